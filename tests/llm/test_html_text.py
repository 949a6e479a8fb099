"""Main text extraction on pages of several layouts, malformed markup and edge cases."""

import random

import pytest

from aerolith.llm.html_text import extract, main_text

P1 = "The first paragraph of the article, which has a comma, and goes on for a good while so that it scores."
P2 = "A second paragraph follows here, with more words, and it is long enough to be counted as prose too."
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>"


@pytest.mark.parametrize("page", [
    f"<html><body>{NAV}<article><p>{P1}</p><p>{P2}</p></article><footer>(c) site</footer></body></html>",
    f"<body><div class='top-menu'><a href=x>m</a></div><div id='content'><p>{P1}<p>{P2}</div><div class='sidebar'><p>{P1}</p></div>",
    f"<div class=wrap><div class='post'><div><p>{P1}</p></div><div><p>{P2}</p></div></div><div id='comments'><p>{P2}, I say, so, there, it, is</p>"
    f"<article class='comment'><p>{P1}</p></article></div></div>",
    f"<main><p>{P1}</p><div class='ad'>Buy, now, cheap, things, of, all, sorts</div><form><p>{P1}</p><input></form><p>{P2}</p></main>",
    f"<div class='page has-sidebar'><div class='cookie-notice'><p>{P1}</p></div><section><p>{P1}</p><script>var t='</p>';</script>"
    f"<p>{P2}</p></section><aside><p>{P2}</p></aside></div>",
    f"<table><tr><td><ul><li><a href=1>one</a><li><a href=2>two</a></ul><td><p>{P1}<p>{P2}</table>",
    f"<body><p style='display:none'>{P1}</p><div class=story><p>{P1.replace('first', '<b>first')}<p>{P2}</div>",
])
def test_layouts(page):
    assert main_text(page) == f"{P1}\n{P2}"


def test_words_of_a_class_do_not_take_article_text():
    page = (f"<article><p>The <span class='search-hit'>quick</span> brown fox is <span class='tag'>fast</span>, and it runs on for long.</p>"
            f"<p class='legal'>{P1}</p><div class='alert'><p>{P2}</p></div><div class='tags'><a href=1>one</a> <a href=2>two</a></div></article>")
    assert main_text(page) == f"The quick brown fox is fast, and it runs on for long.\n{P1}\n{P2}"


@pytest.mark.parametrize("tag", ["svg", "math", "template", "noscript"])
def test_an_element_without_an_end_does_not_swallow_the_page(tag):
    assert main_text(f"<article><p>{P1}</p><{tag} width=1><p>{P2}</p></article>") == f"{P1}\n{P2}"
    assert main_text(f"<article><p>{P1}</p><script>var a = '<p>{P2}</p>'") == P1


def test_points_decide_between_elements():
    """An article element that holds little of the page's text is not the article."""
    teaser = "<article><h2>Another story</h2><p>A short line about it, no more than this.</p></article>"
    long = "".join(f"<p>{P1} {P2} Number {k}, with commas, too.</p>" for k in range(8))
    got = main_text(f"<body>{teaser}{teaser}<div id=story>{long}</div></body>")
    assert got.count("Number") == 8 and got.splitlines()[-1].startswith("The first")
    page = f"<main><div class=rail><ul><li><a href=1>{P1}</a></li><li><a href=2>{P2}</a></li></ul></div><h1>Title</h1><div><div>{long}</div></div></main>"
    assert main_text(page).splitlines()[0] == "Title" and main_text(page).count("Number") == 8


def test_random_layouts_give_the_planted_article():
    """Pages made of a known article and known noise around it and within, in many layouts."""
    rnd = random.Random(11)
    say = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet, consectetur elit, sed do eiusmod tempor".split()) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(n))
    noise = [lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f"<div class='ad'>{say(25)}</div>", lambda: f"<aside><p>{say(40)}</p></aside>",
             lambda: f"<div class='sidebar left'><ul>{links(5)}</ul><p>{say(30)}</p></div>", lambda: f"<div id='cookie-notice'>{say(20)}</div>",
             lambda: f"<form><p>{say(20)}</p><input name=q></form>", lambda: f"<script>var x = '<p>{say(30)}</p>';</script>",
             lambda: f"<style>p {{ color: red }}</style><!-- <p>{say(30)}</p> -->", lambda: f"<div class='related-links'><ul>{links(4)}</ul></div>"]
    after = [lambda: f"<section class='comments'><div class='comment'><p>{say(30)}</p></div><div class='comment'><p>{say(45)}</p></div></section>",
             lambda: f"<footer><p>{say(12)}</p><ul>{links(3)}</ul></footer>"]
    for _ in range(300):
        paragraphs = [say(rnd.randint(25, 90)) for _ in range(rnd.randint(3, 9))]
        title = say(5)
        body = "".join(f"<p>{x.replace('dolor', rnd.choice(['dolor', '<b>dolor</b>', '<a href=x>dolor</a>']), 1)}</p>"
                       + (rnd.choice(noise)() if rnd.random() < 0.2 else "") for x in paragraphs)
        inner = f"<h1>{title}</h1>{body}"
        kind = rnd.choice(["article", "main", "div", "nested", "sections"])
        if kind == "nested":
            inner = f"<article><header><h1>{title}</h1></header><div class=body><div class=text>{body}</div></div></article>"
        elif kind == "sections":
            inner = f"<article><h1>{title}</h1><section>{body}</section></article>"
        else:
            inner = f"<{kind} class=content>{inner}</{kind}>"
        page = "<html><head><title>t</title></head><body>" + "".join(f() for f in rnd.sample(noise, 3)) + inner \
            + "".join(f() for f in after if rnd.random() < 0.7) + "</body></html>"
        assert main_text(page) == "\n".join([title, *paragraphs]), page


def test_references_and_white_space():
    page = f"<article><p>A &amp; B&nbsp;&lt;tag&gt; &eacute; &#233; &copy x,\n\t {P1}</p><p>a<br>b</p></article>"
    assert main_text(page) == f"A & B <tag> é é © x, {P1}\na\nb"


def test_title_and_short_blocks_of_the_article_stay():
    page = f"<article><h1>Title</h1><p>{P1}</p><p>Ok.</p><pre>x\n y</pre></article>"
    assert main_text(page) == f"Title\n{P1}\nOk.\nx y"


def test_malformed_and_empty():
    assert main_text(None) == main_text("") == main_text("<html><body></body>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>cut <b") == "cut"
    assert main_text("</div></p><p>a<p>b</i>") == "a\nb"
    assert main_text("<a '" * 3000 + ">") == ""
    assert main_text("<div>" * 20_000 + P1) == P1


def test_operator(spark):
    rows = [(1, "u", f"<article><p>{P1}</p></article>", 7), (2, None, None, 7), (2, None, None, 7), (None, "u", "", 7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", P1, len(P1)), (2, None, "", 0), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_a_very_long_page_is_read_whole(spark):
    page = "<article>" + "".join(f"<p>{P1} {k}</p>" for k in range(30_000)) + "</article>"
    (row,) = extract(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")).collect()
    assert row.text.count("\n") == 29_999 and row.n_chars == len(row.text)
