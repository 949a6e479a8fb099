"""Token ids by a public tokenizer file, exact and cached by unit.

A text is cut into units that the tokenizer never joins, each distinct unit is encoded
once by the ``tokenizers`` library, and the ids are put together.

* A byte-level pre-tokenizer never joins what stands on the two sides of a single white
  space between other characters, except that a space goes with the word after it. White
  space in runs or beyond ASCII is kept whole.
* A tokenizer that lower-cases and drops white space never joins across any white space,
  and reads A-Z as a-z. In a Latin-1 text it reads all letters in lower case, and a point,
  comma or exclamation mark with no mark beside it stands alone.

Most units are one run of letters, which is one pre-token: its bytes go straight to the
library's merge model. Everything else goes through the whole library. A text with the
string of a special token, or with a control character that only Python takes for white
space, is encoded whole, as any text is under a tokenizer of another kind. ``tests/llm``
holds the result against a plain call of the library.
"""

from __future__ import annotations

import gc
import json
import re
import string
from array import array
from functools import lru_cache

_RUNS = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_OTHER_SPACE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
_CONTROL = re.compile("[\x1c-\x1f]")
_UNIT = re.compile(r"\s?\S+(?:\s{2,}\S+)*(?:\s+\Z)?|\s+\S+(?:\s{2,}\S+)*(?:\s+\Z)?|\s+", re.ASCII)
_MARKS = string.punctuation
#: What a Latin-1 character is: a mark that ends words, another mark, or neither.
_CLASSES = bytes(46 if c in ".,!" else 32 if c.isalnum() or c.isspace() else 33 for c in map(chr, range(256)))
#: Bytes of one generation of the cache, as estimated; two are held. Longer units are not kept.
MAX_BYTES, ENTRY_BYTES, MAX_UNIT = 112 << 20, 200, 64


def _byte_letters() -> dict[int, str]:
    """The character that stands for a byte in byte-level vocabularies: printable ones for themselves,
    the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


_LETTERS = _byte_letters()


def _bytes_as_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


class _Known(dict):
    """Unit -> ids; what is not there is learned when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, unit: str) -> bytes:
        return self.learn(unit)


class Encoder:
    """``encode(texts)``: ids of each text as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"].lower() for t in made["added_tokens"]]
        self.odd = not all("<" in x for x in self.special)
        self.kind = _kind(made)
        self.plain, self.tokenize = self.kind == "words", self.model.tokenize
        self.units = {"bytes": self._byte_units, "words": self._word_units, "other": lambda t: []}[self.kind]
        self.known = _Known(self._learn)
        self.before: dict[str, bytes] = {}  # the generation before: what is used again moves on
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _byte_units(self, text: str) -> list[str]:
        """The units of a text; a unit that begins with a space stands without it, one that
        begins otherwise with a mark before it."""
        wide = not text.isascii() and any(c in text for c in _OTHER_SPACE)
        if not wide and not any(x in text for x in _RUNS):  # only single spaces and line ends
            first, *rest = text.replace("\n", " \x00\n \x00").split(" ")
            return ["\x00" + first, *rest] if first and not first.startswith("\x00") else [first, *rest] if first else rest
        if wide:
            return ["\x00" + text]
        return [u[1:] if u[0] == " " else "\x00" + u for u in _UNIT.findall(text)]

    @staticmethod
    def _word_units(text: str) -> list[str]:
        """The units of a text: Latin-1 lower-cases one by one and composes nothing. A mark that
        stands beside no other one is a pre-token of its own, so a word is one unit before it and elsewhere."""
        try:
            marks = text.encode("latin-1").translate(_CLASSES)
        except UnicodeEncodeError:
            return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").split()
        text = text.lower()
        if not (b".." in marks or b".!" in marks or b"!." in marks):
            text = text.replace(".", " . ").replace(",", " , ").replace("!", " ! ")
        return text.split()

    def _raw(self, unit: str) -> str:
        return unit if self.kind == "words" else unit[1:] if unit[:1] == "\x00" else " " + unit

    def _letters(self, unit: str) -> str | None:
        """What the merge model takes for a unit that is one run of letters, else None. Beyond U+024F,
        or U+00FF where case and composition matter, the library decides what a letter is."""
        if self.kind == "words":
            if not unit.isalpha():
                return None
            return unit if unit.isascii() else _bytes_as_letters(unit.lower()) if max(unit) <= "\xff" else None
        space = unit[:1] != "\x00"
        word = unit if space else unit[1:]
        if not word.isalpha():
            return None
        own = word if word.isascii() else _bytes_as_letters(word) if max(word) <= "\u024f" else None
        return own and ("\u0120" + own if space else own)

    def _learn(self, unit: str) -> bytes:
        """The ids of a unit, from the generation before or anew. Marks at the end of a word are pre-tokens
        of their own, so a word is encoded once whatever mark it stands before. Short units are kept."""
        ids = self.before.get(unit)
        if ids is None:
            letters = unit if self.plain and unit.isascii() and unit.isalpha() else self._letters(unit)
            if letters is not None:
                ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
            else:
                word = unit.rstrip(_MARKS)
                if len(word) < len(unit) and word[-1:].lower().isalpha():  # a dotted capital I ends in a mark
                    mark = unit[len(word):]
                    ids = self.known[word] + self.known[mark if self.kind == "words" else "\x00" + mark]
                else:
                    ids = self._whole([self._raw(unit)])[0]
        if len(unit) <= MAX_UNIT:
            dict.__setitem__(self.known, unit, ids)
            self.held += ENTRY_BYTES + len(unit) + len(ids)
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Nothing here makes reference cycles, but it holds so many small objects that
        the cycle collector would take a quarter of the time; it rests meanwhile."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _cut(self, text: str | None) -> list[str]:
        """The units of a text; none if it is to be encoded whole."""
        if not text or "\x00" in text or _CONTROL.search(text):
            return []
        if "<" in text or self.odd:
            low = text.lower()  # lower-casing must not make a special token
            if any(x in low for x in self.special):
                return []
        return self.units(text)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for t in texts:
            if self.held > MAX_BYTES:
                self.before, self.known, self.held = dict(self.known), _Known(self._learn), 0
            units = self._cut(t)
            out.append(b"".join(map(self.known.__getitem__, units)) if units else self._whole([t])[0] if t else b"")
        return out


def _kind(made: dict) -> str:
    """"bytes", "words" or "other", by the normalizer and pre-tokenizer of a tokenizer file."""
    steps = lambda x, key: [] if x is None else [s["type"] for s in x.get(key, [x])]
    norm, pre = made["normalizer"], made["pre_tokenizer"]
    plain = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not made["model"].get("byte_fallback") \
        and made["model"].get("unk_token") is None and made["post_processor"] is None
    if plain and norm is None and steps(pre, "pretokenizers") == ["ByteLevel"] and pre["use_regex"] and not pre["add_prefix_space"]:
        return "bytes"
    if plain and steps(norm, "normalizers") == ["NFC", "Replace", "Lowercase"] and steps(pre, "pretokenizers") == ["Split", "ByteLevel"]:
        split = pre["pretokenizers"][0]
        if split["invert"] and split["behavior"] == "Removed" and r"[\p{L}]+" in split["pattern"].get("Regex", "") and r"[^\s" in split["pattern"]["Regex"]:
            return "words"
    return "other"


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Encoder(path)
