"""Registry of checked queries: one Spark builder and (where SQL can say it)
one independent DuckDB oracle per operator of the inventory.

Conventions for the cross-engine comparison, applied identically on both
sides: averages and deviations are rounded to 6 places, and date-valued
columns are handed over as midnight ``TIMESTAMP`` values (pandas holds DATE
from one engine as ``datetime.date`` and from the other as ``datetime64``).

Rounding goes through DECIMAL(38,12) on both engines: the double is first
fixed to 12 places, then rounded half-up to 6. Two engines summing the same
values in different orders differ around 1e-16, far below 1e-12, so a value
sitting exactly on a half (an average like 36.49943 / 44 = 0.8295325) rounds
the same way on both instead of following each engine's last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings every query relies on, applied whoever made the
    session: UTC (NTZ facts hold UTC wall clock) and a shared scratch root."""
    from aerolith.session import checkpoint_root
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)


def register(name: str, oracle_sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__, run.__module__ = fn.__name__, fn.__doc__, fn.__module__
        QUERIES[name] = run
        if oracle_sql is not None:
            ORACLES[name] = decimal_rounding(oracle_sql)
        return fn
    return deco


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round the named double columns via DECIMAL(38,12), half-up (see module note)."""
    return df.select(*[F.round(F.col(c).cast("decimal(38,12)"), places).cast("double").alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def decimal_rounding(sql: str, places: int = 6) -> str:
    """Rewrite every ``ROUND(expr, 6)`` of an oracle into the same DECIMAL
    rounding as ``rounded`` (text rewrite with balanced parentheses)."""
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, comma = j + len(key), 1, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[j + len(key):comma], sql[comma + 1:k - 1].strip()
        if digits != str(places):
            out.append(sql[j:k])
        else:
            inner = decimal_rounding(inner, places)
            out.append(f"CAST(ROUND(CAST({inner} AS DECIMAL(38,12)), {places}) AS DOUBLE)")
        i = k


def dates_as_timestamps(df: DataFrame) -> DataFrame:
    """Hand DATE columns over as midnight TIMESTAMP_NTZ (see module note)."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.DateType) else F.col(f.name)
                       for f in df.schema.fields])


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from aerolith.plans import queries_core  # noqa: F401
    from aerolith.plans import queries_io  # noqa: F401
