"""Scalar Column functions (O-F1 .. O-F23).

All are native Catalyst expressions: they stay inside whole-stage codegen and
need no Python UDF (O-U3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.functions import fixed

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- time
def to_day(ts: ColumnOrName) -> Column:
    """O-F1 SQL form: timestamp -> DATE."""
    return F.to_date(_c(ts))


def to_midnight(ts: ColumnOrName) -> Column:
    """O-F1 pandas form (``dt.normalize()``): midnight of the same day, NTZ."""
    return F.to_date(_c(ts)).cast("timestamp_ntz")


def weekday_number_sql(ts: ColumnOrName) -> Column:
    """O-F2 SQL numbering: Sunday = 0 .. Saturday = 6."""
    return (F.dayofweek(_c(ts)) - 1).cast("long")


def weekday_number_monday0(ts: ColumnOrName) -> Column:
    """O-F2 pandas numbering: Monday = 0 .. Sunday = 6."""
    return F.weekday(_c(ts)).cast("long")


def weekday_name(ts: ColumnOrName) -> Column:
    """O-F3 full English day name (T4: ``dayname`` would give 'Sun')."""
    return F.date_format(_c(ts), "EEEE")


def weekend_flag(ts: ColumnOrName) -> Column:
    """O-F4 1 on Saturday/Sunday, else 0."""
    return F.when(F.weekday(_c(ts)) >= 5, F.lit(1)).otherwise(F.lit(0)).cast("long")


def floor_hour(ts: ColumnOrName) -> Column:
    """O-F5 floor to the hour; ``date_trunc`` yields TIMESTAMP, cast back to NTZ."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def parse_utc(text: ColumnOrName) -> Column:
    """O-F6 ISO-8601 with ``Z`` or an offset -> UTC wall clock as NTZ.

    The session zone is UTC, so the instant parsed with its offset is rendered
    in UTC before the zone is dropped. Unparseable text becomes null.
    """
    t = F.try_to_timestamp(_c(text))
    return t.cast("timestamp_ntz")


def month_text(ts: ColumnOrName) -> Column:
    """O-F7 zero-padded month text ('01')."""
    return F.date_format(_c(ts), "MM")


def year_number(ts: ColumnOrName) -> Column:
    return F.year(_c(ts)).cast("long")


def minus_hours(ts: ColumnOrName, hours: int) -> Column:
    """O-F20 interval subtraction."""
    return _c(ts) - F.make_dt_interval(F.lit(0), F.lit(hours))


def minus_days(ts: ColumnOrName, days: int) -> Column:
    """O-F19 current-minus-N-days style arithmetic."""
    return _c(ts) - F.make_dt_interval(F.lit(days))


def utc_now() -> Column:
    """O-F19 current time, one value per query, as NTZ UTC."""
    return F.current_timestamp().cast("timestamp_ntz")


# ---------------------------------------------------------------- numbers
def nan_to_null(x: ColumnOrName) -> Column:
    """NaN is missing. Applied once at ingestion, before every filter."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_number(x: ColumnOrName) -> Column:
    """O-F16 numeric coercion, bad text -> null (plain cast raises under ANSI)."""
    return nan_to_null(_c(x).cast("string").try_cast("double"))


def clip_lower(x: ColumnOrName, lower: float = 1.0) -> Column:
    """O-F17 clip from below; null stays null (``greatest`` would skip it)."""
    c = _c(x)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lower)))


def abs_zscore(x: ColumnOrName, mean: ColumnOrName, std: ColumnOrName) -> Column:
    """O-F23 |(x - mean) / std|; zero or null deviation gives null."""
    return F.abs((_c(x) - _c(mean)) / F.nullif(_c(std), F.lit(0.0)))


# ---------------------------------------------------------------- text
def slug(x: ColumnOrName) -> Column:
    """O-F14 file-name slug: lower case, space and slash -> underscore."""
    return F.translate(F.lower(_c(x)), " /", "__")


def contains_ci(x: ColumnOrName, term: str) -> Column:
    """O-F15 case-insensitive LIKE '%term%' (``%`` and ``_`` stay wildcards)."""
    return F.lower(_c(x)).like(f"%{term.lower()}%")


def blank_to_null(x: ColumnOrName) -> Column:
    return F.nullif(_c(x), F.lit(""))


def default_text(x: ColumnOrName, default: ColumnOrName) -> Column:
    """O-F18 empty or null text -> default."""
    return F.coalesce(blank_to_null(x), _c(default))


def name_or_id(name: ColumnOrName, id_col: ColumnOrName) -> Column:
    """O-F18 / O-J9: location name, else the id as text."""
    return default_text(name, _c(id_col).cast("string"))


# ---------------------------------------------------------------- quality score (F8)
def _literal_map(pairs: dict) -> Column:
    """A constant map (folded to one literal by Catalyst)."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def quality_score(parameter: ColumnOrName, value: ColumnOrName,
                  thresholds: dict[str, tuple[float, float]] | None = None) -> Column:
    """O-F8 score in [0, 1]: 0.5 for an unknown parameter, 0.0 outside the
    range (inclusive bounds), else ``1 - (v - min) / (max - min)``.

    A null value of a known parameter scores null (T23; the row is dropped by
    the keep rule either way). A value equal to the maximum scores 0 (T13).
    The ranges are two constant maps, so the expression stays small inside
    whole-stage codegen however often the optimizer inlines it.
    """
    th = thresholds or fixed.QUALITY_THRESHOLDS
    p, v = _c(parameter), _c(value)
    lo = F.try_element_at(_literal_map({k: float(mn) for k, (mn, _) in th.items()}), p)
    hi = F.try_element_at(_literal_map({k: float(mx) for k, (_, mx) in th.items()}), p)
    score = F.lit(1.0) - (v - lo) / (hi - lo)
    return (F.when(hi.isNull(), F.lit(fixed.UNKNOWN_PARAMETER_SCORE))
             .when(v.isNull(), F.lit(None).cast("double"))
             .when((v < lo) | (v > hi), F.lit(0.0))
             .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))


def parameter_label(parameter: ColumnOrName) -> Column:
    """O-J8 label of a parameter code, default upper case (constant map)."""
    p = _c(parameter)
    return F.coalesce(F.try_element_at(_literal_map(fixed.PARAMETER_LABELS), p), F.upper(p))


# ---------------------------------------------------------------- AQI
def aqi_estimate(pm25: ColumnOrName, pm10: ColumnOrName) -> Column:
    """O-F9 max of the non-null particulates, 0.0 when both are missing."""
    return F.coalesce(F.greatest(_c(pm25), _c(pm10)), F.lit(0.0))


def _aqi_band(aqi: ColumnOrName, pick: int, contiguous: bool) -> Column:
    a = _c(aqi)
    bands = fixed.AQI_BREAKPOINTS
    expr = F.when(a.isNull(), F.lit(fixed.AQI_NO_READING[pick - 2]))
    for i, band in enumerate(bands):
        low, high = band[0], band[1]
        if contiguous:
            upper = bands[i + 1][0] if i + 1 < len(bands) else high
            cond = (a >= low) & ((a < upper) if i + 1 < len(bands) else (a <= upper))
        else:
            cond = (a >= low) & (a <= high)
        expr = expr.when(cond, F.lit(band[pick]))
    return expr.otherwise(F.lit(fixed.AQI_OUT_OF_BANDS[pick - 2]))


def aqi_category(aqi: ColumnOrName, contiguous: bool = False) -> Column:
    """O-F10 band label. Bands have gaps by default (T10): 50.5, negatives and
    values above 500 all fall through to 'Hazardous'."""
    return _aqi_band(aqi, 2, contiguous)


def aqi_color(aqi: ColumnOrName, contiguous: bool = False) -> Column:
    """O-F11 band colour."""
    return _aqi_band(aqi, 3, contiguous)


def aqi_share_degrees(aqi: ColumnOrName) -> Column:
    """O-F12 min(aqi / 500, 1) * 360."""
    return F.least(_c(aqi) / F.lit(fixed.AQI_SCALE_MAX), F.lit(1.0)) * F.lit(360.0)
