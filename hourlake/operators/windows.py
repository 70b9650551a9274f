"""Window operators over time-ordered rows per key.

A plain ``partitionBy(key)`` window puts all rows of a key in one task. The general operators here
avoid that: a key's history is cut into pieces of bounded length, each piece brings along the few
rows its frame reaches back to, and what must travel further (row numbers, last known values) does
so as one summary row per piece. The results equal those of the plain window.

Rows must be unique per (key, time), which the upsert guarantees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourlake.functions.numbers import pct
from hourlake.functions.times import anchor, bucket_start, interval_hours, seconds_between
from hourlake.operators.filters import trailing
from hourlake.operators.joins import scalar

#: Rows of a piece of a key's history, and rows that a window is evaluated over at once.
BLOCK_ROWS = 100_000
#: Units of time whose rows are counted: the coarse one, and the fine one for coarse ones that hold too many rows.
UNITS = ("1 hour", "1 second")


# --- pieces -----------------------------------------------------------------------------------


def with_units(df: DataFrame, keys: list[str], time_col: str, rows: int = BLOCK_ROWS, units: tuple[str, str] = UNITS) -> DataFrame:
    """Adds ``_unit``, the unit of time of each row, and ``_start``, how many rows of its key lie before that unit.

    A unit is an hour, or within an hour of more than ``rows`` rows a second: keys and times are unique, so
    no unit grows with the data. The counts are added up over a key's units, whose number is bounded by the
    range of time.
    """
    coarse, fine = units
    counts = df.groupBy(*keys, bucket_start(time_col, coarse).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    full = counts.where(F.col("_n") > rows).select(*keys, F.col("_unit").alias("_coarse"), F.lit(True).alias("_full"))
    marked = df.withColumn("_coarse", bucket_start(time_col, coarse)).join(full, [*keys, "_coarse"], "left")
    marked = marked.withColumn("_unit", F.when(F.col("_full"), bucket_start(time_col, fine)).otherwise(F.col("_coarse"))).drop("_full", "_coarse")
    by_unit = marked.groupBy(*keys, "_unit").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_unit").rowsBetween(W.unboundedPreceding, -1))
    starts = by_unit.select(*keys, "_unit", F.coalesce(before, F.lit(0)).alias("_start"))
    return marked.join(starts, [*keys, "_unit"])


def with_pieces(df: DataFrame, keys: list[str], time_col: str, piece: str | int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_piece``: consecutive parts of each key's history, in order.

    A number is a bound of rows, whatever a busy key or hour has: a piece ends with the unit (``with_units``) in which
    its rows reach the bound. A text is a width of time; that needs no counting, but such a piece holds whatever
    falls into it.
    """
    if isinstance(piece, str):
        return df.withColumn("_piece", bucket_start(time_col, piece))
    return with_units(df, keys, time_col, piece).withColumn("_piece", F.floor(F.col("_start") / piece)).drop("_unit", "_start")


def number_rows(df: DataFrame, keys: list[str], time_col: str, into: str = "_row", piece: str | int = BLOCK_ROWS) -> DataFrame:
    """Position of every row in its key's time order, from 1.

    Rows are numbered within a unit or piece; how many rows lie before it comes from a frame with one row per
    key and unit or piece.
    """
    if isinstance(piece, int):
        inside = F.row_number().over(W.partitionBy(*keys, "_unit").orderBy(time_col))
        return with_units(df, keys, time_col, piece).withColumn(into, inside + F.col("_start")).drop("_unit", "_start")
    cut = with_pieces(df, keys, time_col, piece)
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        cut.groupBy(*keys, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(time_col))
    return (
        cut.withColumn("_inside", inside)
        .join(offsets, [*keys, "_piece"])
        .withColumn(into, F.col("_inside") + F.col("_before"))
        .drop("_piece", "_inside", "_before")
    )


def blocked(df: DataFrame, keys: list[str], row_col: str, reach: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, W]:
    """Rows laid out in blocks of ``block_rows`` and the window to evaluate over them.

    The last ``reach`` rows of a block are copied into the next one, so a frame that looks back at
    most ``reach`` rows sees the same rows as over the whole key. Drop the copies afterwards with
    ``where(OWN_ROW)``.
    """
    block_rows = max(block_rows, reach)
    block = F.floor((F.col(row_col) - 1) / block_rows)
    tail = (F.col(row_col) - 1) % block_rows >= block_rows - reach
    targets = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    laid_out = df.withColumn("_home", block).withColumn("_block", F.explode(targets))
    return laid_out, W.partitionBy(*keys, "_block").orderBy(row_col)


OWN_ROW = "_home = _block"


def with_lags(
    df: DataFrame, keys: list[str], time_col: str, value_col: str, lags: list[int], by: str = "rows", block_rows: int = BLOCK_ROWS, piece: str | int = BLOCK_ROWS
) -> DataFrame:
    """Earlier values of each key as columns ``lag_n``; all columns stay.

    ``by='rows'`` counts rows, so gaps shift the match; ``by='time'`` looks up the row exactly n
    hours earlier. The latter is one aggregation on (key, time): every row is also sent to the
    times it is the lag of.
    """
    if by == "rows":
        numbered = number_rows(df, keys, time_col, piece=piece)
        laid_out, w = blocked(numbered, keys, "_row", max(lags), block_rows)
        columns = {f"lag_{n}": F.lag(value_col, n).over(w) for n in lags}
        return laid_out.withColumns(columns).where(OWN_ROW).drop("_row", "_home", "_block")
    if by != "time":
        raise ValueError(f"by must be 'rows' or 'time', got {by!r}")
    copies = [F.struct(F.lit(0).alias("n"), F.col(time_col).alias("at"))]
    copies += [F.struct(F.lit(n).alias("n"), (F.col(time_col) + interval_hours(n)).alias("at")) for n in lags]
    rest = [c for c in df.columns if c not in (*keys, time_col, value_col)]
    sent = df.select(*keys, F.col(value_col).alias("_v"), F.struct(F.lit(1), *rest).alias("_rest"), F.explode(F.array(*copies)).alias("_c"))
    own = F.max(F.when(F.col("_c.n") == 0, F.col("_v"))).alias(value_col)
    others = [F.first(F.when(F.col("_c.n") == 0, F.col("_rest")), True).alias("_rest")] if rest else []
    columns = [F.max(F.when(F.col("_c.n") == n, F.col("_v"))).alias(f"lag_{n}") for n in lags]
    matched = sent.groupBy(*keys, F.col("_c.at").alias(time_col)).agg(
        own, *others, *columns, F.count_if(F.col("_c.n") == 0).alias("_own")
    )
    matched = matched.where("_own > 0").withColumns({c: F.col(f"_rest.{c}") for c in rest})
    return matched.select(*df.columns, *[f"lag_{n}" for n in lags])


ROLLING = {"avg": F.avg, "stddev_samp": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}


def rolling(
    df: DataFrame,
    keys: list[str],
    time_col: str,
    value_col: str,
    fn: str,
    n: int = 168,
    min_n: int = 24,
    shift: int = 0,
    into: str | None = None,
    block_rows: int = BLOCK_ROWS,
    piece: str | int = BLOCK_ROWS,
) -> DataFrame:
    """A rolling measure over the last ``n`` rows, null below ``min_n`` values.

    ``shift`` moves the frame back, so ``shift=1`` leaves the row itself out. A standard deviation
    of zero becomes null.
    """
    into = into or f"{value_col}_{fn}_{n}"
    numbered = number_rows(df, keys, time_col, piece=piece)
    laid_out, w = blocked(numbered, keys, "_row", n - 1 + shift, block_rows)
    frame = w.rowsBetween(-(n - 1 + shift), -shift)
    measure = ROLLING[fn](value_col).over(frame)
    if fn == "stddev_samp":
        measure = F.nullif(measure, F.lit(0.0))
    gated = F.when(F.count(value_col).over(frame) >= min_n, measure)
    return laid_out.withColumn(into, gated).where(OWN_ROW).drop("_row", "_home", "_block")


# --- known values before and after ------------------------------------------------------------


def neighbours(df: DataFrame, keys: list[str], time_col: str, value_col: str, piece: str | int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_prev`` and ``_next``: the (time, value) of the nearest non-null value at or before
    and at or after each row.

    Within a piece a window finds them. Across pieces they come from one summary row per key and
    piece holding its first and last known value.
    """
    known = F.when(F.col(value_col).isNotNull(), F.struct(F.col(time_col).alias("t"), F.col(value_col).alias("v")))
    cut = with_pieces(df, keys, time_col, piece).withColumn("_known", known)
    by_piece = W.partitionBy(*keys).orderBy("_piece")
    summary = (
        cut.groupBy(*keys, "_piece")
        .agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
        .select(
            *keys,
            "_piece",
            F.last("_last", True).over(by_piece.rowsBetween(W.unboundedPreceding, -1)).alias("_carry_prev"),
            F.first("_first", True).over(by_piece.rowsBetween(1, W.unboundedFollowing)).alias("_carry_next"),
        )
    )
    inside = W.partitionBy(*keys, "_piece").orderBy(time_col)
    back = F.last("_known", True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("_known", True).over(inside.rowsBetween(0, W.unboundedFollowing))
    return (
        cut.withColumns({"_back": back, "_ahead": ahead})
        .join(summary, [*keys, "_piece"])
        .withColumns({"_prev": F.coalesce("_back", "_carry_prev"), "_next": F.coalesce("_ahead", "_carry_next")})
        .drop("_piece", "_known", "_back", "_ahead", "_carry_prev", "_carry_next")
    )


def fill(df: DataFrame, keys: list[str], time_col: str, value_col: str, order: str = "bf", piece: str | int = BLOCK_ROWS) -> DataFrame:
    """Nulls filled from neighbours: ``b`` takes the next known value, ``f`` the previous one, in
    the order given."""
    sides = {"b": F.col("_next.v"), "f": F.col("_prev.v")}
    filled = F.coalesce(F.col(value_col), *[sides[side] for side in order])
    return neighbours(df, keys, time_col, value_col, piece).withColumn(value_col, filled).drop("_prev", "_next")


def interpolate(df: DataFrame, keys: list[str], time_col: str, value_col: str, piece: str | int = BLOCK_ROWS) -> DataFrame:
    """Inner nulls replaced by the straight line between their neighbours in time."""
    span = seconds_between("_prev.t", "_next.t")
    done = seconds_between("_prev.t", time_col)
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * done / F.nullif(span, F.lit(0.0))
    return (
        neighbours(df, keys, time_col, value_col, piece)
        .withColumn(value_col, F.coalesce(F.col(value_col), line))
        .drop("_prev", "_next")
    )


# --- latest rows ------------------------------------------------------------------------------


def tail_per(df: DataFrame, keys: list[str], time_col: str, n: int) -> DataFrame:
    """The last ``n`` rows per key. Spark keeps at most n rows per key and task before the shuffle
    (window group limit), so a hot key does not travel whole."""
    w = W.partitionBy(*keys).orderBy(F.col(time_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per(df: DataFrame, keys: list[str], time_col: str, ties: list[str] | None = None) -> DataFrame:
    """The latest row per key; the same pruning as ``tail_per``."""
    w = W.partitionBy(*keys).orderBy(F.col(time_col).desc(), *[F.col(c).desc() for c in ties or []])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latest_vintage(forecast: DataFrame, keys: list[str], fit_col: str = "fit_at_utc", ties: list[str] | None = None) -> DataFrame:
    """The most recently fitted forecast of each period and key."""
    return latest_per(forecast, keys, fit_col, ties)


def latest_readings(weather: DataFrame, as_of=None, hours: int = 6, mode: str = "furthest") -> DataFrame:
    """One reading per station from the last ``hours``.

    The window has no upper end, so with forecast feeds ``furthest`` is the hour furthest ahead.
    ``nearest`` takes the reading closest to the reference time.
    """
    recent = trailing(weather, "period_utc", hours, as_of)
    if mode == "furthest":
        return latest_per(recent, ["station_id"], "period_utc")
    now = anchor(weather, "period_utc", as_of)
    near = recent.withColumn("_off", -F.abs(seconds_between(now, "period_utc")))
    return latest_per(near, ["station_id"], "_off", ["period_utc"]).drop("_off")


# --- headline ---------------------------------------------------------------------------------


def demand_headline(demand: DataFrame, as_of=None, hours: int = 48, day: int = 24, aligned: bool = False) -> DataFrame:
    """Network demand now against a day ago.

    "Now" is each key's own latest row and "a day ago" the row ``day`` rows before it. So only the
    last ``day + 1`` rows per key matter, and Spark prunes to them before the shuffle. ``aligned``
    compares one common hour with the hour 24 hours earlier instead.
    """
    recent = trailing(demand, "period_utc", hours, as_of)
    v = F.col("value_mwh")
    if aligned:
        now = scalar(recent, F.max("period_utc"))
        t = F.col("period_utc")
        is_now, is_before = t == now, t == now - interval_hours(day)
        rows = recent.where(is_now | is_before)
        keys = F.countDistinct(F.when(is_now, F.col("ba_code")))
    else:
        back = F.row_number().over(W.partitionBy("ba_code").orderBy(F.col("period_utc").desc()))
        rows = recent.select("ba_code", "period_utc", "value_mwh", back.alias("_back")).where(F.col("_back") <= day + 1)
        is_now, is_before = F.col("_back") == 1, F.col("_back") == day + 1
        keys = F.count_if(is_now)  # one latest row per key
    out = rows.agg(
        F.max(F.when(is_now, F.col("period_utc"))).alias("as_of_utc"),
        F.sum(F.when(is_now, v)).alias("total_mwh_now"),
        F.sum(F.when(is_before, v)).alias("total_mwh_24h_ago"),
        keys.alias("bas"),
    )
    change = F.col("total_mwh_now") - F.col("total_mwh_24h_ago")
    return out.withColumn("delta_pct", pct(change, "total_mwh_24h_ago", "nullif"))


# --- normalising ------------------------------------------------------------------------------


def pct_of_peak(timeline: DataFrame, key: str = "ba_code") -> DataFrame:
    """Actual and forecast as percent of the key's own peak over both; negative values are dropped
    and a key without a positive peak gives null."""
    a = F.when(F.col("actual") >= 0, F.col("actual"))
    y = F.when(F.col("yhat") >= 0, F.col("yhat"))
    peaks = timeline.groupBy(key).agg(F.max(F.greatest(a, y)).alias("_peak"))
    return (
        timeline.join(peaks, key)
        .withColumns({"actual_pct": pct(a, "_peak"), "yhat_pct": pct(y, "_peak")})
        .drop("_peak")
    )


def minmax01(df: DataFrame, value_col: str, into: str) -> DataFrame:
    """Values scaled to 0..1 between the smallest and the largest; a span of zero counts as one."""
    lo, hi = scalar(df, F.min(value_col)), scalar(df, F.max(value_col))
    span = F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))
    share = (F.col(value_col) - lo) / span
    clamped: Column = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return df.withColumn(into, F.when(F.col(value_col).isNotNull(), clamped))
