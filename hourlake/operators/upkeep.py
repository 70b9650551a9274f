"""Writing and maintaining stored tables: upsert, append, incremental marts, exports, retention, audit.

Tables are Parquet folders partitioned by date. Plain Parquet has no MERGE, so changed date
partitions are rewritten as a whole: beside the table, on its own file system, and then swapped in
folder by folder with renames. A marker file names a swap that is complete on disk; the next writer of
the table finishes it, so a driver lost at any moment loses and repeats nothing. Executors lost at any
time only repeat tasks. While a swap is carried out, a reader that lists the table just then may miss the
partition that is being renamed; one that has listed its files may have to read again. A table has one writer
at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T

from hourlake import schemas
from hourlake.functions.times import time_literal
from hourlake.operators.filters import DATE_COL, MONTH_COL, prune_dates
from hourlake.operators.windows import latest_per
from hourlake.sources.tables import latest_period

LATE_HOURS = 36
RETAIN_DAYS = 730
ERROR_CHARS = 500


# --- folders ----------------------------------------------------------------------------------


NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def beside(path: str, what: str) -> str:
    """A place next to a table. Its name begins with ``_``, so that readers of the parent skip it."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{name}.{what}"


def _part_name(date_col: str, d: dt.date | None) -> str:
    return f"{date_col}={NULL_PARTITION if d is None else d.isoformat()}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.getFileStatus(p).isDirectory()


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def stored_dates(spark: SparkSession, path: str, date_col: str = DATE_COL) -> list[dt.date]:
    """The dates a table has partitions for, from its folder names alone; rows without a date not counted."""
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    prefix = f"{date_col}="
    return sorted(dt.date.fromisoformat(n[len(prefix) :]) for n in names if n.startswith(prefix) and n != f"{prefix}{NULL_PARTITION}")


def newest_partition(spark: SparkSession, path: str, date_col: str = DATE_COL) -> DataFrame:
    """The rows of a table's newest date. The date comes from the folder names, so the scan is
    pruned to one partition when it is planned."""
    newest = stored_dates(spark, path, date_col)[-1]
    return spark.read.parquet(path).where(F.col(date_col) == F.lit(newest))


# --- plain writes -----------------------------------------------------------------------------


def partition_col(grain: str) -> str:
    """``d`` for the row's day; ``m`` for the first day of its month, for sparse tables whose daily
    files would be tiny."""
    return {"day": DATE_COL, "month": MONTH_COL}[grain]


def with_date(df: DataFrame, time_col: str = "period_utc", grain: str = "day") -> DataFrame:
    date = F.to_date(time_col) if grain == "day" else F.trunc(time_col, grain)
    return df.withColumn(partition_col(grain), date)


@dataclass(frozen=True)
class Buckets:
    """Storage by a hash of ``columns`` in ``n`` files per date, so that tables of equal buckets join without a shuffle.

    Take the whole key, time included: then a hot key spreads over all buckets.
    """

    n: int
    columns: tuple[str, ...]


def _write(df: DataFrame, path: str, mode: str, date_col: str | None, sort_by: list[str] | None = None, buckets: Buckets | None = None) -> None:
    """Partitioned write. Rebalancing gathers a date's rows in few files and splits a date that is
    too big for one task; the sort narrows the value range of each row group. Buckets get a task each."""
    if buckets:
        name = f"hourlake_staged_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets.n, *buckets.columns)
        writer = dealt.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets.n, *buckets.columns).sortBy(*buckets.columns)
        (writer.partitionBy(date_col) if date_col else writer).saveAsTable(name)
        df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: their place was given
    elif date_col:
        df = df.hint("rebalance", date_col)
        if sort_by:
            df = df.sortWithinPartitions(date_col, *sort_by)
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)
    else:
        df.hint("rebalance").write.mode(mode).parquet(path)


def observed(seen: Observation, name: str = "n") -> int:
    """A counter of an observed write; 0 where Spark left the observation out, as it does for plans without rows."""
    try:
        return int(seen.get.get(name) or 0)
    except (AssertionError, Py4JJavaError):  # an observation without a row
        return 0


def read_buckets(spark: SparkSession, path: str, buckets: Buckets, date_col: str | None = DATE_COL) -> DataFrame:
    """A table stored in buckets, read so that Spark knows them. It is entered in the session's catalog under a name of its path."""
    recover(spark, path)
    name = f"hourlake_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    plain = spark.read.parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    by = ", ".join(f"`{c}`" for c in buckets.columns)
    place = path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet {f'PARTITIONED BY (`{date_col}`)' if date_col else ''} "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets.n} BUCKETS LOCATION '{place}'"
    )
    if date_col:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def append_rows(df: DataFrame, path: str, time_col: str | None = "period_utc", grain: str = "day") -> int:
    """Append without looking at what is there. The rows are counted while they are written; none give 0."""
    recover(df.sparkSession, path)
    seen = Observation()
    dated = with_date(df, time_col, grain) if time_col else df
    counted = dated.observe(seen, F.count(F.lit(1)).alias("n"))
    _write(counted, path, "append", partition_col(grain) if time_col else None)
    return observed(seen)


def overwrite_table(df: DataFrame, path: str, time_col: str | None = None, grain: str = "day") -> None:
    """Full refresh. The old content stays until the new one is complete."""
    recover(df.sparkSession, path)
    date_col = partition_col(grain) if time_col else None
    _swap_in(with_date(df, time_col, grain) if time_col else df, path, date_col, whole=True)


# --- upsert -----------------------------------------------------------------------------------


def merged(old: DataFrame, new: DataFrame, keys: list[str], update_cols: list[str] | None = None) -> DataFrame:
    """Old rows with new ones laid over by key. ``update_cols`` limits what a new row changes in an
    existing one; a row that is new altogether keeps everything it brings."""
    names = old.columns + [c for c in new.columns if c not in old.columns]
    update = set(update_cols or [c for c in names if c not in keys])
    o = old.select(*keys, F.struct(*[F.col(c) for c in old.columns]).alias("_o"))
    n = new.select(*keys, F.struct(*[F.col(c) for c in new.columns]).alias("_n"))
    has_old, has_new = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    out: list[Column] = []
    for c in names:
        if c in keys:
            out.append(F.col(c))
            continue
        mine = F.col(f"_o.{c}") if c in old.columns else F.lit(None).cast(new.schema[c].dataType)
        theirs = F.col(f"_n.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        wins = has_new if c in update else ~has_old
        out.append(F.when(wins, theirs).otherwise(mine).alias(c))
    return o.join(n, keys, "full_outer").select(*out)


def one_per_key(rows: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """The row with the largest ``order_col`` of each key; ties go to the largest by all other columns.

    So a repeated task or run keeps the same row. Map columns cannot be compared and don't count.
    """
    rest = [f.name for f in rows.schema if f.name not in [*keys, order_col] and not isinstance(f.dataType, T.MapType)]
    order = [order_col] * (order_col is not None) + rest
    return latest_per(rows, keys, order[0], order[1:]) if order else rows.dropDuplicates(keys)


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], update_cols: list[str] | None = None) -> DataFrame:
    """The rows of ``new`` that are not stored yet or differ in what they would change. Maps count as different."""
    looked_at = [c for c in new.columns if c not in keys and (not update_cols or c in update_cols)]
    stored = old.select(*keys, F.struct(F.lit(True), *[F.col(c) for c in looked_at if c in old.columns]).alias("_o"))
    same = F.col("_o").isNotNull()
    for c in looked_at:
        comparable = c in old.columns and not isinstance(new.schema[c].dataType, T.MapType)
        same = same & (F.col(f"_o.{c}").eqNullSafe(F.col(c)) if comparable else F.lit(False))
    return new.join(stored, keys, "left").where(~same).drop("_o")


def log_changes(rows: DataFrame, logs: Sequence[str], columns: list[str]) -> None:
    """Note the keys and times of rows that are about to change, a batch of its own in each log."""
    for log in logs:
        rows.select(columns).distinct().write.parquet(f"{log}/batch={uuid.uuid4().hex}")


def upsert(
    batch: DataFrame,
    path: str,
    keys: list[str],
    time_col: str | None = "period_utc",
    order_col: str | None = None,
    update_cols: list[str] | None = None,
    grain: str = "day",
    logs: Sequence[str] = (),
    buckets: Buckets | None = None,
) -> int:
    """Insert rows, or update them where their key is stored already. Returns the rows attempted.

    Of several rows of one key in a batch the one with the largest ``order_col`` wins, ties and a missing
    ``order_col`` are decided by all other columns. ``keys`` must hold ``time_col``, or a key that moves
    to another day would be stored twice. A null in a key is an error and nothing is written: set such rows aside
    before (``normalize.split_rejects``). The batch is written once and the merged partitions once; only
    those that the batch touches are read. Their dates are the one thing that comes to the driver.

    With ``logs`` only rows that differ from the stored ones are merged, so a repeated delivery rewrites no
    partition, and their keys are added to each log (see ``refresh``) before the table changes: a run lost in
    between leaves entries too many, never too few.

    ``buckets`` stores the table by a hash of these columns, for joins without a shuffle (``read_buckets``); give every
    upsert of a table the same.
    """
    n, swap = staged_upsert(batch, path, keys, time_col, order_col, update_cols, grain, logs, buckets)
    if swap:
        commit(batch.sparkSession, [swap])
    return n


def staged_upsert(
    batch: DataFrame,
    path: str,
    keys: list[str],
    time_col: str | None = "period_utc",
    order_col: str | None = None,
    update_cols: list[str] | None = None,
    grain: str = "day",
    logs: Sequence[str] = (),
    buckets: Buckets | None = None,
) -> tuple[int, Swap | None]:
    """An upsert up to its last step: (rows attempted, the swap to ``commit``, None if nothing would change)."""
    if time_col and time_col not in keys:
        raise ValueError(f"keys {keys} must contain the time column {time_col}")
    spark = batch.sparkSession
    recover(spark, path)
    seen = Observation()
    nameless = F.lit(False)
    for k in keys:
        nameless = nameless | F.col(k).isNull()
    counted = batch.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(nameless).alias("bad"))
    rows = one_per_key(counted, keys, order_col)
    if time_col:
        rows = with_date(rows, time_col, grain)
    part_col = partition_col(grain) if time_col else None
    landed, differing = (beside(path, f"batch-{uuid.uuid4().hex}") for _ in range(2))
    swap = None

    def stored(touched: str) -> DataFrame:
        old = spark.read.parquet(path)
        return old.where(F.col(part_col).isin(stored_dates(spark, touched, part_col))) if part_col else old

    try:
        _write(rows, landed, "overwrite", part_col, keys, buckets)
        new = spark.read.schema(rows.schema).parquet(landed)
        if new.isEmpty():
            return 0, None
        n, bad = observed(seen), observed(seen, "bad")
        if bad:
            raise ValueError(f"{bad} rows have a null in their key {keys}")
        if not exists(spark, path):
            log_changes(new, logs, keys)
            swap = Swap(landed, path, True)
            return n, swap
        touched = landed
        if logs:
            _write(changed_rows(stored(landed), new, keys, update_cols).select(rows.columns), differing, "overwrite", part_col, keys)
            new, touched = spark.read.schema(rows.schema).parquet(differing), differing
            if new.isEmpty():
                return n, None
            log_changes(new, logs, keys)
        swap = stage(merged(stored(touched), new, keys, update_cols), path, part_col, keys, buckets=buckets)
        return n, swap
    finally:
        if not swap or swap.staged != landed:
            remove_folder(spark, landed)
        remove_folder(spark, differing)


# --- swapping in ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Swap:
    """New content of a table: the ``whole`` of it, or the partitions it has; ``gone`` names partitions that end."""

    staged: str
    path: str
    whole: bool
    gone: tuple[str, ...] = ()


def stage(content: DataFrame, path: str, date_col: str | None, sort_by: list[str] | None = None, whole: bool = False, gone: Sequence[str] = (), buckets: Buckets | None = None) -> Swap:
    """Write ``content`` beside the table and say how it would be swapped in."""
    staged = beside(path, f"staged-{uuid.uuid4().hex}")
    _write(content, staged, "overwrite", date_col, sort_by, buckets)
    return Swap(staged, path, whole or not date_col, tuple(gone))


def _swap_in(content: DataFrame, path: str, date_col: str | None, sort_by: list[str] | None = None, whole: bool = False, gone: Sequence[str] = ()) -> None:
    """Replace the partitions ``content`` has rows for, or the ``whole`` table, by a copy written beside it."""
    commit(content.sparkSession, [stage(content, path, date_col, sort_by, whole, gone)])


def staged_rows(spark: SparkSession, swap: Swap) -> DataFrame:
    """What a swap would bring in."""
    return spark.read.parquet(swap.staged)


def as_committed(spark: SparkSession, path: str, swap: Swap | None, date_col: str | None) -> DataFrame:
    """A table as it will be after ``swap``: the staged partitions instead of the stored ones."""
    if swap is None:
        return spark.read.parquet(path)
    if swap.whole:
        return staged_rows(spark, swap)
    replaced = stored_dates(spark, swap.staged, date_col) + [dt.date.fromisoformat(n.partition("=")[2]) for n in swap.gone]
    old = spark.read.parquet(path).where(F.coalesce(~F.col(date_col).isin(replaced), F.lit(True)))
    return old.unionByName(staged_rows(spark, swap), allowMissingColumns=True)


def discard(spark: SparkSession, swaps: list[Swap]) -> None:
    """Remove staged content that is not to be swapped in."""
    for s in swaps:
        remove_folder(spark, s.staged)


def group_marker(path: str) -> str:
    """The marker file of swaps of several tables of one folder."""
    return beside(path, "pending").rpartition("/")[0] + "/_tables.pending"


def commit(spark: SparkSession, swaps: list[Swap]) -> None:
    """Book swaps in one marker file, then carry them out: all of them or, where the booking fails, none.

    Several tables must lie in one folder. A marker that is there already is another writer's: an error, and
    what was staged is removed.
    """
    if not swaps:
        return
    paths = {s.path for s in swaps}
    if len({group_marker(p) for p in paths}) > 1:
        raise ValueError(f"tables of one swap must share a folder: {sorted(paths)}")
    marker_path = beside(swaps[0].path, "pending") if len(paths) == 1 else group_marker(swaps[0].path)
    fs, marker = _folder(spark, marker_path)
    try:
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{marker_path}-draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps([asdict(s) for s in swaps]).encode()))
        out.close()
        taken = any(exists(spark, m) for m in {group_marker(swaps[0].path), *(beside(p, "pending") for p in paths)})
        if taken or not fs.rename(draft, marker):
            fs.delete(draft, False)
            raise OSError(f"{marker_path} can't be booked: another swap is pending")
    except BaseException:
        discard(spark, swaps)
        raise
    recover(spark, swaps[0].path)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish the swaps that are booked but not carried out to the end, of the table or of several with it.

    Says whether there were any. Each writer calls it first. A folder that is still staged replaces the table's; one
    that isn't has its place already, so the steps can be repeated from anywhere.
    """
    done = [_finish(spark, m) for m in (beside(path, "pending"), group_marker(path))]
    return any(done)


def _finish(spark: SparkSession, marker_path: str) -> bool:
    if not exists(spark, marker_path):
        return False
    fs, marker = _folder(spark, marker_path)
    source = fs.open(marker)
    swaps = [Swap(**x) for x in json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())]
    source.close()
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path

    def move(source: str, target: str) -> None:
        fs.delete(hadoop_path(target), True)
        fs.mkdirs(hadoop_path(target).getParent())
        if not fs.rename(hadoop_path(source), hadoop_path(target)):
            raise OSError(f"{source} can't be renamed to {target}")

    for swap in swaps:
        if exists(spark, swap.staged):
            if swap.whole:
                move(swap.staged, swap.path)
            else:
                for status in fs.listStatus(hadoop_path(swap.staged)):
                    if status.isDirectory():
                        name = status.getPath().getName()
                        move(f"{swap.staged}/{name}", f"{swap.path}/{name}")
                remove_folder(spark, swap.staged)
        for name in swap.gone:
            remove_folder(spark, f"{swap.path}/{name}")
    fs.delete(marker, False)
    return True


def refresh_start(spark: SparkSession, path: str, late_hours: int = LATE_HOURS, time_col: str = "period_utc", grain: str = "day") -> dt.datetime | None:
    """What an incremental run reloads begins after this: the stored maximum less ``late_hours``.

    None on the first run. The newest partition alone is read; the value comes to the driver, so that
    reads of the raw tables can be pruned with it.
    """
    recover(spark, path)
    if not exists(spark, path) or not stored_dates(spark, path, partition_col(grain)):
        return None
    newest = newest_partition(spark, path, partition_col(grain)).agg(F.max(time_col)).first()[0]
    return newest - dt.timedelta(hours=late_hours)


def refresh_mart(
    source: DataFrame, path: str, keys: list[str], late_hours: int = LATE_HOURS, time_col: str = "period_utc", grain: str = "day"
) -> int:
    """Incremental mart: reload what is younger than the stored maximum less ``late_hours`` and
    upsert it; everything on the first run. Stored keys that vanished upstream stay, and so do
    stored versions of rows that changed before the reloaded hours."""
    start = refresh_start(source.sparkSession, path, late_hours, time_col, grain)
    return upsert(since(source, start, time_col), path, keys, time_col, grain=grain)


def since(df: DataFrame, start: dt.datetime | None, time_col: str = "period_utc") -> DataFrame:
    """Rows after ``start``, or all; day and month partitions are pruned."""
    if start is None:
        return df
    bound = time_literal(start, df.schema[time_col].dataType)
    return prune_dates(df, time_col, bound).where(F.col(time_col) > bound)


# --- removal ----------------------------------------------------------------------------------


def retain(spark: SparkSession, path: str, as_of: dt.date, days: int = RETAIN_DAYS, date_col: str = DATE_COL) -> list[dt.date]:
    """Drop date partitions older than ``days``; no data is read. A month goes once its last day is."""
    limit = as_of - dt.timedelta(days=days)

    def last_day(d: dt.date) -> dt.date:
        if date_col != MONTH_COL:
            return d
        return (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)

    old = [d for d in stored_dates(spark, path, date_col) if last_day(d) < limit]
    for d in old:
        remove_folder(spark, f"{path}/{date_col}={d.isoformat()}")
    return old


def purge(spark: SparkSession, path: str, predicate: Column, date_col: str = DATE_COL, logs: Sequence[str] = (), keys: list[str] | None = None) -> int:
    """Delete the rows a predicate holds for and return their number. Only partitions that have
    such rows are rewritten, also that of rows without a date; one left without rows is removed with the same
    swap. ``logs`` are told the ``keys`` of the rows before."""
    recover(spark, path)
    table = spark.read.parquet(path)
    hit = F.coalesce(predicate, F.lit(False))
    per_date = table.groupBy(date_col).agg(F.count_if(hit).alias("gone"), F.count_if(~hit).alias("kept"))
    touched = per_date.where("gone > 0").collect()
    if not touched:
        return 0
    if logs:
        log_changes(table.where(hit), logs, keys)
    rewritten = [r[date_col] for r in touched if r["kept"]]
    of_those = F.col(date_col).isin([d for d in rewritten if d is not None])
    if None in rewritten:
        of_those = of_those | F.col(date_col).isNull()
    gone = [_part_name(date_col, r[date_col]) for r in touched if not r["kept"]]
    _swap_in(table.where(of_those & ~hit), path, date_col, gone=gone)
    return sum(r["gone"] for r in touched)


# --- exports ----------------------------------------------------------------------------------


def export_csv(frames: dict[str, tuple[DataFrame, list[str | Column]]], out: str) -> None:
    """Each frame as a folder of CSV files with headers, in the given order across the files.

    Sorting by range keeps the order without pulling everything through one task, so a large export
    is several files.
    """
    for name, (df, order) in frames.items():
        ordered = df.orderBy(*order) if order else df
        ordered.write.mode("overwrite").option("header", "true").csv(f"{out}/{name}")


# --- audit ------------------------------------------------------------------------------------


def record_run(
    spark: SparkSession, path: str, source: str, status: str, rows: int, started_at: dt.datetime, finished_at: dt.datetime, error: str | None = None, payload: dict | None = None
) -> None:
    """Add a run to the log. ``payload`` is whatever else is worth keeping of it, as a VARIANT."""
    row = [(str(uuid.uuid4()), source, started_at, finished_at, rows, status, error)]
    noted = spark.createDataFrame(row, schemas.INGEST_RUN).withColumn("payload", F.parse_json(F.lit(json.dumps(payload) if payload is not None else None).cast("string")))
    noted.coalesce(1).write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite an unpartitioned table of many small files, such as the log of runs, in few."""
    recover(spark, path)
    _swap_in(spark.read.parquet(path), path, None)


def update_freshness(path: str, source: str, target: DataFrame | str, rows: int, fetched_at: dt.datetime, error: str | None = None, spark: SparkSession | None = None) -> None:
    """After a load: the target's latest period, the fetch time, the rows and a cleared error.

    A target that is given by its path and partitioned by day is read in its newest partition only. The outcome
    is appended, so loads that end at the same time don't overwrite each other's; ``read_freshness`` gives
    the latest per source.
    """
    spark = spark or target.sparkSession
    row = spark.createDataFrame([(source, fetched_at, rows, error)], "source string, last_fetch_utc timestamp, last_rows long, last_error string")
    newest = newest_partition(spark, target) if isinstance(target, str) else target
    full = row.withColumn("last_period_utc", latest_period(newest).cast("timestamp"))
    _note(full.select(*schemas.SOURCE_FRESHNESS.names), path, True, fetched_at)


def freshness_error(spark: SparkSession, path: str, source: str, error: str, failed_at: dt.datetime) -> None:
    """After a failure only ``last_error`` changes: fetch and period stay, so the source still ages."""
    _note(spark.createDataFrame([(source, None, None, None, error)], schemas.SOURCE_FRESHNESS), path, False, failed_at)


def _note(row: DataFrame, path: str, loaded: bool, at: dt.datetime) -> None:
    """Append an outcome. A source's own outcomes are ordered by their time."""
    noted = row.withColumns({"_loaded": F.lit(loaded), "_noted": F.lit(at).cast("timestamp")})
    noted.coalesce(1).write.mode("append").parquet(path)


def read_freshness(spark: SparkSession, path: str) -> DataFrame:
    """One row per source: its last load, with the error of a later failure."""
    names = [c for c in schemas.SOURCE_FRESHNESS.names if c != "source"]
    noted = spark.read.parquet(path)
    loads = F.max(F.when(F.col("_loaded"), F.struct("_noted", "last_fetch_utc", *[c for c in names if c != "last_fetch_utc"])))
    last = noted.groupBy("source").agg(loads.alias("_load"), F.max(F.struct("_noted", "last_error")).alias("_last"))
    columns = [F.col("_last.last_error").alias(c) if c == "last_error" else F.col(f"_load.{c}").alias(c) for c in names]
    return last.select("source", *columns).select(*schemas.SOURCE_FRESHNESS.names)


def compact_freshness(spark: SparkSession, path: str) -> None:
    """Keep of each source only the outcomes that ``read_freshness`` looks at. Not while loads are noted."""
    recover(spark, path)
    noted = spark.read.parquet(path)
    w = W.partitionBy("source", "_loaded").orderBy(F.col("_noted").desc())
    _swap_in(noted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"), path, None)


def run_source(
    spark: SparkSession,
    ops_path: str,
    source: str,
    load: Callable[[], tuple],
    now: Callable[[], dt.datetime],
    error_chars: int | None = ERROR_CHARS,
) -> int:
    """Run one source's load and book the outcome.

    ``load`` returns the rows written, the table they went to or its path, and if it likes a payload to keep with
    the run. A failure is recorded and gives 0, so the other sources go on; ``error_chars`` cuts its text, None
    keeps it whole.
    """
    started = now()
    try:
        rows, target, *payload = load()
    except Exception as e:  # one source must not stop the rest
        text = f"{type(e).__name__}: {e}"[:error_chars]
        record_run(spark, f"{ops_path}/ingest_run", source, "error", 0, started, now(), text)
        freshness_error(spark, f"{ops_path}/source_freshness", source, text, now())
        return 0
    record_run(spark, f"{ops_path}/ingest_run", source, "ok", rows, started, now(), payload=payload[0] if payload else None)
    update_freshness(f"{ops_path}/source_freshness", source, target, rows, now(), spark=spark)
    return rows
