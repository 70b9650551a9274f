"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourlake.llm.common import hash_unit, join_small
from hourlake.session import shared_dir


def poisson_steps(mean: Column) -> Column:
    """Cumulative Poisson probabilities P(0), P(0..1), ... up to where nothing below 2^-60 is missing.

    Each is computed from logarithms, so that no term underflows before its time.
    """
    last = (mean + 14 * F.sqrt(mean) + 40).cast("int")
    logs = F.transform(F.sequence(F.lit(1), last), lambda k: F.log(mean) - F.log(k))
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(s: Column, x: Column) -> Column:
        total = s["sum"] + F.exp(s["log"] + x)
        return F.struct((s["log"] + x).alias("log"), total.alias("sum"), F.concat(s["all"], F.array(total)).alias("all"))

    return F.when(mean > 0, F.aggregate(logs, start, step, lambda s: s["all"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source: str, weights: DataFrame | None, power: float, total: int | None) -> tuple[DataFrame, int]:
    """One row per source with its mean repetition rate, written to the shared folder, and their number.

    The rate is (target rows of the source) / (its rows), where the targets are ``total`` (default: as many
    as there are) split by weight. Weights come from ``weights`` (source, weight) or are rows ** ``power``.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "mixing-rates")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_source"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_source").cast("double"), F.lit(power)))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n_source", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes.write.parquet(path)
    sizes = spark.read.parquet(path)
    rows, n, all_weights = sizes.agg(F.count(F.lit(1)), F.sum("n_source"), F.sum("weight")).first()
    scale = (n if total is None else total) / all_weights if all_weights else 0.0
    mean = F.col("weight") * F.lit(scale) / F.col("n_source")
    return sizes.select("source", mean.alias("mean")), rows


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    power: float = 0.5,
    total: int | None = None,
    seed: int = 7,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``docs`` with each row repeated by a Poisson count, in a global random order.

    A row's count is the inverse of the Poisson distribution with its source's mean repetition rate
    at a number in [0, 1) hashed from ``seed`` and ``key``; the rates bring the sources to their target weights.
    Columns are added after those of ``docs``: _copy from 1, _copies and _order, a hashed number by which
    the rows are dealt to the tasks in ranges and sorted. All columns of ``docs`` are kept, whatever
    their names. Null sources are one source, sources without a weight get no rows, rows of one
    key and source get the same count, null keys count as an empty key.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rates, n_sources = source_rates(docs, source, weights, power, total)
    steps = rates.select("source", poisson_steps(F.col("mean")).alias("_steps"))
    rows = docs.toDF(*names)
    id_text = F.coalesce(F.col(at[key]).cast("string"), F.lit(""))
    rows = join_small(rows, steps, "source", n_sources, left=at[source])
    u = hash_unit(id_text, seed=seed)
    rows = rows.withColumn("_copies", F.size(F.filter("_steps", lambda c: c <= u))).where("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rows = rows.withColumn("_order", hash_unit(id_text, F.col("_copy").cast("string"), seed=seed + 1)).orderBy("_order")
    return rows.select(*names, "_copy", "_copies", "_order").toDF(*docs.columns, "_copy", "_copies", "_order")
