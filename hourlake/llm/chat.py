"""Chat formatting: logged snapshots that others continue are left out, the rest rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourlake.session import shared_dir

#: Turns in one block, which is sorted, numbered and rendered by one task.
BLOCK = 256


def _word(c: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c).cast("decimal(20,0)")


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, role, text, h1, h2): distinct turns with their place from 0 and rolling hashes of what is before and at them.

    A conversation is cut by turn number into blocks; places and hashes run within a block and are carried
    over by one row per block, so no task needs a whole conversation. The hashes are sums over the turns of
    hashes of (place, role, text), which makes them a prefix's own.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.distinct().withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    in_block = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(in_block) - 1)
    rows = _carried(rows, before).withColumn("pos", F.col("pos") + F.col("ahead")).drop("ahead")
    item = F.struct("pos", "role", "text")
    rows = rows.withColumns({"h1": _word(item, 1), "h2": _word(item, 2)})
    sums = rows.groupBy("conv", "block").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    before = sums.select("conv", "block", *[F.coalesce(F.sum(h).over(ahead), F.lit(0)).alias(f"ahead_{h}") for h in ("h1", "h2")])
    running = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({h: F.sum(h).over(running) for h in ("h1", "h2")})
    rows = _carried(rows, before)
    return rows.select("conv", "pos", "role", "text", *[(F.col(h) + F.col(f"ahead_{h}")).cast("decimal(38,0)").alias(h) for h in ("h1", "h2")])


def _carried(rows: DataFrame, before: DataFrame) -> DataFrame:
    right = before.withColumnsRenamed({"conv": "_c", "block": "_b"})
    return rows.join(right, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")


def maximal(turns: DataFrame) -> DataFrame:
    """Of numbered turns those of conversations that no longer one begins with; of equal ones the smallest stays."""
    whole = turns.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    whole = whole.select("conv", F.col("last.pos").alias("pos"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))
    unique = whole.groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"))
    ends = whole.select(F.col("conv").alias("_c"), F.col("pos").alias("_end"))
    inner = turns.select("conv", "pos", "h1", "h2").join(ends, F.col("conv").eqNullSafe(F.col("_c"))).where("pos < _end")
    prefixes = inner.select("pos", "h1", "h2").distinct()
    kept = unique.join(prefixes, ["pos", "h1", "h2"], "left_anti").select(F.col("conv").alias("_c"), (F.col("pos") + 1).alias("n_turns"))
    return turns.join(kept, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c")


def chat_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, part, n_turns and rendered of every conversation that isn't the beginning of another.

    Turns are ordered by number (null first), role and text; exactly repeated rows are one turn. Conversations
    whose turns are the first ones of a longer conversation go; of equal ones the smallest id stays (an id before
    none). A turn is rendered as ``<|role|>``, newline, text, ``<|end|>``, newline. Up to ``BLOCK`` turns are one
    row, a longer conversation has parts 0, 1, ... that joined are its text. Null roles and texts are empty; rows of a null id are one conversation.
    """
    base = shared_dir(turns.sparkSession, "chat")
    numbered(turns, conv, turn, role, text).write.parquet(base)
    kept = maximal(turns.sparkSession.read.parquet(base))
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    parts = kept.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("part")).agg(F.first("n_turns").alias("n_turns"), lines.alias("lines"))
    return parts.select(F.col("conv").alias(conv), "part", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
