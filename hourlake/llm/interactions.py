"""How quality filters interact: what each removes in every order, by potentials of the removal game."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
#: Multiples of the orders' number make all potentials whole numbers: their denominators are 1 to 5.
ORDERS = 120
KINDS = ("n", "good", "toxic")


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: str) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]+", ""))
    fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.char_length(t), "D": t.rlike("[#$%&*|]")}
    return sum((F.when(c, _bit(f)).otherwise(0) for f, c in fails.items()), F.lit(0))


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with good and toxic as 0 or 1. Rows without a key are dealt out by their content, not as one key."""
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_bad"))
    kind = rows.schema["id"].dataType
    known = known.select(F.col("_key").cast(kind).alias("_key"), F.lit(False).alias("_keyless"), "_good", "_bad")
    keyed = rows.withColumn("_keyless", F.col("id").isNull()).withColumn("_key", F.coalesce("id", F.xxhash64("name", "part").cast(kind)))
    joined = keyed.join(known, ["_key", "_keyless"], "left")
    return joined.withColumns({"good": F.coalesce("_good", F.lit(0)), "toxic": F.coalesce("_bad", F.lit(0))}).drop("_key", "_keyless", "_good", "_bad")


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail.

    Filter E fails a text that a smaller key has too. Texts are named by sha-256. Copies are counted per
    text, part and label before their smallest key is sought, so no group of copies meets in one task:
    all of a text's documents fail E but those with its smallest key.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("name"), text_failures(text).alias("mask"),
    ).groupBy("id", "part", "name", "mask").agg(F.count(F.lit(1)).alias("n"))
    copies = _labelled(rows, labels, key).groupBy("name", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("keyless"),
    )
    smallest = copies.groupBy("name").agg(F.min("least.id").alias("_first"))
    first = F.when(F.col("least.id") == F.col("_first"), F.col("least.n")).otherwise(0) + F.col("keyless")
    split = F.array(
        F.struct(F.col("mask"), first.alias("n")),
        F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - first).alias("n")),
    )
    found = copies.join(smallest, "name").select("part", "good", "toxic", F.explode(split).alias("s")).where("s.n > 0")
    sums = {"n": F.col("s.n"), "good": F.col("s.n") * F.col("good"), "toxic": F.col("s.n") * F.col("toxic")}
    return found.groupBy("part", F.col("s.mask").alias("mask")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def removal_games(counts: DataFrame) -> DataFrame:
    """One row per part: total and, as arrays over the 32 coalitions, what each removes (``n``, ``good``, ``toxic``).

    A coalition is the set of bits of its place in the array; it removes the documents that fail one
    of its filters at least.
    """
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = (
        counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(EVERY))))
        .groupBy("part", "coalition")
        .agg(F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(k)).otherwise(0)).alias(k) for k in KINDS])
    )
    ordered = F.array_sort(F.collect_list(F.struct("coalition", *KINDS)))
    games = removed.groupBy("part").agg(F.max("total").alias("total"), ordered.alias("v"))
    return games.select("part", "total", *[F.col("v")[k].alias(k) for k in KINDS])


def potentials(removed: str) -> Column:
    """``ORDERS`` times the Hart-Mas-Colell potential of each coalition of a removal game, as an array.

    The empty coalition's is 0; that of any other is its worth plus the potentials without each of its
    members, divided by its size. Subsets have smaller numbers, so one pass over the coalitions in order
    has what it needs; the divisions leave no remainder.
    """

    def add(found: Column, coalition: Column) -> Column:
        without = [F.when(coalition.bitwiseAND(F.lit(_bit(f))) != 0, F.get(found, coalition - _bit(f))).otherwise(0) for f in FILTERS]
        worth = ORDERS * F.get(F.col(removed), coalition)
        return F.concat(found, F.array(F.call_function("div", sum(without, worth), F.bit_count(coalition))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EVERY)), F.array(F.lit(0).cast("bigint")), add)


def interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row per part (``part``), order of the five filters and step: what the step removes and what it would.

    All counts are differences of coalitions of the removal game: kept after the step, removed by it,
    redundant (failing its filter, removed earlier), unique_fails (failing no other filter), good_lost and
    toxic_lost. ``shapley`` is ``ORDERS`` times the filter's Shapley value, the potential of all filters less that
    without it: what it removes, summed over all orders.

    Null texts and parts count as empty. Repeated rows count each; they are no copies of each other,
    as their key isn't smaller. Rows without a key have no label, don't fail E and make no other fail it.
    Of several labels of one key the largest count; null labels are none. An empty table gives no rows;
    other columns are ignored.
    """
    games = removal_games(failure_counts(docs, labels, key, text, part)).withColumn("potential", potentials("n"))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.expr("substring(filter_order, step, 1)")
    place = F.expr("substring(filter_order, 1, step - 1)")
    steps = steps.withColumns({
        "_own": sum((F.when(letter == f, _bit(f)).otherwise(0) for f in FILTERS), F.lit(0)),
        "_before": sum((F.when(F.contains(place, F.lit(f)), _bit(f)).otherwise(0) for f in FILTERS), F.lit(0)),
    })

    def of(kind: str, coalition: Column) -> Column:
        return F.get(F.col(kind), coalition)

    own, before, after = F.col("_own"), F.col("_before"), F.col("_own") + F.col("_before")
    removed = {k: of(k, after) - of(k, before) for k in KINDS}
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - of("n", after)).alias("kept"),
        removed["n"].alias("removed"),
        (of("n", own) - removed["n"]).alias("redundant"),
        (of("n", F.lit(EVERY)) - of("n", F.lit(EVERY) - own)).alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        (of("potential", F.lit(EVERY)) - of("potential", F.lit(EVERY) - own)).alias("shapley"),
    )
