"""Landed JSON whose shape drifts: nothing is lost, whatever a source adds, changes or breaks.

Each line of a file is a record. The whole record is kept as a VARIANT beside the declared fields, so fields that
the schema doesn't name yet can be read back later by their path. Records that are no JSON objects are set
aside with their file; a declared field of another type is null and named in ``drifted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_records(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Lines of the files below ``path`` with the file they come from; blank lines are no records."""
    reader = spark.readStream if stream else spark.read
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("line") != "")


def parse_records(records: DataFrame, schema: T.StructType, line: str = "line") -> DataFrame:
    """The columns of ``records``, the declared fields, ``record`` (VARIANT), ``drifted`` (names) and ``broken`` (why, or null).

    A field that is present with a value that can't be cast to its type is null and drifted. An absent or null
    field is null. A broken record has null fields and its line.
    """
    record = F.try_parse_json(line)
    rows = records.withColumn("record", record).withColumn("_kind", F.schema_of_variant("record"))
    is_object = F.col("_kind").startswith("OBJECT")
    broken = F.when(F.col("record").isNull(), "not json").when(~is_object, "not an object")
    rows = rows.withColumn("broken", broken)
    good = F.col("broken").isNull()
    read = {f.name: F.when(good, field(f.name, f.dataType)) for f in schema}
    there = {f.name: good & present(f.name) for f in schema}
    rows = rows.withColumns({f"_f_{n}": c for n, c in read.items()})
    wrong = [F.when(there[f.name] & F.col(f"_f_{f.name}").isNull(), f.name) for f in schema]
    drifted = F.array_compact(F.array(*wrong))
    out = rows.withColumn("drifted", drifted)
    rest = [c for c in records.columns if c not in schema.names]
    return out.select(*rest, *[F.col(f"_f_{n}").alias(n) for n in schema.names], "record", "drifted", "broken")


def _path(name: str) -> str:
    return "$" + "".join(f"['{p}']" for p in name.split("."))


def field(path: str, kind: T.DataType | str, record: str = "record") -> Column:
    """A value of a stored record by its path, such as ``response.total``; null if it isn't there or of another type."""
    return F.try_variant_get(record, _path(path), kind if isinstance(kind, str) else kind.simpleString())


def present(path: str, record: str = "record") -> Column:
    """Whether a record has a value at a path that is not null."""
    value = F.try_variant_get(record, _path(path), "variant")
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


def split_broken(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine): the latter with file, line and reason."""
    return parsed.where("broken IS NULL").drop("broken", "line"), parsed.where("broken IS NOT NULL").select("file", "line", F.col("broken").alias("reason"))


def drift_report(parsed: DataFrame) -> DataFrame:
    """Records per file and what is the matter with them: ok, a reason, or ``type of`` a field; a record may count for several fields."""
    reasons = F.when(F.col("broken").isNotNull(), F.array("broken")).when(F.size("drifted") > 0, F.transform("drifted", lambda n: F.concat(F.lit("type of "), n)))
    return parsed.select("file", F.explode(F.coalesce(reasons, F.array(F.lit("ok")))).alias("reason")).groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))
