"""Reading and writing: inventories, evaluation cases, runtime logs, exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.catalog import apply_exclusions


def scan_inventory(spark: SparkSession, root: str, names: tuple = (), globs: tuple = (), extensions: tuple = ()) -> DataFrame:
    """Files under ``root`` that no rule excludes (as in ``apply_exclusions``), with their path from there; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    name = F.element_at(F.split("path", "/"), -1)
    base = root.rstrip("/").rpartition(":")[2].lstrip("/")
    relative = F.regexp_replace("path", "^[A-Za-z0-9+.-]*:?/*" + re.escape(base) + "/", "")
    out = f.select("path", relative.alias("relative_path"), name.alias("display_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "size_bytes", "modified_at")
    return apply_exclusions(out.withColumn("canonical_path", F.col("relative_path")), list(names), list(globs), list(extensions)).drop("canonical_path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of text files, which are split and read like any other.

    A split's rows come in order and without gaps in ``monotonically_increasing_id``, and its offset in the file is known, so a
    line's number is its place in the split after the lines of the splits before. Those counts are a row a split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def read_eval_cases(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Cases of JSONL files or of files with one JSON array, and rejected lines (``file, line_no, value``).

    Each file is of the one kind or the other, by the first character of its first line that isn't blank. Blank and ``#`` lines are skipped; an array that
    doesn't parse is rejected as line 1. JSONL files are read in splits; a file with an array has no lines to split at, and one task reads it whole.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value"))
    kinds = lines.filter("value != ''").groupBy("file").agg(F.min_by("value", "line_no").alias("first"))
    arrays = [r["file"] for r in kinds.filter("startswith(first, '[')").select("file").collect()]  # names of files
    own = lines.filter(~F.col("file").isin(arrays)) if arrays else lines
    own = own.filter("value != '' and not startswith(value, '#')")
    bad = lambda: F.try_parse_json("value").isNull()
    cases = own.filter(~bad()).select(F.from_json("value", schema).alias("row")).select("row.*")
    rejected = own.filter(bad())
    if arrays:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("file").isin(arrays))
        cases = cases.unionByName(whole.filter(~bad()).select(F.explode(F.from_json("value", f"array<struct<{schema}>>" if not schema.startswith("struct") else f"array<{schema}>")).alias("row")).select("row.*"))
        rejected = rejected.unionByName(whole.filter(bad()).select("file", F.lit(1).cast("long").alias("line_no"), "value"))
    return cases, rejected


def write_samples_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV or JSON with 1 to 200 columns; nested cells as compact JSON, null as an empty cell; never overwrites."""
    if not 1 <= len(df.columns) <= 200:
        raise ValueError("1 to 200 columns can be exported")
    flat = [F.coalesce(F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("emptyValue", "").format(fmt).save(path)


def read_runtime_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSONL log; unparsable rows are dropped, levels normalised, and all other fields put in the map ``fields``."""
    schema = "timestamp string, level string, event string, session_id string, sequence long, correlation_id string"
    rows = spark.read.text(path).filter(F.get_json_object("value", "$.event").isNotNull())
    known = [c.split(" ")[0] for c in schema.split(", ") if c.split(" ")[0] not in ("session_id", "sequence", "correlation_id")]
    fields = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(known) & v.isNotNull())
    rows = rows.select(F.from_json("value", schema).alias("r"), fields.alias("fields")).select("r.*", "fields")
    level = F.lower("level")
    return rows.withColumn("level", F.when(level.isin("error", "fatal"), "error").when(level.startswith("warn"), "warning").when(level.isin("debug", "trace"), "debug").otherwise("info"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)
