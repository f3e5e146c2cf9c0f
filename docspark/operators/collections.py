"""Rule collections over files and their contents. Rules are a parameter list and become expressions of one scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_word(column: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(F.lower(column), F.lit(w.lower())) for w in words))


def _checks(rule: dict, now: str) -> list[Column]:
    name, path = F.col("display_name"), F.col("canonical_path")
    made = {
        "extensions": lambda v: F.lower("extension").isin([e.lower() for e in v]),
        "filename_keywords": lambda v: _any_word(name, v),
        "path_keywords": lambda v: _any_word(path, v),
        "parse_statuses": lambda v: F.col("parse_status").isin(list(v)),
        "modified_within_days": lambda v: F.col("modified_at") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(v)),
        "min_size_bytes": lambda v: F.col("size_bytes") >= v,
        "max_size_bytes": lambda v: F.col("size_bytes") <= v,
    }
    return [make(rule[k]) for k, make in made.items() if rule.get(k)]


def rule_matches(rule: dict, now: str) -> Column:
    """The rule's own checks joined by all or any, less its exclusions; without checks all holds and any doesn't."""
    checks = _checks(rule, now)
    base = reduce(and_ if rule.get("operator", "all") == "all" else or_, checks) if checks else F.lit(rule.get("operator", "all") == "all")
    for key, column in (("exclude_filename_keywords", "display_name"), ("exclude_path_keywords", "canonical_path")):
        if rule.get(key):
            base = base & ~_any_word(F.col(column), rule[key])
    if rule.get("exclude_extensions"):
        base = base & ~F.lower("extension").isin([e.lower() for e in rule["exclude_extensions"]])
    return F.coalesce(base, F.lit(False))


def apply_rules(files: DataFrame, rules: list[dict], now: str) -> DataFrame:
    """``collection_id, file_id`` for every rule that a file meets; one pass over the files, no join."""
    hits = F.array_compact(F.array(*[F.when(rule_matches(r, now), F.lit(r["collection_id"])) for r in rules]))
    return files.select(F.explode(hits).alias("collection_id"), "file_id")


def apply_text_rules(chunks: DataFrame, rules: list[dict]) -> DataFrame:
    """``collection_id, file_id`` of files in which a chunk has an included word and no chunk an excluded one."""
    inc = [F.bool_or(_any_word(F.col("text"), r["text_keywords"])).alias(f"i{n}") for n, r in enumerate(rules)]
    exc = [F.bool_or(_any_word(F.col("text"), r["exclude_text_keywords"])).alias(f"x{n}") for n, r in enumerate(rules) if r.get("exclude_text_keywords")]
    flags = chunks.groupBy("file_id").agg(*inc, *exc)
    hit = [F.when(F.col(f"i{n}") & (~F.col(f"x{n}") if r.get("exclude_text_keywords") else F.lit(True)), F.lit(r["collection_id"])) for n, r in enumerate(rules)]
    return flags.select(F.explode(F.array_compact(F.array(*hit))).alias("collection_id"), "file_id")


def rule_violations(rules: DataFrame) -> DataFrame:
    """``collection_id, problem``: no check at all, days outside 1 to 3650, or the least size above the largest."""
    days, low, high = F.col("modified_within_days"), F.col("min_size_bytes"), F.col("max_size_bytes")
    empty = days.isNull() & low.isNull() & high.isNull() & (F.coalesce(F.size("extensions"), F.lit(0)) <= 0)
    problems = F.array_compact(F.array(F.when(empty, "empty"), F.when((days < 1) | (days > 3650), "days"), F.when(low > high, "sizes")))
    return rules.select("collection_id", F.explode(problems).alias("problem"))


def collection_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(F.count_distinct("file_id").alias("files"))


def suggestion_checks(suggestions: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """``suggestion_id, members, valid``: named, two members or more, all authorised, name unlike any member's."""
    m = members.join(files.select("file_id", F.lower("display_name").alias("file_name")), "file_id", "left").join(suggestions, "suggestion_id")
    g = m.groupBy("suggestion_id").agg(F.count(F.lit(1)).alias("members"), F.bool_and(F.col("file_name").isNotNull()).alias("known"), F.bool_or(F.coalesce(F.lower("name") == F.col("file_name"), F.lit(False))).alias("same"))
    out = suggestions.join(g, "suggestion_id", "left").fillna(0, ["members"])
    valid = (F.trim("name") != "") & (F.col("members") >= 2) & F.col("known") & ~F.col("same")
    return out.select("suggestion_id", "members", F.coalesce(valid, F.lit(False)).alias("valid"))


def member_listing(members: DataFrame, files: DataFrame) -> DataFrame:
    """``collection_id, place, file_id, display_name``: each collection's files by name (case aside), then id; members that are no files go."""
    from pyspark.sql import Window

    named = members.select("collection_id", "file_id").distinct().join(files.select("file_id", "display_name"), "file_id")
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.lower("display_name"), "file_id"))
    return named.select("collection_id", place.alias("place"), "file_id", "display_name")
