"""Column functions on texts, paths and keys; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def token_estimate(text: Column) -> Column:
    """White space 0, ASCII letters and digits a quarter, any other character 1; rounded up, at least 1."""
    quarter = F.length(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    whole = F.length(F.regexp_replace(text, r"(?U)[0-9A-Za-z\s]", ""))
    return F.greatest(F.lit(1), F.ceil(quarter * 0.25 + whole)).cast("long")


def detect_script(text: Column) -> Column:
    """``zh``, ``en``, ``mixed`` or ``unknown`` by the presence of Han and ASCII letters."""
    han, latin = text.rlike(f"[{HAN}]"), text.rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").when(latin, "en").otherwise("unknown")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize_terms(text: Column) -> Column:
    """Terms in order of appearance: Han runs as single characters and bigrams, other runs in lower case."""
    runs = F.regexp_extract_all(text, F.lit(rf"([{HAN}]+|[\p{{L}}\p{{N}}&&[^{HAN}]]+)"), 1)

    def grams(run: Column) -> Column:
        singles = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{HAN}]"), F.concat(singles, pairs)).otherwise(F.array(F.lower(run)))

    # Texts without Han characters, told by one search, need no look at each run.
    return F.when(text.rlike(f"[{HAN}]"), F.flatten(F.transform(runs, grams))).otherwise(F.transform(runs, F.lower))


def path_key(path: Column) -> Column:
    r"""``/`` to ``\``, long-path prefixes and trailing ``\`` removed, lower case."""
    p = F.lower(F.translate(path, "/", "\\"))
    p = F.regexp_replace(p, r"^\\\\\?\\unc\\", r"\\\\")
    p = F.regexp_replace(p, r"^\\\\\?\\", "")
    return F.regexp_replace(p, r"\\+$", "")


def display_path(path: Column, parts: int = 3) -> Column:
    r"""Absolute paths keep their last ``parts`` parts behind ``…\``; relative ones stay whole."""
    p = F.regexp_replace(path, r"^\\\\\?\\", "")
    names = F.filter(F.split(p, r"[\\/]"), lambda x: x != "")
    short = F.array_join(F.slice(names, F.greatest(F.lit(1), F.size(names) - (parts - 1)), parts), "\\")
    absolute = p.rlike(r"^([A-Za-z]:[\\/]|[\\/])")
    return F.when(absolute & (F.size(names) > parts), F.concat(F.lit("…\\"), short)).otherwise(p)


def version_key(name: Column) -> Column:
    """A file's name without extension, copy words, and trailing digits, brackets, dashes and ``v``."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    stem = F.regexp_replace(stem, r"(副本|copy|最终版|final)", "")
    return F.regexp_replace(stem, r"[0-9\-_ ()\[\]v]+$", "")


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.octet_length(F.encode(text, "UTF-8")))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    step = lambda acc, i: F.pmod(acc.bitwiseXOR(byte(i)) * F.lit(16777619), F.lit(1 << 32))
    return F.when(F.octet_length(F.encode(text, "UTF-8")) > 0, F.aggregate(at, F.lit(2166136261).cast("long"), step)).otherwise(F.lit(2166136261).cast("long"))


def dev_or_holdout(key: Column, ratio: float = 0.7) -> Column:
    return F.when(fnv1a32(key) < F.lit(int(ratio * (2**32 - 1))), "DEV").otherwise("HOLDOUT")
