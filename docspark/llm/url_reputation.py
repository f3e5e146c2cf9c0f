"""URL rules, and host reputation by empirical Bayes where no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small

#: The rules of the query, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Under a country code, these labels form a suffix under which names are registered, as in ``co.uk``.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org", "sch")
TWO_LABELS = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, else null: a chain of tests, longest rule first; no join."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _shrunk(groups: DataFrame, key: str, parent_mean: Column) -> DataFrame:
    """Posterior of each group under a beta prior around ``parent_mean`` whose strength all groups give.

    The strength is the moment estimate of the beta-binomial: observed spread of the groups' rates
    around their prior means, less what binomial noise explains, kept within 1 and 1000.
    """
    g = groups.withColumn("m", parent_mean)
    noise = F.col("m") * (1 - F.col("m"))
    spread = g.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)).alias("s"),
        F.sum(noise).alias("e"),
        F.sum(F.col("n") * noise).alias("b"),
    )
    rho = (F.col("s") - F.col("e")) / (F.col("b") - F.col("e"))
    strength = spread.select(F.when(F.col("b") > F.col("e"), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / F.greatest(rho, F.lit(1e-6)) - 1))).otherwise(F.lit(1000.0)).alias("k"))
    return g.crossJoin(F.broadcast(strength)).withColumns({  # strength: one row
        f"{key}_alpha": F.col("k") * F.col("m") + F.col("good"),
        f"{key}_beta": F.col("k") * (1 - F.col("m")) + F.col("n") - F.col("good"),
    }).drop("k", "m")


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    min_good_share: float = 0.8,
    z: float = 1.645,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and the host's posterior mean and bound.

    ``outcomes`` has ``page_id, good`` (0/1; null counts as unlabelled, an id labelled twice counts once,
    bad if any label is). Good rates are shrunk from all pages to suffix, to registered domain, to host; a page
    that no rule fits stays only if its host is credibly good: it is blocked when the lower posterior bound of the
    host's good rate is below ``min_good_share`` of the rate of all pages. Hosts without labels have their domain's
    posterior, so they are blocked only where hosts differ much. Ports, user names and trailing dots belong to the host
    but not to its domain; the empty host is a host. Repeated pages each have a row and count each; a null page id has no
    label. An empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    labelled = judged.join(labels, "page_id", "left")
    hosts = cut(labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    name = F.rtrim(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), F.lit("."))
    labels_of = F.split(name, r"\.")
    tail = lambda k: F.array_join(F.slice(labels_of, F.greatest(F.lit(1), F.size(labels_of) - (k - 1)), k), ".")
    two = name.rlike(TWO_LABELS)
    hosts = hosts.withColumns({"suffix": F.when(two, tail(2)).otherwise(tail(1)), "domain": F.when(two, tail(3)).otherwise(tail(2))})
    totals = hosts.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("top"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).crossJoin(F.broadcast(totals))
    suffixes = _shrunk(suffixes, "suffix", F.col("top")).select("suffix", (F.col("suffix_alpha") / (F.col("suffix_alpha") + F.col("suffix_beta"))).alias("suffix_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(suffixes, "suffix")
    domains = _shrunk(domains, "domain", F.col("suffix_mean")).select("domain", "suffix", (F.col("domain_alpha") / (F.col("domain_alpha") + F.col("domain_beta"))).alias("domain_mean"))
    hosts = _shrunk(hosts.join(domains, ["domain", "suffix"]), "host", F.col("domain_mean"))
    mean = F.col("host_alpha") / (F.col("host_alpha") + F.col("host_beta"))
    total = F.col("host_alpha") + F.col("host_beta")
    lower = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (total + 1)))
    hosts = hosts.crossJoin(F.broadcast(totals)).select(F.col("host").alias("h"), mean.alias("good_rate"), lower.alias("lower_bound"), (lower < min_good_share * F.col("top")).alias("doubtful"))  # totals: one row
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for verdict, text in rules:
        by_rule = F.when(F.col("rule") == text, verdict).otherwise(by_rule)
    return (
        join_small(judged, cut(hosts), F.col("host") == F.col("h"))
        .withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("doubtful"), "block").otherwise("allow")).alias("verdict"), F.round("good_rate", 6).alias("good_rate"), F.round("lower_bound", 6).alias("lower_bound"))
    )
