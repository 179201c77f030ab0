"""URL filter by empirical-Bayes host reputation.

Labelled pages (good or bad) are counted per host, registered domain and suffix. Each level's rate is shrunk
towards the level above by a beta-binomial prior whose strength comes from how much the groups of that level
differ (moments), and a page is blocked where even the upper bound of its host's posterior is too low.
Explicit rules come first. Everything is built-in column work: partial counts before each shuffle, so a host
with most of the pages is one row per task, and joins on keys that adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FLOOR, Z = 0.5, 2.0
#: Prior strengths outside this range say "all alike" or "nothing in common".
WEAKEST, STRONGEST = 0.5, 1000.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def with_url_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``: both empty for a null url or one without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract(after, r"^[^?#]*", 0))


def suffix_of(host: Column) -> Column:
    """The last label."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The last two labels: the registered domain under a one-label suffix."""
    return F.substring_index(host, ".", -2)


def rule_column(rules: tuple[Rule, ...], field: str) -> Column:
    """The longest fitting rule's ``field``, null where none fits. Rules are configuration: a short list."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, getattr(r, field)) if out is None else out.when(fits, getattr(r, field))
    return F.lit(None).cast("string") if out is None else out


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level from (n, k, parent's rate ``m``): the moments of a beta-binomial."""
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))
    row = groups.where("m > 0 and m < 1 and n > 0").agg(F.sum(spread).alias("s"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).first()
    if not row.g or row.g < 2:
        return STRONGEST
    free = row.n - row.q / row.n - (row.g - 1)
    rho = (row.s - (row.g - 1)) / free if free > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, (1 - rho) / rho)) if 0 < rho < 1 else STRONGEST if rho <= 0 else WEAKEST


def reputation(pages: DataFrame) -> DataFrame:
    """Per host: ``n``, ``k`` (labelled and good pages), ``mean`` and ``upper`` of its posterior.

    ``pages`` has ``host`` and ``good`` (1, 0 or null). A host without labels has its domain's rate at the
    prior's strength; without any label at all nothing is known and nothing is blocked.
    """
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = stored(hosts, "hosts")  # one row per host, read several times below
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = (whole.k or 0) / whole.n if whole.n else 0.5

    def level(groups: DataFrame, keys: list[str]) -> tuple[DataFrame, float]:
        s = _strength(groups)
        return groups.select(*keys, ((F.col("k") + F.lit(s) * F.col("m")) / (F.col("n") + s)).alias("m")), s

    top, _ = level(suffixes.withColumn("m", F.lit(base)), ["suffix"])
    mid, _ = level(domains.join(top, "suffix"), ["domain", "suffix"])
    low = hosts.join(mid, ["domain", "suffix"])
    s = _strength(low)
    a, b = F.col("k") + F.lit(s) * F.col("m"), F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("m"))
    mean = a / (a + b)
    upper = F.least(F.lit(1.0), mean + Z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    return low.select("host", "n", "k", mean.alias("mean"), upper.alias("upper"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, floor: float = FLOOR) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``reputation`` and ``verdict`` to ``pages`` (url, good).

    The longest rule that fits decides; else a page is blocked if its host's upper bound is below ``floor``.
    Null urls and urls without ``://`` share the empty host. Repeated rows are each judged; columns of
    those names are replaced. The empty table gives the empty table.
    """
    own = with_url_parts(pages.drop("rule", "reputation", "verdict"))
    known = reputation(own).select("host", F.col("upper").alias("reputation"))
    method = F.when(F.col("reputation") < floor, "block").otherwise("allow")
    return own.join(known, "host", "left").withColumn("rule", rule_column(rules, "name")).withColumn("verdict", F.coalesce(rule_column(rules, "verdict"), method))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` with ``good``: the label of the document whose number ends the url's path.

    Good is quality 1 and not toxic; of several labels for one number the worst counts.
    """
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__number")).agg(F.min(good).alias("good"))
    own = pages.drop("good").withColumn("__number", number.try_cast("bigint"))
    return own.join(known, "__number", "left").drop("__number")
