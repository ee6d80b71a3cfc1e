"""URL filters from a path-template tree, in DataFrame functions only.

Per host, numbers and identifiers in path segments become wildcards. The tree has a level for each segment of the deepest
path. Branches of one parent whose labelled block rate does not differ from the parent's (a two-sided test) merge into
one wildcard branch, however many or long they are. A template's purity is the share of blocked rows among its labelled
rows, smoothed towards its parent's; templates above ``REJECT_AT`` are rejected. Labels come from rules, which also
decide the rows that they fit.

Defined cases: a null url, or one without ``://``, has an empty host and path and stands under the template of the empty
host; where no row is labelled the purity is one half and nothing is rejected; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Weight of the parent's rate, deviations that tell a branch from its parent, and the purity that rejects.
SMOOTHING, DEVIATIONS, REJECT_AT = 4.0, 2.0, 0.5

#: What varies in a segment, and what a segment is once nothing else is left (an extension may stay).
VARIABLE, WILD = r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{8,}|[0-9]+", r"^\**(\.\w{1,5})?$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (written host/path) that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def general(segment: Column) -> Column:
    """A segment with its variable parts as wildcards: numbers and hexadecimal identifiers."""
    plain = F.regexp_replace(segment, VARIABLE, "*")
    return F.when(plain.rlike(WILD), F.lit("*")).otherwise(plain)


def _level(nodes: DataFrame, k: int) -> DataFrame:
    """One level down: ``nodes`` (key, parent purity, leaf columns), all with a segment ``k``, get its branch and its purity."""
    nodes, sums = nodes.withColumn("seg", F.get("parts", F.lit(k))), [F.sum(c).alias(c) for c in ("n", "allowed", "blocked")]
    children = written(nodes.groupBy("key", "seg").agg(*sums, F.first("purity").alias("above")), "url-children")
    labelled = F.col("allowed") + F.col("blocked")
    own = (F.col("blocked") + SMOOTHING * F.col("above")) / (labelled + SMOOTHING)
    noise = F.sqrt(F.col("above") * (1 - F.col("above")) / (labelled + SMOOTHING))
    alike = F.abs(own - F.col("above")) <= DEVIATIONS * noise
    children = children.withColumn("branch", F.when(alike, F.lit("*")).otherwise(F.col("seg")))
    branches = children.groupBy("key", "branch").agg(*sums, F.first("above").alias("above"))
    branches = branches.select("key", "branch", own.alias("next"))
    found = children.select("key", "seg", "branch").join(branches, ["key", "branch"])
    keep = [c for c in nodes.columns if c not in ("key", "purity", "seg")]
    return nodes.join(found, ["key", "seg"]).select(*keep, F.concat_ws("/", "key", "branch").alias("key"), F.col("next").alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, template, purity`` for every row."""
    url = F.col(url_col)
    rows = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), parts.alias("parts"))
    rows = rows.withColumn("parts", F.transform("parts", general))
    keys = ["host", "parts"]
    counts = [F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")]
    leaves = written(rows.groupBy(*keys).agg(*counts), "url-leaves")
    total = leaves.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).select(F.coalesce((F.col("b") + 1) / (F.col("a") + F.col("b") + 2), F.lit(0.5)).alias("overall"))
    hosts = leaves.groupBy("host").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    hosts = hosts.join(F.broadcast(total)).select("host", ((F.col("b") + SMOOTHING * F.col("overall")) / (F.col("a") + F.col("b") + SMOOTHING)).alias("purity"))  # one row is broadcast
    nodes = leaves.join(hosts, "host").withColumn("key", F.col("host"))
    ended = []
    for k in range(leaves.agg(F.max(F.size("parts"))).first()[0] or 0):  # each level is read several times by the next, so it is written
        nodes = written(nodes, "url-nodes")
        ended.append(nodes.where(F.size("parts") <= k))
        nodes = _level(nodes.where(F.size("parts") > k), k)
    for more in ended:
        nodes = nodes.unionByName(more)
    found = written(nodes.select("host", "parts", F.col("key").alias("template"), "purity"), "url-templates")
    by_method = F.when(F.col("purity") > REJECT_AT, "block").otherwise("allow")
    return rows.join(found, keys, "left").select(id_col, "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "purity")
