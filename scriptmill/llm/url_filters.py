"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptmill.llm.common import ascii_lower, bounded, stage, table

#: verdict, host, path; the rules of the registered query
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: hex digits of the digest that the join compares first
PREFIX = 8
#: rule tables of at most so many rows are broadcast, larger ones joined by a shuffle
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table of literals."""
    names = ["verdict", "host", "path"]
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(n) for n in names])
    values = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, rule, strict=True)))
                       for rule in rules))
    return spark.range(1).select(F.inline(values))


def url_parts(url):
    """(host, path) of a url; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    return (F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), F.lit("")))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of `pages`: key, host, path, rule, verdict.

    A rule fits its host and all hosts below it where the path starts with the rule's path. The longest
    rule (host and path together, then host) wins; of equal rules `block` does. `default` is the verdict
    where none fits. Each distinct (host, path) is expanded into the suffixes of its host, and these, joined with
    the rules' shapes (number of labels, length of path), into one expression per shape; expressions meet rules
    by equal digest prefixes, full digests decide. What fits is staged: where a count proves that it is small it is
    broadcast, otherwise AQE can split an address that most rows share. Rows without a host meet nothing.

    Rules need a host and a verdict, others are skipped; a null path is an empty one. Null, empty and
    malformed urls have host and path '' and get the default. Null keys and repeated rows stay as they are.
    Only `key` and `url` are read, so other columns may have any name. No pages: no rows; no rules: defaults.
    """
    rules = rules.select("verdict", ascii_lower(F.col("host")).alias("host"),
                         F.coalesce("path", F.lit("")).alias("path")).where(
        "verdict is not null and host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        "verdict", F.concat("host", "path").alias("rule"),
        F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("reach"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h")).alias("weight"))
    host, path = url_parts(F.col("_url"))
    parts = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select(
        "_key", host.alias("host"), path.alias("path"))
    # A host has a suffix for each of its labels; shapes say how much of the path goes with it.
    names = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.struct(
        k.alias("labels"), F.array_join(F.slice(names, -k, k), ".").alias("suffix")))
    shapes = bounded(stage(rules.select("labels", "reach").distinct(), "rule-shapes"))
    probes = parts.where("host <> ''").select("host", "path").distinct().select(
        "host", "path", F.inline(suffixes)).join(shapes, "labels").where("length(path) >= reach").select(
        "host", "path", F.sha2(F.concat("suffix", F.expr("substring(path, 1, reach)")), 256).alias("digest"))
    index = rules.select("rule", "verdict", "weight", F.sha2("rule", 256).alias("full")).withColumn(
        "short", F.substring("full", 1, PREFIX))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    best = stage(probes.join(index, F.substring("digest", 1, PREFIX) == F.col("short")).where("digest = full").groupBy(
        "host", "path").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best")), "url-verdicts")
    weight = 1 + (F.length("host") + F.length("path")) / 40
    return parts.join(bounded(best, weight), ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = """
with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from p),
r(verdict, h, p) as (values """ + ", ".join(str(r) for r in RULES) + """),
m as (select q.*, r.verdict, h || p as rule, row_number() over (partition by page_id
    order by length(h || p) desc nulls last) as k
  from q left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""
