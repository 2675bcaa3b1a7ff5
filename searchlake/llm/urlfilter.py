"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule is a host and a path prefix; it fits the host, all subdomains and every path that
starts with its own. Canonical keys are bytes: the host's labels in reverse order, each with a
full stop behind it, so a rule's host is the interval of keys that start with its own; and,
under a rule's host, that key, a byte no text holds, and the path. Intervals of prefixes nest or
are disjoint, so a sweep over sorted keys needs a stack of the rules that are open: a running
sum of opening and closing rules is the stack's height, and the rule at a level of the stack is
the last one that opened at this level. One sweep over hosts gives every host the rule hosts
that are open at it (each level of its stack); a second one, over the paths below these, gives
the innermost open rule of each. Of these the longest (host plus path) wins, then the longer
host.

Distribution. Distinct URLs are judged once, distinct hosts swept once. A sweep sorts rules and
points into ranges of even size, so neither a hot host nor a long rule table makes a hot task,
and every rule is there once. Each range is swept by itself, and a table of what is open where a
range begins (one row per range and level) is joined to it.

Cases: a null URL, or one without "://", has an empty host and path, and no rule fits it;
hosts keep ports and empty labels as they are; repeated rows are judged alike; an empty
rule table leaves the default verdict; rules that repeat a host and path count once (the
smallest action, so allow), those with a null host or path never fit; very long URLs are keys
like others; extra columns stay, and the names of the new ones may not be
among them (an error says so; the prefix can be chosen); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A few rules as a table made in the JVM; large ones are read from storage."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "action"), strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def _after_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))


def split_url(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path."""
    rest = F.coalesce(_after_scheme(f"`{url_col}`"), F.lit(""))
    df = df.withColumn("__rest", rest).withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0)
    return df.withColumn("path", path).withColumn("host", F.translate("__host", UPPER, LOWER)).drop("__rest", "__host")


def _host_key(host: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary")


def _sweep(rules: DataFrame, points: DataFrame, payload: list[str], scratch: Scratch, name: str, *, every: bool) -> DataFrame:
    """rules: key and payload; points: key and other columns. The points with the payload of the
    rules that are open at them: of every level of the stack, or of its top only."""
    none = [F.lit(None).cast(dict(rules.dtypes)[c]).alias(c) for c in payload]
    others = [c for c in points.columns if c != "key"]
    blank = [F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in others]
    # a rule closes behind all keys that start with its own: no text holds the byte 255
    opens = rules.select("key", F.lit(1).alias("step"), *payload, *blank)
    closes = rules.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), *none, *blank)
    asked = points.select("key", F.lit(0).alias("step"), *none, *others)
    events = opens.unionByName(closes).unionByName(asked).withColumn("order", F.when(F.col("step") == 0, 1).otherwise(0))
    ranged = events.repartitionByRange("key", "order").withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, f"{name}-ranged")
    # the stack's height: within the range, and where the range begins
    here = Window.partitionBy("part").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = ranged.groupBy("part").agg(F.sum("step").alias("step"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = steps.select("part", F.coalesce(F.sum("step").over(so_far), F.lit(0)).alias("base"))
    high = ranged.withColumn("height", F.sum("step").over(here)).join(F.broadcast(base), "part").withColumn("level", F.col("height") + F.col("base")).drop("height", "base")
    high = scratch.write(high.where("step >= 0 and (step = 1 or level > 0)"), f"{name}-levels")
    # the last rule opened at each level before a range begins
    rule = F.struct("key", *payload)
    last = high.where("step = 1").groupBy("part", "level").agg(F.max(rule).alias("rule"))
    wanted = high.where("step = 0").select("part", (F.explode(F.sequence(F.lit(1), F.col("level"))) if every else F.col("level")).alias("level")).distinct()
    marks = last.unionByName(wanted.withColumn("rule", F.lit(None).cast(last.schema["rule"].dataType)))
    marks = marks.groupBy("part", "level").agg(F.max("rule").alias("rule"))
    earlier = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("part", "level", F.last("rule", ignorenulls=True).over(earlier).alias("carried"))
    spread = high.where("step = 1").select("part", "level", "key", "order", rule.alias("rule"), *blank)
    level = F.explode(F.sequence(F.lit(1).cast("long"), F.col("level"))) if every else F.col("level")
    spread = spread.unionByName(high.where("step = 0").select("part", level.alias("level"), "key", "order", F.lit(None).cast(spread.schema["rule"].dataType).alias("rule"), *others))
    top = Window.partitionBy("part", "level").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = spread.withColumn("open", F.last("rule", ignorenulls=True).over(top)).where("order = 1").join(carried, ["part", "level"], "left")
    return swept.withColumn("open", F.coalesce("open", "carried")).select("key", *others, *[F.col("open")[c].alias(c) for c in payload])


def judge(df: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per distinct URL (null too): url, host, path, rule (null if none fits), verdict."""
    scratch = Scratch(df.sparkSession, "urlfilter")
    urls = split_url(df.select(F.col(f"`{url_col}`").alias("url")).distinct(), "url")
    own = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("action").alias("action"))
    hosts = own.select(F.col("host").alias("rule_host")).distinct().withColumn("key", _host_key("rule_host"))
    judged = urls.where("instr(url, '://') > 0")
    points = judged.select("host").distinct().withColumn("key", _host_key("host"))
    below = _sweep(hosts, points, ["rule_host"], scratch, "hosts", every=True).select("host", "rule_host")
    below = scratch.write(below, "below")
    separator = F.unhex(F.lit("FE"))
    pathed = own.select(F.concat(_host_key("host"), separator, F.col("path").cast("binary")).alias("key"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    asked = judged.join(below, "host").select(F.concat(_host_key("rule_host"), separator, F.col("path").cast("binary")).alias("key"), "url")
    active = _sweep(pathed, asked, ["rule_host", "rule_path", "action"], scratch, "paths", every=False)
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    best = active.groupBy("url").agg(F.max(rank).alias("best"))
    return urls.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def filter_urls(df: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = DEFAULT, prefix: str = "url_") -> DataFrame:
    """Adds host, path, rule and verdict, their names prefixed, to every row of df."""
    names = [f"{prefix}{n}" for n in ("host", "path", "rule", "verdict")]
    if set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(set(names) & set(df.columns))} exist: choose another prefix")
    judged = judge(df, rules, url_col=url_col, default=default).select(F.col("url").alias("__url"), *[F.col(c).alias(n) for c, n in zip(("host", "path", "rule", "verdict"), names, strict=True)])
    joined = df.join(judged, F.col(f"`{url_col}`").eqNullSafe(F.col("__url")), "left").drop("__url")
    return joined


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut
), urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM parts
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
       coalesce((SELECT action FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM urls
"""
