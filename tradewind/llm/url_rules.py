"""URL rules by a sort-merge range join.

A url's key is its host with the labels reversed, a mark, and its path, so that all keys a rule fits form one
interval: those that start with the rule's own key. Intervals of rules nest or are apart. Urls and the two ends
of each rule are sorted together; a sweep along that order keeps the stack of rules that are open, and the top of
the stack at a url is the longest rule that fits. The order is cut into ranges that tasks sweep on their own:
a rule goes to each range its interval touches, and urls of one very frequent key are spread over all ranges
that begin with that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys drawn for each range, to find where ranges begin.
DRAWN = 32


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """labels: reversed. The mark # can be in no host, and no key holds the byte FF that ends an interval."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("#"), path), "utf-8")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _below(bounds: list[bytes], key: Column, equal: bool = False) -> Column:
    """How many bounds lie below key, or at it."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= key if equal else b < key))


def _sweep() -> WindowSpec:
    return Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)


def _depth(events: DataFrame) -> DataFrame:
    return events.withColumn("depth", F.sum("step").over(_sweep()))



def match_url_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row of pages.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's;
    of those that fit, the one whose host and path together are longest decides, of equally long ones the last in
    the alphabet. Two rules of one host and path: block goes before allow. No rule: rule is null and the verdict is
    the default. A null url, or one without ://, has an empty host and path. Null hosts or paths of rules count as
    empty. Repeated rows and null ids stay; an empty table gives an empty result; without rules all rows get the
    default. Further columns are not read.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    named = rules.select("verdict", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))
    # block is after allow in the alphabet
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = named.agg(F.max(F.size(_labels(F.col("host"))))).first()[0] or 1

    # A url is looked up once under each of its parent domains that a rule could name.
    level = F.explode(F.sequence(F.lit(1), F.least(F.size(_labels(F.col("host"))), F.lit(labels))))
    probes = urls.withColumn("level", level)
    probes = probes.withColumn("at", _key(F.slice(_labels(F.col("host")), 1, F.col("level")), F.col("path")))

    ranges = partitions(spark)
    drawn = sorted(bytes(r.at) for r in probes.select("at").orderBy(F.xxhash64("id", "host", "path", "level"), "at").limit(ranges * DRAWN).collect())
    bounds = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if drawn else []

    first, last = _below(bounds, F.col("at")), _below(bounds, F.col("at"), equal=True)
    spread = F.pmod(F.xxhash64("id", "host", "path"), last - first + 1).cast("int")
    keyed = named.select(
        _key(_labels(F.col("host")), F.col("path")).alias("at"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), "verdict").alias("open")
    ).withColumn("end", F.concat("at", F.lit(b"\xff")))
    keyed = keyed.withColumn("part", F.explode(F.sequence(_below(bounds, F.col("at")), _below(bounds, F.col("end")))))
    begins = keyed.select("part", "at", F.lit(0).alias("kind"), F.lit(1).alias("step"), "open")
    ends = keyed.select("part", F.col("end").alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(keyed.schema["open"].dataType).alias("open"))
    deepest = _depth(begins.union(ends)).agg(F.max("depth")).first()[0] or 0

    events = begins.union(ends).unionByName(
        probes.select((first + spread).alias("part"), "at", F.lit(1).alias("kind"), F.lit(0).alias("step"), "id", "host", "path", "level"), allowMissingColumns=True
    )
    stack = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("open")), ignorenulls=True).over(_sweep()) for d in range(1, deepest + 1)]
    top = F.when(F.col("depth") > 0, F.element_at(F.array(*stack), F.col("depth").cast("int"))) if stack else F.lit(None).cast(keyed.schema["open"].dataType)
    swept = _depth(events).withColumn("top", top).where("kind = 1")
    found = swept.groupBy("id", "host", "path").agg(F.max("top").alias("top"), F.count_if(F.col("level") == 1).alias("n"))
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return copies.select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
