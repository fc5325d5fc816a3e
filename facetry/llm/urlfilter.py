"""URL filter rules by a sort-merge range join, in DataFrame operations only.

A host in reversed label order, each label closed by a dot (``com.example.www.``), is its canonical key: a rule
for a host and its subdomains is then the interval of all keys that begin with the rule's key.  A rule's path is an
interval in the same way, of keys of host and path.  Any two such intervals are nested or apart.

``sweep`` sorts the intervals' beginnings and ends and the points by key together.  Going through that order, a
beginning pushes its interval, an end pops it, and the running sum of both is the height of the stack; the interval on
top of a point is the last one pushed at the point's height.  The order is dealt over range partitions, a key with very
many points over several of them; what a partition finds on the stack when it begins are the last intervals that
earlier partitions pushed at each height.

The first sweep gives each URL the stack of rule hosts around its host; the second one, over keys of such a host and
the URL's path, the longest path rule of each.  So neither a host's rules nor a stack's are ever looked through one by
one.  The longest rule wins.

Defined results: a null URL or one without ``://`` has empty host and path and meets no rule; a URL that no rule fits
gets the default verdict, as all do without rules; of rules with equal host and path the verdict that sorts last
(``block`` before ``allow``) counts, and of fitting rules of equal length the one of the longer host; a rule without a
host fits nothing, and one without a path fits every path; repeated rows get equal results; an empty table gives an
empty one.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.spark_utils import cut

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _beginnings(key: Column) -> Column:
    """All keys whose interval contains the key: itself and each shorter run of its labels."""
    labels = F.slice(F.split(key, r"\."), 1, F.size(F.split(key, r"\.")) - 1)
    runs = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    return F.when((key == "") | (F.size(labels) < 1), F.array().cast("array<string>")).otherwise(runs)


#: Bytes that UTF-8 never has: between a host's key and a path, and after all keys that begin alike.
_BETWEEN, _AFTER = bytearray(b"\xfe"), bytearray(b"\xff")


def sweep(points: DataFrame, intervals: DataFrame, parts: int) -> DataFrame:
    """Adds ``top`` to ``key, row``: the ``frame`` of the innermost interval that holds the key, or null.

    ``intervals`` has ``key, frame``, each key once; it holds the keys that begin with its own.  Keys are binary.
    """
    no_row, no_frame = F.lit(None).cast(points.schema["row"].dataType), F.lit(None).cast(intervals.schema["frame"].dataType)
    no_salt = F.lit(None).cast("long").alias("salt")
    pushes = intervals.select("key", F.lit(1).alias("kind"), no_salt, no_row.alias("row"), "frame")
    pops = intervals.select(F.concat("key", F.lit(_AFTER)).alias("key"), F.lit(0).alias("kind"), no_salt, no_row.alias("row"), no_frame.alias("frame"))
    marks = points.select("key", F.lit(2).alias("kind"), F.xxhash64("row").alias("salt"), "row", no_frame.alias("frame"))
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0).cast("long")
    dealt = marks.unionByName(pushes).unionByName(pops).withColumn("step", step).repartitionByRange(parts, "key", "kind", "salt")
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))  # the parts must not move between the uses
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = cut(dealt.groupBy("part").agg(F.sum("step").alias("s")).select("part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base")))
    height = F.col("base") + F.sum("step").over(so_far)
    pushed = dealt.filter("kind < 2").join(F.broadcast(starts), "part").withColumn("height", height).filter("kind = 1")
    last = pushed.groupBy("part", "height").agg(F.max_by("frame", "key").alias("frame")).withColumn("own", F.lit(1))
    held = starts.filter("base > 0").select("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("base"))).alias("height"), no_frame.alias("frame"), F.lit(0).alias("own"))
    upto = Window.partitionBy("height").orderBy("part", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.unionByName(last).withColumn("frame", F.last("frame", ignorenulls=True).over(upto)).filter("own = 0")
    opening = held.select(F.lit(bytearray()).alias("key"), F.lit(-1).alias("kind"), no_salt, no_row.alias("row"), "frame", F.lit(0).cast("long").alias("step"), "part", "height")
    every = dealt.withColumn("height", F.lit(None).cast("long")).unionByName(opening).join(F.broadcast(starts), "part")
    # The window of the height runs over all rows of a partition; an opening row comes first and has its height.
    every = every.repartition("part").withColumn("height", F.coalesce("height", height))
    on_top = Window.partitionBy("part", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("top", F.last("frame", ignorenulls=True).over(on_top)).filter("kind = 2").select("key", "row", "top")


def _host_intervals(rules: DataFrame) -> DataFrame:
    """For each rule host its key and, as frame, the keys of all rule hosts around it and its own."""
    hosts = rules.select("host_key").distinct()
    around = hosts.select("host_key", F.explode(_beginnings(F.col("host_key"))).alias("outer"))
    inside = around.join(hosts.select(F.col("host_key").alias("outer")), "outer")
    stacks = inside.groupBy("host_key").agg(F.collect_set("outer").alias("stack"))  # at most one for each label
    return stacks.select(F.col("host_key").cast("binary").alias("key"), F.struct("stack").alias("frame"))


def _path_key(host_key: Column, path: Column) -> Column:
    return F.concat(host_key.cast("binary"), F.lit(_BETWEEN), path.cast("binary"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``."""
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    address = F.col(url).cast("string")
    urls = pages.select(F.col(key).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    paths = F.coalesce("path", F.lit("")).alias("path")
    known = cut(rules.filter(F.coalesce("host", F.lit("")) != "").select(canonical(F.col("host")).alias("host_key"), "host", paths, "verdict"))
    points = urls.select(canonical(F.col("host")).cast("binary").alias("key"), F.struct("page_id", "host", "path").alias("row"))
    found = sweep(points, _host_intervals(known), parts).select("row.*", F.col("top.stack").alias("stack"))
    found = cut(found.withColumn("nr", F.monotonically_increasing_id()))

    frame = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host_key").alias("k"), F.concat("host", "path").alias("rule"), "verdict")
    intervals = known.select(_path_key(F.col("host_key"), F.col("path")).alias("key"), frame.alias("frame")).groupBy("key").agg(F.max("frame").alias("frame"))
    each = found.filter("stack is not null").withColumn("host_key", F.explode("stack"))
    points = each.select(_path_key(F.col("host_key"), F.col("path")).alias("key"), F.struct("nr", "page_id", "host", "path").alias("row"))
    met = sweep(points, intervals, parts).groupBy(F.col("row.nr").alias("nr")).agg(F.first("row").alias("row"), F.max("top").alias("best"))
    names = ("page_id", "host", "path")
    met = met.select(*[f"row.{c}" for c in names], F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    free = found.filter("stack is null").select(*names, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return met.unionByName(free)
