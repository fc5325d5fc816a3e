"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the wanted size by its weight, but no more than ``max_epochs`` times its own size.
Sources above that are clamped there and what they cannot give goes to the others by weight, again and again,
until no source is above.  A source's target over its size gives its repetitions: the whole part repeats every
document, and the fractional part is a seeded sample without replacement.

The sample is a prefix in the order of a seeded 63-bit hash.  Where the prefix ends is found by radix descent:
sizes are summed by source and leading digit, the digit where the source's budget runs out is kept, and its rows
alone are summed by the next digit.  So no source, however large, is ever sorted or gathered; the driver sees
only how many rows are left.  In the last group, which is bounded, documents are taken in order while they fit,
and one more if that comes nearer to the target.

Defined results: null text has size 0, and a text of size 0 is never taken, as it adds nothing; a null source is a
source of its own, ordered last; a source of size 0 has target 0; rows that are equal in id and text are taken
together; an empty table gives an empty one; texts of any length count whole; columns of the table may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.spark_utils import HOT_SALTS, cut, is_small, whole_row

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 6
HASH_BITS = 60
#: Rows of one source that are ordered in one task at the end of the descent.
EXACT_ROWS = 2000
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``weight`` by the rank of ``source`` in code point order, null last, repeating the weights given."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``source, source_size, weight``; the targets share ``share`` times all sizes."""
    held = cut(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("clamped", F.col("source_size") <= 0))
    total = (held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level = 0.0
    while True:
        clamped = F.col("clamped")
        full, weight = held.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0))
        ).first()
        if weight <= 0:
            break
        level = max(0.0, total - full) / weight
        above = F.col("weight") * F.lit(level) > F.col("cap")
        if not held.filter(~clamped & above).limit(1).count():
            break
        held = cut(held.withColumn("clamped", clamped | above))
    return held.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.lit(level))).drop("cap", "clamped")


def _key(source: Column) -> Column:
    """A key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _order(seed: int, key: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 64 - HASH_BITS)


def with_source_rows(left: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Joins rows to their source's row by ``__k``: broadcast if the sources are few and short, else dealt over salts."""
    if small:
        return left.join(F.broadcast(sources), "__k")
    salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64("__u"), F.lit(HOT_SALTS)).cast("int")).join(salted, ["__k", "__salt"]).drop("__salt")


def _fit(rows: Column, budget: Column) -> Column:
    """Takes rows in order while they fit: what is left, the first hash that did not fit, and fitting ones after it."""
    start = F.struct(budget.cast("double").alias("left"), F.lit(None).cast("long").alias("cut"), F.array().cast("array<bigint>").alias("extra"))

    def step(state: Column, row: Column) -> Column:
        fits = row["s"] <= state["left"]
        return F.struct(
            (state["left"] - F.when(fits, row["s"]).otherwise(0)).cast("double").alias("left"),
            F.coalesce(state["cut"], F.when(~fits, row["u"])).alias("cut"),
            F.when(fits & state["cut"].isNotNull(), F.concat(state["extra"], F.array(row["u"]))).otherwise(state["extra"]).alias("extra"),
        )

    return F.aggregate(rows, start, step)


def plan(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """For each source: whole repetitions, the hash below which a document gets one more, and further hashes that do.

    ``rows`` has ``__k, __u, size``; ``sources`` has ``__k, source_size, target, n``, with ``n`` its rows.
    """
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sources.withColumn("whole", F.floor(epochs + 1e-12)).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    state = cut(state.withColumn("prefix", F.lit(0).cast("long")))
    bits, left = 0, sources.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while left > EXACT_ROWS and bits + DIGITS <= HASH_BITS:
        inside = with_source_rows(rows, state.select("__k", "prefix"), small).filter(F.shiftright("__u", HASH_BITS - bits) == F.col("prefix")) if bits else rows
        bits += DIGITS
        digit = F.shiftright("__u", HASH_BITS - bits)
        sums = inside.groupBy("__k", digit.alias("d")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        upto = F.sum("s").over(Window.partitionBy("__k").orderBy("d"))  # at most 2 ** DIGITS rows for each source
        sums = sums.withColumn("before", upto - F.col("s")).withColumn("upto", upto).join(F.broadcast(state.select("__k", "budget")) if small else state.select("__k", "budget"), "__k")
        ends = sums.filter((F.col("upto") > F.col("budget")) & (F.col("before") <= F.col("budget")))
        ends = ends.groupBy("__k").agg(F.min(F.struct("d", "before", "n")).alias("e"))
        past = F.lit(1 << bits).cast("long")  # the budget takes all rows: a prefix that no hash has
        state = cut(
            state.join(ends, "__k", "left").select(
                "__k", "source_size", "target", "whole", (F.col("budget") - F.coalesce("e.before", F.lit(0))).alias("budget"),
                F.coalesce("e.d", past).alias("prefix"), F.coalesce("e.n", F.lit(0)).alias("n"),
            )
        )
        left = state.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    last = with_source_rows(rows, state.select("__k", "prefix", "budget"), small).filter(F.shiftright("__u", HASH_BITS - bits) == F.col("prefix"))
    each = last.groupBy("__k", "__u").agg(F.sum("size").alias("s"), F.first("budget").alias("budget"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("__u").alias("u"), "s")))  # at most EXACT_ROWS
    groups = each.groupBy("__k").agg(ordered.alias("rows"), F.first("budget").alias("budget"))
    cuts = groups.withColumn("f", _fit(F.col("rows"), F.col("budget")))
    left_over, apart = F.col("f.left"), lambda x: F.abs(F.col("f.left") - x["s"])
    rest = F.filter("rows", lambda x: (x["u"] >= F.col("f.cut")) & ~F.array_contains("f.extra", x["u"]) & (apart(x) < left_over))
    nearest = F.array_min(F.transform(rest, lambda x: F.struct(apart(x).alias("miss"), x["u"].alias("u"))))
    more = F.when(nearest.isNotNull(), F.array(nearest["u"])).otherwise(F.array().cast("array<bigint>"))
    cuts = cuts.select("__k", F.col("f.cut").alias("cut"), F.concat("f.extra", more).alias("extra"))
    whole_prefix = F.when(F.col("prefix") >= F.lit(1 << bits), F.lit(1 << HASH_BITS)).otherwise(F.shiftleft("prefix", HASH_BITS - bits)).cast("long")
    joined = state.join(cuts, "__k", "left")
    return cut(joined.select("__k", "source_size", "target", "whole", F.coalesce("cut", whole_prefix).alias("cut"), F.coalesce("extra", F.array().cast("array<bigint>")).alias("extra")))


def copies() -> Column:
    """Repetitions of a row with ``__u``, ``size`` and its source's plan."""
    more = (F.col("__u") < F.col("cut")) | F.array_contains("extra", F.col("__u"))
    return F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(key).alias("doc_id"), _key(F.col(source)).alias("__k"), F.col(source).cast("string").alias("source"), word_count(t).alias("size"), _order(seed, F.col(key), t).alias("__u"))


def _plan(rows: DataFrame, weights, share: float, max_epochs: float) -> tuple[DataFrame, bool]:
    sources = cut(cycled_weights(rows.groupBy("__k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")), weights))
    small = is_small(sources)
    return plan(rows, water_fill(sources, share, max_epochs).select("__k", "source_size", "target", "n"), small), small


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (and ``copies``) for each row."""
    rows = cut(_sized(docs, key, text, source, seed))
    decided, small = _plan(rows, weights, share, max_epochs)
    out = with_source_rows(rows, decided, small).withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed rows themselves, each as often as it is taken, with the columns they came with."""
    rows = cut(_sized(docs, key, text, source, seed))
    decided, small = _plan(rows, weights, share, max_epochs)
    t = F.col(text).cast("string")
    marked = docs.select(whole_row(docs), _key(F.col(source)).alias("__k"), _order(seed, F.col(key), t).alias("__u"), word_count(t).alias("size"))
    taken = with_source_rows(marked, decided.drop("source_size", "target"), small).withColumn("__c", copies().cast("int")).filter("__c > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("__c"))).alias("__r")).select("row.*")
