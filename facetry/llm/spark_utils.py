"""Checkpoints in the shared folder, joins that survive hot keys, and Arrow batches bounded by bytes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to so many rows and bytes of values; beyond that the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20
#: Ids alone, one long in each row, are broadcast up to so many.
BROADCAST_IDS = 4 * BROADCAST_ROWS
#: A key is hot with more than this share of all rows, so there are at most 1 / HOT_SHARE hot keys at any size.
HOT_SHARE = 1 / 1000
HOT_SALTS = 64


#: Bytes of an Arrow batch: Spark bounds batches by 10,000 rows or 64 MB, of which a worker and its executor hold several copies.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this context: the one that the cluster names.  Only a local master gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def small_batches(df: DataFrame) -> DataFrame:
    """The table itself; from now on the session hands Arrow batches of at most ``BATCH_BYTES`` to Python workers."""
    conf = df.sparkSession.conf
    held = re.fullmatch(r"(\d+)b?", conf.get(_BATCH_SETTING))
    if held and not 0 < int(held[1]) <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` has not, whatever its letters' case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that added columns clash with none; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


def cut(df: DataFrame) -> DataFrame:
    """Computes a narrow table once and cuts its lineage: a lost executor costs a read, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table: smaller, and read by column."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The written table and its folder, for ``remove``."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is not needed any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def is_small(df: DataFrame) -> bool:
    """Whether a (computed) table may be broadcast, by its rows and the bytes of its values."""
    fixed = {"bigint": 8, "int": 4, "double": 8, "boolean": 1}
    width = [F.lit(fixed[t]) if t in fixed else F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in df.dtypes]
    rows, size = df.select(sum(width, F.lit(0)).cast("long").alias("w")).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def sized_broadcast(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """For sides of a few numbers in each row, whose rows are counted."""
    return F.broadcast(df) if rows <= (most or BROADCAST_ROWS) else df


def skew_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join to a table with one row for each key, where ``count`` says how many left rows the key has.

    A right side of few rows and bytes (they are counted first) is broadcast.  Otherwise the join shuffles: rows of hot keys are dealt over HOT_SALTS salts.  The hot keys are few by definition, so the set of them is
    broadcast; only their rows on the right are repeated.  ``count`` is dropped.
    """
    right = cut(right)
    if is_small(right):
        return left.join(F.broadcast(right.drop(count)), keys, "left")
    least = max(64, int(total * HOT_SHARE))
    hot = right.filter(F.col(count) >= least).select(*keys, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    seed = F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]), F.lit(HOT_SALTS)).cast("int")
    marked = marked.withColumn("__salt", F.when(F.col("__hot"), seed).otherwise(F.lit(0))).drop("__hot")
    salts = F.when(F.col(count) >= least, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = right.withColumn("__salt", F.explode(salts)).drop(count)
    return marked.join(dealt, [*keys, "__salt"], "left").drop("__salt")
