"""Tables, stored steps and connected groups shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lictor.session import Rounds, cut

#: Words are maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow`; a worker that waits for its next task keeps no memory of the last one's batches."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back."""
    return cut(df)


class Scratch:
    """Steps of one operator that nothing needs once its result is stored."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def stored(self, df: DataFrame) -> DataFrame:
        table = stored(df)
        self.paths += {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        return table

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        self.paths = []


def small_side(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A stored table for the small side of a join: broadcast if it has at most `most` rows, joined like any other beyond.

    Joining a large table with one row per group would otherwise shuffle its rows by a key that may hold a third of them.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bits that `parted` marks per key, and the most bits of its marks (16 MB to every task); more keys let more rows pass.
MARKS, MOST_MARKS = 32, 1 << 27


def parted(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """`df` in two parts: rows whose hash `column` may be in the stored `keys` (all that are, and few others), and the rest.

    A join on the hash then shuffles the few rows of the first part alone, at any number of keys: a bitmap goes to the rows.
    """
    size = min(MOST_MARKS, 1 << max(15, (MARKS * keys.count()).bit_length()))
    place = F.pmod(F.col(column), F.lit(size))
    bucket = F.bitmap_bucket_number(place).alias("_bucket")
    marks = keys.select(bucket, F.bitmap_bit_position(place).alias("place")).repartition("_bucket")
    marks = stored(marks.groupBy("_bucket").agg(F.bitmap_construct_agg("place").alias("_bits")))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.col("_bits").substr(F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))
    marked = df.select("*", bucket).join(F.broadcast(marks), "_bucket", "left").select(*df.columns, held.alias("_held"))
    return marked.where("_held").drop("_held"), marked.where("NOT _held").drop("_held")


def groups(edges: DataFrame) -> DataFrame:
    """Connected groups of an edge table (a, b): columns node, root, where the root is the group's smallest node.

    Alternates the large-star and small-star steps until no edge changes: every node hangs on its group's smallest
    node then. Minima are aggregated before the shuffle and joined back, so that a hub is split like any skewed key.
    Each round is stored; the loop ends on its condition alone.
    """
    rounds = Rounds()
    edges = rounds.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = _summary(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = rounds.cut(small.distinct())
        now = _summary(edges)
        if now == size:
            break
        size = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _summary(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: equal sets have equal counts and equal exclusive ors of two hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
