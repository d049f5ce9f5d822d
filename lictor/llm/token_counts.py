"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are never recounted. A batch holds changes of
single documents: an image before, an image after, or both (insert, delete, revised count). Each change becomes signed
rows, -1 x the old image under its key and +1 x the new one, and a batch is committed as one signed rollup.

A commit writes the partition `batch=<name>` of the store with dynamic partition overwrite. Committing a batch again,
after a lost driver or by mistake, writes the same partition again, so totals never count it twice; a task that is run
again is settled by Spark's commit protocol. Totals are sums over all committed partitions: batches x keys rows.

Nulls and odd rows: null sources and languages are keys of their own; a null or empty text has 0 tokens and is one
document. Null doc_ids are counted by `inserts`, and can only be taken back by `deletes` of the same image. Repeated
rows are counted as often as they occur. An empty batch commits nothing; an empty store has no totals. Further columns
of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lictor.llm import hashing as H
from lictor.llm.tables import map_arrow

KEYS = ("source", "lang", "version")
#: Fixed value: the pre-tokenizing pattern that belongs to the byte-pair vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokenizer versions: name -> vocabulary file, or None for runs without white space.
VERSIONS = {"words-1": None, "byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken"}


@lru_cache(maxsize=8)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counts(texts: pa.Array, path: str | None) -> np.ndarray:
    if path is None:
        return np.diff(H.words(texts, lower=False).bounds)
    encode = _encoding(path).encode_ordinary
    return np.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], np.int64)


def counted(docs: DataFrame, versions: dict[str, str | None] | None = None) -> DataFrame:
    """One image per document and version: doc_id, source, lang, version, n_tokens. Whole texts, read once."""
    versions = dict(VERSIONS if versions is None else versions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text"):
            for version, path in versions.items():
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in ("doc_id", "source", "lang")),
                    pa.array([version] * batch.num_rows, pa.string()), pa.array(_counts(batch.column("text"), path), pa.int64()),
                ], names=["doc_id", "source", "lang", "version", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return map_arrow(rows, work, "doc_id long, source string, lang string, version string, n_tokens long")


def inserts(images: DataFrame) -> DataFrame:
    return images.select(*KEYS, F.lit(1).alias("sign"), "n_tokens")


def deletes(images: DataFrame) -> DataFrame:
    return images.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both images of revised documents. A revision may also move a document to another source or language."""
    return deletes(before).unionByName(inserts(after))


class TokenTotals:
    """Signed rollups of committed batches in one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Write the batch's signed rollup; the same batch again replaces itself."""
        sign = F.col("sign")
        rollup = changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(sign * F.col("n_tokens")).cast("long").alias("n_tokens"))
        rollup = rollup.withColumn("batch", F.lit(batch))
        rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def deltas(self) -> DataFrame:
        schema = "source string, lang string, version string, n_docs long, n_tokens long, batch string"
        return self.spark.read.schema(schema).parquet(self.folder)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all committed batches; keys without documents left are dropped."""
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
