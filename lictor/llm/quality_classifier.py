"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

1. Word vectors. Every token falls into one of `WORDS` hash rows and has a sparse ternary index vector of `SIZE` places.
   A row's vector is the sum of the index vectors of its neighbours within `REACH` tokens, over all documents. Each task
   counts neighbours and multiplies once; whole-number sums make the result independent of order. The table has
   WORDS x SIZE numbers at any input size, so it is collected, centred, scaled and broadcast (`WORDS * SIZE * 4` bytes).
2. Document vectors: mean word vector, mean product of the vectors of neighbouring tokens, share of tokens that repeat
   the one before, logarithm of the number of tokens. Whole texts, stored once.
3. Network: two layers in numpy, fitted on the driver on at most about `SAMPLE` labelled rows, chosen by hash. One in
   five of them is set aside to fit the temperature that divides the logits.
4. Scores are computed on the executors from the stored vectors.

Labels come only from rows whose crc32 of doc_id is not in the held-out class; labels, lang, source and doc_id are no
input of a score. Nulls and odd rows: a null or empty text has the zero vector and still gets a score; null doc_ids are
scored and never labelled; a doc_id with several labels gives several training rows; repeated documents are scored each.
Without labels every score is 0.5. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lictor.llm import hashing as H
from lictor.llm.tables import map_arrow, stored

WORDS, SIZE, REACH, NONZERO = 4096, 64, 2, 6
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 30, 3
FOLDS, HELD_OUT = 3, 1
INPUTS = 2 * SIZE + 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def index_vectors() -> np.ndarray:
    """The ternary index vector of every row, from a fixed rule."""
    out = np.zeros((WORDS, SIZE), np.int64)
    draws = H.multipliers(WORDS * NONZERO, 31).reshape(WORDS, NONZERO)
    for k in range(NONZERO):
        place = ((draws[:, k] >> H.U(8)) % H.U(SIZE)).astype(np.int64)
        out[np.arange(WORDS), place] += np.where((draws[:, k] >> H.U(40)) & H.U(1), 1, -1)
    return out


def _rows(found: H.Words) -> np.ndarray:
    return (found.hashes % H.U(WORDS)).astype(np.int64)


def _text_of(found: H.Words) -> np.ndarray:
    return np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The centred and scaled word vectors of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(WORDS * WORDS, np.int32)
        for batch in H.small(batches, "text", 1 << 18):
            found = H.words(batch.column("text"), H.TOKENS, lower=False)
            row, text = _rows(found), _text_of(found)
            for gap in range(1, REACH + 1):
                same = text[gap:] == text[:-gap]
                pair = row[:-gap][same] * WORDS + row[gap:][same]
                found_pairs, times = np.unique(pair, return_counts=True)
                near[found_pairs] += times.astype(np.int32)
        near = near.reshape(WORDS, WORDS)
        used = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
        if len(used):
            index = index_vectors().astype(np.float64)
            for begin in range(0, len(used), 256):  # in parts, as the counts alone take WORDS * WORDS * 4 bytes
                rows = used[begin:begin + 256]
                sums = np.rint(near[rows].astype(np.float64) @ index + near[:, rows].T.astype(np.float64) @ index).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows, pa.int32()), H.lists(sums.reshape(-1), [SIZE] * len(rows), pa.int64())], names=["row", "vector"])

    parts = map_arrow(docs.select("text"), work, "row int, vector array<long>")
    summed = parts.groupBy("row").agg(*[F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(SIZE)])
    table = np.zeros((WORDS, SIZE))
    for r in summed.collect():  # at most WORDS rows
        table[r[0]] = r[1:]
    seen = np.abs(table).sum(axis=1) > 0
    if seen.any():
        total = table.sum(axis=0) / max(1e-9, np.linalg.norm(table.sum(axis=0)))
        table[seen] /= np.linalg.norm(table[seen], axis=1, keepdims=True)
        table[seen] -= np.outer(table[seen] @ total, total)  # what all words share
        table[seen] /= np.maximum(1e-9, np.linalg.norm(table[seen], axis=1, keepdims=True))
    return table.astype(np.float32)


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, values.shape[1]), np.float32)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0) / np.diff(bounds)[full, None]
    return out


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The document vectors of a batch of texts, one row of INPUTS numbers each."""
    found = H.words(texts, H.TOKENS, lower=False)
    row, text = _rows(found), _text_of(found)
    vector = np.zeros((len(texts), INPUTS), np.float32)
    if len(row):
        of = table[row]
        vector[:, :SIZE] = _means(of, found.bounds)
        inside = text[1:] == text[:-1]
        product = np.concatenate([of[1:] * of[:-1] * inside[:, None], np.zeros((1, SIZE), np.float32)])
        vector[:, SIZE:2 * SIZE] = _means(product, found.bounds)
        again = np.concatenate([(found.hashes[1:] == found.hashes[:-1]) & inside, [False]])
        vector[:, -2] = _means(again[:, None].astype(np.float32), found.bounds)[:, 0]
        vector[:, -1] = np.log1p(np.diff(found.bounds))
    return vector


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and vector (INPUTS floats) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "text", 1 << 18):
            vector = pooled(batch.column("text"), table.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), H.lists(vector.reshape(-1), [INPUTS] * batch.num_rows, pa.float32())], names=["doc_id", "vector"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, vector array<float>")


class Network:
    """Standardised inputs, a tanh layer, one logit, a temperature. Fitted by Adam with a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        aside = draw.random(len(x)) < 0.2
        fit = ~aside if (~aside).any() else np.ones(len(x), bool)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        self.weights = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature = 1.0
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        rows, step = np.flatnonzero(fit), 0
        for _ in range(epochs):
            draw.shuffle(rows)
            for begin in range(0, len(rows), 128):
                part, step = rows[begin:begin + 128], step + 1
                for w, m, g in zip(self.weights, moments, self._slopes(z[part], y[part]), strict=True):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    w -= 3e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            logits, target = self.logits(x[aside]), y[aside]
            self.temperature = min(np.exp(np.linspace(-2, 3, 101)), key=lambda t: np.logaddexp(0, np.where(target > 0, -logits, logits) / t).mean())

    def _slopes(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(z @ a + b)
        e = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y) / len(y)
        back = np.outer(e, c) * (1 - h * h)
        return [z.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * c, np.array([e.sum()])]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fitted(vectors: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network, from a bounded sample of the labelled rows outside the held-out class."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    rows = vectors.select("doc_id", "vector").join(known, "doc_id")
    count = known.count()
    share = min(1.0, sample / max(1, count))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)).orderBy("doc_id", "quality").collect()
    if not chosen:
        return None
    return Network(np.array([r.vector for r in chosen], np.float64), np.array([float(r.quality) for r in chosen]))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of quality 1), predicted; one row per row of `docs`."""
    vectors = stored(document_vectors(docs, word_vectors(docs)))
    network = fitted(vectors, labels, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            scores = np.full(batch.num_rows, 0.5) if network is None else network(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    out = map_arrow(vectors, work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows that score below `least`. Rows are scored where they are read, nothing is joined."""
    vectors = word_vectors(docs)
    network = fitted(stored(document_vectors(docs, vectors)), labels, sample)
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), 0.5)
        begin = 0
        for batch in H.small(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 1 << 18):
            if network is not None:
                out[begin:begin + batch.num_rows] = network(pooled(batch.column("text"), table.value).astype(np.float64))
            begin += batch.num_rows
        pa.default_memory_pool().release_unused()
        return pa.array(out)

    return docs.withColumn("_score", score("text")).where(F.col("_score") >= least).drop("_score")
