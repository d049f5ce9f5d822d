"""Cross-tokenizer alignment by whitespace-token anchors.

A text, with a space in front, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). Both give byte
strings per token, so each token has a byte range.

1. Both tokenisations are made in full. Neither has a token across a space behind a character that is no white space, so
   a text is encoded by its stretches between such places, and short ones are remembered as windows. (Vocabularies that have such
   tokens or other rules encode whole texts.) They count only if the joined bytes of each equal the space and the text.
2. Anchors: token ends that A and B share and after which both go on with a token that begins with a space. They cut the
   document into windows of token ids, mostly words.
3. A window's alignment depends on its ids alone: the groups between shared ends and the links, which are the pairs of an
   A and a B token whose byte ranges overlap. It is worked out once per pair of id tuples and remembered; a text without
   spaces is one window.
4. The corpus-wide count of an id pair is the number of documents that hold it linked. Every document keeps its distinct
   pairs and how often it has them; counts, the best count per A id and the sums are grouped and joined by Spark.

Pairs held by at least one document in `SHARE` are few, at most SHARE times the mean number of distinct pairs of a document,
and are broadcast; the others, none of which is in more than that share of the documents, are joined in a shuffle.

The memory of windows is emptied between batches when it holds more than `MEMORY` links, which costs time only. Tokenizers are read from a folder
that every executor has.

Nulls and odd rows: a null or empty text, and one that a tokenizer does not keep byte by byte, has no tokens: zeros and an
empty digest. A null doc_id stays null. Repeated rows count as documents of their own. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lictor.llm import hashing as H
from lictor.llm.tables import Scratch, map_arrow, stored

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARE, MEMORY = 256, 1 << 21
#: Stretches of up to LONGEST characters are remembered, at most STRETCHES of them.
LONGEST, STRETCHES = 48, 1 << 18
#: New stretches are encoded together up to so many characters.
TOGETHER = 1 << 15
#: Before a space that follows a character which is white space by nobody's rules.
STRETCH = re.compile("(?= )(?<=[^\\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff])")
#: An id pair is one number: A id * WIDE + B id.
WIDE = 1 << 31
#: Between the A and the B ids of a window's key.
MARK = np.int32(-1).tobytes()

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_of_symbol() -> dict[str, int]:
    """The byte behind each symbol of a byte-level vocabulary: printable Latin bytes stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer's vocabulary: bytes of each id, their number, and whether they begin with a space."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.marked = np.array([t[:1] == b" " for t in table], bool)


class Tokenizers:
    """Both tokenizers, loaded once per worker."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(os.path.join(folder, BYTE_LEVEL), encoding="utf-8") as file:
            given = json.load(file)
        symbols = byte_of_symbol()
        entries = {i: bytes(symbols[c] for c in entry) for entry, i in given["model"]["vocab"].items()}
        for added in given["added_tokens"]:
            entries.setdefault(added["id"], added["content"].encode())
        self.a = Side([entries.get(i, b"") for i in range(max(entries) + 1)])
        self.byte_level = Tokenizer.from_file(os.path.join(folder, BYTE_LEVEL))
        self.byte_level.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        piece = lambda i: self.pieces.id_to_piece(i)
        self.b = Side([
            bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode()
            for i in range(self.pieces.get_piece_size())])
        self.parted = self._parts_at_spaces(given)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _parts_at_spaces(self, given: dict) -> bool:
        """Whether both sides encode a text stretch by stretch: words parted by the usual rules, no piece across a space."""
        rules = given.get("pre_tokenizer") or {}
        plain = given["model"]["type"] == "BPE" and not given.get("normalizer") and rules.get("type") == "ByteLevel" and rules.get("use_regex", True)
        entries = [t.decode(errors="ignore") for t in self.b.table] + [added["content"] for added in given["added_tokens"]]
        return plain and not any(STRETCH.search(entry) for entry in entries)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both tokenizers per text; empty where a tokenizer changes the bytes."""
        if not self.parted:
            return self._whole(texts)
        if len(self.known) > STRETCHES:
            self.known = {}
        parts = [STRETCH.split(" " + t) if t else [] for t in texts]
        new = list({p for own in parts for p in own if p not in self.known})
        learnt = self._stretches(new)
        out: list = []
        for text, own in zip(texts, parts, strict=True):
            ids = [learnt[p] if p in learnt else self.known[p] for p in own]
            if None in ids:  # a stretch that does not keep its bytes alone
                out += self._whole([text])
            else:
                out.append(tuple(np.frombuffer(b"".join(i), np.int32) for i in zip(*ids, strict=True)) if ids else self._whole([text])[0])
        self.known |= {p: i for p, i in learnt.items() if len(p) <= LONGEST}
        return out

    def _stretches(self, new: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """The packed ids of stretches; None where one alone does not keep its bytes. Many are encoded as one text and parted again."""
        found: dict[str, tuple[bytes, bytes] | None] = {}
        plain, held, size = [p for p in new if STRETCH.search(p + " ", len(p)) and "▁" not in p], [], 0
        for i, part in enumerate(plain):
            held.append(part)
            size += len(part)
            if size < TOGETHER and i + 1 < len(plain):
                continue
            ((a, b),) = self._whole(["".join(held)[1:]])
            ends, cuts = np.cumsum([len(p.encode()) for p in held]), []
            for ids, side in ((a, self.a), (b, self.b)):
                at = np.cumsum(side.sizes[ids])
                if len(ids) and np.isin(ends, at).all():
                    flat, place = ids.tobytes(), (4 * np.searchsorted(at, ends) + 4).tolist()
                    cuts.append([flat[s:e] for s, e in zip([0, *place], place, strict=False)])
            if len(cuts) == 2:
                found |= dict(zip(held, zip(*cuts, strict=True), strict=True))
            held, size = [], 0
        alone = [p for p in new if p not in found]
        for part, (a, b) in zip(alone, self._whole([p[1:] for p in alone]), strict=True):
            found[part] = (a.tobytes(), b.tobytes()) if len(a) else None
        return found

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        left = self.byte_level.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, a, b in zip(texts, left, self.pieces.encode(texts, num_threads=1), strict=True):
            a, whole = a.ids, (" " + text).encode()
            kept = text and b"".join(map(self.a.table.__getitem__, a)) == whole and b"".join(map(self.b.table.__getitem__, b)) == whole
            out.append((np.array(a if kept else [], np.int32), np.array(b if kept else [], np.int32)))
        return out


_LOADED: dict[str, Tokenizers] = {}


def tokenizers(folder: str) -> Tokenizers:
    if folder not in _LOADED:
        _LOADED[folder] = Tokenizers(folder)
    return _LOADED[folder]


def anchors(a: np.ndarray, b: np.ndarray, a_side: Side, b_side: Side) -> tuple[np.ndarray, np.ndarray]:
    """Window bounds of a document as places in its A and B tokens, the first and the last included."""
    a_ends, b_ends = np.cumsum(a_side.sizes[a]), np.cumsum(b_side.sizes[b])
    # An anchor is the end of a token before a space-marked one; the end of the other side must be the same byte.
    a_at, b_at = np.flatnonzero(a_side.marked[a[1:]]) + 1, np.flatnonzero(b_side.marked[b[1:]]) + 1
    _, i, j = np.intersect1d(a_ends[a_at - 1], b_ends[b_at - 1], assume_unique=True, return_indices=True)
    return np.r_[0, a_at[i], len(a)], np.r_[0, b_at[j], len(b)]


class Windows:
    """Alignments of windows, remembered by their id tuples: groups as text and links.

    A window's key is its tuple of A ids, a mark and its tuple of B ids, as packed numbers. The windows of a batch that are
    not known yet are aligned together: both sides of a window have equally many bytes, so windows in a row are aligned
    as one document and parted again.
    """

    def __init__(self, given: Tokenizers, memory: int = MEMORY):
        self.given, self.most = given, memory
        # A token's text in the digest, and what stands behind it: more of the group, its other side, the next group.
        self.symbols = [f"{i}{end}".encode() for i in range(len(given.a.table)) for end in ",|"] + [f"{i}{end}".encode() for i in range(len(given.b.table)) for end in ",;"]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.stretches: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.links, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.tokens = np.empty((2, 0), np.int64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The number of each window, by which its text and links are found. Numbers hold until the next call."""
        if len(self.links) > self.most:
            self._forget()
        return self._placed(keys)

    def _placed(self, keys: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(k for k in keys if k not in self.known))
        if new:
            self.known.update(zip(new, self._learn(new), strict=True))
        return np.array([self.known[k] for k in keys], np.int64)

    def _learn(self, new: list[bytes]) -> range:
        """Aligns windows and returns their numbers."""
        ids = np.frombuffer(b"".join(new), np.int32)
        of = np.repeat(np.arange(len(new)), [len(k) // 4 for k in new])
        mark = ids < 0
        before = np.cumsum(mark) - mark == of  # A ids stand before the mark of their window
        a, b, b_of = ids[before & ~mark].astype(np.int64), ids[~before].astype(np.int64), of[~before]
        a_of = of[before & ~mark]
        a_ends, b_ends = np.cumsum(self.given.a.sizes[a]), np.cumsum(self.given.b.sizes[b])
        # Every stretch between neighbouring ends of either side is the overlap of one A and one B token.
        i = np.searchsorted(a_ends, cells := np.union1d(a_ends, b_ends))
        links = a[i] * WIDE + b[np.searchsorted(b_ends, cells)]
        count = np.bincount(a_of[i], minlength=len(new))
        # Groups end where both sides end; a group's A tokens are written before its B tokens.
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.isin(a_ends, shared), np.isin(b_ends, shared)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
        symbol = np.r_[2 * a + a_last, 2 * len(self.given.a.table) + 2 * b + b_last][order].tolist()
        cut = np.searchsorted(np.r_[a_of, b_of][order], np.arange(len(new) + 1)).tolist()
        written = list(map(self.symbols.__getitem__, symbol))
        self.tokens = np.c_[self.tokens, [np.bincount(a_of, minlength=len(new)), np.bincount(b_of, minlength=len(new))]]
        self.texts += [b"".join(written[s:e])[:-1] for s, e in zip(cut, cut[1:], strict=False)]
        self.links = np.r_[self.links, links]
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(count)]
        return range(len(self.texts) - len(new), len(self.texts))

    def texts_aligned(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Number of A tokens, of B tokens and of groups, digest of the groups and all links of each text.

        A stretch ends at an anchor, so a short one is a window, found by its characters without going through its ids.
        """
        if not self.given.parted:
            encoded = self.given.encode(texts)
            return [(len(a), len(b), *found) for (a, b), found in zip(encoded, self.align(encoded), strict=True)]
        if len(self.links) > self.most or len(self.stretches) > STRETCHES:
            self._forget()
        parts = [STRETCH.split(" " + t) if t else [] for t in texts]
        learnt = self.given._stretches(list({p for own in parts for p in own if p not in self.stretches}))
        short = [p for p, ids in learnt.items() if ids and len(p) <= LONGEST]
        if short:
            self.stretches.update(zip(short, self._learn([MARK.join(learnt[p]) for p in short]), strict=True))
        rows = []
        for text, own in zip(texts, parts, strict=True):
            try:
                rows.append([self.stretches[p] for p in own])
            except KeyError:  # a long stretch, or one that does not keep its bytes alone
                rows.append(self._parted(text, own, learnt))
        return self._joined(rows)

    def _parted(self, text: str, own: list[str], learnt: dict[str, tuple[bytes, bytes] | None]) -> list[int]:
        """The windows of a text whose stretches are not all remembered."""
        if any(learnt.get(p, True) is None for p in own):
            ((a, b),) = self.given._whole([text])
            return self._placed(self._keys(a, b)).tolist() if len(a) else []
        row: list[int] = []
        for p in own:
            at = self.stretches.get(p)
            row += [at] if at is not None else self._placed(self._keys(*(np.frombuffer(i, np.int32) for i in learnt[p]))).tolist()
        return row

    def align(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, str, np.ndarray]]:
        """Number of groups, digest of the groups and all links of each document, given as its A and B ids."""
        keys, counts = [], []
        for a, b in pairs:
            own = self._keys(a, b) if len(a) else []
            keys += own
            counts.append(len(own))
        at, stop = self.places(keys).tolist(), np.cumsum([0, *counts]).tolist()
        return [found[2:] for found in self._joined([at[s:e] for s, e in zip(stop, stop[1:], strict=False)])]

    def _joined(self, rows: list[list[int]]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Tokens, groups, digest and links of documents, given as the numbers of their windows."""
        at = np.array([k for row in rows for k in row], np.int64)
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        links = self.links[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        last = np.cumsum([0, *map(len, rows)])
        stop = np.r_[0, np.cumsum(size)][last].tolist()
        tokens = np.diff(np.c_[np.zeros((2, 1), np.int64), np.cumsum(self.tokens[:, at], axis=1)][:, last]).tolist()
        out = []
        for row, n_a, n_b, first, end in zip(rows, *tokens, stop, stop[1:], strict=False):
            whole = b";".join([self.texts[k] for k in row])
            out.append((n_a, n_b, whole.count(b"|"), hashlib.sha256(whole).hexdigest() if row else "", links[first:end]))
        return out

    def _keys(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        at, bt = anchors(a, b, self.given.a, self.given.b)
        n = np.arange(len(at) - 1)
        row = np.empty(len(a) + len(b) + len(n), np.int32)
        row[np.arange(len(a)) + np.repeat(bt[:-1] + n, np.diff(at))] = a
        row[at[1:] + bt[:-1] + n] = -1
        row[np.arange(len(b)) + np.repeat(at[1:] + n + 1, np.diff(bt))] = b
        flat, cut = row.tobytes(), (4 * (at + bt + np.arange(len(at)))).tolist()
        return [flat[s:e] for s, e in zip(cut, cut[1:], strict=False)]


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Per document: token, group and link numbers, the digest of its groups, its distinct id pairs and how often it has each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = tokenizers(folder)
        windows = Windows(given)
        for batch in H.small(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            numbers, digests, pairs, times = [], [], [], []
            for *counted, digest, links in windows.texts_aligned(texts):
                ids, count = np.unique(links, return_counts=True)
                numbers.append((*counted, len(links)))
                digests.append(digest)
                pairs.append(ids)
                times.append(count)
            sizes = [len(p) for p in pairs]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array([n[i] for n in numbers], pa.int64()) for i in range(4)], pa.array(digests, pa.string()),
                H.lists(np.concatenate(pairs), sizes, pa.int64()), H.lists(np.concatenate(times), sizes, pa.int64())],
                names=[c.split()[0] for c in ALIGNED.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (whether no pair of the same A id has more) of all aligned documents."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = counts.withColumn("a", F.expr(f"pair div {WIDE}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "a", "count", (F.col("count") == F.col("top")).alias("best"))


def measured(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per row of `docs`."""
    scratch = Scratch()
    found = scratch.stored(aligned(docs, folder).withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.stored(pair_counts(found))
    number = found.count()
    common = F.broadcast(counts.where(F.col("count") * SHARE >= number))
    rare = counts.where(F.col("count") * SHARE < number)
    held = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("held")).select("row", F.col("held.pairs").alias("pair"), F.col("held.times").alias("times"))
    sums = [F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    often = held.join(common, "pair").groupBy("row").agg(*sums)
    seldom = held.join(common.select("pair"), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
    total = often.unionByName(seldom).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = stored(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
    scratch.drop(docs.sparkSession)
    return out
