"""Alignment of two tokenisations against brute force over byte positions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lictor.llm import token_align as align


@pytest.fixture(scope="module")
def given():
    return align.Tokenizers(align.FOLDER)


TEXTS = [
    None, "", " ", "a", "Hello world", "  two  spaces\tand\nlines \n\n", "漢字 é ß 😀 naïve", "<|endoftext|> <s> </s> <unk>", "x" * 3000,
    "mark▁inside", "The quick brown fox. " * 40, "The quick brown fox.", "nul\x00byte", "a b ﬁne", "ends ", "1234567890 12,345.67",
]


def brute(given, texts):
    """Per text (n_a, n_b, n_groups, links, digest), from sets of byte positions."""
    out = []
    for text in texts:
        a = b = []
        if text:
            whole = (" " + text).encode()
            a = given.byte_level.encode(" " + text, add_special_tokens=False).ids
            b = given.pieces.encode(text)
            if b"".join(given.a.table[i] for i in a) != whole or b"".join(given.b.table[i] for i in b) != whole:
                a = b = []
        spans = []
        for ids, side in ((a, given.a), (b, given.b)):
            at, held = 0, []
            for i in ids:
                held.append((at, at + len(side.table[i]), i))
                at += len(side.table[i])
            spans.append(held)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(i) for s, e, i in side if low <= s < high) for side in spans) for low, high in zip([0, *cuts], cuts, strict=False)]
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, spans[1][j][2]))
                j += 1
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def test_measured_equals_brute_force(spark, given):
    draw = random.Random(3)
    texts = TEXTS + [" ".join("".join(draw.choice("abcdeé漢. \n") for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 60))) for _ in range(40)]
    found = brute(given, texts)
    count = Counter(p for *_, links, _ in found for p in set(links))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = sorted(
        (i, n_a, n_b, n_groups, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest)
        for i, (n_a, n_b, n_groups, links, digest) in enumerate(found))
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id int, text string, pairs string, row int, a string")
    got = sorted(tuple(r) for r in align.measured(table).collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 45 and any(t and r[1] == 0 for t, r in zip(texts, got, strict=True))


def test_joined_in_a_shuffle_too(spark, given, monkeypatch):
    texts = [f"word{i} shared tail {i % 7}" for i in range(30)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(tuple(r) for r in align.measured(table).collect())
    monkeypatch.setattr(align, "SHARE", 1)
    assert sorted(tuple(r) for r in align.measured(table).collect()) == whole


def test_memory_changes_nothing(given):
    small, large = align.Windows(given, 1), align.Windows(given)
    encoded = given.encode([t or "" for t in TEXTS])
    whole = large.align(encoded)
    for pair, two, again in zip(encoded, whole, large.align(encoded), strict=True):
        one, = small.align([pair])
        assert one[:2] == two[:2] == again[:2] and np.array_equal(one[2], two[2]) and np.array_equal(two[2], again[2])
    assert len(small.known) < len(large.known)


def test_anchors_are_shared_ends_before_spaces(given):
    (a, b), = given.encode(["one two  three four"])
    at, bt = align.anchors(a, b, given.a, given.b)
    assert len(at) == len(bt) > 3
    for i, j in zip(at[1:-1], bt[1:-1], strict=True):
        assert given.a.sizes[a[:i]].sum() == given.b.sizes[b[:j]].sum() and given.a.marked[a[i]] and given.b.marked[b[j]]


def test_empty_table_repeats_and_null_ids(spark):
    table = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert align.measured(table.limit(0)).collect() == []
    rows = align.measured(table).collect()
    assert len(rows) == 3 and {r.count_sum for r in rows} == {3 * rows[0].n_links} and {r.doc_id for r in rows} == {None, 1}


def test_stretches_are_encoded_once_and_make_the_same_ids(given):
    draw = random.Random(5)
    pieces = ["word", "a", "é", "漢字", " ", "  ", "\n", "\t", "▁", "don't", "12,3", "\x00", "　", "\x1c", "😀", "<s>", "ﬁ", "́", "x" * 60]
    texts = [t for t in TEXTS if t is not None] + [" ".join(draw.choices(pieces, k=9)) + "".join(draw.choices(pieces, k=3)) for _ in range(300)]
    again = align.Tokenizers(align.FOLDER)
    for batch in (texts[:100], texts[100:], texts):
        for ours, whole in zip(again.encode(batch), given._whole(batch), strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(ours, whole, strict=True))
    assert again.parted and " word" in again.known and " " + "x" * 60 not in again.known


def test_a_known_stretch_is_aligned_without_being_encoded_again(given, monkeypatch):
    texts = [t or "" for t in TEXTS] + ["one  two\nthree four", "x" * 60 + " " + "y" * 70, " one two", "one two "]
    ours, plain = align.Windows(given), align.Windows(given)
    encoded = given._whole(texts)
    expected = [(len(a), len(b), *found[:2], found[2].tolist()) for (a, b), found in zip(encoded, plain.align(encoded), strict=True)]
    as_rows = lambda found: [(*row[:4], row[4].tolist()) for row in found]
    assert as_rows(ours.texts_aligned(texts)) == expected
    learnt = []
    monkeypatch.setattr(given, "_stretches", lambda new: learnt.extend(new) or align.Tokenizers._stretches(given, new))
    assert as_rows(ours.texts_aligned(texts)) == expected
    assert not [p for p in learnt if len(p) <= align.LONGEST and align.Tokenizers._stretches(given, [p])[p]]
    forgetful = align.Windows(given, 1)
    assert [as_rows(forgetful.texts_aligned([t]))[0] for t in texts] == expected
