"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lictor.llm import (
    chat, decontamination, hashing, html_text, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, tables, token_counts, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, row string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def word(draw):
    return "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 8)))


def prose(draw, n):
    return " ".join(word(draw) for _ in range(n))


def docs_of(spark, texts, ids=None, langs=None, sources=None):
    n = len(texts)
    rows = [((ids or range(n))[i], texts[i], (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(texts[i] or ""), "x", "y", "z") for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "two words", "É ß — 漢字"]


def test_words_equal_the_pattern():
    texts = [*ODD, "a\x0bb\x0cc", "x" * 3000, "ends ", " begins"]
    for lower, inside, pattern in ((False, hashing.SPACED, "[^\x20\x09-\x0D]+"), (True, hashing.ALPHANUMERIC, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = hashing.words(pa.array(texts), inside, lower)
        for i, text in enumerate(texts):
            t = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
            want = re.findall(pattern, t)
            got = [bytes(found.data[a:b]).decode() for a, b in zip(found.starts[found.bounds[i]:found.bounds[i + 1]], found.ends[found.bounds[i]:found.bounds[i + 1]], strict=True)]
            assert got == want
    same = hashing.words(pa.array(["a b", "c a b"]))
    assert same.hashes[0] == same.hashes[3] and len(set(same.hashes.tolist())) == 3


def test_segments_hash_equal_runs_alike():
    h = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    of = hashing.Segments(h)
    a, b = of(np.array([0, 0]), np.array([3, 2])), of(np.array([3, 3]), np.array([6, 5]))
    assert (a == b).all() and a[0] != a[1]


# 1 ------------------------------------------------------------------------------------------------------------------


def repeated_windows(texts, ids, least):
    first, rows = {}, []
    for _, i in sorted((d, i) for i, d in enumerate(ids)):
        w = WORD.findall(texts[i] or "")
        for s in range(len(w) - least + 1):
            rows.append((i, s, key := tuple(w[s:s + least])))
            first.setdefault(key, (i, s))
    count = Counter(k for _, _, k in rows)
    covered = {True: {}, False: {}}
    for i, s, key in rows:
        if count[key] > 1:
            covered[first[key] != (i, s)].setdefault(i, set()).update(range(s, s + least))
    return covered


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    shared = [prose(draw, draw.randint(10, 70)) for _ in range(6)]
    texts = [" ".join(x for _ in range(4) for x in (prose(draw, draw.randint(0, 30)), draw.choice(shared))) for _ in range(14)]
    texts += [texts[0], "na " * 200, prose(draw, 3000), *ODD]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    least, seed_words = (50, 10) if seed % 2 else (20, 6)
    found = suffix_dedup.passages(docs_of(spark, texts, ids), least, seed_words).collect()
    got = {True: {}, False: {}}
    for r in found:
        got[r.removed].setdefault(ids.index(r.doc_id), set()).update(range(r.begin, r.end))
    assert got == repeated_windows(texts, ids, least)


def test_cleaned_texts_keep_the_first_passage(spark):
    draw = random.Random(9)
    passage, clean = prose(draw, 60), prose(draw, 80)
    texts = ["start " + passage + " end", clean, "other\n" + passage + "\ntail é", passage, None, ""]
    out = {r.doc_id: r for r in suffix_dedup.cleaned(docs_of(spark, texts)).collect()}
    assert set(out) == {0, 1, 2, 4, 5}
    assert out[0].text == texts[0] and out[1].text == clean and out[4].text is None and out[5].text == ""
    assert out[2].text == "other\ntail é" and out[2].n_chars == len(out[2].text)
    assert len(suffix_dedup.cleaned(docs_of(spark, texts)).columns) == 8


def test_repeated_rows_share_their_first_place(spark):
    text = prose(random.Random(1), 70)
    docs = docs_of(spark, [text, text], [4, 4])
    assert {(r.begin, r.end, r.removed) for r in suffix_dedup.passages(docs).collect()} == {(0, 70, False)}
    assert suffix_dedup.cleaned(docs).count() == 2
    assert suffix_dedup.passages(docs.where("false")).count() == 0 and suffix_dedup.cleaned(docs.where("false")).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def test_totals_equal_a_recount_and_commits_are_idempotent(spark, tmp_path):
    versions = {"words-1": None}
    docs = docs_of(spark, ["a b c", "d e", None, "f", "f"], [1, 2, 3, 4, 4], ["en", "en", None, "de", "de"], ["s", None, "s", "t", "t"])
    images = token_counts.counted(docs, versions)
    store = token_counts.TokenTotals(spark, f"file://{tmp_path}/store")
    store.commit("1", token_counts.inserts(images))
    after = token_counts.counted(docs_of(spark, ["a b c d e", "d"], [1, 2], ["en", "fr"], ["s", None]), versions)
    change = token_counts.revisions(images.where("doc_id IN (1, 2)"), after)
    for _ in range(2):
        store.commit("2", change)
        store.commit("3", token_counts.deletes(images.where("doc_id = 4")))
        store.commit("4", token_counts.inserts(images.where("false")))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert got == {("s", "en"): (1, 5), (None, "fr"): (1, 1), ("s", None): (1, 0)}


def test_byte_pair_counts(spark):
    import tiktoken

    texts = ["Hello world, don't!", "  spaces\n\n", None, "漢字 é"]
    got = {(r.doc_id, r.version): r.n_tokens for r in token_counts.counted(docs_of(spark, texts)).collect()}
    assert isinstance(token_counts._encoding(token_counts.VERSIONS["byte-bpe-50k"]), tiktoken.Encoding)
    for i, t in enumerate(texts):
        assert got[i, "words-1"] == len(WORD.findall(t or ""))
        assert got[i, "byte-bpe-50k"] == len(token_counts._encoding(token_counts.VERSIONS["byte-bpe-50k"]).encode_ordinary(t or ""))


# 3 ------------------------------------------------------------------------------------------------------------------


def test_classifier_learns_and_scores_every_row(spark):
    draw = random.Random(2)
    good = [prose(draw, draw.randint(20, 60)) for _ in range(150)]
    bad = [" ".join(word(draw) + draw.choice(["###", "$$$", "&&&"]) for _ in range(draw.randint(20, 60))) for _ in range(150)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + [None, "", "word"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == list(range(303)) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.95
    # Labels of the held-out class are never read.
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - quality ELSE quality END quality")
    assert {r.doc_id: r.score for r in quality_classifier.scored(docs, turned).collect()} == {r.doc_id: r.score for r in rows}
    kept = quality_classifier.accepted(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.5} and kept.columns == docs.columns


def test_classifier_without_labels_or_documents(spark):
    docs = docs_of(spark, ["a b", None], [1, None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_classifier.scored(docs, none).collect()] == [0.5, 0.5]
    assert quality_classifier.scored(docs.where("false"), none).count() == 0
    assert quality_classifier.accepted(docs, none).count() == 2


def test_temperature_is_fitted_on_rows_set_aside():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, 3))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality_classifier.Network(x, y)(x)
    for low in np.arange(0.05, 0.95, 0.1):
        inside = (p >= low) & (p < low + 0.1)
        if inside.sum() > 100:
            assert abs(p[inside].mean() - y[inside].mean()) < 0.1


# 4 ------------------------------------------------------------------------------------------------------------------


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_and_outliers(spark):
    draw = random.Random(3)
    texts = [prose(draw, draw.randint(30, 90)) for _ in range(140)]
    texts += [" ".join(word(draw) + "###" for _ in range(50)) for _ in range(8)]
    loop = prose(draw, 9)
    texts += [f"{loop} {loop} {prose(draw, 30)} {loop}", "l m\nl m\n\n \nn", "a b c d e f g h " * 6, "x " * 400, prose(draw, 5000), *ODD]
    n = len(texts)
    docs = docs_of(spark, texts, None, ["en" if i % 2 else None for i in range(n)], ["s" if i % 3 else "tiny" for i in range(n)])
    rows = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert len(rows) == n
    for i, t in enumerate(texts):
        r, want = rows[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(140)) and not any(rows[i].kept for i in range(140, 148))


def smallest_determinant(x):
    """Squared distances by the minimum covariance determinant, from many starts, without grids or Spark."""
    n, p = x.shape
    h, floor = math.ceil(quality_rules.SHARE * n), np.diag([f * f for f in quality_rules.FLOORS.values()])
    factor = quality_rules.SHARE / quality_rules.chi_square(quality_rules.chi_square_quantile(quality_rules.SHARE, p), p + 2)
    draw, best = np.random.default_rng(1), (math.inf, None)
    for _ in range(300):
        some, old = draw.choice(n, p + 1, replace=False), math.inf
        while True:
            mean, cov = x[some].mean(0), factor * np.cov(x[some].T, bias=True) + floor
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            now = np.linalg.slogdet(cov)[1] if len(some) == h else math.inf
            if now < best[0]:
                best = now, far
            if len(some) == h and now > old - 1e-9:
                break
            some, old = np.argsort(far)[:h], now
    return best[1]


def test_moderate_outliers_equal_a_brute_force_determinant(spark):
    draw = random.Random(8)
    texts = [prose(draw, draw.randint(80, 120)) for _ in range(150)]
    texts += [" ".join(word(draw) + ("#" if i % 5 == 0 else "") for i in range(100)) for _ in range(3)]  # 20 symbols per 100 words
    loop = [prose(draw, 14) for _ in range(3)]
    texts += [f"{x} {prose(draw, 36)} {x} {prose(draw, 36)}" for x in loop]  # 28 % repeated words
    texts += ["\n".join([prose(draw, 5)] + ["same"] * 13 + [prose(draw, 80)]) for _ in range(3)]
    texts += [" ".join(w if i % 8 else f"{w} {w}" for i, w in enumerate(prose(draw, 90).split())) for _ in range(3)]  # 12 % stutter
    docs = docs_of(spark, texts)
    rows = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    inside = [i for i in range(len(texts)) if not rows[i].base_failed]
    assert len(inside) >= 159
    far = smallest_determinant(np.array([[rows[i][f] for f in quality_rules.FEATURES] for i in inside]))
    limit = quality_rules.chi_square_quantile(quality_rules.CUT, len(quality_rules.FEATURES))
    assert [rows[i].kept for i in inside] == [bool(d <= limit) for d in far]
    assert np.allclose([rows[i].distance for i in inside], far, rtol=0.1, atol=0.5)
    assert not any(rows[i].kept for i in range(150, len(texts))) and sum(rows[i].kept for i in range(150)) >= 147


def test_estimates_converge_beside_many_other_groups(spark):
    """One more concentration step of a slow group, in numpy, finds nothing better, whatever other groups there are."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(0, 1, (400, 5)), draw.normal(2.5, 1, (300, 5))])
    schema = "doc_id long, grp string, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES)
    rows = spark.createDataFrame([(i, "own", *map(float, v)) for i, v in enumerate(x)], schema)
    constant = spark.range(400 * 60).selectExpr("id doc_id", "cast(id % 400 as string) grp", *[f"1.0D {f}" for f in quality_rules.FEATURES])
    got = quality_rules.estimates(rows.unionByName(constant), starts=1).where("grp = 'own'").first()
    mean = np.array([got[f"m_{i}"] for i in range(5)])
    w = np.array([[got[f"w_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    share = quality_rules.SHARE
    factor = share / quality_rules.chi_square(quality_rules.chi_square_quantile(share, 5), 7)
    step = np.floor(256 * np.log2((((x - mean) @ w.T) ** 2).sum(1)))  # the grid of the module
    near = x[step <= np.sort(step)[math.ceil(share * len(x)) - 1]]
    cov = factor * np.cov(near.T, bias=True) + np.diag([f * f for f in quality_rules.FLOORS.values()])
    assert np.linalg.slogdet(cov)[1] > -2 * np.log(np.diag(w)).sum() - 2 * 1e-3


def test_rules_on_empty_and_constant_tables(spark):
    text = prose(random.Random(4), 40)
    same = docs_of(spark, [text] * 30, [7] * 30)
    assert [r.kept for r in quality_rules.judged(same).collect()] == [True] * 30
    assert quality_rules.judged(same.where("false")).count() == 0
    assert [r.kept for r in quality_rules.judged(docs_of(spark, [None], [None])).collect()] == [False]


def test_chi_square():
    assert quality_rules.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)
    assert quality_rules.chi_square_quantile(0.975, 2) == pytest.approx(7.3778, abs=1e-4)


# 5 ------------------------------------------------------------------------------------------------------------------


def contaminated(texts, items):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, named = split(t), set(), set()
        for item, text in items:
            iw = split(text)
            k = min(13, len(iw))
            for b in range(len(iw) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s:s + k] == iw[b:b + k]:
                        hit.update(range(s, s + k))
                        named |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_equals_brute_force(spark):
    draw = random.Random(5)
    items = [(i, prose(draw, draw.choice([1, 3, 5, 8, 13, 14, 30]))) for i in range(12)] + [(3, "Twice the id"), (None, prose(draw, 9)), (40, None), (41, "!!"), (10, "Zwei Ä-Wörter")]
    texts = []
    for _ in range(25):
        w = prose(draw, draw.randint(0, 60)).split()
        for _ in range(draw.randint(0, 3)):
            piece = (draw.choice(items)[1] or "").split()
            cut = draw.randint(0, 3)
            at = draw.randint(0, len(w))
            w[at:at] = [x.upper() if draw.random() < 0.3 else x + "," for x in piece[cut if cut < 2 else 0:]]
        texts.append(" ".join(w))
    texts += [texts[0], "zwei ä wörter", *ODD]
    ids = [None, *range(1, len(texts))]
    ids[-1] = 1  # a doc_id on two texts
    found = decontamination.judged(docs_of(spark, texts, ids), spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, win string"))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found.collect())
    assert got == Counter((i, n, h, tuple(s), c) for i, (n, h, s, c) in zip(ids, contaminated(texts, items), strict=True))


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = docs_of(spark, ["a b c", "d"])
    assert [r.n_hit for r in decontamination.judged(docs, items.where("false")).collect()] == [0, 0]
    assert decontamination.judged(docs.where("false"), items).count() == 0
    kept = decontamination.cleaned(docs, items)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == docs.columns


# 6 ------------------------------------------------------------------------------------------------------------------


def by_rules(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def witten_bell(text, grams, order):
    p_log, t = 0.0, "\x02" + text + "\x03"
    for at in range(1, len(t)):
        p = 1 / url_filter.ALPHABET
        for k in range(min(order, at) + 1):
            of = grams.get(t[at - k:at], {})
            n, f = sum(of.values()), len(of)
            p = (of.get(t[at], 0) + f * p) / (n + f) if n else p
        p_log += np.log(p)
    return p_log


def test_url_verdicts_equal_brute_force(spark):
    import zlib

    hosts = ["a.net", "Shop.example.net", "good.org", "x.example.com", "win.example.com", "fine.example.org", "plain.com", "more.org", "b.net", "c.org"]
    urls = [f"http{'s' * (i % 2)}://{hosts[i % 10]}/{('en', 'de', 'fr')[i % 3]}/{i}{('', '/', '?q', '#f')[i % 4]}" for i in range(120)]
    urls += [None, "", "no scheme", "http://net", "http://net/", "x://a.net?p", "http://examplexnet/en/", "http://EXAMPLE.net/EN/", "a://b://c.net/", urls[0]]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert len(rows) == len(urls)
    want = [by_rules(u) for u in urls]
    grams = {"allow": {}, "block": {}}
    form = lambda h, p: re.sub("[0-9]+", "0", h + p)
    for host, path, _, verdict in want:
        if verdict and zlib.crc32(host.encode()) % url_filter.FOLDS:
            t = "\x02" + form(host, path) + "\x03"
            for at in range(1, len(t)):
                for k in range(min(url_filter.ORDER, at) + 1):
                    grams[verdict].setdefault(t[at - k:at], Counter())[t[at]] += 1
    for i, (host, path, rule, verdict) in enumerate(want):
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[i]
        if verdict:
            assert r.verdict == verdict
        else:
            f = form(host, path)
            assert r.ratio == pytest.approx((witten_bell(f, grams["block"], 5) - witten_bell(f, grams["allow"], 5)) / (len(f) + 1), abs=1e-6)
            assert r.verdict == ("block" if r.p_block >= 0.5 else "allow")
    assert url_filter.judged(pages.where("false")).count() == 0
    assert [r.verdict for r in url_filter.judged(pages.where("url = 'http://net'")).collect()] == ["allow"]


# 7 ------------------------------------------------------------------------------------------------------------------


def linked(texts, ids, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(sets[i]), least.get(find(i))) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # several blocks per bucket
    monkeypatch.setattr(near_dedup, "LARGE", 3)
    draw = random.Random(seed)
    texts = []
    for _ in range(6):
        base = prose(draw, draw.randint(30, 120)).split()
        for _ in range(draw.randint(1, 25)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = word(draw)
            texts.append(" ".join(x.upper() if draw.random() < 0.1 else x for x in copy))
            base = copy if draw.random() < 0.3 else base
    shared = prose(draw, 30)
    texts += [shared + " " + prose(draw, 30) for _ in range(30)] + [texts[0], prose(draw, 4000), *ODD]
    ids = list(range(100, 100 + len(texts)))
    draw.shuffle(ids)
    ids[3] = ids[4] = None
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(docs_of(spark, texts, ids), 4, 80).collect())
    want = Counter((d, n, d if n == 0 else c) for d, (n, c) in zip(ids, linked(texts, ids, 4, 80), strict=True))
    assert got == want


def test_deduplicated_keeps_one_of_each_group(spark):
    draw = random.Random(6)
    a, b = prose(draw, 40), prose(draw, 50)
    texts, ids = [a, a, a + " x", b, b, b, "", None, None], [5, 5, 2, None, None, 9, 1, 3, 3]
    docs = docs_of(spark, texts, ids)
    out = near_dedup.deduplicated(docs)
    assert Counter(r.doc_id for r in out.collect()) == Counter({2: 1, 9: 1, 1: 1, 3: 1}) and out.columns == docs.columns
    unnamed = docs_of(spark, [a, a, b], [None, None, None])
    assert Counter(r.text for r in near_dedup.deduplicated(unnamed).collect()) == Counter({a: 1, b: 1})
    assert near_dedup.deduplicated(docs.where("false")).count() == 0


def test_rows_that_no_key_concerns_go_past_a_join(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("key"))
    keys = tables.stored(rows.where("id % 50 = 0").select("key"))
    met, others = (part.select("id").toPandas()["id"].tolist() for part in tables.parted(rows, keys, "key"))
    assert sorted(met + others) == list(range(5000))
    assert set(range(0, 5000, 50)) <= set(met) and len(met) < 500
    met, others = tables.parted(rows, keys.where("false"), "key")
    assert met.count() == 0 and others.count() == 5000 and others.columns == rows.columns


def test_one_large_group_is_not_compared_with_itself(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    names = [bytes([i]) * 16 for i in range(1, 101)]
    members = spark.createDataFrame([(7, n) for n in names], "bucket long, cls binary")
    known = spark.createDataFrame([(n, names[0]) for n in names[1:97]], "node binary, root binary")
    finer = spark.createDataFrame([(n, 9, [i] * 8, [i] * 32, [7] + [i] * 29) for i, n in enumerate(names)], "cls binary, n long, sketch array<long>, fine array<long>, bands array<long>")
    scratch = tables.Scratch()
    rows = near_dedup._ordered_blocks(scratch, members, known, finer, 1, True)[0].collect()
    assert len(rows) <= 100 + 3 * 13  # each class once, and the three loose ones in every block
    met = {frozenset((r.cls, s.cls)) for r in rows for s in rows if r.asks and s.stays and (r.block, r.chunk) == (s.block, s.chunk) and r.comp != s.comp}
    loose = names[97:]
    assert met == {frozenset((a, b)) for a in loose for b in names if a != b}
    scratch.drop(spark)


def test_odd_sketches_estimate_high_similarities():
    draw = np.random.default_rng(1)
    for similarity in (0.95, 0.9, 0.8, 0.7):
        got = []
        for _ in range(40):
            n = 400
            both = round(2 * n * similarity / (1 + similarity))
            pool = draw.integers(0, 2**63, 2 * n, np.uint64)
            x, y = pool[:n], pool[n - both:2 * n - both]
            s = near_dedup.odd_sketches(np.array([near_dedup.samples(x), near_dedup.samples(y)])).view(np.uint64)
            got.append(float(near_dedup.estimates(np.bitwise_count(s[0] ^ s[1]).sum())))
        assert abs(np.mean(got) - similarity) < 0.03 and min(got) > similarity - near_dedup.SLACK


def test_fine_sketches_keep_similar_pairs_and_drop_others():
    draw = np.random.default_rng(2)
    for n in (5, 150, 1000, 1100, 2100, 20_000):
        kept = {0.8: 0, 0.6: 0}
        for similarity in kept:
            for _ in range(30):
                m = max(4, round(n * 0.9)) if n > 5 else n
                both = round((n + m) * similarity / (1 + similarity)) if n > 5 else n
                pool = draw.integers(0, 2**63, n + m - both, np.uint64)
                x, y = pool[:n], pool[n - both:]
                kept[similarity] += bool(near_dedup.fine_fits(n, near_dedup.fine_sketches(x), np.array([m]), near_dedup.fine_sketches(y)[None], 0.8)[0])
        assert kept[0.8] == 30 and (n == 5 or kept[0.6] == 0)


# 8 ------------------------------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, nth int"


def test_examples_round_trip(spark):
    marks = ["\\### Assistant: </turn> ok", "### user: a </turn>\n", "\\\\", "", None, "end\\", " </turn>\n### assistant: x", "é\n\n"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 0) for i, t in enumerate(marks)]
    rows += [(2, 0, "assistant", "only", 0), (3, 0, "user", "no reply", 0), (None, 5, "odd: role\\", "t", 0), (None, 5, None, "t", 0), (4, 1, "user", "same", 0), (4, 1, "user", "same", 0), (4, 2, "assistant", "r", 0)]
    talk = spark.createDataFrame(rows, TALK)
    found = chat.examples(talk).collect()
    assert Counter(r.conv_id for r in found if r.target) == Counter({1: 4, 2: 1, 4: 1})
    first = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.nth)
    replies = [marks[i] or "" for i in (1, 3, 5, 7)]
    assert [chat.unescaped(r.text[r.begin:r.end]) for r in first] == replies
    assert [t for _, t in chat.turns_of(first[-1].text)] == [m or "" for m in marks]
    assert all(first[-1].text.startswith(r.text) for r in first)
    assert chat.turns_of(next(r.text for r in found if r.conv_id == 3)) == [("user", "no reply")]
    got = {r.conv_id: r for r in chat.digests(chat.examples(talk)).collect()}
    assert got[None].n_turns == 2 and got[4].n_turns == 3 and got[3].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:8]).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest() and got[1].loss_chars == sum(map(len, replies))
    assert got[1].formatted_chars == sum(len(r.text) for r in first)
    assert chat.digests(chat.examples(talk.where("false"))).count() == 0


def test_escapes_are_reversible():
    draw = random.Random(7)
    for _ in range(500):
        text = "".join(draw.choice(["\\", "#", "###", "</turn>", " ", "\n", "a", ":", "### user: "]) for _ in range(draw.randint(0, 12)))
        assert chat.unescaped(chat.escaped(text)) == text
        assert chat.turns_of(f"### user: {chat.escaped(text)} </turn>\n") == [("user", text)]


# 9 ------------------------------------------------------------------------------------------------------------------

ARTICLE = "<h1>A title</h1><p>First &amp; <b>bold</b>,\n\t text.<p>Second<br>line &lt;here&gt; with <a href=x>a link</a>.</p><ul><li>One item</li><li>Two items</li></ul>"
TEXT = "A title\n\nFirst & bold, text.\n\nSecond line <here> with a link.\n\nOne item\n\nTwo items"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>x';</script></head><body><nav><ul><li><a>Menu</a></ul></nav><article>{ARTICLE}</article><footer>&copy; foot.</footer></body></html>",
    f"<body><header><h1>Site name, with words.</h1></header><div class='sidebar-left'><p>Aside text, long enough.</p></div><main><header>{ARTICLE[:16]}</header>{ARTICLE[16:]}<section id=comments><p>I disagree, strongly.</p></section></main>",
    f"<body><div id='menu'><a>Home</a> <a>About</a></div><div><div class=\"post\">{ARTICLE}</div></div><form><p>Your mail, please.</p><input></form><div class='cookie-notice'>We use cookies, as all do.</div><!-- <p>old</p> -->",
    f"<ARTICLE CLASS=post>{ARTICLE}<aside>More.</aside><div class='ad'>Buy this, now.</div></ARTICLE>",
])
def test_main_text(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div><div>{}</div></div>"])
def test_short_blocks_stay_beside_long_paragraphs(outer):
    long = ["A sentence of some length, with marks. " * 51 + f"No {i}." for i in range(10)]
    items = [f"list item number {i:03}" for i in range(30)]
    cells = [f"cell {i}" for i in range(40)]
    links = [f"Other page {i}" for i in range(30)]
    page = "".join(f"<p>{t}</p>" for t in long) + "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul><p>" + long[0] + "</p><table>"
    page += "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2], strict=True)) + "</table><pre>x = 1</pre>"
    other = "<section><ol>" + "".join(f"<li><a href=x>{t}</a></li>" for t in links) + "</ol></section>"
    got = html_text.main_text(outer.format(page + other)).split("\n\n")
    assert got == [*long, *items, long[0], *cells, "x = 1"]


@pytest.mark.parametrize("page", [
    f'<body><article class="post comments-open">{ARTICLE}</article></body>',
    f'<body><main class="main with-sidebar">{ARTICLE}</main><div class="sidebar"><p>Aside text.</p></div></body>',
    f'<body><article class="post related">{ARTICLE}</article></body>',
    f'<body><div class="content has-sidebar">{ARTICLE}</div><div id="left-sidebar"><p>Aside text.</p></div></body>',
    f'<body><div class="content sidebar">{ARTICLE}<div class="share-buttons">Share this.</div></div><p class=ad>Buy.</p></body>',
    f'<body><div data-id="menu" data-role="navigation" title="a hidden gem" class="box hidden md:block">{ARTICLE}</div><p hidden>No.</p><p style="color:red; display: none">No.</p><p aria-hidden=true>No.</p></body>',
    f'<body><div class="ad"><p>Buy this, now, and that, too.</p></div><article><h2>Teaser</h2></article><div>{ARTICLE}</div></body>',
])
def test_words_in_attributes_do_not_take_content(page):
    assert html_text.main_text(page) == TEXT


def test_words_that_name_everything_count_for_nothing():
    parts = [f"<div class='{name}'><p>The {name} part, in words.</p></div>" for name in ("related", "comments", "widget")]
    assert html_text.main_text("".join(parts)) == "\n\n".join(f"The {name} part, in words." for name in ("related", "comments", "widget"))


def test_pages_with_odd_markup(spark):
    odd = [None, "", "<", "a < b and c > d", "<p>open", "<script>never ends", "<!-- never ends", "</p></div>", "<p>" * 3000 + "deep", "plain, text. " * 20000]
    pages = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(odd)] + [(None, "u", "<p>t</p>", "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert got[0] == got[1] == got[5] == got[6] == got[7] == "" and got[4] == "open" and got[8] == "deep" and got[None] == "t"
    assert got[3] == "a < b and c > d" and len(got[9]) == len(odd[9]) - 1
    assert html_text.extracted(pages.where("false")).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free)) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_reaches_its_targets(spark, seed):
    draw = random.Random(seed)
    sources = [draw.choice(["b", "a", "z", "é", None, "big", "big", "big", "big"]) for _ in range(150)]
    texts = [prose(draw, draw.randint(0, 40)) for _ in sources] + [None, ""]
    sources += ["null only", "a"]
    ids = [*range(150), None, 3]
    texts[7], sources[7], ids[7] = texts[8], sources[8], ids[8]  # a repeated row
    rows = mixing.mixed(docs_of(spark, texts, ids, None, sources)).collect()
    sizes = Counter()
    for s, t in zip(sources, texts, strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = filled(sizes), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    again = mixing.mixed(docs_of(spark, texts[::-1], ids[::-1], None, sources[::-1])).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in again) == Counter((r.doc_id, r.text, r.taken) for r in rows)


def test_mix_of_nothing(spark):
    assert [r.taken for r in mixing.mixed(docs_of(spark, [None, ""])).collect()] == [0, 0]
    assert mixing.mixed(docs_of(spark, ["a"]).where("false")).count() == 0
