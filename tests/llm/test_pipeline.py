"""The pipeline on a small folder, stage by stage against brute force."""

import random
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from lictor.llm.quality_classifier import scored
from tests.llm.test_operators import WORD, contaminated, filled, linked, prose, repeated_windows, word


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of known kinds: clean, symbol junk, copies, near copies, a shared passage, benchmark text, odd rows."""
    draw = random.Random(11)
    items = [(i, prose(draw, 20)) for i in range(5)] + [(5, None)]
    passage = prose(draw, 60)
    texts = [prose(draw, draw.randint(60, 120)) for _ in range(90)]
    texts += [" ".join(word(draw) + draw.choice(["###", "$$$", "&&&"]) for _ in range(60)) for _ in range(90)]
    texts += [texts[3], texts[3], texts[4] + " " + word(draw)]
    texts += [prose(draw, 70) + "\n" + passage + "\n" + prose(draw, 70) for _ in range(3)]
    texts += [prose(draw, 40) + " " + items[i][1] + " " + prose(draw, 40) for i in range(3)]
    texts += [None, "", prose(draw, 1500)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 90), 0) for i in range(180) if i % 5]
    place = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place, texts, items


def test_stages_equal_brute_force(spark, folder, tmp_path):
    place, texts, items = folder
    docs, kept = spark.read.parquet(f"{place}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, place).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
        if name == "quality":
            low = {r.doc_id for r in scored(before, spark.read.parquet(f"{place}/labels.parquet")).collect() if r.score < 0.5}
            assert set(kept[name]) == set(range(len(texts))) - low
            assert not set(range(90, 180)) & set(kept[name]) and set(range(90)) <= set(kept[name])
    assert all(set(columns) == set(spark.read.parquet(f"file://{tmp_path}/{n}").columns) for n, _ in corpus_pipeline.STAGES[:-1])

    ids = sorted(kept["quality"])
    groups = linked([texts[i] for i in ids], ids, 5, 80)
    assert set(kept["near_duplicates"]) == {i for i, (n, c) in zip(ids, groups, strict=True) if n == 0 or c == i}

    ids = sorted(kept["near_duplicates"])
    gone = repeated_windows([texts[i] for i in ids], ids, 50)[True]
    for at, i in enumerate(ids):
        words = WORD.findall(texts[i] or "")
        left = [w for j, w in enumerate(words) if j not in gone.get(at, ())]
        if words and not left:
            assert i not in kept["repeated_passages"]
        else:
            r = kept["repeated_passages"][i]
            assert WORD.findall(r.text or "") == left and (at in gone or r.text == texts[i])
            assert r.n_chars == len(r.text or "")
    assert len(gone) == 2

    ids = sorted(kept["repeated_passages"])
    judged = contaminated([kept["repeated_passages"][i].text for i in ids], items)
    assert set(kept["benchmark_free"]) == {i for i, (*_, bad) in zip(ids, judged, strict=True) if not bad}
    assert len(ids) - len(kept["benchmark_free"]) == 3

    sizes, taken = Counter(), Counter()
    for r in kept["benchmark_free"].values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in kept["mix"].values():
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 2 for s, t in filled(sizes).items())


def test_run_gives_the_last_stage(spark, folder):
    place, *_ = folder
    rows = corpus_pipeline.run(spark, place)
    assert {"doc_id", "text", "size", "source_size", "target", "taken"} <= set(rows.columns) and rows.count() > 90


def test_accepted_rows_are_those_scored_one_and_are_scored_in_arrow_arrays(spark):
    from lictor.llm import quality_classifier

    docs = spark.createDataFrame([(i, " ".join(["good clear words"] * 9) if i % 2 else "junk junk junk") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    expected = {r["doc_id"] for r in quality_classifier.scored(docs, labels).where("predicted = 1").collect()}
    found = quality_classifier.accepted(docs, labels)
    assert {r["doc_id"] for r in found.collect()} == expected != set()
    assert not hasattr(quality_classifier, "pd")


def test_workers_of_the_pipeline_load_no_pandas():
    """A worker that loads pandas holds 45 MB more for the rest of the session."""
    seen = "import sys, corpus_pipeline; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", seen], capture_output=True, text=True, check=True).stdout.strip() == "False"
