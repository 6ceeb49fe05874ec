import random
import zlib

from pyspark.sql import functions as F

from corvane.llm import op02_quality_classifier as q
from corvane.llm import op06_toxicity as t

LABELS = "doc_id long, quality int, toxic int, text string"
W = [f"{a}{b}{c}" for a in "btdkm" for b in "aeiou" for c in ("n", "rs", "l", "")]


def corpus(n=420, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(W, k=rng.randint(15, 150))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + rng.choice(["###", " |", "%%"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "zomp" + rng.choice("aeiou") + "x", "Vile,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic), "clash"))
    return rows, labels


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_held_out(spark, docs):
    rows, labels = corpus()
    more = [(9001, None), (9002, ""), (9003, "x " * 50_000), (None, "no id"), (9004, "same"), (9004, "same")]
    got = q.quality(docs(rows + more), spark.createDataFrame([*labels, (1, None, None, ""), (None, 1, 1, "")], LABELS)).collect()
    assert len(got) == len(rows) + len(more)
    want = {i: y for i, y, _, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*want, 9001, 9002, 9003, 9004] if fold(i, 3) == 1}
    right = [r["predicted"] == want[r["doc_id"]] for r in held if r["doc_id"] in want]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_labels_do_not_matter(spark, docs):
    rows, labels = corpus(200)
    turned = [(i, 1 - a if fold(i, 3) == 1 else a, 1 - b if fold(i, 4) == 2 else b, "") for i, a, b, _ in labels]
    for f in (q.quality, t.toxicity):
        a, b = ({r["doc_id"]: r["score"] for r in f(docs(rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
        assert a == b


def test_toxicity_held_out_and_passages(spark, docs):
    rows, labels = corpus(600)
    more = [(9001, None), (9002, ""), (9003, "ban " * 50_000), (9004, "grobian"), (9004, "grobian")]
    got = t.toxicity(docs(rows + more), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(more)
    want, texts = {i: y for i, _, y, _ in labels}, dict(rows)
    right = [r["predicted"] == want[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in want]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    for r in got:
        for p in r["passages"]:
            part = texts.get(r["doc_id"], "grobian").encode()[p["start"] : p["end"]].decode().lower()
            assert any(x in part for x in ("grobian", "zomp", "vile"))
    low = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (9001, 9002, 9003)}
    assert max(low.values()) < 0.3


def test_no_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in q.quality(docs([(1, "a b")]), none).collect()] == [0.5]
    assert [r["predicted"] for r in t.toxicity(docs([(1, "a b")]), none).collect()] == [0]
    labels = spark.createDataFrame(corpus(30)[1], LABELS)
    assert q.quality(docs([]), labels).count() == 0 and t.toxicity(docs([]), labels).count() == 0


def brute_segments(scores):
    """All maximal segments by their definition: repeatedly the best segment, then both sides of it."""
    def best(lo, hi):
        top, at = 0, None
        for i in range(lo, hi):
            s = 0
            for j in range(i, hi):
                s += scores[j]
                if s > top + 1e-12 or (at and abs(s - top) < 1e-12 and j + 1 - i < at[1] - at[0]):
                    top, at = s, (i, j + 1)
        return [] if at is None else [*best(lo, at[0]), at, *best(at[1], hi)]

    return best(0, len(scores))


def test_maximal_segments_equal_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        scores = [rng.choice([-1, 1]) * rng.random() * 5 for _ in range(rng.randrange(1, 30))]
        got = t.maximal_segments([(s, i, i + 1) for i, s in enumerate(scores)])
        assert [(a, b) for _, a, b in got] == brute_segments(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for s, a, b in got)
