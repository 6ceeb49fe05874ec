import random
import re

import corpus_pipeline
import pytest

from corvane.llm.components import connected_components
from corvane.llm.op07_jaccard_join import JaccardRules, jaccard_components, links, nodes, one_of_each

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Class, number of shingles and linked classes of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                if a != b:
                    linked.add(frozenset((frozenset(a), frozenset(b))))
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))], linked


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 6, 12, 60, 150]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, len(w) // 40, len(w) // 25, len(w) // 12])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: len(w) * 9 // 10]
            rows.append(" ".join(w) if rng.random() < 0.7 else "  ".join(w).upper())
    hub = rng.choices(vocab, k=120)
    for i in range(40):  # copies of a hub, each with an edit elsewhere
        w = list(hub)
        for _ in range(2):
            w[rng.randrange(120)] = f"new{i}{rng.randrange(9)}"
        rows.append(" ".join(w))
    shared = " ".join(rng.choices(vocab, k=30))  # a passage of many texts
    rows += [shared + " " + " ".join(rng.choices(vocab, k=rng.choice([4, 20, 60]))) for _ in range(20)]
    rows += [None, "", "  ", "one", "One", "one two", " ".join(f"long{i}" for i in range(30_000))]
    rng.shuffle(rows)
    out = [(i * 3 % 251, t) for i, t in enumerate(rows)]
    return [*out, (None, rows[0]), (None, "only null"), out[5], out[5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(docs, tmp_path, seed):
    rows = corpus(seed)
    want, _ = brute(rows)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs(rows, tmp_path / "d")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_link_is_found(docs, tmp_path):
    rows = corpus(3)
    _, want = brute(rows)
    df, rules = docs(rows, tmp_path / "d"), JaccardRules()
    members = nodes(df, rules).collect()
    text = {}
    for r, (k, t) in zip(sorted(members, key=lambda r: r["place"]), df.select("doc_id", "text").collect()):
        assert r["doc_id"] == k
        text[r["node"]] = frozenset(shingles(t))
    got = {frozenset((text[r["a"]], text[r["b"]])) for r in links(df, nodes(df, rules), rules, every=True)[0].collect()}
    assert got == want


def test_one_of_each_keeps_columns_and_rows_without_words(docs, tmp_path):
    rows = [(4, "a b c d e f"), (2, "A b c d  e f"), (2, "a b c d e f"), (9, None), (9, ""), (7, "own text of its own kind")]
    df = docs(rows, tmp_path / "d")
    out = one_of_each(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"], (r["text"] or "").lower().split()[:1]) for r in out.collect())
    assert got == [(2, ["a"]), (7, ["own"]), (9, []), (9, [])]


def test_one_of_each_with_null_and_repeated_ids(docs, tmp_path):
    own = [" ".join(f"{k}{i}" for i in range(20)) for k in "abcdef"]
    rows = [(None, own[0]), (None, own[1]), (None, own[1].upper()), (5, own[2]), (5, own[3]), (5, own[3]), (None, own[4]), (8, own[5]), (6, own[5])]
    out = [(r["doc_id"], r["text"]) for r in one_of_each(docs(rows, tmp_path / "d")).collect()]
    assert sorted((k, t.lower()) for k, t in out if k) == [(5, own[2]), (5, own[3]), (6, own[5])]
    assert sorted(t.lower() for k, t in out if not k) == [own[0], own[1], own[4]]


def test_join_empty_table(docs, tmp_path):
    assert jaccard_components(docs([], tmp_path / "d")).count() == 0
    assert one_of_each(docs([(1, None)], tmp_path / "e")).count() == 1


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: ". ".join(" ".join(f"{rng.choice('klmnop')}{rng.randrange(3000)}" for _ in range(9)) for _ in range(n)) + "."
    item = " ".join(f"q{i}" for i in range(30))
    passage = prose(8)
    a, b, c = prose(12), prose(12), prose(12)
    rows = [(1, a), (2, a), (3, a + " one more"), (4, b + " " + passage), (5, c + " " + passage), (6, prose(10) + " " + item), (7, "same words again " * 60), (8, "short"), (9, None), (10, prose(400))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        df = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r["doc_id"]: r for r in df.collect()})
    assert [sorted(x) for x in kept] == [[1, 2, 3, 4, 5, 6, 10], [1, 4, 5, 6, 10], [1, 4, 5, 6, 10], [1, 4, 5, 10]]
    assert kept[2][4]["text"] == rows[3][1] and kept[2][5]["text"].startswith(c) and len(kept[2][5]["text"]) < len(c) + 60
    assert kept[2][5]["n_chars"] == len(kept[2][5]["text"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {1, 4, 5, 10}
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_pipeline_on_empty_repeated_and_clashing_rows(spark, tmp_path):
    rng = random.Random(7)
    prose = lambda n: ". ".join(" ".join(f"{rng.choice('klmnop')}{rng.randrange(3000)}" for _ in range(9)) for _ in range(n)) + "."
    a, b = prose(12), prose(12)
    rows = [(1, a), (1, a), (None, b), (None, b.upper()), (4, None), (5, ""), (6, prose(9))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, place long, kept_spans string, row_number int"
    for name, own, items, want in (("full", rows, [(1, "some item that is nowhere")], [None, 1, 6]), ("empty", [], [], []), ("none", rows, [], [None, 1, 6])):
        d = tmp_path / name
        spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "s", 4) for i, t in own], kind).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        df = spark.read.parquet(str(d / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, df, str(d))
            assert out.columns == df.columns
            out.write.parquet(str(d / f"s{k}"))
            df = spark.read.parquet(str(d / f"s{k}"))
        assert sorted((r["doc_id"] for r in df.collect()), key=str) == sorted(want, key=str)
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(d)).collect()} == set(want)
