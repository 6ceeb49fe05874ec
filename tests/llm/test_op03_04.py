import re
import zlib
from collections import Counter

import numpy as np

from corvane.llm.op03_quality_rules import kept_rows, quality_rules
from corvane.llm.op04_sharding import invert, permute, shard_rows

EDGE = [(1, ""), (2, None), (3, "word"), (4, "a b c\na b c\n\nx"), (5, "x y " * 30), (6, "ünï #*$ <p> | " * 3 + "ok"), (7, "one two three four five six seven eight " * 2), (7, "w " * 100_000), (None, " \t\n"), (8, "\n".join(f"line {i} of some text that is all its own {i * i}" for i in range(40)))]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_base_measures_equal_brute_force(docs):
    got = sorted((tuple(r)[:8] for r in quality_rules(docs(EDGE)).collect()), key=str)
    want = []
    for i, t in EDGE:
        b = brute(t)
        want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert [g[:7] for g in got] == sorted(want, key=str)
    assert all(not (g[6] and g[7]) for g in got)


def test_clean_text_stays_and_repetition_goes(docs):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 4000, 600)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:60] * 8)), (3, " ".join(words[:300]) + "\n" + "\n".join(["same short line"] * 120))]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(docs(rows)).collect()}
    assert got == {1: True, 2: False, 3: False}
    kept = kept_rows(docs(rows))
    assert kept.columns == docs(rows).columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_rules_empty_table(docs):
    assert quality_rules(docs([])).count() == 0 and kept_rows(docs([])).count() == 0


def test_permutation_and_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = permute(np.arange(n), n, 42)
        assert sorted(p.tolist()) == list(range(n)) and (invert(p, n, 42) == np.arange(n)).all()
    assert (permute(np.arange(1000), 1000, 1) != permute(np.arange(1000), 1000, 2)).any()


def test_shards_rows_law(docs):
    rows = [*EDGE, *((i, f"text {i % 7}") for i in range(100, 400)), *((500, "same") for _ in range(150))]
    got = shard_rows(docs(rows), shards=40).collect()
    assert len(got) == len(rows)
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) - min(count[s] for s in range(40)) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = shard_rows(docs(rows[::-1]).repartition(3), shards=40).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rs)
    assert key(again) == key(got)


def test_shards_fewer_rows_than_shards_and_none(docs):
    assert {r["slot"] for r in shard_rows(docs([(1, "a"), (2, "b")])).collect()} == {0}
    assert shard_rows(docs([])).count() == 0


def test_equal_rows_are_dealt_over_partitions(spark):
    from pyspark.sql import functions as F

    from corvane.llm.op04_sharding import numbered

    out, total = numbered(spark.range(4000).select(F.lit(1).alias("k")), ["k"], 8)
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert total == 4000 and sorted(r["row_number"] for r in got) == list(range(4000))
    assert len({r["p"] for r in got}) > 4


def verdict(text, rules):
    """kept by counting, without hashes."""
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, size, total = len(words), [len(w) for w in words], sum(map(len, words))

    def covered(k):
        grams = [tuple(words[i : i + k]) for i in range(n - k + 1)]
        many = {g for g, c in Counter(grams).items() if c > 1}
        return {j for i, g in enumerate(grams) if g in many for j in range(i, i + k)}

    if n < 20 or 100 * len(covered(8)) > 30 * n:
        return False
    for k, limit in rules.dup_limit.items():
        if sum(size[i] for i in covered(k)) / total > limit:
            return False
    for k, limit in rules.top_limit.items():
        counts = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        most = max(counts.values())
        if most > 1 and most * max(sum(map(len, g)) for g, c in counts.items() if c == most) / total > limit:
            return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    return not (len(lines) >= 4 and len(again) > rules.line_share * len(lines)) and chars / total <= rules.line_char_share


def test_verdicts_equal_plain_counting(spark):
    import random

    from corvane.llm.op03_quality_rules import RepetitionRules, kept_rows

    rng, rows = random.Random(12), []
    for i in range(400):
        vocab = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(rng.choice([6, 30, 200, 2000]))]
        lines = [" ".join(rng.choices(vocab, k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(6)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(lines))
        rows.append((i, rng.choice(["\n", " ", "\n\n", "\r\n"]).join(lines)))
    rows += [(1000, None), (1001, ""), (1002, "same " * 40)]
    rules = RepetitionRules()
    want = {i: verdict(x, rules) for i, x in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(df).collect()}
    assert got == want and 40 < sum(want.values()) < 360
    assert sorted(r["doc_id"] for r in kept_rows(df).collect()) == sorted(i for i, k in want.items() if k)
