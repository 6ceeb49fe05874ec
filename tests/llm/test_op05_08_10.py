import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvane.llm.op05_substring_dedup import dedup_passages
from corvane.llm.op08_decontamination import TilingRules, clean_rows, matches, tile, verdicts
from corvane.llm.op10_packing import Bm25Shard, PackingPlan, pack
from corvane.llm.tokens import WordIds, default_path

rng = random.Random(11)
words = lambda n, tag="": " ".join(f"{tag}{rng.choice('abcdefg')}{rng.randrange(900)}" for _ in range(n))


# --- op 5


def test_passage_inside_other_lines_goes_but_from_the_first(docs, tmp_path):
    p = ". ".join(words(9, "p") for _ in range(8)) + ","
    rows = [(3, words(30) + " " + p + " " + words(30)), (1, words(20) + "\n" + p.upper() + "\n" + words(20)), (2, words(10) + ". " + p + "\n" + words(40)), (4, words(50)), (5, None), (6, "")]
    out = {r["doc_id"]: r for r in dedup_passages(docs(rows, tmp_path / "d")).collect()}
    text = dict(rows)
    assert out[1]["text"] == text[1] and out[4]["text"] == text[4] and out[5]["text"] is None and out[6]["text"] == ""
    for i in (2, 3):
        left = out[i]["text"]
        assert sum(w in left.split() for w in p.split()) < 0.3 * len(p.split())
        assert left == "".join(text[i][s["start"] : s["end"]] for s in out[i]["kept_spans"])
    assert set(text[4].split()) == set(out[4]["text"].split())


def test_whole_lines_short_lines_and_repeated_rows(docs, tmp_path):
    line = "This line stands in many of the texts."
    rows = [(1, f"{line}\nown one here.\n{line}\nshort."), (2, f"ünï own two.\n{line}\nshort."), (7, "same row, of a text with some words in it."), (7, "same row, of a text with some words in it.")]
    out = [(r["doc_id"], r["text"]) for r in dedup_passages(docs(rows, tmp_path / "d")).collect()]
    assert sorted(out) == [(1, f"{line}\nown one here.\nshort."), (2, "ünï own two.\nshort."), (7, rows[2][1]), (7, rows[3][1])]


def test_same_text_under_other_id_goes_whole(docs, tmp_path):
    t = words(40) + ".\n" + words(30)
    big = words(60_000)
    rows = [(2, t), (1, t), (None, "tail " + t), (9, big), (10, big)]
    out = {r["doc_id"]: r["text"] for r in dedup_passages(docs(rows, tmp_path / "d"), spans=None).collect()}
    assert out[9] == big and out[10] == "" and out[2] == "" and out[None] == rows[2][1]
    df = docs(rows, tmp_path / "e")
    assert dedup_passages(df, spans=None).schema == df.schema
    assert dedup_passages(docs([], tmp_path / "f")).count() == 0


@pytest.mark.parametrize("most, sep", [(1, "\n"), (1, "!! "), (2, "\n"), (2, ", ")])
def test_passages_of_short_units_go_wherever_they_begin(docs, tmp_path, most, sep):
    def short(n, tag):
        return [words(rng.randrange(1, most + 1), tag) for _ in range(n)]

    p = short(60, "p")
    rows = [(1, sep.join(short(9, "a") + p + short(7, "b"))), (2, sep.join(short(4, "c") + p + short(5, "d"))), (3, sep.join(p)), (4, words(12, "e") + ". " + sep.join(p)), (5, sep.join(short(40, "f")))]
    out = {r["doc_id"]: r for r in dedup_passages(docs(rows, tmp_path / "d")).collect()}
    text, own = dict(rows), set(sep.join(p).split()) | {w.rstrip("!,") for w in sep.join(p).split()}
    assert out[1]["text"] == text[1] and out[5]["text"] == text[5] and out[3]["text"].split() == []
    for i in (2, 4):
        left = out[i]["text"].split()
        assert sum(w.rstrip("!,") in own for w in left) <= 2 * most and {w for w in text[i].split() if w.rstrip("!,") not in own} <= set(left)
        assert out[i]["text"] == "".join(text[i][s["start"] : s["end"]] for s in out[i]["kept_spans"])


def test_short_ends_of_lines_and_repeats_within_a_text(docs, tmp_path):
    rows = [(1, "first of all.\nthis is a line, yes.\nand one"), (2, "here we begin.\nthis is a line, yes.\nwith other words"), (3, "no, " * 20 + "that is all")]
    out = {r["doc_id"]: r["text"] for r in dedup_passages(docs(rows, tmp_path / "d"), spans=None).collect()}
    assert out == {1: rows[0][1], 2: "here we begin.\nwith other words", 3: "no, no, no, that is all"}


def test_lines_that_came_earlier_go(docs, tmp_path):
    r = random.Random(21)
    pool = [" ".join(f"{r.choice('abcdefg')}{r.randrange(5000)}" for _ in range(r.randrange(10, 30))) for _ in range(150)]
    texts = []
    for i in range(80):
        own = []
        for _ in range(r.randrange(0, 9)):
            x = r.choice(pool)
            own.append(x if r.random() < 0.6 else x.upper() if r.random() < 0.5 else f'"{x}".')
        texts.append((i * 37 % 101, "\n".join(own)))
    plain = lambda x: x.lower().strip('".')
    seen, want = set(), {}
    for i, x in sorted(texts):
        keep = []
        for line in x.split("\n"):
            if plain(line) not in seen or not line:
                keep.append(line)
            seen.add(plain(line))
        want[i] = [x for x in keep if x]
    got = {d["doc_id"]: [x for x in d["text"].split("\n") if x.strip()] for d in dedup_passages(docs(texts, tmp_path / "d")).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len(x.split("\n")) for _, x in texts) - 50


def test_columns_of_the_operators_names_give_way(spark):
    p = words(40)
    df = spark.createDataFrame([(1, p, "x", 2, 3), (2, p, "y", 2, 3)], "doc_id long, text string, Kept_spans string, __dups int, __doc_key int")
    got = dedup_passages(df)
    assert got.columns == ["doc_id", "text", "__dups", "__doc_key", "kept_spans"]
    assert {r["doc_id"]: (r["text"], r["__dups"], [tuple(s) for s in r["kept_spans"]]) for r in got.collect()} == {1: (p, 2, [(0, len(p))]), 2: ("", 2, [])}
    assert dedup_passages(df, spans=None).columns == df.columns


# --- op 8


def brute_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places; total of marked words."""
    fa, fb, total = [True] * len(a), [True] * len(b), 0
    while True:
        best, at = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best and k >= least:
                    at.append((i, j))
        if best < least or not at:
            return total
        for i, j in at:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [False] * best
                total += best


def test_tiling_equals_brute_force():
    for n in range(300):
        alphabet = 3 if n % 2 else 6
        a = np.array([rng.randrange(10, 10 + alphabet) for _ in range(rng.randrange(1, 24))], np.uint64)
        b = np.array([rng.randrange(10, 10 + alphabet) for _ in range(rng.randrange(1, 60))], np.uint64)
        least = rng.choice([1, 2, 3])
        got = tile(a, b, least)
        for i, j, k in got:
            assert (a[i : i + k] == b[j : j + k]).all()
        assert sum(k for *_, k in got) == brute_tiles(a.tolist(), b.tolist(), min(least, len(a)))


def test_reordered_item_is_found_and_clean_text_stays(spark, docs):
    item = words(40)
    w = item.split()
    turned = " ".join([*w[20:30], *w[30:40], words(3), *w[:10], *w[10:20]])
    rows = [(1, words(100) + " " + item + " " + words(50)), (2, words(30) + "\n" + turned), (3, words(200)), (4, " ".join(w[:8]) + words(40)), (5, None), (6, ""), (7, "short one"), (7, "short one"), (None, item), (8, words(50_000) + item)]
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, ""), (4, None), (5, item)], "item_id long, text string")
    got = verdicts(docs(rows), items).collect()
    assert {(r["doc_id"], tuple(r["item_ids"])) for r in got} == {(1, (1, 5)), (2, (1, 5)), (3, ()), (4, ()), (5, ()), (6, ()), (7, (2,)), (None, (1, 5)), (8, (1, 5))}
    assert len(got) == len(rows)
    blocks = TilingRules(block_words=1)  # every item in its own block
    assert sorted(map(str, verdicts(docs(rows), items, blocks).collect())) == sorted(map(str, got))
    kept = clean_rows(docs(rows), items, blocks)
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert {(r["doc_id"], r["item_id"]) for r in matches(docs(rows), items).where("coverage >= 0.6").collect()} >= {(1, 1), (2, 5), (7, 2)}


def test_empty_benchmark_and_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert verdicts(docs([(1, "a")]), none).first()["contaminated"] is False
    assert matches(docs([(1, "a")]), none).count() == 0
    assert verdicts(docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_case_and_outer_punctuation_do_not_hide_an_item(spark, docs):
    item = "Où l'ÉTÉ “commence”, the River (wide) bends: a + b = c -- or so; it's Said"
    twin = "où L'été commence the river WIDE bends a + b = c -- or so ... it's «said»"
    plain = words(30)
    rows = [(1, words(20) + " " + item.upper()), (2, words(20) + "\n" + " ".join(f'"{w}",' for w in plain.split()) + words(9)), (3, twin), (4, words(60)), (5, "a - b = c")]
    items = spark.createDataFrame([(1, item), (2, plain.upper()), (3, "a + b = c")], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in verdicts(docs(rows), items).collect()}
    assert got == {1: [1, 3], 2: [2], 3: [1, 3], 4: [], 5: []}
    assert sorted(r["doc_id"] for r in clean_rows(docs(rows), items).collect()) == [4, 5]
    span = matches(docs(rows), items).where("doc_id = 1 and item_id = 1").first()
    assert rows[0][1].encode()[span["doc_start"] : span["doc_end"]].decode() == item.upper() and span["coverage"] == 1.0


def test_coverage_is_the_greatest_of_all_items(spark, docs):
    r = random.Random(9)
    common = "one two three four five"
    items = [(i, " ".join([common, *(f"v{r.randrange(40)}" for _ in range(r.randrange(1, 25))), common])) for i in range(60)]
    rows = []
    for i in range(40):
        w = [f"v{r.randrange(40)}" for _ in range(60)]
        for _ in range(r.randrange(4)):
            src = r.choice(items)[1].split()
            a = r.randrange(len(src))
            w[r.randrange(60) : r.randrange(60)] = src[a : a + r.randrange(4, 20)]
        rows.append((i, " ".join([*w, common])))
    df = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for m in matches(docs(rows), df).collect():
        best, ids = want.setdefault(m["doc_id"], [0.0, []])
        want[m["doc_id"]][0] = max(best, m["coverage"])
        ids += [m["item_id"]] * (m["coverage"] >= 0.6)
    got = {v["doc_id"]: [v["coverage"], v["item_ids"]] for v in verdicts(docs(rows), df).collect()}
    assert got == {i: [want.get(i, [0.0, []])[0], sorted(want.get(i, [0.0, []])[1])] for i, _ in rows}


# --- op 10


ODD = ["", None, "Hello, World! It's 2024's  best", "ÀÉÎ õü ß straße", "日本語 テスト", "a\x1cb", "İstanbul ΣΑΣ", "<|endoftext|> x", "é é", "x" * 5000, "don't 'll 've'd", "\x85next   nb sep", "emoji 🙂🙂 ok", "½ ² 12ab", "ŉ ĲĳĿ", "a​b ﻿c"]


def test_ids_equal_the_tokenizers():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    texts = [*ODD, *(words(200) for _ in range(20)), " ".join("".join(rng.choice("abcÄéñ.,'!?-1ß×÷ÿÀÞE\u0301\u00a0œ日") for _ in range(rng.randrange(1, 14))) for _ in range(3000))]
    for x, ids in zip(texts, WordIds.of(default_path()).encode(texts)):
        assert ids.tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_words_beyond_the_room_kept(monkeypatch):
    from corvane.llm import tokens

    monkeypatch.setattr(tokens, "_MOST_KEPT", 50)
    coder = WordIds(default_path())
    texts = [" ".join(f"w{rng.randrange(4000)}x" for _ in range(n)) for n in (10, 30, 2000, 5, 60)]
    for _ in range(2):
        for x in texts:
            assert coder.encode([x])[0].tolist() == coder.tokenizer.encode(x, add_special_tokens=False).ids


def test_neighbours_are_those_of_bm25_over_all_tokens():
    import math

    r = random.Random(3)
    docs = [np.array([r.randrange(2, 60) for _ in range(r.randrange(1, 40))], "<u4") for _ in range(150)] + [np.zeros(0, "<u4")]
    docs += docs[:5]  # ties
    index, mean = Bm25Shard(docs, PackingPlan()), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in range(60)}
    for seed in range(0, len(docs), 7):
        used = np.array([r.random() < 0.3 for _ in docs])
        want = []
        for k, d in enumerate(docs):
            score = 0.0
            for t in set(docs[seed].tolist()):
                tf = int((d == t).sum())
                if tf and df[t] > 1:
                    score += math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            if score and not used[k]:
                want.append((k, score))
        got = list(index.neighbours(seed, used))
        assert sorted(k for k, _ in got) == [k for k, _ in want]
        exact = dict(want)
        assert all(abs(exact[k] - s) < 1e-4 for k, s in got) and all(a >= b for (_, a), (_, b) in zip(got, got[1:]))
        assert all(x < y for (x, a), (y, b) in zip(got, got[1:]) if a == b)


@pytest.mark.parametrize("shard", [300, 1 << 20])
def test_pieces_cover_every_id_once_with_little_padding(docs, shard):
    rows = [*enumerate(ODD), (500, words(5000)), *((i, words(rng.randrange(1, 400))) for i in range(1000, 1060)), (7000, "same text"), (7000, "same text"), (None, "no id")]
    plan = PackingPlan(shard_tokens=shard)
    got = pack(docs(rows).coalesce(2), plan).collect()
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    spans, sequences = {}, {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, x in rows:
        if i == 7000:
            continue
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(spans[i], key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len(spans[7000]) >= 2
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_neighbours_share_a_window(docs):
    topic = {k: [f"{k}{i}" for i in range(30)] for k in ("alpha", "beta", "gamma", "delta")}
    rows = [(100 * k + i, " ".join(rng.choices(topic[name], k=100))) for i in range(8) for k, name in enumerate(topic)]
    got = pack(docs(rows).coalesce(1), PackingPlan(window=1024)).collect()
    same = [r["doc_id"] // 100 == r["seed_doc"] // 100 for r in got if r["bm25"] > 0]
    assert len(same) > 8 and sum(same) / len(same) > 0.6  # by chance about 0.25


def test_pack_empty_table(docs):
    assert pack(docs([])).count() == 0
