import random

from corvane.llm.op09_token_counts import PieceCounter, TokenTree, apply_edits, build_trees, default_path, mask_edits


def test_random_edits_equal_whole_count():
    counter = PieceCounter.of(default_path())
    rng = random.Random(5)
    signs = ["a", "b", " ", "  ", "\n", "'", "s", "'re", "1", "23", ".", "!!", "é", "word", "\t", "ß", "日本"]
    for _ in range(150):
        text = "".join(rng.choices(signs, k=rng.randrange(0, 400)))
        tree = TokenTree.of(text, counter)
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + rng.choice([0, 1, 5, 300])))
            new = "".join(rng.choices(signs, k=rng.choice([0, 1, 3, 2000]) if rng.random() < 0.1 else rng.randrange(4)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            pieces = counter.split(text)
            assert tree.text == text
            assert sum(tree.lens, []) == list(map(len, pieces))
            assert tree.tokens == len(counter.coder.encode_ordinary(text))


def test_edits_touch_only_their_region():
    counter = PieceCounter.of(default_path())
    tree = TokenTree.of("some plain words in a row " * 2000, counter)
    tree.edit(20_000, 20_004, "other")
    assert tree.recounted < 12


def test_query_rows(spark):
    rows = [(1, "write to me.you@mail.example.com or +49 171 5551234 now"), (2, None), (3, ""), (3, ""), (None, "plain"), (5, "x" * 70_000 + " a@b.example.org")]
    out = {(r["doc_id"], r["tokens_after"], r["n_edits"]) for r in apply_edits(build_trees(spark.createDataFrame(rows, "doc_id long, text string")), mask_edits).collect()}
    coder = PieceCounter.of(default_path()).coder
    masked = "write to <EMAIL> or <NUMBER> now"
    assert out == {(1, len(coder.encode_ordinary(masked)), 2), (2, 0, 0), (3, 0, 0), (None, len(coder.encode_ordinary("plain")), 0), (5, len(coder.encode_ordinary("x" * 70_000 + " <EMAIL>")), 1)}


def test_edit_column_and_second_round(spark):
    docs = spark.createDataFrame([(1, "one two three", [(4, 7, "2")])], "doc_id long, text string, e array<struct<start: int, end: int, text: string>>")
    once = apply_edits(build_trees(docs), "e")
    row = once.first()
    assert row["text"] == "one 2 three" and row["n_edits"] == 1
    again = apply_edits(once.withColumnRenamed("tokens_after", "n_tokens").select("doc_id", "text", "n_tokens", "tree"), lambda t: [(0, 3, "un")]).first()
    assert again["text"] == "un 2 three" and again["tokens_after"] == len(PieceCounter.of(default_path()).coder.encode_ordinary("un 2 three"))


def test_empty_table(spark):
    assert apply_edits(build_trees(spark.createDataFrame([], "doc_id long, text string")), mask_edits).count() == 0


def test_columns_of_the_operators_names_give_way(spark):
    df = spark.createDataFrame([(1, "mail me at a@b.org now", 7, "t", 3, 4)], "doc_id long, text string, n_tokens int, Tree string, n_pieces int, recounted_pieces int")
    trees = build_trees(df)
    assert trees.columns == ["doc_id", "text", "recounted_pieces", "n_tokens", "n_pieces", "tree"]
    counter = PieceCounter.of(default_path())
    r = apply_edits(trees, mask_edits).first()
    assert (r["tokens_before"], r["tokens_after"]) == tuple(len(counter.coder.encode_ordinary(t)) for t in ("mail me at a@b.org now", r["text"]))
    assert "a@b.org" not in r["text"]
