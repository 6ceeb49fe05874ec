import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from corvane.llm.op01_warc import assemble, pages_through_archive, parse, read_records

PAGES = "page_id long, url string, html string, digest string, n int"


def test_round_trip_and_roles(spark, tmp_path):
    body = "<p>über</p>\r\n\r\nWARC/1.1\r\n" * 3
    rows = [(1, "http://a", body), (5, "http://b c\r\nX: y", body), (3, None, body), (2, "u", None), (9, "u", ""), (7, "u", "x" * 200_000), (8, "u", "\x00€"), (None, "u", "no id"), (4, "u", "tie"), (4, "u", "tie")]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)
    pages.write.mode("overwrite").parquet(str(tmp_path / "p"))
    got = pages_through_archive(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, _, h in rows:
        raw = (h or "").encode()
        for r in by[i]:
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["digest_holds"]
        assert all(r["url"] == u for i, u, h in rows for r in by[i] if len(by[i]) == 1)
    one = {i: (by[i][0]["record_type"], by[i][0]["refers_to"]) for i in (1, 3, 5, 2, 9, 7, 8, None)}
    assert one == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("revisit", 9), 9: ("response", None), 7: ("response", None), 8: ("response", None), None: ("response", None)}
    assert sorted((r["record_type"], r["refers_to"]) for r in by[4]) == [("response", None), ("revisit", 4)] or {r["record_type"] for r in by[4]} == {"response", "revisit"}


def test_small_payloads_stay_responses(spark, tmp_path):
    spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in pages_through_archive(spark.read.parquet(str(tmp_path / "p")), min_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert pages_through_archive(spark.read.parquet(str(tmp_path / "p"))).count() == 0


def record(kind, rid, block, **fields):
    head = "".join(f"WARC-{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n".encode()


def test_concurrent_to_on_either_side_and_over_a_request(spark, tmp_path):
    rows = [
        record("warcinfo", "<i>", "software: x"),
        record("response", "<r1>", "HTTP/1.1 404 No\r\n\r\nbody", Concurrent_To="<q1>"),
        record("request", "<q1>", "GET / HTTP/1.1\r\n\r\n"),
        record("metadata", "<m1>", "a: b", Concurrent_To="<q1>"),
        record("metadata", "<m2>", "alone: 1", Concurrent_To="<gone>"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows))  # a member for each record
    (tmp_path / "w" / "b.warc").write_bytes(b"".join(rows[:2]) + rows[2][:-12])  # plain, the same again, cut short
    records = read_records(spark, str(tmp_path / "w"), payloads=True)
    assert records.count() == 8 and records.where("truncated").count() == 1
    got = {r["capture_id"]: r for r in assemble(records).collect()}
    r = got["<r1>"]
    assert r["response"]["status"] == 404 and bytes(r["response"]["payload"]) == b"body"
    assert [x["record_id"] for x in r["requests"]] == ["<q1>"] and [x["record_id"] for x in r["metadata"]] == ["<m1>"]
    assert got["<m2>"]["response"] is None and set(got) == {"<r1>", "<m2>"}


def test_parse_folded_fields_and_garbage():
    raw = b"junk\r\n" + b"WARC/1.0\r\nWARC-Type: metadata\r\nX-A: one\r\n two\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    ((fields, block, cut),) = list(parse(raw))
    assert fields["x-a"] == ["one two"] and block == b"abc" and not cut


def test_bad_lengths_flag_the_record_and_reading_goes_on():
    for bad in ("abc", "-5", "", "9" * 30):
        raw = f"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: {bad}\r\n\r\nlost: 1\r\n\r\n".encode() + record("metadata", "<m>", "a: b")
        (_, block, cut), (fields, after, whole) = list(parse(raw))
        assert block == b"" and cut and fields["warc-record-id"] == ["<m>"] and after == b"a: b" and not whole


def test_records_without_an_id_and_different_ones_of_one_id(spark, tmp_path):
    bare = [record("response", "x", f"HTTP/1.1 200 OK\r\n\r\n{i}").replace(b"WARC-Record-ID: x\r\n", b"") for i in (1, 2, 2)]
    rows = [*bare, record("response", "<r>", "HTTP/1.1 200 OK\r\n\r\none"), record("response", "<r>", "HTTP/1.1 200 OK\r\n\r\ntwo"), record("response", "<r>", "HTTP/1.1 200 OK\r\n\r\ntwo"), record("request", "<q>", "GET / HTTP/1.1\r\n\r\n", Concurrent_To="<r>")]
    (tmp_path / "a.warc").write_bytes(b"".join(rows))
    got = [(r["response"]["record_id"], bytes(r["response"]["payload"]), len(r["requests"] or [])) for r in assemble(read_records(spark, str(tmp_path), payloads=True)).collect()]
    assert sorted(got, key=str) == sorted([(None, b"1", 0), (None, b"2", 0), (None, b"2", 0), ("<r>", b"one", 1), ("<r>", b"two", 1)], key=str)


def test_assembly_equals_a_walk_over_the_records(spark, tmp_path):
    import random

    rng, raw, want = random.Random(8), [], {}
    for i in range(300):
        heads = rng.random() < 0.9
        kind = rng.choice(["response", "revisit", "resource"])
        asks = [f"<q{i}.{k}>" for k in range(rng.randrange(3))]
        about = [f"<m{i}.{k}>" for k in range(rng.randrange(3))]
        if heads:
            raw.append(record(kind, f"<r{i}>", f"HTTP/1.1 200 OK\r\n\r\n{i}", **({"Concurrent_To": asks[0]} if asks else {})))
            want[f"<r{i}>"] = (sorted(asks), sorted(about))
        else:
            want |= {q: ([q], []) for q in asks} | {m: ([], [m]) for m in about}
        raw += [record("request", q, "GET / HTTP/1.1\r\n\r\n", Concurrent_To=f"<r{i}>") for q in asks]
        raw += [record("metadata", m, "a: b", Concurrent_To=rng.choice(asks) if asks and heads else f"<r{i}>") for m in about]
    rng.shuffle(raw)
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(raw[k::3])))
    got = {r["capture_id"]: tuple(sorted(x["record_id"] for x in r[c] or []) for c in ("requests", "metadata")) for r in assemble(read_records(spark, str(tmp_path))).collect()}
    assert got == {k: tuple(map(list, v)) for k, v in want.items()}
