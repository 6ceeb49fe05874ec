"""Repeated passages by hashing the units of lines.

Lines are cut into units at line breaks and after words that end a clause or sentence, so that
a passage set into the middle of another line still has units of its own. A unit's words, in
lower case (A-Z) and without outer punctuation, give its digest. A unit shorter than
``unit_words`` is looked up with the units after it until there are so many words, and with
those before it where that is something else; so every word of a text lies in something looked
up, wherever a passage begins and ends. Digests are grouped globally:
of all places of a unit the earliest in rank (document id, then place) is the one that stays.
In each document consecutive repeated units form runs; runs of ``least_words`` words, and whole
lines of ``least_line_words``, are removed. What stays keeps its offsets in the original text.

Shuffles carry narrow rows of digests; hot digests are aggregated before they are shuffled, the
repeated ones are stored, and the joins back are plain equi-joins that adaptive execution can split. Texts are shuffled once,
to meet their removals.

Defined results: null and empty texts stay as they are; rows with equal id and equal text count
as one document and get equal results; a null id ranks first; short units that aren't part of
something repeated go only together with removed units on both sides; of a passage that repeats
within itself the first place stays whole; texts of fewer than ``unit_words`` words stay; a text
may become empty, its row stays. All columns of docs pass through, but one that has the name of
the added column gives way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import saved, without
from .op06_toxicity import _PUNCT

UNIT = "digest long, doc_id long, doc_key long, unit int"
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".,;:!?", np.uint8)] = True


@dataclass(frozen=True)
class UnitRules:
    unit_words: int = 3
    least_words: int = 10
    least_line_words: int = 5


@dataclass
class Units:
    """Units of a slice of documents: words first[u]:first[u+1] make unit u; of document doc[u]."""

    first: np.ndarray
    doc: np.ndarray
    digest: np.ndarray
    number: np.ndarray  # within the document
    line_start: np.ndarray  # whether the unit begins a line
    sums: np.ndarray  # running sums of the words' hashes

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each unit the end of the least words from it on, and the start of those up to it.

        -1 where the document has fewer; the second also where the first gives the same units.
        """
        end = np.searchsorted(self.first, self.first[:-1] + least, "left")
        end[end > np.searchsorted(self.doc, self.doc, "right")] = -1
        start = np.searchsorted(self.first, self.first[1:] - least, "right") - 1
        start[start < np.searchsorted(self.doc, self.doc, "left")] = -1
        start[end[start] == np.arange(1, len(start) + 1)] = -1
        return end, start

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Digests of the words of units a to b."""
        return _digest(self.sums, self.first[a], self.first[b])


def _digest(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tc.mix((sums[b] - sums[a]) * tc.powers(tc._QI, len(sums))[a] + (b - a).astype(np.uint64))


def units(w: tc.Words) -> Units:
    """w must be split in lower case."""
    n = len(w.start)
    if not n:
        z = np.zeros(0, np.int64)
        return Units(np.zeros(1, np.int64), z, np.zeros(0, np.uint64), z, np.zeros(0, bool), np.zeros(1, np.uint64))
    breaks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=breaks[1:])
    doc = np.searchsorted(w.first, np.arange(n), "right") - 1
    new_line = np.ones(n, bool)
    new_line[1:] = (breaks[w.start[1:]] > breaks[w.end[:-1]]) | (doc[1:] != doc[:-1])
    begins = new_line.copy()
    begins[1:] |= _ENDS[w.data[w.end[:-1] - 1]]
    s, e = w.start.copy(), w.end.copy()
    for _ in range(4):
        e -= (e > s + 1) & _PUNCT[w.data[e - 1]]
        s += (e > s + 1) & _PUNCT[w.data[s]]
    h = w.span_hash(s, e)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * tc.powers(tc._Q, n), out=sums[1:])
    first = np.append(np.flatnonzero(begins), n)
    a, b = first[:-1], first[1:]
    digest = _digest(sums, a, b)
    own = doc[a]
    number = np.arange(len(a)) - np.searchsorted(own, own, "left")
    return Units(first, own, digest, number, new_line[a], sums)


def unit_rows(docs: DataFrame, rules: UnitRules, key: str, text: str) -> DataFrame:
    """The looked-up units of all documents; unit: twice its number, and 1 if looked up with those before."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("doc_key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a, b, w in tc.docs_words(batch.column(2), lower=True):
                u = units(w)
                end, start = u.windows(rules.unit_words)
                on, back = np.flatnonzero(end >= 0), np.flatnonzero(start >= 0)
                digest = np.concatenate([u.digests(on, end[on]), u.digests(start[back], back + 1)])
                rows = pa.array(a + np.concatenate([u.doc[on], u.doc[back]]))
                unit = np.concatenate([2 * u.number[on], 2 * u.number[back] + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(unit, pa.int32())], names=["digest", "doc_id", "doc_key", "unit"]
                )

    return source.mapInArrow(run, UNIT)


def _marked(found: np.ndarray, lo: int, hi: int, end: np.ndarray, start: np.ndarray, rules: UnitRules) -> np.ndarray:
    """Which of the units lo..hi lie in something repeated; found: looked-up units and how far the first place is."""
    place, near = np.divmod(found, rules.unit_words)
    number, back = np.divmod(place, 2)
    at = lo + number[number < hi - lo]
    near, back = near[number < hi - lo], back[number < hi - lo] > 0
    a, b = np.where(back, start[at], at), np.where(back, at + 1, end[at])
    a = np.where(near > 0, np.maximum(a, end[at - near]), a)
    ok = (a >= lo) & (b > a)
    steps = np.zeros(hi - lo + 1, np.int64)
    np.add.at(steps, a[ok] - lo, 1)
    np.add.at(steps, b[ok] - lo, -1)
    return np.cumsum(steps[:-1]) > 0


def _runs(u: Units, lo: int, hi: int, dup: np.ndarray, rules: UnitRules) -> Iterator[tuple[int, int]]:
    """Ranges of units lo..hi that go; dup marks repeated ones."""
    size = np.diff(u.first[lo : hi + 1])
    bridge = (size < rules.unit_words) & ~dup
    at, n = 0, hi - lo
    marked = np.flatnonzero(dup)
    i = 0
    while i < len(marked):
        a = marked[i]
        b = a + 1
        j = i + 1
        while j < len(marked) and bridge[b : marked[j]].all():
            b = marked[j] + 1
            j += 1
        i = j
        # short units at a run's edge stay, except that the rest of a line's end may go with it
        if size[a:b].sum() >= rules.least_words:
            yield lo + a, lo + b
            continue
        at = a
        while at < b:  # or whole lines of it
            if u.line_start[lo + at]:
                to = at + 1
                while to < n and not u.line_start[lo + to]:
                    to += 1
                if to <= b and size[at:to].sum() >= rules.least_line_words:
                    yield lo + at, lo + to
                at = to
            else:
                at += 1


def removed_spans(w: tc.Words, u: Units, d: int, lo: int, hi: int, dup: np.ndarray, rules: UnitRules) -> list[tuple[int, int]]:
    """Byte ranges of document d (units lo..hi) that go, from the start of the slice's bytes."""
    out = []
    for a, b in _runs(u, lo, hi, dup, rules):
        s, past = int(w.start[u.first[a]]), int(w.end[u.first[b] - 1])
        nxt = int(w.start[u.first[b]]) if b < hi else int(w.offs[d + 1])
        whole = u.line_start[a] or not (w.data[past:nxt] == 10).any()
        out.append((s, nxt if whole else past))
    return out


def dedup_passages(docs: DataFrame, rules: UnitRules | None = None, key: str = "doc_id", text: str = "text", spans: str | None = "kept_spans") -> DataFrame:
    """docs with repeated passages cut from the text column.

    spans: name of an added column with the kept stretches, as (start, end) in characters of the
    original text; None adds none.
    """
    rules = rules or UnitRules()
    docs = without(docs, spans) if spans else docs
    rows = unit_rows(docs, rules, key, text)
    place = F.struct("doc_id", "doc_key", "unit")
    # stored, so that the join meets two plain shuffles and a hot digest's rows can be split
    repeated = saved(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("best")).where("n > 1"))
    later = rows.join(repeated.select("digest", "best"), "digest").where(~place.eqNullSafe(F.col("best")))
    mark, dups = f"key_{uuid.uuid4().hex}", f"dups_{uuid.uuid4().hex}"  # no column of docs
    # places that reach into the first one keep out of it
    apart = F.col("unit") - F.col("best.unit")
    near = (F.col("doc_key") == F.col("best.doc_key")) & (apart % 2 == 0) & (F.col("best.unit") % 2 == 0) & (apart < 2 * rules.unit_words)
    found = F.col("unit") * rules.unit_words + F.when(near, (apart / 2).cast("int")).otherwise(0)
    cuts = later.groupBy(F.col("doc_key").alias(mark)).agg(F.collect_set(found).alias(dups))
    joined = docs.withColumn(mark, F.xxhash64(F.col(key), F.col(text))).join(cuts, mark, "left").select(*(F.col(f"`{c}`") for c in docs.columns), dups)
    at = docs.columns.index(text)
    kept_type = "array<struct<start: long, end: long>>"
    schema = docs.limit(0).withColumn(spans, F.lit(None).cast(kept_type)).schema if spans else docs.schema

    def run(batches):
        for batch in batches:
            marks = batch.column(batch.num_columns - 1)
            col = batch.column(at)
            new, kept = [None] * batch.num_rows, [None] * batch.num_rows
            raw, offs = tc.strings(col)
            for a, b, w in tc.docs_words(col, lower=True):
                u = None
                for d in range(b - a):
                    r = a + d
                    if not col[r].is_valid:
                        continue
                    body = raw[offs[r] : offs[r + 1]]
                    if not marks[r].is_valid:
                        if spans:
                            kept[r] = [(0, int(((body & 0xC0) != 0x80).sum()))] if len(body) else []
                        new[r] = body.tobytes()
                        continue
                    if u is None:
                        u = units(w)
                        end, start = u.windows(rules.unit_words)
                    lo, hi = np.searchsorted(u.doc, [d, d + 1])
                    dup = _marked(marks[r].values.to_numpy(), lo, hi, end, start, rules)
                    base = int(w.offs[d])
                    parts, last, chars, own = [], 0, 0, []
                    char_at = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)]) if spans else None
                    for s, e in [*removed_spans(w, u, d, lo, hi, dup, rules), (int(w.offs[d + 1]), 0)]:
                        s, e = s - base, e - base
                        if s > last:
                            parts.append(body[last:s].tobytes())
                            if spans:
                                own.append((int(char_at[last]), int(char_at[s])))
                        last = e
                    new[r], kept[r] = b"".join(parts), own
            arrays = [batch.column(i) for i in range(len(docs_names))]
            arrays[at] = pa.array(new, pa.binary()).cast(pa.string())
            if spans:
                made = [[{"start": s, "end": e} for s, e in k] if k is not None else None for k in kept]
                arrays.append(pa.array(made, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*docs_names, *([spans] if spans else [])])

    docs_names = docs.columns
    return joined.mapInArrow(run, schema)
