"""Benchmark decontamination by greedy string tiling.

Benchmark items are blocks of a bounded number of words, each sent to all tasks; every document
is held against every block, so the work on a document depends on no other document and nothing
is shuffled but the found pairs of several blocks. A task holds one block at a time: where the
benchmark has several, documents are read once for each and the narrow results are joined by the
rows' places. In a task, hashes of each run of ``min_match``
words of an item are joined to those of the documents. The item's words inside seeds that stand
in the document bound its coverage; of the items that can reach the threshold or beat the
coverage found, the most covered first, Karp-Rabin hashes of falling lengths find the longest matches that don't overlap a marked
one; these are marked as tiles until none of ``min_match`` words is left. The share of an item's
words inside tiles tells contamination, in whatever order its passages stand. Words are compared
with case folded and without outer punctuation; words of punctuation alone stay as they are.

Defined results: null and empty texts match nothing, null and empty items aren't held against
anything; items with fewer words than ``min_match`` are matched whole; equal items and equal
documents each get their own result; an empty benchmark or document table gives no match.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import fixed_splits
from .op06_toxicity import _PUNCT
from .tokens import spread


@dataclass(frozen=True)
class TilingRules:
    min_match: int = 5
    #: A document is contaminated when tiles cover so much of an item.
    coverage: float = 0.6
    #: Words of benchmark items in one broadcast block (24 bytes each).
    block_words: int = 1_000_000


MATCHES = "doc_id long, item_id long, tiles int, tile_words int, item_words int, coverage double, doc_start long, doc_end long"


def _fold(word: bytes) -> str:
    """A word with letters beyond A-Z: case folded, outer punctuation of any script off."""
    t = word.decode("utf-8", "replace").casefold()
    a, b = 0, len(t)
    while a < b and unicodedata.category(t[b - 1])[0] in "PS":
        b -= 1
    while a < b and unicodedata.category(t[a])[0] in "PS":
        a += 1
    return t[a:b] or t


def word_hashes(w: tc.Words) -> np.ndarray:
    """Hashes of folded words; w must be split in lower case."""
    s, e = w.start.copy(), w.end.copy()
    while True:
        tail = (e > s + 1) & _PUNCT[w.data[e - 1]]
        e -= tail
        head = (e > s + 1) & _PUNCT[w.data[s]]
        s += head
        if not (tail.any() or head.any()):
            break
    bare = (e == s + 1) & _PUNCT[w.data[s]]
    h = w.span_hash(np.where(bare, w.start, s), np.where(bare, w.end, e))
    high = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data > 127, out=high[1:])
    odd = np.flatnonzero(high[w.end] > high[w.start])
    if len(odd):
        raw, number = w.data.tobytes(), {}
        at = [number.setdefault(raw[a:b], len(number)) for a, b in zip(w.start[odd].tolist(), w.end[odd].tolist())]
        data, offs = tc.strings(pa.array([_fold(x) for x in number], pa.large_string()))
        one = tc.split(data, offs)
        h[odd] = one.span_hash(one.offs[:-1], one.offs[1:])[at]
    return h


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, doc place, words) of two sequences of word hashes.

    The search length starts at the longest run of the item that can match and falls to ``least``;
    at each length all places whose windows agree and hold no marked word are marked, the
    leftmost of the item first, each with the leftmost free place of the document.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    tiles, item_free, doc_free = [], np.ones(len(item), bool), np.ones(len(doc), bool)
    # only stretches of the document that share a seed can hold a tile
    seeds = tc.rolling(item, least)
    near = np.flatnonzero(np.isin(tc.rolling(doc, least), seeds))
    if not len(near):
        return []
    length = _longest(item, doc, near, least)
    while length >= least:
        ih, dh = tc.rolling(item, length), tc.rolling(doc, length)
        starts = near[near <= len(doc) - length]
        places = defaultdict(list)
        wanted = set(ih.tolist())
        for j in starts[::-1].tolist():
            if (v := int(dh[j])) in wanted:
                places[v].append(j)
        found = False
        for i in range(len(ih)):
            own = places.get(int(ih[i]))
            if not own or not item_free[i : i + length].all():
                continue
            for j in reversed(own):
                if doc_free[j : j + length].all() and (item[i : i + length] == doc[j : j + length]).all():
                    item_free[i : i + length] = doc_free[j : j + length] = False
                    tiles.append((i, j, length))
                    found = True
                    break
        if item_free.sum() < least:
            break
        rest = _longest(np.where(item_free, item, np.uint64(1)), np.where(doc_free, doc, np.uint64(2)), near[doc_free[near]], least)
        length = min(length - (not found), rest)
    return tiles


def _longest(item: np.ndarray, doc: np.ndarray, near: np.ndarray, least: int) -> int:
    """Words of the longest run that both share, by bisection over Karp-Rabin windows."""
    lo, hi = least - 1, len(item)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        h = tc.rolling(doc, mid)
        h = h[near[near < len(h)]]
        if len(h) and np.isin(h, tc.rolling(item, mid)).any():
            lo = mid
        else:
            hi = mid - 1
    return lo


class Block:
    """Seeds of a block of items, for joining them to the windows of documents."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items = items
        seeds: dict[int, list] = defaultdict(list)
        for n, (_, w) in enumerate(items):
            k = min(least, len(w))
            seeds[k].append((tc.rolling(w, k), n))
        self.by_length = {}
        for k, found in seeds.items():
            h = np.concatenate([x for x, _ in found])
            owner = np.repeat([n for _, n in found], [len(x) for x, _ in found])
            place = np.concatenate([np.arange(len(x)) for x, _ in found])
            order = np.argsort(h, kind="stable")
            h = h[order]
            quick = np.zeros(1 << 20, bool)
            quick[h & np.uint64(0xFFFFF)] = True
            self.by_length[k] = h, owner[order], place[order], quick

    def candidates(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, words of the item inside shared seeds); h: word hashes of all documents in turn.

        Documents in turn, of each the most covered items first.
        """
        found = []
        for k, (seeds, owner, place, quick) in self.by_length.items():
            g = tc.rolling(h, k)
            at = np.flatnonzero(quick[g & np.uint64(0xFFFFF)])
            lo, hi = np.searchsorted(seeds, g[at], "left"), np.searchsorted(seeds, g[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            ok = (hi > lo) & (at + k <= first[doc + 1])
            hits = np.unique(np.column_stack([doc[ok], lo[ok], hi[ok]]), axis=0)  # each seed once a document
            total = np.cumsum(hits[:, 2] - hits[:, 1])
            cut = 0
            while cut < len(hits):  # whole documents, some million of their seeds' places at once
                end = int(np.searchsorted(total, (total[cut - 1] if cut else 0) + (1 << 21), "right"))
                end = int(np.searchsorted(hits[:, 0], hits[max(cut, end - 1), 0], "right"))
                d, a, b = hits[cut:end].T
                own, at = np.repeat(d, b - a), spread(a, b - a)
                n, p = owner[at], place[at]
                order = np.lexsort((p, n, own))
                own, n, p = own[order], n[order], p[order]
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (n[1:] != n[:-1])])
                wide = np.full(len(p), k)
                wide[:-1] = np.where(new[1:], k, np.minimum(k, p[1:] - p[:-1]))
                at = np.flatnonzero(new)
                found.append(np.column_stack([own[at], n[at], np.add.reduceat(wide, at)]))
                cut = end
        if found:
            rows = np.concatenate(found)
            yield from map(tuple, rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))].tolist())


def _blocks(items: DataFrame, rules: TilingRules, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one block on the driver at a time."""
    rows = items.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    block, words = [], 0
    for k, t in rows.toLocalIterator():
        n = len(t) // 2 + 1
        if block and words + n > rules.block_words:
            yield block
            block, words = [], 0
        block.append((k, t))
        words += n
    if block:
        yield block


def _prepared(block: list, least: int) -> Block:
    texts = pa.array([t for _, t in block], pa.string())
    items = []
    for a, b, w in tc.docs_words(texts, lower=True):
        h = word_hashes(w)
        items += [(block[a + d][0], h[w.first[d] : w.first[d + 1]]) for d in range(b - a)]
    return Block([x for x in items if len(x[1])], least)


def _matches(col: pa.Array, block: Block, rules: TilingRules, every: bool = False) -> Iterator[tuple]:
    """(row, item id, tiles, tile words, item words, first and last byte of tiles in the row's text).

    Of every item with a tile, or of those that contaminate the row or cover more of an item than those before.
    """
    for a, _, w in tc.docs_words(col, lower=True):
        h = word_hashes(w)
        best: dict[int, float] = {}
        for d, n, bound in block.candidates(h, w.first):
            item_id, item = block.items[n]
            if not every and bound < rules.coverage * len(item) and bound <= best.get(d, 0.0) * len(item):
                continue
            lo, hi = w.first[d], w.first[d + 1]
            tiles = tile(item, h[lo:hi], rules.min_match)
            if tiles:
                begin = min(int(w.start[lo + j]) for _, j, _ in tiles) - int(w.offs[d])
                end = max(int(w.end[lo + j + k - 1]) for _, j, k in tiles) - int(w.offs[d])
                best[d] = max(best.get(d, 0.0), sum(k for _, _, k in tiles) / len(item))
                yield a + d, item_id, len(tiles), sum(k for _, _, k in tiles), len(item), begin, end


def matches(docs: DataFrame, items: DataFrame, rules: TilingRules | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that share a tile."""
    rules = rules or TilingRules()
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for rows in _blocks(items, rules, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            block = _prepared(shared.value, rules.min_match)
            for batch in batches:
                found = list(_matches(batch.column(1), block, rules, every=True))
                if found:
                    r, item, n, words, size, lo, hi = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(words, pa.int32()), pa.array(size, pa.int32()), pa.array([a / b for a, b in zip(words, size)], pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                        names=[x.split()[0] for x in MATCHES.split(", ")],
                    )

        part = source.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def _verdict(source: DataFrame, rows: list, rules: TilingRules) -> DataFrame:
    """source (any columns, the last one the text) with coverage and item_ids by one block, without the text."""
    shared = source.sparkSession.sparkContext.broadcast(rows)
    names = [*source.columns[:-1], "__coverage", "__item_ids"]

    def run(batches):
        block = _prepared(shared.value, rules.min_match)
        for batch in batches:
            cover, ids = [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for r, item, _, words, size, _, _ in _matches(batch.column(batch.num_columns - 1), block, rules):
                cover[r] = max(cover[r], words / size)
                if words >= rules.coverage * size:
                    ids[r].append(item)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cover, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], names=names)

    schema = T.StructType([*source.schema.fields[:-1], T.StructField(names[-2], T.DoubleType()), T.StructField(names[-1], T.ArrayType(T.LongType()))])
    return source.mapInArrow(run, schema)


def _judged(docs: DataFrame, items: DataFrame, rules: TilingRules, keep: list[str], text: str, item_key: str, item_text: str) -> DataFrame:
    """The columns keep of docs with __coverage and __item_ids."""
    blocks = _blocks(items, rules, item_key, item_text)
    first, more = next(blocks, None), next(blocks, None)
    body = F.col(f"`{text}`").cast("string").alias("__text")
    cols = [F.col(f"`{c}`") for c in keep]
    if first is None:
        return docs.select(*cols, F.lit(0.0).alias("__coverage"), F.array().cast("array<bigint>").alias("__item_ids"))
    if more is None:
        return _verdict(docs.select(*cols, body), first, rules)
    fixed_splits(docs.sparkSession)
    source, found = docs.select(F.monotonically_increasing_id().alias("__place"), body), None
    for rows in chain([first, more], blocks):
        part = _verdict(source, rows, rules).where("__coverage > 0")
        found = part if found is None else found.union(part)
    found = found.groupBy("__place").agg(F.max("__coverage").alias("__coverage"), F.flatten(F.collect_list("__item_ids")).alias("__item_ids"))
    out = docs.select(*cols, F.monotonically_increasing_id().alias("__place")).join(found, "__place", "left")
    return out.select(*cols, F.coalesce("__coverage", F.lit(0.0)).alias("__coverage"), F.coalesce("__item_ids", F.array().cast("array<bigint>")).alias("__item_ids"))


def clean_rows(docs: DataFrame, items: DataFrame, rules: TilingRules | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, all columns as they are."""
    out = _judged(docs, items, rules or TilingRules(), docs.columns, text, item_key, item_text)
    return out.where(F.size("__item_ids") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def verdicts(docs: DataFrame, items: DataFrame, rules: TilingRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the items that contaminate it and the greatest coverage."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = _judged(docs, items, rules or TilingRules(), ["doc_id"], "text", "item_id", "text")
    return out.select("doc_id", (F.size("__item_ids") > 0).alias("contaminated"), F.array_sort("__item_ids").alias("item_ids"), F.col("__coverage").alias("coverage"))
