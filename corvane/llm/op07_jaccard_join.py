"""Jaccard join of word shingles with filters under several global token orders.

Tokens are 64-bit hashes of a text's distinct shingles. Texts of equal sets are one node. Two
nodes whose sets have a Jaccard similarity of t or more must pass all of these filters:

1. Hash order: of the first ``|x| - ceil(t |x|) + l`` tokens of each in the order of their hashes
   they share l, with l growing with the set. A node of which too few of these tokens occur in
   any other node drops out; only the others' whole sets are looked at from here on.
2. Frequency order: they share one of the ``|x| - ceil(t |x|) + 1`` rarest tokens of each, counted
   over the nodes that are left. Tokens of passages that many texts share come last, so they
   don't make candidates. This proposes candidate pairs.
3. A second hash order, after the tokens that no other node has: their plain prefixes meet.
4. The parity bits of their shared tokens differ in no more places than sets so similar can.

Each node's prefixes and bits make one narrow row, its profile. Candidates are intersected with
all filters on profiles; texts are read again only of nodes with a candidate that passes them
all, and there whole sets are intersected, so links are exact (to hashes).

Components need not visit every candidate: first every node is tested against the one candidate
that shares most rare tokens with it (hubs and neighbours in size only, so that a group of
thousands of near copies gives a linear number of pairs); then again between the components so
found. At last all candidates that still lie in different components are tested, so none is
lost: nodes are laid in blocks, related ones side by side, and the profiles of each pair of
blocks with any candidate are compared in one task, which names the nodes that need their texts.
:func:`links` with ``every`` tests all candidates so, and gives all links.

Tokens travel as sorted blobs by token range, at most ``bucket_tokens`` a bucket on average.
Defined results: texts with fewer words than a shingle have their word sequence as the one
token; null and empty texts have no tokens and link with nothing; rows of equal texts or ids are
members of one node each; a null id never names a component if another member has an id; an
empty table gives an empty result. docs must give the same rows whenever it is read again (a
stored table); a text that isn't the node's when it is read again fails the job. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import fixed_splits, forget_table, saved, written
from .components import connected_components


@dataclass(frozen=True)
class JaccardRules:
    words: int = 5
    per_cent: int = 80
    #: Tokens of the first filter beyond the plain prefix, as a divisor of the set's size.
    extra: int = 5
    bucket_tokens: int = 1_000_000
    linear_rounds: int = 2
    #: A block of nodes that a task compares with another one: so many, or of so many tokens.
    block_nodes: int = 512
    block_tokens: int = 500_000


def least_overlap(n, rules: JaccardRules):
    """Tokens that a set of n shares at least with any set similar to it; also its partner's least size."""
    return (n * rules.per_cent + 99) // 100


def shared_prefix(n, rules: JaccardRules):
    """l of the first filter for a set of n tokens."""
    return 1 + n // rules.extra


def token_sets(col: pa.Array, rules: JaccardRules) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct tokens) of every row of a text column."""
    for a, b, w in tc.docs_words(col, lower=True):
        h = w.hashes()
        g = tc.rolling(h, rules.words)
        for d in range(b - a):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            if hi - lo >= rules.words:
                yield a + d, np.unique(g[lo : hi - rules.words + 1])
            elif hi > lo:
                yield a + d, tc.rolling(h[lo:hi], hi - lo)
            else:
                yield a + d, np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    s = tc.mix(np.array([len(tokens), tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(tc.mix(tokens + np.uint64(77)))], np.uint64))
    return int(tc.mix((s * np.array([3, 5, 7], np.uint64)).sum(keepdims=True)).view(np.int64)[0])


def nodes(docs: DataFrame, rules: JaccardRules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, place (of the row in docs), n, node of every row; node is null for an empty set."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for r, t in token_sets(batch.column(2), rules):
                n[r] = len(t)
                if len(t):
                    node[r] = node_of(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(node, pa.int64())], names=["doc_id", "place", "n", "node"])

    return source.mapInArrow(run, "doc_id long, place long, n long, node long")


# --- blobs of tokens by bucket

BLOB = "bucket int, tok binary, loc binary, node binary, n binary, extra binary"


def _packed(tok: np.ndarray) -> bytes:
    """Sorted 48-bit values: as differences of 32 bits where they fit."""
    d = np.diff(tok)
    if len(tok) > 1 and int(d.max()) < 1 << 32:
        return b"d" + tok[:1].tobytes() + d.astype("<u4").tobytes()
    return b"r" + tok.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"r":
        return np.frombuffer(raw, np.uint64, offset=1)
    out = np.empty((len(raw) - 9) // 4 + 1, np.uint64)
    out[0] = np.frombuffer(raw, np.uint64, 1, 1)[0]
    out[1:] = np.frombuffer(raw, "<u4", offset=9)
    return np.cumsum(out)


def _blobs(tok: np.ndarray, own: np.ndarray, bucket: np.ndarray, node: np.ndarray, n: np.ndarray, extra: np.ndarray | None, per_token: bool) -> pa.RecordBatch | None:
    """A row for each bucket. own: place in node and n of each token; extra: by token or by node."""
    if not len(tok):
        return None
    order = np.lexsort((tok, bucket))
    tok, own, bucket = tok[order], own[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows: list[list] = [[] for _ in range(6)]
    for a, b in zip(cut, cut[1:]):
        used, loc = np.unique(own[a:b], return_inverse=True)
        rows[0].append(int(bucket[a]))
        rows[1].append(_packed(tok[a:b]))
        rows[2].append(loc.astype("<u2" if len(used) <= 65536 else "<u4").tobytes())
        rows[3].append(node[used].tobytes())
        rows[4].append(n[used].astype("<u4").tobytes())
        rows[5].append(b"" if extra is None else extra[order[a:b]].tobytes() if per_token else extra[used].tobytes())
    types = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=[x.split()[0] for x in BLOB.split(", ")])


def _gathered(g: pd.DataFrame, kind, per_token: bool) -> tuple[np.ndarray, ...]:
    """tok, own, node, n, extra of a group of blob rows; own points into node and n (and extra, if by node)."""
    tc.trim()
    tok, own, node, n, extra, at = [], [], [], [], [], 0
    for t, l, d, m, x in zip(g["tok"], g["loc"], g["node"], g["n"], g["extra"]):
        t, d = _unpacked(t), np.frombuffer(d, np.int64)
        tok.append(t)
        own.append(np.frombuffer(l, "<u2" if len(d) <= 65536 else "<u4").astype(np.int64) + at)
        node.append(d)
        n.append(np.frombuffer(m, "<u4"))
        extra.append(np.frombuffer(x, kind))
        at += len(d)
    tok, own, node, n, extra = map(np.concatenate, (tok, own, node, n, extra))
    name, first, inverse = np.unique(node, return_index=True, return_inverse=True)
    return tok, inverse[own], name, n[first].astype(np.int64), extra if per_token or not len(extra) else extra[first]


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that their tokens stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            yield batch.slice(at, 2000)


def _prefix_blobs(docs: DataFrame, rules: JaccardRules, buckets: int, text: str) -> DataFrame:
    """Filter 1: the first tokens in hash order of every node, by token bucket."""

    def run(batches):
        for batch in _parts(batches):
            seen, tok, n = {}, [], []
            for _, t in token_sets(batch.column(0), rules):
                if not len(t) or (name := node_of(t)) in seen:
                    continue
                seen[name] = len(seen)
                size = len(t)
                take = size - least_overlap(size, rules) + shared_prefix(size, rules)
                tok.append(t[:take] >> np.uint64(16))
                n.append(size)
            if tok:
                own = np.repeat(np.arange(len(tok)), [len(t) for t in tok])
                tok = np.concatenate(tok)
                yield _blobs(tok, own, (tok % np.uint64(buckets)).astype(np.int64), np.array(list(seen), np.int64), np.array(n), None, False)

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, BLOB)


def _shared_tokens(blobs: DataFrame, buckets: int) -> DataFrame:
    """Of each token bucket, the tokens that two or more nodes have, by node bucket, with the nodes' number."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tok, own, node, n, _ = _gathered(g, "u1", False)
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])])
        tok, own = tok[new], own[new]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        df = np.repeat(np.diff(np.append(start, len(tok))), np.diff(np.append(start, len(tok))))
        many = df > 1
        out = _blobs(tok[many], own[many], (node[own[many]] % buckets), node, n, np.minimum(df[many], 65535).astype("<u2"), True)
        return out.to_pandas() if out is not None else pd.DataFrame(columns=[x.split()[0] for x in BLOB.split(", ")])

    return blobs.groupBy("bucket").applyInPandas(run, BLOB)


def _enough_shared(shared: DataFrame, rules: JaccardRules) -> DataFrame:
    """Nodes of which enough tokens of the first filter occur elsewhere."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        _, own, node, n, _ = _gathered(g, "<u2", True)
        return pd.DataFrame({"node": node[np.bincount(own, minlength=len(node)) >= shared_prefix(least_overlap(n, rules), rules)]})

    return shared.groupBy("bucket").applyInPandas(run, "node long")


def _whole_blobs(texts: DataFrame, rules: JaccardRules, buckets: int) -> DataFrame:
    """All tokens of every node left, by token bucket."""

    def run(batches):
        for batch in _parts(batches):
            name, tok, n = [], [], []
            for r, t in token_sets(batch.column(1), rules):
                if not len(t) or node_of(t) != batch.column(0)[r].as_py():
                    raise RuntimeError("docs gave other rows when it was read again; store it first")
                name.append(batch.column(0)[r].as_py())
                tok.append(t >> np.uint64(16))
                n.append(len(t))
            if tok:
                own = np.repeat(np.arange(len(tok)), n)
                tok = np.concatenate(tok)
                yield _blobs(tok, own, (tok % np.uint64(buckets)).astype(np.int64), np.array(name, np.int64), np.array(n), None, False)

    return texts.select("node", "text").mapInArrow(run, BLOB)


def _second(tok: np.ndarray) -> np.ndarray:
    """Places of tokens in the second hash order."""
    return (tc.mix(tok ^ np.uint64(0xABCD1234567)) >> np.uint64(32)).astype(np.uint32)


def parity_width(n):
    """Bits of a set of n tokens: a power of two of at least 8 n."""
    return 1 << np.maximum(6, np.ceil(np.log2(8 * np.maximum(n, 1))).astype(np.int64))


def parity_bits(tok: np.ndarray, width: int) -> np.ndarray:
    """Which places tokens fall on an odd number of times, as 64-bit words."""
    at = tc.mix(tok + np.uint64(0x5DEECE66D)) & np.uint64(width - 1)
    odd = np.bincount(at.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (a row for each set) as those of a smaller width."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _profiles(shared: DataFrame, rules: JaccardRules) -> DataFrame:
    """Filters 2 to 4: node, n, c (its shared tokens) and profile of nodes that have a prefix.

    tok: those of its rarest tokens that others have; second: the prefix under the second order;
    bits: parity of its shared tokens. A token that no other node has comes before any other in
    both orders, so those take the prefixes first.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tok, own, node, n, df = _gathered(g, "<u2", True)
        order = np.lexsort((tok, df, own))
        tok, own = tok[order], own[order]
        c = np.bincount(own, minlength=len(node))
        keep = n - least_overlap(n, rules) + 1 - (n - c)
        first = np.cumsum(c) - c
        good = np.flatnonzero(keep > 0)
        width = parity_width(n)
        rows = []
        for i in good.tolist():
            t, k = tok[first[i] : first[i] + c[i]], int(keep[i])
            s = _second(t)
            rows.append((t[:k].tobytes(), (np.partition(s, k - 1)[:k] if k < len(s) else s).tobytes(), parity_bits(t, int(width[i])).tobytes()))
        return pd.DataFrame(rows, columns=["tok", "second", "bits"]).assign(node=node[good], n=n[good], c=c[good])[["node", "n", "c", "tok", "second", "bits"]]

    return shared.groupBy("bucket").applyInPandas(run, PROFILE)


PROFILE = "node long, n long, c long, tok binary, second binary, bits binary"


PAIRS = "a long, b long, ca long, cb long, hits long"


def _spread(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Prefix tokens by token bucket. prefixes: node, n, tok and two numbers that go along."""

    def run(batches):
        for batch in batches:
            t = [np.sort(np.frombuffer(x, np.uint64)) for x in batch.column(2).to_pylist()]
            own = np.repeat(np.arange(len(t)), [len(x) for x in t])
            tok = np.concatenate(t) if t else np.zeros(0, np.uint64)
            extra = np.column_stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()]).astype(np.int64)
            out = _blobs(tok, own, (tok % np.uint64(buckets)).astype(np.int64), batch.column(0).to_numpy(), batch.column(1).to_numpy(), extra, False)
            if out is not None:
                yield out

    return prefixes.mapInArrow(run, BLOB)


def _candidates(prefixes: DataFrame, rules: JaccardRules, buckets: int) -> DataFrame:
    """Pairs of nodes of different components ca and cb, with the number of rare tokens shared there.

    Of each token only its hub with every node, and neighbours in size: the pairs grow with the
    prefixes, not with their square. The hub is the node of which most tokens occur elsewhere.
    """

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        g = g.copy()
        tok, own, node, n, extra = _gathered_pairs(g)
        c, comp = extra[:, 0], extra[:, 1]
        centre = np.argsort(np.argsort(-(c / n), kind="stable"), kind="stable")
        order = np.lexsort((node[own], n[own], tok))
        tok, own = tok[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(start, len(tok)))
        same = tok[1:] == tok[:-1]
        best = np.minimum.reduceat(centre[own], start) if len(own) else np.zeros(0, np.int64)
        i = np.concatenate([own[:-1][same], np.repeat(np.argsort(centre)[best], size)])
        j = np.concatenate([own[1:][same], own])
        ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= least_overlap(np.maximum(n[i], n[j]), rules))
        i, j = i[ok], j[ok]
        code, hits = np.unique(np.minimum(i, j) * len(node) + np.maximum(i, j), return_counts=True)
        x, y = code // max(len(node), 1), code % max(len(node), 1)
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        return pd.DataFrame({"a": node[x], "b": node[y], "ca": comp[x], "cb": comp[y], "hits": hits})

    blobs = _spread(prefixes.select("node", "n", "tok", "c", "component"), buckets)
    return blobs.groupBy("bucket").applyInPandas(pairs, PAIRS)


def _block_pairs(placed: DataFrame, buckets: int) -> DataFrame:
    """Pairs of blocks (i <= j) that hold nodes of different components with a rare token in common."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tok, own, node, n, extra = _gathered_pairs(g.copy())
        block, comp = extra[own, 0], extra[own, 1]
        order = np.lexsort((comp, block, tok))
        tok, block, comp = tok[order], block[order], comp[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (block[1:] != block[:-1])])
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(tok)) - 1
        tok, block, low, high = tok[start], block[start], comp[start], comp[last]  # a row for each token and block
        at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        mixed = np.minimum.reduceat(low, at) != np.maximum.reduceat(high, at) if len(at) else np.zeros(0, bool)
        found: set[tuple[int, int]] = set()
        for lo, hi in zip(at[mixed].tolist(), np.append(at[1:], len(tok))[mixed].tolist()):
            for k in range(lo, hi):  # a token's blocks are sorted
                apart = (low[k:hi] != low[k]) | (high[k:hi] != low[k]) | (high[k] != low[k])
                found.update((int(block[k]), y) for y in block[k:hi][apart].tolist())
        return pd.DataFrame(sorted(found), columns=["i", "j"])

    blobs = _spread(placed.select("node", "n", "tok", "block", "component"), buckets)
    return blobs.groupBy("bucket").applyInPandas(run, "i long, j long").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every one of b, by incidence products."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])
    shared = np.intersect1d(flat_a, flat_b)
    if not len(shared):
        return out.astype(np.int64)
    sides = []
    for sets, flat in ((a, flat_a), (b, flat_b)):
        own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], own[hit][order]))
    for lo in range(0, len(shared), 4096):
        parts = []
        for (at, own), n in zip(sides, (len(a), len(b))):
            x, y = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[own[x:y], at[x:y] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def close_enough(ca, cb, na, nb, apart, rules: JaccardRules):
    """Filter 4: whether sets of na and nb tokens, ca and cb of them shared, can be similar if so many parities differ."""
    return (100 + rules.per_cent) * ((ca + cb - apart) // 2) >= rules.per_cent * (na + nb)


def _parities_apart(bits: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of different parities of each pair of nodes x, y."""
    words = np.array([len(b) // 8 for b in bits], np.int64)
    both = np.minimum(words[x], words[y])
    out = np.zeros(len(x), np.int64)
    for w in np.unique(both).tolist():
        at = np.flatnonzero(both == w)
        used, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        m = np.concatenate([folded(np.frombuffer(bits[k], np.uint64)[None], w) for k in used])
        i, j = place[: len(at)], place[len(at) :]
        step = max(1, (1 << 20) // w)
        for lo in range(0, len(at), step):
            out[at[lo : lo + step]] = np.bitwise_count(m[i[lo : lo + step]] ^ m[j[lo : lo + step]]).sum(axis=1)
    return out


def _placed(profiles: DataFrame, rules: JaccardRules) -> DataFrame:
    """Profiles with their block: nodes of a family, and in it of a component, side by side."""

    def run(batches):
        from pyspark import TaskContext

        block, held, tokens = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            own = []
            for n in batch.column(1).to_pylist():
                if held and (held >= rules.block_nodes or tokens + n > rules.block_tokens):
                    block, held, tokens = block + 1, 0, 0
                held, tokens = held + 1, tokens + n
                own.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "block"])

    keys = ["family", "component", "node"]
    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return profiles.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{PROFILE}, component long, family long, block long")


def _passing(placed: DataFrame, pairs: DataFrame, rules: JaccardRules) -> DataFrame:
    """i, j, block, node, component: the nodes that a pair of blocks has to compare by whole sets.

    Of the two blocks' profiles, those with a partner in the other block, of another component,
    that passes every filter.
    """
    need = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(placed.drop("family"), "block")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tc.trim()
        g = g.sort_values(["block", "node"]).reset_index(drop=True)
        node, comp, n, c = (g[k].to_numpy() for k in ("node", "component", "n", "c"))
        left, right = np.flatnonzero(g["block"] == g["i"]), np.flatnonzero(g["block"] == g["j"])
        ni, nj = n[left][:, None], n[right][None]
        ok = (comp[left][:, None] != comp[right][None]) & (np.minimum(ni, nj) >= least_overlap(np.maximum(ni, nj), rules))
        ok &= (node[left][:, None] < node[right][None]) if g["i"].iloc[0] == g["j"].iloc[0] else True
        for name, kind in (("tok", np.uint64), ("second", np.uint32)):
            if ok.any():
                sets = [np.unique(np.frombuffer(x, kind)) for x in g[name]]
                ok &= overlaps([sets[k] for k in left], [sets[k] for k in right]) > 0
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        good = close_enough(c[x], c[y], n[x], n[y], _parities_apart(g["bits"].tolist(), x, y), rules)
        return g.loc[np.unique(np.concatenate([x[good], y[good]])), ["i", "j", "block", "node", "component"]]

    return need.groupBy("i", "j").applyInPandas(run, "i long, j long, block long, node long, component long")


def _verified_blocks(passing: DataFrame, texts: DataFrame, rules: JaccardRules, every: bool) -> DataFrame:
    """Links a, b (of components ca, cb) between the nodes of each pair of blocks that passed, by
    products of incidence matrices: all of them, or those that join components."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tc.trim()
        g = g.sort_values(["block", "node"]).reset_index(drop=True)
        sets = [t for _, t in token_sets(pa.array(g["text"]), rules)]
        node, comp, n = g["node"].to_numpy(), g["component"].to_numpy(), np.array([len(t) for t in sets])
        left, right = np.flatnonzero(g["block"] == g["i"]), np.flatnonzero(g["block"] == g["j"])
        ni, nj = n[left][:, None], n[right][None]
        ok = comp[left][:, None] != comp[right][None]
        ok &= (node[left][:, None] < node[right][None]) if g["i"].iloc[0] == g["j"].iloc[0] else True
        both = overlaps([sets[k] for k in left], [sets[k] for k in right])
        ok &= 100 * both >= rules.per_cent * (ni + nj - both)
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        if not every:  # links of components already joined here add nothing
            up: dict[int, int] = {}

            def find(k: int) -> int:
                while up.setdefault(k, k) != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            keep = np.zeros(len(x), bool)
            for k, (p, q) in enumerate(zip(comp[x].tolist(), comp[y].tolist())):
                p, q = find(p), find(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    keep[k] = True
            x, y = x[keep], y[keep]
        return pd.DataFrame({"a": node[x], "b": node[y], "ca": comp[x], "cb": comp[y]})

    return passing.join(texts.select("node", "text"), "node").groupBy("i", "j").applyInPandas(run, "a long, b long, ca long, cb long")


def _gathered_pairs(g: pd.DataFrame):
    """Like _gathered, with the two extra values of each node."""
    extra = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in g["extra"]])
    node = np.concatenate([np.frombuffer(x, np.int64) for x in g["node"]])
    first = np.unique(node, return_index=True)[1]
    g["extra"] = [b""] * len(g)
    tok, own, name, n, _ = _gathered(g, "u1", False)
    return tok, own, name, n, extra[first]


def _passing_pairs(pairs: DataFrame, profiles: DataFrame, rules: JaccardRules) -> DataFrame:
    """Those of pairs (a, b, ca, cb) that pass the filters on profiles."""
    side = lambda s: profiles.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "c", "second", "bits")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    names = ["a", "b", "ca", "cb", *(f"{c}_{s}" for s in "ab" for c in ("n", "c", "second", "bits"))]

    def run(batches):
        for batch in _parts(batches):
            col = dict(zip(names, batch.columns))
            number = {k: col[k].to_numpy() for k in ("n_a", "n_b", "c_a", "c_b")}
            rows = batch.num_rows
            apart = _parities_apart([*col["bits_a"].to_pylist(), *col["bits_b"].to_pylist()], np.arange(rows), rows + np.arange(rows))
            ok = close_enough(number["c_a"], number["c_b"], number["n_a"], number["n_b"], apart, rules)
            for k in np.flatnonzero(ok).tolist():
                ok[k] = np.isin(*(np.frombuffer(col[f"second_{s}"][k].as_py(), np.uint32) for s in "ab")).any()
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))

    return joined.select(*names).mapInArrow(run, "a long, b long, ca long, cb long")


def similar(a: np.ndarray, b: np.ndarray, rules: JaccardRules) -> bool:
    """a, b: sorted distinct tokens."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= rules.per_cent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, rules: JaccardRules) -> DataFrame:
    """The linked ones of pairs (a, b, ca, cb) by whole sets. texts: node, text."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in _parts(batches):
            sets = [[t for _, t in token_sets(batch.column(i), rules)] for i in (4, 5)]
            ok = pa.array([similar(x, y, rules) for x, y in zip(*sets)], pa.bool_())
            yield batch.select([0, 1, 2, 3]).filter(ok)

    return joined.select("a", "b", "ca", "cb", "text_a", "text_b").mapInArrow(run, "a long, b long, ca long, cb long")


def _merged(current: DataFrame, found: DataFrame) -> DataFrame:
    """current with the components that the links found (of components ca, cb) join."""
    joined = connected_components(found, "ca", "cb").withColumnRenamed("component", "root").withColumnRenamed("node", "component")
    return current.join(joined, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")


def links(docs: DataFrame, members: DataFrame, rules: JaccardRules, key: str = "doc_id", text: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links a, b between nodes: enough for the components, or every one; node, component of nodes that may have any)."""
    spark = docs.sparkSession
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = members.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "place")).alias("best"), F.first("n").alias("n"))
    share = (100 - rules.per_cent) / 100 + 1 / rules.extra
    tokens = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(at_least, int(tokens * share / rules.bucket_tokens) + 1)
    left = _enough_shared(_shared_tokens(_prefix_blobs(docs, rules, buckets, text), buckets), rules)
    wanted = saved(left.join(first.select("node", "n", F.col("best.place").alias("place")), "node"))
    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.col(text).cast("string").alias("text"))
    texts = written(placed.join(wanted, "place").select("node", "n", "text"), "texts")
    tokens = wanted.agg(F.sum("n")).first()[0] or 0
    buckets = max(at_least, int(tokens / rules.bucket_tokens) + 1)
    profiles = written(_profiles(_shared_tokens(_whole_blobs(texts, rules, buckets), buckets), rules), "profiles")
    current = profiles.select("node", F.col("node").alias("component"))
    # families: nodes that candidates connect at all; a node's pairs with its tokens' hubs suffice
    pairs = saved(_candidates(profiles.join(current, "node"), rules, buckets).groupBy("a", "b", "ca", "cb").agg(F.sum("hits").alias("hits")))
    families = connected_components(pairs).withColumnRenamed("component", "family")
    found = []
    for k in range(0 if every else rules.linear_rounds):
        if k:
            pairs = _candidates(profiles.join(current, "node"), rules, buckets).groupBy("a", "b", "ca", "cb").agg(F.sum("hits").alias("hits"))
        best = pairs.select("*", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.max(F.struct("hits", "a", "b", "ca", "cb")).alias("best"))
        best = _passing_pairs(best.select("best.a", "best.b", "best.ca", "best.cb").distinct(), profiles, rules)
        found.append(saved(_verified(best, texts, rules)))
        current = saved(_merged(current, found[-1]).select("node", "component"))
    placed = profiles.join(current, "node").join(families, "node", "left").select(*profiles.columns, "component", F.coalesce("family", "node").alias("family"))
    placed = written(_placed(placed, rules), "blocks")
    passing = saved(_passing(placed, _block_pairs(placed, buckets), rules))
    found.append(saved(_verified_blocks(passing, texts, rules, every)))
    for done in (texts, placed, *([] if every or not rules.linear_rounds else [profiles])):
        forget_table(done)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("a", "b"), _merged(current, found[-1])


def _labelled(docs: DataFrame, rules: JaccardRules | None, key: str, text: str) -> DataFrame:
    """The rows of jaccard_components and their component, a node; null without tokens."""
    rules = rules or JaccardRules()
    fixed_splits(docs.sparkSession)
    members = saved(nodes(docs, rules, key, text))
    _, components = links(docs, members, rules, key, text)
    named = saved(members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    label = saved(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = named.join(label, "component", "left")
    return out.select("doc_id", "place", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("node").isNotNull().alias("has_tokens"), "component")


def jaccard_components(docs: DataFrame, rules: JaccardRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, place, n_shingles, component_id of every row of docs."""
    return _labelled(docs, rules, key, text).drop("component")


def one_of_each(docs: DataFrame, rules: JaccardRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each component the row of the smallest id stays (of rows with
    that id the first), and every row without tokens. All columns as they are."""
    found = saved(_labelled(docs, rules, key, text))
    best = found.where("has_tokens").groupBy("component").agg(F.min(F.struct("doc_id", "place")).alias("best")).select(F.col("best.place").alias("__place"))
    keep = best.union(found.where("not has_tokens").select("place"))
    marked = docs.withColumn("__place", F.monotonically_increasing_id())
    return marked.join(keep, "__place", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
