"""Lexical retrieval packing into token windows.

Documents are dealt into index shards of a bounded number of tokens, as they come. Each shard
holds a BM25 inverted index over the token ids of its documents. The first document of a window
is its seed; the index returns the unused documents that match the seed's tokens best, and these
greedily fill the window. A document that passes the window's end is cut, and
its rest is the next seed, so windows are full. What a shard has left at its end goes to
sequences whose lengths are powers of two, which aren't padded.

Every shard is made inside one task from consecutive rows, so nothing is shuffled, memory is
bounded by the shard's tokens (or one document), and a task that is run again gives the same
pieces: sequence ids join the partition's number and a count.

Defined results: a null or empty text is its closing id alone, and is packed as any other; equal
texts and repeated rows are packed once for each row; of documents with equal scores the first in
the shard comes first, and so does the first unused one where no neighbour is left; an empty table gives an empty result. Only
the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordIds, default_path, spread

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc long, bm25 double"


@dataclass(frozen=True)
class PackingPlan:
    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 1 << 20
    k1: float = 1.2
    b: float = 0.75
    tokenizer: str = ""


class Bm25Shard:
    """An inverted index of one shard's documents: token id -> documents and weights."""

    def __init__(self, docs: list[np.ndarray], plan: PackingPlan):
        n = len(docs)
        self.n = n
        lens = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64) if n else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), lens)
        pair = (flat << 32) | owner
        pair.sort()
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(pair) else np.zeros(1, np.int64)
        tf = np.diff(cut).astype(np.float32)
        key = pair[cut[:-1]]
        self.term, self.doc = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        width = int(self.term[-1]) + 2 if len(key) else 1
        self.at = np.searchsorted(self.term, np.arange(width))
        df = np.diff(np.append(self.at, len(key)))
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = plan.k1 * (1 - plan.b + plan.b * lens / max(lens.mean(), 1.0)) if n else lens
        self.weight = idf[self.term] * tf * (plan.k1 + 1) / (tf + norm[self.doc].astype(np.float32))
        self.many = df[self.term] > 1
        by_doc = np.argsort(self.doc, kind="stable")
        by_doc = by_doc[self.many[by_doc]]
        self.by_doc, self.doc_at = by_doc, np.searchsorted(self.doc[by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have a token of the seed, in order, and their scores for all its different tokens."""
        t = self.term[self.by_doc[self.doc_at[seed] : self.doc_at[seed + 1]]]
        at = spread(self.at[t], self.at[t + 1] - self.at[t])
        if 8 * len(at) < self.n:  # a few of many documents
            docs, own = np.unique(self.doc[at], return_inverse=True)
            return docs, np.bincount(own, self.weight[at], len(docs))
        scores = np.bincount(self.doc[at], self.weight[at], self.n)
        docs = np.flatnonzero(scores)
        return docs, scores[docs]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[tuple[int, float]]:
        """The unused documents with a token of the seed and their scores, the best first, of equal ones the first.

        Ranked in growing parts, as far as the window takes them; used is read when this begins.
        """
        docs, scores = self.scores(seed)
        docs, scores = docs[~used[docs]], scores[~used[docs]]
        part = 32
        while len(docs):
            least = np.partition(scores, -part)[-part] if len(docs) > part else 0.0
            now = scores >= least
            order = np.argsort(-scores[now], kind="stable")
            yield from zip(docs[now][order].tolist(), scores[now][order].tolist())
            docs, scores = docs[~now], scores[~now]
            part *= 4


def pack_shard(keys: list, docs: list[np.ndarray], plan: PackingPlan, first_sequence: int) -> Iterator[tuple]:
    """Pieces of one shard. docs carry their closing id."""
    n, total = len(docs), sum(map(len, docs))
    index = Bm25Shard([d[:-1] for d in docs], plan)
    used = np.zeros(n, bool)
    unseen = 0  # documents before it are used
    full, rest = divmod(total, plan.window)
    sizes = [plan.window] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    doc, done = -1, 0  # the document that is being laid, and its tokens laid so far
    for seq, size in enumerate(sizes, first_sequence):
        room, seed, near, score = size, -1, None, 0.0
        while room:
            if doc < 0:
                doc, score = next(near, (-1, 0.0)) if near else (-1, 0.0)
                if doc < 0:  # no neighbours or none left: the next document is a seed in turn
                    near, seed = None, -1
                    while used[unseen]:
                        unseen += 1
                    doc = unseen
                used[doc] = True
                done = 0
            if seed < 0:
                seed = doc
                if len(docs[doc]) - done < room:
                    near = index.neighbours(seed, used)
            take = min(room, len(docs[doc]) - done)
            yield keys[doc], done, take, zlib.crc32(docs[doc][done : done + take].tobytes()), len(docs[doc]), seq, size - room, keys[seed], score
            done += take
            room -= take
            if done == len(docs[doc]):
                doc = -1


def pack(docs: DataFrame, plan: PackingPlan | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: which tokens of which document lie where in which sequence."""
    plan = plan or PackingPlan()
    path = plan.tokenizer or default_path()

    def run(batches):
        from pyspark import TaskContext

        coder = WordIds.of(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        end = np.array([plan.end_id], "<u4")
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            rows = list(pack_shard(keys, ids, plan, sequence))
            sequence = rows[-1][5] + 1
            keys.clear()
            ids.clear()
            held = 0
            types = [pa.int64()] * 8 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, flat, first in coder.slices(batch.column(1)):
                for k, x, y in zip(names[a:b], first[:-1].tolist(), first[1:].tolist()):
                    keys.append(k)
                    ids.append(np.concatenate([flat[x:y], end]))
                    held += y - x + 1
                    if held >= plan.shard_tokens:
                        yield flush()
        if keys:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
