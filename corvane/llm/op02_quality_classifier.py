"""Quality classifier: random-indexing vectors, pooled, under a small calibrated network.

Each word gives two units: its bytes in lower case (A-Z), hashed to a fixed number of rows, and
its shape (case, kinds of signs, length, whether it repeats the word before). Every unit has a
fixed sparse ternary index vector; the sum of the index vectors around a unit's places in the
training texts is its word vector. A text is the mean of its units' vectors with their norms and
its length. A two-layer network in numpy turns that into a logit; a temperature fitted on a part
of the training rows that the network didn't learn from makes it a probability.

Bounds: vectors and network are fitted on at most ``train_rows`` labelled rows, one document for
each labelled id (the least text of those that have it); the vector table has a fixed size
whatever the corpus, so words can share a row (README). Every row and its whole text is scored, without a shuffle.
Defined results: null and empty texts have the mean vector zero and are scored as such; rows are
independent, so repeated rows repeat; without training rows of both kinds every score is 0.5.
Null labels aren't learned from. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_bucket


@dataclass(frozen=True)
class QualityPlan:
    train_rows: int = 12_000
    #: Rows of the table of word vectors; words whose hashes agree modulo this share one.
    word_rows: int = 1 << 16
    dims: int = 64
    nonzero: int = 4
    window: int = 2
    hidden: int = 32
    epochs: int = 40
    batch: int = 128
    rate: float = 2e-3
    decay: float = 1e-4
    calibration_share: float = 0.2
    seed: int = 7


SHAPES = 1 << 10
#: Most tables of sums that tasks send to the driver, one after the other.
TABLES = 8


@dataclass
class QualityModel:
    vectors: np.ndarray  # words, then shapes
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def _mask(signs: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[np.frombuffer(signs, np.uint8)] = True
    return m


_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
_SIGNS, _BARS, _BANG, _STOP = _mask(b"#*$%&@^~+="), _mask(b"|<>{}[]\\/_"), _mask(b"!?"), _mask(b".,;:")


def units(w: tc.Words, word_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word's hash and of its shape in the vector table. w keeps the case of its text."""
    low = tc.LOWER[w.data]
    prefix = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * tc.powers(tc._R, len(low)), out=prefix[1:])
    h = tc.Words(low, w.offs, w.start, w.end, w.first, prefix, w.raw_prefix_pow).hashes()
    s, e = w.start, w.end

    def has(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(mask[w.data], out=c[1:])
        return c[e] - c[s]

    up, lo, n = has(_UPPER), has(_LOWER), e - s
    case = np.where(up == 0, 0, np.where(lo > 0, 1, np.where(up == 1, 2, 3)))
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][w.first[:-1] < len(h)]] = False
    size = np.digitize(n, (2, 5, 10))
    shape = case | size << 2 | same << 4
    for i, m in enumerate((_SIGNS, _BARS, _BANG, _STOP, _DIGIT)):
        shape |= (has(m) > 0).astype(np.int64) << (5 + i)
    return (h % np.uint64(word_rows)).astype(np.int64), word_rows + shape.astype(np.int64)


def index_vectors(plan: QualityPlan) -> np.ndarray:
    """The fixed sparse ternary vector of each row."""
    rows = plan.word_rows + SHAPES
    out = np.zeros((rows, plan.dims), np.float32)
    for k in range(plan.nonzero):
        h = tc.mix(np.arange(rows, dtype=np.uint64) * np.uint64(2 * k + 3) + np.uint64(plan.seed * 1000 + k))
        np.add.at(out, (np.arange(rows), (h % np.uint64(plan.dims)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    return out


def _add_contexts(sums: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray, index: np.ndarray, window: int, first: int, past: int) -> None:
    """Add to the rows of the units first..past the index vectors around their places."""
    lo, hi = max(0, first - window), past + window
    a, b, doc = a[lo:hi], b[lo:hi], doc[lo:hi]
    own = index[a] + index[b]
    around = np.zeros_like(own)
    for k in range(1, window + 1):
        near = (doc[k:] == doc[:-k])[:, None]
        around[k:] += own[:-k] * near
        around[:-k] += own[k:] * near
    inner = slice(first - lo, past - lo)
    around = around[inner]
    for rows in (a[inner], b[inner]):
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0]))
        sums[rows[order][at]] += np.add.reduceat(around[order], at)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def pooled(w: tc.Words, vectors: np.ndarray, word_rows: int) -> np.ndarray:
    """Features of each document."""
    n, dims = len(w.offs) - 1, vectors.shape[1]
    count = np.diff(w.first)
    a, b = units(w, word_rows)
    out = np.zeros((n, 2 * dims + 3), np.float32)
    some = np.flatnonzero(count)
    for at in range(0, len(some), 256):
        d = some[at : at + 256]
        lo, hi = w.first[d[0]], w.first[d[-1] + 1]
        cuts = w.first[d] - lo
        per = 1 / count[d][:, None].astype(np.float32)
        out[d, :dims] = np.add.reduceat(vectors[a[lo:hi]], cuts) * per
        out[d, dims : 2 * dims] = np.add.reduceat(vectors[b[lo:hi]], cuts) * per
    out[:, -3] = np.linalg.norm(out[:, :dims], axis=1)
    out[:, -2] = np.linalg.norm(out[:, dims : 2 * dims], axis=1)
    out[:, -1] = np.log1p(count)
    return out


def _fit_network(x: np.ndarray, y: np.ndarray, plan: QualityPlan) -> QualityModel:
    rng = np.random.default_rng(plan.seed)
    order = rng.permutation(len(y))
    held = max(1, int(len(y) * plan.calibration_share))
    cal, fit = order[:held], order[held:]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = ((x - mean) / scale).astype(np.float64)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], plan.hidden)), np.zeros(plan.hidden), rng.normal(0, plan.hidden**-0.5, plan.hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for _ in range(plan.epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // plan.batch)):
            h = np.tanh(z[at] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[at]) / len(at)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[at].T @ back + plan.decay * p[0], back.sum(0), h.T @ g + plan.decay * p[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] -= plan.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[cal] @ p[0] + p[1]) @ p[2] + p[3][0]

    def loss(t: float) -> float:
        s = logit / t
        return float(np.mean(np.logaddexp(0, s) - y[cal] * s))

    lo, hi = 0.2, 10.0
    for _ in range(60):  # golden section
        a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return QualityModel(np.zeros((0, plan.dims)), mean, scale, p[0], p[1], p[2], float(p[3][0]), (lo + hi) / 2)


def train(docs: DataFrame, labels: DataFrame, plan: QualityPlan | None = None, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel | None:
    """Fit on labelled rows, at most plan.train_rows (those of lowest hashed id); None without both kinds."""
    plan = plan or QualityPlan()
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.col(label) > 0).cast("long").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64("k"), "k", "y").limit(plan.train_rows)
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), "k").groupBy("k", "y").agg(F.min("text").alias("text")).select("k", "text", "y").repartition(TABLES, "k").persist()
    try:
        if {r["y"] for r in sample.select("y").distinct().collect()} != {0, 1}:
            return None

        def contexts(batches):
            index = index_vectors(plan)
            sums, some = np.zeros_like(index), False
            for batch in batches:
                some = some or batch.num_rows > 0
                for _, _, w in tc.docs_words(batch.column(0)):
                    a, b = units(w, plan.word_rows)
                    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                    for at in range(0, len(a), 1 << 17):
                        _add_contexts(sums, a, b, doc, index, plan.window, at, min(len(a), at + (1 << 17)))
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        total = np.zeros((plan.word_rows + SHAPES, plan.dims), np.float32)
        # a task's sums are a whole table (17 MB), so few tasks, however many partitions the sample has
        for r in sample.select("text").coalesce(TABLES).mapInArrow(contexts, "sums binary").toLocalIterator():
            total += np.frombuffer(r["sums"], np.float32).reshape(total.shape)
        vectors = _normal(total)
        shared = docs.sparkSession.sparkContext.broadcast(vectors)

        def features(batches):
            for batch in batches:
                for a, b, w in tc.docs_words(batch.column(0)):
                    x = pooled(w, shared.value, plan.word_rows)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["x", "y", "k"])

        got = sample.select("text", "y", "k").mapInArrow(features, "x binary, y long, k long").toPandas().sort_values(["k", "y"], kind="stable")
        x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1)
        model = _fit_network(x, got["y"].to_numpy(float), plan)
        model.vectors = vectors
        shared.destroy()
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: QualityModel | None, plan: QualityPlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and calibrated probability of quality of each row of docs."""
    plan = plan or QualityPlan()
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, w in tc.docs_words(batch.column(1)):
                z = (pooled(w, m.vectors, plan.word_rows) - m.mean) / m.scale
                logit = np.tanh(z @ m.w1 + m.b1) @ m.w2 + m.b2
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(logit / m.temperature, -40, 40))), pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, plan: QualityPlan | None = None, folds: int = 3, held: int = 1) -> DataFrame:
    """Scores of all docs by a model that never saw labels of the held-out fold."""
    model = train(docs, labels.where(crc_bucket(F.col("doc_id"), folds) != held), plan)
    out = score(docs, model, plan)
    return out.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
