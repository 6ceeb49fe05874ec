"""Toxicity by maximum-scoring segments of token log-odds.

Learning: in how many toxic and clean training texts each token stands gives log-odds with an
informative Dirichlet prior (the token's count in all training texts), and their z value; tokens
that are significantly toxic form a lexicon. A token is a word without outer ASCII punctuation,
in lower case (A-Z), or the word's first bytes, so that stems with new endings are met. A word
outside the lexicon costs what its absence from it tells: the log-odds of all other words.

Scoring: a text is a row of scores, the log-odds of lexicon tokens and a small cost for any
other word. The linear-time all-maximal-segments scan finds every maximal passage; a passage of
score S among n words has the extreme-value significance 1 - exp(-K n exp(-lambda S)), where
lambda solves the balance of the scores over clean text and K is, of a geometric grid, the one
under which the training labels are likeliest. The surprises -ln p of all maximal
passages, so of many weak ones too, add up to one number, which a fitted logistic turns into a
probability; the significant passages are returned with their places.

Bounds: the model is fitted on at most ``train_rows`` labelled rows, one document for each
labelled id (the least text of those that have it); its lexicon, which goes to the driver, is a
part of their tokens. Everything else covers all rows and whole texts; there is no shuffle of
texts. Defined results: null and empty texts have no passage and get the lowest score; rows are
independent, so repeated ids and texts give repeated rows; without training rows of both kinds
every score is 0. Labels that are null aren't learned from. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_bucket

PREFIXES = (4, 5, 6)
#: Values of K that the fit compares.
GRID = (0.01, 0.03, 0.1, 0.3, 1.0)
_PUNCT = np.zeros(256, bool)
_PUNCT[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True


@dataclass(frozen=True)
class ToxicityPlan:
    train_rows: int = 20_000
    #: Weight of the Dirichlet prior as a share of all training tokens: a token met t times has a prior count of so much of t.
    prior_share: float = 0.1
    least_z: float = 3.3
    significance: float = 0.05
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    token: np.ndarray  # sorted
    odds: np.ndarray
    lam: float
    k: float
    gap_cost: float  # of a word outside the lexicon: minus its log-odds
    slope: float
    shift: float
    quick: np.ndarray


def tokens(w: tc.Words) -> list[np.ndarray]:
    """Hashes of each word's tokens: itself and its prefixes (0 where it is shorter)."""
    s, e = w.start.copy(), w.end.copy()
    for _ in range(4):
        e -= (e > s + 1) & _PUNCT[w.data[e - 1]]
        s += (e > s + 1) & _PUNCT[w.data[np.minimum(s, len(w.data) - 1)]]
    out = [w.span_hash(s, e)]
    for k in PREFIXES:
        out.append(np.where(e - s > k, w.span_hash(s, np.minimum(s + k, e)) ^ np.uint64(0x5851F42D4C957F2D), np.uint64(0)))
    return out


def maximal_segments(scores: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a row of (score, first, past the last), in linear time."""
    total, found = 0.0, []  # each: sum before, sum after, first, last, link to the nearest before it with a lower sum before
    for s, a, b in scores:
        if s <= 0:
            total += s
            continue
        left, first = total, a
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((left, total, first, b, j))
                break
            left, first, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(r - l, a, b) for l, r, a, b, _ in found]


def _hits(w: tc.Words, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Places and log-odds of words with a token in the lexicon."""
    best = np.zeros(len(w.start))
    if len(w.start) and len(model.token):
        for h in tokens(w):
            at = np.flatnonzero(model.quick[h & np.uint64(0xFFFFF)])
            i = np.minimum(np.searchsorted(model.token, h[at]), len(model.token) - 1)
            ok = model.token[i] == h[at]
            np.maximum.at(best, at[ok], model.odds[i[ok]])
    at = np.flatnonzero(best)
    return at, best[at]


def _rows(w: tc.Words, model: ToxicityModel) -> Iterator[list[tuple[float, int, int]]]:
    """Each document's row of scores, from its first lexicon token to its last: (score, first word, past the last)."""
    at, odds = _hits(w, model)
    cut = np.searchsorted(at, w.first)
    for a, b in zip(cut, cut[1:]):
        row, last = [], None
        for i, s in zip(at[a:b].tolist(), odds[a:b].tolist()):
            if last is not None and i > last + 1:
                row.append((-model.gap_cost * (i - last - 1), last + 1, i))
            row.append((s, i, i + 1))
            last = i
        yield row


def passages(w: tc.Words, model: ToxicityModel, plan: ToxicityPlan) -> Iterator[tuple[float, list]]:
    """(surprise, significant passages as first byte, past the last, score, p) of each document."""
    for d, row in enumerate(_rows(w, model)):
        n = int(w.first[d + 1] - w.first[d])
        total, spans = 0.0, []
        for s, first, past in maximal_segments(row):
            x = model.lam * s - math.log(model.k * max(n, 1))
            p = -math.expm1(-math.exp(-x)) if x > -30 else 1.0
            total += -math.log(max(p, 1e-300))
            if p <= plan.significance:
                spans.append((int(w.start[first] - w.offs[d]), int(w.end[past - 1] - w.offs[d]), float(s), p))
        yield total, spans


def _counts(labelled: DataFrame) -> DataFrame:
    """token, toxic texts, clean texts."""

    def run(batches):
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for a, b, w in tc.docs_words(batch.column(0), lower=True):
                h, y = [], []
                for d, parts in enumerate(_by_doc(w)):
                    h.append(np.unique(parts))
                    y.append(np.full(len(h[-1]), toxic[a + d]))
                if not h:
                    continue
                h, y = np.concatenate(h), np.concatenate(y)
                token, at = np.unique(h, return_inverse=True)
                t = np.bincount(at, y, len(token)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(token)) - t)], names=["token", "t", "c"])

    return labelled.mapInArrow(run, "token long, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _by_doc(w: tc.Words) -> Iterator[np.ndarray]:
    all_ = tokens(w)
    for a, b in zip(w.first, w.first[1:]):
        x = np.concatenate([t[a:b] for t in all_])
        yield x[x != 0]


def _balance(odds: np.ndarray, rate: np.ndarray, cost: float) -> float:
    """The positive lambda at which the mean of exp(lambda score) over clean text is one."""
    f = lambda l: float((rate * np.exp(np.minimum(l * odds, 700))).sum() + (1 - rate.sum()) * math.exp(-l * cost)) - 1
    lo, hi = 1e-4, 1e-3
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def train(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows, at most plan.train_rows of them (those of lowest hashed id)."""
    plan = plan or ToxicityPlan()
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.1, 0.1, 0.0, -50.0, np.zeros(1 << 20, bool))
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.col(label) > 0).cast("long").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64("k"), "k", "y").limit(plan.train_rows)
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), "k").groupBy("k", "y").agg(F.min("text").alias("text")).select("text", "y").repartition(8).persist()
    try:
        counts = _counts(sample).persist()
        n = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
        kinds = {r["y"] for r in sample.select("y").distinct().collect()}
        if kinds != {0, 1}:
            return none
        nt, nc = float(n["t"]), float(n["c"])
        a0 = plan.prior_share * (nt + nc)
        both = F.col("t") + F.col("c")
        a = F.lit(plan.prior_share) * both
        delta = F.log((F.col("t") + a) / (nt + a0 - F.col("t") - a)) - F.log((F.col("c") + a) / (nc + a0 - F.col("c") - a))
        z = delta / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
        best = counts.select("token", "t", "c", a.alias("a"), delta.alias("odds"), z.alias("z")).where((F.col("z") > plan.least_z) & (F.col("odds") > 1))
        got = best.toPandas()
        counts.unpersist()
        if not len(got):
            return none
        h = got["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        quick = np.zeros(1 << 20, bool)
        quick[h & np.uint64(0xFFFFF)] = True
        rate = ((got["c"] + got["a"]) / (nc + a0)).to_numpy()
        cost = max(1e-3, math.log1p(-min(rate.sum(), 0.5)) - math.log1p(-min(0.9, float(got["t"].sum()) / nt)))
        model = ToxicityModel(h[order], got["odds"].to_numpy()[order], _balance(got["odds"].to_numpy(), rate, cost), 0.1, cost, 1.0, 0.0, quick)

        def run(batches):
            for batch in batches:
                for i, j, w in tc.docs_words(batch.column(0), lower=True):
                    x = [[s for s, _ in passages(w, replace(model, k=k), plan)] for k in GRID]
                    yield pa.RecordBatch.from_arrays([*(pa.array(one, pa.float64()) for one in x), batch.column(1).slice(i, j - i)], names=[*(f"x{n}" for n in range(len(GRID))), "y"])

        xy = sample.mapInArrow(run, ", ".join(f"x{n} double" for n in range(len(GRID))) + ", y long").toPandas()
        fits = []
        for n, k in enumerate(GRID):
            x, y = np.log1p(xy[f"x{n}"].to_numpy()), xy["y"].to_numpy(float)
            slope, shift = _logistic(x, y)
            t = slope * x + shift
            fits.append((float(np.mean(np.logaddexp(0, t) - y * t)), k, slope, shift))
        _, model.k, model.slope, model.shift = min(fits)
        return model
    finally:
        sample.unpersist()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a small ridge."""
    beta, design = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((design * w[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


SCHEMA = "doc_id long, score double, surprise double, passages array<struct<start: long, end: long, score: double, p: double>>"


def score(docs: DataFrame, model: ToxicityModel, plan: ToxicityPlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: probability of toxicity and the significant passages (byte offsets)."""
    plan = plan or ToxicityPlan()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, w in tc.docs_words(batch.column(1), lower=True):
                got = list(passages(w, m, plan))
                x = np.array([s for s, _ in got])
                y = 1 / (1 + np.exp(-np.clip(m.slope * np.log1p(x) + m.shift, -40, 40)))
                spans = [[dict(zip(("start", "end", "score", "p"), p)) for p in ps] for _, ps in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(y), pa.array(x), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "surprise", "passages"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan | None = None, folds: int = 4, held: int = 2) -> DataFrame:
    """Scores of all docs by a model that never saw labels of the held-out fold."""
    plan = plan or ToxicityPlan()
    model = train(docs, labels.where(crc_bucket(F.col("doc_id"), folds) != held), plan)
    out = score(docs, model, plan)
    return out.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= plan.threshold).cast("int").alias("predicted"), "surprise", "passages")
