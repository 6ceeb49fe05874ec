"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over the words of each text give the characters that
lie inside n-grams found twice or more, the share of the most frequent short n-gram, and the
characters of repeated lines. A text is rejected when a share passes its limit.

Defined results: a null or empty text has no words, so it fails the base rule. Rows are
independent: repeated ids or texts give repeated rows; an empty table gives an empty result.
Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Most share of characters inside repeated n-grams, by n. Twice the familiar web-text limits and
#: more, as the first place counts too: a header and footer alone don't condemn a short text.
DUP_LIMIT = {5: 0.36, 6: 0.35, 7: 0.34, 8: 0.33, 9: 0.32, 10: 0.31}
#: Most share of characters that all places of the one most frequent n-gram take, by n.
TOP_LIMIT = {2: 0.20, 3: 0.18, 4: 0.16}


@dataclass(frozen=True)
class RepetitionRules:
    dup_limit: dict = field(default_factory=lambda: dict(DUP_LIMIT))
    top_limit: dict = field(default_factory=lambda: dict(TOP_LIMIT))
    #: Short texts reach shares by chance; the n-gram limits hold from so many words on.
    least_words: int = 20
    line_share: float = 0.30
    line_char_share: float = 0.30
    base_least_words: int = 20
    base_most_repeat: int = 30  # per cent of words in repeated 8-word windows


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_share double, top_share double, dup_line_char_share double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _covered(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in the n-grams that start at places."""
    d = np.zeros(words + 1, np.int32)
    np.add.at(d, places, 1) if len(places) < 64 else d.__iadd__(np.bincount(places, minlength=words + 1).astype(np.int32))
    e = np.bincount(places + n, minlength=words + 1)[: words + 1].astype(np.int32)
    return np.cumsum(d - e)[:words] > 0


def _repeated(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of values that occur twice or more; all values sorted, and their order."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    dup = np.zeros(len(g), bool)
    dup[1:] |= same
    dup[:-1] |= same
    return order[dup], s, order


def _top_share(g: np.ndarray, chars: np.ndarray, n: int, total: int) -> float:
    """Characters of all places of the most frequent n-gram (longest of equals), as a share."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    counts = np.diff(cut)
    most = counts.max()
    if most < 2:
        return 0.0
    at = order[cut[:-1][counts == most]]
    return float(most) * float((chars[at + n] - chars[at]).max()) / total


def measure(w: tc.Words, rules: RepetitionRules) -> Iterator[tuple]:
    """One tuple for each document, in the order of SCHEMA after doc_id."""
    h = w.hashes()
    inside = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(((w.data & 0xC0) != 0x80) & ~tc.SPACE[w.data], out=inside[1:])
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOL[w.data], out=symbols[1:])
    chars = np.append(inside[w.start], inside[-1] if len(inside) else 0)
    breaks = np.flatnonzero(w.data == 10)
    break_at = np.searchsorted(breaks, w.offs)
    for d in range(len(w.offs) - 1):
        a, b = w.first[d], w.first[d + 1]
        lo, hi = w.offs[d], w.offs[d + 1]
        n, total = int(b - a), int(inside[hi] - inside[lo])
        own = breaks[break_at[d] : break_at[d + 1]]
        ls, le = np.concatenate([[lo], own + 1]), np.concatenate([own, [hi]])
        with_word = inside[le] > inside[ls]
        ls, le = ls[with_word], le[with_word]
        lh = w.span_hash(ls, le)
        n_lines = len(lh)
        _, first = np.unique(lh, return_index=True)
        later = np.ones(n_lines, bool)
        later[first] = False
        n_dup_lines = int(later.sum())
        dup_line_chars = int((inside[le[later]] - inside[ls[later]]).sum())
        repeat_words, dup_share, top_share, bad = 0, 0.0, 0.0, False
        c = np.append(chars[a:b], chars[a] + total) if n else np.zeros(1, np.int64)
        lens = np.diff(c)
        hd = h[a:b]
        if n >= 8:
            places, _, _ = _repeated(tc.rolling(hd, 8))
            repeat_words = int(_covered(places, 8, n).sum()) if len(places) else 0
        base = n < rules.base_least_words or 100 * repeat_words > rules.base_most_repeat * n
        if n >= rules.least_words:
            more = True
            for k in sorted(rules.dup_limit):
                if not more:  # no repeated n-gram, so no longer one either
                    break
                places, _, _ = _repeated(tc.rolling(hd, k))
                more = len(places) > 0
                if more:
                    share = float(lens[_covered(places, k, n)].sum()) / total
                    dup_share = max(dup_share, share)
                    bad |= share > rules.dup_limit[k]
            for k, limit in rules.top_limit.items():
                share = _top_share(tc.rolling(hd, k), c, k, total)
                top_share = max(top_share, share)
                bad |= share > limit
        line_share = dup_line_chars / total if total else 0.0
        if n_lines:
            bad |= n_dup_lines > rules.line_share * n_lines and n_lines >= 4
            bad |= line_share > rules.line_char_share
        yield n, total, int(symbols[hi] - symbols[lo]), n_dup_lines, repeat_words, bool(base), bool(not base and not bad), dup_share, top_share, line_share


def quality_rules(docs: DataFrame, rules: RepetitionRules | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of measures and verdict for each row of docs; no shuffle."""
    rules = rules or RepetitionRules()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for _, _, w in tc.docs_words(batch.column(1)):
                rows.extend(measure(w, rules))
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def kept_rows(docs: DataFrame, rules: RepetitionRules | None = None, text: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, all columns as they are; no shuffle.

    The verdict is taken beside each row, so ids that are null or repeated don't matter.
    """
    rules = rules or RepetitionRules()
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep: list[bool] = []
            for _, _, w in tc.docs_words(batch.column(at)):
                keep.extend(m[6] for m in measure(w, rules))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
