"""Edit-aware token counts.

A text's pre-tokens (the tokenizer's split before its merges) are the leaves of a segment tree,
in blocks; each node holds the characters and tokens below it. An edit finds its leaves by the
characters' sums, re-splits from some pre-tokens before the first touched one until a boundary
meets an old one again, counts only the pre-tokens in between, and updates the sums above the
changed leaves. The split never looks back, and ahead only over white space or two letters, so
everything outside that region keeps its pre-tokens and the tree's root holds what counting the
whole new text would give.

:func:`build_trees` counts whole texts and keeps each tree in a column; :func:`apply_edits` takes
texts and trees and edits them without counting the rest again. Neither shuffles.

Defined results: a null text has no tokens and stays null, an empty one has none; edits must lie
inside the text and not overlap, else the task fails; they are taken in order of their place;
null edits are none. Rows are independent; columns beside those named pass through build_trees,
and columns of docs that have the names of its own give way to them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

BLOCK = 64
_MOST_KEPT = 1_000_000
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Splits into pre-tokens and counts the tokens of each; counts met before are kept."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "PieceCounter":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = {p for p in pieces if p not in known}
        if new:
            if len(known) > _MOST_KEPT:
                known.clear()
                new = set(pieces)
            encode = self.coder.encode_ordinary
            known.update((p, len(encode(p))) for p in new)
        return [known[p] for p in pieces]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Rope:
    """A text in parts of a few thousand characters, so that an edit copies only parts it touches."""

    PART = 4096

    def __init__(self, text: str):
        self.parts = [text[i : i + self.PART] for i in range(0, len(text), self.PART)]
        self.starts, self.length = [i * self.PART for i in range(len(self.parts))], len(text)

    def __len__(self) -> int:
        return self.length

    def __str__(self) -> str:
        return "".join(self.parts)

    def cut(self, start: int, end: int) -> str:
        """The characters from start to end."""
        i = max(0, bisect_right(self.starts, start) - 1)
        out = []
        while i < len(self.parts) and self.starts[i] < end:
            out.append(self.parts[i][max(0, start - self.starts[i]) : end - self.starts[i]])
            i += 1
        return "".join(out)

    def replace(self, start: int, end: int, new: str) -> None:
        if not self.parts:
            self.__init__(new)
            return
        i = max(0, bisect_right(self.starts, start) - 1)
        j = max(i + 1, bisect_left(self.starts, end))
        text = self.cut(self.starts[i], start) + new + self.cut(end, self.starts[j] if j < len(self.parts) else self.length)
        self.length = self.starts[i]
        self.parts[i:j] = [text[k : k + self.PART] for k in range(0, len(text), self.PART)]
        del self.starts[i:]
        for x in self.parts[i:]:
            self.starts.append(self.length)
            self.length += len(x)


class TokenTree:
    """A text with the sums of its pre-tokens' characters and tokens."""

    def __init__(self, text: str, lens: list[int], counts: list[int], counter: PieceCounter):
        self.rope, self.counter, self.recounted = text if isinstance(text, Rope) else Rope(text), counter, 0
        n = max(1, -(-len(lens) // BLOCK))
        self.lens = [lens[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.counts = [counts[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.cap = 1 << (n - 1).bit_length()
        self.sums = [[0, 0] for _ in range(2 * self.cap)]
        for i in range(n):
            self.sums[self.cap + i] = [sum(self.lens[i]), sum(self.counts[i])]
        for i in range(self.cap - 1, 0, -1):
            a, b = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = [a[0] + b[0], a[1] + b[1]]

    @classmethod
    def of(cls, text: str, counter: PieceCounter) -> "TokenTree":
        pieces = counter.split(text)
        return cls(text, list(map(len, pieces)), counter.counts(pieces), counter)

    @property
    def text(self) -> str:
        return str(self.rope)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at this place (the last one at the end), and its start."""
        i, start = 1, 0
        while i < self.cap:
            left = self.sums[2 * i][0]
            if at < start + left or not self.sums[2 * i + 1][0]:
                i = 2 * i
            else:
                i, start = 2 * i + 1, start + left
        return min(i - self.cap, len(self.lens) - 1), start

    def _piece(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token at this character."""
        leaf, start = self._leaf(at)
        k = 0
        while k < len(self.lens[leaf]) - 1 and at >= start + self.lens[leaf][k]:
            start += self.lens[leaf][k]
            k += 1
        return leaf, k, start

    def _before(self, leaf: int, k: int, start: int) -> tuple[int, int, int]:
        """The pre-token before, or the same at the beginning."""
        if k:
            return leaf, k - 1, start - self.lens[leaf][k - 1]
        for i in range(leaf - 1, -1, -1):
            if self.lens[i]:
                return i, len(self.lens[i]) - 1, start - self.lens[i][-1]
        return leaf, k, start

    def _context(self, at: int) -> tuple[int, int, int]:
        """The pre-token from which to split again for an edit at this character.

        A contraction looks two letters ahead, so that is two before the touched one; white space
        looks to its run's end, so further back while there is only white space.
        """
        here = self._before(*self._before(*self._piece(at)))
        while here[2] and self.rope.cut(here[2], here[2] + self.lens[here[0]][here[1]]).isspace():
            here = self._before(*here)
        return here

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end."""
        old = self.rope
        if not 0 <= start <= end <= len(old):
            raise ValueError(f"edit {start}..{end} of a text of {len(old)} characters")
        shift = len(new) - (end - start)
        leaf, k, begin = self._context(start) if len(old) else (0, 0, 0)
        window = 8
        while True:
            # old boundaries from the context's start on, to some pre-tokens past the edit
            bounds, i, j, at, past = [begin], leaf, k, begin, 0
            while i < len(self.lens) and past < window:
                while j >= len(self.lens[i]):
                    i, j = i + 1, 0
                    if i == len(self.lens):
                        break
                else:
                    at += self.lens[i][j]
                    j += 1
                    bounds.append(at)
                    past += at >= end
                    continue
                break
            stop = bounds[-1]
            pieces = self.counter.split(old.cut(begin, start) + new + old.cut(end, stop))
            olds, at, met = {b + shift: n for n, b in enumerate(bounds) if b >= end}, begin, None
            whole = stop == len(old)
            for n, p in enumerate(pieces):
                at += len(p)
                if at >= start + len(new) and at in olds and (whole or n < len(pieces) - 3 and not "".join(pieces[n + 1 : -1]).isspace()):
                    met = n + 1, olds[at]
                    break
            if met is None and not pieces and whole:
                met = 0, len(bounds) - 1
            if met:
                break
            window *= 4
        made, gone = pieces[: met[0]], met[1]
        self._replace(leaf, k, gone, list(map(len, made)), self.counter.counts(made))
        self.recounted += len(made)
        old.replace(start, end, new)

    def _replace(self, leaf: int, k: int, gone: int, lens: list[int], counts: list[int]) -> None:
        first, changed = leaf, [leaf]
        here = min(gone, len(self.lens[leaf]) - k)
        self.lens[leaf][k : k + here] = lens
        self.counts[leaf][k : k + here] = counts
        gone -= here
        while gone:
            leaf += 1
            here = min(gone, len(self.lens[leaf]))
            del self.lens[leaf][:here], self.counts[leaf][:here]
            gone -= here
            changed.append(leaf)
        if len(self.lens[first]) > 16 * BLOCK:  # long insertions: deal the leaves anew
            self.__dict__.update(TokenTree(self.rope, list(chain(*self.lens)), list(chain(*self.counts)), self.counter).__dict__ | {"recounted": self.recounted})
            return
        for i in changed:
            self.sums[self.cap + i] = [sum(self.lens[i]), sum(self.counts[i])]
        for i in {(self.cap + i) >> 1 for i in changed}:
            while i:
                a, b = self.sums[2 * i], self.sums[2 * i + 1]
                self.sums[i] = [a[0] + b[0], a[1] + b[1]]
                i >>= 1

    def state(self) -> bytes:
        return _state(list(chain(*self.lens)), list(chain(*self.counts)))


def _state(lens: list[int], counts: list[int]) -> bytes:
    both = np.array([lens, counts], np.int64)
    wide = both.size and both.max() > 65535
    return (b"4" if wide else b"2") + both.astype("<u4" if wide else "<u2").tobytes()


def _of_state(raw: bytes) -> tuple[list[int], list[int]]:
    both = np.frombuffer(raw, "<u4" if raw[:1] == b"4" else "<u2", offset=1).reshape(2, -1)
    return both[0].tolist(), both[1].tolist()


#: Personal data and secrets, each with what stands for it after masking.
_MASKS = (
    (re.compile(r"[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+"), "<EMAIL>", "@"),
    (re.compile(r"\+?\d[\d ()./-]{7,}\d"), "<NUMBER>", ""),
    (re.compile(r"\b(?:sk|pk|ghp|AKIA|xox)[-_A-Za-z0-9]{16,}"), "<KEY>", ""),
)


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask e-mail addresses, long numbers and keys; the earliest of overlapping ones."""
    found = []
    for pattern, name, needs in _MASKS:
        if not needs or needs in text:
            found += [(m.start(), m.end(), name) for m in pattern.finditer(text)]
    out, last = [], 0
    for e in sorted(found):
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


def build_trees(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """docs with n_tokens, n_pieces and the tree of each text."""
    path = tokenizer or default_path()
    docs = without(docs, "n_tokens", "n_pieces", "tree")
    at, names = docs.columns.index(text), [*docs.columns, "n_tokens", "n_pieces", "tree"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("tree", T.BinaryType())])

    def run(batches):
        counter = PieceCounter.of(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                tokens, pieces, trees = [], [], []
                for t in batch.column(at).to_pylist():
                    parts = counter.split(t) if t else []
                    n = counter.counts(parts)
                    tokens.append(sum(n))
                    pieces.append(len(n))
                    trees.append(_state(list(map(len, parts)), n))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array(pieces, pa.int64()), pa.array(trees, pa.binary())], names=names)

    return docs.mapInArrow(run, schema)


EDITED = "doc_id long, tokens_before long, n_edits long, recounted_pieces long, n_pieces long, tokens_after long, chars_after long, text string, tree binary"


def apply_edits(trees: DataFrame, edits: str | Callable[[str], list[tuple[int, int, str]]], key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Edited texts, their trees and counts. trees: rows of build_trees.

    edits: a column of array<struct<start, end, text>> in characters of the old text, or a
    function from a text to such tuples.
    """
    path = tokenizer or default_path()
    column = edits if isinstance(edits, str) else None
    source = trees.select(F.col(key).cast("long"), F.col(text).cast("string"), "n_tokens", "tree", *([F.col(column)] if column else []))

    def run(batches) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                cols = [c.to_pylist() for c in batch.columns[1:]]
                rows = []
                for t, n, raw, *own in zip(*cols):
                    if t is None:
                        rows.append((n, 0, 0, 0, 0, None, None, raw))
                        continue
                    todo = [(e["start"], e["end"], e["text"]) for e in own[0] or ()] if column else edits(t)
                    if not todo:
                        rows.append((n, 0, 0, (len(raw) - 1) // (8 if raw[:1] == b"4" else 4), n, len(t), t, raw))
                        continue
                    tree = TokenTree(t, *_of_state(raw), counter)
                    last = len(t)
                    for s, e, new in sorted(todo, key=lambda x: (x[0], x[1]), reverse=True):  # later places first: the others keep theirs
                        if e > last:
                            raise ValueError("overlapping edits")
                        tree.edit(s, e, new or "")
                        last = s
                    rows.append((n, len(todo), tree.recounted, sum(map(len, tree.lens)), tree.tokens, len(tree.rope), tree.text, tree.state()))
                types = [*[pa.int64()] * 6, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, x) for c, x in zip(zip(*rows), types))], names=[x.split()[0] for x in EDITED.split(", ")])

    return source.mapInArrow(run, EDITED)
