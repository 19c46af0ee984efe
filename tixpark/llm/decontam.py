"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most k edits leaves at
least ``m + 1 - q - k * q`` of its q-grams unharmed there, and their hits lie on
diagonals (place in the text minus place in the item) at most k apart.  The
hits of each item are counted in overlapping diagonal bands, bands that reach
the bound are kept, and a banded alignment of the item with the band verifies
the edit distance.  So every occurrence within the budget is found and nothing
else is reported.

Both sides are compared in lower case with runs of white space as one blank.
The budget is ``EDIT_PERCENT`` of the item's characters.

The benchmark is a query set: it is put into blocks of at most
``block_chars`` characters, and every text is searched against each block in
turn; a block's q-gram index is all that a task holds besides one window of
text.  A text is searched whole, in windows that overlap by more than an item.

Defined cases: null and empty texts hold nothing; null, empty and short items
(fewer than ``MIN_CHARS`` characters) are no evidence and never match; an empty
benchmark matches nothing; repeated documents and items each give their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Q = 12
EDIT_PERCENT = 6
MIN_CHARS = 32
WINDOW = 1 << 20
BLOCK_CHARS = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, edits int, shared_qgrams int, at long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams (q = 12: built from grams of 4 and 8)."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    two = codes[:-1] * _BASE + codes[1:]
    four = two[:-2] * _BASE * _BASE + two[2:]
    b4 = _BASE * _BASE * _BASE * _BASE
    eight = four[:-4] * b4 + four[4:]
    g = eight[:-4] * b4 + four[8:]
    return (g ^ (g >> np.uint64(31))) * _BASE


def _budget(chars: int) -> int:
    """Edits allowed: the percentage, but never so many that no q-gram need survive."""
    return min(chars * EDIT_PERCENT // 100, (chars - Q) // Q)


class Index:
    """The q-grams of one block of items, sorted, with a bit filter before the search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.budgets = np.array([_budget(len(t)) for t in self.texts], np.int64)
        self.needed = self.sizes + 1 - Q - self.budgets * Q
        with np.errstate(over="ignore"):
            grams = [_qgrams(_codes(t)) for t in self.texts]
        all_grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, first = np.unique(all_grams[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.place = item[order], place[order]
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.longest = int(self.sizes.max(initial=0) + self.budgets.max(initial=0))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, item, place in item) of every shared q-gram."""
        with np.errstate(over="ignore"):
            g = _qgrams(codes)
        at = np.flatnonzero(self.bits[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        g = g[at]
        found = np.searchsorted(self.grams, g)
        found[found == len(self.grams)] = 0
        same = self.grams[found] == g if len(self.grams) else np.zeros(len(g), bool)
        at, found = at[same], found[same]
        lo, n = self.first[found], self.first[found + 1] - self.first[found]
        flat = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return np.repeat(at, n), self.item[flat], self.place[flat]

    def search(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item number, edits, shared q-grams, place of a hit, its diagonal) of the verified regions of a normalised text."""
        at, item, place = self.hits(_codes(text))
        if not len(at):
            return
        wide = self.budgets[item] + 1
        band = (at - place + self.longest) // wide  # never negative
        key = np.concatenate((band, band + 1))  # band b holds the strips b - 1 and b
        item2, place2, at2 = (np.concatenate((x, x)) for x in (item, place, at))
        # distinct q-grams of an item in a band
        order = np.lexsort((place2, key, item2))
        key, item2, place2, at2 = key[order], item2[order], place2[order], at2[order]
        new_band = np.concatenate(([True], (key[1:] != key[:-1]) | (item2[1:] != item2[:-1])))
        new_gram = new_band | np.concatenate(([True], place2[1:] != place2[:-1]))
        starts = np.flatnonzero(new_band)
        shared = np.add.reduceat(new_gram.astype(np.int64), starts)
        keep = shared >= self.needed[item2[starts]]
        for s, n in zip(starts[keep].tolist(), shared[keep].tolist()):
            i = int(item2[s])
            k = int(self.budgets[i])
            lo = (int(key[s]) - 1) * (k + 1) - self.longest
            hi = lo + 2 * (k + 1)
            edits = aligned(self.texts[i], text, lo, hi, k)
            if edits <= k:
                yield i, edits, n, int(at2[s]), int(at2[s] - place2[s])


def aligned(item: str, text: str, lo: int, hi: int, k: int) -> int:
    """Least edits of ``item`` against a part of ``text`` that starts at lo..hi-1 and strays at most k; k + 1 if more."""
    if text.find(item, max(lo, 0), hi + len(item)) >= 0:
        return 0
    first, width = lo - k, hi - lo + 2 * k  # diagonals first .. first + width - 1
    t = np.zeros(width + len(item), np.uint64)  # 0: outside the text, equal to nothing
    a, b = max(first, 0), min(first + len(t), len(text))
    if b > a:
        t[a - first:b - first] = _codes(text[a:b])
    steps = np.arange(width)
    cost = np.zeros(width, np.int64)
    for i, c in enumerate(_codes(item)):
        swap = cost + (t[i:i + width] != c)
        drop = np.append(cost[1:], len(item)) + 1
        cost = np.minimum(swap, drop)
        cost = np.minimum.accumulate(cost - steps) + steps
        if cost.min() > k:
            return k + 1
    return int(cost.min())


def _windows(texts: list[tuple[int, str]], overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (row, offset, part) of about WINDOW characters, more where an item is long: a window is four overlaps at least."""
    group, size, window = [], 0, max(WINDOW, 4 * overlap)
    for row, text in texts:
        at = 0
        while True:
            part = text[at:at + window]
            group.append((row, at, part))
            size += len(part)
            if size >= window:
                yield group
                group, size = [], 0
            if at + window >= len(text):
                break
            at += window - overlap
    if group:
        yield group


def find_all(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """Best region per (row, item): (row, item number, edits, shared q-grams, place)."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    rows = [(r, normal(t)) for r, t in enumerate(texts) if t]
    gap = "\0" * Q  # no q-gram of an item holds it
    for group in _windows(rows, 2 * index.longest + Q):
        joined, spans, at = gap.join(p for _, _, p in group), [], 0
        for row, offset, part in group:
            spans.append((at, row, offset))
            at += len(part) + len(gap)
        begins = np.array([s for s, _, _ in spans])
        for i, edits, shared, hit, diagonal in index.search(joined):
            start, row, offset = spans[int(np.searchsorted(begins, hit, "right")) - 1]
            found = (edits, -shared, max(diagonal - start, 0) + offset)
            if found < best.get((row, i), (1 << 30,)):
                best[row, i] = found
    return [(row, i, e, -s, p) for (row, i), (e, s, p) in best.items()]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The usable items, normalised, in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text)).filter(F.length(text) >= MIN_CHARS)
    for i, t in rows.toLocalIterator():
        t = normal(t)
        if len(t) < MIN_CHARS:
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, edits, shared_qgrams, at``."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value)
            for b in batches:
                ids = b["doc_id"].astype("Int64")
                found = find_all(index, list(b["text"]))
                rows = [x[0] for x in found]
                yield pd.DataFrame({"doc_id": ids.iloc[rows].array, "item_id": pd.array([index.ids[x[1]] for x in found], "Int64"),
                                    "edits": [x[2] for x in found], "shared_qgrams": [x[3] for x in found], "at": [x[4] for x in found]})

        out = out.union(d.mapInPandas(run, SCHEMA))
    return out


def _holds(block: list[tuple[int, str]], spark) -> "Column":
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value)
        for texts in parts:
            flags = np.zeros(len(texts), bool)
            for row, *_ in find_all(index, list(texts)):
                flags[row] = True
            yield pd.Series(flags)

    return holds


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark):
        docs = docs.filter(~_holds(block, docs.sparkSession)(F.col(text)))
    return docs
