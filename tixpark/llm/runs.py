"""Periodic runs of words: stretches that repeat with one period at least four times.

A run is a maximal stretch of words with smallest period q (words q apart are
equal) and a length of at least max(6, 4 q).  Long periods are found by
minimizers at scales k = 16, 32, ...: grams of k words are hashed (each scale
doubles the one below), and the least hash of every window of k / 2 grams is
selected.  Inside a run of period q with k / 2 < q <= k

* a gram has q words or more, so it comes again after q words and not before,
* a window and the one q words on lie inside the run (4 q words hold both), so
  they select the same gram: equal minimizers follow each other at distance q.

Such a pair is a seed, extended both ways word by word.  A seed is a square (the
k-grams overlap), so clean text has hardly any, and a stretch is extended once.
Periods up to ``DIRECT`` are too short for a minimizer and are found by scans
at their own lag.  A lag that is a multiple of the smallest period gives the
same stretch, so of equal stretches that of the shortest lag is the run.

Every document is worked on by itself, whole, where it lies: nothing is
shuffled, copies and hot sources cost their own share only.  Documents of one
Arrow batch are laid end to end with separators that equal no word.  Words are
numbered exactly; only grams are hashed (64 bits), which selects seeds.

Defined cases: a null or empty text has no word and no run; a null doc_id has no
checksum, its words stay as they are; rows are never merged, so repeated rows
give repeated results; only doc_id and text are read, further columns are left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A run has MIN_WORDS words and MIN_TIMES times its period at least.
MIN_WORDS, MIN_TIMES = 6, 4
#: Periods up to here are scanned at their own lag; a power of two.
DIRECT = 8
#: Words of an Arrow batch that are worked on together (a longer document goes alone).
GROUP_WORDS = 1 << 19
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

SPANS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>"
DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * GOLDEN) ^ (b + (a >> np.uint64(29)))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def _slid(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every window of ``width`` (a power of two) entries."""
    step = 1
    while step < width:
        a = pick(a[:-step], a[step:])
        step *= 2
    return a


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that are the least of some window of ``width`` grams."""
    least = _slid(grams, width, np.minimum)
    best = _slid(np.pad(least, width - 1), width, np.maximum)  # greatest of the minima of a gram's windows
    return np.flatnonzero(best == grams)


def _stretch(ids: np.ndarray, i: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The words around i that equal those ``lag`` on: [first, end) of the whole stretch, the last period included."""
    end, step = i, 64
    while end + lag < high:
        stop = min(end + step, high - lag)
        bad = np.flatnonzero(ids[end:stop] != ids[end + lag:stop + lag])
        if len(bad):
            end += int(bad[0])
            break
        end, step = stop, step * 2
    first, step = i, 64
    while first > low:
        stop = max(first - step, low)
        bad = np.flatnonzero(ids[stop:first] != ids[stop + lag:first + lag])
        if len(bad):
            first = stop + int(bad[-1]) + 1
            break
        first, step = stop, step * 2
    return first, end + lag


def _scanned(ids: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches whose words equal those ``lag`` on, by one pass at that lag."""
    bad = np.flatnonzero(ids[lag:] != ids[:-lag])
    edges = np.concatenate(([-1], bad, [len(ids) - lag]))
    for k in np.flatnonzero(np.diff(edges) - 1 + lag >= max(MIN_WORDS, MIN_TIMES * lag)):
        yield int(edges[k]) + 1, int(edges[k + 1]) + lag


def _found(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], int]:
    """All runs, (first, end) -> period, of documents laid end to end, the longest document first."""
    runs: dict[tuple[int, int], int] = {}
    ends = starts + sizes + 1  # the separator included

    def within(least: int) -> int:
        """The end of the documents of at least so many words."""
        n = int(np.searchsorted(-sizes, -least, side="right"))
        return int(ends[n - 1]) if n else 0

    for lag in range(1, DIRECT + 1):
        some = within(max(MIN_WORDS, MIN_TIMES * lag))
        if some > lag:
            for span in _scanned(ids[:some], lag):
                runs.setdefault(span, lag)
    grams, k = ids.astype(np.uint64), 1
    grams = _mixed(grams, np.uint64(1))
    while True:
        some = within(MIN_TIMES * (k // 2 + 1) if k > DIRECT else MIN_TIMES * (DIRECT + 1))
        if some < 2 * k:
            return runs
        grams = grams[:some - k + 1]
        if k > DIRECT:
            at = _minimizers(grams, k // 2)
            at = at[np.argsort(grams[at], kind="stable")]
            gap = np.diff(at)
            seeds = np.flatnonzero((gap > k // 2) & (gap <= k) & (grams[at[1:]] == grams[at[:-1]]))
            order = np.lexsort((at[seeds], gap[seeds]))
            done, last = 0, 0
            for i, lag in zip(at[seeds][order].tolist(), gap[seeds][order].tolist()):
                if lag == last and i + lag < done:
                    continue
                if ids[i] != ids[i + lag]:
                    continue
                doc = int(np.searchsorted(starts, i, side="right")) - 1
                first, done = _stretch(ids, i, lag, int(starts[doc]), int(ends[doc] - 1))
                last = lag
                if done - first >= MIN_TIMES * lag and runs.get((first, done), lag) >= lag:
                    runs[first, done] = lag
        if k * 2 > len(grams):
            return runs
        grams = _mixed(grams[:-k], grams[k:])
        k *= 2


def runs_of(documents: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs as (start, length, period), by start, then period."""
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    sizes = np.array([len(documents[d]) for d in order], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64) if len(order) else sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not len(order) or sizes[0] < MIN_WORDS:
        return out
    ids = np.empty(int(sizes.sum()) + len(order), dtype=np.int64)
    number: dict = {}
    for d, start, size in zip(order, starts.tolist(), sizes.tolist()):
        ids[start:start + size] = [number.setdefault(w, len(number)) for w in documents[d]]
    ids[starts + sizes] = len(number) + np.arange(len(order))
    for (first, end), period in _found(ids, starts, sizes).items():
        doc = int(np.searchsorted(starts, first, side="right")) - 1
        out[order[doc]].append((first - int(starts[doc]), end - first, period))
    for spans in out:
        spans.sort(key=lambda r: (r[0], r[2]))
    return out


def planted(doc_id: int | None, words: list) -> list:
    """The words of the contract: a tenth of the documents, by checksum, get a periodic tail."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; ties: least start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that are not in a run after its first period."""
    if not runs:
        return words
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]


def _digest(doc_id: int | None, words: list, runs: list[tuple[int, int, int]]) -> tuple:
    best = _longest(runs)
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(_kept(words, runs))).hexdigest())


def _spans(doc_id: int | None, words: list, runs: list[tuple[int, int, int]]) -> tuple:
    return doc_id, len(words), [dict(start=s, length=n, period=p) for s, n, p in runs]


def _groups(ids: Iterable, texts: Iterable, prepare) -> Iterator[list[tuple]]:
    """(doc_id, words) of one batch, in groups of bounded size."""
    group, size = [], 0
    for doc_id, text in zip(ids, texts):
        words = (text or b"").split()  # bytes split at blank, TAB, LF, VT, FF and CR
        words = prepare(doc_id, words)
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append((doc_id, words))
        size += len(words)
    if group:
        yield group


def _mapped(docs: DataFrame, schema: str, row, prepare) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (v.as_py() for v in batch.column(1))
            for group in _groups(batch.column(0).to_pylist(), texts, prepare):
                found = runs_of([words for _, words in group])
                rows = [row(doc_id, words, runs) for (doc_id, words), runs in zip(group, found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return narrow.mapInArrow(work, schema)


def runs(docs: DataFrame) -> DataFrame:
    """Every document's number of words and its runs, by start, then period."""
    return _mapped(docs, SPANS, _spans, lambda doc_id, words: words)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: the runs of every document (a tenth with a periodic tail) and what their collapse keeps."""
    return _mapped(docs, DIGESTS, _digest, planted)


def collapsed(docs: DataFrame, column: str = "collapsed") -> DataFrame:
    """doc_id and the text with every run cut to its first period, words joined by one blank."""
    return _mapped(docs, f"doc_id long, {column} string",
                   lambda doc_id, words, found: (doc_id, b" ".join(_kept(words, found)).decode("utf-8", "replace")),
                   lambda doc_id, words: words)
