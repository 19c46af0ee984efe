"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence scores p = sigmoid(bias + sum of the weights of its features); a
document is toxic if any sentence is (noisy-or): 1 - product of (1 - p).  With
L = sum of softplus over the sentences that is 1 - exp(-L).  Labels are known
for documents only; the gradient reaches the sentences that explain them, so a
sentence's own score locates the offence.

Features are character grams of 4 and 6 inside words, word ends included, as 64
bit hashes.  They are chosen by the likelihood ratio (G) of their document
counts: first over hashed buckets, then exactly for the grams of the best
buckets.  Both are sums over all labelled rows that Spark adds up; so are the
gradients, taken over a written table that holds only chosen features.  The
model (``FEATURES`` weights) is all that the driver and the tasks hold.

Never an input of a score: labels of held-out rows, language, source, doc_id.

Defined cases: a null or empty text, or one without letters or digits, has no
sentence and scores 0; a null doc_id has no label and is not held out; a
document labelled more than once is toxic if any label says so, null labels are
none; repeated rows are rows of their own; without toxic training rows every
score is 0, without clean ones the bias alone decides.  Very long texts are
worked on in pieces that end with a sentence (a sentence of over ``PIECE`` code
points is cut at a blank).  Only doc_id, text and toxic are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

GRAMS = (4, 6)
BUCKET_BITS = 20
#: Buckets looked into, and grams kept, by falling G; the least G of a kept gram, and how many times as common it
#: must be in toxic documents as in clean ones (half as many for a bucket, where others share it).
CANDIDATES, FEATURES, LEAST_G, LEAST_RATIO = 16_384, 4096, 15.0, 4.0
#: Gradient passes, the weights' penalty, and the score from which a document or sentence is called toxic.
PASSES, PENALTY, THRESHOLD = 40, 0.5, 0.3
#: Labelled documents that are broadcast as (id, label); more are joined by a shuffle.
LABELS = 4_000_000
#: Code points that are worked on at a time.
PIECE = 1 << 18
_STOP = re.compile(r"[.!?\n…。]")
_BLANK = re.compile(r"\s")
_STOPS = np.array([ord(c) for c in ".!?\n…。"], dtype=np.uint32)


@dataclass
class Model:
    """``weights`` of the sorted gram hashes ``grams``, and the bias."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float
    _mask: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_mask": None}


@dataclass
class Piece:
    """Some text: gram hashes and the sentence of each, the document of each sentence, and its [start, end).

    A piece holds whole documents, or a part of one; then ``goes_on`` unless it is the last part.
    """

    grams: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    start: np.ndarray
    end: np.ndarray
    goes_on: bool = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part): the text in parts of bounded size that end with a sentence."""
    at = 0
    while len(text) - at > 2 * PIECE:
        found = _STOP.search(text, at + PIECE, at + 2 * PIECE) or _BLANK.search(text, at + PIECE, at + 2 * PIECE)
        cut = found.end() if found else at + 2 * PIECE
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def _piece(parts: list[tuple[int, int, str]]) -> Piece:
    starts = np.cumsum([0] + [len(t) + 1 for _, _, t in parts])
    code = np.frombuffer("\n".join(t for *_, t in parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stop = np.isin(code, _STOPS)
    letter = ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57)) | ((code >= 0xC0) & ((code < 0x2000) | (code > 0x206F)) & ((code < 0x3000) | (code > 0x303F)))
    number = np.cumsum(stop) - stop  # sentence ends before each place
    bounds = np.flatnonzero(np.diff(number, prepend=-1, append=len(code) + 1))
    some = np.zeros(len(bounds) - 1 if len(bounds) else 0, dtype=bool)
    some[number[letter]] = True
    begin, end = bounds[:-1][some], bounds[1:][some]
    part = np.searchsorted(starts, begin, side="right") - 1
    shift = np.array([o for _, o, _ in parts], dtype=np.int64)[part] - starts[part]
    document = np.array([d for d, _, _ in parts], dtype=np.int64)[part]
    new = np.cumsum(some) - 1
    symbol = np.where(letter, code, 1).astype(np.uint64)
    hashes, places = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        size = len(code) - n + 1
        inside = letter[1:size + 1].copy()
        for j in range(2, n - 1):
            inside &= letter[j:size + j]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ symbol[at + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        hashes.append((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
        places.append(new[number[at + 1]])
    none = np.zeros(0, dtype=np.int64)
    return Piece(np.concatenate(hashes) if hashes else none, np.concatenate(places) if places else none, document, begin + shift, end + shift)


def _pieces(texts: list[str | None]) -> Iterator[Piece]:
    parts, size = [], 0
    for d, text in enumerate(texts):
        if not text:
            continue
        cut = [(d, offset, part) for offset, part in _parts(_lower(text))]
        if parts and (len(cut) > 1 or size + len(text) > PIECE):
            yield _piece(parts)
            parts, size = [], 0
        if len(cut) > 1:
            for k, part in enumerate(cut):
                piece = _piece([part])
                piece.goes_on = k + 1 < len(cut)
                yield piece
        else:
            parts += cut
            size += len(text) + 1
    if parts:
        yield _piece(parts)


def _by_document(texts: list[str | None], wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, gram) of whole documents, those in ``wanted`` buckets if given; a gram may come more than once."""
    held: list[np.ndarray] = []
    for piece in _pieces(texts):
        near = slice(None) if wanted is None else np.flatnonzero(wanted[_bucket(piece.grams)])
        grams, document = piece.grams[near], piece.document[piece.sentence[near]]
        if piece.goes_on or held:
            held.append(np.unique(grams))
            if piece.goes_on:
                continue
            grams = np.unique(np.concatenate(held))
            document = np.full(len(grams), piece.document[0] if len(piece.document) else 0)
            held = []
        yield document, grams


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _mask_of(buckets: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << BUCKET_BITS, dtype=bool)
    mask[buckets] = True
    return mask


def _features(piece: Piece, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) of a piece."""
    if model._mask is None:
        model._mask = _mask_of(_bucket(model.grams))
    near = np.flatnonzero(model._mask[_bucket(piece.grams)])
    grams = piece.grams[near]
    index = np.minimum(np.searchsorted(model.grams, grams), len(model.grams) - 1)
    near, index = near[model.grams[index] == grams], index[model.grams[index] == grams]
    key = np.unique(piece.sentence[near] * len(model.grams) + index)
    return key // max(len(model.grams), 1), key % max(len(model.grams), 1)


def _softplus(z):
    return np.logaddexp(0, z)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scored(piece: Piece, model: Model) -> np.ndarray:
    """z of every sentence of a piece."""
    if not len(model.grams):
        return np.full(len(piece.document), model.bias)
    sentence, index = _features(piece, model)
    return model.bias + np.bincount(sentence, model.weights[index], len(piece.document))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of the labelled documents that are not held out.

    Labels are narrow: up to ``LABELS`` of them (counted) are broadcast, so texts stay where they are.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max(F.col("toxic") == 1).cast("int").alias("y"))
    marks = materialize(marks, "toxicity-labels")
    if marks.count() <= LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    return rows.join(marks, F.col("_id") == F.col("_label_id")).select("text", "y")


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, pos, neg) parts added up by key."""
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = [key]
    for i in (1, 2):
        out.append(np.bincount(at, np.concatenate([p[i] for p in parts]), len(key)).astype(np.int64))
    return tuple(out)


def _counts(train: DataFrame, buckets: np.ndarray | None) -> DataFrame:
    """(k, pos, neg): documents by label that hold each bucket, or, for given buckets, each gram in them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if buckets is None else _mask_of(buckets)
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for document, grams in _by_document(batch.column(0).to_pylist(), wanted):
                if not len(grams):
                    continue
                if wanted is None:
                    key, at, bits = np.arange(1 << BUCKET_BITS), _bucket(grams), BUCKET_BITS
                else:
                    key, at = np.unique(grams, return_inverse=True)
                    bits = int(len(key)).bit_length()
                pair = np.unique(document << bits | at)
                toxic, at = y[pair >> bits] == 1, pair & ((1 << bits) - 1)
                count = [np.bincount(at[some], minlength=len(key)) for some in (toxic, ~toxic)]
                if wanted is None and parts:  # the buckets' counts are added in place
                    for i in (0, 1):
                        parts[0][i + 1][:] += count[i]
                else:
                    parts.append((key, *count))
                if len(parts) > 64:
                    parts = [_merged(parts)]
        if not parts:
            return
        key, pos, neg = parts[0] if wanted is None else _merged(parts)
        some = np.flatnonzero(pos + neg)
        for i in range(0, len(some), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[some[i:i + 65536]]) for c in (key, pos, neg)], names=["k", "pos", "neg"])

    return train.select("text", "y").mapInArrow(work, "k long, pos long, neg long").groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _best(counts: DataFrame, toxic: int, clean: int, top: int, ratio: float) -> np.ndarray:
    """The ``top`` keys that are ``ratio`` times as common in toxic documents as in clean ones, by falling G; ties by key.

    G alone grows with the corpus: weakly tied common grams would fill the model and every document's bag."""
    pos, neg = F.col("pos"), F.col("neg")
    share = (pos + neg) / F.lit(float(toxic + clean))

    def part(seen: Column, of: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (F.lit(float(of)) * share))).otherwise(0.0)

    def rest(seen: Column, of: int) -> Column:
        left = F.lit(of) - seen
        return F.when(left > 0, left * F.log(left / (F.lit(float(of)) * (1 - share)))).otherwise(0.0)

    g = 2 * (part(pos, toxic) + part(neg, clean) + rest(pos, toxic) + rest(neg, clean))
    rows = counts.where(pos * clean > ratio * neg * toxic).withColumn("g", g).where(F.col("g") >= LEAST_G) \
        .orderBy(F.desc("g"), "k").limit(top).select("k").collect()
    return np.array(sorted(r.k for r in rows), dtype=np.int64)


def _bags(train: DataFrame, model: Model) -> DataFrame:
    """(y, plain, sentence, feature): every training document's number of sentences without chosen features, and
    the others' features.  Clean documents are sums over sentences, so theirs without features are one row a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, y = batch.num_rows, batch.column(1).to_numpy(zero_copy_only=False)
            plain, rows, base = np.zeros(size, dtype=np.int64), [], 0
            for piece in _pieces(batch.column(0).to_pylist()):
                sentence, feature = _features(piece, model)
                rows.append((piece.document[sentence], sentence + base, feature))
                base += len(piece.document)
                plain += np.bincount(piece.document, minlength=size) - np.bincount(piece.document[np.unique(sentence)], minlength=size)
            document, sentence, feature = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
            held = np.bincount(document, minlength=size)
            some = np.flatnonzero((held > 0) | (y == 1))
            offsets = pa.array(np.append(0, np.cumsum(held[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (sentence, feature)]
            yield pa.RecordBatch.from_arrays([pa.array(y[some]), pa.array(np.where(y == 1, plain, 0)[some]), *lists],
                                             names=["y", "plain", "sentence", "feature"])
            none = pa.array([[]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([int(plain[y == 0].sum())]), none, none],
                                             names=["y", "plain", "sentence", "feature"])

    return train.select("text", "y").mapInArrow(work, "y int, plain long, sentence array<int>, feature array<int>")


def _gradient(bags: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    """Gradient of the noisy-or loss over all training documents, by weight, the bias last."""
    k = len(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(k + 1)
        for batch in batches:
            y, plain = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held = np.diff(batch.column(2).offsets.to_numpy())
            feature = batch.column(3).flatten().to_numpy()
            document = np.repeat(np.arange(batch.num_rows), held)
            sentence = batch.column(2).flatten().to_numpy()
            new = np.append(True, (np.diff(sentence) != 0) | (np.diff(document) != 0)) if len(sentence) else np.zeros(0, bool)
            at = np.cumsum(new) - 1
            of = document[new]
            z = bias + np.bincount(at, weights[feature], len(of))
            hazard = plain * _softplus(bias) + np.bincount(of, _softplus(z), batch.num_rows)
            with np.errstate(over="ignore"):
                slope = np.where(y == 1, -1 / np.expm1(np.maximum(hazard, 1e-12)), 1.0)
            dz = slope[of] * _sigmoid(z)
            acc[:k] += np.bincount(feature, dz[at], k)
            acc[k] += dz.sum() + (slope * plain).sum() * _sigmoid(bias)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], names=["pos", "v"])

    out = np.zeros(k + 1)
    for r in bags.mapInArrow(work, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r.pos] = r.v
    return out


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the sentence model from the labels of all documents that are not held out."""
    small_batches(docs.sparkSession)
    train = materialize(training_rows(docs, labels), "toxicity-train")
    seen = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    none = np.zeros(0)
    if not toxic:
        return Model(none.astype(np.int64), none, -1000.0)
    grams = none.astype(np.int64)
    if clean:
        buckets = _best(_counts(train, None), toxic, clean, CANDIDATES, LEAST_RATIO / 2)
        if len(buckets):
            grams = _best(_counts(train, buckets), toxic, clean, FEATURES, LEAST_RATIO)
    weights, bias = np.full(len(grams), 0.2), -4.0
    if not len(grams):
        return Model(grams, weights, float(np.log(max(toxic, 1) / max(clean, 1))) - 2.0)
    bags = materialize(_bags(train, Model(grams, weights, bias)), "toxicity-bags")
    point = np.append(weights, bias)
    step, before = np.append(np.full(len(weights), 0.05), 0.5), np.zeros(len(point))
    for _ in range(PASSES):  # resilient steps: each weight's own step grows while its gradient keeps its sign
        slope = _gradient(bags, point[:-1], float(point[-1]))
        slope[:-1] += PENALTY * point[:-1]
        same = slope * before
        step = np.clip(np.where(same > 0, step * 1.3, np.where(same < 0, step * 0.5, step)), 1e-6, 2.0)
        slope = np.where(same < 0, 0.0, slope)
        point = point - np.sign(slope) * step
        before = slope
    return Model(grams, point[:-1], float(point[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hazard = np.zeros(batch.num_rows)
            for piece in _pieces(batch.column(1).to_pylist()):
                hazard += np.bincount(piece.document, _softplus(_scored(piece, model)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(-np.expm1(-hazard))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def located(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The offending sentences: doc_id, place in the text (code points, from 0), score and words."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, rows = batch.column(1).to_pylist(), batch.column(0).to_pylist(), []
            for piece in _pieces(texts):
                p = _sigmoid(_scored(piece, model))
                for s in np.flatnonzero(p >= least).tolist():
                    d, a, b = int(piece.document[s]), int(piece.start[s]), int(piece.end[s])
                    rows.append((ids[d], a, b, float(p[s]), texts[d][a:b].strip()))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "end", "score", "sentence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, start long, end long, score double, sentence string")
