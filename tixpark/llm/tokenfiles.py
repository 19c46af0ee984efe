"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Documents are put in ascending doc_id order over range partitions; a task
encodes its documents and writes one file.  Layout (little-endian):

    magic "TIDS0001" | 8 bytes dictionary hash | frames | index | trailer
    frame: a zstandard frame of the ids as uint32, or the ids as they are if that is shorter
    index: per document has_id u8, doc_id i64, offset u64, length u32, n_tokens u32, packed u8
    trailer: index offset u64 | documents u64 | tokens u64 | magic

A short document is read with one seek: its index entry, its frame and the
dictionary, whose hash every file repeats.  The dictionary is trained on the
serialised ids of a bounded sample: about ``SAMPLE_DOCS`` documents, by
hash, among those of at most ``SAMPLE_CHARS`` characters (a dictionary is for
short documents).  Everything else covers all rows.

Ids come from the tokenizers library.  A word never merges with its neighbours
across white space, so each word's ids are asked for once and remembered.

Files get their final name by renaming a file that is whole, named by
partition: a repeated task replaces its file by the same bytes.

Defined cases: a null or empty text is the end id alone; rows of a null doc_id
come first; repeated doc_ids keep every row, ordered by their ids' checksum; an
empty table gives no rows; ids are cut nowhere, however long a text is.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, small_batches

MAGIC = b"TIDS0001"
ENTRY = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4"), ("packed", "u1")])
TRAILER = "<QQQ8s"
TRAILER_BYTES = struct.calcsize(TRAILER)
#: Bytes of text that a file takes at most, about.
FILE_BYTES = 64 << 20
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 1000, 20_000, 65_536, 1
MEMO_WORDS = 400_000
#: Characters of texts whose words are looked up together.
GROUP_CHARS = 4_000_000
#: Marks that are a token apart after a letter (no apostrophe: it may begin one).
MARKS = ".,!?;:|%&#*$@()[]{}\"-_/\\+=<>~^`"
#: Blanks to Python's split that are none to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MANIFEST = "part int, path string, documents long, tokens long, bytes long"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that Spark names by URI or path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _byte_letters() -> dict[int, str]:
    """Letters of a byte-level vocabulary: printable bytes of latin-1 stand for themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class _Memory:
    """Serialised ids by word, in two generations of bounded size: words in use move to the young one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, ids: dict[str, bytes | None]) -> list[str]:
        """Put in what is known; the words that are not."""
        if len(self.young) >= MEMO_WORDS:
            self.young, self.old = {}, self.young
        unknown, young, old = [], self.young, self.old
        for w in ids:
            known = young.get(w)
            if known is None:
                known = old.get(w)
                if known is None:
                    unknown.append(w)
                    continue
                young[w] = known
            ids[w] = known
        return unknown


def _ends_with_letter(word: str) -> bool:
    """Whether the word ends with a letter also after the tokenizer's normal form and lower case: some letters
    become a letter and a mark, which the marks behind them would join."""
    last = word[-1]
    return last.isalpha() and (last.isascii() or unicodedata.normalize("NFC", unicodedata.normalize("NFC", last).lower())[-1].isalpha())


class Encoder:
    """Whole texts to serialised ids (uint32), with a bounded memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.cores = _Memory(), _Memory()

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | None:
        """Ids of a lower-case word of letters below U+0100, by the tokenizer's model alone: such a word is one
        piece in normal form already.  None for any other word."""
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0100"):
            return None
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, ids: dict[str, bytes | None], unknown: list[str]) -> None:
        """Ids of the unknown words.  Marks after a letter are a token apart, and the
        tokenizer lowers case, so words are looked up without either first."""
        cores, tails = [], []
        for w in unknown:
            core = w.rstrip(MARKS)
            if not core or not _ends_with_letter(core):
                core = w
            tails.append(w[len(core):])
            # below U+0100 lower case is one letter for one, wherever it stands
            cores.append(core.lower() if core.isascii() or max(core) < "\u0100" else core)
        parts: dict[str, bytes | None] = dict.fromkeys(cores)
        parts.update(dict.fromkeys(tails))
        parts[""] = b""
        new = {w: self._word(w) for w in self.cores.fill(parts)}
        ask = [w for w, raw in new.items() if raw is None]
        new.update(zip(ask, self._ask(ask)))
        parts.update(new)
        self.cores.young.update(new)
        new = dict(zip(unknown, map(add, map(parts.__getitem__, cores), map(parts.__getitem__, tails))))
        ids.update(new)
        self.words.young.update(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            # as many texts as a group may hold; their words are looked up once
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_CHARS):
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            out += [b"".join(self._group(list(_pieces(group[0]))))] if size > GROUP_CHARS else self._group(group)
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) > 2 * GROUP_CHARS:  # pieces of one long text
            return [raw for t in texts for raw in self._group([t])]
        # a special token's name may hold what else ends a token, and some blanks to Python are none to the tokenizer
        plain = ["<|" not in t and not _SEPARATORS.search(t) for t in texts]
        lists = [t.split() for t, p in zip(texts, plain) if p]
        ids: dict[str, bytes | None] = dict.fromkeys(chain.from_iterable(lists))
        unknown = self.words.fill(ids)
        if unknown:
            self._learn(ids, unknown)
        known = (b"".join(map(ids.__getitem__, words)) for words in lists)
        return [next(known) if p else self._ask([t])[0] for t, p in zip(texts, plain)]


def _pieces(text: str) -> Iterator[str]:
    """A long text cut at blanks, where no token can reach across."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + GROUP_CHARS) if at + GROUP_CHARS < len(text) else -1
        yield text[at:] if end < 0 else text[at:end]
        at = len(text) if end < 0 else end


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder: the tasks of a worker share what it has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """A zstandard dictionary from the ids of a bounded sample (empty where there is too little to learn from)."""
    small_batches(docs.sparkSession)
    length = F.length(F.col(text))
    rows = max(docs.count(), 1)
    # a cut through the hashes, not a sort: each task keeps its few rows; equal rows count once
    cut = (1 << 32) if rows <= SAMPLE_DOCS else (1 << 32) * SAMPLE_DOCS // rows
    sample = (docs.filter((length > 0) & (length <= SAMPLE_CHARS)).select(F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("h"))
              .filter(F.pmod("h", F.lit(1 << 32)) < cut).groupBy("h").agg(F.first("text").alias("text")).select("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples = [raw for b in batches for raw in encoder_for(tokenizer_path).encode(list(b["text"]))]
        try:
            yield pd.DataFrame({"dictionary": [zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()]})
        except zstandard.ZstdError:  # too few samples
            yield pd.DataFrame({"dictionary": [b""]})

    # one task trains on the bounded sample; the driver gets the dictionary
    row = sample.coalesce(1).mapInPandas(run, "dictionary binary").first()
    return bytes(row["dictionary"]) if row else b""


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of ``docs`` below ``folder``; the manifest, one row per file."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    dictionary = train_dictionary(docs, tokenizer_path, doc_id, text)
    shared = spark.sparkContext.broadcast(dictionary)
    target, path = place(folder)
    target.create_dir(path, recursive=True)
    with target.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        words = shared.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        encoder = encoder_for(tokenizer_path)
        out, at = place(folder)
        final, draft = f"{at}/part-{part:06d}.tids", f"{at}/_draft-{part:06d}-{attempt}"
        entries, offset, tokens = [], len(MAGIC) + 8, 0
        stream = None
        for b in batches:
            if not len(b):
                continue
            if stream is None:
                stream = out.open_output_stream(draft)
                stream.write(MAGIC + xxhash.xxh64_digest(words))
            ids = encoder.encode(["" if t is None else t for t in b["text"]])
            known = b["doc_id"].notna().to_numpy()
            numbers = b["doc_id"].fillna(0).astype("int64").to_numpy()
            rows = np.zeros(len(b), ENTRY)
            for i, raw in enumerate(ids):
                raw += end
                frame = packer.compress(raw)
                packed = len(frame) < len(raw)
                stream.write(frame if packed else raw)
                size = len(frame) if packed else len(raw)
                rows[i] = (known[i], numbers[i], offset, size, len(raw) // 4, packed)
                offset += size
                tokens += len(raw) // 4
            entries.append(rows)
        if stream is None:
            return
        index = np.concatenate(entries)
        stream.write(index.tobytes())
        stream.write(struct.pack(TRAILER, offset, len(index), tokens, MAGIC))
        stream.close()
        out.move(draft, final)
        yield pd.DataFrame({"part": [part], "path": [final], "documents": [len(index)], "tokens": [tokens],
                            "bytes": [offset + index.nbytes + TRAILER_BYTES]})

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_t", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = d.repartitionByRange(n, "doc_id", "_t").sortWithinPartitions("doc_id", "_t").select("doc_id", "text")
    return materialize(ordered.mapInPandas(run, _MANIFEST), "tids-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read all files of a manifest: ``doc_id, start, n_tokens, ids_crc32, part, at``, start counted over all files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # one file per task or so
    files = files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()), "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, at = place(folder)
        with source.open_input_file(f"{at}/dictionary") as f:
            words = f.read()
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for b in batches:
            for part, path, base in zip(b["part"], b["path"], b["base"]):
                with source.open_input_file(path) as f:
                    if f.read(len(MAGIC) + 8) != MAGIC + xxhash.xxh64_digest(words):
                        raise ValueError(f"{path}: not a token file of this dictionary")
                    end = f.size() - TRAILER_BYTES
                    f.seek(end)
                    index_at, documents, _, magic = struct.unpack(TRAILER, f.read(TRAILER_BYTES))
                    if magic != MAGIC:
                        raise ValueError(f"{path}: cut off")
                    f.seek(index_at)
                    index = np.frombuffer(f.read(end - index_at), ENTRY)
                    starts = int(base) + np.concatenate(([0], np.cumsum(index["n_tokens"].astype(np.int64))[:-1]))
                    f.seek(len(MAGIC) + 8)
                    for lo in range(0, documents, 4096):
                        rows = index[lo:lo + 4096]
                        sums = np.empty(len(rows), np.int64)
                        for i, (size, n, packed) in enumerate(zip(rows["length"].tolist(), rows["n_tokens"].tolist(), rows["packed"].tolist())):
                            raw = f.read(size)
                            ids = unpacker.decompress(raw, max_output_size=4 * n) if packed else raw
                            if len(ids) != 4 * n:
                                raise ValueError(f"{path}: document {lo + i} has other tokens than its index says")
                            sums[i] = zlib.crc32(ids)
                        numbers = pd.Series(pd.array(rows["doc_id"].astype(np.int64), "Int64")).mask(rows["has_id"] == 0)
                        yield pd.DataFrame({"doc_id": numbers, "start": starts[lo:lo + 4096], "n_tokens": rows["n_tokens"].astype(np.int64),
                                            "ids_crc32": sums, "part": np.full(len(rows), part, np.int32), "at": np.arange(lo, lo + len(rows))})

    return files.select("part", "path", "base").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, at long")


def document_ids(folder: str, path: str, at: int) -> np.ndarray:
    """The ids of one document, by a seek to its index entry and one to its frame."""
    source, root = place(folder)
    with source.open_input_file(f"{root}/dictionary") as f:
        words = f.read()
    with source.open_input_file(path) as f:
        f.seek(f.size() - TRAILER_BYTES)
        index_at, documents, _, _ = struct.unpack(TRAILER, f.read(TRAILER_BYTES))
        if not 0 <= at < documents:
            raise IndexError(at)
        f.seek(index_at + at * ENTRY.itemsize)
        entry = np.frombuffer(f.read(ENTRY.itemsize), ENTRY)[0]
        f.seek(int(entry["offset"]))
        raw = f.read(int(entry["length"]))
    if entry["packed"]:
        raw = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompress(
            raw, max_output_size=4 * int(entry["n_tokens"]))
    return np.frombuffer(raw, "<u4")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` and read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    return read(spark, folder, write(docs, folder, tokenizer_path, end_id)).select("doc_id", "start", "n_tokens", "ids_crc32")
