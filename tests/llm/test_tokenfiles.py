"""Token files: ids equal the tokenizer's, exact round trip, single documents, damaged files."""

import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tixpark.llm import tokenfiles
from tixpark.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "the cat, the cat. The CAT!", "don't we'll it's", "a\x1cb \x1dc", "<|endoftext|> x <|startoftext|>", "Äpfel é é naïve ΑΣ ας İ", "1,234.5 ... ,., end.",
         "x y z​q", "日本語 テキスト 한국어", "😀😀 ok.", "word " * 3000, "tab\tnew\nline\r\n", "A.B,C. a.b,c.", "É. É, é.", "́a b́.", "ﬁ ﬂ Ⅷ ² x². ½,"]


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_remembered_give_the_same_ids(direct, monkeypatch):
    encoder = tokenfiles.Encoder(tokenizer_path())
    texts = [t or "" for t in TEXTS] * 2
    for memo, chars in ((400_000, 2_000_000), (8, 50)):  # also where it must forget, and cut long texts
        monkeypatch.setattr(tokenfiles, "MEMO_WORDS", memo)
        monkeypatch.setattr(tokenfiles, "GROUP_CHARS", chars)
        for t, raw in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == direct(t), t


def test_every_letter_before_a_mark(direct):
    """All code points that Python calls letters, followed by marks."""
    texts = [f"a{chr(c)}{m} b" for c in range(0x80, 0x110000) if chr(c).isalpha() for m in "?;"]
    encoder = tokenfiles.Encoder(tokenizer_path())
    want = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, raw, e in zip(texts, encoder.encode(texts), want) if np.frombuffer(raw, "<u4").tolist() != e.ids]
    assert not wrong, wrong[:20]


def rows_of(direct, docs):
    return {i: direct(t) + [2] for i, t in docs}


def test_round_trip(spark, direct, tmp_path):
    docs = [(i * 3, t) for i, t in enumerate(TEXTS * 4)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, start string").repartition(7)
    ids = rows_of(direct, docs)
    got = tokenfiles.round_trip(frame, tokenizer_path()).orderBy("doc_id").collect()
    start = 0
    for r in got:
        raw = np.array(ids[r.doc_id], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(raw))
        start += r.n_tokens
    assert len(got) == len(docs)


def test_single_documents_by_the_index(spark, direct, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    docs = [(i, f"document {i} " + "some words, again. " * (i % 40)) for i in range(300)]
    manifest = tokenfiles.write(spark.createDataFrame(docs, "doc_id long, text string"), folder, tokenizer_path())
    paths = {r.part: r.path for r in manifest.collect()}
    ids = rows_of(direct, docs)
    rows = tokenfiles.read(spark, folder, manifest).collect()
    assert len(rows) == 300
    for r in rows[::17]:
        assert tokenfiles.document_ids(folder, paths[r.part], r["at"]).tolist() == ids[r.doc_id]
    with pytest.raises(IndexError):
        tokenfiles.document_ids(folder, paths[rows[0].part], 10_000)
    # the dictionary helps: files are smaller than the ids
    assert sum(r.bytes for r in manifest.collect()) < sum(4 * len(v) for v in ids.values()) / 2


def test_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([(None, "b"), (5, "x y"), (5, "x y"), (5, "z"), (None, None), (-3, "the")], "doc_id long, text string")
    got = tokenfiles.round_trip(frame, tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("-3", 2), ("5", 2), ("5", 3), ("5", 3), ("None", 1), ("None", 2)]
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in in_order] == [None, None, -3, 5, 5, 5]
    assert [r.start for r in in_order] == np.concatenate(([0], np.cumsum([r.n_tokens for r in in_order])[:-1])).tolist()
    assert tokenfiles.round_trip(frame.limit(0), tokenizer_path()).count() == 0


def test_a_foreign_dictionary_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = tokenfiles.write(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), folder, tokenizer_path())
    (tmp_path / "tokens/dictionary").write_bytes(struct.pack("<I", 7))
    with pytest.raises(Exception, match="not a token file of this dictionary|dict"):
        tokenfiles.read(spark, folder, manifest).collect()
