"""WARC: exact round trip, revisits, and ranges that own each record once wherever they are cut."""

import base64
import gzip
import hashlib
import os
import random

from pyarrow import fs

from tixpark.llm import warc


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.example/ä?q={i} x", "".join(rng.choices("<p>aé\r\n", k=rng.randrange(3000)))) for i in range(60)]
    rows += [(100 + i, "http://copy.example/", "same payload") for i in range(50)]
    rows += [(200, None, None), (201, "", ""), (None, "u", "same payload"), (None, None, None), (149, "twice", "same payload"), (300, "magic", "\x1f\x8b\x08" * 10)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(4)


def test_round_trip(spark):
    rows, frame = pages(spark)
    got = warc.round_trip(frame).collect()
    assert len(got) == len(rows)
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", -1), i)
    by_id = {}
    for i, _, h in rows:
        by_id.setdefault(i, []).append(h or "")
    for r in got:
        h = next(x for x in by_id[r.page_id] if base64.b32encode(hashlib.sha1(x.encode()).digest()).decode() == r.payload_digest)
        assert r.payload_bytes == len(h.encode())
        response = r.page_id is None or newest[h] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", newest[h]))
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_payloads_and_small_ranges(spark, tmp_path):
    rows, frame = pages(spark)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(frame, folder)
    whole = warc.read(spark, folder, manifest).collect()
    for size in (97, 1000):
        assert sorted(map(str, warc.read(spark, folder, manifest, range_bytes=size).collect())) == sorted(map(str, whole))
    texts = {}
    for i, u, h in rows:
        texts.setdefault(i, []).append((u, (h or "").encode()))
    for r in whole:
        if r.record_type == "response":
            assert (r.url, bytes(r.payload)) in texts[r.page_id]
    # any gzip reader sees the same records
    data = b"".join(gzip.decompress((tmp_path / "warc" / n).read_bytes()) for n in os.listdir(tmp_path / "warc") if n.endswith(".gz"))
    assert data.count(b"WARC/1.1\r\n") == len(rows)


def test_least_bytes(spark):
    frame = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "long enough"), (4, "a", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.round_trip(frame, least_bytes=5).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_false_magic_inside_a_member_is_passed_over(tmp_path):
    raw = [warc._member(warc._record(i, f"u{i}", os.urandom(500) + b"\x1f\x8b\x08\x00" * 20, None, False)) for i in range(6)]
    stored = gzip.compress(warc._record(9, "u9", b"\x1f\x8b\x08" + raw[0], None, False), 0)  # stored: its bytes hold a whole member
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + raw[0] + stored + b"".join(raw[1:]))
    local = fs.LocalFileSystem()
    size = path.stat().st_size
    heads = [h for _, h, _ in warc.records_in(local, str(path), 0, size)]
    assert [warc._id(warc._fields(h)["warc-record-id"]) for h in heads] == [0, 9, 1, 2, 3, 4, 5]
