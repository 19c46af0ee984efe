"""K-d tree sharding: all rows once, near equal bytes, gapless slots, groups, edge cases."""

import zlib
from collections import Counter, defaultdict

from tixpark.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string"


def corpus(n=3000):
    rows = []
    for i in range(n):
        size = 20 + (i * 7919) % 400
        source = "hot" if i % 3 == 0 else f"src{i % 11}"
        rows.append((i, f"t{i} " + "é" * size, ["en", "de", None][i % 3], source, size, "x"))
    rows += [(n + i, "copy of one text", "en", "hot", 16, "x") for i in range(n // 2)]
    return rows


def test_shards(spark):
    rows = corpus()
    got = sharding.sharded(spark.createDataFrame(rows, SCHEMA).repartition(6), leaves=40).collect()
    text = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    size, slots, copies = Counter(), defaultdict(list), Counter()
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        copies[r.shard] += text[r.doc_id].startswith("copy")
    assert sorted(size) == list(range(40))
    mean = sum(size.values()) / 40
    assert max(size.values()) - min(size.values()) < 0.06 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # a group of equal texts is cut only where its size demands it
    assert sum(n > 0 for n in copies.values()) <= 2 + -(-1500 * 32 // int(mean)) + 1


def test_target_bytes_and_reruns(spark):
    docs = spark.createDataFrame(corpus(400), SCHEMA)
    total = docs.selectExpr("sum(octet_length(text) + 16)").first()[0]
    first = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs, target_bytes=total // 7).collect()}
    assert len({s for _, s, _ in first}) == 8
    assert first == {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs.repartition(3), target_bytes=total // 7).collect()}


def test_repeated_rows_are_cut_through(spark):
    rows = corpus(1200) + [(None, "one row again and again", "en", "hot", 23, "x")] * 900
    size = Counter()
    for r in sharded_rows(spark, rows):
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(size.values()) - min(size.values()) < 0.12 * mean


def sharded_rows(spark, rows):
    return sharding.sharded(spark.createDataFrame(rows, SCHEMA).repartition(5), leaves=40).collect()


def test_edge_cases(spark):
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, ""), (1, "", "en", "a", 0, ""), (2, "x" * 100000, "en", "a", 100000, "")]
    got = sharding.sharded(spark.createDataFrame(rows, SCHEMA), leaves=40).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter({(None, 16, 0): 1, (1, 16, 0): 2, (2, 100016, zlib.crc32(b"x" * 100000)): 1})
    assert all(0 <= r.shard < 40 for r in got)
    assert sharding.sharded(spark.createDataFrame([], SCHEMA), leaves=40).count() == 0
    # no metadata but the size
    assert sharding.sharded(spark.createDataFrame([(i, "ab" * i) for i in range(50)], "doc_id long, text string"), leaves=3).select("shard").distinct().count() == 3
