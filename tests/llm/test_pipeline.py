"""The pipeline: every stage against a brute-force version of its own input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tixpark.llm.common import materialize
from tixpark.llm.queries import tokenizer_path

from test_neardup import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    common = ["the", "of", "and", "to", "a", "in", "is", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.25 else "".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(1)
    items = [(i, prose(rng, 30)) for i in range(4)]
    docs = [(i, prose(rng, rng.randrange(60, 300)), "en", f"s{i % 4}" if i % 3 else "hot") for i in range(80)]
    docs += [(100 + i, docs[i][1], "en", "copy") for i in range(0, 20)]
    docs += [(200 + i, docs[i][1] + " " + prose(rng, 2), "en", "near") for i in range(20, 40)]
    docs += [(300 + i, prose(rng, 80) + " " + items[i][1] + " " + prose(rng, 40), "en", "leak") for i in range(4)]
    docs += [(400, None, None, None), (401, "too short", "en", "s1"), (402, re.sub(" ", "%%% ", prose(rng, 200)), "en", "s1")]
    folder = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], folder), f"test-{name}"))
    return folder, tables, items


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_kept_rows(spark, stages):
    folder, (documents, good, single, clean, mixed, tokens), items = stages
    for df in (good, single, clean, mixed):
        assert df.columns == documents.columns
    assert ids(documents) - ids(good) == {400, 401, 402}
    rows = {r.doc_id: r.text for r in good.collect()}
    components = brute(list(rows.items()), 5, 80)
    assert ids(single) == {d for d, (_, c) in components.items() if c == d}
    texts = {r.doc_id: r.text for r in single.collect()}
    assert ids(clean) == {d for d, t in texts.items() if not any(x in t for _, x in items)} and ids(single) - ids(clean) == {300, 301, 302, 303}


def test_mix_and_files(spark, stages):
    folder, (_, _, _, clean, mixed, tokens), _ = stages
    sizes, taken = Counter(), Counter()
    for r in clean.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    from test_mixing import plain_targets
    want = plain_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 256 for s in sizes)
    t = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for r in mixed.collect():
        i = t.encode(r.text, add_special_tokens=False).ids + [2]
        expected[r.doc_id, len(i), zlib.crc32(np.array(i, "<u4").tobytes())] += 1
    got = tokens.orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()


def test_run_and_registration(spark, stages):
    folder, tables, _ = stages
    a, b = (sorted(map(str, x.collect())) for x in (corpus_pipeline.run(spark, folder), tables[-1]))
    assert a == b
    names = [re.match(r"op(\d+)_", n) for n in __spark_entry__.queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
