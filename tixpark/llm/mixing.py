"""Mixing sources to target weights, by blocks of tokens.

The documents of a source, in a fixed pseudorandom order, are one stream of
words packed into blocks of ``block`` words.  Targets follow the weights and
stop at ``max_epochs`` times a source's size; what is over is shared again by
weight.  The mix is a sequence of output shards of ``shard_slots`` blocks; each
shard draws how many blocks it takes from each source from a multinomial, and
the draws are settled to the targets (slots drawn beyond a source's total are
dropped, those it still lacks go to shards by hash).  The slots of a source are
numbered through the shards; slot j is block ``permutation_e(j mod blocks)`` of
epoch ``e = j div blocks``, a keyed pseudorandom permutation of the source's
block numbers for each epoch.  Joining the slots with the packed blocks by
(source, block) gives the mix.

Nothing random but hashes of seeds and indexes: reruns agree.

Defined cases: null and blank texts have size 0 and are never taken; a null
source is a source of its own, last in order; a source of size 0 has target 0;
an empty table gives an empty mix; repeated rows are further documents, numbered
once in a written table, so that any number of them is spread; of rows equal in
doc_id, source and text, which takes which place is open; other columns, whatever
their names, are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize, running_total

BLOCK, SHARD_SLOTS, MAX_EPOCHS, SEED = 128, 2048, 3, 17


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None) -> DataFrame:
    """``row, doc_id, source, size`` and a hash of the text that breaks ties; rows are numbered, unless ``row`` is their number."""
    t = F.coalesce(F.col(text), F.lit(""))
    row = F.monotonically_increasing_id() if row is None else row
    d = docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), t.alias("t"))
    d = d.select("row", "doc_id", "source", "t", F.split("t", r"[\x20\x09-\x0D]+").alias("cut"))
    # blanks at either end leave an empty part there
    size = F.size("cut") - (F.col("cut")[0] == "").cast("int") - ((F.size("cut") > 1) & (F.element_at("cut", -1) == "")).cast("int")
    return d.select("row", "doc_id", "source", size.cast("long").alias("size"), F.xxhash64("t").alias("tie"))


def targets(sources: DataFrame, cycle: int = 3, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``code`` (place by code point, null last), ``weight`` and ``target`` to ``sources (source, source_size)``.

    With all sources ordered by cap / weight, the sources that stop at their
    cap are a prefix: those for which the level that the rest would share is
    above the cap.  One row per source, so windows over all of them are small.
    """
    s = sources.withColumn("code", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.pmod("code", F.lit(cycle)) + 1).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "code")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    s = s.withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "code", "level"))).over(every)["level"]
    s = s.withColumn("shared", F.coalesce(level * F.col("weight"), F.col("cap")).cast("double"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("shared"), F.col("cap").cast("double")))
    return s.withColumn("target", target).select("source", "code", "weight", "source_size", "target")


def planned(sources: DataFrame, block: int) -> DataFrame:
    """Add ``blocks`` (of the source) and ``slots`` (blocks the mix takes): whole epochs, then the nearest count of further blocks."""
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    more = F.least(F.round((F.col("target") - epochs * F.col("source_size")) / block).cast("long"), F.col("blocks"))
    return s.withColumn("slots", epochs * F.col("blocks") + F.coalesce(more, F.lit(0)))


def packed(rows: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """The packed blocks as pieces: ``code, block, row, doc_id, start, size, from, upto`` (words of the document in the block).

    A document without words has one row with a null block.  Repeated rows are
    told apart by their number ``nth`` among themselves, so the stream does not
    depend on how the table is split.
    """
    coded = rows.join(sources.select(F.col("source").alias("_s"), "code"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    coded = materialize(coded.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "mix-coded")
    buckets = buckets_for(coded.count())
    numbered = running_total(coded, ["code", "id", "tie"], ["row"], F.lit(1), "nth", buckets)
    coded = materialize(numbered.drop("id"), "mix-sized")
    placed = running_total(coded, ["code"], ["doc_id", "tie", "nth"], F.col("size"), "start", buckets)
    last = F.when(F.col("size") > 0, F.floor((F.col("start") + F.col("size") - 1) / block))
    first = F.when(F.col("size") > 0, F.floor(F.col("start") / block))
    p = placed.withColumn("block", F.explode_outer(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return p.select("code", "block", "row", "doc_id", "start", "size", begin.alias("from"), end.alias("upto"))


def drawn(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``shard, code, slot``: the settled multinomial draws, one row per slot.

    The driver holds one row per source (``blocks`` and ``slots``), nothing per
    shard or slot.
    """
    spark = sources.sparkSession
    plan = sources.filter("slots > 0").select("code", "slots").orderBy("code").collect()
    codes, slots = [r["code"] for r in plan], np.array([r["slots"] for r in plan], np.int64)
    total = int(slots.sum())
    shards = -(-total // shard_slots) if total else 0

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard in b["id"]:
                size = min(shard_slots, total - int(shard) * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, slots / total)
                out += [(shard, codes[k], c) for k, c in enumerate(counts) if c]
            yield pd.DataFrame(out, columns=["shard", "code", "n"])

    draws = materialize(spark.range(shards).mapInPandas(draw, "shard long, code int, n long"), "mix-draws")
    numbered = running_total(draws, ["code"], ["shard"], F.col("n"), "base", buckets_for(draws.count(), least=16))
    wanted = sources.select("code", "slots")
    numbered = numbered.join(wanted, "code").withColumn("n", F.least("n", F.greatest(F.col("slots") - F.col("base"), F.lit(0))))
    out = numbered.filter("n > 0").withColumn("slot", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)))
    # what the draws left short, in runs of a shard's length
    got = draws.groupBy("code").agg(F.sum("n").alias("got"))
    short = wanted.join(got, "code", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    runs = short.withColumn("run", F.explode(F.sequence(F.col("got"), F.col("slots") - 1, F.lit(shard_slots))))
    rest = runs.withColumn("slot", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + shard_slots, F.col("slots")) - 1)))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("code", "slot", F.lit(seed)), F.lit(max(shards, 1))))
    return out.select("shard", "code", "slot").union(rest.select("shard", "code", "slot"))


def _permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of 0..n-1 for each row: four Feistel rounds over the next even power of two, walked into range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right, h, m, k = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo]
            for r in range(4):
                f = (right + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k
                f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & m)
            x[todo] = (left << h) | right
            todo[todo] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


def mapped(slots: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """``shard, code, slot, block``: each slot's block by the permutation of its source and epoch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, slot = b["blocks"].to_numpy(), b["slot"].to_numpy()
            epoch = slot // n
            pairs = {p: xxhash.xxh64_intdigest(f"{seed}/{p[0]}/{p[1]}") for p in set(zip(b["code"].tolist(), epoch.tolist()))}
            key = np.fromiter((pairs[p] for p in zip(b["code"].tolist(), epoch.tolist())), np.uint64, len(b))
            yield pd.DataFrame({"shard": b["shard"], "code": b["code"], "slot": slot, "block": _permuted(slot % n, n, key)})

    s = slots.join(sources.select("code", "blocks"), "code").select("shard", "code", "slot", "blocks")
    return s.mapInPandas(run, "shard long, code int, slot long, block long")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources with their targets, packed pieces, slots of the mix with their blocks)."""
    rows = materialize(sized(docs, doc_id, text, source, row), "mix-rows")
    sources = materialize(planned(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), block), "mix-sources")
    return sources, packed(rows, sources, block), mapped(drawn(sources, shard_slots, seed), sources, seed)


def _taken_pieces(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The pieces with ``times``: how often the mix takes their block."""
    times = slots.groupBy("code", "block").agg(F.count(F.lit(1)).alias("times"))
    return pieces.join(times, ["code", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def taken(docs: DataFrame, block: int = BLOCK, **columns) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken``."""
    sources, pieces, slots = mix(docs, block, **columns)
    p = _taken_pieces(pieces, slots)
    words = F.coalesce((F.col("upto") - F.col("from")) * F.col("times"), F.lit(0))
    per = p.groupBy("row").agg(*[F.first(c).alias(c) for c in ("code", "doc_id", "size")], F.sum(words).alias("taken"))
    return per.join(sources, "code").select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: up to ``MAX_EPOCHS`` rows per document.

    Row c of a document holds the words of the blocks that the mix takes c times
    or more, cut from the whole text between word ends, so each word occurs as
    often as the mix takes it.  ``n_chars`` (where it exists) is that of the
    new text.  Documents of which nothing is taken have no row.
    """
    body = F.struct(*[F.col("`" + n.replace("`", "``") + "`").alias(n) for n in docs.columns])
    kept = materialize(docs.select(F.monotonically_increasing_id().alias("row"), body.alias("body")), "mix-docs")
    _, pieces, slots = mix(kept.select("row", "body.doc_id", "body.text", "body.source"), block, seed=seed, row=F.col("row"))
    p = _taken_pieces(pieces, slots).filter("times > 0")
    p = p.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    spans = p.groupBy("row", "copy").agg(F.sort_array(F.collect_list(F.struct("from", "upto"))).alias("spans"),
                                         (F.sum(F.col("upto") - F.col("from")) == F.first("size")).alias("whole"))
    d = kept.join(spans, "row").withColumn("text", F.col("body.text"))
    d = d.withColumn("words", F.when(~F.col("whole"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"))))
    d = d.withColumn("text", F.expr("CASE WHEN whole THEN text ELSE "
                                    "array_join(transform(spans, s -> array_join(slice(words, CAST(s.from + 1 AS INT), CAST(s.upto - s.from AS INT)), '')), '') END"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return d.select(*[new.get(n, F.col("body").getField(n)).alias(n) for n in docs.columns])
