"""The whole scoring chain as one persisted pipeline.

A chain goes from the export's raw columns to a class name: text steps, unit
weights of grams over a fitted vocabulary, (the union of a word and a character
block,) classifier, label names.  Every stage is a Spark ML stage or
a small transformer of this module with readable and writable parameters, so
``PipelineModel.save`` / ``load`` hold all of it.  Stages work in the row;
the vocabulary (bounded by ``max_features``) and the coefficients are the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import fixed
from ..functions import text as tx
from ..session import written
from . import evaluate as ev
from . import features as fe
from . import models as md
from . import projections as pj


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer from ``inputCol`` to ``outputCol`` whose parameters are saved with it."""

    inputCol = Param(Params._dummy(), "inputCol", "input column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        self._set(**values)      # unset (null) ones are left out

    def _of(self, name: str):
        return self.getOrDefault(getattr(self, name))


class TicketText(_Stage):
    """The text that a model reads.  ``style``: ``filled`` (P2 + F5), ``present`` (P1 + F1) or ``core``."""

    fields = Param(Params._dummy(), "fields", "text columns, in order", TypeConverters.toListString)
    style = Param(Params._dummy(), "style", "filled, present or core", TypeConverters.toString)

    def __init__(self, fields=None, style="filled", outputCol="texto"):
        super().__init__(fields=fields, style=style, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, fields = self._of("outputCol"), self._of("fields")
        if self._of("style") == "core":
            description, short = fields
            core = [tx.strip_boilerplate(tx.mask_entities(pj.col_or(df, c))) for c in (description, short)]
            return df.withColumns({"_desc": core[0], "_short": core[1]}) \
                .withColumn(out, tx.choose_text(F.col("_desc"), F.col("_short"))).drop("_desc", "_short")
        if self._of("style") == "present":
            x = pj.unify_text_skipnull(df, fields, out=out)
            return x.withColumn(out, tx.normalize_nfkc(F.col(out)))
        x = pj.unify_text_fill(df, fields, out=out, raw_copy=None)
        return x.withColumn(out, tx.clean_text(F.col(out)))


class Weights(_Stage):
    """A text to the unit vector of its word or character grams over a fitted vocabulary: counts (1 + ln of them, if
    sublinear) times idf (M1, M2, M4).  In Arrow batches; no row holds the array of its grams."""

    kind = Param(Params._dummy(), "kind", "word or char", TypeConverters.toString)
    ngram = Param(Params._dummy(), "ngram", "least and greatest length", TypeConverters.toListInt)
    sublinear = Param(Params._dummy(), "sublinear", "1 + ln of counts", TypeConverters.toBoolean)
    stripAccents = Param(Params._dummy(), "stripAccents", "fold accents", TypeConverters.toBoolean)
    terms = Param(Params._dummy(), "terms", "the vocabulary, in index order", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "idf of every term", TypeConverters.toListFloat)

    def __init__(self, inputCol=None, outputCol=None, kind="word", ngram=None, sublinear=False, stripAccents=False, terms=None, idf=None):
        super().__init__(inputCol=inputCol, outputCol=outputCol, kind=kind, ngram=ngram, sublinear=sublinear, stripAccents=stripAccents, terms=terms, idf=idf)

    def _transform(self, df: DataFrame) -> DataFrame:
        text, out, terms = F.col(self._of("inputCol")), self._of("outputCol"), self._of("terms")
        words, size = self._of("kind") == "word", len(self._of("terms"))
        symbols = fe.word_tokens(text, self._of("stripAccents")) if words else fe.char_text(text)
        weigh = fe.weigher(df.sparkSession, terms, self._of("idf"), words, self._of("ngram"), self._of("sublinear"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = []

            def places():
                for batch in batches:
                    now[:] = [batch]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.columns[-1]], names=["doc", "symbols"])

            for at, doc, idx, w in weigh(places()):
                part = now[0].slice(at[0].as_py(), len(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], fe.sparse_column(len(at), size, doc, idx, w)], names=[*part.schema.names[:-1], out])

        return df.withColumn("_symbols", symbols).mapInArrow(work, StructType([*df.schema.fields, StructField(out, VectorUDT())]))


class KeepColumns(_Stage):
    """Drop a chain's working columns."""

    working = Param(Params._dummy(), "working", "columns to drop", TypeConverters.toListString)

    def __init__(self, working=None):
        super().__init__(working=working)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self._of("working"))


class MacroF1(Evaluator):
    """Macro F1 from the counts of (label, prediction), which are written: rows are scored once."""

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = written(ev.confusion_counts(dataset, "label_idx", "prediction"), "grid-counts")
        return float(ev.classification_metrics(counts).first()["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class Block:
    """One vectorised block of a chain."""

    name: str
    kind: str = "word"
    ngram: tuple[int, int] = (1, 2)
    min_df: int = 1
    max_features: int = 5000
    sublinear: bool = False
    accents: bool = False


#: M4, and M1 beside M2 (M3).
TERMS = (Block("words"),)
UNION = (Block("words", min_df=3, max_features=150_000, sublinear=True, accents=True),
         Block("chars", "char", (3, 5), min_df=3, max_features=100_000))


def _block_stages(block: Block, vocabulary: DataFrame) -> list:
    """The stage of a block from text to unit vectors, over a fitted vocabulary (at most ``max_features`` terms, they are the model)."""
    rows = vocabulary.orderBy("idx").select("term", "idf").collect()
    return [Weights(inputCol="texto", outputCol=block.name, kind=block.kind, ngram=list(block.ngram), sublinear=block.sublinear, stripAccents=block.accents,
                    terms=[r["term"] for r in rows] or ["_"], idf=[r["idf"] for r in rows] or [0.0])]


def feature_stages(texts: DataFrame, blocks=TERMS) -> list:
    """Fitted stages from ``texto`` to ``features``; the vocabulary is that of ``texts`` (number, texto; a written table)."""
    n_docs, vocabularies = texts.count(), []
    for block in blocks:
        counted = fe.term_counts(fe.terms_frame(texts, "number", "texto", block.kind, block.accents), block.ngram)
        vocabularies.append(fe.fit_vocabulary(counted, n_docs, block.min_df, block.max_features))
    return vector_stages(vocabularies, blocks)


def vector_stages(vocabularies: list[DataFrame], blocks=TERMS) -> list:
    """Stages from ``texto`` to ``features`` over one fitted vocabulary per block."""
    stages = [stage for block, vocabulary in zip(blocks, vocabularies) for stage in _block_stages(block, vocabulary)]
    return [*stages, VectorAssembler(inputCols=[b.name for b in blocks], outputCol="features")]


def whole_chain(text: TicketText, stages: list, model, labels: list[str], blocks=TERMS, out: str = "Clasificación") -> PipelineModel:
    """Raw columns to class name: text steps, fitted ``stages`` to features, classifier, label names."""
    names = IndexToString(inputCol="prediction", outputCol=out, labels=labels)
    return PipelineModel([text, *stages, model, names, KeepColumns(working=[*_working(blocks), "features", "prediction"])])


def _working(blocks) -> list[str]:
    return [b.name for b in blocks]


def grid_search_c(rows: DataFrame, folds: int = 3, grid=(0.5, 1.0, 2.0, 5.0), parallelism: int = 4, max_iter: int = 1000,
                  id_col: str = "number", label: str = "clase") -> tuple[CrossValidatorModel, dict[float, float]]:
    """M8: macro F1 over stratified folds for every C, fits side by side over one written frame; refitted with the best.

    ``rows`` has features, label_idx and the class; C maps to regParam = 1 / (C n), n the rows of a fold's training part."""
    weighted = rows.join(ev.class_weights_balanced(rows, label).select(label, "weight"), label)
    frame = written(ev.stratified_kfold(weighted, label, id_col, folds, fixed.SEED, "fold"), "grid")
    n = max(1, frame.count() * (folds - 1) // folds)
    svm = md.svm_ovr_balanced(n, 1.0, max_iter)
    maps = ParamGridBuilder().addGrid(svm.getClassifier().regParam, [1.0 / (c * n) for c in grid]).build()
    model = CrossValidator(estimator=svm, estimatorParamMaps=maps, evaluator=MacroF1(), numFolds=folds, foldCol="fold", parallelism=parallelism).fit(md.packed(frame, parallelism))
    return model, dict(zip(grid, map(float, model.avgMetrics)))


def fit_chain(train: DataFrame, label: str, text: TicketText, blocks=TERMS, classifier: str = "lr", out: str = "Clasificación",
              C: float = 1.0, max_iter: int = 3000) -> PipelineModel:
    """M24 / M25 (+ S16): fit on labelled raw tickets (``number`` and the raw columns); the result scores raw exports.

    ``classifier``: ``lr`` on oversampled rows, ``svm`` (one-vs-rest, balanced weights), or ``svm_grid`` (M8 first)."""
    texts = written(text.transform(train).select("number", label, "texto"), "chain-texts")     # the text steps run once
    stages = feature_stages(texts, blocks)
    labels = [r[0] for r in texts.select(label).distinct().orderBy(label).collect()]     # the label domain
    x = texts
    for stage in stages:
        x = stage.transform(x)
    index = F.create_map(*[v for i, name in enumerate(labels) for v in (F.lit(name), F.lit(float(i)))])
    rows = written(x.select("number", F.col(label).alias("clase"), index[F.col(label)].alias("label_idx"), "features"), "chain-rows")
    if classifier == "lr":
        model = md.fit_oversampled_lr(rows, "clase", "number", C, max_iter)
    elif classifier == "svm":
        weighted = written(rows.join(ev.class_weights_balanced(rows, "clase").select("clase", "weight"), "clase"), "chain-weighted")
        model = md.svm_ovr_balanced(weighted.count(), C, max_iter).fit(md.packed(weighted))
    else:
        model = grid_search_c(rows, max_iter=max_iter)[0].bestModel
    return whole_chain(text, stages, model, labels, blocks, out)


def scorer(chain: PipelineModel, out: str = "Clasificación", review_empty: bool = False):
    """A scorer for the jobs: the class of every row; M25 sends rows without text to review."""
    def score(export: DataFrame) -> DataFrame:
        x = chain.transform(export)
        if review_empty:
            x = x.withColumn(out, pj.empty_text_to_review(F.col("texto"), F.col(out)))
        return x.drop("texto", "rawPrediction", "probability")
    return score
