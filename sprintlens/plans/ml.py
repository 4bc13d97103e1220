"""Features and predictors as stages of a ``pyspark.ml`` Pipeline.

``TokenVectorizer`` learns a vocabulary, ``CodeFeatures`` parses both sides of a change,
``Joined`` lines up feature arrays, and ``EffortPredictor`` learns a distribution of effort.
All add columns to the frame that they get, by its id column, whose values are unique; other
columns stay as they are. Fitted stages and whole PipelineModels are saved and loaded on any
file system that Spark writes, and exchanged for one another by their columns alone.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasInputCols, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import models as N
from ..sources.storage import read_text, write_text
from .stages import score

#: The heads of each kind of predictor: target and the kind of its distribution.
HEADS = {"mdn": {"y": "mdn"}, "quantile": {"y": "quantile"}, "multitask": {"y": "mdn", "z": "quantile"}}


class HasIdCol(Params):
    idCol = Param(Params._dummy(), "idCol", "column of the rows' unique ids", TypeConverters.toString)

    def getIdCol(self) -> str:
        return self.getOrDefault(self.idCol)

    def _added(self, df: DataFrame, found: DataFrame) -> DataFrame:
        """df with found's columns (id and others) in the place of equally named ones."""
        key = self.getIdCol()
        new = [c for c in found.columns if c != "id"]
        return df.drop(*new).join(found.withColumnRenamed("id", key), key, "left")


class _DataWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save(self.sparkSession, f"{path}/data")


class _DataReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(said["uid"])
        DefaultParamsReader.getAndSetParams(out, said)
        out._load(self.sparkSession, f"{path}/data")
        return out


class _WithData(MLWritable, MLReadable):
    """Parameters and data of its own: ``_save`` and ``_load``."""

    def write(self) -> MLWriter:
        return _DataWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DataReader(cls)


class _TokenParams(HasIdCol, HasInputCol, HasOutputCol):
    vocabSize = Param(Params._dummy(), "vocabSize", "terms that count at most", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "texts that a term has to be in", TypeConverters.toInt)

    def _start(self) -> None:
        self._setDefault(idCol="commit_id", inputCol="diff_text", outputCol="tokens", vocabSize=X.VOCABULARY, minDF=X.MIN_DOCS)

    def _docs(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.getIdCol()).alias("id"), F.col(self.getInputCol()).alias("text"))


class TokenVectorizer(Estimator, _TokenParams, DefaultParamsWritable, DefaultParamsReadable):
    """Learns the most frequent terms of a text column."""

    @keyword_only
    def __init__(self, *, idCol="commit_id", inputCol="diff_text", outputCol="tokens", vocabSize=X.VOCABULARY, minDF=X.MIN_DOCS):
        super().__init__()
        self._start()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TokenVectorizerModel:
        vocab = X.frequent_terms(self._docs(df), self.getOrDefault("vocabSize"), self.getOrDefault("minDF"))
        # at most vocabSize terms
        return self._copyValues(TokenVectorizerModel([r["term"] for r in vocab.orderBy("col").collect()]))


class TokenVectorizerModel(Model, _TokenParams, _WithData):
    """Counts the vocabulary's terms in each text: an array of floats in the order of ``terms``."""

    def __init__(self, terms: list[str] = ()):
        super().__init__()
        self._start()
        self.terms = list(terms)

    def _vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, k) for k, t in enumerate(self.terms)], "term string, col bigint")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = X.token_vector(F.col(self.getInputCol()), self.terms)
        return df.select(*[c for c in df.columns if c != self.getOutputCol()], out.alias(self.getOutputCol()))

    def _save(self, spark: SparkSession, path: str) -> None:
        self._vocabulary(spark).coalesce(1).write.parquet(path)

    def _load(self, spark: SparkSession, path: str) -> None:
        self.terms = [r["term"] for r in spark.read.parquet(path).orderBy("col").collect()]


class CodeFeatures(Transformer, HasIdCol, HasOutputCol, DefaultParamsWritable, DefaultParamsReadable):
    """Syntax-tree and graph features of both sides of a change, in one array; zeros for other languages than Python."""

    languageCol = Param(Params._dummy(), "languageCol", "language of the change", TypeConverters.toString)
    beforeCol = Param(Params._dummy(), "beforeCol", "map of paths to texts before the change", TypeConverters.toString)
    afterCol = Param(Params._dummy(), "afterCol", "map of paths to texts after the change", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, idCol="commit_id", languageCol="language", beforeCol="before_blobs", afterCol="after_blobs", outputCol="code"):
        super().__init__()
        self._setDefault(idCol="commit_id", languageCol="language", beforeCol="before_blobs", afterCol="after_blobs", outputCol="code")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        own = {"id": self.getIdCol(), "language": self.getOrDefault("languageCol"), "before_blobs": self.getOrDefault("beforeCol"), "after_blobs": self.getOrDefault("afterCol")}
        x = X.code_features(df.select(*[F.col(c).alias(n) for n, c in own.items()]))
        return self._added(df, x.select("id", F.concat("tree", "graph").alias(self.getOutputCol())))


class Joined(Transformer, HasInputCols, HasOutputCol, DefaultParamsWritable, DefaultParamsReadable):
    """Feature arrays one after another."""

    @keyword_only
    def __init__(self, *, inputCols=("tokens", "code"), outputCol="features"):
        super().__init__()
        self._setDefault(inputCols=["tokens", "code"], outputCol="features")
        self._set(**{**self._input_kwargs, **({"inputCols": list(inputCols)} if "inputCols" in self._input_kwargs else {})})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.concat(*self.getInputCols()))


class _EffortParams(HasIdCol, HasFeaturesCol, HasSeed):
    kind = Param(Params._dummy(), "kind", "mdn, quantile or multitask", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "effort, from 0 to 1", TypeConverters.toString)
    deliveryCol = Param(Params._dummy(), "deliveryCol", "effort until delivery, for multitask", TypeConverters.toString)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", TypeConverters.toInt)
    sample = Param(Params._dummy(), "sample", "rows that the driver learns from at most; 0: all rows, in tasks", TypeConverters.toInt)
    steps = Param(Params._dummy(), "steps", "steps an epoch where all rows are learnt from", TypeConverters.toInt)

    def _start(self) -> None:
        self._setDefault(idCol="commit_id", featuresCol="features", kind="mdn", labelCol="y", deliveryCol="z", epochs=60, sample=0, steps=16, seed=0)


class EffortPredictor(Estimator, _EffortParams, DefaultParamsWritable, DefaultParamsReadable):
    """Learns a distribution of effort from features; ids may repeat, as for several draws of a label."""

    @keyword_only
    def __init__(self, *, idCol="commit_id", featuresCol="features", kind="mdn", labelCol="y", deliveryCol="z", epochs=60, sample=0, steps=16, seed=0):
        super().__init__()
        self._start()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> EffortModel:
        g = self.getOrDefault
        if g("kind") not in HEADS:
            raise ValueError(f"unknown kind: {g('kind')}")
        heads = HEADS[g("kind")]
        target = {"y": g("labelCol"), "z": g("deliveryCol")}
        rows = df.select(F.col(self.getIdCol()).alias("id"), F.col(self.getFeaturesCol()).alias("x"), *[F.col(target[t]).cast("double").alias(t) for t in heads])
        how = {"epochs": g("epochs"), "seed": g("seed")}
        model = N.train(rows, heads, g("sample"), **how) if g("sample") else N.train_all(rows, heads, steps=g("steps"), **how)
        return self._copyValues(EffortModel(model))


class EffortModel(Model, _EffortParams, _WithData):
    """Adds mean, p50, p90 and payload (the distribution as JSON) to rows with features."""

    def __init__(self, net: N.Model | None = None):
        super().__init__()
        self._start()
        self.net = net

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = df.select(F.col(self.getIdCol()).alias("id"), F.col(self.getFeaturesCol()).alias("x"))
        return self._added(df, score(rows, self.net))

    def _save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, self.net.to_json())

    def _load(self, spark: SparkSession, path: str) -> None:
        self.net = N.Model.from_json(read_text(spark, path))
