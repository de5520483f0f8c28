"""Few-shot classifier with the interface of ``pyspark.ml``: params, persistence, cross-validation."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from specgrade.functions.vectors import l2_normalize
from specgrade.operators.fewshot import center, centered_centroids, classify, unit_centroids
from specgrade.operators.ranking import hash_rank
from specgrade.session import materialise


class _Columns(Params):
    """Columns of the input, and whether vectors are centred on the support's mean."""

    label: Param[str] = Param(Params._dummy(), "label", "column of the class", TypeConverters.toString)
    vector: Param[str] = Param(Params._dummy(), "vector", "column of the vector", TypeConverters.toString)
    key: Param[str] = Param(Params._dummy(), "key", "column that identifies a row", TypeConverters.toString)
    centred: Param[bool] = Param(Params._dummy(), "centred", "subtract the mean of the support", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(label="label", vector="embedding", key="record_id", centred=True)

    def _columns(self) -> tuple[str, str, str, bool]:
        return tuple(self.getOrDefault(p) for p in ("label", "vector", "key", "centred"))


class CentroidClassifier(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Nearest centroid. ``fit`` reads (vector, label), once; the model's tables are stored."""

    @keyword_only
    def __init__(self, *, label: str = "label", vector: str = "embedding", key: str = "record_id", centred: bool = True) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CentroidModel":
        label, vector, _, centred = self._columns()
        support = dataset.select(label, vector)
        if centred:
            means, centroids = centered_centroids(support, label, (), vector)
        else:
            # A mean of no length, so that both kinds of model read alike.
            means, centroids = support.limit(0).select(F.col(vector).cast("array<double>").alias("center")), unit_centroids(support, label, (), vector)
        return self._copyValues(CentroidModel(materialise(means, "means"), materialise(centroids, "centroids")))


class CentroidModel(Model, _Columns, MLReadable, MLWritable):
    """Adds ``prediction``, ``probability`` and ``l2_distance`` of the best class."""

    def __init__(self, means: DataFrame, centroids: DataFrame) -> None:
        super().__init__()
        self.means, self.centroids = means, centroids

    def probabilities(self, dataset: DataFrame, top_k: int | None = None) -> DataFrame:
        """Ranked classes per row (all of them by default)."""
        label, vector, key, centred = self._columns()
        rows = dataset.select(key, vector)
        moved = center(rows, self.means, (), vector) if centred else rows.withColumn(vector, l2_normalize(F.col(vector)))
        return classify(moved, self.centroids, key, label, (), top_k, vector)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault("key")
        best = self.probabilities(dataset, 1).select(
            key,
            F.col("rank_value").alias("prediction"),
            F.col("softmax_score").alias("probability"),
            "l2_distance",
        )
        return dataset.join(best, key, "left")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: CentroidModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.means.write.parquet(f"{path}/means")
        self.model.centroids.write.parquet(f"{path}/centroids")


class _ModelReader(MLReader):
    def __init__(self, cls: type[CentroidModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CentroidModel:
        spark = self.sparkSession or SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/means"), spark.read.parquet(f"{path}/centroids"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class Accuracy(Evaluator):
    """Share of rows whose prediction is the class; rows without a prediction are wrong."""

    def __init__(self, label: str = "label") -> None:
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        right = F.coalesce((F.col("prediction") == F.col(self.label)).cast("int"), F.lit(0))
        return dataset.agg(F.avg(right)).first()[0] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold numbers for ``CrossValidator(foldCol=...)``: all rows of a group share one, sizes differ by one group at most."""
    ranked = hash_rank(df.select(group).distinct(), [], group, seed, "_rank")
    numbered = ranked.select(group, F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int").alias(out))
    return df.join(numbered, group)
