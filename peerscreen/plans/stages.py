"""The detector and the forecaster as ``pyspark.ml`` stages, for use in a ``Pipeline``.

Fitted stages are written with their parameters as metadata and their trees as Parquet, and
a reloaded pipeline gives equal rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from peerscreen import schema as S
from peerscreen.operators import boosting, iforest, ordering
from peerscreen.plans import training


class _Writer(MLWriter):
    """Parameters as metadata, the rest as the stage itself writes it."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, self.instance._facts())
        self.instance._save(self.sparkSession, path)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._load(self.sparkSession, path, metadata)
        return stage


class _Stored(MLReadable, MLWritable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _DetectorParams(HasSeed):
    contamination = Param(Params._dummy(), "contamination", "share of reference rows to flag, in (0, 0.5)", TypeConverters.toFloat)
    robustThreshold = Param(Params._dummy(), "robustThreshold", "robust z beyond which a part is flagged", TypeConverters.toFloat)
    keys = Param(Params._dummy(), "keys", "columns of a scope; one forest each", TypeConverters.toListString)
    columns = Param(Params._dummy(), "columns", "features of the forest", TypeConverters.toListString)
    numTrees = Param(Params._dummy(), "numTrees", "trees of a scope", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(contamination=0.1, robustThreshold=S.ROBUST_THRESHOLD, keys=[], columns=list(S.MODEL_FEATURES), numTrees=250, seed=42)


class PeerDetector(Estimator, _DetectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits isolation forests on feature rows."""

    def __init__(self, *, contamination: float = 0.1, keys: Sequence[str] = (), numTrees: int = 250, seed: int = 42):
        super().__init__()
        if not 0 < contamination < 0.5:
            raise ValueError("contamination must be between 0 and 0.5")
        self._set(contamination=contamination, keys=list(keys), numTrees=numTrees, seed=seed)

    def _fit(self, dataset: DataFrame) -> PeerDetectorModel:
        get = self.getOrDefault
        forest = iforest.fit(ordering.stable(dataset), keys=get("keys"), columns=get("columns"), n_trees=get("numTrees"), seed=get("seed"))
        return self._copyValues(PeerDetectorModel(forest))


class PeerDetectorModel(Model, _DetectorParams, _Stored):
    """Adds scores, flags and reasons to feature rows."""

    def __init__(self, forest: iforest.IsolationModel | None = None):
        super().__init__()
        self.forest = forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        return self.forest.score(dataset, contamination=get("contamination"), robust_threshold=get("robustThreshold"))

    def _facts(self) -> dict:
        return {"forestKeys": self.forest.keys, "forestColumns": self.forest.columns}

    def _save(self, spark, path: str) -> None:
        for name in ("forest", "medians", "train_scores"):
            getattr(self.forest, name).write.parquet(os.path.join(path, name))

    def _load(self, spark, path: str, metadata: dict) -> None:
        tables = [spark.read.parquet(os.path.join(path, name)) for name in ("forest", "medians", "train_scores")]
        self.forest = iforest.IsolationModel(metadata["forestKeys"], metadata["forestColumns"], *tables)


class _ForecastParams(HasSeed, HasPredictionCol):
    configuration = Param(Params._dummy(), "configuration", "a candidate configuration as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(configuration=json.dumps(asdict(boosting.FINAL)), seed=26170, predictionCol="pred")

    def config(self) -> boosting.CandidateConfig:
        return boosting.CandidateConfig(**json.loads(self.getOrDefault("configuration")))


class Forecaster(Estimator, _ForecastParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a forecast on the rows whose target ``y`` is known."""

    def __init__(self, config: boosting.CandidateConfig = boosting.FINAL, *, seed: int = 26170, predictionCol: str = "pred"):
        super().__init__()
        self._set(configuration=json.dumps(asdict(config)), seed=seed, predictionCol=predictionCol)

    def _fit(self, dataset: DataFrame) -> ForecasterModel:
        train = ordering.stable(dataset.filter(F.col("y").isNotNull()))
        return self._copyValues(ForecasterModel(boosting.fit_model(self.config(), train, seed=self.getOrDefault("seed"))))


class ForecasterModel(Model, _ForecastParams, _Stored):
    """Adds the forecast in limit fractions."""

    def __init__(self, fitted: boosting.FittedModel | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getOrDefault("predictionCol"))

    def _facts(self) -> dict:
        return {}

    def _save(self, spark, path: str) -> None:
        training.save_model(self.fitted, spark, os.path.join(path, "fitted"))

    def _load(self, spark, path: str, metadata: dict) -> None:
        self.fitted = training.load_model(spark, os.path.join(path, "fitted"))
