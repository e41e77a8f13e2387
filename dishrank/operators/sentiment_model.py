"""Sentence sentiment 1..5 from a model trained on labelled texts."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages
from ..sources.versions import current_version, switch_to

# Bound on the labelled rows that the model is fitted on.
FIT_ROWS = 50_000
FEATURES = 1 << 15
CLASSES = 5


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> PipelineModel:
    """Model of ``label`` (0 or 1) from ``text``; about ``rows`` rows at most, chosen by a hash.

    Words are hashed, so the model's size does not grow with the vocabulary.
    """
    known = labelled.where(F.col("label").isin(0, 1) & F.col("text").isNotNull())
    total = known.count()
    share = min(1.0, rows / total) if total else 0.0
    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) <= int(share * (1 << 32)))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="ml_words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="ml_words", outputCol="ml_counts", numFeatures=FEATURES),
        IDF(inputCol="ml_counts", outputCol="ml_weights"),
        LogisticRegression(featuresCol="ml_weights", probabilityCol="ml_probability", rawPredictionCol="ml_raw",
                           predictionCol="ml_prediction", regParam=0.05, maxIter=30),
    ]
    return Pipeline(stages=stages).fit(chosen.select("text", F.col("label").cast("double").alias("label")))


def fit_once(labelled: DataFrame, root: str | None = None, rows: int = FIT_ROWS) -> PipelineModel:
    """``fit``, saved under a digest of how the labelled rows are made; a later call loads the model.

    ``labelled`` must be read from files, as a stage's rows must.
    """
    spark = labelled.sparkSession
    step = Stages(spark, root, release=f"{FEATURES},{rows}")
    path = f"{step.root}/sentiment-{step.digest(labelled)}"
    if current_version(spark, path) is None:
        attempt = uuid.uuid4().hex
        fit(labelled, rows).write().save(f"{path}/data/{attempt}")
        switch_to(spark, path, attempt)
    return PipelineModel.load(f"{path}/data/{current_version(spark, path)}")


def quality(model: PipelineModel, labelled: DataFrame) -> tuple[float, float]:
    """Share of labels that the model gets right, and the area under its ROC curve."""
    known = labelled.where(F.col("label").isin(0, 1) & F.col("text").isNotNull())
    scored = model.transform(known.select("text", F.col("label").cast("double").alias("label")))
    right = scored.agg(F.avg((F.col("ml_prediction") == F.col("label")).cast("double"))).first()[0]
    curve = BinaryClassificationEvaluator(rawPredictionCol="ml_raw", labelCol="label", metricName="areaUnderROC")
    return float(right), float(curve.evaluate(scored))


def score_sentences(rows: DataFrame, text: str, model: PipelineModel) -> DataFrame:
    """Add ``score``: the probability of label 1 in five equal steps; a null text is neutral.

    Sentences are scored where they are, without a shuffle.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    named = rows.select(F.struct(*kept).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chance = F.get(vector_to_array("ml_probability"), F.lit(1))
    score = F.least(F.floor(chance * CLASSES) + 1, F.lit(CLASSES)).cast("int")
    known = F.col("row").getField(text).isNotNull()
    return model.transform(named).select("row.*", F.when(known, score).otherwise((CLASSES + 1) // 2).alias("score"))
