"""Feature encoding and a soft-voting classifier on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(train: DataFrame, categorical: list[str], numeric: list[str], label: str, seed: int = 42) -> PipelineModel:
    """Indexes categories (unseen ones get an index of their own), scales, and fits two tree ensembles."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep") for c in categorical]
    stages += [VectorAssembler(inputCols=[*numeric, *(f"{c}_ix" for c in categorical)], outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    for name, kind in (("rf", RandomForestClassifier), ("gbt", GBTClassifier)):
        voter = kind(labelCol=label, featuresCol="features", seed=seed, predictionCol=f"{name}_label")
        stages.append(voter.setProbabilityCol(f"{name}_p").setRawPredictionCol(f"{name}_raw"))
    return Pipeline(stages=stages).fit(train)


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: of each label about that share, by a hash of the key, so that reruns give the same."""
    at = F.pmod(F.xxhash64(F.col(key), F.col(label)), F.lit(10_000)) < int(share * 10_000)
    return rows.filter(at), rows.filter(~at)


def cross_validated_auc(rows: DataFrame, key: str, categorical: list[str], numeric: list[str], label: str, folds: int = 5, seed: int = 42) -> list[float]:
    """The area under the curve on each fold, from a model of the others; folds by a hash of the key."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))
    judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="score")
    return [judge.evaluate(score(fit(rows.filter(fold != i), categorical, numeric, label, seed), rows.filter(fold == i))) for i in range(folds)]


def score(model: PipelineModel, rows: DataFrame, review: float = 0.4, flag: float = 0.75) -> DataFrame:
    """Adds score, the mean of both probabilities, and decision."""
    p = lambda c: vector_to_array(c)[1]
    done = model.transform(rows).withColumn("score", (p("rf_p") + p("gbt_p")) / 2)
    return done.select(*rows.columns, "score", F.when(F.col("score") >= flag, "FLAG").when(F.col("score") >= review, "REVIEW").otherwise("CLEAR").alias("decision"))
