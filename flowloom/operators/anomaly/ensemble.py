"""The three models side by side and their vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.functions import scalars as X
from flowloom.operators.anomaly import features as U
from flowloom.operators.anomaly import iforest, lof, ocsvm
from flowloom.session import durable

MODELS = {"isolation_forest": iforest.detect, "local_outlier_factor": lof.detect, "one_class_svm": ocsvm.detect}
SCORES = "user string, outlyingness double, is_anomaly boolean, anomaly_score double"


def prepare(flows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Features and scaled vectors written once, and the number of users."""
    features = durable(U.feature_table(flows))
    vectors = durable(U.vectors(features))
    return features, vectors, vectors.count()


def detect(vectors: DataFrame, users: int, model: str, contamination: float = U.CONTAMINATION,
           min_users: int = U.MIN_USERS) -> DataFrame:
    """Score every user with one model; too few users give an empty frame."""
    if users < min_users:
        return vectors.sparkSession.createDataFrame([], SCORES)
    return MODELS[model](vectors, users, contamination).select("user", "outlyingness", "is_anomaly", "anomaly_score")


def model_report(flows: DataFrame, model: str, top_n: int = U.TOP_N) -> dict[str, DataFrame]:
    features, vectors, users = prepare(flows)
    scored = durable(detect(vectors, users, model))
    return {"scores": scored, "anomalies": U.top_anomalies(scored, features, top_n), "summary": U.model_summary(scored)}


def vote(top_lists: DataFrame, top_n: int = U.TOP_N, min_votes: int = 2) -> DataFrame:
    """Users named by at least two models with the mean of their scores.

    ``top_lists`` holds (model, user, anomaly_score), at most ``top_n`` rows per model.
    """
    g = top_lists.groupBy("user").agg(
        F.count(F.lit(1)).alias("votes"), X.round_half_up(F.avg("anomaly_score"), 2).alias("anomaly_score"),
        F.array_join(F.array_sort(F.collect_list("model")), ", ").alias("voting_models"))
    return (g.where(F.col("votes") >= min_votes).orderBy(F.col("anomaly_score").desc(), "user").limit(top_n)
            .withColumn("severity", X.model_severity(F.col("anomaly_score"))))


def ensemble(flows: DataFrame, top_n: int = U.TOP_N) -> dict[str, DataFrame]:
    """Consensus of the three models; fewer users than the minimum give empty frames."""
    features, vectors, users = prepare(flows)
    lists = None
    for model in MODELS:
        best = detect(vectors, users, model).where("is_anomaly").orderBy(
            F.col("anomaly_score").desc(), "user").limit(top_n).select(F.lit(model).alias("model"), "user", "anomaly_score")
        lists = best if lists is None else lists.unionByName(best)
    voted = durable(vote(durable(lists), top_n))
    # At most top_n rows: the upper middle score is the reported median.
    place = F.row_number().over(Window.orderBy("anomaly_score"))
    middle = voted.withColumn("r", place - 1)
    size = voted.agg(F.count(F.lit(1)).alias("c")).scalar()
    summary = middle.withColumn("c", size).agg(
        F.count(F.lit(1)).alias("anomaly_users"), F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.max(F.when(F.col("r") == F.floor(F.col("c") / 2), F.col("anomaly_score"))), F.lit(0.0)).alias("median_score"))
    summary = summary.withColumns({"total_users": F.lit(users).cast("bigint"),
                                   "normal_users": F.greatest(F.lit(users) - F.col("anomaly_users"), F.lit(0)).cast("bigint")})
    return {"anomalies": voted.join(U.column_evidence(features), "user"), "summary": summary}
