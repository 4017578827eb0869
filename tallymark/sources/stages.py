"""Results of stages kept by content, so that a run does again only what has changed.

A table holds results in folders by stage and profile (``reviews.profile`` of a
stage's models, thresholds and requests) and keyed by a fingerprint of what they
were computed from.  A changed threshold is another profile: its stage is
computed anew, other stages find their results.  Reading prunes to one folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["content", "stage", "profile"]


def kept(spark: SparkSession, path: str, stage: str, profile: str, schema: str) -> DataFrame:
    """Results of one stage under one profile: content and the columns of ``schema``; none where nothing was kept.

    Attempts write folders of their own; of results for one content, which are alike, one counts.
    """
    rows = _table(spark, path, schema).where((F.col("stage") == stage) & (F.col("profile") == profile))
    return rows.drop("stage", "profile", "attempt").dropDuplicates(["content"])


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = f"content string, {schema}, stage string, profile string, attempt string"
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def keep(results: DataFrame, path: str, stage: str, profile: str) -> None:
    """Add results (content, ...) of a stage; a folder of this attempt appears whole or not at all."""
    results.write.mode("errorifexists").parquet(f"{path}/stage={stage}/profile={profile}/attempt={uuid.uuid4().hex}")


def run_stage(inputs: DataFrame, path: str, stage: str, profile: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results (content and ``schema``) for all ``inputs`` (content, ...); only contents without a kept result reach ``compute``.

    Inputs without a content are always computed and never kept.
    """
    spark = inputs.sparkSession
    known, unknown = inputs.where("content is not null"), inputs.where("content is null")
    missing = known.dropDuplicates(["content"]).join(kept(spark, path, stage, profile, schema).select("content"), "content", "left_anti")
    if not missing.isEmpty():
        keep(compute(missing), path, stage, profile)
    done = kept(spark, path, stage, profile, schema)
    return done.join(known.select("content").distinct(), "content", "left_semi").unionByName(compute(unknown).select(done.columns))
