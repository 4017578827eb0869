"""Derived flags kept up to date for the cases that a stream touches.

Every micro-batch writes the rows of its touched cases to a folder of its own
number, in place of what an earlier try of the same batch has left there; the
current row of a case is that of its latest batch.  So a replayed batch changes
nothing, and the work follows what was touched, not what is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Compute = Callable[[DataFrame], DataFrame]


def refresher(path: str, keys: list[str], compute: Compute, *, summary: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows that ``compute`` gives for the batch's distinct keys, and a snapshot of ``summary`` over all current rows."""

    def write(batch: DataFrame, number: int) -> None:
        touched = batch.select(keys).distinct()
        compute(touched).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if summary is not None:
            snapshot = summary(current(batch.sparkSession, path, keys))
            snapshot.write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")

    return write


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def snapshot(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What the summary was after a batch, if the batch was finished."""
    try:
        return spark.read.parquet(f"{path}/snapshots/batch={number}")
    except AnalysisException:
        return None


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """All current rows as batch -1 of a new place, where the stream may go on."""
    current(spark, path, keys).write.mode("errorifexists").parquet(f"{to}/rows/batch=-1")


def differing(kept: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``change``: ``added``, ``removed`` or ``changed`` where the kept rows are not the desired ones; nothing where they are."""
    rest = [c for c in desired.columns if c not in keys]
    ours = kept.select(*keys, F.struct(*rest).alias("ours"), F.lit(True).alias("in_ours"))
    theirs = desired.select(*keys, F.struct(*rest).alias("theirs"), F.lit(True).alias("in_theirs"))
    both = ours.join(theirs, keys, "full")
    change = F.when(F.col("in_ours").isNull(), "added").when(F.col("in_theirs").isNull(), "removed").when(~F.col("ours").eqNullSafe(F.col("theirs")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")
