"""Snapshots of evaluations: one JSON object of cases by id, and artifacts that appear together or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases (source_id, case as JSON text) of files that hold one object each, and what is wrong (file, source_id, problem).

    The keys are not known beforehand, so an object is read as a map of its
    values' texts; a value that is no object is a problem, like a file that is
    no object, and an id that several files hold.  Spark passes over files
    without a byte.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").cast("string").alias("text"))
    read = files.select("file", F.when(F.trim("text").startswith("{"), F.from_json("text", "map<string, string>", {"mode": "PERMISSIVE"})).alias("held"))
    whole = read.where("held is not null").select("file", F.explode("held").alias("source_id", "case"))
    is_object = F.coalesce(F.trim("case").startswith("{"), F.lit(False))
    twice = whole.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.lit(True).alias("twice"))
    marked = whole.join(twice, "source_id", "left").withColumn("problem", F.when(~is_object, "no_object").when(F.col("twice"), "repeated_id"))
    bad = marked.where("problem is not null").select("file", "source_id", "problem")
    none = read.where("held is null").select("file", F.lit(None).cast("string").alias("source_id"), F.lit("no_object").alias("problem"))
    return marked.where("problem is null").select("source_id", "case"), bad.unionByName(none)


def publish(artifacts: Mapping[str, DataFrame], path: str) -> None:
    """Write every artifact as JSON beside ``path``, then give the whole set its name; refused if the name is taken.

    Until the one rename nothing is seen under ``path``; a set that fails half
    way leaves only its own hidden folder.
    """
    if not artifacts:
        raise ValueError("nothing to publish")
    spark = next(iter(artifacts.values())).sparkSession
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(jsc.hadoopConfiguration())
    if files.exists(place):
        raise FileExistsError(path)
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    try:
        for name, rows in artifacts.items():
            rows.write.mode("errorifexists").json(f"{draft}/{name}")
        if files.exists(place) or not files.rename(draft, place):
            raise FileExistsError(path)
    finally:
        files.delete(draft, True)


def artifact(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One artifact of a published set."""
    return spark.read.schema(schema).json(f"{path}/{name}")
