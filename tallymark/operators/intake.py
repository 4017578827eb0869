"""Attachment resolution and idempotent import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def resolve(references: DataFrame, members: DataFrame) -> DataFrame:
    """(email_id, ref) -> member, state: exact path wins, else a name that is unique, else ambiguous or missing."""
    exact = members.select(F.col("path").alias("ref"), F.col("path").alias("_exact")).distinct()
    names = members.select("path", basename(F.col("path")).alias("_name")).distinct().groupBy("_name").agg(F.count("*").alias("_n"), F.min("path").alias("_only"))
    refs = references.select("email_id", "ref").distinct().withColumn("_name", basename(F.col("ref")))
    out = refs.join(exact, "ref", "left").join(names, "_name", "left")
    state = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") == 1, "by_name").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return out.select("email_id", "ref", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only"))).alias("member"), state.alias("state"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the canonical JSON of some columns."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def import_outcome(rows: DataFrame, existing: DataFrame | None = None, *, key: str = "digest", order: str = "doc_id") -> DataFrame:
    """Adds outcome: the first row of a digest is accepted, later ones and those already there are duplicates.

    Firsts come from an aggregate that is combined before the shuffle, so a
    digest that many rows share is no burden to one task.  A row without a
    digest could not be read: it failed.  Rows alike in digest and order are one row.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    state = F.when(F.col(key).isNull(), "failed").when(F.col(order).eqNullSafe(F.col("_first")), "accepted").otherwise("duplicate")
    out = rows.join(first, key, "left").withColumn("outcome", state).drop("_first")
    if existing is None:
        return out
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    return out.join(there, key, "left").withColumn("outcome", F.when(F.col("_there") & (F.col("outcome") == "accepted"), "duplicate").otherwise(F.col("outcome"))).drop("_there")


def preview(records: DataFrame) -> DataFrame:
    """One row: valid and invalid records (error), and files that records name but no one sent (missing, an array)."""
    missing = F.sum(F.size(F.coalesce("missing", F.array().cast("array<string>"))))
    return records.agg(F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("invalid"), F.coalesce(missing, F.lit(0)).alias("missing_files"))


# How a file is read, by its suffix, and the size beyond which none is.
READERS = {"txt": "text", "pdf": "pdf", "docx": "word", "xlsx": "sheet", "png": "image", "jpg": "image", "jpeg": "image"}
MOST_DOCUMENT_BYTES = 10_000_000


def dispatch(files: DataFrame, *, most_bytes: int = MOST_DOCUMENT_BYTES) -> DataFrame:
    """``files`` (filename, length) with reader, null where issue says why none reads them; nothing is passed over in silence."""
    suffix = F.lower(F.regexp_extract(basename(F.col("filename")), r"[^.](\.[^.]+)$", 1))
    kind = F.create_map(*(F.lit(x) for k, v in READERS.items() for x in (f".{k}", v)))
    length = F.coalesce("length", F.lit(0))
    issue = (
        F.when(length == 0, "empty_document")
        .when(length > most_bytes, F.concat(F.lit("document_size_limit_exceeded:"), length.cast("string"), F.lit(f">{most_bytes}")))
        .when(F.try_element_at(kind, suffix).isNull(), F.concat(F.lit("unsupported_document_type:"), F.when(suffix == "", "none").otherwise(suffix)))
    )
    return files.withColumn("issue", issue).withColumn("reader", F.when(F.col("issue").isNull(), F.try_element_at(kind, suffix)))


def of_tenant(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """document_id, workspace_id, found of ``requests``: a document of another workspace is as unknown as one that isn't there."""
    own = documents.select("document_id", "workspace_id", F.lit(True).alias("found")).distinct()
    return requests.select("document_id", "workspace_id").join(own, ["document_id", "workspace_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def group_id(*parts: Column) -> Column:
    """An identifier that the same parts always give, in the form of a UUID (not that of a name-based one)."""
    hexed = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat_ws("-", *(F.substring(hexed, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each slot; older ones are superseded."""
    own = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("superseded", F.row_number().over(own) > 1)


def only_expected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, problem: ids that are missing, unexpected or duplicated."""
    missing = expected.join(actual, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = actual.join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem")).distinct()
    twice = actual.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)
