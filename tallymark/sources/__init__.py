"""Reading emails, attachments and archives; writing exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intake import only_expected

EMAIL = "email_id string, `from` string, subject string, body string, attachments array<string>, _corrupt_record string"
SUFFIXES = ("txt", "pdf", "docx", "xlsx", "png", "jpg", "jpeg")
MOST_BYTES, MOST_ENTRIES, MOST_TOTAL = 10_000_000, 2000, 32_000_000


def read_emails(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good emails and failures (file, reason); malformed files are never dropped."""
    raw = spark.read.schema(EMAIL).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_name"))
    length = lambda c: F.coalesce(F.char_length(F.col(c)), F.lit(0))
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "invalid_json")
        .when(~length("email_id").between(1, 256), "email_id")
        .when(length("from") > 320, "from")
        .when(~length("subject").between(1, 1000), "subject")
        .when(length("body") > 100_000, "body")
        .when(F.size(F.coalesce("attachments", F.array())) > 20, "attachments")
    )
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason", "_corrupt_record"), marked.where("reason is not null").select("file", "reason")


def inbox_problems(good: DataFrame, bad: DataFrame) -> DataFrame:
    """file, reason of what keeps an inbox from being taken as a whole: malformed files, ids that several files give, no file at all."""
    twice = good.groupBy("email_id").agg(F.count("*").alias("n")).where("n > 1").select("email_id")
    repeated = good.join(twice, "email_id", "left_semi").select("file", F.lit("repeated_id").alias("reason"))
    found = bad.select("file", "reason").unionByName(repeated)
    empty = good.select("file").unionByName(bad.select("file")).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("file"), F.lit("empty_inbox").alias("reason"))
    return found.unionByName(empty)


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """path, name, suffix, length, content of allowed files; length is filtered before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(f"length between 1 and {MOST_BYTES}")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).where(F.col("suffix").isin(*SUFFIXES)).select("path", "name", "suffix", "length", "content")


def safe_path(path: Column) -> Column:
    """True for a relative path without drive, empty or ``..`` parts (backslashes count as slashes)."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~p.rlike(r"^/|^[A-Za-z]:") & ~F.exists(F.split(p, "/"), lambda x: x.isin("", "..", "."))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows.extend((path, *m) for m in _open(bytes(content)))
        yield pd.DataFrame(rows, columns=["archive", "member", "size", "content", "error"])


def _open(content: bytes) -> list[tuple]:
    try:
        held = zipfile.ZipFile(io.BytesIO(content))
        entries = [e for e in held.infolist() if not e.is_dir()]
    except (zipfile.BadZipFile, OSError):
        return [(None, 0, None, "not_an_archive")]
    names = [e.filename for e in entries]
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_TOTAL:
        return [(None, 0, None, "too_large")]
    out = []
    for e in entries:
        parts = e.filename.replace("\\", "/").split("/")
        link = (e.external_attr >> 16) & 0o170000 == 0o120000
        if link or "" in parts or ".." in parts or ":" in parts[0] or names.count(e.filename) > 1 or e.file_size > MOST_BYTES:
            out.append((e.filename, e.file_size, None, "unsafe_member"))
            continue
        try:
            out.append((e.filename, e.file_size, held.read(e), None))
        except (zipfile.BadZipFile, OSError, RuntimeError, EOFError):
            out.append((e.filename, e.file_size, None, "unreadable_member"))
    return out


def expand_archives(files: DataFrame) -> DataFrame:
    """archive, member, size, content, error of binaryFile rows; an archive a row, many at once."""
    return files.select("path", "content").mapInPandas(_members, "archive string, member string, size long, content binary, error string")


def write_predictions(decisions: DataFrame, path: str, *, expected: DataFrame | None = None) -> None:
    """Write only if no row is blocked, and only to a new path; with ``expected`` (case_id) only if exactly these cases are there, once each."""
    blocked = decisions.where("blocker is not null").limit(1).count()
    if blocked:
        raise ValueError("some cases can't be exported; see the diagnostics")
    if expected is not None and not only_expected(expected.select("case_id"), decisions.select("case_id"), "case_id").isEmpty():
        raise ValueError("cases are missing, unexpected or repeated")
    decisions.select("case_id", "status", "review_reason", "has_defect", "defect_fields").write.mode("errorifexists").json(path)


def write_diagnostics(decisions: DataFrame, path: str) -> None:
    """Coverage: cases by status or blocker; always written."""
    decisions.groupBy(F.coalesce("status", "blocker").alias("outcome")).count().coalesce(1).write.mode("errorifexists").json(path)
