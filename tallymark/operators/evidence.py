"""Quality of what was read from a document, and short views of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW = 2000
MOST_BLOCKS = 240
_ISSUES = "array<string>"


def problems(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, problems (sorted) of every document; an empty array is sound evidence.

    ``blocks``: document_id, block_id, text, n_locations, kind, page.
    ``documents``: document_id, n_issues; null ids are a problem of their own.
    """
    twice = blocks.groupBy("document_id", "block_id").agg(F.count("*").alias("n"), F.max(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.max(F.col("n_locations") == 0).alias("nowhere"), F.max((F.col("kind") == "docx") & F.col("page").isNotNull()).alias("invented"))
    name = lambda flag, code: F.when(flag, F.concat(F.lit(f"{code}:"), F.col("block_id")))
    own = F.array_compact(F.array(name(F.col("n") > 1, "duplicate_evidence_id"), name(F.col("empty"), "empty_evidence_text"), name(F.col("nowhere"), "missing_location"), name(F.col("invented"), "invented_docx_page")))
    found = twice.groupBy("document_id").agg(F.flatten(F.collect_list(own)).alias("_found"))
    out = documents.join(found, documents["document_id"].eqNullSafe(found["document_id"]), "left").drop(found["document_id"])
    whole = F.array_compact(F.array(F.when(F.coalesce("document_id", F.lit("")) == "", "missing_document_identity"), F.when(F.col("_found").isNull() & (F.col("n_issues") == 0), "empty_reading_without_issue")))
    return out.select("document_id", F.array_sort(F.concat(whole, F.coalesce("_found", F.array().cast(_ISSUES)))).alias("problems"))


def previews(blocks: DataFrame, *, least: float = 0.8) -> DataFrame:
    """document_id, preview, truncated: reliable blocks in order, cut at 2000 characters; nothing if an issue blocks.

    ``blocks``: document_id, ordinal, text, method, ocr_confidence, blocked (of the document).
    """
    reliable = (F.col("method") != "ocr") | F.coalesce(F.col("ocr_confidence") >= least, F.lit(False))
    held = F.array_sort(F.collect_list(F.when(reliable, F.struct("ordinal", "text"))))
    out = blocks.groupBy("document_id").agg(held.alias("held"), F.count("*").alias("n"), F.bool_or("blocked").alias("blocked"))
    text = F.array_join(F.transform("held", lambda x: x["text"]), "\n")
    cut = (F.char_length(text) > PREVIEW) | (F.size("held") != F.col("n"))
    return out.select("document_id", F.when(F.col("blocked"), "").otherwise(F.substring(text, 1, PREVIEW)).alias("preview"), (F.col("blocked") | cut).alias("truncated"))


def within_capacity(blocks: DataFrame) -> DataFrame:
    """document_id, n_blocks, fits: extraction takes documents of 1 to 240 blocks."""
    return blocks.groupBy("document_id").agg(F.count("*").alias("n_blocks")).withColumn("fits", F.col("n_blocks").between(1, MOST_BLOCKS))


def meaningful_title(title: Column) -> Column:
    bare = F.lower(F.regexp_replace(title, r"(?U)[\s._-]+", ""))
    return ~bare.isin("sheet", "sheet1", "worksheet", "worksheet1")


def kept_titles(sheets: DataFrame) -> DataFrame:
    """Sheets whose title block stays: a meaningful title on a sheet with cells."""
    return sheets.where(meaningful_title(F.col("title")) & (F.col("n_cells") > 0))


def first_uncertain(cells: Column, most: int = 20) -> Column:
    """The first cell names joined by commas, and ``,...`` if there are more."""
    return F.concat(F.array_join(F.slice(cells, 1, most), ","), F.when(F.size(cells) > most, ",...").otherwise(""))


def cell_position(address: Column) -> tuple[Column, Column]:
    """Row and column number of an address such as AB12."""
    from .segment import column_number

    return F.regexp_extract(address, r"([0-9]+)$", 1).cast("int"), column_number(F.regexp_extract(address, r"^([A-Za-z]+)", 1))


def pages_for_ocr(pages: DataFrame, *, most_pages: int = 20, most_ocr: int = 3) -> DataFrame:
    """document_id, page, wanted, read: pages with hardly any text, or a large image and little text; the first three of the first twenty are read.

    ``pages``: document_id, page (from 1), n_readable, image_share.
    """
    wanted = (F.col("n_readable") < 4) | ((F.col("image_share") > 0.25) & (F.col("n_readable") < 200))
    seen = pages.where(F.col("page") <= most_pages).withColumn("wanted", wanted)
    first = seen.where("wanted").groupBy("document_id").agg(F.slice(F.sort_array(F.collect_list("page")), 1, most_ocr).alias("_first"))
    out = seen.join(first, "document_id", "left")
    return out.select("document_id", "page", "wanted", F.coalesce(F.array_contains("_first", F.col("page")), F.lit(False)).alias("read"))
