"""Choosing the block that holds a field, by its label alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.values import canonical_texts, field_of, head_of, is_ascii, lines_of


def blocks_by_field(blocks: DataFrame) -> DataFrame:
    """doc_id and, for each field, an array of the blocks (block, text) that hold it, in order.

    ``blocks``: doc_id, block, text.  A block holds the fields whose label one
    of its lines begins with, followed by a value.
    """
    fields_of = lambda x: F.transform(lines_of(x), lambda line: field_of(line))
    text = F.col("text")
    rows = blocks.select("doc_id", "block", F.coalesce("text", F.lit("")).alias("text")).withColumn("head", head_of(text))
    # ASCII texts are canonical, and most are a line, which needs no lambda
    found = F.when(text.contains("\n") | text.contains("\r"), fields_of(text)).otherwise(F.array(field_of(text, F.col("head"))))
    rows = rows.select("doc_id", F.struct("block", "text", F.when(is_ascii(text), found).alias("found")).alias("b"))
    # a document's blocks meet before texts cross, where they lie: a document without any label still has its row
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("all"))
    docs = docs.withColumn("canonical", canonical_texts(F.transform("all", lambda x: x["text"])))
    plain = F.forall("all", lambda x: x["found"].isNotNull())
    docs = docs.select("doc_id", "all", F.when(plain, F.transform("all", lambda x: x["found"])).otherwise(F.transform("canonical", fields_of)).alias("fields"))
    of = lambda f: F.filter("all", lambda x, k: F.array_contains(F.get("fields", k), F.lit(f)))
    return docs.select("doc_id", *(of(f).alias(f) for f in L.FIELDS))


def status_of(chosen: Column) -> Column:
    """One block is ``present``, several are ``uncertain``, all of them given, for a person to choose; none is ``missing``."""
    return F.when(F.size(chosen) == 0, "missing").when(F.size(chosen) == 1, "present").otherwise("uncertain")


def numbers_of(chosen: Column) -> Column:
    """The blocks' numbers."""
    return F.transform(chosen, lambda x: x["block"].cast("long"))


def select_by_label(blocks: DataFrame) -> DataFrame:
    """doc_id, field, status, blocks, text: seven rows a document of ``blocks_by_field``; ``text`` joins the chosen blocks by line ends."""
    found = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("chosen")) for f in L.FIELDS)))
    out = blocks_by_field(blocks).select("doc_id", found)
    text = F.when(F.size("chosen") > 0, F.array_join(F.transform("chosen", lambda x: x["text"]), "\n"))
    return out.select("doc_id", "field", status_of(F.col("chosen")).alias("status"), numbers_of(F.col("chosen")).alias("blocks"), text.alias("text"))
