"""Token files: flat unsigned ids, 64-bit document offsets, memory-mapped reads.

A token set is a folder with, per part, ``NAME-ids.bin`` (flat unsigned ids, 16
bits when the vocabulary fits, else 32), ``NAME-offsets.bin`` (unsigned 64-bit
starts inside the part, one more than documents) and ``NAME-docs.bin`` (signed
64-bit ids; the least value stands for null), and ``parts``, a small table of
each part's name and base.  Parts are ranges of the document id, and bases are
prefix sums over them, so ids of all parts in order are the corpus in ascending id.

A task names its files by its own attempt, and ``parts`` lists those of the
attempt that Spark committed, so retries, speculation and lost executors never
mix files; what other attempts wrote is in no table.  Defined results: a null or empty text
is the end id alone; equal ids stand next to each other in any order; null ids
come first; an empty table gives an empty set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize, new_path
from .tokens import SLICE, encoder, id_dtype
from .wordhash import slices

NULL_ID = np.iinfo(np.int64).min
_PART = "part int, name string, n_docs long, n_tokens long, dtype string"
_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_READ_DOCS = 4096


def _write_part(folder: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path), TaskContext.get()
        part, dtype = task.partitionId(), id_dtype(encode.vocabulary)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, at, offsets, docs = f"{part:06d}-{task.taskAttemptId()}", 0, [np.zeros(1, np.int64)], []
        with fs.open_output_stream(f"{root}/{name}-ids.bin") as out:
            for batch in batches:
                names, texts = batch.column(0), batch.column(1)
                docs.append(np.asarray(names.fill_null(NULL_ID), np.int64))
                for low, high in slices(texts, SLICE):
                    ids, edges = encode(texts[low:high], end_id)
                    out.write(ids.astype(dtype).tobytes())
                    offsets.append(edges[1:] + at)
                    at += len(ids)
        docs = np.concatenate([np.empty(0, np.int64), *docs])
        for kind, values in (("offsets", np.concatenate(offsets).astype("<u8")), ("docs", docs.astype("<i8"))):
            with fs.open_output_stream(f"{root}/{name}-{kind}.bin") as out:
                out.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [len(docs)], "n_tokens": [at], "dtype": [dtype]})

    return run


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A file's values: mapped where the folder is a mounted one, else read."""
    if not fs.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _read_parts(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids = _mapped(fs, f"{root}/{r['name']}-ids.bin", r["dtype"])
                offsets = _mapped(fs, f"{root}/{r['name']}-offsets.bin", "<u8").astype(np.int64)
                docs = _mapped(fs, f"{root}/{r['name']}-docs.bin", "<i8")
                for low in range(0, len(docs), _READ_DOCS):
                    edges = offsets[low : low + _READ_DOCS + 1]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    names = np.asarray(docs[low : low + _READ_DOCS])
                    columns = [pa.array(names, mask=names == NULL_ID), pa.array(edges[:-1] + r["base"]), pa.array(np.diff(edges)), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_DOC_ARROW)

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, parts: int | None = None) -> str:
    """Write a token set and return its folder (a new one in the shared folder if none is given)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tied = chosen.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # equal ids don't all go to one part
    ranged = tied.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id").select("doc_id", "text")
    written = materialize(ranged.mapInArrow(_write_part(folder, tokenizer_path, end_id), _PART), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part, not per document
    written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/parts")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    parts = spark.read.schema(_PART + ", base long").parquet(f"{folder}/parts")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(n).mapInArrow(_read_parts(folder), _DOC)
