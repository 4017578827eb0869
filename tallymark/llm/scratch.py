"""Tables and files that one step writes and a later step reads.

Everything goes below ``spark.checkpoint.dir``, the one folder that driver and
executors share.  Only where that setting is absent *and* the master is local
(unit tests) a temporary folder is made.  A cluster without the setting is an
error: a machine's own disk is invisible to the other machines.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write are of no use to anyone; drop them at once.
_DROP_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallymark-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder, removed when the driver ends normally."""
    path = f"{shared_root(spark)}/tallymark-{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_remove, spark, _made[app])
    _made[app].append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        discard(spark, *paths)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables at places named in this block are deleted at its end."""
    app = spark.sparkContext.applicationId
    before = len(_made.get(app, []))
    yield
    discard(spark, *_made.get(app, [])[before:])


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` stands for a dot) for the length of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, *, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage like ``checkpoint()`` does, survives the loss of any
    executor, keeps column pruning, and lets Spark know the real size.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    before = spark.conf.get(_DROP_SHUFFLE, None)
    spark.conf.set(_DROP_SHUFFLE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLE) if before is None else spark.conf.set(_DROP_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)
