"""Small helpers of the text operators: positional column names, written intermediates, word rules."""

from __future__ import annotations

import ctypes
import sys
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.session import scratch_path
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a frame into the shared folder and read it back, so that later steps do not recompute it."""
    path = path or scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def released(spark: SparkSession):
    """Jobs within delete their shuffle files when they end, since what later steps need of them is written."""
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def positional(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """Columns renamed to c0, c1, … so that no added column can clash, and the new name of each needed one.

    Column names are matched exactly; of equal names the first counts.
    """
    names = {n: f"c{docs.columns.index(n)}" for n in needed}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), names


def restored(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the original frame under their own names."""
    return frame.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    gaps = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"))
    spaces = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, ""))
    return (gaps - spaces).cast("long")


WORKER_WORDS = "tallystar_worker_words"


def trim() -> None:
    """Give freed memory of this Python worker back to the system; the allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if give_back:
        give_back(0)


def slices(batches, rows: int = 500, keep_words: bool = False):
    """Arrow batches in smaller parts, so that few texts are Python objects at a time.

    Python workers are reused from stage to stage; what packing keeps in them is dropped by any other work, and what a
    batch needed is given back after it.
    """
    if not keep_words:
        sys.modules.pop(WORKER_WORDS, None)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        trim()
