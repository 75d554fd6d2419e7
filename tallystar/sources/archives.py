"""ZIP archives as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

_MEMBERS = "archive string, member string, base_name string, size_bytes long, content binary, error string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in _MEMBERS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.endswith("/"):
                            continue
                        data = archive.read(member)
                        row = (path, member, member.rsplit("/", 1)[-1], len(data), data, None)
                        yield pd.DataFrame([row], columns=names)
            except Exception as error:  # a broken archive is a result, not the end of the job
                yield pd.DataFrame([(path, None, None, None, None, str(error))], columns=names)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """One row per archive member under its base name, or one with ``error`` per bad archive.

    Members are emitted one at a time, so a task holds one archive and one member.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(_members, _MEMBERS)


def archive_outcomes(members: DataFrame) -> DataFrame:
    """Per archive whether it opened, and how many members it held."""
    return members.groupBy("archive").agg(
        F.count("member").alias("members"), F.max("error").alias("error")
    ).withColumn("ok", F.col("error").isNull())
