"""Loading the wide fact table, and the audits around a load."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.schema import CANONICAL_COLUMNS, FACT_SCHEMA, SURVEY_MONTH
from tallystar.session import scratch_path

_SALTS = 1024
VINTAGE_BUCKETS = 16


def load_projection(standardized: DataFrame) -> DataFrame:
    """Canonical columns plus survey and source columns, in table order; extras are left out."""
    types = {f.name: f.dataType for f in FACT_SCHEMA.fields}
    return standardized.select(
        *[F.col(c).cast(types[c]).alias(c) for c in CANONICAL_COLUMNS],
        F.col("_data_year").cast("int").alias("SURVEY_YEAR"),
        F.lit(SURVEY_MONTH).alias("SURVEY_MONTH"),
        F.col("_source_file").alias("SOURCE_FILE"),
        F.col("_source_folder").alias("SOURCE_FOLDER"),
        F.current_timestamp().alias("IMPORTED_AT"),
    )


def write_standardized(df: DataFrame, path: str, folder: str = "_source_folder") -> None:
    """Standardized files, one directory per source folder, zstd-compressed."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(folder).parquet(path)


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file below ``path``, whatever the directory names say."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def write_fact(df: DataFrame, path: str, order: Sequence[str] = ("AREA", "OCC_CODE")) -> None:
    """Partition by year and cluster by area and occupation, in place of lookup indexes.

    Range partitioning keeps each file's min/max narrow, so Parquet statistics prune. The
    trailing hash splits a key that holds a large share of the rows over several tasks. The
    bounds come from a sampling pass that reads these columns only, given a columnar input.
    """
    salt = F.pmod(F.xxhash64("NAICS", "OWN_CODE", "TOT_EMP", "A_MEAN", "SOURCE_FILE"), F.lit(_SALTS))
    clustered = df.repartitionByRange("SURVEY_YEAR", *order, salt)
    (
        clustered.sortWithinPartitions("SURVEY_YEAR", *order)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .partitionBy("SURVEY_YEAR")
        .parquet(path)
    )


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in FACT_SCHEMA.fields])


def _versions(spark: SparkSession, base: str, table: str):
    """The folder of a table's publications, and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_versions/{table}")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(folder, system) -> list[int]:
    if not system.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit())


def publish(spark: SparkSession, base: str, table: str, path: str, rows: int) -> int:
    """Make a finished version the current one; returns its sequence number.

    A publication is a file named by the next free number, created only if it is absent, so of two publishers at the same
    moment one is first and the other second, whatever their clocks say.
    """
    folder, system = _versions(spark, base, table)
    number = 1 + max(_numbers(folder, system), default=0)
    local = system.getUri().getScheme() == "file"
    system.mkdirs(folder)
    while True:
        file = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")
        # Hadoop's local file system looks for a file before it creates it, and another may do so in between.
        if local and not spark._jvm.java.io.File(file.toUri().getPath()).createNewFile():
            number += 1
            continue
        try:
            out = system.create(file, local)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            number += 1
            continue
        out.write(json.dumps({"path": path, "rows": rows}).encode())
        out.close()
        return number


def current_version(spark: SparkSession, base: str, table: str) -> str:
    """Path of the publication with the highest number; one that was interrupted before its content does not count."""
    folder, system = _versions(spark, base, table)
    for number in reversed(_numbers(folder, system)):
        stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}"))
        try:
            content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        try:
            return json.loads(content)["path"]
        except ValueError:
            continue
    raise LookupError(f"table was never published: {table}")


def load_table(df: DataFrame, base: str, table: str, expected: DataFrame | None = None) -> DataFrame:
    """Replace a table as a whole, or leave the published one in place.

    The new version is written beside the old one, audited against ``expected``
    (``path, rows`` per source file, the path being ``folder/file``) when given, and only then published.
    """
    spark = df.sparkSession
    path = f"{base}/{table}/{uuid.uuid4().hex}"
    write_fact(df, path)
    loaded = read_fact(spark, path)
    counted = loaded.groupBy("SOURCE_FOLDER", "SOURCE_FILE").agg(F.count(F.lit(1)).alias("rows"))
    counted = counted.withColumn("path", F.concat_ws("/", "SOURCE_FOLDER", "SOURCE_FILE"))
    audit = counted.selectExpr("rows AS loaded_rows", "'ok' AS status") if expected is None else reconcile(expected, counted)
    found = audit.agg(F.count_if(F.col("status") != "ok").alias("wrong"), F.sum("loaded_rows").alias("rows")).first()
    if found["wrong"]:
        raise RuntimeError(f"{found['wrong']} source files do not reconcile; {table} was not published")
    publish(spark, base, table, path, found["rows"] or 0)
    return read_fact(spark, current_version(spark, base, table))


def vintage_audit(
    df: DataFrame,
    path: str,
    year: str = "SURVEY_YEAR",
    file: str = "SOURCE_FILE",
    folder: str = "SOURCE_FOLDER",
) -> DataFrame:
    """Row count and lineage per loaded file.

    All rows of a file carry one year, name and folder or null, so the least non-null value
    is the first one, whatever order the rows arrive in. Text cannot sit in a hash
    aggregation buffer, so names are first grouped, which hashes, and then reduced per path.
    """
    per_name = df.groupBy(path, file, folder).agg(F.min(year).alias("__year"), F.count(F.lit(1)).alias("__rows"))
    return per_name.groupBy(path).agg(
        F.min(file).alias("SOURCE_FILE"),
        F.min(folder).alias("SOURCE_FOLDER"),
        F.min("__year").alias("SURVEY_YEAR"),
        F.sum("__rows").alias("ROW_COUNT"),
    )


def vintage_upsert(audits: DataFrame, key: Sequence[str] = ("SOURCE_FILE",)) -> DataFrame:
    """One vintage per key, the latest winning.

    With the file name alone as key, equal names in different folders replace each other;
    pass ``("SOURCE_FOLDER", "SOURCE_FILE")`` to keep them apart.
    """
    values = [c for c in ("SOURCE_FILE", "SOURCE_FOLDER", "SURVEY_YEAR", "ROW_COUNT") if c not in key]
    # Null years lose: structs compare field by field and null is the smallest value.
    latest = F.max(F.struct("SURVEY_YEAR", "SOURCE_FOLDER", "SOURCE_FILE", "ROW_COUNT"))
    picked = audits.groupBy(*key).agg(latest.alias("__latest"))
    return picked.select(*key, *[F.col(f"__latest.{v}").alias(v) for v in values])


def upsert_vintages(spark: SparkSession, path: str, audits: DataFrame, key: Sequence[str] = ("SOURCE_FILE",)) -> None:
    """Add audits to the vintages at ``path``: those of equal key are replaced, all others stay.

    The table is partitioned by a hash of the key. Only partitions that a new key falls into are merged, first beside the
    table and then put in place by dynamic partition overwrite. An attempt that was interrupted is repeated as it was.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(VINTAGE_BUCKETS)).cast("int").alias("bucket")
    new = vintage_upsert(audits, key).select("*", F.current_timestamp().alias("IMPORTED_AT"), bucket)
    staged = scratch_path(spark, "vintages")
    new.write.parquet(f"{staged}/new")
    new = spark.read.parquet(f"{staged}/new")
    try:
        known = spark.read.parquet(path)
    except AnalysisException:
        known = spark.createDataFrame([], new.schema)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    touched = known.join(new.select("bucket").distinct(), "bucket", "left_semi").select(*new.columns)
    kept = touched.join(new, same(touched, new), "left_anti")
    kept.unionByName(new).write.parquet(f"{staged}/merged")
    merged = spark.read.parquet(f"{staged}/merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def load_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("SOURCE_FILE").alias("files"),
        F.min("SURVEY_YEAR").alias("min_year"),
        F.max("SURVEY_YEAR").alias("max_year"),
    )


def pending_inputs(inputs: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs without any output yet; all of them under ``force``."""
    if force:
        return inputs
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def reconcile(expected: DataFrame, loaded: DataFrame, path: str = "path", rows: str = "rows") -> DataFrame:
    """Expected against loaded rows per file: ``ok``, ``missing``, ``unexpected`` or ``mismatch``."""
    left = expected.select(path, F.col(rows).alias("expected_rows"))
    right = loaded.select(path, F.col(rows).alias("loaded_rows"))
    status = (
        F.when(F.col("loaded_rows").isNull(), "missing")
        .when(F.col("expected_rows").isNull(), "unexpected")
        .when(F.col("expected_rows") == F.col("loaded_rows"), "ok")
        .otherwise("mismatch")
    )
    return left.join(right, path, "full").withColumn("status", status)


def outcome_of(ok, message):
    """``skipped`` when the message says so, else by the success flag."""
    return (
        F.when(F.contains(F.lower(message), F.lit("already")), "skipped")
        .when(ok, "success")
        .otherwise("failed")
    )


def outcome_tally(runs: DataFrame, item: str, ok: str, message: str) -> DataFrame:
    """Per outcome, the number of runs and the sorted distinct items.

    Items are reduced to distinct ones before they are listed; they name survey years.
    """
    per_item = (
        runs.withColumn("status", outcome_of(F.col(ok), F.col(message)))
        .groupBy("status", item)
        .agg(F.count(F.lit(1)).alias("runs"))
    )
    return per_item.groupBy("status").agg(
        F.sum("runs").alias("runs"), F.sort_array(F.collect_list(item)).alias("items")
    )
