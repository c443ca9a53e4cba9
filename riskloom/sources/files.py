"""Reading and writing tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.staging import stage
from .schemas import BORROWERS, LOANS, REPAYMENTS, assert_schema


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, typed by ``schema``; a malformed row is an error, not a silent NULL."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    return reader.option("dateFormat", "yyyy-MM-dd").csv(path)


def read_csv_rejects(
    spark: SparkSession, path: str, schema: StructType, *, sep: str = ",", header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): a bad line does not end the load.

    Rejects have ``file``, ``line`` (its text) and ``reason``: the columns whose values do not fit
    their types, or ``number of columns``. The parsed rows are staged, so the files are read once.
    """
    bad = "_rejected"
    wide = StructType([*schema.fields, StructField(bad, StringType())])
    reader = spark.read.schema(wide).option("header", header).option("mode", "PERMISSIVE").option("sep", sep)
    reader = reader.option("columnNameOfCorruptRecord", bad).option("dateFormat", "yyyy-MM-dd")
    parsed = stage(reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file")), "parsed")
    good = parsed.where(F.col(bad).isNull()).select(*schema.fieldNames())
    # the texts of the few bad lines, column by column
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    as_text = F.from_csv(bad, texts.simpleString()[7:-1].replace(":", " "), {"sep": sep})
    lines = parsed.where(F.col(bad).isNotNull()).select("_file", bad, as_text.alias("_t"))
    wrong = [
        F.when(
            F.col("_t")[f.name].isNotNull() & F.col("_t")[f.name].try_cast(f.dataType).isNull(), F.lit(f.name)
        )
        for f in schema.fields
    ]
    named = F.concat_ws(", ", *wrong)
    reason = F.when(named != "", named).otherwise(F.lit("number of columns"))
    rejects = lines.select(F.col("_file").alias("file"), F.col(bad).alias("line"), reason.alias("reason"))
    return good, rejects


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if schema is None else assert_schema(df, schema)


def read_loan_book(
    spark: SparkSession, folder: str, fmt: str = "csv"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """borrowers, loans and repayments from ``<folder>/<table>.<fmt>``."""
    tables = {"borrowers": BORROWERS, "loans": LOANS, "repayments": REPAYMENTS}
    read = read_csv if fmt == "csv" else read_parquet
    return tuple(read(spark, f"{folder}/{name}.{fmt}", schema) for name, schema in tables.items())


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for report-sized tables only."""
    (df.coalesce(1) if single_file else df).write.option("header", True).csv(path)


def write_result_set(tables: dict[str, DataFrame], folder: str) -> None:
    """Metrics, curves, feature names and coefficients as Parquet tables below one folder."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def read_result_set(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


# -- results that are replaced as a whole ----------------------------------------------------

CURRENT = "_current"


def _files(spark: SparkSession, folder: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm.org.apache.hadoop.fs, path.getFileSystem(conf), conf


def published(spark: SparkSession, folder: str) -> dict[str, str]:
    """What a published folder shows: run id per partition (of one key "" if it has none)."""
    fs, files, _ = _files(spark, folder)
    if not files.exists(fs.Path(f"{folder}/{CURRENT}")):
        return {}
    stream = files.open(fs.Path(f"{folder}/{CURRENT}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(df: DataFrame, folder: str, *, partition: str | None = None, run: str | None = None) -> str:
    """Write ``df`` below ``folder`` under a run id and show it in one step; returns the run id.

    The rows go to a folder of their own. Only when they are all there does the small file ``_current``,
    which says what readers see, take its new state by one rename. A job that ends half-way leaves the
    old result as it was. With ``partition`` only the partitions that ``df`` has are replaced. One
    publisher at a time per folder; runs that are no longer shown can be deleted by :func:`retire`.
    """
    spark = df.sparkSession
    run = run or uuid.uuid4().hex
    target = f"{folder}/run={run}"
    if partition is None:
        df.write.parquet(target)
        state = {"": run}
    else:
        key = F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit("null"))
        df.withColumn("_part", key).write.partitionBy("_part").parquet(target)
        parts = spark.read.parquet(target).select("_part").distinct().collect()  # as many as folders
        state = published(spark, folder) | {r[0]: run for r in parts}
        state.pop("", None)
    fs, files, conf = _files(spark, folder)
    fresh = fs.Path(f"{folder}/{CURRENT}.{run}")
    out = files.create(fresh, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    context = fs.FileContext.getFileContext(files.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(fs.Path(f"{folder}/{CURRENT}")), options)
    return run


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a published folder shows."""
    state = published(spark, folder)
    if not state:
        raise FileNotFoundError(f"nothing published in {folder}")
    by_run: dict[str, list[str]] = {}
    for part, run in state.items():
        by_run.setdefault(run, []).append(part)
    tables = []
    for run, parts in sorted(by_run.items()):
        rows = spark.read.parquet(f"{folder}/run={run}")
        if parts != [""]:
            rows = rows.where(F.col("_part").isin(parts)).drop("_part")  # prunes folders
        tables.append(rows)
    return reduce(DataFrame.unionByName, tables)


def retire(spark: SparkSession, folder: str) -> int:
    """Delete the runs below ``folder`` that are not shown. No publisher may be at work."""
    shown = set(published(spark, folder).values())
    fs, files, _ = _files(spark, folder)
    gone = 0
    for status in files.listStatus(fs.Path(folder)):
        name = status.getPath().getName()
        if name.startswith("run=") and name[4:] not in shown:
            gone += bool(files.delete(status.getPath(), True))
    return gone
