"""Line and state files: tolerant JSON lines pruned by month, single documents, tables with unknown delimiters, sinks."""

from __future__ import annotations

import csv
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are none."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    whole = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return whole.filter(F.col(BAD).isNull()).drop(BAD), whole.filter(F.col(BAD).isNotNull()).select(BAD)


def write_months(df: DataFrame, path: str, at: Column) -> None:
    """JSON lines in a folder per month; months that df doesn't hold stay."""
    rows = df.withColumn("month", F.date_format(at, "yyyy-MM"))
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").json(path)


def read_months(spark: SparkSession, path: str, schema: T.StructType, since: str) -> DataFrame:
    """Rows of months from that of `since` (a day) on; earlier folders aren't read."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("month", T.StringType())]) if "month" not in schema.names else schema).json(path).filter(F.col("month") >= since[:7])


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The object of a one-document file; fields are null where it is invalid."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def sniffed_csv(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """A table whose delimiter is found from its first lines and whose encoding from the whole of it.

    Columns are renamed by `aliases`, whose keys are compared without case and blanks.
    """
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("head"), F.expr("is_valid_utf8(cast(content as string))").alias("utf8")).first()
    name = "UTF-8" if row.utf8 else "ISO-8859-1"
    try:
        mark = csv.Sniffer().sniff(bytes(row.head).decode("utf-8-sig" if row.utf8 else "cp1252", "replace"), delimiters=",;\t|").delimiter
    except csv.Error:
        mark = ","
    rows = spark.read.option("header", True).option("sep", mark).option("encoding", name).csv(path)
    named = {k.strip().lower(): v for k, v in (aliases or {}).items()}
    return rows.toDF(*[named.get(c.strip().lower(), c) for c in rows.columns])


def feed_document(rows: DataFrame, order: list[Column], path: str) -> None:
    """One deterministic JSON line a row, in order, in one file: for exports of bounded size."""
    rows.orderBy(*order).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def registry(spark: SparkSession, path: str, schema: T.StructType, required: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A registry file (JSON or YAML list of records) as rows that hold, and errors (key, problem) of every record that doesn't.

    A registry is edited by hand and fits the driver. Unknown fields, missing required ones and repeated keys are errors;
    all of them are collected.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        records = json.loads(text)
    except ValueError:
        import yaml  # only where it is installed

        records = yaml.safe_load(text)
    rows, errors, seen = [], [], set()
    for k, record in enumerate(records if isinstance(records, list) else []):
        name = str(record.get(key) if isinstance(record, dict) else None or f"#{k}")
        problems = ["no record"] if not isinstance(record, dict) else [f"unknown field {f}" for f in sorted(set(record) - set(schema.names))] + [f"no {f}" for f in required if record.get(f) in (None, "", [])]
        if not problems and name in seen:
            problems = ["repeated"]
        seen.add(name)
        errors += [(name, p) for p in problems]
        if not problems:
            rows.append(tuple(record.get(f) for f in schema.names))
    if not isinstance(records, list):
        errors.append(("", "no list"))
    return spark.createDataFrame(rows, schema), spark.createDataFrame(errors, f"{key} string, problem string")
