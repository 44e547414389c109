"""The observation store: a Parquet table partitioned by ``source``
(S1 scan, S2 append with schema completion, S3 schema alignment, S4 CSV
full-replace load with a count check, U1 append = UNION ALL).

Writes go through Spark's file commit protocol, so a lost executor's
partial output is never committed and a retried job does not duplicate
rows of a failed attempt.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import schemas as S


def align_to_schema(df: DataFrame, schema: StructType = S.OBSERVATIONS) -> DataFrame:
    """S3: the declared columns in declared order; absent ones as typed
    NULLs, present ones cast, a value that does not cast as NULL.  A
    structured ``metadata`` becomes JSON text."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f"`{f.name}`")
            if f.name == "metadata" and not isinstance(df.schema[f.name].dataType, StringType):
                c = F.to_json(c)
            cols.append(c.try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def scan_observations(spark: SparkSession, path: str, schema: StructType = S.OBSERVATIONS) -> DataFrame:
    """The whole table; a missing table reads as empty."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append_observations(df: DataFrame, path: str, schema: StructType = S.OBSERVATIONS) -> bool:
    """Append rows (no dedup), completing missing columns first.
    An empty input is a successful no-op; a failed write raises.

    Each write task sorts its rows by (source, product, seq): a local sort,
    no shuffle.  With the partition column first the writer needs no sort
    of its own, and Parquet row-group statistics then let a product lookup
    skip row groups.
    """
    if df.isEmpty():
        return True
    (align_to_schema(df, schema).sortWithinPartitions("source", "product_name", "seq")
     .write.mode("append").partitionBy("source").parquet(path))
    return True


#: Fields may be quoted, hold quotes (doubled) and line ends.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


_SPLITS = "file long, start long, flips long, if_outside long, if_quoted long, odd_lines long"


def csv_splits(spark: SparkSession, csv_path: str) -> DataFrame:
    """One row for each byte split of CSV files, read line by line: how often
    its lines turn quoted into unquoted and back (``flips``), the records that
    end in it if it begins outside quotes (``if_outside``) and inside
    (``if_quoted``), and its lines of white space only.  Lines never leave their
    task: a split's running parity is a prefix sum over its own lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(csv_path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.pmod(quotes, F.lit(2)).cast("long").alias("odd"), F.when(F.col("value") == "", 0).otherwise(1).cast("long").alias("full"),
        ((F.col("value") != "") & (F.trim("value") == "")).cast("long").alias("blank"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        at, sums = None, None    # the split being read: (file, start), its four sums
        for batch in batches:
            file, start, odd, full, blank = (batch.column(i).to_numpy() for i in range(5))
            edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
            done = []
            for a, b in zip([0, *edges], [*edges, len(file)]):
                if a == b:
                    continue
                if at != (file[a], start[a]):
                    if at is not None:
                        done.append((*at, *sums))
                    at, sums = (file[a], start[a]), [0, 0, 0, 0]
                quoted = (np.cumsum(odd[a:b]) + sums[0]) % 2
                sums = [sums[0] + int(odd[a:b].sum()), sums[1] + int((full[a:b] * (1 - quoted)).sum()),
                        sums[2] + int((full[a:b] * quoted).sum()), sums[3] + int(blank[a:b].sum())]
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, map(int, d))) for d in done])
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, map(int, (*at, *sums))))])
    return lines.mapInArrow(run, _SPLITS)


def csv_count(spark: SparkSession, csv_path: str) -> tuple[int, bool]:
    """Records of CSV files by their line ends outside quotes, headers and empty
    lines not counted, and whether every line is a record: a count that does not
    come from the CSV parser.  Quotes stand as RFC 4180 has them (doubled inside
    quoted fields, none inside bare ones); a quote left open ends with its file.

    Each split carries its records for both parities at its begin; the parity of
    all splits before it in the file tells which holds."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.pmod(F.coalesce(F.sum("flips").over(before), F.lit(0)), F.lit(2)) == 1
    splits = csv_splits(spark, csv_path).select("*", quoted.alias("quoted"))
    files = splits.groupBy("file").agg(
        (F.sum(F.when(F.col("quoted"), F.col("if_quoted")).otherwise(F.col("if_outside"))) + F.pmod(F.sum("flips"), F.lit(2))).alias("records"),
        F.sum(F.col("if_outside") + F.col("if_quoted")).alias("lines"), F.sum("odd_lines").alias("odd_lines"))
    got = files.agg(F.sum(F.greatest(F.col("records") - 1, F.lit(0))).alias("n"),
                    F.bool_and((F.col("records") == F.col("lines")) & (F.col("odd_lines") == 0)).alias("plain")).first()
    return got["n"] or 0, bool(got["plain"])


def csv_record_count(spark: SparkSession, csv_path: str) -> int:
    """The records of ``csv_count``."""
    return csv_count(spark, csv_path)[0]


def csv_replace_load(spark: SparkSession, csv_path: str, table_path: str,
                     column_map: Mapping[str, str] | None = None,
                     csv_schema: StructType | None = None,
                     schema: StructType = S.OBSERVATIONS) -> DataFrame:
    """Replace the table with a CSV file's rows and verify the count.

    ``column_map`` renames CSV columns to table columns (other CSV layouts,
    e.g. ``{"Date": "timestamp", "Price": "price"}``).  Files whose every line
    is a record are parsed split by split; line ends inside quotes leave a file
    to one task, as the parser then has to read it from its begin.
    """
    n_src, plain = csv_count(spark, csv_path)
    r = spark.read.options(**CSV_OPTIONS | {"multiLine": str(not plain).lower()})
    src = (r.schema(csv_schema) if csv_schema is not None else r).csv(csv_path)
    if column_map:
        src = src.withColumnsRenamed(dict(column_map))
    align_to_schema(src, schema).write.mode("overwrite").partitionBy("source").parquet(table_path)
    table = scan_observations(spark, table_path, schema)
    n_dst = table.count()
    if n_src != n_dst:
        raise RuntimeError(f"load verification failed: {n_src} rows in, {n_dst} rows stored")
    return table
