"""Browsing the raw data: keyword and regex search, paging, counts, the
data-file catalogue and JSON export (P4, P5, O3, A12, S6, S10)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.store import CSV_OPTIONS

SEARCH_COLUMNS = ["product_name", "review_text", "source"]


def like_pattern(term: str) -> str:
    """``%term%``; a backslash in the term stands for itself."""
    return "%" + term.replace("\\", "\\\\") + "%"


def search_keyword(df: DataFrame, term: str, columns=SEARCH_COLUMNS) -> DataFrame:
    """Case-insensitive LIKE ``%term%`` over the given columns, OR-ed.
    ``%`` and ``_`` inside the term remain wildcards, as in the original."""
    if not term:
        return df
    pat = like_pattern(term)
    cond = None
    for c in columns:
        e = F.coalesce(F.col(c).ilike(pat), F.lit(False))
        cond = e if cond is None else (cond | e)
    return df.where(cond)


def search_any_column(df: DataFrame, term: str) -> DataFrame:
    """P5: rows where any column, read as text, matches ``term`` as a
    case-insensitive regular expression.  NULL cells never match."""
    if not term:
        return df
    rx = F.lit("(?i)" + term)
    cond = None
    for c in df.columns:
        e = F.coalesce(F.regexp_like(F.col(f"`{c}`").cast("string"), rx), F.lit(False))
        cond = e if cond is None else (cond | e)
    return df.where(cond)


@dataclass
class Page:
    rows: DataFrame
    total_rows: int
    page: int
    page_size: int
    total_pages: int


def page_numbers(total_rows: int, page: int, page_size: int = S.PAGE_SIZE) -> tuple[int, int]:
    """O3: ``pages = max(1, ceil(n / size))`` and the page clamped to it."""
    pages = max(1, (total_rows + page_size - 1) // page_size)
    return max(1, min(page, pages)), pages


#: Rows of a range of the rank index, and the most ranges it has.
RANGE_ROWS, MOST_RANGES = 50_000, 10_000


def _rank_key(df: DataFrame, order_by: str) -> Column:
    """The order of pages: the key (NULLs first), then a hash of the row, so
    that rows that tie on the key keep one order and lie in several ranges."""
    return F.struct(F.col(order_by).alias("key"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("tie"))


def rank_index(df: DataFrame, order_by: str = "seq", total_rows: int | None = None) -> list[Row]:
    """O3: the rank index of a table in the order of a key: ranges ``(low, high,
    n, before)`` with the rows of each and of all before it.

    Only keys and row hashes are shuffled, by range; a range is one row here, and
    there are at most ``MOST_RANGES`` (so beyond 500 million rows ranges grow).
    One index serves all pages of a table.  Rows equal in all columns share a
    range."""
    n = df.count() if total_rows is None else total_rows
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    keys = df.select(_rank_key(df, order_by).alias("k")).repartitionByRange(ranges, "k")
    per = keys.groupBy(F.spark_partition_id().alias("range")).agg(
        F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("low", "high", "n", before.alias("before")).orderBy("low").collect()


def paginate(df: DataFrame, page: int = 1, page_size: int = S.PAGE_SIZE, order_by: str = "seq",
             total_rows: int | None = None, index: list[Row] | None = None) -> Page:
    """O3 + A12: one page of rows in the order of a key (NULLs first).

    The rank index tells which ranges of the key hold the page; only their rows
    are sorted, so a page costs the same whatever its number.  The bounds of the
    key are a filter on the scan."""
    if index is None:
        index = rank_index(df, order_by, total_rows)
    n = sum(r["n"] for r in index)
    p, pages = page_numbers(n, page, page_size)
    first = (p - 1) * page_size
    held = [r for r in index if r["before"] < first + page_size and r["before"] + r["n"] > first]
    if not held:
        return Page(df.limit(0), n, p, page_size, pages)
    low, high = held[0]["low"], held[-1]["high"]
    kind = df.schema[order_by].dataType
    k, col = _rank_key(df, order_by), F.col(order_by)

    def bound(r):
        return F.struct(F.lit(r["key"]).cast(kind).alias("key"), F.lit(r["tie"]).cast("long").alias("tie"))

    rows = df.where((k >= bound(low)) & (k <= bound(high)))
    if high["key"] is not None:
        rows = rows.where(col.isNull() | (col <= F.lit(high["key"]).cast(kind)) if low["key"] is None
                          else col.between(F.lit(low["key"]).cast(kind), F.lit(high["key"]).cast(kind)))
    rows = rows.orderBy(k).offset(first - held[0]["before"]).limit(page_size)
    return Page(rows, n, p, page_size, pages)


def page_counts(df: DataFrame, term: str, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """Whole-table rows, matching rows and pages, in one aggregation."""
    pat = like_pattern(term)
    hit = None
    for c in SEARCH_COLUMNS:
        e = F.coalesce(F.col(c).ilike(pat), F.lit(False))
        hit = e if hit is None else (hit | e)
    agg = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(hit).alias("matched_rows"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("matched_rows") / F.lit(page_size))).cast("long")
    return agg.withColumn("total_pages", pages)


def file_catalog(spark: SparkSession, root: str, extensions=S.DATA_FILE_EXTENSIONS) -> DataFrame:
    """Data files under ``root`` (recursive) with one of the
    extensions, newest first: name, path, path below ``root``, size and time of
    change; only file metadata is read, not contents."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root))
    name = F.element_at(F.split("path", "/"), -1)
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/") + "/"   # Spark may spell the scheme otherwise
    below = F.substr("path", F.locate(top, F.col("path")) + F.lit(len(top)))
    return files.select(name.alias("name"), "path", below.alias("relative_path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def read_flat_file(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Reader chosen by the file extension (csv with header and quoted
    fields; json as lines or, where the text begins with a bracket, as arrays)."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext == "csv":
        r = spark.read.options(**CSV_OPTIONS)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
        return r.csv(path)
    if ext == "json":
        begin = spark.read.text(path).where(F.trim("value") != "").first()
        array = begin is not None and begin["value"].lstrip("\ufeff \t").startswith("[")
        r = spark.read.option("multiLine", str(array).lower())
        return (r.schema(schema) if schema is not None else r).json(path)
    if ext == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type: .{ext}")


def export_json(df: DataFrame) -> DataFrame:
    """One JSON record per row, NULLs kept as JSON null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("json"))
