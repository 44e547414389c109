"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

#: Bytes of text a Python step works on at a time.
STEP_BYTES = 16 << 20


_HELD: dict = {}


def worker_state(key, make):
    """What a Python worker keeps between steps and tasks, one thing at a time:
    a worker that goes on to another operator lets the former's go."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Hands the memory that a former operator freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def settled(df: DataFrame) -> DataFrame:
    """``materialize(df)``; then the driver collects its garbage, upon which
    Spark deletes the shuffle files that only the steps before it have read."""
    out = materialize(df)
    jvm = getattr(df.sparkSession, "_jvm", None)  # None under Spark Connect
    if jvm is not None:
        gc.collect()
        jvm.System.gc()
    return out


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def steps(batches: Iterator[pa.RecordBatch], col: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of ``col`` (one row at
    least), so that a run of long texts does not pile up in a worker."""
    for batch in batches:
        arr = batch.column(batch.schema.get_field_index(col))
        if batch.num_rows == 0:
            continue
        off = np.frombuffer(arr.buffers()[1], np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
                            else np.int32, count=arr.offset + len(arr) + 1)[arr.offset:]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def texts_of(batch: pa.RecordBatch, col: str) -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def with_columns(df: DataFrame, col: str, new: list[T.StructField],
                 fn: Callable[[pa.RecordBatch], list], limit: int = STEP_BYTES) -> DataFrame:
    """``df`` with the columns ``new`` computed by ``fn`` from each slice of
    rows; an input column of the same name is replaced."""
    names = {f.name.lower() for f in new}
    keep = [c for c in df.columns if c.lower() not in names or c == col]
    kept = df.select(*map(quoted, keep))
    out = [f for f in kept.schema.fields if f.name.lower() not in names]
    arrow = [to_arrow_type(f.dataType) for f in new]
    passed, final = [f.name for f in out], [f.name for f in out + new]
    # plain names on the way: those of the caller may hold any characters
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(out + new)])

    def run(batches):
        named = (pa.RecordBatch.from_arrays(b.columns, names=keep) for b in batches)
        for batch in steps(named, col, limit):
            made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(fn(batch), arrow)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays(cols + made, names=plain.names)

    return kept.toDF(*[f"c{i}" for i in range(len(keep))]).mapInArrow(run, plain).toDF(*final)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i]:starts[i] + lens[i]]`` one after another."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


def offsets(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out
