"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.session import fresh_path

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder (``spark.checkpoint.dir``) and
    read back: later plans start from files that outlive any executor."""
    path = fresh_path(df.sparkSession, f"llm/{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system.  Python workers live on between tasks, and beside them
    the executor needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):           # not a GNU libc
        pass


def freeing(f):
    """``f`` (a generator over batches) that gives its task's memory back at the end."""
    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def freeing_group(f):
    """The same for a function of one group's table."""
    @functools.wraps(f)
    def run(table):
        try:
            return f(table)
        finally:
            give_back()

    return run


def over_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a generator of column dicts; nothing is kept between batches."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for cols in f(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[x.name], type=x.type) if not isinstance(cols[x.name], (pa.Array, pa.ChunkedArray))
                     else cols[x.name].cast(x.type) for x in out], schema=out)

    return df.mapInArrow(freeing(run), schema)


BROADCAST_IDS = 1_000_000       # so many ids (16 MB) are broadcast at most


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the first column of ``ids``.  Few ids are
    broadcast, so that the texts aren't shuffled; more are joined as they are."""
    ids = stored(ids.select(F.col(ids.columns[0]).alias("_drop_id")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["_drop_id"], "left_anti")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def first_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``key`` (all rows if there are fewer).  Only rows
    below a hash that about 4n rows pass are sorted, so what moves doesn't grow with the input;
    the bound is widened until n rows pass, so the result is exact."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows, share = df.count(), 1.0
    kept = df
    if rows > 8 * n:
        share = 4.0 * n / rows
        while share < 1.0:
            kept = df.where(h < F.lit(int(-(2**63) + share * 2**64)))
            if kept.count() >= n:
                break
            kept, share = df, share * 4
    return kept.orderBy(h, key).limit(n)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def pack(a: np.ndarray) -> bytes:
    """An array as bytes, bytes of equal rank together: sorted values compress well so."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()
