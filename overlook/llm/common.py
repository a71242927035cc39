"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so (Spark does not mind case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_part(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls in no part."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


@contextmanager
def bounded(spark: SparkSession, records: int = 1000, nbytes: int = 16 << 20):
    """Smaller Arrow batches for the actions inside; the session's own settings hold again afterwards."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": str(nbytes)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sliced(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1000, nbytes: int = 16 << 20):
    """``run`` over batches of at most ``rows`` rows and about ``nbytes`` bytes, and its results cut likewise."""

    def pieces(batches):
        for b in batches:
            at = 0
            while at < b.num_rows:
                n = min(rows, b.num_rows - at)
                while n > 1 and b.slice(at, n).get_total_buffer_size() > nbytes:
                    n //= 2
                yield b.slice(at, n)
                at += n
            if not b.num_rows:
                yield b

    return lambda batches: run(pieces(batches))
