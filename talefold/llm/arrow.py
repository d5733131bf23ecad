"""Arrow plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batches(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, so that a batch of long texts stays small in memory."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = 1000) -> DataFrame:
    """mapInArrow with a function that `make` builds once per task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in parts:
            for piece in batches(part, rows):
                out = step(piece)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def sum_counts(df: DataFrame, count: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], buckets: int, slices: int = 64) -> np.ndarray:
    """The sum over all rows of `count`'s arrays of `buckets` numbers; of fixed size, whatever the number of rows.

    Each task adds up its own rows first, then parts of the array are added
    by `slices` tasks; the driver gets one array.
    """
    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        step = count()
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for piece in batches(part, 1000):
                total += step(piece)
        if total.any():
            pack = zstandard.ZstdCompressor(3).compress
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([pack(s.tobytes()) for s in np.split(total, slices)], pa.binary())], ["slice", "counts"])

    return add_slices(df.mapInArrow(own, "slice int, counts binary"), buckets, slices)


def add_slices(parts: DataFrame, buckets: int, slices: int) -> np.ndarray:
    """Adds compressed parts (slice, counts) of arrays of 64-bit numbers."""
    import zstandard

    def add(blobs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for part in blobs:
            for no, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts = np.frombuffer(unpack(blob), np.int64)
                sums[no] = sums[no] + counts if no in sums else counts
        pack = zstandard.ZstdCompressor(3).compress
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(c.tobytes()) for c in sums.values()], pa.binary())], ["slice", "counts"])

    out = np.zeros((slices, buckets // slices), np.int64)
    for row in parts.repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["counts"])), np.int64)
    return out.reshape(-1)


#: Bits of the filter that keeps most other texts out of a join (1 MB, whatever the number of rows).
FILTER_BITS = 1 << 23


def may_be_in(chosen: DataFrame) -> Callable[[Column], Column]:
    """A test on row_id, never false for a row of `chosen`."""
    bit = F.pmod(F.col("row_id"), F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    words = chosen.groupBy(F.bitmap_bucket_number(bit).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS, bool)
    for row in words:
        low = (row["no"] - 1) * 32768
        part = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        at = low + np.flatnonzero(part)
        bits[at % FILTER_BITS] = True
    packed = chosen.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def test(row_id: pd.Series) -> pd.Series:
        x = row_id.to_numpy().astype(np.int64) % FILTER_BITS
        return pd.Series((packed.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1).astype(bool)

    return test
