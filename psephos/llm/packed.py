"""Tables of sorted 64-bit codes, packed into one row per key.

A row holds a key, the sorted codes that belong to it and one value per code, as bytes.  Codes of
different keys do not overlap and keep the order of the keys, so that rows sorted by key
are one sorted run of codes.  Work on a partition streams over its rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.tables import columns

#: Codes that are merged at a time.
CHUNK = 1 << 20

MERGED = pa.schema([("key", pa.int64()), ("codes", pa.binary()), ("sums", pa.binary())])


def unpacked(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    size = int(offsets[-1] - offsets[0])
    values = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return values.view(dtype) if values.ctypes.data % 8 == 0 else values.copy().view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary row from each bound to the next."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int64)
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of the values of each."""
    if not len(codes):
        return codes, values
    order = np.argsort(codes)
    codes, values = codes[order], values[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(values, first)


def key_bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def rows_by_key(keys: np.ndarray, codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    bounds = key_bounds(keys)
    return columns(MERGED, key=keys[bounds[:-1]], codes=packed(codes, bounds), sums=packed(sums, bounds))


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (key, codes, sums as doubles) to one row per key."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting
        keys, codes, sums = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(codes)
        keys, codes, sums = keys[order], codes[order], sums[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        keys, codes, sums = keys[first], codes[first], np.add.reduceat(sums, first)
        cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        held, waiting = ([(keys[cut:], codes[cut:], sums[cut:])], len(keys) - cut) if cut < len(keys) else ([], 0)
        if cut:
            yield rows_by_key(keys[:cut], codes[:cut], sums[:cut])

    for batch in batches:
        if not batch.num_rows:
            continue
        codes, lengths = unpacked(batch.column("codes"), "<u8")
        sums, _ = unpacked(batch.column("sums"), "<f8")
        held.append((np.repeat(np.asarray(batch.column("key")), lengths), codes, sums))
        waiting += len(codes)
        if waiting >= CHUNK:
            before = waiting
            yield from flush(False)
            # A key that alone exceeds the chunk is merged when as much again has come.
            waiting = waiting if waiting < before // 2 else 0
    if held and sum(len(x[0]) for x in held):
        yield from flush(True)


def merged(rows: DataFrame, groups: int) -> DataFrame:
    """One row per key from rows (key, block, codes, sums).

    A key that comes from every block is merged in ``groups`` parts first, then the parts.
    """
    schema = "key long, codes binary, sums binary"
    salted = rows.withColumn("salt", F.pmod(F.hash("block"), F.lit(groups)))
    parts = salted.repartition("key", "salt").sortWithinPartitions("key").select("key", "codes", "sums").mapInArrow(merge, schema)
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema)


def answers(requests: DataFrame, table: DataFrame, groups: int, dtype: str) -> DataFrame:
    """(key, block, found): the value of each code of each request (key, block, codes), in the same order.

    ``table`` has one row per key (key, codes, found as ``dtype``), and every code that is asked for.
    A key that every block asks for is served in ``groups`` places.
    """
    schema = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("found", pa.binary())])

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        codes, values = np.zeros(0, "<u8"), np.zeros(0, dtype)
        for batch in batches:
            keys, kinds = np.asarray(batch.column("key")), np.asarray(batch.column("kind"))
            tables = np.flatnonzero(kinds == 0)
            if len(tables):
                own = keys[tables]
                new = own != np.append(last if last is not None else -1, own[:-1])
                rows = batch.take(pa.array(tables[new]))
                more, _ = unpacked(rows.column("codes"), "<u8")
                found, lengths = unpacked(rows.column("found"), dtype)
                tail = len(codes) - carried if last is not None else 0
                codes, values = np.concatenate([codes[tail:], more]), np.concatenate([values[tail:], found])
                if len(lengths):
                    last, carried = int(own[-1]), int(lengths[-1])
            asked = np.flatnonzero(kinds == 1)
            if len(asked):
                rows = batch.take(pa.array(asked))
                wanted, lengths = unpacked(rows.column("codes"), "<u8")
                bounds = np.append(0, np.cumsum(lengths))
                out = values[np.searchsorted(codes, wanted)]
                yield columns(schema, key=rows.column("key"), block=rows.column("block"), found=packed(out, bounds))

    salts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("salt")
    served = table.select("key", F.lit(None).cast("long").alias("block"), "codes", "found", F.lit(0).alias("kind"), salts)
    asking = requests.select(
        "key", "block", "codes", F.lit(None).cast("binary").alias("found"), F.lit(1).alias("kind"),
        F.pmod(F.hash("block"), F.lit(groups)).alias("salt"),
    )
    both = served.unionByName(asking).repartition("key", "salt").sortWithinPartitions("key", "kind", "salt")
    return both.select("key", "block", "codes", "found", "kind").mapInArrow(serve, "key long, block long, found binary")
