"""Small helpers that several operators share."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.text import BLOCK_BYTES, blocks

#: A group with more than this share of all rows is joined by broadcast; so at most this many are.
HOT_SHARE = 1000
#: Most bits of a filter on keys, which travels to every task.
FILTER_BITS = 1 << 28


def by_block(
    docs: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``work`` on every block of rows of ``docs``; a block holds ``limit`` bytes of text or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, limit):
                out = work(block)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return docs.mapInArrow(run, schema)


def give_back() -> None:
    """Return the memory that a finished task has freed, as its Python process stays for later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def key_filter(keys: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """Bits of a filter on the long column ``key`` of stored ``keys``, and their number, a power of two.

    About eight bits a key, ``FILTER_BITS`` at most; beyond that more keys pass, none is lost.
    """
    size = 1 << 16
    while size < min(8 * keys.count(), FILTER_BITS):
        size *= 2
    slot = F.col(key).bitwiseAND(size - 1)
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("bits")
    ).toArrow()  # a row per 64 bits
    bits = np.zeros(size // 64, np.uint64)
    bits[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return bits, size


def passes(bits: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """Which 64-bit ``values`` the filter lets through."""
    slots = values.view(np.int64) & (size - 1)
    return ((bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def columns(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays by name."""
    arrays = []
    for field in schema:
        value = values[field.name]
        if isinstance(value, (pa.Array, pa.ChunkedArray)):
            arrays.append(value.cast(field.type))
        else:
            arrays.append(pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def by_position(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by position, so that no name clashes with one added, and the new names of ``wanted``."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(name)] for name in wanted]


def place(text: str) -> Column:
    """With the id, tells rows apart: a hash of the text, a null text being an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row per ``key``.

    Groups of more than a thousandth of all rows, of which there are a thousand at most, are
    broadcast, so that no key of the sort-merge join holds more.  Both tables are read
    twice and should be stored ones.
    """
    least = groups.agg((F.sum(size) / HOT_SHARE).alias("least")).first()["least"] or 0
    large = groups.filter(F.col(size) > F.lit(least))
    small = groups.filter(F.col(size) <= F.lit(least))
    hot = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
    return hot.unionByName(rest)
