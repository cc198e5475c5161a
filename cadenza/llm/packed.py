"""Exchange of 64-bit keys in packed form.

Each task packs its keys into one binary row for each range of keys, so that an exchange moves 8 or 16
bytes a key and no row for each. Ranges are equal shares of the hash space: as a task gives a key
twice at most, however often it has it, no key and no group of copies can make a range large. A
receiving task holds its range's keys only; more partitions make it smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(keys: np.ndarray) -> np.ndarray:
    """Rows of ``keys`` (n x words) in order."""
    if keys.shape[1] == 1:
        return np.sort(keys, axis=0)
    return keys[np.lexsort(keys.T[::-1])]


def at_most_twice(keys: np.ndarray) -> np.ndarray:
    """Ordered rows, with no row more than two times."""
    return keys if len(keys) < 3 else keys[np.concatenate([[True, True], (keys[2:] != keys[:-2]).any(axis=1)])]


def ranges(first: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the ``parts`` ranges begins in the sorted keys, and their number."""
    bounds = np.array([-(-p * (1 << 64) // parts) for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(first, bounds), [len(first)]])


def packed(keys: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Range numbers and bytes of the ordered rows of keys, for ranges with any."""
    at = ranges(keys[:, 0], parts)
    some = np.flatnonzero(np.diff(at))
    return some.tolist(), [keys[at[p] : at[p + 1]].tobytes() for p in some]


def unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, width)


def views(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's keys, without a copy."""
    offsets, data = (np.frombuffer(b, t) if b is not None else np.zeros(0, t) for b, t in zip(column.buffers()[1:], (np.int64 if pa.types.is_large_binary(column.type) else np.int32, np.uint8), strict=True))
    at = offsets[column.offset : column.offset + len(column) + 1]
    return [data[a:z].view(np.uint64).reshape(-1, width) for a, z in zip(at[:-1], at[1:], strict=True)]


def in_pieces(rows: list[np.ndarray], number: int) -> Iterator[np.ndarray]:
    """All keys of some rows, each of which is in order, by ranges of the first word; in order and together in memory only by range."""
    rows = [r for r in rows if len(r)]
    if not rows:
        return
    low, high = min(int(r[0, 0]) for r in rows), max(int(r[-1, 0]) for r in rows)
    bounds = np.array([low + (high - low) * i // number for i in range(1, number)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(r[:, 0], bounds), [len(r)]]) for r in rows]
    for i in range(number):
        some = [r[c[i] : c[i + 1]] for r, c in zip(rows, cuts, strict=True) if c[i + 1] > c[i]]
        if some:
            yield ordered(np.concatenate(some))


def recurring(keys: DataFrame, parts: int, width: int) -> DataFrame:
    """From (part, block, blob) to (block, blob): of each block's keys those that occur twice or more in all blocks together.

    A block must give its keys in one row a range, each key twice at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, owners = [], []
        for b in batches:
            for block, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                blobs.append(blob)
                owners.append(np.full(len(blob) // (8 * width), block, np.int32))
        if not blobs:
            return
        own = np.concatenate(owners)
        every = unpacked(blobs, width)
        del blobs, owners
        order = np.argsort(every[:, 0], kind="stable") if width == 1 else np.lexsort(every.T[::-1])
        every, own = every[order], own[order]
        same = (every[1:] == every[:-1]).all(axis=1)
        again = np.zeros(len(every), bool)
        again[1:] |= same
        again[:-1] |= same
        every, own = every[again], own[again]
        order = np.argsort(own, kind="stable")
        every, own = every[order], own[order]
        blocks, begins = np.unique(own, return_index=True)
        ends = [*begins[1:], len(own)]
        for at in range(0, len(blocks), 4096):
            rows = list(zip(blocks[at : at + 4096].tolist(), begins[at : at + 4096], ends[at : at + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([every[a:z].tobytes() for _, a, z in rows], pa.binary())], names=["block", "blob"])

    return keys.repartition(parts, "part").select("part", "block", "blob").mapInArrow(run, "block int, blob binary")


def block_of(number: int, *columns: str):
    """A block for each row, by its content."""
    return F.pmod(F.xxhash64(*columns), F.lit(number)).cast("int")
