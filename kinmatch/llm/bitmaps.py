"""Broadcast bitmaps of 64-bit hashes: a bounded size, no hash of the set is ever missed, others may pass."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BLOCK = 20, 30, 16
SECOND = 33  # a value's second bit is that of its upper part


class Bitmap:
    """The bits of a set, broadcast; ``holds`` is for workers."""

    def __init__(self, broadcast, full: bool):
        self.shared, self.full = broadcast, full

    def holds(self, x: np.ndarray) -> np.ndarray:
        bits = self.shared.value
        mask = np.uint64(8 * len(bits) - 1)
        out = np.ones(len(x), bool)
        for k in (x.view(np.uint64) & mask, x.view(np.uint64) >> np.uint64(SECOND) & mask):
            out &= (bits[(k >> np.uint64(3)).view(np.int64)] >> (k & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def release(self) -> None:
        """Deletes it on the driver and all executors, which keep a file each; no plan may use it afterwards."""
        self.shared.destroy()


def bitmap(rows: DataFrame, column: str, per_value: int = 16) -> Bitmap:
    """A bitmap of a long column of a stored table; nulls are left out.

    It has ``per_value`` bits or more for each row, 128 KB at least and 128 MB at most; ``full`` tells that the bound left
    it with less than half of that, so that more of the other hashes pass. The driver gets the bitmap alone, in blocks that
    are put together on executors.
    """
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (per_value * n).bit_length()))
    mask, size = np.uint64((1 << bits) - 1), 1 << (BLOCK - 3)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of bits as blocks and two bytes within them."""
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                x = batch.column(0).to_numpy().view(np.uint64)
                held += [x & mask, x >> np.uint64(SECOND) & mask]
            if held and (batch is None or sum(map(len, held)) > 1 << 22):
                k = np.unique(np.concatenate(held)).view(np.int64)
                held = []
                parts = np.split(k, np.flatnonzero(np.diff(k >> BLOCK)) + 1) if len(k) else []
                blocks = [int(part[0] >> BLOCK) for part in parts]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([p.astype(np.uint16).tobytes() for p in parts], pa.binary())], names=["block", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.setdefault(block, np.zeros(1 << BLOCK, bool))[np.frombuffer(packed, np.uint16)] = True
        packed = [np.packbits(b, bitorder="little").tobytes() for b in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(packed, pa.binary())], names=["block", "bits"])

    schema = "block long, bits binary"
    places = rows.where(F.col(column).isNotNull()).select(column).mapInArrow(cut, schema).repartition("block")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for block, packed in places.mapInArrow(join, schema).collect():
        out[block * size : (block + 1) * size] = np.frombuffer(packed, np.uint8)
    return Bitmap(rows.sparkSession.sparkContext.broadcast(out), 2 << bits < per_value * n)
