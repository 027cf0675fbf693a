"""Buckets of candidates: singles go, large ones are dealt over pairs of parts, and the rows of a key are met in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, member: str, most: int, also: str | None = None) -> DataFrame:
    """rows(bucket, member, ...) of buckets of two rows or more, with ``key`` in place of bucket.

    A bucket of n rows has ceil(n / most) parts. Part i meets every part j under the key of (i, j), so a key has at most
    about 2 * most rows, all pairs of a bucket still meet, and a bucket of one part is one key. ``also`` is SQL over a
    bucket's rows that must hold for it to matter.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.expr(also or "true").alias("matters")).where("n > 1 and matters")
    sizes = sizes.select("bucket", F.ceil(F.col("n") / most).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64(member, F.lit(1)), F.col("parts"))
    met = rows.join(sizes, "bucket").withColumn("_own", own).withColumn("_met", F.explode(F.expr("sequence(0L, parts - 1)")))
    return met.withColumn("key", F.xxhash64("bucket", F.least("_own", "_met"), F.greatest("_own", "_met"))).drop("bucket", "parts", "_own", "_met")


def met_once(rows: DataFrame, columns: list[str], work: Callable[[pa.Table], dict], most: int, fold: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """``work`` on the buckets of rows(bucket, columns), met in one shuffle; gives (key, member) of what it holds.

    ``work`` gets tables of whole buckets with ``key`` for bucket. A bucket of more than ``most`` rows is not worked on
    where it is: as soon as it is seen to be larger its rows are passed on, and are dealt over pairs of parts afterwards.
    ``fold`` makes one of like rows of a key before they are counted; with it ``work`` gets keys of one row too.
    """
    member = columns[0]
    fields = [("key", pa.int64()), *((c, ARROW[t]) for c, t in rows.select(*columns).dtypes), ("large", pa.bool_())]
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        large: int | None = None

        def passed(part: pa.Table) -> Iterator[pa.RecordBatch]:
            whole = part.append_column("large", pa.array(np.ones(part.num_rows, bool)))
            yield from whole.cast(arrow).combine_chunks().to_batches()

        def made(part: pa.Table) -> Iterator[pa.RecordBatch]:
            if part.num_rows:
                key = part.column(0).to_numpy()
                # Only buckets of two rows or more matter, and those over the bound wait.
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                size = np.repeat(n, n)
                if (size > most).any():
                    yield from passed(part.filter(pa.array(size > most)))
                some = part.filter(pa.array(((size > 1) | (fold is not None)) & (size <= most)))
                if some.num_rows:
                    out = work(some)
                    rest = {c: pa.array(out[c], t) if c in out else pa.nulls(len(out["key"]), t) for c, t in fields}
                    rest["large"] = pa.array(np.zeros(len(out["key"]), bool))
                    yield pa.RecordBatch.from_arrays([rest[c] for c, _ in fields], schema=arrow)

        for batch in batches:
            new = pa.Table.from_batches([batch]).rename_columns(["key", *columns])
            if large is not None:
                key = new.column(0).to_numpy()
                end = int(np.searchsorted(key, large, side="right"))
                yield from passed(new.slice(0, end))
                new = new.slice(end)
                if not new.num_rows:
                    continue
                large = None
            held = new if held is None else pa.concat_tables([held, new])
            held = held if fold is None else fold(held)
            key = held.column(0).to_numpy()
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield from made(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
            if held.num_rows > most:
                large = int(key[-1])
                yield from passed(held)
                held = None
        if held is not None:
            yield from made(held)

    spark_type = dict(rows.dtypes)
    schema = ", ".join(["key long", *(f"{c} {spark_type[c]}" for c in columns), "large boolean"])
    return rows.select("bucket", *columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def members(rows: DataFrame, columns: list[str], work: Callable[[pa.Table], dict], most: int, keep: Callable[[DataFrame], DataFrame], also: list[str] | None = None, fold: Callable[[pa.Table], pa.Table] | None = None, work_large: Callable[[pa.Table], dict] | None = None) -> DataFrame:
    """(key, member) of what ``work`` holds in all buckets, large ones too, and the columns ``also`` of its result.

    ``keep`` stores a table that is read twice; ``work_large`` is for the parts of large buckets, if not the same.
    """
    names = ["key", columns[0], *(also or [])]
    first = keep(met_once(rows, columns, work, most, fold))
    large = dealt(first.where("large").drop("large").withColumnRenamed("key", "bucket"), columns[0], most)
    types = dict(rows.dtypes) | {"key": "bigint"}
    out = met(large, columns, work_large or work, ", ".join(f"{c} {types[c]}" for c in names), pa.schema([(c, ARROW[types[c]]) for c in names]))
    return first.where("not large").select(names).unionByName(out)


def met(rows: DataFrame, columns: list[str], work: Callable[[pa.Table], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """Brings the rows of a key together; ``work`` gets tables of whole keys, sorted by key, and gives columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                key = held.column(0).to_numpy()
                if cut := int(np.searchsorted(key, key[-1])):  # the last key may go on
                    yield made(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield made(held)

    def made(part: pa.Table) -> pa.RecordBatch:
        out = work(part)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return rows.select("key", *columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


class Forest:
    """Links that join two trees, found one by one, over n rows."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        p, q = self.root(x), self.root(y)
        self.parent[max(p, q)] = min(p, q)
        return p != q

    def flatten(self) -> np.ndarray:
        while (step := self.parent[self.parent] != self.parent).any():
            self.parent[step] = self.parent[self.parent[step]]
        return self.parent


def close_pairs(key: np.ndarray, first: np.ndarray, reach: int, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one key whose ``first`` differs by at most ``reach``; rows sorted by key, then first.

    Pairs come by distance in the order, and a row goes once its next is out of the window. Pairs already joined in the
    forest are left out.
    """
    alive, k = np.arange(len(key)), 1
    while len(alive):
        alive = alive[alive + k < len(key)]
        near = (key[alive] == key[alive + k]) & (first[alive + k] - first[alive] <= reach)
        alive = alive[near]
        i, j = alive, alive + k
        if forest is not None and len(i):
            parent = forest.flatten()
            new = parent[i] != parent[j]
            i, j = i[new], j[new]
        if len(i):
            yield i, j
        k += 1
