"""SimHash near-duplicates with pivot distance tables.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are merged first (a hot text counts once).
Two fingerprints that differ in at most 3 of 64 bits agree wholly in 2 of 5 bit blocks, so each fingerprint is dealt to 10
buckets, one for each pair of blocks. In a bucket every fingerprint has a row of the pivot table: its Hamming distances to
``PIVOTS`` reference fingerprints. By the triangle inequality a pair within 3 bits differs by at most 3 in every
coordinate; rows are sorted by the first coordinate, pairs out of its window are never formed, pairs with a larger
maximum difference in the others are discarded, and only survivors are verified by their own distance.

From a bucket come the links of a spanning forest alone, never all pairs. A bucket of more than ``most`` fingerprints is
dealt over pairs of parts, so that a task holds two parts at most and every pair still meets. Components then give the
smallest id reachable.

Null and wordless texts have fingerprint 0 and link like any other. Rows with a null id take part, also where no other row
has their fingerprint; null is never a component id unless all ids of the component are null. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, map_rows, stored

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIVOTS = np.random.RandomState(7).randint(0, 2**32, (24, 2), dtype=np.uint64) @ np.array([1 << 32, 1], np.uint64)


def shingle_hashes(text: str | None, k: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words, A-Z in lower case, joined by single spaces; one of all words if there are fewer."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= k:
        return np.array([digest(b" ".join(w), seed)], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    return np.fromiter((digest(g, seed) for g in grams), np.uint64, len(w) - k + 1)


def fingerprints(texts: list[str | None], k: int = 3, portion: int = 1 << 16) -> list[int]:
    """Signed 64-bit fingerprints: bit i is set if it is in over half the shingles' hashes."""
    out = []
    for t in texts:
        h = shingle_hashes(t, k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), portion):
            part = h[at : at + portion]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return out


def close_links(key: np.ndarray, prints: np.ndarray, ids: np.ndarray, bits: int) -> tuple[list, list]:
    """Links of a spanning forest of the pairs within ``bits`` among equal keys. Rows of a key must be neighbours."""
    first = np.bitwise_count(prints ^ PIVOTS[0])
    order = np.lexsort((first, key))
    key, prints, ids, first = key[order], prints[order], ids[order], first[order].astype(np.int16)
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, 1:]).astype(np.int8)
    parent = np.arange(len(key))
    a: list = []
    b: list = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    alive, k = np.arange(len(key)), 1
    while len(alive):
        alive = alive[alive + k < len(key)]
        other = alive + k
        near = (key[alive] == key[other]) & (first[other] - first[alive] <= bits)
        alive, other = alive[near], other[near]  # sorted: past the window no later row can come back
        i, j = alive, other
        for c in range(0, table.shape[1], 8):
            ok = (np.abs(table[i, c : c + 8] - table[j, c : c + 8]) <= bits).all(axis=1)
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(prints[i] ^ prints[j]) <= bits
        i, j = i[ok], j[ok]
        new = parent[i] != parent[j]
        if new.any():
            for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(ids[x])
                    b.append(ids[y])
            while (step := parent[parent] != parent).any():
                parent[step] = parent[parent[step]]
        k += 1
    return a, b


def bucket_links(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b) from rows(key, print, id) sorted by key within partitions; a key's rows may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

        def links(columns):
            a, b = close_links(*columns, bits)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last key may go on
            if cut:
                yield links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield links(held)

    return rows.select("key", "print", "id").mapInArrow(run, "a long, b long")


def with_fingerprints(df: DataFrame, name: str, text_col: str = "text", k: int = 3) -> DataFrame:
    """df with the fingerprint of each row's text as a long."""
    names, schema = [*df.columns, name], StructType([*df.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = pa.array(fingerprints(part.column(text_col).to_pylist(), k), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=names)

    return df.mapInArrow(run, schema)


def print_components(distinct: DataFrame, bits: int = 3, most: int = 2048) -> DataFrame:
    """(node, component) of the fingerprints in distinct(print) that are linked; component is the smallest of them."""
    keys = []
    for n, pair in enumerate(combinations(BLOCKS, 2)):
        mask = sum(((1 << width) - 1) << at for at, width in pair)
        mask -= 1 << 64 if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(n), F.col("print").bitwiseAND(F.lit(mask))))
    dealt = distinct.select(F.explode(F.array(*keys)).alias("bucket"), "print", F.col("print").alias("id"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / most).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("print", F.lit(1)), F.col("parts"))
    # Part i of a bucket meets every part j in task (i, j); a bucket of one part is a task as it is.
    met = F.explode(F.expr("sequence(0L, parts - 1)")).alias("other")
    rows = dealt.join(sizes, "bucket").select("bucket", "print", "id", own.alias("own"), met)
    rows = rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "print", "id")
    links = bucket_links(rows.repartition("key").sortWithinPartitions("key"), bits)
    return connected_components(links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = 3, most: int = 2048) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row of df."""
    arrow = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
    prints = map_rows(df, lambda ids, texts: {"doc_id": ids, "print": fingerprints(texts, k)}, [id_col, text_col], "doc_id long, print long", arrow)
    prints = stored(prints)  # the texts are read once
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    component = print_components(distinct.select("print"), bits, most)
    group = F.coalesce("component", "print").alias("group")
    grouped = distinct.join(component, distinct.print == component.node, "left").select("print", "least", group)
    ids = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    least = grouped.select("print", "group").join(ids, "group").select("print", "component_id")
    return prints.join(least, "print").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
