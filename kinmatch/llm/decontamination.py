"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark's items (``window`` words, or the whole item if it has fewer). Patterns of
one length share a table: the ids of each block of two neighbouring words give the least shift that can still align the
block with a pattern; a block in no pattern lets the search skip the whole window less one word. Where the shift is zero,
the patterns of that suffix block are compared with the words directly.

The benchmark is a stated query set: it is split into blocks of at most ``block_windows`` windows, of which a ``group`` at a
time is broadcast and kept as tables by workers, so that what is broadcast and kept is bounded. A pass over the texts
searches a group; no document is shuffled. Between groups the rows are stored with their hits so far.

Null texts have no words. An item with a null id counts for hits, not for ids; repeated items count once by id. Every
document row gives a row, also repeated ones; columns of df other than the id and the text are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A-Z to a-z; of ASCII, all but digits and letters part words. Bytes over 0x7F belong to words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def windows(item: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))]


class WuManber:
    """Search for many word sequences; ``patterns`` maps each to the ids of the items that hold it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.ids = {w: i for i, w in enumerate(sorted({w for p in patterns for w in p}), 1)}
        self.size = len(self.ids) + 1
        by_length: dict[int, list] = {}
        for p, items in patterns.items():
            by_length.setdefault(len(p), []).append((tuple(self.ids[w] for w in p), tuple(items)))
        self.tables = []
        for m, group in sorted(by_length.items()):
            block = min(2, m)
            shift: dict[int, int] = {}
            bucket: dict[int, list] = {}
            for p, items in group:
                for end in range(block, m + 1):
                    key = p[end - 1] if block == 1 else p[end - 2] * self.size + p[end - 1]
                    shift[key] = min(shift.get(key, m), m - end)
                    if end == m:
                        bucket.setdefault(key, []).append((p, items))
            self.tables.append((m, block, shift, bucket))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, tuple]]:
        """(start, length, item ids) of every occurrence of every pattern."""
        get = self.ids.get
        seq = [get(w, 0) for w in text]
        n, size = len(seq), self.size
        if not any(seq):
            return
        for m, block, shift, bucket in self.tables:
            skip, end = m - block + 1, m
            while end <= n:
                last = seq[end - 1]
                key = last if block == 1 else seq[end - 2] * size + last
                step = shift.get(key, skip)
                if step:
                    end += step
                    continue
                found = tuple(seq[end - m : end])
                for p, items in bucket[key]:
                    if p == found:
                        yield end - m, m, items
                end += 1


def pattern_blocks(benchmark: DataFrame, window: int, block_windows: int, id_col: str, text_col: str) -> Iterator[dict]:
    """Patterns of the benchmark in blocks; the driver holds one at a time."""
    block: dict[tuple[bytes, ...], list] = {}
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        for w in windows(words(row[1]), window):
            block.setdefault(w, []).append(row[0])
        if len(block) >= block_windows:
            yield block
            block = {}
    if block:
        yield block


RESULTS = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
_MACHINES: dict[int, WuManber] = {}


def machines(blocks: list) -> list[WuManber]:
    """The machines of a group of broadcast blocks; a worker keeps those of one group."""
    if _MACHINES.keys() - {k for k, _ in blocks}:
        _MACHINES.clear()
    for k, shared in blocks:
        if k not in _MACHINES:
            _MACHINES[k] = WuManber(shared.value)
    return [_MACHINES[k] for k, _ in blocks]


def searched(df: DataFrame, blocks: list, last: bool) -> DataFrame:
    """df(row, text, hits, items) with the hits of a group of blocks: bits of words and item ids; ``last`` makes figures of them."""
    arrow = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())), ("contaminated", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [words(t) for t in batch.column(1).to_pylist()]
                hit = [None if h is None else np.unpackbits(np.frombuffer(h, np.uint8), count=len(t)).astype(bool) for h, t in zip(batch.column(2).to_pylist(), texts, strict=True)]
                items = [set(x or ()) for x in batch.column(3).to_pylist()]
                for m in machines(blocks):
                    for i, t in enumerate(texts):
                        for start, n, found in m.search(t):
                            if hit[i] is None:
                                hit[i] = np.zeros(len(t), bool)
                            hit[i][start : start + n] = True
                            items[i].update(str(x) for x in found if x is not None)
                if last:
                    n_hit = [0 if h is None else int(h.sum()) for h in hit]
                    out = [[len(t) for t in texts], n_hit, [len(x) for x in items], [sorted(x) for x in items], [n > 0 for n in n_hit]]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, (_, t) in zip(out, arrow, strict=True))], names=["row", *(n for n, _ in arrow)])
                else:
                    packed = pa.array([None if h is None else np.packbits(h).tobytes() for h in hit], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["row", "text", "hits", "items"])

    row = df.schema["row"].dataType
    figures = ", n_words long, n_hit long, n_items long, item_ids array<string>, contaminated boolean"
    return df.mapInArrow(run, f"row {row.simpleString()}" + (figures if last else ", text string, hits binary, items array<string>"))


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 100_000, group: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, clean: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids, contaminated) for every row of df.

    With ``keep`` those columns of df stand for the id; such as have a result's name give way to it. With ``clean`` the
    result is instead the rows of df, with all their columns as they are, that are not contaminated.
    """
    sc = df.sparkSession.sparkContext
    head = df.columns if clean else [c for c in keep or [id_col] if c not in RESULTS]
    row = F.struct(*(F.col(f"`{c}`") for c in head))
    out = df.select(row.alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    blocks = pattern_blocks(benchmark, window, block_windows, item_id, item_text)
    some = list(islice(blocks, group))
    while True:
        shared = [(b._jbroadcast.id(), b) for b in map(sc.broadcast, some)]
        some = list(islice(blocks, group))
        out = searched(out, shared, not some)
        if not some:
            break
        out = stored(out)  # a pass of its own, after which these blocks go
        for _, b in shared:
            b.destroy()
    out = out.where("not contaminated").select("row.*") if clean else out.select("row.*", *RESULTS)
    return out


def items_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()


#: The contract's query in DuckDB: windows of the items joined with those of the documents, hit words counted once.
SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
pos AS (
  SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, lens WHERE len(w) >= m)),
occ AS (SELECT rid, i, pos.m, item_id FROM pos JOIN win USING (m, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
