"""Line deduplication by a segment-partition edit join.

Lines of at least ``min_chars`` characters (without blanks at the ends) that are equal or within ``edits`` edits are
linked; of each class the first line by document id and place stays and the others are removed. Of shorter lines, down to
``exact_chars``, equal ones alone are a class. Other lines stay.

A line is cut into edits + 1 even segments; lines within the distance share a segment of the shorter one, at a place that
the multi-match-aware selection bounds. So each line is in the buckets of its own segments and of those substrings that a
line of its length or up to ``edits`` less could match. Rows carry a hash, the length and a folded histogram of the line,
no text. In a bucket, lines with a partner whose length and histogram allow the distance are candidates; their texts alone
are brought together and verified with a banded bit-parallel edit distance. From a bucket come the links of a forest.

Equal lines are merged by a 128-bit hash before (a hot line counts once). Null text has no lines. Rows that repeat an id
count as one document, of which each row keeps what the first keeps. A null id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap
from .buckets import Forest, close_pairs, members, met
from .common import checkpoint, connected_components


def lines(text: str | None, min_chars: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that take part."""
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= min_chars:
            yield i, line


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def halves(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of line ids as whole numbers."""
    h = np.frombuffer(b"".join(ids), "<i8")
    return h[::2].copy(), h[1::2].copy()


def histograms(raws: list[bytes]) -> np.ndarray:
    """Of each line, as four bytes a character: counts of 16 classes of characters, 4 bits each.

    An edit changes two of them by one at most.
    """
    if not raws:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(raws)), [len(r) // 4 for r in raws])
    n = np.bincount(owner * 16 + (np.frombuffer(b"".join(raws), np.uint32) & 15), minlength=16 * len(raws)).reshape(-1, 16) & 15
    return (n.astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def histogram_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the sum of differences of two arrays of histograms."""
    out = np.zeros(len(a), np.int64)
    for k in range(0, 64, 4):
        d = ((a >> np.uint64(k)) - (b >> np.uint64(k))) & np.uint64(15)
        out += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return out


@lru_cache(1 << 16)
def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of an even partition, the shorter ones first."""
    short, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


@lru_cache(1 << 12)
def cuts(n: int, edits: int, min_chars: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, end, seed), in bytes of four a character, of a line's own segments and of the substrings to probe with.

    A substring that stands where the line's own segment does is left to that.
    """
    own, probes = [(4 * p, 4 * (p + k), n << 4 | i) for i, (p, k) in enumerate(segments(n, edits + 1))], []
    for size in range(max(min_chars, n - edits), n + 1):
        more = n - size
        for i, (p, k) in enumerate(segments(size, edits + 1)):
            low = max(0, p - i, p + more - (edits - i))
            high = min(n - k, p + i, p + more + (edits - i))
            probes += [(4 * q, 4 * (q + k), size << 4 | i) for q in range(low, high + 1)]
    return own, [x for x in probes if x not in own]


def signatures(raw: bytes, n: int, edits: int, min_chars: int) -> tuple[list[int], list[int]]:
    """Buckets of the line's own segments, and those of substrings that may match a segment of another line.

    raw holds the n characters of the line as four bytes each, so that a substring is a slice.
    """
    digest = xxhash.xxh3_64_intdigest
    own, probes = cuts(n, edits, min_chars)
    own = [digest(raw[a:b], seed) for a, b, seed in own]
    return own, list({digest(raw[a:b], seed) for a, b, seed in probes}.difference(own))


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel over a band of 2 * edits + 1 diagonals.

    Bit k of a column stands for the row that lies k - edits below the diagonal; the band slides down by one a column, and
    the vertical differences of Myers' algorithm are kept for its rows alone.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    head = 0
    least = min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) <= edits
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * edits + 2
    full = (1 << width) - 1
    top = 1 << (width - 1)
    # At the first column the band's last row is that of character ``edits`` of a.
    up, down = full & ~((1 << (width - 1 - edits)) - 1), 0
    score, shift = edits, edits + 1 - width
    below = top >> 1
    for j, c in enumerate(b):
        m = places.get(c, 0)
        x = (m >> shift if shift >= 0 else m << -shift) & full
        zero = ((((x & up) + up) ^ up) | x | down) & full
        right_up = down | (full & ~(zero | up))
        right_down = zero & up
        if j < len(a) - edits:
            score += not zero & top
        else:
            score += bool(right_up & below)
            score -= bool(right_down & below)
            below >>= 1
        shift += 1
        half = zero >> 1
        up = right_down | (full & ~(half | right_up))
        down = half & right_up
        if score > 2 * edits + len(b) - j:
            return False
    return score <= edits


def occurrences(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, place, h1, h2) of every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, ids = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, line in lines(t, min_chars):
                    doc.append(d)
                    place.append(i)
                    ids.append(line_id(line))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()), *map(pa.array, halves(ids))], names=["doc", "place", "h1", "h2"])

    return df.select(id_col, text_col).mapInArrow(run, "doc long, place int, h1 long, h2 long")


def bucket_rows(df: DataFrame, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """(bucket, line, hist, size) of the distinct lines of each partition; size is twice the length, plus one at a segment of the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, raws, buckets, counts, own_counts = [], [], [], [], []
                for t in batch.column(0).slice(at, 256).to_pylist():
                    for _, line in lines(t, min_chars):
                        h = line_id(line)
                        if h in seen:
                            continue
                        if len(seen) >= 1_000_000:  # bounded; a line met again later is only dealt again
                            seen.clear()
                        seen.add(h)
                        raw = line.encode("utf-32-le")
                        own, probes = signatures(raw, len(raw) // 4, edits, min_chars)
                        ids.append(h)
                        raws.append(raw)
                        buckets += own
                        buckets += probes
                        counts.append(len(own) + len(probes))
                        own_counts.append(len(own))
                if ids:
                    n = np.array(counts)
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    size = np.repeat(np.array([len(r) // 4 for r in raws], np.int32) * 2, n) + (place < np.repeat(np.array(own_counts), n))
                    columns = [np.array(buckets, np.uint64).view(np.int64), np.repeat(halves(ids)[0], n), np.repeat(histograms(raws).view(np.int64), n), size.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "line", "hist", "size"])

    return df.select(text_col).mapInArrow(run, "bucket long, line long, hist long, size int")


def partnered(edits: int):
    """Of the rows of a key, those with a partner that length and histogram allow."""

    def work(part: pa.Table) -> dict:
        key, line, hist, size = (part.column(k).to_numpy() for k in ("key", "line", "hist", "size"))
        order = np.lexsort((size, key))
        key, line, hist, size = key[order], line[order], hist[order].view(np.uint64), size[order].astype(np.int64)
        size, own = size >> 1, (size & 1).astype(bool)
        held = np.zeros(len(key), bool)
        for i, j in close_pairs(key, size, edits):
            ok = (line[i] != line[j]) & (own[i] | own[j])
            i, j = i[ok], j[ok]
            ok = histogram_distance(hist[i], hist[j]) <= 2 * edits
            held[i[ok]] = held[j[ok]] = True
        return {"key": key[held], "line": line[held]}

    return work


def verified(edits: int):
    """Links of a forest among the lines of each key, by their texts; lines are told apart by both halves of their hash."""

    def work(part: pa.Table) -> dict:
        key, line, more = (part.column(k).to_numpy() for k in ("key", "line", "more"))
        texts = part.column("text").to_pylist()
        size = np.array([len(t) for t in texts])
        hist = histograms([t.encode("utf-32-le") for t in texts])
        order = np.lexsort((size, key))
        key, line, more, size, hist, texts = key[order], line[order], more[order], size[order], hist[order], [texts[i] for i in order]
        forest, a, b = Forest(len(key)), [], []
        for i, j in close_pairs(key, size, edits, forest):
            ok = histogram_distance(hist[i], hist[j]) <= 2 * edits
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if (line[x] != line[y] or more[x] != more[y]) and forest.root(x) != forest.root(y) and within(texts[x], texts[y], edits):
                    forest.join(x, y)
                    a.append({"h1": line[x], "h2": more[x]})
                    b.append({"h1": line[y], "h2": more[y]})
        return {"a": a, "b": b}

    return work


def candidate_texts(df: DataFrame, members: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(line, more, text) of the lines of members(line), a stored table, and of others that its bitmap lets pass."""
    marked = bitmap(members, "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = {line_id(line): line for t in batch.column(0).slice(at, 256).to_pylist() for _, line in lines(t, min_chars)}
                h1, h2 = halves(list(found))
                keep, texts = np.flatnonzero(marked.holds(h1)), list(found.values())
                yield pa.RecordBatch.from_arrays([pa.array(h1[keep]), pa.array(h2[keep]), pa.array([texts[k] for k in keep.tolist()], pa.string())], names=["line", "more", "text"])

    return df.select(text_col).mapInArrow(run, "line long, more long, text string").groupBy("line", "more").agg(F.min("text").alias("text"))


def links(df: DataFrame, edits: int = 2, min_chars: int = 16, text_col: str = "text", most: int = 2048) -> DataFrame:
    """(a, b): 128-bit hashes, as (h1, h2), of lines within ``edits`` edits, enough to give the classes."""
    found = members(bucket_rows(df, text_col, edits, min_chars), ["line", "hist", "size"], partnered(edits), most, checkpoint)
    held = checkpoint(found.distinct())
    texts = candidate_texts(df, held, text_col, min_chars)
    together = held.join(texts, "line").select("key", "line", "more", "text")
    one = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
    return met(together, ["line", "more", "text"], verified(edits), "a struct<h1: long, h2: long>, b struct<h1: long, h2: long>", pa.schema([("a", one), ("b", one)]))


def removals(df: DataFrame, edits: int = 2, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """(doc, places): the places of the lines to remove, for documents with any."""
    occ = checkpoint(occurrences(df, id_col, text_col, min_chars if exact_chars is None else min(exact_chars, min_chars)))
    first = F.min(F.struct("doc", "place"))
    distinct = occ.groupBy("h1", "h2").agg(first.alias("first"), F.count("*").alias("n"))
    component = connected_components(links(df, edits, min_chars, text_col))
    component = component.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "component")
    classed = distinct.join(component, ["h1", "h2"], "left").where("n > 1 or component is not null")
    alone = classed.where("component is null").select("h1", "h2", "first")
    linked = classed.where("component is not null").select("h1", "h2", "first", "component")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    keep = alone.unionByName(linked.join(heads, "component").select("h1", "h2", F.col("head").alias("first")))
    gone = occ.join(keep, ["h1", "h2"]).where("not (doc <=> first.doc and place = first.place)").select("doc", "place").distinct()
    return gone.groupBy("doc").agg(F.sort_array(F.collect_list("place")).alias("places"))  # a document's own lines


def kept_text(text: Column, places: Column) -> Column:
    """The text without the lines of the given places."""
    parts = F.split(text, "\n", -1)
    return F.array_join(F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(places, s["i"])), lambda s: s["x"]), "\n")


def deduplicate(df: DataFrame, edits: int = 2, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """df with text_col less its removed lines; rows of which nothing but blanks is left by that are dropped."""
    gone = removals(df, edits, min_chars, id_col, text_col, exact_chars)
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = whole.join(gone, whole.id.eqNullSafe(gone.doc), "left")
    less = F.when(F.col("places").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("places")))
    out = out.withColumn("less", less).where(F.col("places").isNull() | (F.trim(F.translate("less", "\t\n\r", "   ")) != ""))
    return out.select(*(F.col("less").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns))
