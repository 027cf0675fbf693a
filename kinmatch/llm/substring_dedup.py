"""Substring deduplication by paragraph MinHash banding, with matches carried to their ends.

A paragraph is a run of ``SPAN`` words; paragraphs begin where a shingle's hash is the least of ``WINDOW`` neighbours
(winnowing), so that any 31 words that two texts share hold a paragraph of both. Its five-word shingles give ``n_bands``
buckets of ``band_rows`` MinHash values each. Of colliding paragraphs equal ones are a class; unequal ones whose 64-bit
sketches allow the similarity are brought together with their shingles and verified by exact Jaccard similarity. From a
bucket come the links of a forest; components give the classes. Among twelve shingles 0.8 allows one other shingle; three
bands of two values bring such a pair together with probability 0.97.

Paragraphs of a class flag a place. About flagged paragraphs single shingles that occur elsewhere about flagged
paragraphs carry the match to its ends and past changed words: runs of 12 words, or less beside a match with the same
other text at about the same distance. Matched words with at most ``GAP`` changed ones between are a passage if it has
``LEAST`` words or more, ``RUN`` matched ones on end and the similarity of its shingles to the matched ones; changed
words in it belong to it. A passage of over 50 words and its near-copy (five-word Jaccard of 0.8 or more) have 25 words on
end in common; ``test_near_copies_by_brute_force`` measures how many such pairs are linked.

Of each class the first place by document id and place stays, the words of the others are removals, but for words that
the first place itself covers; changed words go with those at both sides. Documents are linked if passages of both hold a
paragraph of one class.

Words are what white space parts, A-Z in lower case. Texts of under ``LEAST`` words, null ones too, have no passage. Hashes
have 64 bits; one wrong equality alone makes no passage. Rows that repeat an id count as one document; rows with a null id
have a row in the result and no class. Ids are integers. Other columns are not read.

Texts are read in four narrow passes: buckets; colliding paragraphs; flagged paragraphs and what they look for; and, of
flagged documents alone, what is looked for. What a pass needs of the one before is a bitmap of bounded size. Tables, bitmaps
and shuffle files go when what is made from them is stored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap
from .buckets import Forest, close_pairs, members, met
from .common import connected_components, lean, remove_stored, shuffles_removed
from .common import stored as stored_table

SHINGLE = 5
SPAN = 16  # words of a paragraph
WINDOW = 16  # places among which one begins
REACH = 48  # words about a flagged paragraph that are looked at
SHORT = 12  # words on end that match by themselves
RUN = 24  # matched words on end in a passage
GAP = 8  # changed words on end in a passage
LEAST = 40  # words of a passage
WIDTH = SPAN - SHINGLE + 1
ODD = np.random.RandomState(11).randint(0, 2**32, (64, 2), dtype=np.uint64) @ np.array([1 << 32, 1], np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def extreme(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The extreme of every window of that width, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


class Flat:
    """The texts of ``LEAST`` words or more one after another: a shingle's hash at every word's place.

    Words are hashed by Python's own 64-bit hash of bytes, which Spark seeds alike in all workers.
    """

    def __init__(self, ids: list[int], lists: list[list[bytes]]):
        self.ids = np.array(ids, np.int64)
        n = np.array([len(w) for w in lists], np.int64)
        self.ends = np.cumsum(n)
        self.begin = self.ends - n
        size = int(n.sum())
        w = np.fromiter(map(hash, chain.from_iterable(lists)), np.int64, size).view(np.uint64)
        self.doc = np.repeat(np.arange(len(n)), n)
        #: Words from a place to its text's end. What reaches further is no shingle, paragraph or window.
        self.left = self.ends[self.doc] - np.arange(size)
        self.s = np.zeros(size, np.uint64)
        if size:
            self.s[: size - SHINGLE + 1] = mixed(sum((w[k : size - SHINGLE + 1 + k] * ODD[k] for k in range(SHINGLE)), np.uint64(0)))

    def paragraphs(self) -> np.ndarray:
        """Places at which paragraphs begin."""
        s, left = self.s, self.left
        if not len(s):
            return np.zeros(0, np.int64)
        least = extreme(s, WINDOW, np.minimum)
        least = np.where(left[: len(least)] >= SPAN + WINDOW - 1, least, np.uint64(0))
        edge = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero((extreme(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == s) & (left >= SPAN))
        # Of neighbouring beginnings, near-copies of each other, the least hash stays; equal ones are equal paragraphs.
        beside, a, b = at[1:] - at[:-1] == 1, s[at[:-1]], s[at[1:]]
        drop = np.zeros(len(at), bool)
        drop[1:] |= beside & (a < b)
        drop[:-1] |= beside & (a > b)
        return at[~drop]

    def names(self, at: np.ndarray) -> np.ndarray:
        """A hash of each paragraph."""
        s = self.s
        return mixed(s[at] * ODD[8] + s[at + 5] * ODD[9] + s[at + 10] * ODD[10] + s[at + 11] * ODD[11]).view(np.int64)

    def shingles(self, at: np.ndarray) -> np.ndarray:
        return self.s[at[:, None] + np.arange(WIDTH)]

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, place in the text)."""
        d = self.doc[at]
        return self.ids[d], at - self.begin[d]

    def chains(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, text) of chains of paragraphs that overlap or meet."""
        new = np.concatenate([[True], (at[1:] > at[:-1] + SPAN) | (self.doc[at[1:]] != self.doc[at[:-1]])]) if len(at) else np.zeros(0, bool)
        last = np.concatenate([new[1:], [True]]) if len(at) else new
        return at[new], at[last] + SPAN, self.doc[at[new]]

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of every place whether it is in any [low, high)."""
        n = len(self.s)
        step = np.bincount(low, minlength=n + 1) - np.bincount(np.maximum(low, high), minlength=n + 1)
        return np.cumsum(step)[:n] > 0


    def about(self, at: np.ndarray) -> np.ndarray:
        """Of every place whether a shingle in or about those paragraphs begins there."""
        low, high, d = self.chains(at)
        return self.within(np.maximum(low - REACH, self.begin[d]), np.minimum(high + REACH, self.ends[d])) & (self.left >= SHINGLE)


def flats(batches: Iterator[pa.RecordBatch], only=None, most_chars: int = 1 << 20) -> Iterator[Flat]:
    """Slices of batches(id, text) of a bounded number of characters, or one text; ``only`` tells ids that are wanted."""
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        raise RuntimeError("workers hash words alike only under one PYTHONHASHSEED, which Spark sets")
    for batch in batches:
        ids, lists, size = [], [], 0
        wanted = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        if only is not None and batch.num_rows:
            wanted &= only.holds(batch.column(0).fill_null(0).to_numpy())
        for k in np.flatnonzero(wanted).tolist():
            t = batch.column(1)[k].as_py()
            w = (t or "").encode().lower().split()
            if len(w) >= LEAST:
                ids.append(batch.column(0)[k].as_py())
                lists.append(w)
                size += len(t)
                if size >= most_chars:
                    flat, ids, lists, size = Flat(ids, lists), [], [], 0
                    yield flat
        flat, ids, lists = Flat(ids, lists), [], []
        yield flat


def bands(shingles: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """Bucket numbers, band by band; the last two bits are the band's."""
    out = []
    for b in range(n_bands):
        least = [(shingles * ODD[40 + b * rows + r]).min(axis=1) for r in range(rows)]
        out.append((mixed(sum((v * ODD[20 + k] for k, v in enumerate(least)), np.uint64(b))) & ~np.uint64(3) | np.uint64(b & 3)).view(np.int64))
    return np.concatenate(out)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One bit of 64 for each shingle; sets that differ in d shingles differ in at most d bits."""
    return np.bitwise_or.reduce(np.uint64(1) << (shingles >> np.uint64(58)), axis=1).view(np.int64)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, which begin a group of equal ones."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def apart(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of groups of rows sorted by place, 1 for those whose places span a paragraph's length or more, else 0."""
    low = np.flatnonzero(first)
    high = np.append(low[1:], len(at)) - 1
    return (at[high[: len(low)]] - at[low] >= SPAN).astype(np.int64)


def collisions(df: DataFrame, n_bands: int, band_rows: int) -> DataFrame:
    """(bucket) of buckets with two places; paragraphs that overlap in one text count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in flats(batches):
            at = flat.paragraphs()
            x = bands(flat.shingles(at), n_bands, band_rows)
            order = np.argsort(x, kind="stable")
            x, g = x[order], np.tile(at, n_bands)[order]
            first = starts(x)
            one = x[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, one[apart(first, g) > 0]]))], names=["bucket"])

    return df.mapInArrow(lean(run), "bucket long").groupBy("bucket").count().where("count > 1").select("bucket")


def colliding(df: DataFrame, hits, n_bands: int, band_rows: int) -> DataFrame:
    """(bucket, p, sketch, n) of paragraphs in the buckets of ``hits``; n: 2 if they have more than one place in a slice of texts.

    A text that has any gives one row more, with n -1 and its id for p, in a bucket of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in flats(batches):
            at = flat.paragraphs()
            sh = flat.shingles(at)
            x = bands(sh, n_bands, band_rows)
            held = np.flatnonzero(hits.holds(x))
            k = held % max(1, len(at))
            x, g, p = x[held], at[k], flat.names(at)[k]
            order = np.lexsort((g, p, x))
            x, g, p, sk = x[order], g[order], p[order], sketches(sh)[k][order]
            first = starts(x, p)
            ids = np.unique(flat.ids[flat.doc[g]])
            own = mixed(ids.view(np.uint64) * ODD[7]).view(np.int64)
            columns = ((x[first], own), (p[first], ids), (sk[first], np.zeros(len(ids), np.int64)), (1 + apart(first, g), np.full(len(ids), -1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["bucket", "p", "sketch", "n"])

    return df.mapInArrow(lean(run), "bucket long, p long, sketch long, n long")


def folded(part: pa.Table) -> pa.Table:
    """Rows of (key, p, sketch, n) sorted by key, one for each paragraph of a key."""
    if part.num_rows < 2:
        return part
    key, p, sketch, n = (c.to_numpy() for c in part.columns)
    order = np.lexsort((n < 0, p, key))
    key, p, sketch, n = key[order], p[order], sketch[order], n[order]
    at = np.flatnonzero(starts(key, p, n < 0))
    return pa.table([key[at], p[at], sketch[at], np.add.reduceat(n, at)], names=part.column_names)


def allowed(similarity: float, size: int) -> int:
    """The most shingles in which two sets of at most ``size`` can differ at that similarity."""
    return int((1 - similarity) * 2 * size / (1 + similarity) + 1e-9)


def partnered(most_bits: int, buckets: bool = True):
    """Of the paragraphs of each key those with a partner that the sketches allow (n 1), those with two places (n 2), or both (n 3).

    Equal paragraphs meet in every band: if keys are ``buckets``, those without a partner are told in the first alone. Rows
    of texts (n below 0) go through with n -1.
    """

    def work(part: pa.Table) -> dict:
        part = part.select(["key", "p", "sketch", "n"])
        texts = part.filter(pa.array(part.column("n").to_numpy() < 0))
        key, p, sketch, n = (c.to_numpy() for c in folded(part.filter(pa.array(part.column("n").to_numpy() > 0))).columns)
        sketch = sketch.view(np.uint64)
        ones = np.bitwise_count(sketch).astype(np.int64)
        order = np.lexsort((ones, key))
        key, p, sketch, ones, n = key[order], p[order], sketch[order], ones[order], n[order]
        near = np.zeros(len(key), bool)
        for i, j in close_pairs(key, ones, most_bits):
            ok = np.bitwise_count(sketch[i] ^ sketch[j]) <= most_bits
            near[i[ok]] = near[j[ok]] = True
        what = near + 2 * (n > 1)
        held = near | ((n > 1) & ((key & 3 == 0) | (not buckets)))
        own = [texts.column(c).to_numpy() for c in ("key", "p")]
        return {"key": np.concatenate([key[held], own[0]]), "p": np.concatenate([p[held], own[1]]), "n": np.concatenate([what[held], np.full(len(own[0]), -1)])}

    return work


def verified(similarity: float, most_bits: int):
    """Links of a forest among the paragraphs of each key by their exact Jaccard similarity."""

    def work(part: pa.Table) -> dict:
        key, p = part.column("key").to_numpy(), part.column("p").to_numpy()
        sets = [frozenset(np.frombuffer(x, np.uint64).tolist()) for x in part.column("shingles").to_pylist()]
        sketch = np.array([sum({1 << (x >> 58) for x in s}) for s in sets], np.uint64)
        ones = np.bitwise_count(sketch).astype(np.int64)
        order = np.lexsort((ones, key))
        key, p, sketch, ones, sets = key[order], p[order], sketch[order], ones[order], [sets[i] for i in order]
        forest, a, b = Forest(len(key)), [], []
        for i, j in close_pairs(key, ones, most_bits, forest):
            ok = np.bitwise_count(sketch[i] ^ sketch[j]) <= most_bits
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if p[x] != p[y] and forest.root(x) != forest.root(y):
                    both = len(sets[x] & sets[y])
                    if both >= similarity * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                        forest.join(x, y)
                        a.append(p[x])
                        b.append(p[y])
        return {"a": a, "b": b}

    return work


def flagged(df: DataFrame, equal, near, documents) -> DataFrame:
    """(key, doc, at, size, shingles): flagged paragraphs (size ``SPAN``); shingles looked for about them (size 0); and the
    shingles of paragraphs of ``near`` (size -1).

    Within chains of ``equal`` paragraphs nothing is looked for, unless their bitmap is too full to tell; a lookup by one of
    two texts is enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in flats(batches, documents):
            at = flat.paragraphs()
            p = flat.names(at)
            e, h = equal.holds(p), near.holds(p)
            hp, first = np.unique(p[h], return_index=True)
            sh = [x.tobytes() for x in flat.shingles(at[h][first])]
            low, high, _ = flat.chains(at[e] if not equal.full else at[:0])
            want = flat.about(at[e | h]) & ~flat.within(low, high - SHINGLE + 1)
            at, p = at[e | h], p[e | h]
            keys = np.unique(flat.s[want]).view(np.int64)
            doc, place = flat.places(at)
            blank = [None] * (len(keys) + len(hp))
            size = np.repeat([SPAN, 0, -1], [len(p), len(keys), len(hp)])
            columns = [pa.array(np.concatenate([p, keys, hp])), pa.array(doc.tolist() + blank, pa.int64()), pa.array(place.tolist() + blank, pa.int64()), pa.array(size), pa.array([None] * (len(p) + len(keys)) + sh, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "at", "size", "shingles"])

    return df.mapInArrow(lean(run), "key long, doc long, at long, size long, shingles binary")


def offered(df: DataFrame, equal, near, wanted, documents) -> DataFrame:
    """(key, doc, at) of the shingles in and about flagged paragraphs that are looked for; of those within chains of equal
    paragraphs, which need no match themselves, the first place in a slice of texts is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in flats(batches, documents):
            at = flat.paragraphs()
            p = flat.names(at)
            e = equal.holds(p)
            low, high, _ = flat.chains(at[e] if not equal.full else at[:0])
            at = np.flatnonzero(flat.about(at[e | near.holds(p)]))
            at = at[wanted.holds(flat.s[at])]
            key, doc, place = flat.s[at].view(np.int64), *flat.places(at)
            inner = flat.within(low, high - SHINGLE + 1)[at]
            order = np.flatnonzero(inner)[np.lexsort((place[inner], doc[inner], key[inner]))]
            inner[order[starts(key[order])]] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[~inner]) for c in (key, doc, place)], names=["key", "doc", "at"])

    return df.mapInArrow(lean(run), "key long, doc long, at long")


def holding(more: DataFrame, classes) -> DataFrame:
    """Those rows of (key, doc, at) whose key may be one of ``classes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(classes.holds(batch.column(0).to_numpy())))

    return more.mapInArrow(lean(run), "key long, doc long, at long")


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def passages(doc: int, at: np.ndarray, size: np.ndarray, head: np.ndarray, head_at: np.ndarray, similarity: float) -> tuple[list, list, np.ndarray]:
    """(repeated, removed, used) of the matched places of a document and their classes' first places.

    repeated and removed are intervals of words; used tells the paragraphs that stand in a passage.
    """
    shift = head_at - at
    order = np.lexsort((size, at, shift, head))
    at_, to_, head_, shift_, size_ = at[order], (at + size)[order], head[order], shift[order], size[order]
    # Segments: places that overlap or meet, of one other text at one distance.
    new = starts(head_, shift_)
    low = int(at.min())
    n = int(to_.max()) - low
    group = np.cumsum(new) * (n + 1)
    top = np.maximum.accumulate(to_ - low + group) - group + low
    new[1:] |= at_[1:] > top[:-1]
    first = np.flatnonzero(new)
    a, b = at_[first] - low, np.maximum.reduceat(to_, first) - low
    seg_head, seg_shift = head_[first], shift_[first]
    good = (np.maximum.reduceat(size_, first) >= SPAN) | (b - a >= SHORT)
    if not good.any():
        return [], [], np.zeros(len(at), bool)
    if not good.all():  # short ones need a like neighbour
        strong = np.flatnonzero(good)[np.argsort(a[good], kind="stable")]
        weak = np.flatnonzero(~good)
        spot = np.searchsorted(a[strong], a[weak])
        for k in (-2, -1, 0, 1):
            near = strong[np.clip(spot + k, 0, len(strong) - 1)]
            good[weak] |= (seg_head[near] == seg_head[weak]) & (np.abs(seg_shift[near] - seg_shift[weak]) <= GAP)

    def covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0

    other = (seg_head != doc) | (seg_shift != 0)
    held = covered(a[good], b[good])
    out = covered(a[good & other], b[good & other]) & ~covered(a[good & ~other], b[good & ~other])
    x, y = intervals(held)
    # A passage goes on while matched words outweigh changed ones: Jaccard (all - lost) / (all + lost) of its shingles.
    gap = x[1:] - y[:-1]
    lost = np.concatenate([[0.0], np.cumsum(gap + SHINGLE - 1 + 1e9 * (gap > GAP))]) * (1 + similarity) / (1 - similarity)
    worth = np.maximum.accumulate((y - lost)[::-1])[::-1]
    last = np.searchsorted(-worth, -(x + SHINGLE - 1 - lost) + 1e-6, side="right") - 1
    last = np.maximum(last, np.arange(len(x)))
    long = np.concatenate([[0], np.cumsum(y - x >= RUN)])
    ok = (y[last] - x >= LEAST) & (long[last + 1] > long[:-1])
    kept = covered(x[ok], y[last][ok])
    for i, j in zip(y[:-1].tolist(), x[1:].tolist(), strict=True):  # changed words go with both sides
        if kept[i] and out[i - 1] and out[j]:
            out[i:j] = True
    spans = [[(i + low, j + low) for i, j in zip(*map(np.ndarray.tolist, intervals(f)), strict=True)] for f in (kept, kept & out)]
    return *spans, (size == SPAN) & kept[at - low]


def assembled(per_doc: DataFrame, similarity: float) -> DataFrame:
    """(doc, r, g, removed, classes) from doc, places(at, size, head, head_at, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc": [], "r": [], "g": [], "removed": [], "classes": []}
            lists = batch.column(1)
            for k, d in enumerate(batch.column(0).to_pylist()):
                at, size, head, head_at, name = (c.to_numpy() for c in lists[k].values.flatten())
                whole, less, used = passages(d, at, size, head, head_at, similarity)
                if whole:
                    out["doc"].append(d)
                    out["r"].append(sum(y - x for x, y in whole))
                    out["g"].append(sum(y - x for x, y in less))
                    out["removed"].append(",".join(f"{x}:{y}" for x, y in less))
                    out["classes"].append(np.unique(name[used]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, c) for v, c in zip(out.values(), types, strict=True)], names=list(out))

    return per_doc.select("doc", "places").mapInArrow(lean(run), "doc long, r long, g long, removed string, classes array<long>")


def matched(texts: DataFrame, n_bands: int, band_rows: int, similarity: float, most: int) -> DataFrame:
    """(doc, component, r, g, removed) of texts(id, text) that have passages.

    Tables and bitmaps go as soon as all that is made from them is stored: disk holds what later steps read, not the run.
    """
    stored = functools.partial(stored_table, compression="uncompressed")
    most_bits = allowed(similarity, WIDTH)
    buckets = stored(collisions(texts, n_bands, band_rows))
    hits = bitmap(buckets, "bucket", 64)
    remove_stored(buckets)
    kept: list[DataFrame] = []

    def keep(rows: DataFrame) -> DataFrame:
        kept.append(stored(rows))
        return kept[-1]

    rows = colliding(texts, hits, n_bands, band_rows)
    held = stored(members(rows, ["p", "sketch", "n"], partnered(most_bits), most, keep, ["n"], folded, partnered(most_bits, False)))
    hits.release()
    remove_stored(*kept)
    pairs = held.where("n in (1, 3)")
    equal, near, documents = bitmap(held.where("n > 1"), "p", 32), bitmap(pairs, "p"), bitmap(held.where("n < 0"), "p")
    found = stored(flagged(texts, equal, near, documents))
    documents.release()
    paragraphs = stored(found.where(f"size = {SPAN}").select("key", "doc", "at", "size"))
    # Near-copied paragraphs, verified.
    shingles = found.where("size = -1").groupBy(F.col("key").alias("p")).agg(F.first("shingles").alias("shingles"))
    together = pairs.select("key", "p").distinct().join(shingles, "p")
    component = connected_components(met(together, ["p", "shingles"], verified(similarity, most_bits), "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())])))
    # Shingles that are looked for, in flagged documents.
    wanted = bitmap(found.where("size = 0"), "key", 8)
    remove_stored(found, held)
    ids = stored(paragraphs.select("doc").distinct())
    documents = bitmap(ids, "doc")
    more = stored(offered(texts, equal, near, wanted, documents))
    for bits in (equal, near, wanted, documents):
        bits.release()
    remove_stored(ids)
    short = F.lit(SHINGLE).cast("long")
    every = paragraphs.unionByName(more.withColumn("size", short))
    # Classes of more than one place, each with its first.
    here = F.struct("doc", "at")
    heads = every.groupBy("key").agg(F.min(here).alias("head"), F.max(here).alias("last"))
    classed = heads.join(component, F.col("key") == F.col("node"), "left").where("head <> last or component is not null")
    classed = stored(classed.select("key", "component", F.col("head.doc").alias("head"), F.col("head.at").alias("head_at")))
    linked = classed.where("component is not null")
    least = linked.groupBy("component").agg(F.min(F.struct("head", "head_at")).alias("h"))
    linked = linked.select("key", "component").join(least, "component").select("key", F.col("component").alias("name"), "h.head", "h.head_at")
    named = classed.where("component is null").select("key", F.col("key").alias("name"), "head", "head_at").unionByName(linked)
    # Most shingles have one place; they stay out of the shuffle. The name counts for paragraphs alone.
    classes = bitmap(classed, "key")
    every = paragraphs.unionByName(holding(more, classes).withColumn("size", short))
    name = F.when(F.col("size") == SPAN, F.col("name")).otherwise(0).alias("name")
    places = every.join(named, "key").select("doc", F.struct("at", "size", "head", "head_at", name).alias("place"))
    per_doc = places.groupBy("doc").agg(F.collect_list("place").alias("places"))  # a document's own places
    found = stored(assembled(per_doc, similarity))
    classes.release()
    remove_stored(paragraphs, more, classed)
    # Documents whose passages hold paragraphs of one class.
    pairs = found.select("doc", F.explode("classes").alias("name"))
    shared = stored(pairs.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least <> last"))
    groups = connected_components(pairs.join(shared, "name").select(F.col("doc").alias("a"), F.col("least").alias("b")))
    remove_stored(shared)
    return found.join(groups, found.doc == groups.node, "left").select("doc", "component", "r", "g", "removed")


def deduplicate(df: DataFrame, n_bands: int = 3, band_rows: int = 2, similarity: float = 0.8, most: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id, n_repeat_words, n_removed_words, removed) for every row of df.

    component_id is the smallest id reachable through shared passages; n_repeat_words counts words in passages that have
    more than one place, n_removed_words those of them that are not in a class's first; removed lists the latter as
    first:last words from 0, last exclusive, comma-joined.
    """
    texts = df.select(id_col, text_col)
    with shuffles_removed(df.sparkSession):
        found = matched(texts, n_bands, band_rows, similarity, most)
    out = df.select(F.col(id_col).alias("_id")).join(found, F.col("_id") == found.doc, "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("component", "_id").alias("component_id"),
        F.coalesce("r", F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce("g", F.lit(0)).cast("long").alias("n_removed_words"),
        F.coalesce("removed", F.lit("")).alias("removed"),
    )
