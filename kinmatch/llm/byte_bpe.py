"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut by a pattern; each distinct piece is encoded once a batch and kept in a bounded cache. Pieces that are not
tokens themselves go into matrices padded to the bucket of their length. In each round every row merges its leftmost pair
of least rank; pair ranks come from an open-addressing hash table in numpy, and finished rows are compacted away. Pieces
longer than ``LONG`` bytes (one row each would need as many rounds as it has merges) take the same merges from a heap.

Null text is an empty one: 0 ids. Every row gives a row; other columns are not returned.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

NONE = np.int32(2**31 - 1)
LONG = 256
#: Characters from which pieces are taken in portions instead of one list.
PORTION = 1 << 20


class PairTable:
    """Ranks of token pairs: keys left * size + right in a table of a power of two slots, probed linearly."""

    def __init__(self, pairs: dict[tuple[int, int], int], n_ids: int):
        self.n = np.int64(n_ids)
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.probes = 1
        keys = np.fromiter((a * n_ids + b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots, probe = self.slot(keys), 1
        while len(keys):
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            put = first[free[first]]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, slots = keys[rest], ranks[rest], (slots[rest] + 1) & self.mask
            self.probes, probe = max(self.probes, probe), probe + 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none or a side is padding (-1)."""
        keys = left.astype(np.int64) * self.n + right
        keys[(left < 0) | (right < 0)] = -2
        slots = self.slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for one rank file of the public base64 form."""

    def __init__(self, path: str, pattern: str, most_pieces: int = 400_000, longest_piece: int = 48):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.most, self.longest = regex.compile(pattern), most_pieces, longest_piece
        n = max(self.ranks.values()) + 1
        self.pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs, n)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        tokens = [b""] * n
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    # -- encoding -------------------------------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece by the merges alone."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault(4 if len(p) <= 4 else -(-len(p) // 8) * 8 if len(p) <= 32 else -(-len(p) // 64) * 64, []).append(i)
        for width, rows in buckets.items():
            for at in range(0, len(rows), step := max(1, (1 << 20) // width)):
                self.merge_rows(pieces, rows[at : at + step], width, out)
        return out

    def merge_rows(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        left = np.array([len(pieces[i]) for i in rows])
        ids = np.where(np.arange(width) < left[:, None], self.byte[raw], np.int32(-1))
        ids = np.concatenate([ids, np.full((len(rows), 2), -1, np.int32)], axis=1)
        rank = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width + 1)
        which = np.array(rows)
        columns = np.arange(width + 1)
        while len(which):
            at = rank.argmin(axis=1)  # the leftmost of the least
            every = np.arange(len(which))
            best = rank[every, at]
            done = best == NONE
            if done.any():
                for r, row, k in zip(which[done].tolist(), ids[done], left[done].tolist(), strict=True):
                    out[r] = row[:k].astype("<u4").tobytes()
                keep = ~done
                ids, rank, which, left, at, best = ids[keep], rank[keep], which[keep], left[keep], at[keep], best[keep]
                every = np.arange(len(which))
                if not len(which):
                    break
            # Drop the pair's second id and the rank of the pair, then put in the merged id and its two new ranks.
            source = columns + (columns > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            ids[every, at] = best
            rank[:, :-1] = np.take_along_axis(rank, np.minimum(source[:, :-1], rank.shape[1] - 1), axis=1)
            rank[every, at] = self.table.get(ids[every, at], ids[every, at + 1])
            has = at > 0
            rank[every[has], at[has] - 1] = self.table.get(ids[every[has], at[has] - 1], ids[every[has], at[has]])
            left -= 1

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := pairs.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """ids of each of the given distinct pieces; short ones stay in the cache."""
        found, hard = {}, []
        for p in pieces:
            raw = p.encode()
            r = self.ranks.get(raw)
            if r is None:
                hard.append((p, raw))
            else:
                found[p] = r.to_bytes(4, "little")
        found.update(zip((p for p, _ in hard), self.merge([raw for _, raw in hard]), strict=True))
        self.cache.update((p, b) for p, b in found.items() if len(p) <= self.longest)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.cache) > self.most:
            self.cache.clear()
        short = [i for i, t in enumerate(texts) if len(t) <= PORTION]
        lists = [self.pattern.findall(texts[i]) for i in short]
        found = self.learn(set().union(*lists) - self.cache.keys())
        out = [b""] * len(texts)
        for i, pieces in zip(short, lists, strict=True):
            out[i] = self.join(pieces, found)
        for i, t in enumerate(texts):
            if len(t) > PORTION:
                out[i] = b"".join(self.portions(t))
        return out

    def portions(self, text: str) -> Iterable[bytes]:
        pieces = []
        for m in self.pattern.finditer(text):
            pieces.append(m[0])
            if len(pieces) == 1 << 16:
                yield self.join(pieces, self.learn(set(pieces) - self.cache.keys()))
                pieces = []
        yield self.join(pieces, self.learn(set(pieces) - self.cache.keys()))

    def join(self, pieces: list[str], found: dict[str, bytes]) -> bytes:
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            return b"".join([self.cache[p] if p in self.cache else found[p] for p in pieces])

    # -- decoding -------------------------------------------------------------------------------------------------

    def decode(self, ids: bytes, portion: int = 1 << 18) -> bytes:
        """The bytes that the ids stand for."""
        every, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(every), portion):
            some = every[at : at + portion]
            n = self.length[some]
            ends = np.cumsum(n)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.offset[some] - (ends - n), n)].tobytes())
        return b"".join(out)


_MODELS: dict[tuple[str, str], ByteBPE] = {}


def model(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = ByteBPE(path, pattern)
    return _MODELS[path, pattern]


def encode_texts(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary): the ids as little-endian unsigned 32-bit integers, and the bytes they stand for."""

    def rows(keys, texts):
        m = model(ranks, pattern)
        ids = m.encode([t or "" for t in texts])
        return {"doc_id": keys, "ids": ids, "decoded": [m.decode(x) for x in ids]}

    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
    out = map_rows(df, rows, [id_col, text_col], "doc_id long, ids binary, decoded binary", arrow)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def encode_digests(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of df(doc_id, text); the ids stay in the worker."""

    def rows(keys, texts):
        m = model(ranks, pattern)
        ids = m.encode([t or "" for t in texts])
        return {
            "doc_id": keys,
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(m.decode(x)).hexdigest() for x in ids],
        }

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_rows(df, rows, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow)
