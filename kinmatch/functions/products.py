"""The string kernels over pairs of two lists: the values of ``kernels``' plain functions.

The second texts have ``LONGEST`` characters at most, and each is a word of bits. Of all pairs (a matrix with a row for each
first text), one step takes a character of a first text to all second ones; first texts go in order, and what they have in
common at their beginning (or end) is worked out once. Of some pairs (their places i and j), a step takes one of each.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np

from . import batches
from .batches import each, lengths, ordered

LONGEST = 64
COLUMNS = 8192
#: The share of all pairs from which on a matrix takes less time than the pairs.
DENSE = 1 / 6
#: Words that make classes of texts which share them: so many, and of over this share of all pairs.
WORDS, FREQUENT = 6, 1 / 64


def bits(size: np.ndarray) -> type:
    """The words of bits that texts of these lengths need."""
    longest = int(size.max(initial=0))
    return np.uint16 if longest <= 16 else np.uint32 if longest <= 32 else np.uint64


def masks(texts: list[str]) -> dict[str, np.ndarray]:
    """Of each character, its places in each text as bits."""
    size = lengths(texts)
    wide, kind = int(size.max(initial=0)), bits(size)
    if not wide:
        return {}
    codes = np.frombuffer("".join(t.ljust(wide) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), wide)
    there = np.arange(wide) < size[:, None]
    letters, number = np.unique(codes[there], return_inverse=True)
    out = np.zeros((len(letters), len(texts)), kind)
    text, place = np.nonzero(there)
    for k in range(wide):  # a text has one character at a place
        at = place == k
        out[number[at], text[at]] |= kind(1 << k)
    return {chr(c): row for c, row in zip(letters.tolist(), out, strict=True)}


def shared(x: str, y: str) -> int:
    """Characters that both begin with."""
    for k, (c, d) in enumerate(zip(x, y, strict=False)):
        if c != d:
            return k
    return min(len(x), len(y))


def in_order(texts: list[str]) -> tuple[int, list[tuple[str, int, int]]]:
    """Steps in all, and (text, characters it begins with as the one before, place) in order."""
    out, last = [], ""
    for text, k in sorted(zip(texts, range(len(texts)), strict=True)):
        out.append((text, shared(last, text), k))
        last = text
    return sum(len(t) - n for t, n, _ in out), out


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences."""
    out = np.zeros((len(a), len(b)), np.uint8)
    known = set("".join(b))
    drop = {ord(c): None for c in set("".join(a)) - known}  # of no second text
    a = [t.translate(drop) for t in a] if drop else a
    steps, order = in_order(a)
    back, reverse = in_order([t[::-1] for t in a])
    if back < steps:
        order, b = reverse, [t[::-1] for t in b]
    deep = max(map(len, a), default=0) + 1
    wide = max(LONGEST, min(COLUMNS, (1 << 20) // deep))
    for low in range(0, len(b), wide):
        part = b[low : low + wide]
        of, size, kind = masks(part), len(part), bits(lengths(part))
        none = np.zeros(size, kind)
        state, u = list(np.empty((deep, size), kind)), np.empty(size, kind)
        state[0][:] = ~kind(0)
        for text, begin, k in order:
            for i in range(begin, len(text)):
                here, to, m = state[i], state[i + 1], of.get(text[i], none)
                np.bitwise_and(here, m, u)
                np.add(here, u, to)
                np.bitwise_xor(here, u, u)
                np.bitwise_or(to, u, to)
            np.invert(state[len(text)], u)
            np.bitwise_count(u, out[k, low : low + wide])
    return out


def ratio(a: list[str], b: list[str]) -> np.ndarray:
    common, lb = common_lengths(a, b), lengths(b)
    out, empty = np.empty(common.shape), lb == 0
    for row, c, n in zip(out, common, lengths(a).tolist(), strict=True):
        np.divide(np.multiply(c, 200.0, row), np.maximum(n + lb, 1), row)
        if not n:
            row[empty] = 100.0
    return out


def token_sort(a: list[str], b: list[str]) -> np.ndarray:
    return ratio(each(ordered, a), each(ordered, b))


def places(lists) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for k, values in enumerate(lists):
        for v in values:
            out[v].append(k)
    return out


def common_of(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of some pairs."""
    if len(i) > DENSE * len(a) * len(b):
        return common_lengths(a, b)[i, j]
    out, of, kind = np.zeros(len(i), np.uint8), masks(b), bits(lengths(b))
    if not of:
        return out
    number = {ord(c): chr(k) for k, c in enumerate(of, 1)}
    drop = dict.fromkeys(map(ord, set("".join(a)) - of.keys()))
    a = [t.translate(drop | number) for t in a]
    longest = int(lengths(a).max(initial=0))
    if not longest:
        return out
    codes = np.frombuffer("".join(t.ljust(longest, chr(0)) for t in a).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(a), longest)
    steps = np.ascontiguousarray(codes.T).astype(np.int64) * len(b)
    flat = np.concatenate([np.zeros(len(b), kind), *of.values()])
    for low in range(0, len(i), COLUMNS):
        p, q = i[low : low + COLUMNS], j[low : low + COLUMNS]
        state, at, (m, high) = np.full(len(p), ~kind(0)), np.empty(len(p), np.int64), np.empty((2, len(p)), kind)
        for step in steps:
            np.take(step, p, out=at, mode="clip")
            np.add(at, q, at)
            np.take(flat, at, out=m, mode="clip")
            np.bitwise_and(state, m, m)
            np.add(state, m, high)
            np.bitwise_xor(state, m, state)
            np.bitwise_or(state, high, state)
        np.bitwise_count(~state, out[low : low + COLUMNS])
    return out


def ratio_of(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    total = lengths(a)[i] + lengths(b)[j]
    return np.where(total > 0, 100.0 * 2 * common_of(a, b, i, j) / np.maximum(total, 1), 100.0)


def token_set_of(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Texts of the same frequent words meet as classes, as they then share those; pairs that share another word go one by one."""
    x, y = ([frozenset(t.split()) for t in s] for s in (a, b))
    in_a, in_b = places(x), places(y)
    weight = sorted(((len(in_a[w]) * len(in_b[w]), w) for w in in_a.keys() & in_b.keys()), reverse=True)
    frequent = frozenset(w for n, w in weight[:WORDS] if n > FREQUENT * len(a) * len(b))
    kinds, class_of = [], []
    for side in (x, y):
        known: dict[frozenset, int] = {}
        class_of.append(np.array([known.setdefault(words & frequent, len(known)) for words in side], np.int64))
        kinds.append(list(known))
    kind = class_of[0][i] * len(kinds[1]) + class_of[1][j]
    out = np.zeros(len(i))
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        p, q = i[at], j[at]
        both = kinds[0][k // len(kinds[1])] & kinds[1][k % len(kinds[1])]
        left, right = ([" ".join(sorted(words - both)) for words in side] for side in (x, y))
        l, r, h = lengths(left)[p], lengths(right)[q], sum(map(len, both)) + len(both) - 1 if both else -1  # noqa: E741
        best = 100.0 * 2 * (common_of(left, right, p, q).astype(np.int64) + h + 1) / np.maximum(l + r + 2 * (h + 1), 1)
        if both:  # what both have, against it with one rest
            for rest in (l, r):
                best = np.maximum(best, 100.0 * 2 * h / np.maximum(2 * h + 1 + rest, 1))
            best[(l == 0) | (r == 0)] = 100.0
        out[at] = best
    out[(lengths(x)[i] == 0) | (lengths(y)[j] == 0)] = 0.0
    others = [w for _, w in weight if w not in frequent]
    if others:
        key, found = i * len(b) + j, []
        for w in others:
            found.append((np.array(in_a[w])[:, None] * len(b) + np.array(in_b[w])).ravel())
        alone(out, np.flatnonzero(np.isin(key, np.concatenate(found))), batches.token_set, a, b, i, j)
    return out


def alone(out: np.ndarray, which: np.ndarray, f, a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> None:
    """Some of the pairs by the kernel of batches."""
    for low in range(0, len(which), COLUMNS):
        at = which[low : low + COLUMNS]
        out[at] = f([a[k] for k in i[at].tolist()], [b[k] for k in j[at].tolist()])


def weighted_of(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, sort: np.ndarray) -> np.ndarray:
    """sort: the token_sort ratios of the pairs. Pairs of unlike lengths go one by one."""
    la, lb = lengths(a)[i], lengths(b)[j]
    full, spread = (la > 0) & (lb > 0), np.maximum(la, lb) / np.maximum(np.minimum(la, lb), 1)
    out = np.where(full, np.maximum(ratio_of(a, b, i, j), 0.95 * np.maximum(sort, token_set_of(a, b, i, j))), 0.0)
    alone(out, np.flatnonzero(full & (spread >= 1.5)), batches.weighted, a, b, i, j)
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    lb = lengths(b)
    by_length: dict[int, list[int]] = defaultdict(list)
    for k, t in enumerate(a):
        by_length[len(t)].append(k)
    of, kind, size = masks(b), bits(lb), len(b)
    ones = np.array([(1 << k) - 1 for k in range(LONGEST + 1)], np.uint64).astype(kind)
    unlike = {c: ~m for c, m in of.items()}
    first = {c: [(m >> kind(k)) & kind(1) == 1 for k in range(4)] for c, m in of.items()}
    whole, long = ones[lb], np.maximum(lb, 1).astype(np.float64)
    u, low, swapped = np.empty((3, size), kind)
    for n, at in by_length.items():
        if not n:
            continue
        reach = np.maximum(0, np.maximum(n, lb) // 2 - 1)
        window = []
        for i in range(n):
            high = np.minimum(lb, i + reach + 1)
            window.append(ones[high] ^ ones[np.minimum(np.maximum(0, i - reach), high)])
        free, hit = list(np.empty((n + 1, size), kind)), list(np.empty((n, size), kind))
        free[0][:] = ~kind(0)
        for text, begin, place in in_order([a[k] for k in at])[1]:
            for i in range(begin, n):
                m = of.get(text[i])
                if m is None:
                    free[i + 1][:], hit[i][:] = free[i], 0
                    continue
                np.bitwise_and(np.bitwise_and(free[i], m, u), window[i], u)
                np.bitwise_and(np.negative(u, low), u, low)  # the first free place
                np.bitwise_xor(free[i], low, free[i + 1])
                np.not_equal(u, 0, out=hit[i], casting="unsafe")
                np.negative(hit[i], hit[i])
            taken = ~free[n] & whole
            count = np.bitwise_count(taken)
            swapped[:] = 0
            for i, c in enumerate(text):
                if c in of:
                    np.bitwise_and(np.negative(taken, low), taken, low)
                    np.bitwise_and(low, hit[i], low)
                    np.bitwise_xor(taken, low, taken)
                    np.bitwise_or(swapped, np.bitwise_and(low, unlike[c], low), swapped)
            swaps = np.bitwise_count(swapped) >> 1
            jaro = count / float(n)
            jaro += count / long
            jaro += (count - swaps) / np.maximum(count, 1)
            jaro /= 3
            jaro[count == 0] = 0.0
            high = np.flatnonzero(jaro > 0.7)
            head, going = np.zeros(len(high), np.int64), np.ones(len(high), bool)
            for k, c in enumerate(text[:4]):
                going &= first[c][k][high] if c in first else False
                head += going
            jaro[high] += head * 0.1 * (1 - jaro[high])
            out[at[place]] = jaro
    here = places([t] for t in b)
    for k, t in enumerate(a):
        if t in here:
            out[k, here[t]] = 1.0
    return out


