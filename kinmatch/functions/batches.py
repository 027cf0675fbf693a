"""The string kernels over batches of pairs: the values of ``kernels``' plain functions, worked out for many pairs at once.

A batch's strings are matrices of characters, a row for each place and a column for each pair, so that a step of the dynamic
programme is one operation on a byte of every pair. Pairs with a string of over ``LONGEST`` characters go to the plain functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

LONGEST = 254
ROWS = 4096


def ordered(s: str) -> str:
    return " ".join(sorted(s.split()))


def lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def matrices(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of both sides, numbered from 2; places after an end are 0 and 1, which are equal to nothing."""
    n, m = int(la.max()), int(lb.max())
    whole = "".join([*(x.ljust(n) for x in a), *(y.ljust(m) for y in b)])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(codes.max())
    if top > 253:
        there = np.zeros(top + 1, bool)
        there[codes] = True
        codes = (np.cumsum(there) - 1)[codes]
        top = int(codes.max())
    codes = (codes + 2).astype(np.uint8 if top < 254 else np.uint16 if top < 65534 else np.uint32)
    x, y = (np.ascontiguousarray(c.reshape(len(a), w).T) for c, w in ((codes[: len(a) * n], n), (codes[len(a) * n :], m)))
    x[np.arange(n)[:, None] >= la] = 0
    y[np.arange(m)[:, None] >= lb] = 1
    return x, y


def parts(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> Iterator[tuple]:
    """(places, character matrices, lengths) of pairs of like lengths; the longer string of a pair comes second."""
    order = np.lexsort((np.minimum(la, lb), np.maximum(la, lb)))
    for low in range(0, len(order), ROWS):
        at = order[low : low + ROWS]
        x, y = zip(*((a[k], b[k]) if la[k] <= lb[k] else (b[k], a[k]) for k in at.tolist()), strict=True)
        n, m = np.minimum(la[at], lb[at]), np.maximum(la[at], lb[at])
        yield at, *matrices(x, y, n, m), n, m


def split(f: Callable, plain: Callable, a: list[str], b: list[str], kind=np.float64) -> np.ndarray:
    """f(a, b, la, lb) of pairs that are neither empty nor long; of long ones the plain function; else 0."""
    la, lb = lengths(a), lengths(b)
    out = np.zeros(len(a), kind)
    long = np.maximum(la, lb) > LONGEST
    for k in np.flatnonzero(long).tolist():
        out[k] = plain(a[k], b[k])
    at = np.flatnonzero(~long & (la > 0) & (lb > 0))
    if len(at):
        out[at] = f([a[k] for k in at.tolist()], [b[k] for k in at.tolist()], la[at], lb[at])
    return out


def _common(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for at, x, y, _, _ in parts(a, b, la, lb):
        best = np.zeros((len(y) + 1, len(at)), np.uint8)
        new, rows = np.empty((len(y), len(at)), np.uint8), list(best)
        for c in x:
            np.equal(y, c, out=new.view(bool))
            new += best[:-1]
            np.maximum(best[1:], new, out=best[1:])
            for left, here in zip(rows[1:-1], rows[2:], strict=True):
                np.maximum(here, left, out=here)
        out[at] = best[-1]
    return out


def common_length(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences."""
    from . import kernels as K  # whose UDFs take the batches here

    return split(_common, K.common_length, a, b, np.int64)


def ratio(a: list[str], b: list[str]) -> np.ndarray:
    total = lengths(a) + lengths(b)
    return np.where(total > 0, 100.0 * 2 * common_length(a, b) / np.maximum(total, 1), 100.0)


def each(f: Callable, texts: list[str]) -> list:
    """f of each text, worked out once for equal ones."""
    known = {t: f(t) for t in set(texts)}
    return [known[t] for t in texts]


def token_sort(a: list[str], b: list[str]) -> np.ndarray:
    return ratio(each(ordered, a), each(ordered, b))


def token_set(a: list[str], b: list[str]) -> np.ndarray:
    """The words of both come first on either side, so that they add their length; only the rests are compared."""
    words = lambda t: frozenset(t.split())
    out, at, left, right, held = np.zeros(len(a)), [], [], [], []
    for k, (x, y) in enumerate(zip(each(words, a), each(words, b), strict=True)):
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[k] = 100.0
            continue
        at.append(k)
        left.append(" ".join(sorted(x - both)))
        right.append(" ".join(sorted(y - both)))
        held.append(sum(map(len, both)) + len(both) - 1 if both else -1)
    if at:
        l, r, h = lengths(left), lengths(right), np.array(held)  # noqa: E741
        best = 100.0 * 2 * (common_length(left, right) + h + 1) / (l + r + 2 * (h + 1))
        for rest in (l, r):  # what both have, against it with one rest
            best = np.where(h >= 0, np.maximum(best, 100.0 * 2 * h / np.maximum(2 * h + 1 + rest, 1)), best)
        out[at] = best
    return out


def _best_window(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter string with a window of the longer of its length, or shorter at the edges.

    Strands go down from each place of the longer string and from the left of each row; at unequal characters two that
    meet cross unless they have crossed before (Tiskin's combing). A window's common length is then the number of its
    places at which strands end that began before it.
    """
    out = np.zeros(len(a))
    for at, x, y, n, m in parts(a, b, la, lb):
        size, wide, one = len(at), len(y), np.arange(len(at))
        began = np.repeat(np.arange(1, wide + 1, dtype=np.uint8)[:, None], size, axis=1)  # 0: from the left
        open_, v, s = np.empty_like(began), np.empty(size, np.uint8), np.empty(size, np.uint8)
        rows, others = list(began), list(open_)
        for c in x:
            np.not_equal(y, c, out=open_.view(bool))
            open_ *= began
            v[:] = 0
            for here, o in zip(rows, others, strict=True):
                np.add(here, v, out=s)
                np.maximum(v, o, out=here)
                np.subtract(s, here, out=v)
        ends = np.full((wide + 1, size), 255, np.uint8)
        for j in range(wide):
            ends[began[j], one] = j
        n, m = n.astype(np.int32), m.astype(np.int32)
        found, best = np.zeros(size, np.int32), np.zeros(size)
        for h in range(1, len(x) + 1):  # windows from the left edge, up to a full one
            live = h <= n
            found += (began[h - 1] == 0) & live
            np.maximum(best, np.where(live, 200.0 * found / (n + h), 0.0), out=best)
        flat = began.ravel()
        for low in range(1, wide):
            high, last = np.minimum(low + n, m), np.minimum(low - 1 + n, m)
            found -= began[low - 1] <= low - 1
            found += (ends[low] >= low) & (ends[low] < last)
            found += (high > last) & (flat[np.minimum(low + n - 1, wide - 1) * size + one] <= low)
            live = low < m
            np.maximum(best, np.where(live, 200.0 * found / np.where(live, n + high - low, 1), 0.0), out=best)
        out[at] = best
    return out


def partial(a: list[str], b: list[str]) -> np.ndarray:
    from . import kernels as K  # whose UDFs take the batches here

    def both_ways(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        same = np.flatnonzero(la == lb)
        best = _best_window(a + [b[k] for k in same.tolist()], b + [a[k] for k in same.tolist()], np.concatenate([la, la[same]]), np.concatenate([lb, lb[same]]))
        out = best[: len(a)]
        out[same] = np.maximum(out[same], best[len(a) :])
        return out

    out = split(both_ways, K.partial, a, b)
    return np.where((lengths(a) == 0) & (lengths(b) == 0), 100.0, out)


def partial_token(a: list[str], b: list[str]) -> np.ndarray:
    words = lambda t: frozenset(t.split())
    once = lambda t: " ".join(sorted(set(t.split())))
    shared = np.fromiter((not x.isdisjoint(y) for x, y in zip(each(words, a), each(words, b), strict=True)), bool, len(a))
    at = np.flatnonzero(~shared)
    out = np.full(len(a), 100.0)
    if len(at):
        a, b = [a[k] for k in at.tolist()], [b[k] for k in at.tolist()]
        s, t, u, v = each(ordered, a), each(ordered, b), each(once, a), each(once, b)
        best = partial(s, t)
        more = [k for k in range(len(a)) if s[k] != u[k] or t[k] != v[k]]  # words that are repeated
        if more:
            best[more] = np.maximum(best[more], partial([u[k] for k in more], [v[k] for k in more]))
        out[at] = best
    return out


def weighted(a: list[str], b: list[str], known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """known: values of other kernels for these pairs, which are not worked out again."""
    la, lb = lengths(a), lengths(b)
    out, known = np.zeros(len(a)), known or {}
    full = (la > 0) & (lb > 0)
    spread = np.maximum(la, lb) / np.maximum(np.minimum(la, lb), 1)
    near, far = np.flatnonzero(full & (spread < 1.5)), np.flatnonzero(full & (spread >= 1.5))
    of = lambda t, at: [t[k] for k in at.tolist()]
    value = lambda f, at, x, y: known[f.__name__][at] if f.__name__ in known else f(x, y)
    if len(near):
        x, y = of(a, near), of(b, near)
        out[near] = np.maximum(value(ratio, near, x, y), 0.95 * np.maximum(value(token_sort, near, x, y), value(token_set, near, x, y)))
    if len(far):
        x, y, scale = of(a, far), of(b, far), np.where(spread[far] <= 8, 0.9, 0.6)
        out[far] = np.maximum(np.maximum(value(ratio, far, x, y), scale * value(partial, far, x, y)), 0.95 * scale * partial_token(x, y))
    return out


def _jaro_winkler(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    out, order = np.zeros(len(a)), np.argsort(np.maximum(la, lb), kind="stable")
    for low in range(0, len(order), ROWS):
        at = order[low : low + ROWS]
        n, m = la[at], lb[at]
        out[at] = _jaro_of(*matrices([a[k] for k in at.tolist()], [b[k] for k in at.tolist()], n, m), n, m)
    return out


def _jaro_of(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    within = np.arange(int(reach.max()) + 1)[:, None] <= reach
    free, took = np.ones(y.shape, bool), np.zeros(x.shape, bool)
    hit = np.empty(x.shape[1], bool)
    for i, c in enumerate(x):
        first, last = max(0, i - len(within) + 1), min(len(y), i + len(within))
        same = (y[first:last] == c) & free[first:last]
        same &= within[np.abs(np.arange(first, last) - i)]
        open_ = np.ones(x.shape[1], bool)
        for here, left in zip(same, free[first:last], strict=True):
            np.logical_and(here, open_, out=hit)
            np.logical_xor(left, hit, out=left)
            np.logical_xor(open_, hit, out=open_)
        np.logical_not(open_, out=took[i])
    count = took.sum(axis=0)
    unlike = x.T[took.T] != y.T[~free.T]
    swaps = np.bincount(np.repeat(np.arange(x.shape[1]), count), unlike, x.shape[1]).astype(np.int64) // 2
    some = np.maximum(count, 1)
    jaro = np.where(count > 0, (count / n + count / m + (count - swaps) / some) / 3, 0.0)
    head, going = np.zeros(x.shape[1], np.int64), np.ones(x.shape[1], bool)
    for c, d in zip(x[:4], y[:4], strict=False):
        going &= c == d
        head += going
    return np.where(jaro > 0.7, jaro + head * 0.1 * (1 - jaro), jaro)


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    from . import kernels as K  # whose UDFs take the batches here

    out = split(_jaro_winkler, K.jaro_winkler, a, b)
    return np.where(np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, len(a)), 1.0, out)


KERNELS = {f.__name__: f for f in (ratio, token_sort, token_set, partial, weighted, jaro_winkler)}


def together(names: tuple[str, ...], a: list[str], b: list[str]) -> dict[str, np.ndarray]:
    """Some kernels of the same pairs; the weighted ratio comes last and takes the others' values."""
    found: dict[str, np.ndarray] = {}
    for name in sorted(names, key="weighted".__eq__):
        found[name] = weighted(a, b, found) if name == "weighted" else KERNELS[name](a, b)
    return found


def trigram_cosine(a: list[str], b: list[str]) -> np.ndarray:
    """Cosine of trigram counts; equal texts 1, an empty one 0, shorter than 3 only if equal.

    Trigrams are numbered and counted once a text; those of a pair's first text are then looked up among the second's.
    """
    number = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in (a, b))
    size = lengths(list(number))
    out = np.where((x == y) & (size[x] > 0), 1.0, 0.0)
    at = np.flatnonzero((x != y) & (size[x] >= 3) & (size[y] >= 3))
    if not len(at):
        return out
    codes = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(size)), size)
    within = text[:-2] == text[2:]
    grams, gram = np.unique((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[within], return_inverse=True)
    key, count = np.unique(text[:-2][within] * len(grams) + gram, return_counts=True)
    owner, gram = np.divmod(key, len(grams))
    begin = np.searchsorted(owner, np.arange(len(size) + 1))
    long = np.sqrt(np.bincount(owner, count * count, len(size)))
    at = at[np.argsort(y[at], kind="stable")]  # so that what is looked up lies near
    left, right = x[at], y[at]
    many = begin[left + 1] - begin[left]
    place = np.arange(int(many.sum())) + np.repeat(begin[left] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    sought = np.repeat(right, many) * len(grams) + gram[place]
    found = np.minimum(np.searchsorted(key, sought), len(key) - 1)
    product = np.where(key[found] == sought, count[place] * count[found], 0)
    out[at] = np.bincount(np.repeat(np.arange(len(at)), many), product, len(at)) / (long[left] * long[right])
    return out
