"""String similarities of pairs: builtins where they exist, else Arrow-batched pandas UDFs.

Ratios are 0 to 100, Jaro-Winkler and Levenshtein 0 to 1. Two empty strings have ratio 100, Jaro-Winkler 1 and Levenshtein
similarity 1; token_set, partial and weighted ratios of an empty string are 0. Null counts as empty.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import batches
from .batches import ordered


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    full, places = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(ordered(a), ordered(b))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    join = lambda rest: f"{both} {rest}" if both else rest
    best = ratio(join(left), join(right))
    return max(best, ratio(both, join(left)), ratio(both, join(right))) if both else best


def best_window(a: str, b: str) -> float:
    """The best ratio of a with a window of b of its length, or shorter at the edges.

    A window's common subsequence is at most the number of characters it shares with a, and a step to the right adds one
    at most; a window is looked into only if both let it be better than the best so far. The one that shares most comes first.
    """
    n, places, left = len(a), {}, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
        left[c] = left.get(c, 0) + 1
    full, shared, held = (1 << n) - 1, 0, []
    for at in range(1 - n, len(b)):
        if at > 0 and (c := b[at - 1]) in left:
            left[c] += 1
            shared -= left[c] > 0
        if at + n <= len(b) and (c := b[at + n - 1]) in left:
            shared += left[c] > 0
            left[c] -= 1
        held.append(shared)

    def common(low: int, high: int) -> int:
        open_ = full
        for c in b[low:high]:
            hit = open_ & places.get(c, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & full
        return n - open_.bit_count()

    first = max(range(len(held)), key=held.__getitem__)
    low, high = max(0, first + 1 - n), min(len(b), first + 1)
    best, most = 200.0 * common(low, high) / (n + high - low), 0
    for k, shared in enumerate(held):
        low, high = max(0, k + 1 - n), min(len(b), k + 1)
        most = min(shared, most + 1)
        # A best window begins, or at the left edge ends, with a character of a.
        if 200.0 * most / (n + high - low) > best and b[low if low else high - 1] in places:
            most = common(low, high)
            best = max(best, 200.0 * most / (n + high - low))
    return best


def best_window_combed(a: str, b: str) -> float:
    """``best_window`` of long strings, all windows at once: strands are combed a diagonal at a time (see ``batches``)."""
    n, m = len(a), len(b)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a[::-1], b))
    h, v = np.arange(n, dtype=np.int32), np.arange(n, n + m, dtype=np.int32)
    for d in range(n + m - 1):
        j, end = max(0, d - n + 1), min(m, d + 1)
        left, up = h[n - 1 - d + j : n - 1 - d + end], v[j:end]
        right = np.minimum(left, up)
        np.copyto(right, up, where=x[n - 1 - d + j : n - 1 - d + end] == y[j:end])
        up += left - right
        left[:] = right
    began, at = v.astype(np.int64) - n, np.arange(m)
    step = np.bincount(np.maximum(np.maximum(began, at - n) + 1, 0), minlength=m + 1) - np.bincount(at + 1, minlength=m + 1)
    wide = np.cumsum(step)[:m]  # of windows from each place on
    edge = np.cumsum(began < 0)[: min(n, m)]
    return float(max((200.0 * wide / (n + np.minimum(n, m - at))).max(), (200.0 * edge / (n + 1 + np.arange(len(edge)))).max()))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer; of equal lengths, the better way round."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = best_window if min(len(a), len(b)) < 256 else best_window_combed
    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(*sorted((a, b), key=len))


def partial_token(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return 100.0 if x & y else max(partial(ordered(a), ordered(b)), partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted(a: str, b: str) -> float:
    """The largest of the plain ratio and weighted token ratios; partial ones where the lengths differ much."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    swaps = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    head = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + head * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


KERNELS = {f.__name__: f for f in (ratio, token_sort, token_set, partial, weighted, jaro_winkler)}


def distinct(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], list[int]]:
    """Both sides of a batch's distinct pairs, and the place of each row's pair among them."""
    places: dict[tuple[str, str], int] = {}
    back = [places.setdefault((x or "", y or ""), len(places)) for x, y in zip(a, b, strict=True)]
    left, right = zip(*places, strict=True) if places else ((), ())
    return list(left), list(right), back


def of_batch(name: str, a: pd.Series, b: pd.Series) -> np.ndarray:
    """The kernel of each pair of a batch; pairs that repeat are worked out once."""
    left, right, back = distinct(a, b)
    return batches.KERNELS[name](left, right)[back]


def _udf(name: str):
    @F.pandas_udf(DoubleType())
    def pairwise(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(of_batch(name, a, b), dtype="float64")

    return pairwise


UDFS = {name: _udf(name) for name in KERNELS}


def similarity(name: str, a: Column, b: Column) -> Column:
    return UDFS[name](a, b)


@functools.cache
def _together(names: tuple[str, ...]):
    @F.pandas_udf(", ".join(f"{name} double" for name in names))
    def pairwise(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        left, right, back = distinct(a, b)
        return pd.DataFrame({name: x[back] for name, x in batches.together(names, left, right).items()}, columns=list(names))

    return pairwise


def together(a: Column, b: Column, *names: str) -> Column:
    """Some kernels of the same pairs as a structure with their names, so that they share their work."""
    return _together(names)(a, b)


def register(spark: SparkSession, prefix: str = "sim_") -> None:
    """The kernels as SQL functions."""
    for name, f in UDFS.items():
        spark.udf.register(prefix + name, f)


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def trigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body or its lambdas name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """The value as the one row of a generator: filters on it are not pushed below, where it would be worked out again."""
    return F.explode(F.array(value))


def trigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of trigram counts; equal strings 1, an empty one 0, shorter than 3 only if equal."""

    def pairs(x: Column, y: Column) -> Column:
        """How many pairs of equal trigrams, one of each side."""
        return F.aggregate(x, F.lit(0.0), lambda s, g: s + F.size(y) - F.size(F.array_remove(y, g)))

    def cosine(q: Column) -> Column:
        return pairs(q["x"], q["y"]) / (F.sqrt(pairs(q["x"], q["x"])) * F.sqrt(pairs(q["y"], q["y"])))

    def value(t: Column) -> Column:
        a, b = t["a"], t["b"]
        full = let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), cosine)
        return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when((F.length(a) < 3) | (F.length(b) < 3), F.lit(0.0)).otherwise(full)

    return let(F.struct(a.alias("a"), b.alias("b")), value)


@F.pandas_udf(DoubleType())
def _trigram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right, back = distinct(a, b)
    return pd.Series(batches.trigram_cosine(left, right)[back], dtype="float64")


def trigram_cosine_of_batches(a: Column, b: Column) -> Column:
    """``trigram_cosine`` in batches of pairs; null counts as empty."""
    return _trigram_cosine(a, b)
