"""Rule scores of pairs, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import products as P
from ..functions import text as X
from ..functions.batches import lengths, ordered
from .features import agreement, both, overlap, sim


def trigram_score(n1: Column, a1: Column, n2: Column, a2: Column) -> Column:
    """0.65 of the names' and 0.35 of the addresses' trigram cosine, of trimmed lower-case texts."""
    low = lambda c: F.trim(F.lower(c))
    return 0.65 * K.trigram_cosine(low(n1), low(n2)) + 0.35 * K.trigram_cosine(low(a1), low(a2))


def weighted_score() -> Column:
    """Of the 20 features of version 2; damped for empty names and for short names of unlike lengths."""
    parts = {"name_tset": 0.25 / 100, "name_tsort": 0.15 / 100, "name_ratio": 0.10 / 100, "name_jw": 0.10, "compact_ratio": 0.05 / 100, "addr_tset": 0.10 / 100, "addr_tsort": 0.05 / 100, "addr_ratio": 0.05 / 100, "blocking_score": 0.10}
    total = sum((F.col(c) * w for c, w in parts.items()), F.lit(0.05) * F.col("num_tset") / 100 * F.col("num_both"))
    empty = (F.col("name1_empty") > 0.5) | (F.col("name2_empty") > 0.5)
    short = (F.col("len_ratio") < 0.4) & (F.col("name_ratio") < 60)
    return total * F.when(empty, 0.3).otherwise(1.0) * F.when(short, 0.5).otherwise(1.0)


def gate_texts(n: Column, a: Column) -> dict[str, Column]:
    """Of an entity, what ``gated_score`` takes of it."""
    d = X.clean_folded(a)
    return {"c": X.clean_folded(n), "d": d, "pin": X.postal_last(d), "num": X.number_set(d)}


def long_texts(n: Column, a: Column) -> Column:
    """Whether an entity's texts are too long for ``gated_products``. Only other than ASCII grows when it is cleaned."""
    made = gate_texts(n, a)
    may_be = F.concat(n, a).rlike(r"[^\x00-\x7F]") | (F.length(n) + F.length(a) >= P.LONGEST)
    return may_be & (F.length(made["c"]) + F.length(made["d"]) >= P.LONGEST)


def gated_score(pairs: DataFrame, made: bool = False) -> DataFrame:
    """pairs(n1, a1, n2, a2) with ``rule_score``: 0 outside two gates, else a weighted sum with number checks, 0 to 1.

    made: pairs have both sides' ``gate_texts`` too, worked out once an entity.
    """
    if not made:
        pairs = pairs.withColumns({f"{x}{k}": c for k in (1, 2) for x, c in gate_texts(F.col(f"n{k}"), F.col(f"a{k}")).items()})
    c1, d1, c2, d2 = (F.col(c) for c in ("c1", "d1", "c2", "d2"))
    p = pairs.withColumns({
        "_comb": sim("token_sort", both(c1, d1), both(c2, d2)), "_set": sim("token_set", d1, d2), "_names": K.together(c1, c2, "token_sort", "jaro_winkler", "weighted"),
    })
    p = p.withColumns({"_sort": F.col("_names.token_sort") / 100.0, "_jw": F.col("_names.jaro_winkler"), "_w": F.col("_names.weighted") / 100.0})
    pin = agreement(F.col("pin1"), F.col("pin2"))
    num = overlap(F.col("num1"), F.col("num2"))
    within = (c1 != "") & (c2 != "") & (F.contains(c1, c2) | F.contains(c2, c1))
    total = (
        0.40 * F.col("_comb") + 0.25 * F.col("_sort") + 0.15 * F.col("_jw") + 0.10 * F.col("_set") + 0.10 * F.col("_w")
        + F.when(pin > 0, 0.03).when(pin < 0, -0.25).otherwise(0.0) + F.when(num > 0, 0.03).when(num < 0, -0.15).otherwise(0.0) + F.when(within, 0.02).otherwise(0.0)
    )
    shut = (F.col("_comb") < 0.55) | ((F.col("_sort") < 0.60) & (F.col("_jw") < 0.75))
    score = F.when(shut, 0.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    return p.withColumn("rule_score", score).drop(*(f"{x}{k}" for x in ("c", "d", "pin", "num") for k in (1, 2)), "_names", "_comb", "_sort", "_jw", "_set", "_w")


#: Pairs of a block, pairs whose kernels are worked out at once, and pairs of a row that goes back to Spark.
BLOCK, SOME, ROW = 1 << 22, 1 << 20, 1 << 17
PRODUCTS = "s1 array<string>, t array<string>, score array<double>"


def rounded(x: np.ndarray) -> np.ndarray:
    """Values of 0 to 1 to 6 places as Spark rounds them: what is next to a half goes by its decimal digits."""
    y = x * 1e6
    whole = np.floor(y)
    y -= whole
    out = (whole + (y >= 0.5)) / 1e6
    half = np.flatnonzero(np.abs(y - 0.5) < 1e-4)
    if len(half):
        values, back = np.unique(x.ravel()[half], return_inverse=True)
        exact = np.array([float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values.tolist()])
        out.ravel()[half] = exact[back]
    return out


def numbered(values: list) -> tuple[list, np.ndarray]:
    """Distinct values, and the place of each value among them."""
    known: dict = {}
    back = np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, len(values))
    return list(known), back


def open_names(c1: list[str], of_c1: np.ndarray, c2: list[str], of_c2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the pairs whose names the gate lets through, with those of their names and the names' token_sort and Jaro-Winkler."""
    sort, jw = P.token_sort(c1, c2), P.jaro_winkler(c1, c2)
    sort /= 100.0
    let = ~((sort < 0.60) & (jw < 0.75))
    columns = slice(None) if np.array_equal(of_c2, np.arange(len(of_c2))) else of_c2
    found = [np.flatnonzero(let[n][columns]) for n in of_c1.tolist()]
    i, j = np.repeat(np.arange(len(found)), lengths(found)), np.concatenate(found)
    x, y = of_c1[i], of_c2[j]
    return i, j, x, y, sort[x, y], jw[x, y]


def product_scores(a: pa.Table, b: pa.Table) -> np.ndarray:
    """``gated_score`` to 6 places of all pairs of two tables (c, d, pin, num), of which the second has short texts.

    Kernels of pairs that a gate shuts are not worked out.
    """
    (c1, of_c1), (c2, of_c2), (d1, of_d1), (d2, of_d2) = (numbered(t[x].to_pylist()) for x in ("c", "d") for t in (a, b))
    (u1, of_u1), (u2, of_u2) = (numbered([ordered(f"{c} {d}") for c, d in zip(t["c"].to_pylist(), t["d"].to_pylist(), strict=True)]) for t in (a, b))
    s1, s2 = ([ordered(c) for c in side] for side in (c1, c2))
    n1, n2 = (t["num"].to_pylist() for t in (a, b))
    (pins, pin), wide = numbered([*a["pin"].to_pylist(), *b["pin"].to_pylist()]), b.num_rows
    known = np.array([p is not None and p != "" for p in pins], bool)[pin]
    (p1, p2), (k1, k2) = (np.split(v, [a.num_rows]) for v in (pin, known))
    m1, m2, in1, in2 = lengths(n1) > 0, lengths(n2) > 0, P.places(n1), P.places(n2)
    same = np.unique(np.concatenate([np.zeros(0, np.int64), *((np.array(in1[v])[:, None] * wide + np.array(in2[v])).ravel() for v in in1.keys() & in2.keys())]))
    out = np.zeros((a.num_rows, wide))
    opened = open_names(c1, of_c1, c2, of_c2)
    for low in range(0, len(opened[0]), SOME):
        i, j, x, y, sort, jw = (v[low : low + SOME] for v in opened)
        comb = P.ratio_of(u1, u2, of_u1[i], of_u2[j]) / 100.0
        at = np.flatnonzero(comb >= 0.55)
        i, j, x, y, sort, jw, comb = (v[at] for v in (i, j, x, y, sort, jw, comb))
        total = 0.40 * comb
        total += 0.25 * sort
        total += 0.15 * jw
        total += 0.10 * (P.token_set_of(d1, d2, of_d1[i], of_d2[j]) / 100.0)
        total += 0.10 * (P.weighted_of(c1, c2, x, y, P.ratio_of(s1, s2, x, y)) / 100.0)
        total += np.where(k1[i] & k2[j], np.where(p1[i] == p2[j], 0.03, -0.25), 0.0)
        total += np.where(m1[i] & m2[j], np.where(np.isin(i * wide + j, same), 0.03, -0.15), 0.0)
        pairs, back = np.unique(x * len(c2) + y, return_inverse=True)
        names = [(c1[k], c2[n]) for k, n in zip(*(v.tolist() for v in np.divmod(pairs, len(c2))), strict=True)]
        total += np.array([0.02 if s and t and (s in t or t in s) else 0.0 for s, t in names])[back]
        out[i, j] = rounded(np.clip(total, 0.0, 1.0))
    return out


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a group of S1 and S2 (src, id, c, d, pin, num): lists of S1, of S2, and the scores of their pairs, row after row."""
    group = pa.Table.from_batches(batches)
    s1, s2 = (group.filter(pc.equal(group["src"], k)) for k in (1, 2))
    s2 = s2.filter(pc.less_equal(pc.add(pc.utf8_length(s2["c"]), pc.utf8_length(s2["d"])), P.LONGEST - 1))
    for low in range(0, s2.num_rows, P.COLUMNS):
        b = s2.slice(low, P.COLUMNS)
        ids, most = b["id"].combine_chunks(), BLOCK // b.num_rows
        for top in range(0, s1.num_rows, most):
            a = s1.slice(top, most)
            scores, step = product_scores(a, b), max(1, ROW // b.num_rows)
            for k in range(0, a.num_rows, step):
                flat = scores[k : k + step].ravel()
                lists = (a["id"].slice(k, step).combine_chunks(), ids, pa.array(flat))
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=["s1", "t", "score"])


def gated_products(s1: DataFrame, s2: DataFrame, parts: int = 8) -> DataFrame:
    """(s1_id, t_id, score): ``gated_score`` to 6 places of all pairs of a country of s1 and s2 (country, id, c, d, pin, num).

    S2 is dealt over parts, S1 goes to each, and they meet as blocks. S2 with ``long_texts`` are left out.
    """
    columns = ("id", "c", "d", "pin", "num")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    one = s1.select("country", each_part.alias("part"), F.lit(1).alias("src"), *columns)
    two = s2.select("country", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("src"), *columns)
    every = one.unionByName(two).where("country is not null").repartition(8 * parts, "country", "part")  # a fixed number: small tables still make many pairs
    blocks = every.groupBy("country", "part").applyInArrow(meet, PRODUCTS)
    pairs = blocks.select("s1", "t", F.size("t").alias("n"), F.posexplode("score").alias("k", "score"))
    return pairs.select(F.get("s1", F.expr("k div n").cast("int")).alias("s1_id"), F.get("t", F.col("k") % F.col("n")).alias("t_id"), "score")
