"""Pair features: named sets over pairs(s1_id, t_id, src, score, ord) joined with both sides' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X


def join_sides(pairs: DataFrame, s1: DataFrame, pool: DataFrame, outer: bool = False, texts=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """pairs with n1, a1, n2, a2, and ``keep`` of S1; pairs of an unknown id are dropped, or with ``outer`` have empty texts.

    texts(name, address) names further columns, worked out once an entity; they come with 1 and 2 behind their names.
    """
    how = "left" if outer else "inner"
    make = lambda n, a: {"n": n, "a": a} | (texts(n, a) if texts else {})
    side = lambda e, i, k: e.select(F.col("entity_id").alias(i), *(keep if k == 1 else ()), *(c.alias(f"{x}{k}") for x, c in make(X.text("name"), X.text("addr")).items()))
    out = pairs.join(side(s1, "s1_id", 1), "s1_id", how).join(side(pool, "t_id", 2), "t_id", how)
    empty = make(F.lit(""), F.lit(""))
    return out.withColumns({f"{x}{k}": F.coalesce(F.col(f"{x}{k}"), c) for x, c in empty.items() for k in (1, 2)}) if outer else out


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where they are true, else 0."""
    return pairs.join(truth.select("s1_id", "t_id").distinct().withColumn("label", F.lit(1)), ["s1_id", "t_id"], "left").fillna(0, ["label"])


def agreement(a: Column, b: Column) -> Column:
    """1 if equal, -1 if not, 0 if one is missing or empty."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(~known, 0.0).when(a == b, 1.0).otherwise(-1.0)


def overlap(a: Column, b: Column) -> Column:
    """1 if two arrays share a value, -1 if both have some and share none, else 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(F.arrays_overlap(a, b), 1.0).otherwise(-1.0)


def relative_length(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def sim(kernel: str, a: Column, b: Column, scale: float = 100.0) -> Column:
    return K.similarity(kernel, a, b) / scale


def some(kernels: dict[str, str], a: Column, b: Column, scale: float = 100.0) -> dict[str, Column]:
    """``sim`` of several kernels, by the features' names; Jaro-Winkler stays 0 to 1."""
    found = K.together(a, b, *dict.fromkeys(kernels.values()))
    return {name: found[kernel] / (1.0 if kernel == "jaro_winkler" else scale) for name, kernel in kernels.items()}


def both(n: Column, a: Column) -> Column:
    return F.concat(n, F.lit(" "), a)


def words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: w != "")


def cleaned(n: Column, a: Column) -> dict[str, Column]:
    """Of an entity: texts without legal words."""
    return {"c": X.clean_articles(n), "d": X.clean_articles(a)}


def generic(p: DataFrame) -> DataFrame:
    """16 features of lower-cased texts."""
    n1, a1, n2, a2 = (F.trim(F.lower(F.col(c))) for c in ("n1", "a1", "n2", "a2"))
    w1, w2 = X.word_set(a1), X.word_set(a2)
    m1, m2 = (F.array_union(X.number_set(F.col(a)), X.number_set(F.col(n))) for a, n in (("a1", "n1"), ("a2", "n2")))
    out = p.withColumns({
        "name_token_sort": sim("token_sort", n1, n2), "name_partial": sim("partial", n1, n2), "name_wratio": sim("weighted", n1, n2),
        "name_ratio": sim("ratio", n1, n2), "name_token_set": sim("token_set", n1, n2), "name_len_diff": relative_length(n1, n2),
        "addr_token_set": sim("token_set", a1, a2), "addr_token_sort": sim("token_sort", a1, a2), "addr_partial": sim("partial", a1, a2),
        "addr_match_count": F.size(F.array_intersect(w1, w2)).cast("double"), "addr_jaccard": K.jaccard(w1, w2),
        "num_overlap": F.arrays_overlap(m1, m2).cast("double"), "num_jaccard": K.jaccard(m1, m2),
        "comb_token_sort": sim("token_sort", both(n1, a1), both(n2, a2)),
    })
    total = F.col("name_token_sort") + F.col("addr_token_sort")
    return out.withColumn("harmonic", F.when(total > 0, 2 * F.col("name_token_sort") * F.col("addr_token_sort") / total).otherwise(0.0)).withColumn("blocking_score", F.col("score"))


def method2(p: DataFrame) -> DataFrame:
    """12 features of texts without legal words."""
    c1, d1, c2, d2 = (F.col(c) for c in ("c1", "d1", "c2", "d2"))
    f1, f2 = X.first_token(c1), X.first_token(c2)
    return p.withColumns({
        "name_ratio": sim("ratio", c1, c2), "name_token_sort": sim("token_sort", c1, c2), "name_token_set": sim("token_set", c1, c2),
        "name_wratio": sim("weighted", c1, c2), "addr_ratio": sim("ratio", d1, d2), "addr_token_set": sim("token_set", d1, d2),
        "name_jw": sim("jaro_winkler", c1, c2, 1.0), "num_overlap": F.size(F.array_intersect(X.number_set(F.col("a1")), X.number_set(F.col("a2")))).cast("double"),
        "name_len_diff": F.abs(F.length(c1) - F.length(c2)).cast("double"), "first_token": ((f1 != "") & (f1 == f2)).cast("double"),
        "comb_token_sort": sim("token_sort", both(c1, d1), both(c2, d2)), "blocking_score": F.col("score"),
    })


def method3(p: DataFrame) -> DataFrame:
    """Those of method2 with postal code, name containment and leading number: 15."""
    p = method2(p)
    return p.withColumns({
        "postal": agreement(X.postal_first(F.col("a1")), X.postal_first(F.col("a2"))),
        "containment": K.containment(words(F.col("c1")), words(F.col("c2"))),
        "leading": agreement(X.leading_number(F.col("a1")), X.leading_number(F.col("a2"))),
    })


def method4(p: DataFrame) -> DataFrame:
    """16 features about a dense score."""
    c1, d1, c2, d2 = (F.col(c) for c in ("c1", "d1", "c2", "d2"))
    return p.withColumns({
        "dense": F.col("score"), "name_token_sort": sim("token_sort", c1, c2), "name_token_set": sim("token_set", c1, c2),
        "name_wratio": sim("weighted", c1, c2), "name_ratio": sim("ratio", c1, c2), "name_prefix": sim("ratio", F.substring(c1, 1, 20), F.substring(c2, 1, 20)),
        "name_partial": sim("partial", c1, c2), "addr_token_sort": sim("token_sort", d1, d2), "addr_token_set": sim("token_set", d1, d2),
        "addr_ratio": sim("ratio", d1, d2), "addr_wratio": sim("weighted", d1, d2), "comb_token_sort": sim("token_sort", both(c1, d1), both(c2, d2)),
        "name_len_diff": relative_length(c1, c2), "street": overlap(X.number_set(F.col("a1")), X.number_set(F.col("a2"))),
        "containment": K.containment(words(c1), words(c2)), "postal": agreement(X.postal_last(F.col("a1")), X.postal_last(F.col("a2"))),
    })


def texts5(n: Column, a: Column) -> dict[str, Column]:
    c = X.clean_articles(n)
    return cleaned(n, a) | {"numbers": X.number_set(a), "pin": X.postal_last(a), "brand": F.try_element_at(X.significant_tokens(c), F.lit(1))}


def method5(p: DataFrame) -> DataFrame:
    """18 features with edit similarity, street numbers and brand."""
    c1, d1, c2, d2, s1, s2 = (F.col(c) for c in ("c1", "d1", "c2", "d2", "numbers1", "numbers2"))
    shared = F.size(F.array_intersect(s1, s2))
    return p.withColumns(some({
        "name_token_sort": "token_sort", "name_token_set": "token_set", "name_wratio": "weighted", "name_ratio": "ratio", "name_jw": "jaro_winkler", "name_partial": "partial",
    }, c1, c2) | some({"addr_token_sort": "token_sort", "addr_token_set": "token_set", "addr_wratio": "weighted", "addr_ratio": "ratio"}, d1, d2) | {
        "blocking_score": F.col("score"), "name_levenshtein": K.levenshtein(c1, c2),
        "comb_token_sort": sim("token_sort", both(c1, d1), both(c2, d2)), "name_len_diff": relative_length(c1, c2), "pincode": agreement(F.col("pin1"), F.col("pin2")),
        "name_within": ((c1 != "") & (c2 != "") & (F.contains(c1, c2) | F.contains(c2, c1))).cast("double"),
        "street": F.when((F.size(s1) == 0) | (F.size(s2) == 0), 0.0).when(shared == 0, -1.0).otherwise(shared.cast("double")),
        "brand": F.coalesce(F.col("brand1") == F.col("brand2"), F.lit(False)).cast("double"),
    })


def texts_version1(n: Column, a: Column) -> dict[str, Column]:
    return {"c": X.name_core(X.clean_ascii(n)), "d": X.clean_ascii(a)}


def version1(p: DataFrame) -> DataFrame:
    """8 features of ASCII-cleaned texts."""
    c1, d1, c2, d2 = (F.col(c) for c in ("c1", "d1", "c2", "d2"))
    return p.withColumns({
        "name_jw": sim("jaro_winkler", c1, c2, 1.0), "name_ts": sim("token_sort", c1, c2), "addr_jw": sim("jaro_winkler", d1, d2, 1.0),
        "addr_tset": sim("token_set", d1, d2), "num_conflict": overlap(X.number_set(d1), X.number_set(d2)),
        "name_subset": ((F.length(c1) > 3) & (F.length(c2) > 3) & (F.contains(c1, c2) | F.contains(c2, c1))).cast("double"),
        "len_ratio": F.least(F.length(c1), F.length(c2)) / F.greatest(F.length(c1), F.length(c2), F.lit(1)), "blocking_score": F.col("score"),
    })


def texts_version2(n: Column, a: Column) -> dict[str, Column]:
    d = X.address_v2(a)
    return {"c": X.name_v2(n), "d": d, "numbers": X.number_text(d)}


def version2(p: DataFrame) -> DataFrame:
    """20 features: the candidate list's context, then kernels (0 to 100; Jaro-Winkler 0 to 1)."""
    group = Window.partitionBy("s1_id")
    c1, d1, c2, d2, m1, m2 = (F.col(c) for c in ("c1", "d1", "c2", "d2", "numbers1", "numbers2"))
    # Kernels come first, so that no texts are dealt anew for the windows.
    p = p.withColumns(some({"name_ratio": "ratio", "name_tsort": "token_sort", "name_tset": "token_set", "name_partial": "partial", "name_jw": "jaro_winkler"}, c1, c2, 1) | some({
        "addr_ratio": "ratio", "addr_tsort": "token_sort", "addr_tset": "token_set", "addr_partial": "partial",
    }, d1, d2, 1) | {
        "compact_ratio": sim("ratio", X.compact(c1), X.compact(c2), 1), "num_tset": sim("token_set", m1, m2, 1), "num_both": ((m1 != "") & (m2 != "")).cast("double"),
        "name1_empty": (c1 == "").cast("double"), "name2_empty": (c2 == "").cast("double"),
        "len_ratio": F.least(F.length(c1), F.length(c2)) / F.greatest(F.length(c1), F.length(c2), F.lit(1)),
    })
    return p.withColumns({
        "blocking_score": F.col("score"), "block_rank": F.row_number().over(group.orderBy(F.desc("score"), "src", "ord", "t_id")) - F.lit(1.0),
        "block_gap": F.max("score").over(group) - F.col("score"), "n_cands": F.count("*").over(group).cast("double"), "is_s2": (F.col("src") == 2).cast("double"),
    })


#: Names of each set's features, in order.
SETS = {
    "generic": (generic, ["name_token_sort", "name_partial", "name_wratio", "name_ratio", "name_token_set", "name_len_diff", "addr_token_set", "addr_token_sort", "addr_partial", "addr_match_count", "addr_jaccard", "num_overlap", "num_jaccard", "comb_token_sort", "harmonic", "blocking_score"]),
    "method2": (method2, ["name_ratio", "name_token_sort", "name_token_set", "name_wratio", "addr_ratio", "addr_token_set", "name_jw", "num_overlap", "name_len_diff", "first_token", "comb_token_sort", "blocking_score"]),
    "method3": (method3, ["name_ratio", "name_token_sort", "name_token_set", "name_wratio", "addr_ratio", "addr_token_set", "name_jw", "num_overlap", "name_len_diff", "first_token", "comb_token_sort", "postal", "containment", "leading", "blocking_score"]),
    "method4": (method4, ["dense", "name_token_sort", "name_token_set", "name_wratio", "name_ratio", "name_prefix", "name_partial", "addr_token_sort", "addr_token_set", "addr_ratio", "addr_wratio", "comb_token_sort", "name_len_diff", "street", "containment", "postal"]),
    "method5": (method5, ["blocking_score", "name_token_sort", "name_token_set", "name_wratio", "name_ratio", "name_jw", "name_levenshtein", "name_partial", "addr_token_sort", "addr_token_set", "addr_wratio", "addr_ratio", "comb_token_sort", "name_len_diff", "pincode", "name_within", "street", "brand"]),
    "version1": (version1, ["name_jw", "name_ts", "addr_jw", "addr_tset", "num_conflict", "name_subset", "len_ratio", "blocking_score"]),
    "version2": (version2, ["blocking_score", "block_rank", "block_gap", "n_cands", "is_s2", "name_ratio", "name_tsort", "name_tset", "name_partial", "name_jw", "compact_ratio", "addr_ratio", "addr_tsort", "addr_tset", "addr_partial", "num_tset", "num_both", "name1_empty", "name2_empty", "len_ratio"]),
}


#: What a set takes of each entity besides its texts.
TEXTS = {"method2": cleaned, "method3": cleaned, "method4": cleaned, "method5": texts5, "version1": texts_version1, "version2": texts_version2}


def compute(name: str, candidates: DataFrame, s1: DataFrame, pool: DataFrame, outer: bool = False) -> DataFrame:
    """candidates with the named set's features."""
    return of_sides(name, join_sides(candidates, s1, pool, outer, TEXTS.get(name)))


def of_sides(name: str, pairs: DataFrame) -> DataFrame:
    """pairs of ``join_sides`` with the named set's texts, as ``compute`` gives them."""
    make, columns = SETS[name]
    return make(pairs).select("s1_id", "t_id", "src", "ord", "score", *[F.col(c).cast("double").alias(c) if c != "score" else F.col(c) for c in columns])
