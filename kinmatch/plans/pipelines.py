"""Whole linkage plans: S1 and pool entities in, candidates, scored pairs and matches out. All are lazy but training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.kernels import once, trigram_cosine_of_batches
from ..operators import assign, blocking, features, learn, metrics, scoring
from ..operators.graph import stored


@dataclass(frozen=True)
class Linkage:
    """candidates(s1_id, t_id, src, ord, score, rank), scored pairs, and matches(s1_id, t_id, score, pos)."""

    candidates: DataFrame
    scored: DataFrame
    matches: DataFrame


def ranked_by_s1(scored: DataFrame, s1: DataFrame) -> DataFrame:
    """Adds the place of the S1 row, which breaks ties between claimants."""
    return scored.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("ord").alias("s1_ord")), "s1_id")


def trained(name: str, candidates: DataFrame, s1: DataFrame, pool: DataFrame, truth: DataFrame, train: DataFrame, outer: bool = False, **how) -> DataFrame:
    """Probabilities of all candidates from a model fitted on the pairs of train(s1_id)."""
    rows = stored(features.compute(name, candidates, s1, pool, outer))  # read for each pass of the fit and for the scores
    columns = features.SETS[name][1]
    size = dict(zip(("trees", "step", "depth"), learn.SIZES.get(name, ()), strict=False))
    how = size | how
    model = learn.fit(features.with_labels(rows, truth).join(train.select("s1_id"), "s1_id", "left_semi"), columns, **how)
    return learn.predict(model, rows.drop("score"))


def minimum(s1: DataFrame, pool: DataFrame, threshold: float = 0.5, most: int = 50, texts=None) -> Linkage:
    """Pairs of a common word of the cleaned names, trigram score, greedy claims.

    Words that more than ``most`` targets of a country and source have are no keys: a word of all names would pair all.
    With ``texts`` of ``features.join_sides``, scored pairs keep them, so that features need no joins of their own.
    """
    keys = F.split(X.clean_legal("name"), " ")
    # Dealt by S1 once: for the distinct pairs and for the join with S1.
    c = blocking.key_pairs(s1, pool, keys, drop_over=most).select("s1_id", "t_id", "src", "ord").repartition("s1_id").distinct()
    # Texts are cleaned once an entity, not once a pair.
    legal = lambda n, a: {"legal_n": X.clean_legal(n), "legal_a": X.clean_legal(a)} | (texts(n, a) if texts else {})
    p = features.join_sides(c, s1.withColumnRenamed("ord", "s1_ord"), pool, texts=legal, keep=("s1_ord",))
    cosine = lambda k: trigram_cosine_of_batches(F.col(f"legal_{k}1"), F.col(f"legal_{k}2"))
    p = p.withColumn("score", once(F.round(0.65 * cosine("n") + 0.35 * cosine("a"), 6)))
    scored = p.drop(*(f"legal_{k}{n}" for k in "na" for n in (1, 2))) if texts else p.select("s1_id", "t_id", "src", "ord", "score", "s1_ord")
    return Linkage(c, scored, assign.claims(scored.select("s1_id", "t_id", "src", "ord", "score", "s1_ord"), threshold, ("s1_ord",)))


def method1(s1: DataFrame, pool: DataFrame, threshold: float = 0.7) -> Linkage:
    """TF-IDF candidates, trigram score, threshold alone."""
    c = blocking.tfidf_topk(s1, pool)
    p = features.join_sides(c.drop("score"), s1, pool)
    scored = p.select("s1_id", "t_id", "src", "ord", once(F.round(scoring.trigram_score(*(F.col(x) for x in ("n1", "a1", "n2", "a2"))), 6)).alias("score"))
    return Linkage(c, scored, assign.at_least(scored, threshold))


def method2(s1: DataFrame, pool: DataFrame, truth: DataFrame, train: DataFrame, threshold: float = 0.93, **how) -> Linkage:
    c = blocking.union_blocking(s1, pool)
    scored = trained("method2", c, s1, pool, truth, train, **how)
    return Linkage(c, scored, assign.at_least(scored, threshold))


def method3(s1: DataFrame, pool: DataFrame, truth: DataFrame, train: DataFrame, threshold: float = 0.7, **how) -> Linkage:
    c = blocking.dual_index(s1, pool)
    scored = ranked_by_s1(trained("method3", c, s1, pool, truth, train, **how), s1)
    return Linkage(c, scored, assign.claims(scored, threshold, ("s1_ord", "ord")))


def method4(s1: DataFrame, pool: DataFrame, queries: DataFrame, vectors: DataFrame, truth: DataFrame, train: DataFrame, threshold: float = 0.7, **how) -> Linkage:
    """Dense candidates from given vectors."""
    c = blocking.nearest(queries, vectors, 3)
    scored = ranked_by_s1(trained("method4", c, s1, pool, truth, train, True, **how), s1)
    return Linkage(c, scored, assign.claims(scored, threshold, ("s1_ord", "ord")))


def method5(s1: DataFrame, pool: DataFrame, truth: DataFrame, train: DataFrame, threshold: float = 0.7, block: int = 8192, **how) -> Linkage:
    """Cascade candidates and an optimal assignment; long texts take smaller blocks."""
    c = blocking.cascade(s1, pool, block=block).repartition(96, "s1_id")  # a fixed number: few pairs of long texts are many tasks' work
    scored = trained("method5", c, s1, pool, truth, train, **how)
    return Linkage(c, scored, assign.optimal_claims(scored, threshold))


def version1(s1: DataFrame, pool: DataFrame, queries: DataFrame, vectors: DataFrame, truth: DataFrame, threshold: float = 0.5, k: int = 10, **how) -> Linkage:
    """Dense candidates over one pool, eight features, an ensemble fitted across countries, a strict threshold."""
    c = blocking.nearest(queries, vectors.withColumn("src", F.lit(0)), k).drop("src")
    c = c.join(pool.select(F.col("entity_id").alias("t_id"), "src"), "t_id")
    rows = features.with_labels(features.compute("version1", c, s1, pool), truth).join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    rows = stored(rows)  # read for each pass of each fold's fit and for the scores
    models, _ = learn.cross_fit(rows, features.SETS["version1"][1], **how)
    scored = learn.ensemble(models, rows)
    return Linkage(c, scored, assign.at_least(scored, threshold, True))


def version2(s1: DataFrame, pool: DataFrame, truth: DataFrame, train: DataFrame, threshold: float = 0.5, k: int = 15, max_df: int = 3000, **how) -> Linkage:
    """Sparse candidates, 20 features, boosted trees, a strict threshold."""
    c = blocking.sparse(s1, pool, k, max_df).drop("src").join(pool.select(F.col("entity_id").alias("t_id"), "src"), "t_id")
    scored = trained("version2", c, s1, pool, truth, train, **how)
    return Linkage(c, scored, assign.at_least(scored, threshold, True))


def champion(s1: DataFrame, pool: DataFrame, threshold: float = 0.8, k: int = 15, max_df: int = 3000) -> Linkage:
    """Sparse candidates, 20 features, weighted score, greedy claims; no training."""
    c = blocking.sparse(s1, pool, k, max_df).drop("src").join(pool.select(F.col("entity_id").alias("t_id"), "src"), "t_id")
    scored = features.compute("version2", c, s1, pool).withColumn("score", F.round(scoring.weighted_score(), 6))
    scored = ranked_by_s1(scored, s1)
    return Linkage(c, scored, assign.claims(scored, threshold, ("s1_ord", "ord")))


def production(s1: DataFrame, pool: DataFrame, threshold: float = 0.92, bucket: int = 40, k: int = 5) -> Linkage:
    """Key candidates, gated rule score, the best of each source, single claims."""
    c = blocking.key_blocking(s1, pool, bucket, k)
    scored = scoring.gated_score(features.join_sides(c.drop("score"), s1, pool)).select("s1_id", "t_id", "src", "ord", F.round("rule_score", 6).alias("score"))
    scored = ranked_by_s1(scored, s1)
    return Linkage(c, scored, assign.single_claims(scored, threshold, ("s1_ord",)))


def configurations(s1: DataFrame, pool: DataFrame, truth: DataFrame, counts: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Scores of production pairs without resolution, with the best of each source, and with claims."""
    link = production(s1, pool, threshold)
    held = assign.at_least(link.scored, threshold)
    parts = {"threshold": held, "best_per_source": assign.best_per_source(held), "claims": link.matches}
    out = None
    for name, m in parts.items():
        row = metrics.pair_summary(metrics.entity_scores(truth, counts, m.select("s1_id", "t_id"))).withColumn("configuration", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
