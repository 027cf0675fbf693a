"""Conflict resolution of scored(s1_id, t_id, src, score, ord): who keeps which target."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, stored


def at_least(scored: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def claims(scored: DataFrame, threshold: float, order: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """Each target goes to its best-scored claimant, at ties to the first by ``order``; an S1 may keep many.

    As only targets are exclusive, the greedy pass over all pairs by score is a row number for each target.
    """
    first = F.row_number().over(Window.partitionBy("t_id").orderBy(F.desc("score"), *order))
    won = at_least(scored, threshold).withColumn("_r", first).where("_r = 1").drop("_r")
    return won.withColumn("pos", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "t_id")))


def best_per_source(scored: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("s1_id", "src").orderBy(F.desc("score"), "ord", "t_id"))
    return scored.withColumn("_r", r).where("_r = 1").drop("_r")


def single_claims(scored: DataFrame, threshold: float, order: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """Of each S1's best target a source; contested ones to the higher score, and the loser gets no other."""
    return claims(best_per_source(at_least(scored, threshold)), threshold, order)


def optimum(weights: list) -> list[int]:
    """The column of each row (-1: none): as many pairs as possible, then the largest total.

    ``weights[i]`` has row i's edges, as a list with None where there is none, or as a dictionary by column.

    Successive cheapest augmenting paths over the edges alone (a queue of rows whose cost has fallen): the pairs placed so
    far are the best of their number, so the last are the best of the largest number.
    """
    weights = [w if isinstance(w, dict) else {j: x for j, x in enumerate(w) if x is not None} for w in weights]
    column, owner = [-1] * len(weights), {}
    while True:
        cost = {i: 0.0 for i, j in enumerate(column) if j < 0 and weights[i]}
        came, queue, waits = {}, deque(cost), set(cost)
        while queue:
            i = queue.popleft()
            waits.discard(i)
            for j, w in weights[i].items():
                to = cost[i] - w
                if column[i] != j and (j not in came or to < came[j][0] - 1e-12):
                    came[j] = (to, i)
                    k = owner.get(j)
                    if k is not None:
                        cost[k] = to + weights[k][j]
                        if k not in waits:
                            waits.add(k)
                            queue.append(k)
        free = [(to, j) for j, (to, _) in came.items() if j not in owner]
        if not free:
            return column
        j = min(free)[1]
        while j >= 0:
            i = came[j][1]
            owner[j], column[i], j = i, j, column[i]


def optimal_claims(scored: DataFrame, threshold: float) -> DataFrame:
    """Targets of one claimant go to it; contested ones by an optimal assignment, at most one of them an S1; what is left
    goes to its best S1. Each connected group of contested claims is solved on its own, from its edges alone; a group is
    one task's, so its claims must fit one.
    """
    held = stored(at_least(scored, threshold).select("s1_id", "t_id", "score"))
    n = held.groupBy("t_id").agg(F.count("*").alias("n"))
    marked = held.join(n, "t_id")
    alone, open_ = marked.where("n = 1").select("s1_id", "t_id", "score"), stored(marked.where("n > 1").select("s1_id", "t_id", "score"))
    # S1 and target ids are told apart by what is put before them.
    edges = open_.select(F.concat(F.lit("s"), "s1_id").alias("a"), F.concat(F.lit("t"), "t_id").alias("b"))
    group = connected_components(edges).where("node like 's%'").select(F.substring("node", 2, 1 << 30).alias("s1_id"), "component")
    grouped = open_.join(group, "s1_id")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(f.s1_id)), sorted(set(f.t_id))
        at, to = {x: i for i, x in enumerate(rows)}, {x: j for j, x in enumerate(cols)}
        w: list[dict[int, float]] = [{} for _ in rows]
        best: dict[int, tuple] = {}
        for s, t, x in sorted(zip(f.s1_id, f.t_id, f.score, strict=True)):
            i, j = at[s], to[t]
            w[i][j] = x
            if j not in best or x > best[j][0]:
                best[j] = (x, i)
        got = {j: i for i, j in enumerate(optimum(w)) if j >= 0}
        out = [(rows[got.get(j, best[j][1])], t, w[got.get(j, best[j][1])][j]) for j, t in enumerate(cols)]
        return pd.DataFrame(out, columns=["s1_id", "t_id", "score"])

    won = alone.unionByName(grouped.groupBy("component").applyInPandas(solve, "s1_id string, t_id string, score double"))
    return won.withColumn("pos", F.row_number().over(Window.partitionBy("s1_id").orderBy("t_id")))


def fill(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """(s1_id, matches) for every S1, an empty array where none."""
    lists = matches.groupBy("s1_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, t_id))), x -> x.t_id)").alias("matches"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select("s1_id", F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))
