"""Quality rules: a learned decision list over text statistics, as ordered Spark conditional expressions.

The statistics are built-in expressions over whole texts. The list is learned by sequential covering: a rule grows one
threshold at a time by FOIL gain on two thirds of the labelled rows, is pruned on the last third, and is kept while it
rejects with at least ``precision`` there; the rows it covers are taken out and the next rule is grown. Labelled rows are
a bounded sample: the ``most_labels`` labels of least hashed id. Statistics and verdicts cover every row.

Null text has no words. A text is rejected by the base rule if it has under 10 words or over 20 % of its words lie in
repeated windows. Without usable labels there are no learned rules. Every row gives a row, also repeated ones. A label that
is null is no label; a row labelled twice counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def add_statistics(df: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a struct of figures for rules, ``stats``.

    Columns of df with these names give way to them; all others go through as they are.

    Repeated windows: each window's hash, its low bits replaced by its place, is one long; a primitive sort puts equal
    windows side by side, where the words themselves are compared. If unlike windows have met there, which few texts
    see, the windows of that text are sorted by their words instead. The places found twice are merged as intervals.
    """
    rest = [c for c in df.columns if c not in (*RESULTS, "stats")]
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row") if rest else F.lit(0).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", f"[{BLANK}]+", -1), ""))
    df = df.withColumn("_n", F.size("_w").cast("long"))
    # Bits for places: as many as the number of words needs.
    df = df.withColumn("_m", F.expr("shiftleft(1L, length(bin(_n))) - 1"))
    words = ", ".join(f"_w[i + {j}]" for j in range(window))
    df = df.withColumn("_k", F.expr(f"if(_n < {window}, array(), sort_array(transform(sequence(0, cast(_n as int) - {window}), i -> (xxhash64({words}) & ~_m) | i)))").cast("array<long>"))

    def alike(a: str, b: str) -> str:
        return f"(({a}) & ~_m) = (({b}) & ~_m)"

    def equal(a: str, b: str) -> str:
        return f"slice(_w, cast(({a}) & _m as int) + 1, {window}) = slice(_w, cast(({b}) & _m as int) + 1, {window})"

    def same(a: str, b: str) -> str:
        return f"{alike(a, b)} and {equal(a, b)}"

    fast = f"sort_array(transform(filter(_k, (x, i) -> (i > 0 and {same('x', '_k[i - 1]')}) or (i < size(_k) - 1 and {same('x', '_k[i + 1]')})), x -> x & _m))"
    mixed = f"size(filter(_k, (x, i) -> i > 0 and {alike('x', '_k[i - 1]')} and not {equal('x', '_k[i - 1]')})) > 0"
    sure = f"transform(array(sort_array(transform(_k, x -> named_struct('s', slice(_w, cast(x & _m as int) + 1, {window}), 'i', x & _m)))), q -> sort_array(transform(filter(q, (x, i) -> (i > 0 and x.s = q[i - 1].s) or (i < size(q) - 1 and x.s = q[i + 1].s)), x -> x.i)))[0]"
    df = df.withColumn("_p", F.expr(f"if({mixed}, {sure}, {fast})"))
    repeat = F.expr(f"if(size(_p) = 0, 0L, aggregate(_p, named_struct('n', 0L, 'to', 0L), (s, p) -> named_struct('n', s.n + p + {window}L - greatest(p, s.to), 'to', p + {window}L), s -> s.n))")
    lines = F.expr(f"sort_array(filter(split({'_t'}, '\\n', -1), l -> l rlike '[^{BLANK}]'))".replace("'[^", "r'[^"))
    df = df.withColumn("_l", lines)
    df = df.withColumns({
        "n_words": F.col("_n"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.expr("cast(size(filter(_l, (x, i) -> i > 0 and x = _l[i - 1])) as long)"),
        "n_repeat_words": repeat.cast("long"),
        "_upper": F.regexp_count("_t", F.lit(r"[A-ZÀ-Þ]")),
        "_bang": F.regexp_count("_t", F.lit(r"[!?]")),
        "_digit": F.regexp_count("_t", F.lit("[0-9]")),
        "_lines": F.size("_l"),
    })
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    figures = {
        "symbol_share": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "upper_share": F.col("_upper") / chars,
        "mark_share": F.col("_bang") / n,
        "digit_share": F.col("_digit") / chars,
    }
    made = F.struct(*RESULTS, F.struct(*(c.alias(k) for k, c in figures.items())).alias("stats"))
    # One row out for one in; a filter on a statistic is not pushed through, where it would be worked out again in each lambda.
    df = df.select("_row", F.explode(F.array(made)).alias("_s"))
    return df.select(*(F.col(f"_row.`{c}`") for c in rest), "_s.*")


@dataclass(frozen=True)
class Condition:
    """figure >= threshold, or below it."""

    figure: str
    above: bool
    threshold: float

    def __call__(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.figure] >= self.threshold if self.above else x[self.figure] < self.threshold

    def column(self, stats: str) -> Column:
        c = F.col(f"{stats}.{self.figure}")
        return c >= self.threshold if self.above else c < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: dict[str, np.ndarray], most: int) -> Rule:
    """Adds the condition of the largest FOIL gain until no good row is covered."""
    rule: tuple[Condition, ...] = ()
    held = np.ones(len(bad), bool)
    while len(rule) < most and (held & ~bad).any():
        p, n = (held & bad).sum(), (held & ~bad).sum()
        best, gain = None, 1e-9
        for name, cuts in thresholds.items():
            for t in cuts:
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    now = held & c(x)
                    q, m = (now & bad).sum(), (now & ~bad).sum()
                    if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule += (best,)
        held &= best(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule of the best (bad - good) / (bad + good) on rows it was not grown on."""

    def worth(r: Rule) -> float:
        held = covers(r, x, len(bad))
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, most_rules: int = 12, most_conditions: int = 3, cuts: int = 40, seed: int = 5) -> list[Rule]:
    """Ordered rules that reject; each rejects with at least ``precision`` on rows held out from its growth."""
    order = np.random.RandomState(seed).permutation(len(bad))
    left, rules = order, []
    while len(rules) < most_rules:
        a, b = left[: len(left) * 2 // 3], left[len(left) * 2 // 3 :]
        if bad[a].sum() < 5 or bad[b].sum() < 2:
            break
        xa, xb = ({k: v[part] for k, v in x.items()} for part in (a, b))
        thresholds = {k: np.unique(np.quantile(v, np.linspace(0.01, 0.99, cuts))) for k, v in xa.items()}
        hard = {k: np.unique(np.quantile(v[bad[a]], np.linspace(0.05, 0.95, cuts // 2))) for k, v in xa.items()}
        rule = prune(grow(xa, bad[a], {k: np.unique(np.concatenate([v, hard[k]])) for k, v in thresholds.items()}, most_conditions), xb, bad[b])
        held = covers(rule, xb, len(b)) if rule else np.zeros(len(b), bool)
        if held.sum() < 2 or (held & bad[b]).sum() < precision * held.sum():
            break
        rules.append(rule)
        left = left[~covers(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def fit(df: DataFrame, labels: DataFrame, most_labels: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> list[Rule]:
    """Rules from at most ``most_labels`` labelled rows of df; label 0 is bad."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most_labels)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = add_statistics(texts.join(F.broadcast(some), "_id")).select("_id", "_y", "stats.*").collect()  # most_labels rows of ids at most are broadcast
    if not rows:
        return []
    rows.sort(key=tuple)  # one result for one table, whatever the order of its files
    names = [n for n in rows[0].asDict() if n not in ("_id", "_y")]
    x = {n: np.array([r[n] for r in rows], float) for n in names}
    return learn_rules(x, np.array([r["_y"] == 0 for r in rows]), **how)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """The rules in order as one conditional expression: false where the first rule that holds rejects, else true."""
    out = None
    for rule in rules:
        hold = F.lit(True)
        for c in rule:
            hold = hold & c.column(stats)
        out = F.when(hold, F.lit(False)) if out is None else out.when(hold, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(df: DataFrame, rules: list[Rule], text_col: str = "text", least_words: int = 10, most_repeat: int = 20) -> DataFrame:
    """df with its statistics, base_failed and kept; columns of df with these names give way to them."""
    out = add_statistics(df.drop("base_failed", "kept"), text_col)
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(most_repeat) * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)).drop("stats")


def keep(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with all their columns as they are."""
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"))
    return judge(whole, rules).where("kept").select("row.*")
