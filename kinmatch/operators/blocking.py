"""Candidate generation within countries. All give candidates(s1_id, t_id, src, score, rank), ranks from 1.

Every ranking is by score, rounded to six places, then by the target's order; ``src`` and ``country`` are join keys.
Inputs are entities(entity_id, src, country, name, addr, ord): S1 on one side, the pool of S2 and S3 on the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from . import terms as T
from .graph import stored


def docs(entities: DataFrame, text: Column, one_pool: bool = False) -> DataFrame:
    src = F.lit(0) if one_pool else F.col("src")
    return entities.select("country", src.alias("src"), F.col("entity_id").alias("id"), "ord", text.alias("text"))


def top(pairs: DataFrame, k: int, by: tuple[str, ...] = ("s1_id", "src")) -> DataFrame:
    """The k best of each group by score, then ord."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "src", "ord", "t_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def product(q: DataFrame, p: DataFrame, min_score: float) -> DataFrame:
    """(country, s1_id, t_id, src, ord, score): sums of weight products over common terms."""
    q = q.select("country", "src", "term", F.col("id").alias("s1_id"), F.col("w").alias("wq"))
    p = p.select("country", "src", "term", F.col("id").alias("t_id"), "ord", F.col("w").alias("wp"))
    out = q.join(p, ["country", "src", "term"]).groupBy("country", "src", "s1_id", "t_id", "ord").agg(F.round(F.sum(F.col("wq") * F.col("wp")), 6).alias("score"))
    return out.where(F.col("score") >= min_score)


def tfidf_pairs(s1: DataFrame, pool: DataFrame, text: Column, terms=T.char_wb, min_score: float = 0.05, sublinear: bool = True, max_features: int | None = 100_000) -> DataFrame:
    """Cosine of pairs with a common term; the vocabulary is that of each (country, source) of the pool."""
    pd_, qd = docs(pool, text), docs(s1, text)
    tf = T.frequencies(pd_, terms(F.col("text")))
    vocab = T.vocabulary(tf, pd_, 2, None, max_features)
    # Each query is weighed once for each source of the pool, by that source's vocabulary.
    qtf = T.frequencies(qd, terms(F.col("text"))).drop("src")
    return product(T.weights(qtf, vocab, sublinear, ("country", "term")), T.weights(tf, vocab, sublinear), min_score)


def merged(entities: DataFrame, text: Column, group: list[str]) -> DataFrame:
    """(*group, id, ord, texts): rows that share id and ord are one text."""
    d = entities.where("country is not null").select(*group, F.col("entity_id").alias("id"), "ord", text.alias("text"))
    return d.groupBy(*group, "id", "ord").agg(F.collect_list("text").alias("texts"))


def terms_of(texts: str, terms) -> Column:
    return F.flatten(F.transform(texts, terms))


def block_vocabulary(p: DataFrame, max_features: int | None, max_df: int | None = None) -> DataFrame:
    """(country, src, terms, idf) of merged texts: like ``terms.vocabulary``, a row for about 65,536 terms of a country and source."""
    once = K.let(F.sort_array("terms"), lambda s: F.transform(s, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (t != F.get(s, i - 1))).cast("int").alias("new"))))
    df = p.select("country", "src", F.explode(once).alias("t")).groupBy("country", "src", "t.term").agg(F.sum("t.new").alias("df"), F.count("*").alias("total")).where("df >= 2")
    df = df.where(F.col("df") <= max_df) if max_df is not None else df
    if max_features is not None:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy("country", "src").orderBy(F.desc("total"), "term"))).where(F.col("_r") <= max_features)
    n = p.groupBy("country", "src").agg(F.count_distinct("id").alias("n"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    part = F.pmod(F.xxhash64("term"), F.ceil(F.col("n") / 16384)).alias("part")  # so that a row stays small; a text has a few terms of its own
    entry = df.join(n, ["country", "src"]).select("country", "src", part, F.struct("term", idf.alias("idf")).alias("e")).groupBy("country", "src", "part").agg(F.collect_list("e").alias("e"))
    return entry.select("country", "src", F.col("e.term").alias("terms"), F.col("e.idf").alias("idf"))


class Postings:
    """Texts of a block by a vocabulary: rows (id, ord), and for each term the rows that have it with their weights."""

    def __init__(self, t: pa.Table, vocab: pa.Array, idf: np.ndarray, sublinear: bool):
        self.ids, self.ords = t.column("id").to_pylist(), t.column("ord").to_numpy()
        lists = t.column("terms").combine_chunks()
        code = pc.index_in(lists.flatten(), vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        n = max(1, len(lists))
        key, tf = np.unique((code * n + row)[code >= 0], return_counts=True)
        self.term, self.row = key // n, key % n
        w = (1.0 + np.log(tf) if sublinear else tf) * idf[self.term]
        ids = pd.factorize(np.array(self.ids, dtype=object))[0][self.row]  # of length one for each id
        self.w = w / np.sqrt(np.bincount(ids, w * w))[ids]
        self.begin = np.searchsorted(self.term, np.arange(len(idf) + 1))


def block_scores(q: Postings, p: Postings, low: int, high: int) -> np.ndarray:
    """Products of rows [low, high) of q with all rows of p. Terms that many of both have go as matrices, others by their rows."""
    n, out = len(p.ids), np.zeros((high - low, len(p.ids)))
    count, held, dense = np.diff(p.begin), (q.row >= low) & (q.row < high), []
    term, row, w = q.term[held], q.row[held] - low, q.w[held]
    own, first = np.unique(term, return_index=True)
    for t, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(term)], strict=True):
        if not count[t]:
            continue
        if (b - a) * count[t] * 20 > (high - low) * n:
            dense.append((t, a, b))
            continue
        at = slice(p.begin[t], p.begin[t + 1])
        if b - a == 1:
            out[row[a], p.row[at]] += w[a] * p.w[at]
        else:
            out[np.ix_(row[a:b], p.row[at])] += np.outer(w[a:b], p.w[at])
    for k in range(0, len(dense), 256):
        some = dense[k : k + 256]
        x, y = np.zeros((high - low, len(some))), np.zeros((len(some), n))
        for j, (t, a, b) in enumerate(some):
            x[row[a:b], j] = w[a:b]
            y[j, p.row[p.begin[t] : p.begin[t + 1]]] = p.w[p.begin[t] : p.begin[t + 1]]
        out += x @ y
    return out


def best_of_block(q: Postings, p: Postings, src: int, k: int, min_score: float, slice_: int = 256) -> Iterator[pa.Table]:
    """(s1_id, t_id, src, ord, score) of the k best of p for each row of q, by the rounded score, then ord and id."""
    place = np.lexsort((np.array(p.ids, dtype=object).astype(str), p.ords))  # the order of equal scores
    rank = np.argsort(place)
    for low in range(0, len(q.ids), slice_):
        high = min(len(q.ids), low + slice_)
        s = block_scores(q, p, low, high)
        least = np.full(high - low, min_score)
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
        i, j = np.nonzero(s >= least[:, None] - 1e-6)  # all that may be among the k best once rounded
        score = np.round(s[i, j], 6)
        keep = score >= max(min_score, 1e-12)
        i, j, score = i[keep], j[keep], score[keep]
        order = np.lexsort((rank[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = i[nth < k], j[nth < k], score[nth < k]
        yield pa.table([pa.array([q.ids[x + low] for x in i.tolist()], pa.string()), pa.array([p.ids[x] for x in j.tolist()], pa.string()), pa.array(np.full(len(i), src, np.int32)), pa.array(p.ords[j]), pa.array(score)], names=["s1_id", "t_id", "src", "ord", "score"])


def best_by_products(q: Postings, p: Postings, src: int, k: int, min_score: float, most: int = 1 << 21) -> Iterator[pa.Table]:
    """Like ``best_of_block``, by the products of common terms alone, where terms are rare: time and room go with their number.

    About ``most`` products are held at once. Rows of q of one id are one query.
    """
    if not len(q.term) or not len(p.term):
        return
    who, names = pd.factorize(np.array(q.ids, dtype=object))
    order = np.argsort(who[q.row], kind="stable")
    who, term, w = who[q.row][order], q.term[order], q.w[order]
    many = p.begin[term + 1] - p.begin[term]
    ends, n = np.cumsum(many), len(p.ids)
    place = np.lexsort((np.array(p.ids, dtype=object).astype(str), p.ords))  # the order of equal scores
    rank = np.argsort(place)
    last = np.flatnonzero(np.append(who[1:] != who[:-1], True)) + 1  # where a query's entries end
    low, done = 0, 0
    while low < len(who):
        cut = np.searchsorted(ends[last - 1], done + most, "right")
        high = int(last[min(max(cut - 1, np.searchsorted(last, low, "right")), len(last) - 1)])
        size, total = many[low:high], int(ends[high - 1]) - done
        if total:
            at = np.arange(total) + np.repeat(p.begin[term[low:high]] - (ends[low:high] - size - done), size)
            pair = np.repeat(who[low:high] * n, size) + p.row[at]
            product = np.repeat(w[low:high], size) * p.w[at]
            sort = np.argsort(pair)
            pair = pair[sort]
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            score = np.round(np.add.reduceat(product[sort], first), 6)
            keep = score >= max(min_score, 1e-12)
            (i, j), score = np.divmod(pair[first][keep], n), score[keep]
            best = np.lexsort((rank[j], -score, i))
            i, j, score = i[best], j[best], score[best]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, score = i[nth < k], j[nth < k], score[nth < k]
            yield pa.table([pa.array(names[i].tolist(), pa.string()), pa.array([p.ids[x] for x in j.tolist()], pa.string()), pa.array(np.full(len(i), src, np.int32)), pa.array(p.ords[j]), pa.array(score)], names=["s1_id", "t_id", "src", "ord", "score"])
        low, done = high, int(ends[high - 1])


def tfidf_best(s1: DataFrame, pool: DataFrame, text: Column, k: int, terms=T.char_wb, min_score: float = 0.05, sublinear: bool = True, max_features: int | None = 100_000, block: int = 8192, max_df: int | None = None) -> DataFrame:
    """``top(tfidf_pairs(...), k)`` for a min_score above 0: the k best of each source, without a table of all pairs.

    Texts stay rows, and are dealt in blocks of about ``block`` to pairs of blocks of a country and source; each pair of
    blocks gives its k best for each query, and the best of those stay. Each block comes with its source's vocabulary.

    With ``max_df`` the pool is one, for ``sparse``: the vocabulary is that of both sides, without terms that more rows have,
    and the k best are those of an S1.
    """
    q = merged(s1, text, ["country"])
    one = max_df is not None
    pool = pool.withColumn("src", F.lit(0)) if one else pool
    p = merged(pool, text, ["country", "src"])
    blocks = lambda e, group, name: e.where("country is not null").groupBy(*group).agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    n_q, n_p = blocks(s1, ["country"], "n_q"), blocks(pool, ["country", "src"], "n_p")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n))  # noqa: E731  rows of one id are in one block
    by, none = ["country", "src", "q_block", "p_block"], F.lit(None).cast("array<double>").alias("idf")
    left = q.join(n_q, "country").join(n_p, "country").select("country", "src", of("n_q").alias("q_block"), number("n_p").alias("p_block"), "id", "ord", "texts", F.lit(None).cast("array<string>").alias("terms"), none)
    words = p.unionByName(q.withColumn("src", F.lit(0))) if one else p
    vocab = block_vocabulary(words.withColumn("terms", terms_of("texts", terms)), max_features, max_df).join(n_q, "country").join(n_p, ["country", "src"])
    vocab = vocab.withColumn("q_block", number("n_q")).select("country", "src", "q_block", number("n_p").alias("p_block"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("array<string>").alias("texts"), "terms", "idf")
    right = p.join(n_q, "country").join(n_p, ["country", "src"]).select("country", "src", number("n_q").alias("q_block"), of("n_p").alias("p_block"), "id", "ord", "texts")
    # Texts are dealt to the blocks, and their terms, which take several times the room, are made there.
    left = left.unionByName(vocab).repartition(*by).select(*by, "id", "ord", F.coalesce("terms", terms_of("texts", terms)).alias("terms"), "idf")
    right = right.repartition(*by).select(*by, "id", "ord", terms_of("texts", terms).alias("terms"))

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        words = a.filter(pc.is_valid(a.column("idf")))
        found = []
        if words.num_rows and a.num_rows > words.num_rows and b.num_rows:
            terms, idf = (words.column(c).combine_chunks().flatten() for c in ("terms", "idf"))
            args = (terms, idf.to_numpy(), sublinear)
            best = best_by_products if one else best_of_block
            found = list(best(Postings(a.filter(pc.is_null(a.column("idf"))), *args), Postings(b, *args), key[1].as_py(), k, min_score))
        none = pa.schema([("s1_id", pa.string()), ("t_id", pa.string()), ("src", pa.int32()), ("ord", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([none.empty_table(), *found])

    anew = lambda df: df.toDF(*df.columns).groupBy(*by)  # noqa: E731  columns of its own: both sides come from the pool
    best = anew(left).cogroup(anew(right)).applyInArrow(meet, "s1_id string, t_id string, src int, ord long, score double")
    return top(best, k, ("s1_id",) if one else ("s1_id", "src"))


def tfidf_topk(s1: DataFrame, pool: DataFrame, k: int = 3, min_score: float = 0.05) -> DataFrame:
    """Character trigrams of name and address: the k best of each source."""
    text = X.composite(X.clean_legal("name"), X.clean_legal("addr"))
    return tfidf_best(s1, pool, text, k, min_score=min_score)


def heavy_name() -> Column:
    name = X.clean_articles("name")
    return X.composite(name, X.clean_articles("addr"), 2)


def keyed(entities: DataFrame, keys: Column, per_src: bool = True) -> DataFrame:
    """(country, src, key, id, ord), a row for each distinct key that is not empty."""
    return entities.select("country", "src", F.explode(F.array_distinct(keys)).alias("key"), F.col("entity_id").alias("id"), "ord").where("key <> ''")


def key_pairs(s1: DataFrame, pool: DataFrame, keys: Column, keep_first: int | None = None, drop_over: int | None = None) -> DataFrame:
    """(country, key, s1_id, t_id, src, ord): pairs of a common key; large buckets are cut to their first or dropped."""
    p, by = keyed(pool, keys), ("country", "src", "key")
    if keep_first is not None:
        p = p.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "id"))).where(F.col("_r") <= keep_first).drop("_r")
    if drop_over is not None:
        small = p.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") <= drop_over).drop("_n")
        p = p.join(small, list(by), "left_semi")
    q = keyed(s1, keys).select("country", "key", F.col("id").alias("s1_id"))
    return q.join(p.withColumnRenamed("id", "t_id"), ["country", "key"])


def prefix_key() -> Column:
    """First five letters of the first two words, or six of a single one."""
    w = F.split(X.clean_articles("name"), " ")
    first, second = F.element_at(w, 1), F.try_element_at(w, F.lit(2))
    return F.array(F.when(first == "", "").when(second.isNotNull(), F.concat_ws("_", F.substring(first, 1, 5), F.substring(second, 1, 5))).otherwise(F.substring(first, 1, 6)))


def union_blocking(s1: DataFrame, pool: DataFrame, per_source: int = 3, most: int = 5) -> DataFrame:
    """TF-IDF with the name twice, joined by prefix-key hits at 0.5 where TF-IDF gave none; ``most`` for each S1."""
    a = tfidf_best(s1, pool, heavy_name(), per_source).select("s1_id", "t_id", "src", "ord", "score")
    b = key_pairs(s1, pool, prefix_key(), keep_first=5).select("s1_id", "t_id", "src", "ord").distinct()
    both = a.withColumnRenamed("score", "cosine").join(b.withColumn("hit", F.lit(0.5)), ["s1_id", "t_id", "src", "ord"], "full")
    return top(both.select("s1_id", "t_id", "src", "ord", F.coalesce("cosine", "hit").alias("score")), most, ("s1_id",))


def shingles() -> Column:
    w = F.filter(F.split(X.clean_articles(X.composite(X.text("name"), X.text("addr"))), " "), lambda x: x != "")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def best_by_jaccard(a: pa.Table, b: pa.Table, cuts: pa.Table, src: int, k: int, min_score: float, most: int = 1 << 21) -> Iterator[pa.Table]:
    """(s1_id, t_id, src, ord, score) of the k best rows of b for each of a: common keys by the union of both rows' keys.

    Common keys count in rows up to the one (ord, id) that cuts(keys, ord, id) names. About ``most`` of them are held at once.
    """
    lists = [t.column("keys").combine_chunks() for t in (a, b, cuts)]
    codes = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    own, theirs, limits = np.split(codes, np.cumsum([int(x.sum()) for x in sizes])[:2])
    ids, ords, n = b.column("id").to_pylist(), b.column("ord").to_numpy(), b.num_rows
    row = np.repeat(np.arange(n), sizes[1])
    last, last_id = np.full(int(codes.max(initial=0)) + 1, np.iinfo(np.int64).max), dict(zip(limits.tolist(), cuts.column("id").to_pylist(), strict=True))
    last[limits] = cuts.column("ord").to_numpy()
    held = ords[row] <= last[theirs]
    for at in np.flatnonzero(ords[row] == last[theirs]).tolist():
        held[at] = int(theirs[at]) not in last_id or ids[row[at]] <= last_id[int(theirs[at])]
    passed = np.unique(row[~held] * len(last) + theirs[~held])  # what a row has and does not count
    limited = np.isin(own, limits)
    cut_own, cut_many = own[limited], np.bincount(np.repeat(np.arange(a.num_rows), sizes[0])[limited], minlength=a.num_rows)
    cut_begin = np.concatenate([[0], np.cumsum(cut_many)])
    order = np.argsort(theirs[held], kind="stable")
    row, theirs = row[held][order], theirs[held][order]
    begin = np.searchsorted(theirs, np.arange(len(last) + 1))
    many, who = begin[own + 1] - begin[own], np.repeat(np.arange(a.num_rows), sizes[0])
    sums = np.concatenate([[0], np.cumsum(many)])
    ends = sums[np.cumsum(sizes[0])]  # common keys up to each row of a
    names, rank = a.column("id").to_pylist(), np.argsort(np.lexsort((np.array(ids, dtype=object).astype(str), ords)))
    first, of_rows = 0, np.concatenate([[0], np.cumsum(sizes[0])])
    while first < a.num_rows:
        done = int(ends[first - 1]) if first else 0
        after = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        low, high = of_rows[first], of_rows[after]
        size, first = many[low:high], after
        total = int(size.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(begin[own[low:high]] - (sums[low:high] - done), size)
        pair, both = np.unique(np.repeat(who[low:high] * n, size) + row[at], return_counts=True)
        i, j = np.divmod(pair, n)
        able = both >= (min_score - 1e-6) * np.maximum(sizes[0][i], sizes[1][j])
        i, j, both = i[able], j[able], both[able]
        size, total = cut_many[i], int(cut_many[i].sum())
        sought = np.repeat(j * len(last), size) + cut_own[np.arange(total) + np.repeat(cut_begin[i] - (np.cumsum(size) - size), size)]
        place = np.minimum(np.searchsorted(passed, sought), max(len(passed) - 1, 0))
        more = passed[place] == sought if len(passed) else np.zeros(total, bool)
        union = sizes[0][i] + sizes[1][j] - both - np.bincount(np.repeat(np.arange(len(i)), size), more, len(i)).astype(np.int64)
        score = (2_000_000 * both + union) // (2 * union) / 1e6  # rounded half up
        keep = score >= min_score
        i, j, score = i[keep], j[keep], score[keep]
        best = np.lexsort((rank[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = i[nth < k], j[nth < k], score[nth < k]
        yield pa.table([pa.array([names[x] for x in i.tolist()], pa.string()), pa.array([ids[x] for x in j.tolist()], pa.string()), pa.array(np.full(len(i), src, np.int32)), pa.array(ords[j]), pa.array(score)], names=["s1_id", "t_id", "src", "ord", "score"])


def jaccard_best(s1: DataFrame, pool: DataFrame, keys: Column, bucket: int, k: int, min_score: float, block: int = 32768) -> DataFrame:
    """The k best of each source by the Jaccard measure of keys; pairs are those of a common key, of whose rows of a country and
    source the first ``bucket`` count. No table of all pairs is made: texts go to pairs of blocks, with the last row that counts of
    each key of more rows.
    """
    by, of = ["country", "src", "q_block", "p_block"], lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda e, *group: e.where("country is not null").select(*group, F.col("entity_id").alias("id"), "ord", "name", "addr")
    blocks = lambda e, name, *group: e.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    q, p = side(s1, "country"), side(pool, "country", "src")
    n = blocks(p, "n_p", "country", "src").join(blocks(q, "n_q", "country"), "country")
    nth = F.row_number().over(Window.partitionBy("country", "src", "key").orderBy("ord", "id"))
    cuts = keyed(pool, keys).withColumn("_r", nth).where(F.col("_r") == bucket).join(n, ["country", "src"]).withColumn("q_block", number("n_q"))
    cuts = cuts.select("country", "src", "q_block", number("n_p").alias("p_block"), "id", "ord", F.array("key").alias("keys"), F.lit(True).alias("cut"))
    left = q.join(n, "country").select("country", "src", of("n_q").alias("q_block"), number("n_p").alias("p_block"), "id", "ord", "name", "addr").repartition(*by)
    right = p.join(n, ["country", "src"]).select("country", "src", number("n_q").alias("q_block"), of("n_p").alias("p_block"), "id", "ord", "name", "addr").repartition(*by)
    made = lambda df: df.select(*by, "id", "ord", keys.alias("keys"))  # noqa: E731  texts are dealt, their keys made there
    left = made(left).withColumn("cut", F.lit(False)).unionByName(cuts)

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found, cut = [], a.column("cut")
        if a.num_rows and b.num_rows:
            found = list(best_by_jaccard(a.filter(pc.invert(cut)), b, a.filter(cut), key[1].as_py(), k, min_score))
        none = pa.schema([("s1_id", pa.string()), ("t_id", pa.string()), ("src", pa.int32()), ("ord", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([none.empty_table(), *found])

    anew = lambda df: df.toDF(*df.columns).groupBy(*by)  # noqa: E731  columns of its own: both sides come from the pool
    best = anew(left).cogroup(anew(made(right))).applyInArrow(meet, "s1_id string, t_id string, src int, ord long, score double")
    return top(best, k)


def dual_index(s1: DataFrame, pool: DataFrame, bucket: int = 50, k_text: int = 3, k_shingle: int = 2, k: int = 3, min_jaccard: float = 0.2) -> DataFrame:
    """The better of TF-IDF and shingle Jaccard, the k best of each source."""
    a = tfidf_best(s1, pool, heavy_name(), k_text).select("s1_id", "t_id", "src", "ord", "score")
    b = jaccard_best(s1, pool, shingles(), bucket, k_shingle, min_jaccard)
    both = a.unionByName(b.select(a.columns)).groupBy("s1_id", "t_id", "src", "ord").agg(F.max("score").alias("score"))
    return top(both, k)


def brand_keys() -> Column:
    w = X.significant_tokens(X.clean_eu("name"))
    first = F.try_element_at(w, F.lit(1))
    two = F.when(F.size(w) > 1, F.concat_ws(" ", first, F.element_at(w, 2)))
    return F.filter(F.array(two, F.when(F.length(first) >= 3, first)), lambda k: k.isNotNull())


def address_keys() -> Column:
    brand = F.substring(F.coalesce(F.try_element_at(X.significant_tokens(X.clean_eu("name")), F.lit(1)), F.lit("")), 1, 4)
    pin, num = X.postal_last(X.text("addr")), F.regexp_extract(X.text("addr"), r"\b(\d+)\b", 1)
    return F.filter(F.array(F.concat(F.lit("pin_"), pin), F.when((num != "") & (brand != ""), F.concat(F.lit("num_"), num, F.lit("_"), brand))), lambda k: k.isNotNull())


def cascade(s1: DataFrame, pool: DataFrame, k_text: int = 2, brand_cap: int = 25, address_cap: int = 20, k: int = 3, block: int = 8192) -> DataFrame:
    """Sums of cosine, shared brand keys (0.35 and 0.15 of the names' token sort) and shared address keys (0.25)."""
    cols = ["s1_id", "t_id", "src", "ord", "score"]
    a = tfidf_best(s1, pool, heavy_name(), k_text, T.char, 0.03, False, None, block).select(cols)
    name = lambda e, i: e.select(F.col("entity_id").alias(i), X.clean_eu("name").alias(f"name_{i}"))
    b = key_pairs(s1, pool, brand_keys(), drop_over=brand_cap).join(name(s1, "s1_id"), "s1_id").join(name(pool, "t_id"), "t_id")
    b = b.withColumn("score", 0.35 + 0.15 * K.similarity("token_sort", F.col("name_s1_id"), F.col("name_t_id")) / 100).select(cols)
    c = key_pairs(s1, pool, address_keys(), drop_over=address_cap).withColumn("score", F.lit(0.25)).select(cols)
    return top(a.unionByName(b).unionByName(c).groupBy("s1_id", "t_id", "src", "ord").agg(F.round(F.sum("score"), 6).alias("score")), k)


def sparse(s1: DataFrame, pool: DataFrame, k: int = 15, max_df: int = 3000, min_score: float = 0.1, name: Column | None = None, addr: Column | None = None) -> DataFrame:
    """Words and word pairs of name, joined name and address, binary, weighed over pool and queries of a country."""
    text = X.blocking_text(X.name_v2("name") if name is None else name, X.address_v2("addr") if addr is None else addr)
    words = lambda c: F.array_distinct(T.word_pairs(c))
    return tfidf_best(s1, pool, text, k, words, min_score, False, None, 32768, max_df)


def production_keys(raw_addr: str = "addr") -> Column:
    w = X.significant_tokens(X.clean_folded("name"), X.KEY_STOPWORDS_WIDE)
    first, second = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(2))
    pin, num = X.postal_last(X.text(raw_addr)), F.regexp_extract(X.text(raw_addr), r"\b(\d+)\b", 1)
    start = F.substring(first, 1, 3)
    return F.filter(
        F.array(
            F.when(second.isNotNull(), F.concat(F.lit("b2_"), first, F.lit("_"), second)),
            F.when(F.length(first) >= 3, F.concat(F.lit("w1_"), F.substring(first, 1, 5))),
            F.concat(F.lit("pin_"), pin, F.lit("_"), start),
            F.when(num != "", F.concat(F.lit("num_"), num, F.lit("_"), start)),
        ),
        lambda k: k.isNotNull(),
    )


def key_blocking(s1: DataFrame, pool: DataFrame, bucket: int = 40, k: int = 5) -> DataFrame:
    """Pairs of a common production key, by 0.6 token sort of names and 0.4 of names with addresses; k of each source."""
    pairs = key_pairs(s1, pool, production_keys(), keep_first=bucket).select("s1_id", "t_id", "src", "ord").distinct()
    side = lambda e, i: e.select(F.col("entity_id").alias(i), X.clean_folded("name").alias(f"n_{i}"), X.clean_folded("addr").alias(f"a_{i}"))
    p = pairs.join(side(s1, "s1_id"), "s1_id").join(side(pool, "t_id"), "t_id")
    whole = lambda i: F.concat_ws(" ", f"n_{i}", f"a_{i}")
    score = 0.6 * K.similarity("token_sort", F.col("n_s1_id"), F.col("n_t_id")) + 0.4 * K.similarity("token_sort", whole("s1_id"), whole("t_id"))
    return top(p.select("s1_id", "t_id", "src", "ord", F.round(score / 100, 6).alias("score")), k)


# -- dense vectors ----------------------------------------------------------------------------------------------------


def unit(c: Column) -> Column:
    """The vector at length one, as doubles."""
    v = F.transform(c, lambda x: x.cast("double"))
    return F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))


def hashed_vectors(text: Column, size: int = 64) -> Column:
    """Unit vectors of a text's trigrams, hashed to ``size`` places: a stand-in for an encoder's vectors, native throughout."""
    n = F.transform(F.concat(T.char(text), F.array(F.lit("#"))), lambda g: F.pmod(F.xxhash64(g), F.lit(size)))
    places = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    counts = K.let(n, lambda x: F.transform(places, lambda k: (F.size(x) - F.size(F.array_remove(x, k))).cast("double")))
    return K.let(counts, unit)


def nearest(queries: DataFrame, pool: DataFrame, k: int, by: tuple[str, ...] = ("country", "src"), block: int = 4096) -> DataFrame:
    """Exact (s1_id, t_id, src, score, rank): the k largest inner products of unit vectors in each (country, src).

    queries(country, s1_id, v) meet the pool(country, src, t_id, ord, v) in blocks of about ``block`` rows as matrices;
    each block gives its k best for each query, and the best of those stay. Pairs of blocks are dealt by their numbers,
    so that a country is as many tasks' work as it has blocks of the pool.
    """

    def blocks(df: DataFrame, group: list[str], name: str) -> DataFrame:
        return df.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("long").alias(name))

    def in_blocks(df: DataFrame, counts: DataFrame, group: list[str], key: str, rows: Column, name: str) -> DataFrame:
        of = F.pmod(F.xxhash64(key), F.col(f"{name}_blocks")).alias(f"{name}_block")
        return df.join(counts, group).select(*group, of, rows.alias(name)).groupBy(*group, f"{name}_block").agg(F.collect_list(name).alias(name))  # about block rows

    n_q, n_p = blocks(queries, ["country"], "q_blocks"), blocks(pool, list(by), "p_blocks")
    q = in_blocks(queries, n_q, ["country"], "s1_id", F.struct("s1_id", "v"), "q")
    p = in_blocks(pool, n_p, list(by), "t_id", F.struct("t_id", "ord", "v"), "p")
    number = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{name}_blocks") - 1)).alias(f"{name}_block")
    deal = n_p.select(*by, number("p")).join(n_q, "country").select(*by, "p_block", number("q"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                a = np.array([x["v"] for x in row.q])
                b = np.array([x["v"] for x in row.p])
                ids, ords = [x["t_id"] for x in row.p], [x["ord"] for x in row.p]
                order = np.argsort(ords, kind="stable")
                s = np.round(a @ b.T, 6)[:, order]
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out = [(x["s1_id"], ids[order[j]], row.src, ords[order[j]], s[i, j]) for i, x in enumerate(row.q) for j in best[i]]
                yield pd.DataFrame(out, columns=["s1_id", "t_id", "src", "ord", "score"])

    pairs = deal.join(q, ["country", "q_block"]).join(p, [*by, "p_block"]).select("q", "p", "src").mapInPandas(multiply, "s1_id string, t_id string, src int, ord long, score double")
    return top(pairs, k)


def nearest_cells(queries: DataFrame, pool: DataFrame, k: int, cells: int, probes: int, seed: int = 0) -> DataFrame:
    """Approximate ``nearest`` over one pool: k-means cells of the pool, of which each query searches ``probes``.

    The centres are fitted on the pool; every row of it is in one cell, so more probes give the exact result at last.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = pool.withColumn("features", array_to_vector("v"))
    model = KMeans(k=cells, seed=seed, maxIter=8, predictionCol="cell").fit(v)
    shared = queries.sparkSession.sparkContext.broadcast(np.array(model.clusterCenters()))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    @F.pandas_udf("array<int>")
    def order(v: pd.Series) -> pd.Series:
        c, out = shared.value, []
        for low in range(0, len(v), 512):
            d = (c * c).sum(axis=1) - 2 * np.stack(v.iloc[low : low + 512].tolist()) @ c.T
            out += list(np.argsort(d, axis=1, kind="stable")[:, :probes])
        return pd.Series(out, index=v.index)

    q = queries.select("country", "s1_id", "v", F.explode(order("v")).alias("cell")).withColumnRenamed("v", "vq")
    p = model.transform(v).select("country", "src", "t_id", "ord", F.col("v").alias("vp"), "cell")
    pairs = q.join(p, ["country", "cell"]).select("s1_id", "t_id", "src", "ord", F.round(dot(F.col("vq"), F.col("vp")), 6).alias("score"))
    return top(pairs, k, ("s1_id",))


def nearest_index(queries: DataFrame, pool: DataFrame, k: int, flat: int = 50_000) -> DataFrame:
    """``nearest`` over all sources: exact in countries of at most ``flat`` rows of the pool, else by cells.

    A country of n rows has min(4 sqrt(n), n / 39) cells, of which a query searches 24.
    """
    sizes = pool.groupBy("country").count()
    large = {r.country: r["count"] for r in sizes.where(F.col("count") > flat).collect()}
    among = F.col("country").isin(list(large))
    out = top(nearest(queries.where(~among), pool.where(~among), k).drop("rank"), k, ("s1_id",))
    for country, n in large.items():  # each has an index of its own
        cells = max(1, int(min(4 * n**0.5, n // 39)))
        own = F.col("country") == country
        out = out.unionByName(nearest_cells(queries.where(own), pool.where(own), k, cells, min(cells, 24)).select(out.columns))
    return out


def audit(candidates: DataFrame, truth: DataFrame, n_s1: Column | int, n_pool: Column | int) -> DataFrame:
    """(recall, average candidates, reduction ratio) in one row; recall is 1 without true pairs."""
    candidates = stored(candidates.select("s1_id", "t_id"))  # counted twice
    hit = truth.join(candidates.distinct().withColumn("hit", F.lit(1)), ["s1_id", "t_id"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_hit"))
    n = candidates.agg(F.count("*").alias("n_cands"))
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (n_s1, n_pool))
    return hit.crossJoin(n).select(  # one row by one row
        F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_true")).alias("recall"),
        (F.col("n_cands") / a).alias("avg_candidates"),
        (1 - F.col("n_cands") / (a.cast("double") * b)).alias("reduction_ratio"),
    )
