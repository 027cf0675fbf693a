"""Terms of texts and their TF-IDF weights as long tables of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K


def grams(c: Column, n: int = 3) -> Column:
    """Runs of n characters; none if there are fewer. A long text is split first, as a substring looks for its place from the start."""
    runs = lambda at: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), at)
    short = runs(lambda i: F.substring(c, i, n))
    long = K.let(F.split(c, ""), lambda x: runs(lambda i: F.concat(*(F.get(x, i + (k - 1)) for k in range(n)))))
    return F.when(F.length(c) >= n, F.when(F.length(c) <= 512, short).otherwise(long)).otherwise(F.array().cast("array<string>"))


def char_wb(c: Column) -> Column:
    """Trigrams of each word with a blank at both ends."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit(" "), w, F.lit(" ")))))


def char(c: Column) -> Column:
    """Trigrams of the whole text, runs of white space as one blank."""
    return grams(F.regexp_replace(F.lower(c), r"\s+", " "))


def word_pairs(c: Column) -> Column:
    """Words and pairs of neighbouring words."""
    w = F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def frequencies(docs: DataFrame, terms: Column, binary: bool = False) -> DataFrame:
    """(country, src, id, ord, term, tf) of docs(country, src, id, ord, text)."""
    made = docs.select("country", "src", "id", "ord", F.explode(F.array_distinct(terms) if binary else terms).alias("term"))
    return made.groupBy("country", "src", "id", "ord", "term").agg(F.count("*").cast("double").alias("tf"))


def vocabulary(tf: DataFrame, docs: DataFrame, min_df: int = 2, max_df: int | None = None, max_features: int | None = None) -> DataFrame:
    """(country, src, term, idf), smoothed; the most frequent ``max_features`` terms of each (country, src) where given."""
    n = docs.groupBy("country", "src").agg(F.count_distinct("id").alias("n"))
    df = tf.groupBy("country", "src", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_df is not None:
        df = df.where(F.col("df") <= max_df)
    if max_features is not None:
        rank = F.row_number().over(Window.partitionBy("country", "src").orderBy(F.desc("total"), "term"))
        df = df.withColumn("_r", rank).where(F.col("_r") <= max_features).drop("_r")
    return df.join(n, ["country", "src"]).select("country", "src", "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(tf: DataFrame, vocab: DataFrame, sublinear: bool = False, on: tuple[str, ...] = ("country", "src", "term")) -> DataFrame:
    """(country, src, id, ord, term, w), of length one for each id after the vocabulary."""
    tf_part = 1.0 + F.log("tf") if sublinear else F.col("tf")
    w = tf.join(vocab, list(on)).withColumn("w", tf_part * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("country", "src", "id")))
    return w.select("country", "src", "id", "ord", "term", (F.col("w") / norm).alias("w"))
