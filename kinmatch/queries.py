"""Queries over entities of the star schema and of the documents, with the same in DuckDB SQL where it can be said there."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import text as X
from .operators import assign, blocking, features, graph, metrics, scoring, validate
from .plans import pipelines
from .sources import tables

ENT = """
ent0 AS (
  SELECT 1 AS src, s_suppkey AS key, s_nationkey AS k, replace(s_name, '#', ' ') AS name, 'supply depot' AS kind FROM supplier
  UNION ALL SELECT 2, c_custkey, c_nationkey, replace(c_name, '#', ' '), c_mktsegment || ' depot' FROM customer
  UNION ALL SELECT 3, p_partkey, CAST(p_partkey % 25 AS INT), 'Supplier Co Ltd ' || p_name || ' ' || p_brand, p_type || ' store' FROM part),
ent AS (
  SELECT 'S' || src || '-' || key AS entity_id, src, n_name AS country, name,
         lpad(CAST(key AS VARCHAR), CAST(greatest(5, length(CAST(key AS VARCHAR))) AS INT), '0') || ' ' || kind || ' ' || n_name AS addr, CAST(key AS BIGINT) AS ord
  FROM ent0 JOIN nation ON n_nationkey = k),
truth AS (
  SELECT a.entity_id AS s1_id, b.entity_id AS t_id FROM ent a JOIN ent b ON a.country = b.country AND a.ord = b.ord WHERE a.src = 1 AND b.src > 1),
cnt AS (
  SELECT e.entity_id AS s1_id, count(t.t_id) AS n_true FROM ent e LEFT JOIN truth t ON t.s1_id = e.entity_id WHERE e.src = 1 GROUP BY 1)
"""


#: Documents as entities; copies give true pairs, near-copies and common words contested claims.
DOC = """
docw AS (
  SELECT doc_id, doc_id % 3 + 1 AS src, coalesce(lang, '') AS country, text,
         list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
ent AS (
  SELECT 'S' || src || '-' || doc_id AS entity_id, src, country, array_to_string(w[1:6], ' ') AS name, array_to_string(w[7:18], ' ') AS addr,
         CAST(doc_id AS BIGINT) AS ord, text
  FROM docw),
truth AS (
  SELECT a.entity_id AS s1_id, b.entity_id AS t_id FROM ent a JOIN ent b ON a.country = b.country AND a.text = b.text WHERE a.src = 1 AND b.src > 1),
cnt AS (
  SELECT e.entity_id AS s1_id, count(t.t_id) AS n_true FROM ent e LEFT JOIN truth t ON t.s1_id = e.entity_id WHERE e.src = 1 GROUP BY 1)
"""


def clean(c: str, words) -> str:
    """DuckDB form of a Cleaner of ASCII text."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\b(?:{'|'.join(words)})\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def ascii_(c: str) -> str:
    """DuckDB form of clean_ascii of ASCII text without web addresses."""
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\w\s&]', ' ', 'g'), '\s+', ' ', 'g'))"


def core(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({ascii_(c)}, '\b(?:{'|'.join(X.LEGAL_CORE)})\b', '', 'g'), '\s+', ' ', 'g'))"


def joined(c):
    return F.array_join(F.array_sort(c), " ")


def cosine(a: str, b: str) -> str:
    """DuckDB form of the trigram cosine of two columns."""
    grams = lambda c: f"CASE WHEN length({c}) >= 3 THEN list_transform(range(1, length({c}) - 1), lambda i: substr({c}, CAST(i AS INT), 3)) ELSE [] END"
    x, y = grams(a), grams(b)
    count = lambda g, s: f"len(list_filter({g}, lambda z: z = {s}))"
    total = lambda g, h: f"list_sum(list_transform({g}, lambda w: {count(h, 'w')}))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 3 OR length({b}) < 3 THEN 0.0 ELSE {total(x, y)} / (sqrt({total(x, x)}) * sqrt({total(y, y)})) END"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = tables.star_entities(spark, sf_dir)
    return e, e.where("src = 1"), e.where("src > 1")


def doc_sides(spark: SparkSession, sf_dir: str, *whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = graph.stored(tables.document_entities(spark, sf_dir, *whole))  # plans read it many times, the texts once
    return e, e.where("src = 1"), e.where("src > 1")


def truth_of(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = tables.document_truth(e) if "same" in e.columns else tables.star_truth(e)
    n = e.where("src = 1").select(F.col("entity_id").alias("s1_id")).join(t.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").fillna(0, ["n_true"])
    return t, n


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def candidates_out(c: DataFrame) -> DataFrame:
    return c.select("s1_id", "t_id", F.col("rank").cast("long").alias("rank"), "score")


# -- sources and text ---------------------------------------------------------------------------------------------------


@query(f"WITH {ENT} SELECT entity_id, CAST(src AS BIGINT) AS src, country, name, addr, ord, CAST(src * 1000000000000 + ord AS BIGINT) AS eid FROM ent")
def entities(spark, sf_dir):
    """IO14: entities with encoded ids that come back as they were."""
    e, _, _ = sides(spark, sf_dir)
    return e.select("entity_id", F.col("src").cast("long").alias("src"), "country", "name", "addr", "ord", X.encode_id(F.col("entity_id")).alias("eid"))


@query(f"WITH {ENT} SELECT country, count(*) AS n FROM ent GROUP BY 1")
def countries(spark, sf_dir):
    """IO12, A4: rows of each country."""
    return tables.countries(sides(spark, sf_dir)[0])


def written(spark, sf_dir) -> str:
    """A folder with the star's entities and truth as the delimited files of a training split."""
    e, s1, _ = sides(spark, sf_dir)
    folder, names = graph.new_folder(spark), {"name": "business_name", "addr": "business_address"}
    for k in (1, 2, 3):
        rows = e.where(F.col("src") == k).orderBy("ord").coalesce(1).withColumnsRenamed(names).select(*tables.SCHEMA.names)
        rows.write.options(sep="\t", header=True, quote="", emptyValue="").csv(f"{folder}/train_source{k}.tsv")
    t = tables.star_truth(e).withColumn("pos", F.row_number().over(Window.partitionBy("s1_id").orderBy("t_id")))
    tables.write_lists(tables.id_lists(s1, t, "matched_entity_ids"), f"{folder}/train_ground_truth.tsv", "matched_entity_ids")
    return folder


@query(f"WITH {ENT} SELECT entity_id, CAST(src AS BIGINT) AS src, country, name, addr FROM ent")
def source_files(spark, sf_dir):
    """IO1-IO6: a split of delimited files, written and read again."""
    s1, pool = tables.load_split(spark, written(spark, sf_dir), "train")
    return s1.unionByName(pool).select("entity_id", F.col("src").cast("long").alias("src"), "country", "name", "addr")


@query(f"WITH {ENT} SELECT s1_id, n_true FROM cnt")
def source_truth(spark, sf_dir):
    """IO7, IO8, IO16, IO18: ground truth, written and read again."""
    return tables.truth_counts(tables.load_truth(spark, f"{written(spark, sf_dir)}/train_ground_truth.tsv"))


@query(f"""WITH {ENT}, s AS (SELECT entity_id, ord FROM ent WHERE src = 1 ORDER BY ord LIMIT 40),
p AS (SELECT entity_id, src, row_number() OVER (PARTITION BY src ORDER BY ord) <= 80 OR entity_id IN (SELECT t_id FROM truth WHERE s1_id IN (SELECT entity_id FROM s)) AS held FROM ent WHERE src > 1)
SELECT 'truth' AS part, entity_id FROM s UNION ALL SELECT 's1', entity_id FROM s UNION ALL SELECT 'pool', entity_id FROM p WHERE held""")
def source_sample(spark, sf_dir):
    """IO9, IO10, IO11: the coherent sample of 40 truth rows of the training files."""
    truth, s1, pools = tables.load_train(spark, written(spark, sf_dir), 40)
    ids = lambda df, part, c="entity_id": df.select(F.lit(part).alias("part"), F.col(c).alias("entity_id"))
    return ids(truth, "truth", "source1_entity_id").unionByName(ids(s1, "s1")).unionByName(ids(pools[0], "pool")).unionByName(ids(pools[1], "pool"))


@query(f"WITH {ENT} SELECT entity_id FROM (SELECT entity_id, row_number() OVER (PARTITION BY country ORDER BY ord, entity_id) AS r FROM ent) WHERE r <= 20")
def source_first(spark, sf_dir):
    """F8: the first 20 rows of each country."""
    return tables.first_of_country(sides(spark, sf_dir)[0], 20).select("entity_id")


@query(rf"""WITH {ENT} SELECT entity_id, {clean('name', X.LEGAL)} AS t1, {clean('name', X.LEGAL_ARTICLES)} AS t2, {clean('addr', X.LEGAL_EU)} AS t3,
trim({clean('name', X.LEGAL_ARTICLES)} || ' ' || {clean('name', X.LEGAL_ARTICLES)} || ' ' || {clean('addr', X.LEGAL_ARTICLES)}) AS composite,
array_to_string(list_sort(regexp_extract_all(addr, '\b\d+\b')), ' ') AS numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(addr, '\d+'))), ' ') AS number_text,
array_to_string(list_sort(list_distinct(regexp_extract_all(addr, '\b\d+\b'))), ' ') AS number_set, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(addr), '\b[a-z0-9]+\b'))), ' ') AS word_set,
{core('name')} || ' ' || {ascii_('addr')} AS core_text, regexp_extract(lower(name), '[a-z0-9]+') AS first_token, regexp_extract(addr, '\b(\d{{5}}|\d{{6}})\b', 1) AS postal_first,
regexp_extract_all(addr, '\b\d{{5,}}\b')[-1] AS postal_last, regexp_extract(addr, '^\D*(\d+)', 1) AS leading_number,
replace(name, ' ', '') AS compact, 'name: ' || name || ' | address: ' || addr AS prompt FROM ent""")
def text_functions(spark, sf_dir):
    """T1-T3, T8-T17, T19, T21-T23."""
    e, _, _ = sides(spark, sf_dir)
    n, a = F.col("name"), F.col("addr")
    return e.select(
        "entity_id", X.clean_legal("name").alias("t1"), X.clean_articles("name").alias("t2"), X.clean_eu("addr").alias("t3"),
        X.composite(X.clean_articles("name"), X.clean_articles("addr"), 2).alias("composite"), X.address_numbers(a).alias("numbers"), X.number_text(a).alias("number_text"),
        joined(X.number_set(a)).alias("number_set"), joined(X.word_set(a)).alias("word_set"), X.core_text(n, a).alias("core_text"),
        X.first_token(n).alias("first_token"), X.postal_first(a).alias("postal_first"), X.postal_last(a).alias("postal_last"), X.leading_number(a).alias("leading_number"),
        X.compact(n).alias("compact"), X.prompt(n, a).alias("prompt"),
    )


@query()
def text_functions_folded(spark, sf_dir):
    """Whole document texts and entity names through the cleaners that need decomposition."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", X.clean_folded("text").alias("folded"), X.basic("text").alias("basic"), X.address_v2("text").alias("address"), X.name_v2("text").alias("name"), X.clean_ascii("text").alias("ascii"), X.name_core(X.clean_ascii("text")).alias("core"), F.size(X.word_set(F.col("text"))).alias("n_words"), F.size(X.significant_tokens(X.clean_eu("text"))).alias("n_tokens"))


@query(r"""SELECT page_id, replace(regexp_extract(lower(trim(url)), '^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co\.in|fr|us|biz|info|io)\b.*$', 1), '-', ' ') AS host,
regexp_extract(lower(url), '^https?://([a-z0-9\-]+)', 1) AS first_label FROM pages""")
def page_hosts(spark, sf_dir):
    """The host that stands for a name given as a web address."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.lower(F.trim("url"))
    return p.select("page_id", F.regexp_replace(F.regexp_extract(u, X.DOMAIN, 1), "-", " ").alias("host"), F.regexp_extract(F.lower("url"), r"^https?://([a-z0-9\-]+)", 1).alias("first_label"))


# -- kernels ---------------------------------------------------------------------------------------------------------------

PAIRS = "SELECT a.entity_id AS s1_id, b.entity_id AS t_id, a.name AS n1, b.name AS n2, a.addr AS a1, b.addr AS a2 FROM ent a JOIN ent b ON a.country = b.country AND a.src = 1 AND b.src = 2"


def same_country(spark, sf_dir, parts: int = 8, texts=None, only=None) -> DataFrame:
    """All pairs of S1 and S2 of a country with their texts. S2 is dealt over parts and S1 goes to each; no pair is dealt again.

    texts(name, address) names further columns, worked out once an entity; they come with 1 and 2 behind their names.
    only(name, address): the S2 that pairs are asked of.
    """
    more = lambda k: [c.alias(f"{x}{k}") for x, c in (texts(X.text("name"), X.text("addr")) if texts else {}).items()]
    _, s1, pool = sides(spark, sf_dir)
    part = F.pmod(F.xxhash64("entity_id"), F.lit(parts)).cast("int").alias("part")
    one = s1.select("country", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("entity_id").alias("s1_id"), X.text("name").alias("n1"), X.text("addr").alias("a1"), *more(1))
    pool = pool.where("src = 2")
    pool = pool.where(only(X.text("name"), X.text("addr"))) if only else pool
    two = pool.select("country", part, F.col("entity_id").alias("t_id"), "src", "ord", X.text("name").alias("n2"), X.text("addr").alias("a2"), *more(2))
    dealt = lambda df: df.repartition(8 * parts, "country", "part")  # noqa: E731  a fixed number: small tables still make many pairs
    return dealt(two).join(dealt(one), ["country", "part"]).drop("part")


@query(rf"""WITH {ENT}, p AS ({PAIRS}) SELECT s1_id, t_id, round({cosine('n1', 'n2')}, 6) AS cosine,
round(1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)), 6) AS lev,
round(len(list_intersect(list_distinct(string_split(a1, ' ')), list_distinct(string_split(a2, ' ')))) / len(list_distinct(list_concat(string_split(a1, ' '), string_split(a2, ' ')))), 6) AS jaccard,
round(len(list_intersect(list_distinct(string_split(a1, ' ')), list_distinct(string_split(a2, ' ')))) / len(list_distinct(string_split(a1, ' '))), 6) AS containment FROM p""")
def kernels_native(spark, sf_dir):
    """Trigram cosine, edit similarity, Jaccard and containment of all pairs of a country."""
    p = same_country(spark, sf_dir, texts=lambda n, a: {"w": F.array_distinct(F.split(a, " "))})
    p = p.withColumn("both", F.size(F.array_intersect("w1", "w2")))
    union = F.size("w1") + F.size("w2") - F.col("both")
    r = lambda c: F.round(c, 6)
    return p.select("s1_id", "t_id", r(K.trigram_cosine_of_batches(F.col("n1"), F.col("n2"))).alias("cosine"), r(K.levenshtein(F.col("n1"), F.col("n2"))).alias("lev"), r(F.col("both") / union).alias("jaccard"), r(F.col("both") / F.size("w1")).alias("containment"))


@query(f"WITH {ENT}, p AS ({PAIRS}) SELECT s1_id, t_id, round(jaro_winkler_similarity(n1, n2), 6) AS jw FROM p")
def kernel_jaro_winkler(spark, sf_dir):
    """K6."""
    return same_country(spark, sf_dir).select("s1_id", "t_id", F.round(K.similarity("jaro_winkler", F.col("n1"), F.col("n2")), 6).alias("jw"))


@query()
def kernels_udf(spark, sf_dir):
    """K1-K5, K11."""
    p = same_country(spark, sf_dir)
    names = ("ratio", "token_sort", "token_set", "partial", "weighted")
    found = p.select("s1_id", "t_id", K.together(F.col("n1"), F.col("n2"), *names).alias("k"))
    return found.select("s1_id", "t_id", *(F.round(f"k.{k}", 6).alias(k) for k in names))


# -- blocking ---------------------------------------------------------------------------------------------------------------


def tfidf_sql(text: str, terms: str, tf: str, min_score: float, most: int | None, k: int, by: str = "s1_id, src", pool_src: str = "src") -> str:
    """CTEs up to ``topk(s1_id, t_id, src, ord, score, rank)``; terms is a list expression over t."""
    cap = f"WHERE r <= {most}" if most else ""
    return f"""
d AS (SELECT src AS real_src, {pool_src} AS src, country, entity_id AS id, ord, {text} AS t FROM ent),
g AS (SELECT real_src, src, country, id, ord, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT real_src, src, country, id, ord, unnest({terms}) AS term FROM d) GROUP BY ALL),
nn AS (SELECT country, src, count(DISTINCT id) AS n FROM d WHERE real_src > 1 GROUP BY ALL),
dfs AS (SELECT country, src, term, count(*) AS df, sum(tf) AS total FROM g WHERE real_src > 1 GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT country, src, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT *, row_number() OVER (PARTITION BY country, src ORDER BY total DESC, term) AS r FROM dfs) JOIN nn USING (country, src) {cap}),
w AS (SELECT v.country, v.src, id, ord, term, real_src, {tf} * idf AS w FROM g JOIN v USING (country, term) WHERE g.real_src = 1 OR g.src = v.src),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY country, src, id)) AS x FROM w),
s AS (SELECT q.id AS s1_id, p.id AS t_id, p.src, p.ord, round(sum(q.x * p.x), 6) AS score FROM u q JOIN u p USING (country, src, term) WHERE q.real_src = 1 AND p.real_src > 1 GROUP BY ALL HAVING round(sum(q.x * p.x), 6) >= {min_score}),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, src, ord, t_id) AS rank FROM s) WHERE rank <= {k})"""


WB = "flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 1), lambda i: substr(' ' || x || ' ', CAST(i AS INT), 3))))"
M1 = tfidf_sql(f"trim({clean('name', X.LEGAL)} || ' ' || {clean('addr', X.LEGAL)})", WB, "(1.0 + ln(tf))", 0.05, 100_000, 3)
HEAVY = f"trim({clean('name', X.LEGAL_ARTICLES)} || ' ' || {clean('name', X.LEGAL_ARTICLES)} || ' ' || {clean('addr', X.LEGAL_ARTICLES)})"
M2 = tfidf_sql(HEAVY, WB, "(1.0 + ln(tf))", 0.05, 100_000, 3)
NAMES2 = clean("name", X.LEGAL_ARTICLES)


@query(f"WITH {ENT}, {M1} SELECT s1_id, t_id, rank, score FROM topk")
def block_tfidf(spark, sf_dir):
    """B1, B-t1, B-t3 to B-t7, J6, J7, F6, W1."""
    _, s1, pool = sides(spark, sf_dir)
    return candidates_out(blocking.tfidf_topk(s1, pool))


PREFIX = "CASE WHEN w[1] = '' THEN NULL WHEN len(w) > 1 THEN substr(w[1], 1, 5) || '_' || substr(w[2], 1, 5) ELSE substr(w[1], 1, 6) END"


@query(f"""WITH {ENT}, {M2}, kk AS (SELECT entity_id AS id, src, country, ord, {PREFIX} AS key FROM (SELECT *, string_split({NAMES2}, ' ') AS w FROM ent)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, src, key ORDER BY ord, id) AS r FROM kk WHERE src > 1 AND key <> '') WHERE r <= 5),
h AS (SELECT DISTINCT q.id AS s1_id, p.id AS t_id, p.src, p.ord FROM kk q JOIN pk p USING (country, key) WHERE q.src = 1),
b AS (SELECT s1_id, t_id, src, ord, coalesce(topk.score, 0.5) AS score FROM topk FULL JOIN h USING (s1_id, t_id, src, ord))
SELECT s1_id, t_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, src, ord, t_id) AS rank FROM b) WHERE rank <= 5""")
def block_union(spark, sf_dir):
    """B2, J8, W7."""
    _, s1, pool = sides(spark, sf_dir)
    return candidates_out(blocking.union_blocking(s1, pool))


SHINGLES = "list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])))"


@query(f"""WITH {ENT}, {M2}, sh AS (SELECT entity_id AS id, src, country, ord, {SHINGLES} AS sh FROM (SELECT *, list_filter(string_split({clean("trim(name || ' ' || addr)", X.LEGAL_ARTICLES)}, ' '), lambda x: x <> '') AS w FROM ent)),
e AS (SELECT id, src, country, ord, unnest(sh) AS key FROM sh),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, src, key ORDER BY ord, id) AS r FROM e WHERE src > 1) WHERE r <= 50),
c AS (SELECT q.id AS s1_id, p.id AS t_id, p.src, p.ord, count(*) AS n FROM e q JOIN pk p USING (country, key) WHERE q.src = 1 GROUP BY ALL),
j AS (SELECT s1_id, t_id, c.src, c.ord, round(n / len(list_distinct(list_concat(a.sh, b.sh))), 6) AS score FROM c JOIN sh a ON a.id = s1_id JOIN sh b ON b.id = t_id),
jk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, src, ord, t_id) AS r FROM j WHERE score >= 0.2) WHERE r <= 2),
b AS (SELECT s1_id, t_id, src, ord, max(score) AS score FROM (SELECT s1_id, t_id, src, ord, score FROM topk UNION ALL SELECT s1_id, t_id, src, ord, score FROM jk) GROUP BY ALL)
SELECT s1_id, t_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, src, ord, t_id) AS rank FROM b) WHERE rank <= 3""")
def block_dual(spark, sf_dir):
    """B3, A7, W6."""
    _, s1, pool = sides(spark, sf_dir)
    return candidates_out(blocking.dual_index(s1, pool))


@query()
def block_cascade(spark, sf_dir):
    """B5, B-t2, A8, W8."""
    _, s1, pool = sides(spark, sf_dir)
    return candidates_out(blocking.cascade(s1, pool))


W12 = "list_distinct(list_concat(string_split(t, ' '), list_transform(range(1, len(string_split(t, ' '))), lambda i: string_split(t, ' ')[i] || ' ' || string_split(t, ' ')[i + 1])))"


@query(f"""WITH {ENT}, d AS (SELECT src, country, entity_id AS id, ord, {clean('name', X.LEGAL)} || ' ' || replace({clean('name', X.LEGAL)}, ' ', '') || ' ' || {clean('addr', X.LEGAL)} AS t FROM ent),
g AS (SELECT src, country, id, ord, unnest({W12}) AS term FROM d), nn AS (SELECT country, count(DISTINCT id) AS n FROM d GROUP BY 1),
v AS (SELECT country, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT country, term, count(*) AS df FROM g GROUP BY ALL HAVING count(*) BETWEEN 2 AND 3000) JOIN nn USING (country)),
u AS (SELECT src, country, id, ord, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY country, id)) AS x FROM g JOIN v USING (country, term)),
s AS (SELECT q.id AS s1_id, p.id AS t_id, p.ord, round(sum(q.x * p.x), 6) AS score FROM u q JOIN u p USING (country, term) WHERE q.src = 1 AND p.src > 1 GROUP BY ALL HAVING round(sum(q.x * p.x), 6) >= 0.1)
SELECT s1_id, t_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, ord, t_id) AS rank FROM s) WHERE rank <= 15""")
def block_sparse(spark, sf_dir):
    """B6, A5, with the plain cleaner, which SQL has too."""
    _, s1, pool = sides(spark, sf_dir)
    return candidates_out(blocking.sparse(s1, pool, name=X.clean_legal("name"), addr=X.clean_legal("addr")))


@query()
def block_keys(spark, sf_dir):
    """B8."""
    _, s1, pool = sides(spark, sf_dir)
    return candidates_out(blocking.key_blocking(s1, pool))


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All embeddings as entities: label 0 to 3 the queries, the others the pool, one country."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("all").alias("country"), F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("long").alias("ord"), "label", blocking.unit(F.col("embedding")).alias("v"))
    q = e.where("label < 4").select("country", F.col("id").alias("s1_id"), "v")
    return q, e.where("label >= 4").select("country", F.lit(2).alias("src"), F.col("id").alias("t_id"), "ord", "v")


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM n),
s AS (SELECT CAST(a.vec_id AS VARCHAR) AS s1_id, CAST(b.vec_id AS VARCHAR) AS t_id, b.vec_id AS ord, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label < 4 AND b.label >= 4)
SELECT s1_id, t_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, ord) AS rank FROM s) WHERE rank <= 3""")
def block_dense(spark, sf_dir):
    """B4, J9."""
    q, p = vectors(spark, sf_dir)
    return candidates_out(blocking.nearest(q, p, 3))


@query()
def block_dense_cells(spark, sf_dir):
    """Exact up to 50,000 vectors of a country, else k-means cells."""
    q, p = vectors(spark, sf_dir)
    return candidates_out(blocking.nearest_index(q, p, 10))


@query(f"""WITH {ENT}, {M1} SELECT (SELECT count(*) FROM truth JOIN topk USING (s1_id, t_id)) / (SELECT count(*) FROM truth) AS recall,
(SELECT count(*) FROM topk) / (SELECT count(*) FROM ent WHERE src = 1) AS avg_candidates,
1 - (SELECT count(*) FROM topk) / (CAST((SELECT count(*) FROM ent WHERE src = 1) AS DOUBLE) * (SELECT count(*) FROM ent WHERE src > 1)) AS reduction_ratio""")
def blocking_audit(spark, sf_dir):
    """B10."""
    e, s1, pool = sides(spark, sf_dir)
    return blocking.audit(blocking.tfidf_topk(s1, pool), truth_of(e)[0], s1.count(), pool.count())


# -- whole plans, claims and metrics -------------------------------------------------------------------------------------

MIN = f"""kk AS (SELECT *, {clean('name', X.LEGAL)} AS cn, {clean('addr', X.LEGAL)} AS ca FROM ent),
wk AS (SELECT entity_id, src, country, unnest(list_distinct(string_split(cn, ' '))) AS key FROM kk),
wb AS (SELECT country, src, key FROM wk WHERE src > 1 AND key <> '' GROUP BY ALL HAVING count(*) <= 50),
pk AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS t_id FROM wk a JOIN wk b ON a.country = b.country AND a.key = b.key AND a.src = 1 JOIN wb ON wb.country = b.country AND wb.src = b.src AND wb.key = b.key),
pr AS (SELECT s1_id, t_id, a.ord AS s1_ord, a.cn AS n1, a.ca AS a1, b.cn AS n2, b.ca AS a2 FROM pk JOIN kk a ON a.entity_id = s1_id JOIN kk b ON b.entity_id = t_id),
sc AS (SELECT s1_id, t_id, s1_ord, round(0.65 * {cosine('n1', 'n2')} + 0.35 * {cosine('a1', 'a2')}, 6) AS score FROM pr),
cl AS (SELECT s1_id, t_id, score FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, s1_ord) AS r FROM sc WHERE score >= 0.5) WHERE r = 1)"""
SCORE = """es AS (SELECT n.s1_id, n_true, count(c.t_id) AS n_pred, count(t.t_id) AS tp FROM cnt n LEFT JOIN cl c ON c.s1_id = n.s1_id LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.t_id = c.t_id GROUP BY ALL),
pe AS (SELECT *, CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS INT) WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END AS p, CASE WHEN n_true = 0 THEN 1 ELSE tp / n_true END AS r FROM es),
fe AS (SELECT *, CASE WHEN n_true = 0 THEN p WHEN tp = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END AS f FROM pe)"""
SUMMARY = "round(avg(f), 6) AS macro_f05, round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r, round(coalesce(avg(CASE WHEN n_true = 0 THEN f END), 1.0), 6) AS singleton_acc, round(coalesce(avg(CASE WHEN n_true > 0 THEN f END), 0.0), 6) AS non_singleton_f05"


@query(f"WITH {DOC}, {MIN} SELECT s1_id, t_id, score FROM cl")
def pipeline_minimum(spark, sf_dir):
    """Flagship: keys, trigram score (M-1), claims."""
    _, s1, pool = doc_sides(spark, sf_dir)
    return pipelines.minimum(s1, pool).matches.select("s1_id", "t_id", "score")


@query(f"WITH {DOC}, {MIN}, {SCORE} SELECT {SUMMARY} FROM fe")
def metric_macro(spark, sf_dir):
    """E1-E3, A1, A2, A9, J4."""
    e, s1, pool = doc_sides(spark, sf_dir)
    t, n = truth_of(e)
    return metrics.summary(metrics.entity_scores(t, n, pipelines.minimum(s1, pool).matches.select("s1_id", "t_id")))


@query(f"""WITH {DOC}, {MIN}, {SCORE} SELECT round(avg(f), 6) AS macro_f05, round(coalesce(avg(CASE WHEN n_true > 0 AND n_pred > 0 THEN p END), 0.0), 6) AS macro_p,
round(coalesce(avg(CASE WHEN n_true > 0 THEN r END), 0.0), 6) AS macro_r, round(coalesce(avg(CASE WHEN n_true = 0 THEN f END), 1.0), 6) AS singleton_acc FROM fe""")
def metric_pairs(spark, sf_dir):
    """E5."""
    e, s1, pool = doc_sides(spark, sf_dir)
    t, n = truth_of(e)
    return metrics.pair_summary(metrics.entity_scores(t, n, pipelines.minimum(s1, pool).matches.select("s1_id", "t_id")))


@query(f"""WITH {DOC}, {MIN}, th AS (SELECT CAST(unnest([{', '.join(map(str, metrics.GRIDS['m2']))}]) AS DOUBLE) AS threshold),
es AS (SELECT threshold, n.s1_id, n_true, count(c.t_id) AS n_pred, count(t.t_id) AS tp FROM cnt n CROSS JOIN th LEFT JOIN sc c ON c.s1_id = n.s1_id AND c.score >= threshold LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.t_id = c.t_id GROUP BY ALL),
pe AS (SELECT *, CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS INT) WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END AS p, CASE WHEN n_true = 0 THEN 1 ELSE tp / n_true END AS r FROM es),
fe AS (SELECT *, CASE WHEN n_true = 0 THEN p WHEN tp = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END AS f FROM pe)
SELECT threshold, {SUMMARY} FROM fe GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    """All thresholds of a grid in one job."""
    e, s1, pool = doc_sides(spark, sf_dir)
    t, n = truth_of(e)
    return metrics.sweep(t, n, pipelines.minimum(s1, pool).scored, metrics.GRIDS["m2"])


BEST = {n: f"SELECT '{n}' AS grid, threshold, macro_f05 FROM (SELECT * FROM ({{0}}) WHERE list_contains([{', '.join(map(str, g))}], threshold) ORDER BY macro_f05 DESC, threshold {'DESC' if n == 'v2' else 'ASC'} LIMIT 1)" for n, g in metrics.GRIDS.items()}


def swept_sql(compare: str, thresholds) -> str:
    return f"""SELECT threshold, round(avg(CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS INT) WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END), 6) AS macro_f05
FROM (SELECT threshold, n.s1_id, n_true, count(c.t_id) AS n_pred, count(t.t_id) AS tp FROM cnt n CROSS JOIN (SELECT CAST(unnest([{', '.join(map(str, thresholds))}]) AS DOUBLE) AS threshold)
LEFT JOIN sc c ON c.s1_id = n.s1_id AND c.score {compare} threshold LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.t_id = c.t_id GROUP BY ALL) GROUP BY threshold"""


@query(f"WITH {DOC}, {MIN} " + " UNION ALL ".join(BEST[n].format(swept_sql(">=" if n[0] == "m" else ">", g)) for n, g in metrics.GRIDS.items()))
def threshold_best(spark, sf_dir):
    """The best threshold of each of the four grids; at ties the lowest, of the last grid the highest."""
    e, s1, pool = doc_sides(spark, sf_dir)
    t, n = truth_of(e)
    scored = graph.stored(pipelines.minimum(s1, pool).scored)
    out = [metrics.best(metrics.sweep(t, n, scored, g, k[0] == "v"), k == "v2").select(F.lit(k).alias("grid"), "threshold", "macro_f05") for k, g in metrics.GRIDS.items()]
    return functools.reduce(DataFrame.unionByName, out)


@query(f"""WITH {DOC}, {MIN}, th AS (SELECT CAST(unnest([{', '.join(map(str, metrics.GRIDS['v1']))}]) AS DOUBLE) AS threshold),
es AS (SELECT threshold, s1_id, count(*) FILTER (score > threshold) AS n_pred, count(*) FILTER (score > threshold AND hit) AS tp, count(*) FILTER (hit) AS own FROM (SELECT sc.*, t.t_id IS NOT NULL AS hit FROM sc LEFT JOIN truth t USING (s1_id, t_id)) CROSS JOIN th GROUP BY ALL),
fe AS (SELECT th.threshold, n_true, own, CASE WHEN own IS NULL THEN CAST(n_true = 0 AS INT) WHEN own = 0 THEN CAST(n_pred = 0 AS INT) WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / own) / (0.25 * (tp / n_pred) + tp / own) END AS f FROM cnt CROSS JOIN th LEFT JOIN es ON es.s1_id = cnt.s1_id AND es.threshold = th.threshold)
SELECT threshold, round(avg(f), 6) AS macro_f05 FROM fe GROUP BY threshold""")
def threshold_sweep_candidates(spark, sf_dir):
    """The sweep whose truth is what blocking has kept."""
    e, s1, pool = doc_sides(spark, sf_dir)
    t, n = truth_of(e)
    return metrics.sweep_candidates(t, n, pipelines.minimum(s1, pool).scored, metrics.GRIDS["v1"])


@query(f"""WITH {DOC}, {MIN}, es AS (SELECT n.s1_id, n_true, count(t.t_id) AS tp FROM cnt n LEFT JOIN sc c ON c.s1_id = n.s1_id LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.t_id = c.t_id GROUP BY ALL)
SELECT round(avg(CASE WHEN n_true = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / n_true / (0.25 + tp / n_true) END), 6) AS macro_f05 FROM es""")
def metric_ceiling(spark, sf_dir):
    """What a perfect scorer could reach on the candidates."""
    e, s1, pool = doc_sides(spark, sf_dir)
    t, n = truth_of(e)
    return metrics.ceiling(t, n, pipelines.minimum(s1, pool).candidates).select("macro_f05")


@query(f"""WITH {DOC}, {MIN}, p2 AS (SELECT sc.*, substr(t_id, 2, 1) AS src, e.ord FROM sc JOIN ent e ON e.entity_id = t_id WHERE score >= 0.5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, ord, t_id) AS r FROM p2) WHERE r = 1)
SELECT s1_id, t_id, score FROM (SELECT s1_id, t_id, score, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, s1_ord) AS r2 FROM b) WHERE r2 = 1""")
def claims_single(spark, sf_dir):
    """R2, W5."""
    _, s1, pool = doc_sides(spark, sf_dir)
    return assign.single_claims(pipelines.minimum(s1, pool).scored, 0.5, ("s1_ord",)).select("s1_id", "t_id", "score")


@query()
def claims_optimal(spark, sf_dir):
    """R3."""
    _, s1, pool = doc_sides(spark, sf_dir)
    return assign.optimal_claims(pipelines.minimum(s1, pool).scored, 0.6)


@query(f"WITH {DOC}, {MIN} SELECT entity_id AS source1_entity_id, coalesce(string_agg(t_id, ',' ORDER BY score DESC, t_id), '') AS matched_entity_ids FROM ent LEFT JOIN cl ON s1_id = entity_id WHERE src = 1 GROUP BY 1")
def match_lists(spark, sf_dir):
    """IO16, IO17, R5, A3, U3."""
    _, s1, pool = doc_sides(spark, sf_dir)
    return tables.id_lists(s1, pipelines.minimum(s1, pool).matches, "matched_entity_ids").drop("ord")


@query(f"WITH {DOC}, {MIN}, z AS (SELECT entity_id, count(t_id) AS size FROM ent LEFT JOIN cl ON s1_id = entity_id WHERE src = 1 GROUP BY 1) SELECT size, count(*) AS n FROM z GROUP BY 1")
def match_histogram(spark, sf_dir):
    """How many S1 have so many matches."""
    _, s1, pool = doc_sides(spark, sf_dir)
    return assign.fill(s1, pipelines.minimum(s1, pool).matches).groupBy(F.size("matches").cast("long").alias("size")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOC}, c2 AS (SELECT s1_id, country, n_true = 0 AS lone FROM cnt JOIN ent ON entity_id = s1_id)
SELECT s1_id, row_number() OVER (PARTITION BY country, lone ORDER BY md5(s1_id || '#42'), s1_id) <= ceil(0.2 * count(*) OVER (PARTITION BY country, lone)) AS held FROM c2""")
def split_stratified(spark, sf_dir):
    """E8, E9."""
    e, s1, _ = doc_sides(spark, sf_dir)
    _, n = truth_of(e)
    d = n.join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").withColumn("lone", F.col("n_true") == 0)
    return metrics.stratified(d, ["country", "lone"]).select("s1_id", "held")


@query(f"""WITH {DOC}, {MIN}, gap AS (SELECT s1_id, t_id, rank() OVER (PARTITION BY s1_id ORDER BY score DESC) AS _r, max(score) OVER (PARTITION BY s1_id) - score AS block_gap, count(*) OVER (PARTITION BY s1_id) AS n_cands, score FROM sc)
SELECT s1_id, t_id, round(block_gap, 6) AS block_gap, n_cands, score FROM gap""")
def list_context(spark, sf_dir):
    """A candidate's place in its list."""
    _, s1, pool = doc_sides(spark, sf_dir)
    w = Window.partitionBy("s1_id")
    return pipelines.minimum(s1, pool).scored.select("s1_id", "t_id", F.round(F.max("score").over(w) - F.col("score"), 6).alias("block_gap"), F.count("*").over(w).alias("n_cands"), "score")


@query(f"""WITH {DOC}, {MIN}, l AS (SELECT entity_id AS s1_id, coalesce(string_agg(t_id, ','), '') AS ids FROM ent LEFT JOIN cl ON s1_id = entity_id WHERE src < 3 GROUP BY 1)
SELECT * FROM (SELECT 'extra_s1' AS rule, 'error' AS severity, count(*) AS n FROM l WHERE s1_id NOT LIKE 'S1-%'
UNION ALL SELECT 'match_not_candidate', 'warning', count(*) FROM cl WHERE score < 0.7) WHERE n > 0""")
def validation(spark, sf_dir):
    """V-1, J10, U2: findings on lists with S2 rows among them, against candidates from 0.7 on."""
    e, s1, pool = doc_sides(spark, sf_dir)
    m = pipelines.minimum(s1, pool).matches
    to = lambda rows, pairs: tables.id_lists(rows, pairs, "ids").select(F.col("source1_entity_id").alias("s1_id"), "ids", F.lit(1).alias("tabs"))
    lists = to(e.where("src < 3"), m)
    found = validate.check_lists(lists, s1.select(F.col("entity_id").alias("s1_id")), "matching_results").unionByName(validate.check_subset(lists, to(s1, m.where("score >= 0.7"))))
    return found.select("rule", "severity", "n")


@query(f"WITH {DOC}, {MIN} SELECT * FROM (SELECT 'match_not_candidate' AS rule, 'error' AS severity, count(*) AS n FROM cl WHERE score < 0.7 UNION ALL SELECT 'missing_s1', 'error', n FROM range(2), (SELECT count(*) AS n FROM ent WHERE src = 2 AND ord < 30)) WHERE n > 0")
def validation_files(spark, sf_dir):
    """V-1 to V-4, IO13, IO18: written result files, read and checked again; some S2 ids are wrongly required."""
    e, s1, pool = doc_sides(spark, sf_dir)
    m, folder = graph.stored(pipelines.minimum(s1, pool).matches), graph.new_folder(spark)
    for name, column, pairs in (("matching", "matched_entity_ids", m), ("candidates", "candidate_entity_ids", m.where("score >= 0.7"))):
        tables.write_lists(tables.id_lists(s1, pairs, column), f"{folder}/{name}", column)
    need = e.where("src = 1 or src = 2 and ord < 30").select(F.col("entity_id").alias("s1_id"))
    return validate.check_files(spark, f"{folder}/matching", f"{folder}/candidates", need, True).select("rule", "severity", "n")


# -- features, rules and models ------------------------------------------------------------------------------------------


def _features(name: str):
    def run(spark, sf_dir):
        _, s1, pool = doc_sides(spark, sf_dir)
        none = lambda n, a: {}
        return features.of_sides(name, pipelines.minimum(s1, pool, texts=features.TEXTS.get(name, none)).scored)

    return run


for _name, _x in (("generic", "X2"), ("method2", "X3"), ("method3", "X4"), ("method4", "X5"), ("method5", "X6"), ("version1", "X7"), ("version2", "X8")):
    Q[f"features_{_name}"] = _features(_name)


@query()
def score_rules(spark, sf_dir):
    """M-3, X9: all pairs of a country of S1 and S2, as blocks; those of an S2 with long texts one by one."""
    _, s1, pool = sides(spark, sf_dir)
    long = scoring.gated_score(same_country(spark, sf_dir, texts=scoring.gate_texts, only=scoring.long_texts), True).select("s1_id", "t_id", F.round("rule_score", 6).alias("score"))
    side = lambda e: e.select("country", F.col("entity_id").alias("id"), *(c.alias(x) for x, c in scoring.gate_texts(X.text("name"), X.text("addr")).items()))
    return long.unionByName(scoring.gated_products(side(s1), side(pool.where("src = 2"))))


@query()
def pipeline_champion(spark, sf_dir):
    """B6, X8, M-2, R1."""
    _, s1, pool = sides(spark, sf_dir)
    return pipelines.champion(s1, pool, threshold=0.5).matches.select("s1_id", "t_id", "score", "pos")


@query()
def pipeline_production(spark, sf_dir):
    """B8, M-3, R2 in the three configurations, by E5."""
    e, s1, pool = sides(spark, sf_dir)
    return pipelines.configurations(s1, pool, *truth_of(e), threshold=0.7)


@query(f"WITH {ENT}, {M1} SELECT s1_id, t_id, round(0.65 * {cosine('lower(a.name)', 'lower(b.name)')} + 0.35 * {cosine('lower(a.addr)', 'lower(b.addr)')}, 6) AS score FROM topk JOIN ent a ON a.entity_id = s1_id JOIN ent b ON b.entity_id = t_id WHERE round(0.65 * {cosine('lower(a.name)', 'lower(b.name)')} + 0.35 * {cosine('lower(a.addr)', 'lower(b.addr)')}, 6) >= 0.5")
def pipeline_method1(spark, sf_dir):
    """B1, X1, M-1, R4."""
    _, s1, pool = sides(spark, sf_dir)
    return pipelines.method1(s1, pool, 0.5).matches.select("s1_id", "t_id", "score")


def learning(spark, sf_dir, *whole: bool):
    """S1, pool, truth and the S1 to learn from, of the documents; the latter are those not held out."""
    e, s1, pool = doc_sides(spark, sf_dir, *whole)
    t, n = truth_of(e)
    train = metrics.stratified(n.withColumn("lone", F.col("n_true") == 0), ["lone"]).where("not held")
    return s1, pool, t, train


def dense(s1, pool):
    """Hashed trigram vectors of both sides, in place of an outside encoder's."""
    v = blocking.hashed_vectors(X.core_text(F.col("name"), F.col("addr")))
    q = s1.select("country", F.col("entity_id").alias("s1_id"), v.alias("v"))
    return q, pool.select("country", "src", F.col("entity_id").alias("t_id"), "ord", v.alias("v"))


def probabilities(link) -> DataFrame:
    return link.scored.select("s1_id", "t_id", F.round("score", 6).alias("score"))


def matched(link) -> DataFrame:
    """What the plan's last stage, a threshold or claims, leaves of the scored pairs."""
    return link.matches.select("s1_id", "t_id", F.round("score", 6).alias("score"))


#: Registered plans learn few trees, so that a check of all queries ends; the plans' own default is the published number.
FEW = {"trees": 10, "depth": 3}


@query()
def pipeline_method2(spark, sf_dir):
    """B2, X3, M-4, M-8, R4: boosted trees, fitted on the S1 that are not held out."""
    return matched(pipelines.method2(*learning(spark, sf_dir), 0.5, **FEW))


@query()
def pipeline_method3(spark, sf_dir):
    """B3, X4, M-4, R1."""
    return matched(pipelines.method3(*learning(spark, sf_dir), 0.5, **FEW))


@query()
def pipeline_method4(spark, sf_dir):
    """B4, X5, M-4, R1, J3, over hashed trigram vectors."""
    s1, pool, t, train = learning(spark, sf_dir)
    return matched(pipelines.method4(s1, pool, *dense(s1, pool), t, train, 0.5, **FEW))


@query()
def pipeline_method5(spark, sf_dir):
    """B5, X6, M-5, R3, over whole texts: all words after the name are the address."""
    return pipelines.method5(*learning(spark, sf_dir, True), 0.5, block=2048, **FEW).matches.select("s1_id", "t_id", F.round("score", 6).alias("score"))


@query()
def pipeline_version1(spark, sf_dir):
    """B7, X7, M-7, R4, over hashed trigram vectors: an ensemble across countries."""
    s1, pool, t, _ = learning(spark, sf_dir)
    return probabilities(pipelines.version1(s1, pool, *dense(s1, pool), t, 0.5, folds=3, **FEW))


@query()
def pipeline_version2(spark, sf_dir):
    """B6 with its own cleaners, X8, M-6, R4."""
    return matched(pipelines.version2(*learning(spark, sf_dir), 0.5, **FEW))
