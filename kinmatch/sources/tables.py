"""Delimited sources, ground truth, samples and result files, and the adapter of the star schema to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
NA = ("", "NA", "N/A", "null", "None", "NaN", "nan", "NULL")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA, columns: list[str] | None = None, quoted: bool = False, na: bool = False, skip_bad: bool = False, rows: int | None = None) -> DataFrame:
    """A tab-separated file with a header as strings, blanks empty, and ``ord``, the row's place.

    quoted: " quotes fields, else it is a character like others; na: fields that read as missing become empty; skip_bad:
    rows of a wrong number of fields are dropped, else they fail; rows: the first so many alone. A missing file raises.
    """
    df = spark.read.schema(schema).options(sep="\t", header=True, quote='"' if quoted else "", mode="DROPMALFORMED" if skip_bad else "FAILFAST").csv(path)
    df = df.withColumn("ord", F.monotonically_increasing_id())
    blank = [F.when(F.col(c).isin(*NA), "").otherwise(X.text(c)).alias(c) if na else X.text(c).alias(c) for c in schema.names]
    df = df.select(*blank, "ord")
    df = df.select(*columns, "ord") if columns else df
    return df.orderBy("ord").limit(rows) if rows is not None else df


def entities(raw: DataFrame) -> DataFrame:
    """(entity_id, src, country, name, addr, ord) of a source table."""
    return raw.select("entity_id", F.substring("entity_id", 2, 1).cast("int").alias("src"), F.col("country"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "ord")


def load_split(spark: SparkSession, folder: str, split: str, country: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(S1, pool of S2 and S3) of a split; one country of them where named."""
    one, two, three = (entities(read_tsv(spark, f"{folder}/{split}_source{k}.tsv", **how)) for k in (1, 2, 3))
    pool = two.unionByName(three)
    return (one, pool) if country is None else (one.where(F.col("country") == country), pool.where(F.col("country") == country))


def load_train(spark: SparkSession, folder: str, sample: int | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(truth rows, S1, [S2, S3]) of the training split: all of it, or the coherent sample of ``sample`` truth rows."""
    one, two, three = (entities(read_tsv(spark, f"{folder}/train_source{k}.tsv")) for k in (1, 2, 3))
    truth = load_truth(spark, f"{folder}/train_ground_truth.tsv")
    return coherent_sample(truth, one, [two, three], sample) if sample else (truth, one, [two, three])


def first_of_country(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each country, by ord."""
    r = F.row_number().over(Window.partitionBy("country").orderBy("ord", "entity_id"))
    return df.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def truth_pairs(raw: DataFrame) -> DataFrame:
    """(s1_id, t_id) of a ground truth table; blanks about ids and empty ids go."""
    t = F.explode(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)))
    return raw.select(F.col("source1_entity_id").alias("s1_id"), t.alias("t_id")).where("t_id <> ''").distinct()


def truth_counts(raw: DataFrame) -> DataFrame:
    """(s1_id, n_true) with zeros."""
    every = raw.select(F.col("source1_entity_id").alias("s1_id")).distinct()
    return every.join(truth_pairs(raw).groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))


def load_truth(spark: SparkSession, path: str, among: DataFrame | None = None) -> DataFrame:
    """Ground truth rows, of the S1 ids in among(s1_id) alone where given."""
    raw = read_tsv(spark, path, TRUTH)
    return raw if among is None else raw.join(among.select(F.col("s1_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")


def coherent_sample(truth: DataFrame, s1: DataFrame, pools: list[DataFrame], n: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The first n truth rows, their S1 rows, and of each pool their true rows and the first 2 n rows, once each."""
    some = truth.orderBy("ord").limit(n)
    pairs = truth_pairs(some)
    mine = s1.join(some.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi")
    out = []
    for p in pools:
        needed = p.join(pairs.select(F.col("t_id").alias("entity_id")), "entity_id", "left_semi")
        out.append(needed.unionByName(p.orderBy("ord").limit(2 * n)).dropDuplicates(["entity_id"]))
    return some, mine, out


def countries(df: DataFrame) -> DataFrame:
    """(country, n), most frequent first."""
    return df.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country")


def countries_small_first(df: DataFrame) -> DataFrame:
    """Distinct countries: France, US, India, then others by name."""
    rank = F.when(F.col("country") == "France", 0).when(F.col("country") == "US", 1).when(F.col("country") == "India", 2).otherwise(3)
    return df.select("country").distinct().orderBy(rank, "country")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first field of every line but the header."""
    lines = spark.read.text(path)
    return lines.select(F.substring_index("value", "\t", 1).alias("entity_id")).where("entity_id <> 'entity_id'")


def id_lists(s1: DataFrame, pairs: DataFrame, column: str, distinct: bool = True) -> DataFrame:
    """(source1_entity_id, column) for every S1 row: its ids by pos, comma-joined, empty if none."""
    ids = F.expr("transform(array_sort(collect_list(struct(pos, t_id))), x -> x.t_id)")
    lists = pairs.groupBy("s1_id").agg((F.array_distinct(ids) if distinct else ids).alias("ids"))  # as long as a row of top-k results
    out = s1.select(F.col("entity_id").alias("s1_id"), "ord").join(lists, "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias(column), "ord")


def write_lists(lists: DataFrame, path: str, column: str) -> None:
    """Lines of id, tab, list in the order of S1, with a header; no quotes, and a bare tab for an empty list."""
    head = lists.sparkSession.createDataFrame([(f"source1_entity_id\t{column}", -1)], "value string, ord long")
    body = lists.select(F.concat("source1_entity_id", F.lit("\t"), column).alias("value"), "ord")
    head.unionByName(body).orderBy("ord").select("value").write.mode("overwrite").text(path)


def star_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, customers and parts as the three sources of entities, all rows; the nation is the country.

    A part's nation is that of its key. Names and addresses are whole fields.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country"))
    s = read("supplier").select(F.lit(1).alias("src"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("k"), F.translate("s_name", "#", " ").alias("name"), F.lit("supply depot").alias("kind"))
    c = read("customer").select(F.lit(2).alias("src"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("k"), F.translate("c_name", "#", " ").alias("name"), F.concat(F.col("c_mktsegment"), F.lit(" depot")).alias("kind"))
    p = read("part").select(F.lit(3).alias("src"), F.col("p_partkey").alias("key"), (F.col("p_partkey") % 25).cast("int").alias("k"), F.concat(F.lit("Supplier Co Ltd "), "p_name", F.lit(" "), "p_brand").alias("name"), F.concat("p_type", F.lit(" store")).alias("kind"))
    every = s.unionByName(c).unionByName(p).join(F.broadcast(nation), "k")  # 25 nations
    return every.select(
        F.concat(F.lit("S"), "src", F.lit("-"), "key").alias("entity_id"), "src", "country", "name",
        F.concat_ws(" ", F.lpad(F.col("key").cast("string"), F.greatest(F.lit(5), F.length(F.col("key").cast("string"))), F.lit("0")), "kind", "country").alias("addr"), F.col("key").cast("long").alias("ord"),
    )


def star_truth(entities_: DataFrame) -> DataFrame:
    """(s1_id, t_id): targets of the same country and key as an S1 entity."""
    a = entities_.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "ord")
    b = entities_.where("src > 1").select(F.col("entity_id").alias("t_id"), "country", "ord")
    return a.join(b, ["country", "ord"]).select("s1_id", "t_id")


def document_entities(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """All documents as entities, with copies, near-copies and contested targets among them; the language is the country.

    Of a text's words (runs of ASCII letters and digits) the first six are the name and the twelve after them the address;
    the remainder of the id by three gives the source. ``same`` is a digest of the whole text. With ``whole`` all words after the
    name are the address.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.coalesce("text", F.lit(""))
    head = head if whole else F.regexp_extract(head, "^(?:[^A-Za-z0-9]*+[A-Za-z0-9]++){0,18}+", 0)  # no word after them is looked at
    w = F.filter(F.split(F.regexp_replace(head, "[^A-Za-z0-9]+", " "), " "), lambda x: x != "")
    src = (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    d = d.select("doc_id", src.alias("src"), F.coalesce("lang", F.lit("")).alias("country"), w.alias("w"), F.sha2("text", 256).alias("same"))
    return d.select(
        F.concat(F.lit("S"), "src", F.lit("-"), "doc_id").alias("entity_id"), "src", "country",
        F.array_join(F.slice("w", 1, 6), " ").alias("name"), F.array_join(F.slice("w", F.lit(7), F.size("w") if whole else F.lit(12)), " ").alias("addr"), F.col("doc_id").cast("long").alias("ord"), "same",
    )


def document_truth(entities_: DataFrame) -> DataFrame:
    """(s1_id, t_id): targets of the same country and whole text as an S1 entity."""
    a = entities_.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "same")
    b = entities_.where("src > 1").select(F.col("entity_id").alias("t_id"), "country", "same")
    return a.join(b, ["country", "same"]).select("s1_id", "t_id")
