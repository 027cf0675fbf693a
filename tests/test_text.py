from pyspark.sql import functions as F

from kinmatch.functions import text as X


def values(spark, names, column):
    return [r[0] for r in spark.createDataFrame([(n,) for n in names], "name string").select(column("name")).collect()]


NAMES = ["The Acme Co. Pvt. Ltd.", "Société Générale SARL", "B+ Retail Inc", "A&B Foods, LLC", None, ""]


def test_cleaners(spark):
    assert values(spark, NAMES, X.clean_legal) == ["the acme co", "soci t g n rale sarl", "b retail", "a b foods", "", ""]
    assert values(spark, NAMES, X.clean_articles) == ["acme", "soci t g n rale sarl", "b retail", "a b foods", "", ""]
    assert values(spark, NAMES, X.clean_folded) == ["acme", "generale", "b retail", "a b foods", "", ""]
    assert values(spark, NAMES, X.basic)[:4] == ["the acme co pvt ltd", "socie te ge ne rale sarl", "b retail inc", "a and b foods llc"]
    assert values(spark, ["Saint-Étienne"], X.clean_legal) == ["saint tienne"]
    assert values(spark, ["Saint-Étienne"], X.clean_folded) == ["saint etienne"]


def test_domains_and_addresses(spark):
    assert values(spark, ["www.acme-foods.com", "https://x.co.in/a", "M S Acme & Sons"], X.name_v2) == ["acme foods", "x", "acme sons"]
    assert values(spark, ["007 Main St, Apt 4", "5 N MG Rd"], X.address_v2) == ["7 main street apartment 4", "5 north marg road"]
    assert values(spark, ["Visit http://a.b/c Café & Co!"], X.clean_ascii) == ["visit caf & co"]


def test_numbers(spark):
    a = ["12 Main 12 St 560001", "no digits", "4444 55555 666666 7777777"]
    assert values(spark, a, lambda c: X.address_numbers(F.col(c))) == ["12 12 560001", "", "4444 55555 666666 7777777"]
    assert values(spark, a, lambda c: X.postal_first(F.col(c))) == ["560001", "", "55555"]
    assert values(spark, a, lambda c: X.postal_last(F.col(c))) == ["560001", None, "7777777"]
    assert values(spark, a, lambda c: X.leading_number(F.col(c))) == ["12", "", "4444"]


def test_ids(spark):
    df = spark.createDataFrame([("S1-17",), ("S3-00001",), ("S2-999999999999",)], "entity_id string")
    assert [r[0] for r in df.select(X.encode_id(F.col("entity_id"))).collect()] == [1_000_000_000_017, 3_000_000_000_001, 2_999_999_999_999]
    assert [r[0] for r in X.lossless_ids(df).collect()] == ["S3-00001"]
