"""Blocking, claims, metrics, sources and validation on small hand-made tables."""

import itertools
import random

import pytest

from kinmatch.operators import assign, blocking, metrics, validate
from kinmatch.operators import terms as T
from kinmatch.sources import tables

ENTITY = "entity_id string, src int, country string, name string, addr string, ord long"


def scored(spark, rows):
    return spark.createDataFrame([(s, t, int(t[0]) if t[0].isdigit() else 2, x, k) for k, (s, t, x) in enumerate(rows)], "s1_id string, t_id string, src int, score double, ord long")


def test_terms(spark):
    df = spark.createDataFrame([("a bc",), ("",), ("abcd",)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(T.char_wb(F.col("t"))).collect()] == [[" a ", " bc", "bc "], [], [" ab", "abc", "bcd", "cd "]]
    assert [r[0] for r in df.select(T.char(F.col("t"))).collect()] == [["a b", " bc"], [], ["abc", "bcd"]]
    assert [r[0] for r in df.select(T.word_pairs(F.col("t"))).collect()] == [["a", "bc", "a bc"], [], ["abcd"]]


def test_bucket_policies(spark):
    from pyspark.sql import functions as F

    s1 = spark.createDataFrame([("S1-1", 1, "X", "acme", "", 0)], ENTITY)
    pool = spark.createDataFrame([(f"S2-{k}", 2, "X", "acme", "", k) for k in range(60)] + [("S2-99", 2, "Y", "acme", "", 99)], ENTITY)
    keys = F.array("name")
    assert blocking.key_pairs(s1, pool, keys, keep_first=5).count() == 5
    assert blocking.key_pairs(s1, pool, keys, keep_first=40).agg(F.max("ord")).first()[0] == 39
    assert blocking.key_pairs(s1, pool, keys, drop_over=25).count() == 0
    assert blocking.key_pairs(s1, pool, keys).count() == 60  # not the other country


def test_blockers_give_ranked_lists(spark):
    r = random.Random(3)
    words = ["acme", "foods", "steel", "north", "river", "12", "77", "560001"]
    make = lambda s, n: [(f"S{s}-{k}", s, r.choice("XY"), " ".join(r.choices(words[:5], k=2)), " ".join(r.choices(words, k=3)), k) for k in range(n)]
    s1 = spark.createDataFrame([*make(1, 12), ("S1-99", 1, "Z", "lone", "", 99), ("S1-98", 1, "X", "", "", 98)], ENTITY)
    pool = spark.createDataFrame(make(2, 15) + make(3, 15), ENTITY)
    for f, per_source, most in ((blocking.tfidf_topk, True, 3), (blocking.union_blocking, False, 5), (blocking.dual_index, True, 3), (blocking.cascade, True, 3), (blocking.key_blocking, True, 5), (blocking.sparse, False, 15)):
        rows = f(s1, pool).collect()
        assert rows, f.__name__
        groups = itertools.groupby(sorted(rows, key=lambda x: (x.s1_id, x.src if per_source else 0, x["rank"])), key=lambda x: (x.s1_id, x.src if per_source else 0))
        for _, g in groups:
            g = list(g)
            assert [x["rank"] for x in g] == list(range(1, len(g) + 1)) and len(g) <= most
            assert all(a.score >= b.score for a, b in itertools.pairwise(g))
        assert not any(x.s1_id == "S1-99" for x in rows)


def test_claims(spark):
    rows = [("A", "x", 0.90), ("B", "x", 0.95), ("A", "y", 0.85), ("C", "z", 0.80), ("D", "z", 0.80), ("E", "w", 0.79)]
    got = assign.claims(scored(spark, rows), 0.8, ("ord",)).collect()
    assert sorted((r.s1_id, r.t_id) for r in got) == [("A", "y"), ("B", "x"), ("C", "z")]
    got = assign.single_claims(scored(spark, [("A", "2x", 0.9), ("A", "2y", 0.8), ("B", "2x", 0.9), ("B", "3y", 0.7)]), 0.5, ("s1_id",)).collect()
    assert sorted((r.s1_id, r.t_id) for r in got) == [("A", "2x"), ("B", "3y")]


def test_claims_equal_the_greedy_pass(spark):
    r = random.Random(7)
    rows = [(f"s{a}", f"t{b}", r.randint(5, 10) / 10) for a in range(8) for b in range(8) if r.random() < 0.5]
    taken, want = set(), set()
    for s, t, _ in sorted((x for x in rows if x[2] >= 0.6), key=lambda x: -x[2]):
        if t not in taken:
            taken.add(t)
            want.add((s, t))
    assert {(x.s1_id, x.t_id) for x in assign.claims(scored(spark, rows), 0.6, ("ord",)).collect()} == want


def test_optimum_is_optimal():
    r = random.Random(5)
    for _ in range(150):
        n, m = r.randint(1, 4), r.randint(1, 4)
        w = [[r.randint(1, 9) / 10 if r.random() < 0.7 else None for _ in range(m)] for _ in range(n)]
        best = (0, 0.0)
        for cols in itertools.product([-1, *range(m)], repeat=n):
            used = [c for c in cols if c >= 0]
            if len(used) == len(set(used)) and all(c < 0 or w[i][c] is not None for i, c in enumerate(cols)):
                best = max(best, (len(used), round(sum(w[i][c] for i, c in enumerate(cols) if c >= 0), 6)))
        got = assign.optimum(w)
        assert (sum(c >= 0 for c in got), round(sum(w[i][c] for i, c in enumerate(got) if c >= 0), 6)) == best


def test_optimal_claims_cover_every_contested_target(spark):
    rows = [("A", "x", 0.9), ("B", "x", 0.8), ("A", "y", 0.85), ("B", "y", 0.2), ("C", "z", 0.7)]
    got = {(r.s1_id, r.t_id) for r in assign.optimal_claims(scored(spark, rows), 0.5).collect()}
    assert got == {("B", "x"), ("A", "y"), ("C", "z")} or got == {("A", "x"), ("A", "y"), ("C", "z")}


def test_metrics(spark):
    truth = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3")], "s1_id string, t_id string")
    counts = spark.createDataFrame([("A", 2), ("B", 1), ("C", 0), ("D", 0)], "s1_id string, n_true long")
    pred = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "9"), ("D", "7")], "s1_id string, t_id string")
    e = {r.s1_id: r for r in metrics.entity_scores(truth, counts, pred).collect()}
    assert e["A"].f == pytest.approx(0.714286, abs=1e-6) and e["B"].f == 0 and e["C"].f == 1 and e["D"].f == 0
    s = metrics.summary(metrics.entity_scores(truth, counts, pred)).first()
    assert s.singleton_acc == 0.5 and s.macro_f05 == pytest.approx((0.714286 + 1) / 4, abs=1e-6)
    assert [len(g) for g in metrics.GRIDS.values()] == [14, 26, 9, 38]
    swept = metrics.sweep(truth, counts, pred.selectExpr("*", "0.8 as score"), [0.7, 0.75, 0.9])
    assert metrics.best(swept).first().threshold == 0.9
    tie = swept.where("threshold < 0.9")
    assert (metrics.best(tie).first().threshold, metrics.best(tie, True).first().threshold) == (0.7, 0.75)


def test_splits(spark):
    df = spark.createDataFrame([(f"S1-{k}", "XY"[k % 2]) for k in range(50)], "s1_id string, country string")
    rows = metrics.stratified(df, ["country"]).collect()
    assert sum(r.held for r in rows) == 10
    assert metrics.hashed_sample(df, 1.0).count() == 50 and metrics.hashed_sample(df, 0.0).count() == 0


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "train_source1.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"x" st\tUS\nS1-2\t\t\t\n')
    rows = tables.read_tsv(spark, str(p)).orderBy("ord").collect()
    assert [(r.business_name, r.business_address, r.country) for r in rows] == [("NA", '"x" st', "US"), ("", "", "")]
    assert tables.read_tsv(spark, str(p), na=True).orderBy("ord").first().business_name == ""
    s1 = tables.entities(tables.read_tsv(spark, str(p)))
    pairs = spark.createDataFrame([("S1-1", "S2-5", 2), ("S1-1", "S3-4", 1)], "s1_id string, t_id string, pos int")
    lists = tables.id_lists(s1, pairs, "matched_entity_ids")
    out = str(tmp_path / "out")
    tables.write_lists(lists, out, "matched_entity_ids")
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == sorted(["source1_entity_id\tmatched_entity_ids", "S1-1\tS3-4,S2-5", "S1-2\t"])
    raw = spark.createDataFrame([("S1-1", "S2-1, S3-2,"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(r.t_id for r in tables.truth_pairs(raw).collect()) == ["S2-1", "S3-2"]
    assert {r.s1_id: r.n_true for r in tables.truth_counts(raw).collect()} == {"S1-1": 2, "S1-2": 0}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_tsv(spark, str(tmp_path / "none.tsv")).count()


def test_validation(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1", 1), ("S1-1", "", 1), ("S1-2", "S1-3,X9-1", 1), ("S1-9", "", 0)], "s1_id string, ids string, tabs int")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    found = {r.rule: (r.severity, r.n, r.examples) for r in validate.check_lists(rows, need, "f").collect()}
    assert {k: v[1] for k, v in found.items()} == {"row_without_tab": 1, "duplicate_s1": 1, "duplicate_in_list": 1, "s1_in_list": 1, "unknown_prefix": 1, "missing_s1": 1, "extra_s1": 1}
    cands = spark.createDataFrame([("S1-2", "S1-3", 1)], "s1_id string, ids string, tabs int")
    assert validate.check_subset(rows, cands).first().severity == "warning"
    assert not validate.passed(validate.check_subset(rows, cands, True)) and validate.passed(validate.check_subset(rows, cands))


def test_dense_cells_hold_the_nearest(spark, tmp_path):
    from kinmatch.queries import Q, vectors

    r = random.Random(12)
    made = [(k, k % 10, [r.gauss(0, 1) for _ in range(16)]) for k in range(1500)]
    spark.createDataFrame(made, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q, p = vectors(spark, str(tmp_path))
    pairs = lambda df: {(x.s1_id, x.t_id) for x in df.collect()}
    want = pairs(blocking.nearest(q, p, 10))
    assert pairs(Q["block_dense_cells"](spark, str(tmp_path))) == want
    cells = pairs(blocking.nearest_index(q, p, 10, flat=100))
    assert len(want) == 6000 and len(cells & want) >= 0.9 * len(want)


def test_sweep_of_candidates(spark):
    truth = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3"), ("E", "9")], "s1_id string, t_id string")
    counts = spark.createDataFrame([("A", 2), ("B", 1), ("C", 0), ("D", 0), ("E", 1)], "s1_id string, n_true long")
    pairs = spark.createDataFrame([("A", "1", 0.9), ("A", "5", 0.55), ("B", "4", 0.6), ("C", "7", 0.7)], "s1_id string, t_id string, score double")
    got = {r.threshold: r.macro_f05 for r in metrics.sweep_candidates(truth, counts, pairs, [0.5, 0.6, 0.8]).collect()}
    # A: true pair 1 of its candidates; B's true pair is no candidate, so B counts as a singleton; D has none; E scores 0.
    assert got == {0.5: pytest.approx((1.25 * 0.5 / (0.125 + 1) + 0 + 0 + 1 + 0) / 5, abs=1e-6), 0.6: pytest.approx((1 + 1 + 0 + 1 + 0) / 5), 0.8: pytest.approx((1 + 1 + 1 + 1 + 0) / 5)}


def test_sweep_equals_one_threshold_at_a_time(spark):
    r = random.Random(2)
    truth = spark.createDataFrame([(f"s{k}", f"t{r.randrange(9)}") for k in range(6)], "s1_id string, t_id string").distinct()
    counts = spark.createDataFrame([(f"s{k}", int(k < 6)) for k in range(9)], "s1_id string, n_true long")
    pairs = spark.createDataFrame([(f"s{a}", f"t{b}", r.randint(1, 9) / 10) for a in range(8) for b in range(9) if r.random() < 0.6], "s1_id string, t_id string, score double")
    for strict in (False, True):
        for x in metrics.sweep(truth, counts, pairs, [0.7, 0.2, 0.5], strict).collect():
            held = pairs.where(f"score {'>' if strict else '>='} {x.threshold}")
            one = metrics.summary(metrics.entity_scores(truth, counts, held)).first()
            assert x.asDict() == {"threshold": x.threshold} | one.asDict()


def test_optimum_over_sparse_edges():
    r = random.Random(11)
    for _ in range(60):
        n = r.randint(1, 7)
        w = [{j: r.randint(1, 99) / 100 for j in range(n) if r.random() < 0.4} for _ in range(n)]
        best = max((sum(c >= 0 for c in cols), round(sum(w[i][c] for i, c in enumerate(cols) if c >= 0), 6)) for cols in choices(w))
        got = assign.optimum(w)
        assert len({c for c in got if c >= 0}) == sum(c >= 0 for c in got)
        assert (sum(c >= 0 for c in got), round(sum(w[i][c] for i, c in enumerate(got) if c >= 0), 6)) == best


def choices(w, used=frozenset()):
    if not w:
        yield ()
        return
    for c in (-1, *w[0]):
        if c < 0 or c not in used:
            for rest in choices(w[1:], used | {c} - {-1}):
                yield (c, *rest)


def test_long_chains_of_claims_are_one_group(spark):
    n = 130
    rows = [(f"s{k:03}", f"t{k:03}", 0.9) for k in range(n)] + [(f"s{k:03}", f"t{k + 1:03}", 0.8) for k in range(n)]
    got = {(x.s1_id, x.t_id) for x in assign.optimal_claims(scored(spark, rows), 0.5).collect()}
    assert got >= {(f"s{k:03}", f"t{k:03}") for k in range(n)} and len(got) == n + 1


def test_words_of_all_names_are_no_keys(spark):
    from kinmatch.plans import pipelines

    s1 = spark.createDataFrame([(f"S1-{k}", 1, "X", f"acme w{k}", "1 road", k) for k in range(60)], ENTITY)
    pool = spark.createDataFrame([(f"S2-{k}", 2, "X", f"acme w{k}", "1 road", k) for k in range(60)], ENTITY)
    got = pipelines.minimum(s1, pool)
    assert got.candidates.count() == 60 and got.matches.count() == 60
    assert pipelines.minimum(s1, pool, most=60).candidates.count() == 3600


def test_stored_models(spark, tmp_path):
    from kinmatch.operators import learn

    rows = spark.createDataFrame([(float(k % 7), float(k % 2), int(k % 7 > 3)) for k in range(60)], "a double, b double, label int")
    made = []
    make = lambda: made.append(1) or learn.fit(rows, ["a", "b"], trees=2, depth=2)
    for retrain in (False, False, True):
        model = learn.load_or_fit(spark, str(tmp_path / "model"), make, retrain)
        assert all((x.score > 0.5) == (x.label == 1) for x in learn.predict(model, rows).collect())
    assert len(made) == 2
    assert learn.importances(model, ["a", "b"])[0][0] == "a"


def test_entry_registers_sql_for_known_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "pipeline_minimum" in __spark_entry__.queries()


def test_best_by_blocks_are_those_of_all_pairs(spark):
    """Small blocks, repeated rows, ties, an id with two places, nulls: as the table of all pairs has them."""
    from kinmatch.functions import text as X

    r = random.Random(9)
    words = ["acme", "foods", "steel", "north", "river", "12", "77", "560001", "éclair", "a"]
    make = lambda s, n: [(f"S{s}-{k}", s, r.choice(["X", "Y", None]), " ".join(r.choices(words, k=r.randint(0, 3))) or None, " ".join(r.choices(words, k=2)), k) for k in range(n)]
    a, b = make(1, 60), make(2, 80) + make(3, 40)
    s1 = spark.createDataFrame([*a, a[0], ("S1-3", 1, "X", "acme river", "12", 900)], ENTITY)
    pool = spark.createDataFrame([*b, *b[:9], ("S2-5", 2, "X", "acme north", "12", 901)], ENTITY)
    text = X.composite(X.clean_legal("name"), X.clean_legal("addr"))
    columns = ["s1_id", "t_id", "src", "ord", "score", "rank"]
    for terms, sublinear, most in ((T.char_wb, True, 100_000), (T.char_wb, True, 12), (T.char, False, None)):
        want = blocking.top(blocking.tfidf_pairs(s1, pool, text, terms, 0.05, sublinear, most), 3).select(columns)
        got = blocking.tfidf_best(s1, pool, text, 3, terms, 0.05, sublinear, most, block=16)
        assert sorted(got.select(columns).collect()) == sorted(want.collect())
        assert want.count() > 100


def test_document_entities_take_the_first_words_of_a_text(spark, tmp_path):
    import re

    texts = ["", None, "  one", " ".join(f"w{k}" for k in range(40)), "«a»-b\n" * 9, "x" * 9000 + " y " + "é" * 30, "é" * 50]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for e in tables.document_entities(spark, str(tmp_path)).collect():
        w = re.findall("[A-Za-z0-9]+", texts[e.ord] or "")
        assert (e.name, e.addr) == (" ".join(w[:6]), " ".join(w[6:18]))


def counting(df, column):
    """df, and how many of its rows have been worked out."""
    from pyspark.sql import functions as F

    made = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    return df.withColumn(column, seen.asNondeterministic()(column)), made  # not evaluated again by a filter


def test_document_queries_read_the_texts_once(spark, tmp_path, monkeypatch):
    from kinmatch import queries

    spark.createDataFrame([(k, f"acme w{k // 3} steel", "en") for k in range(30)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    plain = tables.document_entities
    monkeypatch.setattr(tables, "document_entities", lambda *a: made.append(counting(plain(*a), "name")) or made[-1][0])
    assert queries.Q["features_generic"](spark, str(tmp_path)).count() > 0
    assert [m.value for _, m in made] == [30]


def test_plans_that_learn_and_the_audit_work_candidates_out_once(spark):
    from kinmatch.plans import pipelines

    s1 = spark.createDataFrame([(f"S1-{k}", 1, "X", f"acme w{k}", f"{k} road", k) for k in range(20)], ENTITY)
    pool = spark.createDataFrame([(f"S2-{k}", 2, "X", f"acme w{k}", f"{k} road", k) for k in range(20)], ENTITY)
    pairs = [(f"S1-{k}", f"S2-{j}", 2, j, 0.5 + (k == j) / 4) for k in range(20) for j in (k, (k + 1) % 20)]
    c, made = counting(spark.createDataFrame(pairs, "s1_id string, t_id string, src int, ord long, score double"), "s1_id")
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(20)], "s1_id string, t_id string")
    scored = pipelines.trained("method2", c, s1, pool, truth, s1.selectExpr("entity_id as s1_id"), trees=2, depth=2)
    assert scored.count() == 40 and made.value == 40
    c, made = counting(c, "t_id")
    assert blocking.audit(c, truth, 20, 20).first().recall == 1 and made.value == 40


def test_hashed_vectors_count_the_trigrams_of_each_place(spark):
    import time

    from pyspark.sql import functions as F

    r = random.Random(6)
    df = spark.createDataFrame([("",), ("ab",), *((" ".join(r.choices(["acme", "steel", "é", "12"], k=30)),) for _ in range(600))], "t string").repartition(1).cache()
    n = F.transform(F.concat(T.char(F.col("t")), F.array(F.lit("#"))), lambda g: F.pmod(F.xxhash64(g), F.lit(64)))
    step = F.aggregate(n, F.array_repeat(F.lit(0.0), 64), lambda a, k: F.transform(a, lambda x, i: x + F.when(i == k, 1.0).otherwise(0.0)))
    assert df.limit(200).select(blocking.hashed_vectors(F.col("t")) == blocking.unit(step)).distinct().collect() == [(True,)]
    took = []
    for v in (blocking.hashed_vectors(F.col("t")), blocking.K.let(step, blocking.unit)):
        began = time.time()
        df.select(F.sum(v[0])).collect()
        took.append(time.time() - began)
    assert took[0] < took[1]


def test_features_join_texts_once_and_clean_them_once_an_entity(spark):
    """Texts went with the pairs through four joins, and each pair was cleaned anew."""
    from kinmatch.queries import Q

    plan = Q["features_method5"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4  # keys that are rare, pairs, both sides
    above, _ = plan.split("Join Inner", 1)
    assert "regexp_replace" not in above


def test_windows_of_version2_take_no_texts(spark):
    """Both sides' texts were dealt by S1 for the candidate list's context before the kernels read them."""
    from kinmatch.queries import Q

    plan = Q["features_version2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.rsplit("Window", 1)
    assert "pairwise" not in above and "pairwise" in below and "c1#" not in above


def test_blocks_are_dealt_as_texts(spark):
    """Their trigrams took three times the disk."""
    rows = spark.createDataFrame([(f"S{s}-{k}", s, "US", f"acme w{k} steel", "1 road", k) for s in (1, 2) for k in range(4)], "entity_id string, src int, country string, name string, addr string, ord long")
    plan = blocking.tfidf_topk(rows.where("src = 1"), rows.where("src = 2"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [k for k, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert len(at) == 2 and all("AS terms" in plan[k - 1] for k in at)


def test_pairs_of_a_country_are_not_dealt(spark):
    """Each pair was shuffled twice for its texts."""
    from kinmatch.queries import Q

    df = Q["kernels_native"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("RepartitionByExpression")[0].count("Join ") == 1 and df.count() == df.select("s1_id", "t_id").distinct().count() > 0


@pytest.mark.parametrize("name", ["method2", "method3", "method4", "version2"])
def test_plans_give_their_matches(spark, monkeypatch, name):
    """Their probabilities went out, so that the last stage (claims, a threshold) had no effect."""
    from kinmatch import queries

    rows = scored(spark, [("a", "2x", 0.9), ("b", "2x", 0.8), ("b", "3y", 0.5), ("c", "3z", 0.4)])
    take = lambda *a, **how: queries.pipelines.Linkage(rows, rows, assign.claims(rows, 0.5))
    monkeypatch.setattr(queries.pipelines, name, take)
    monkeypatch.setattr(queries, "learning", lambda *a: (None,) * 4)
    monkeypatch.setattr(queries, "dense", lambda *a: (None,) * 2)
    got = queries.Q[f"pipeline_{name}"](spark, "").collect()
    assert sorted(map(tuple, got)) == [("a", "2x", 0.9), ("b", "3y", 0.5)]


def test_sparse_candidates_are_those_of_all_pairs_without_a_table_of_them(spark):
    """The table of all pairs of a common term was shuffled."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(12)
    words = ["acme", "foods", "steel", "north", "river", "12", "77", "560001", *(f"w{k}" for k in range(60))]
    make = lambda s, n: [(f"S{s}-{k}", s, r.choice(["X", "Y", None]), " ".join(r.choices(words, k=r.randint(0, 3))) or None, " ".join(r.choices(words, k=2)), k) for k in range(n)]
    a, b = make(1, 90), make(2, 120) + make(3, 60)
    s1 = spark.createDataFrame([*a, a[0], ("S1-3", 1, "X", "acme w5", "12", 900)], ENTITY)
    pool = spark.createDataFrame([*b, *b[:9], ("S2-5", 2, "X", "acme w5 north", "12", 901)], ENTITY)
    text = blocking.X.blocking_text(blocking.X.name_v2("name"), blocking.X.address_v2("addr"))
    q, p = blocking.docs(s1, text, True), blocking.docs(pool, text, True)
    tf = [T.frequencies(d, T.word_pairs(blocking.F.col("text")), True) for d in (q, p)]
    vocab = T.vocabulary(tf[0].unionByName(tf[1]), q.unionByName(p), 2, 30)
    columns = ["s1_id", "t_id", "src", "ord", "score", "rank"]
    want = blocking.top(blocking.product(T.weights(tf[0], vocab), T.weights(tf[1], vocab), 0.1), 4, ("s1_id",)).select(columns)
    got = blocking.sparse(s1, pool, 4, 30)
    assert sorted(got.select(columns).collect()) == sorted(want.collect()) and want.count() > 100
    assert "wq#" not in got._jdf.queryExecution().optimizedPlan().toString()

    terms = lambda n: pa.table({"id": [f"{k % 37}" for k in range(n)], "ord": list(range(n)), "terms": [r.choices(words, k=3) for _ in range(n)]})
    left, right = (blocking.Postings(terms(50), pa.array(words), np.ones(len(words)), False) for _ in "ab")
    whole, cut = (pa.concat_tables(blocking.best_by_products(left, right, 0, 3, 0.1, most)) for most in (1 << 20, 9))
    assert whole.equals(cut) and whole.num_rows > 50


def test_best_by_jaccard_are_those_of_all_pairs_without_a_table_of_them(spark):
    """The table of all pairs of a common shingle was shuffled."""
    import pyarrow as pa

    r = random.Random(13)
    words = ["acme", "foods", "steel", "north", "river", "12", "77", *(f"w{k}" for k in range(40))]
    make = lambda s, n: [(f"S{s}-{k}", s, r.choice(["X", "Y", None]), " ".join(r.choices(words, k=r.randint(0, 3))) or None, " ".join(r.choices(words, k=3)), k // 2) for k in range(n)]
    s1, pool = spark.createDataFrame(make(1, 90), ENTITY), spark.createDataFrame(make(2, 150) + make(3, 60), ENTITY)
    keys, columns = blocking.shingles(), ["s1_id", "t_id", "src", "ord", "score", "rank"]
    common = blocking.key_pairs(s1, pool, keys, keep_first=6).groupBy("s1_id", "t_id", "src", "ord").count()
    sets = lambda e, i: e.select(blocking.F.col("entity_id").alias(i), keys.alias(f"set_{i}"))
    found = common.join(sets(s1, "s1_id"), "s1_id").join(sets(pool, "t_id"), "t_id")
    want = blocking.top(found.selectExpr("s1_id", "t_id", "src", "ord", "round(count / size(array_union(set_s1_id, set_t_id)), 6) as score").where("score >= 0.1"), 2)
    for block in (16, 32768):
        got = blocking.jaccard_best(s1, pool, keys, 6, 2, 0.1, block)
        assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect()) and want.count() > 100
    plan = blocking.dual_index(s1, pool)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan and plan.count("flatMapCoGroupsInArrow") + plan.count("FlatMapCoGroupsInArrow") == 2

    table = lambda n: pa.table({"id": [f"{k}" for k in range(n)], "ord": list(range(n)), "keys": [r.sample(words, k=3) for _ in range(n)]})
    a, b = table(50), table(40)
    whole, cut = (pa.concat_tables(blocking.best_by_jaccard(a, b, b.slice(0, 0), 2, 3, 0.1, most)) for most in (1 << 20, 5))
    assert whole.equals(cut) and whole.num_rows > 50


def test_rule_scores_clean_texts_once_an_entity(spark):
    """Each pair was cleaned anew, and its names were taken apart by three kernels of their own."""
    from kinmatch.queries import Q

    plan = Q["score_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, _ = plan.split("Join Inner", 1)
    assert "regexp_" not in above and above.count("pairwise(") == 3


def test_rule_scores_of_blocks_are_those_of_pairs(spark, tmp_path):
    """Each pair went to Spark's workers on its own with all its texts. Long texts of S2 still do."""
    from pyspark.sql import functions as F

    from kinmatch.operators import scoring
    from kinmatch.queries import Q, same_country

    r = random.Random(14)
    words = ["acme", "foods", "Ltd", "société", "汉字", "0042", "12345", "the", "#", "\u3390", "north"]
    name = lambda k: r.choice([None, "", "Supplier#%09d" % k, "Customer#%09d" % (k % 7), " ".join(r.choices(words, k=r.choice([1, 2, 3, 25])))])
    table = lambda n, columns, *more: spark.createDataFrame([(k, k % 3, name(k), *(r.choice(x) for x in more)) for k in range(n)], columns)
    table(60, "s_suppkey long, s_nationkey int, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    table(150, "c_custkey long, c_nationkey int, c_name string, c_mktsegment string", ["BUILDING", "AUTOMOBILE 98765", "é" * 9, "long " * 12]).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "a", "b", "c")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "FRANCE"), (1, "PERU"), (2, None)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    pairs = same_country(spark, str(tmp_path), texts=scoring.gate_texts)
    want = sorted(map(tuple, scoring.gated_score(pairs, True).select("s1_id", "t_id", F.round("rule_score", 6)).collect()))
    got = Q["score_rules"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2000 and sum(x[2] > 0 for x in want) > 100
    assert 0 < same_country(spark, str(tmp_path), only=scoring.long_texts).count() < 1500
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rule_scores_do_not_depend_on_the_size_of_blocks(monkeypatch):
    import pyarrow as pa

    from kinmatch.operators import scoring

    r = random.Random(16)
    words = ["acme", "foods", "0042", "12345", "north", "river"]
    text = lambda: " ".join(r.choices(words, k=r.choice([0, 1, 2, 3])))
    rows = [{"src": 1 + k % 2, "id": f"{k}", "c": text(), "d": text(), "pin": r.choice([None, "", "12345", "0"]), "num": r.choices(words[2:4], k=r.choice([0, 1, 2]))} for k in range(100)]

    def scores() -> dict:
        found = [x for t in scoring.meet(iter([pa.RecordBatch.from_pylist(rows[:70]), pa.RecordBatch.from_pylist(rows[70:])])) for x in t.to_pylist()]
        pairs = [(s, t, x["score"][k * len(x["t"]) + n]) for x in found for k, s in enumerate(x["s1"]) for n, t in enumerate(x["t"])]
        assert all(len(x["score"]) == len(x["s1"]) * len(x["t"]) for x in found)
        return sorted(pairs)

    whole = scores()
    for module, name, size in ((scoring, "BLOCK", 90), (scoring, "SOME", 7), (scoring, "ROW", 30), (scoring.P, "COLUMNS", 11)):
        monkeypatch.setattr(module, name, size)
        assert scores() == whole
    assert len(whole) == 2500 and len({x[2] for x in whole}) > 50


def test_rounded_as_spark_does(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from kinmatch.operators import scoring

    r = random.Random(15)
    values = [r.random() for _ in range(300)] + [k / 1e7 for k in r.choices(range(5, 10**7, 10), k=300)] + [0.1 + 0.0000005 + k / 1e3 for k in range(300)] + [0.0, 1.0]
    want = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(F.round("v", 6)).collect()]
    assert scoring.rounded(np.array(values)).tolist() == want


def test_kernels_of_a_pair_share_their_work(spark):
    """Five kernels took the names from the pairs one after another."""
    from kinmatch.queries import Q

    df = Q["kernels_udf"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("pairwise(") == 1
    assert df.columns == ["s1_id", "t_id", "ratio", "token_sort", "token_set", "partial", "weighted"]


def test_words_of_addresses_are_taken_once_an_entity(spark):
    """Each pair split both addresses anew, and looked for common words three times."""
    from kinmatch.queries import Q

    plan = Q["kernels_native"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "split(" not in above and "split(" in below and above.count("array_intersect(") == 1 and "array_union(" not in above


def test_method5_takes_whole_texts(spark, tmp_path, monkeypatch):
    """Of each text 18 words were looked at."""
    from kinmatch import queries

    texts = [" ".join(f"w{k}" for k in range(40)), None, "one", " ".join(f"w{k}" for k in range(30))]
    spark.createDataFrame([(3 * k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(queries.pipelines, "method5", lambda s1, *a, **how: seen.append(s1) or queries.pipelines.Linkage(*[spark.createDataFrame([], "s1_id string, t_id string, score double")] * 3))
    queries.Q["pipeline_method5"](spark, str(tmp_path))
    got = {e.ord: f"{e.name} {e.addr}".strip() for e in seen[0].collect()}
    assert got == {3 * k: t or "" for k, t in enumerate(texts)}


def test_trigrams_of_long_texts(spark):
    text = "".join(random.Random(4).choices("ab é\U0001f600", k=700))
    df = spark.createDataFrame([(text,), (text[:512],), (text[:513],)], "t string")
    for t, g in df.select("t", T.grams(blocking.F.col("t"))).collect():
        assert g == [t[k : k + 3] for k in range(len(t) - 2)]
