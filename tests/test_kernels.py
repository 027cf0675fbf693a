import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinmatch.functions import kernels as K

WORDS = st.text("abc d", max_size=12)


@pytest.mark.parametrize(("a", "b", "value"), [("kitten", "sitting", 61.5385), ("acme foods", "foods acme", 50.0), ("abcd", "abed", 75.0), ("", "", 100.0), ("a", "", 0.0)])
def test_ratio(a, b, value):
    assert K.ratio(a, b) == pytest.approx(value, abs=1e-4)


def test_token_ratios():
    assert K.token_sort("acme foods", "foods acme") == 100
    assert K.token_set("acme foods ltd", "acme foods") == 100
    assert K.token_set("", "x") == 0
    assert K.partial("acme", "the acme foods") == 100
    assert K.weighted("", "x") == 0
    assert K.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert K.jaro_winkler("", "") == 1 and K.jaro_winkler("", "a") == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_kernels_hold_their_bounds(a, b):
    assert K.common_length(a, b) == lcs(a, b)
    for f, most in ((K.ratio, 100), (K.token_sort, 100), (K.token_set, 100), (K.partial, 100), (K.weighted, 100), (K.jaro_winkler, 1)):
        assert -1e-9 <= f(a, b) <= most + 1e-9
        assert f(a, b) == pytest.approx(f(b, a))
    if a and b:
        s, t = sorted((a, b), key=len)
        windows = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))]
        assert K.partial(a, b) >= max(K.ratio(s, w) for w in windows) - 1e-9


def test_native_kernels(spark):
    from pyspark.sql import functions as F

    rows = [("banana", "bananas", 0.92582), ("acme foods", "foods acme", 0.625), ("ab", "ac", 0.0), ("", "x", 0.0), ("ab", "ab", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    for r in df.select("v", K.trigram_cosine(F.col("a"), F.col("b")).alias("c"), K.levenshtein(F.col("a"), F.col("b")).alias("l")).collect():
        assert r.c == pytest.approx(r.v, abs=1e-5) and 0 <= r.l <= 1
    assert spark.createDataFrame([("", "")], "a string, b string").select(K.levenshtein(F.col("a"), F.col("b"))).first()[0] == 1
    K.register(spark)
    assert spark.sql("SELECT sim_token_sort('b a', 'a b')").first()[0] == 100


def test_batches_equal_the_plain_kernels():
    """Pairs of one batch with lengths, characters and repeats of all kinds: the very same values."""
    import random

    import pandas as pd

    r = random.Random(4)
    words = ["a", "of", "reedes", "ñandú", "汉字", "x" * 40, "Onsh", "00077", "\x00", "\x01\x02", "😀"]
    text = lambda: r.choice(["", " "]) + " ".join(r.choices(words, k=r.choice([0, 1, 2, 6, 6, 30])))
    short = lambda: "".join(r.choices("ab c", k=r.randint(0, 14)))
    pairs = [(f(), f()) for f in (text, short) for _ in range(400)] + [("z" * 300, "z" * 299), ("z" * 254, "z" * 253 + "y"), ("", "")] * 2
    a, b = (pd.Series(s) for s in zip(*pairs, (None, "x"), strict=True))
    for name, plain in K.KERNELS.items():
        assert K.of_batch(name, a, b).tolist() == [plain(x or "", y or "") for x, y in zip(a, b, strict=True)], name


def test_a_batch_of_partial_ratios_is_worked_out_at_once():
    """A window at a time took 300 microseconds a pair and more."""
    import time

    import pandas as pd

    a, b = (pd.Series([f"{k * s % 9973:014b} the reedes of onsh {k * s % 7919:014b}" for k in range(4000)]) for s in (31, 47))
    took = time.process_time()
    K.of_batch("partial", a, b)
    batch, took = time.process_time() - took, time.process_time()
    for x, y in zip(a[:400], b[:400], strict=True):
        K.partial(x, y)
    assert batch < 10 * (time.process_time() - took) / 4


def test_kernels_that_share_their_work_equal_single_ones():
    import random

    import numpy as np

    from kinmatch.functions import batches as B

    r = random.Random(5)
    text = lambda: " ".join(r.choices(["a", "of", "reedes", "ñandú", "x" * 40, "00077"], k=r.choice([0, 1, 2, 6, 20])))
    a, b = ([text() for _ in range(300)] for _ in range(2))
    for names in (tuple(B.KERNELS), ("weighted", "token_set"), ("weighted",)):
        found = B.together(names, a, b)
        assert all(np.array_equal(found[name], B.KERNELS[name](a, b)) for name in names)


def test_trigram_cosine_of_batches_equals_the_expression(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(6)
    text = lambda: "".join(r.choices("aab ñ😀", k=r.choice([0, 1, 2, 3, 9, 30])))
    df = spark.createDataFrame([(text(), text()) for _ in range(300)], "a string, b string")
    rows = df.select(K.trigram_cosine(F.col("a"), F.col("b")).alias("x"), K.trigram_cosine_of_batches(F.col("a"), F.col("b")).alias("y")).collect()
    assert [x.x for x in rows] == [x.y for x in rows] and sum(0 < x.x < 1 for x in rows) > 20


def test_combed_windows_equal_those_looked_into():
    """Windows of long texts were looked into one by one."""
    import random

    r = random.Random(8)
    for n, m, letters in ((1, 1, "a"), (1, 9, "ab"), (7, 7, "abc"), (30, 90, "abcé "), (300, 420, "abcdefgh "), (257, 900, "ab")):
        for _ in range(4):
            a, b = ("".join(r.choices(letters, k=k)) for k in (n, m))
            assert K.best_window_combed(a, b) == K.best_window(a, b)


def test_kernels_of_products_equal_the_plain_ones():
    """All pairs of two lists, and some of them, with repeats, empty and long first texts: the very same values."""
    import random

    import numpy as np

    from kinmatch.functions import batches as B
    from kinmatch.functions import products as P

    r = random.Random(9)
    words = ["a", "of", "reedes", "ñandú", "汉字", "x" * 12, "Onsh", "00077", "12", "\x00", "😀", "of of"]
    text = lambda: r.choice(["", " "]) + " ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 6])))
    short = lambda: "".join(r.choices("ab c", k=r.randint(0, 14)))
    for make, more in ((text, ["z" * 64, "y" * 63 + "z", "ab" * 32]), (short, ["ab" * 8, "b" * 16]), (lambda: short() + short(), ["c" * 32])):
        b = [t for t in (make() for _ in range(80)) if len(t) <= P.LONGEST] + more
        a = [make() for _ in range(60)] + ["z" * 70, "zy" * 150, "ab" * 33] + b[:10] + more
        x, y = (list(t) for t in zip(*((s, t) for s in a for t in b), strict=True))
        for f in (P.common_lengths, P.ratio, P.token_sort, P.jaro_winkler):
            plain = B.common_length if f is P.common_lengths else getattr(B, f.__name__)
            assert np.array_equal(f(a, b).ravel(), plain(x, y)), f.__name__
        for step in (1, 23):  # by a matrix, and by pairs
            i, j = np.divmod(np.arange(0, len(x), step), len(b))
            u, v = x[::step], y[::step]
            assert np.array_equal(P.common_of(a, b, i, j), B.common_length(u, v)) and np.array_equal(P.ratio_of(a, b, i, j), B.ratio(u, v))
            assert np.array_equal(P.token_set_of(a, b, i, j), B.token_set(u, v))
            assert np.array_equal(P.weighted_of(a, b, i, j, B.token_sort(u, v)), B.weighted(u, v))
