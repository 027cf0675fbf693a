import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, labels string, spans string, component_id long"


def words(r, n, syllables=("al", "be", "ca", "do", "er", "fi")):
    return [("".join(r.choices(syllables, k=r.randint(1, 3)))) for _ in range(n)]


def texts():
    """Invented texts: copies, near-copies, shared passages, repeats, marks, long, empty and null ones."""
    r = random.Random(9)
    passage = " ".join(words(r, 60))
    out = [" ".join(words(r, r.randint(1, 120))) + "\n" + " ".join(words(r, 12)) for _ in range(40)]
    out += [out[3], out[3], out[5].replace("al", "AL"), out[7][:-1] + "x", out[7] + "y"]
    out += [f"{out[k]} {passage} {out[k + 1]}" for k in (10, 20, 30)]
    out += ["la " * 200, "one two three four five six seven\none two three four five six seven\n" * 3, "### $$$ ### | <>" * 9]
    out += [" ".join(words(r, 9000)), "x" * 70_000, "á é \U0001f600 中文 İ \x1c\x85   b", "", None, "   \n\t ", "\n\n", "A", "a b", "a B c"]
    out += ["Mail joe.q+x@mail3.example.com or +1 (377) 555-0271 from 10.0.255.1, card 4111 1111 1111 1111; 1.2.3.400 4111111111111112 a@b +12 3"]
    out += ["a@b.c%x@d.e f@g.h\nMIT License and the Apache License, the GNU General Public License; license mit license", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    return out


@pytest.fixture(scope="session")
def rows():
    t = texts()
    made = [(k, x, ("en", "fr", None)[k % 3], "s", 0, -1, "clash", "clash", -5) for k, x in enumerate(t)]
    return [*made, made[4], (None, t[3], "en", None, None, None, None, None, None)]  # a repeated row and a null id


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
