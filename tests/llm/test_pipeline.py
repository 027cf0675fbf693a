"""The stages of corpus_pipeline against plain Python, on rows with nulls, repeats, ties and columns of clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import test_operators as T

import tiktoken



import corpus_pipeline
from kinmatch.llm import byte_bpe, language_id, quality

CLASH = ("doc_id", "text", "lang", "source", "n_chars", "n_words", "n_hit", "stats", "kept", "_row", "_w", "_places", "row", "print", "hash", "contaminated", "less")


def made():
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghijklmno", k=r.randint(2, 7)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(r.randint(6, 20))) for _ in range(n))
    texts = [text(r.randint(2, 6)) for _ in range(60)]
    texts += [" ".join(f"{word()}###" for _ in range(40)) for _ in range(30)]
    item = " ".join(word() for _ in range(14))
    texts += [texts[3], texts[3], texts[5] + " tail", text(2) + "\n" + item, texts[7] + "\n" + texts[8].split("\n")[0], "few words", "", None, None, text(3), "same " * 40, texts[9].replace("a", "A")]
    rows = [[k, t] for k, t in enumerate(texts)]
    rows += [[None, text(3)], [None, text(4)], [None, texts[11]], [20, text(3)], [21, texts[21]]]
    labels = [(k, int(k < 60 or k >= 90), 0) for k in range(len(texts))] + [(5, None, 0), (None, 0, 1)]
    return rows, labels, [(1, item), (2, None), (3, "zz yy")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = made()
    at = str(tmp_path_factory.mktemp("corpus"))
    full = [(*r, "en", "s", len(r[1] or ""), *(f"own {c}" for c in CLASH[5:])) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH[5:])
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def first(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def deduplicated(rows):
    """Lines that repeat, or from 16 characters on nearly do, but for the first, by id (none first) and place."""
    place = lambda r: (r[0] is not None, r[0] or 0)
    every = sorted({(place(r), k, s.strip()) for r in rows for k, s in enumerate((r[1] or "").split("\n")) if s.strip()})
    lines = sorted({x[2] for x in every})
    near = [(a, b) for a, b in itertools.combinations([x for x in lines if len(x) >= 16], 2) if abs(len(a) - len(b)) <= 2 and T.edits(a, b) <= 2]
    group, held, gone = T.groups(lines, near), {}, set()
    for p, k, s in every:
        if held.setdefault(group[s], (p, k)) != (p, k):
            gone.add((p, k))
    out = []
    for r in rows:
        less = [s for k, s in enumerate((r[1] or "").split("\n")) if (place(r), k) not in gone]
        touched = any((place(r), k) in gone for k in range(len((r[1] or "").split("\n"))))
        if not touched:
            out.append(list(r))
        elif "".join(less).strip(" \t\n\r"):
            out.append([r[0], "\n".join(less)])
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def as_pairs(rows):
    return sorted(((i, t) for i, t in rows), key=repr)


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rules = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules
    rows = made()[0]

    def good(t):
        n, chars, symbols, dup, repeat = T.statistics(t or "")
        lines = len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        t = t or ""
        x = {"symbol_share": symbols / max(n, 1), "repeat_share": repeat / max(n, 1), "dup_line_share": dup / max(lines, 1), "upper_share": len(re.findall("[A-ZÀ-Þ]", t)) / max(chars, 1)}
        x |= {"mark_share": len(re.findall("[!?]", t)) / max(n, 1), "digit_share": len(re.findall("[0-9]", t)) / max(chars, 1)}
        base = n < 10 or 100 * repeat > 20 * n
        return not base and not any(all(c({k: np.array([v]) for k, v in x.items()})[0] for c in rule) for rule in rules)

    docs = corpus_pipeline.quality_rules(spark, docs, folder)
    rows = [r for r in rows if good(r[1])]
    assert docs.columns == columns and pairs(docs) == as_pairs(rows) and 40 < len(rows) < 80
    assert {tuple(r)[5:] for r in docs.collect()} == {tuple(f"own {c}" for c in CLASH[5:])}

    docs = corpus_pipeline.line_dedup_stage(spark, docs, folder)
    rows = deduplicated(rows)
    assert docs.columns == columns and pairs(docs) == as_pairs(rows)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = corpus_pipeline.simhash_dedup(spark, docs, folder)
    prints = [T.fingerprint(t or "") for _, t in rows]
    group = T.groups(sorted(set(prints)), [(a, b) for a, b in itertools.combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= 3])
    held = {}
    for r, p in zip(rows, prints, strict=True):
        held.setdefault(group[p], []).append(r)
    got = pairs(docs)
    assert docs.columns == columns and len(got) == len(held)
    assert {group[T.fingerprint(t or "")] for _, t in got} == set(held)
    for i, t in got:
        mine = held[group[T.fingerprint(t or "")]]
        assert [i, t] in mine and (i is None, i or 0) == min((x[0] is None, x[0] or 0) for x in mine)
    assert sum(i is None for i, _ in got) >= 2 and sum(i == 20 for i, _ in got) == 2  # different texts of one id, or of none, stay
    rows = got

    docs = corpus_pipeline.decontaminate(spark, docs, folder)
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    windows = {tuple(w[k : k + 10]) for _, s in made()[2] if (w := split(s)) for k in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[k : k + len(win)]) == win for w in [split(t)] for win in windows for k in range(len(w) - len(win) + 1))
    rows = [r for r in rows if not hit(r[1])]
    assert docs.columns == columns and pairs(docs) == as_pairs(rows) and len(rows) < len(got)

    out = corpus_pipeline.byte_bpe_stage(spark, docs, folder).collect()
    m = byte_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=m.ranks, special_tokens={})
    want = [(i, *(lambda ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest()))(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, corpus_pipeline.run(spark, folder).collect()))) == sorted(map(repr, want))


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_with_and_without_the_operators(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names


def test_repeated_windows_that_share_hash_bits(spark, monkeypatch):
    """Unlike windows that meet in the sort do not hide equal ones: all hashes alike."""
    r = random.Random(3)
    texts = [" ".join(r.choices("abc", k=r.randint(0, 40))) for _ in range(60)]
    expr = quality.F.expr
    monkeypatch.setattr(quality.F, "expr", lambda s: expr(re.sub(r"xxhash64\([^)]*\)", "0L", s)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.n_repeat_words for x in quality.add_statistics(df).orderBy("doc_id").collect()] == [T.statistics(t)[4] for t in texts]


def test_numerals_are_no_letters():
    assert language_id.letters("½ ² Ⅷ 12") == [] and language_id.letters("a½b Été") == ["a", "b", "été"]
