"""Each operator against brute force on texts with nulls, empties, ties, repeated rows and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinmatch.llm import byte_bpe, decontamination, language_id, licences, line_dedup, pii, quality, simhash, substring_dedup, token_counts
from kinmatch.llm.buckets import members
from kinmatch.llm.common import connected_components


def key(r):
    return (r.doc_id is not None, r.doc_id or 0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def text_of(rows):
    return {r[0]: r[1] or "" for r in rows}


def groups(nodes, linked):
    """Smallest node reachable of each."""
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(out[a], out[b])
            if out[a] != low or out[b] != low:
                out[a] = out[b] = low
                changed = True
    return out


# -- token counts and BPE ----------------------------------------------------------------------------------------------


def test_token_counts(docs, rows, empty):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path, chunk_chars=3000, overlap_chars=64)
    assert got.count() == len(rows) and token_counts.count_tokens(empty, path).count() == 0
    for i, t in text_of(rows).items():
        r = by_id(got)[i] if i == 0 else None
        if r is not None:
            assert r.n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in text_of(rows).items()}
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in got.collect()} == {i: (n[i], len(t.encode()), n[i] > 2048) for i, t in text_of(rows).items()}


def test_resynchronisation_of_all_kinds():
    r = random.Random(2)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        c = token_counts.Counter(P.path(name))
        for _ in range(15):
            t = "".join(r.choice("ab 'st<|>endoftext\né中!9") for _ in range(r.randint(0, 900)))
            assert token_counts.resync_count(t, c.spans, 120, 8) == c.whole([t])[0]
        assert token_counts.resync_count("ab" * 400, c.spans, 100, 8) == c.whole(["ab" * 400])[0]  # no boundary at all
    special = ["<|endoftext|> a<|endoftext|>b", "don't I'LL"]
    c = token_counts.Counter(P.path("word_bpe_49k.json"))
    assert c.by_word and c.counts(special) == c.whole(special)
    assert not token_counts.Counter(P.path("byte_bpe_50k.json")).by_word


def test_byte_bpe(docs, rows, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in text_of(rows).items():
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = byte_bpe.encode_digests(docs, path, P.PATTERN)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want
    assert got.count() == len(rows) and byte_bpe.encode_digests(empty, path, P.PATTERN).count() == 0
    full = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.encode_texts(docs, path, P.PATTERN).collect()}
    assert full == text_of(rows)


def test_byte_bpe_of_odd_texts():
    path = P.path("byte_bpe_50k.tiktoken")
    m = byte_bpe.ByteBPE(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=m.ranks, special_tokens={})
    r = random.Random(4)
    alphabet = "ab 'st\n\téİ中!9\x1c\x1d 　​﻿\U0001f600٣"
    odd = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(800)] + ["a" * 3000, " " * 900, "ab" * 900, "x" * 300 + "\n"]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(odd)] == [enc.encode_ordinary(t) for t in odd]
    hard = [bytes(r.randrange(256) for _ in range(r.randint(2, 60))) for _ in range(300)]
    assert m.merge(hard) == [m.merge_long(x) for x in hard]


# -- decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, rows, empty):
    t = text_of(rows)
    item_rows = [(1, " ".join(t[50].split()[5:40]) if len(t[50].split()) > 40 else "x"), (2, "one TWO three"), (10, t[2]), (11, None), (12, ""), (None, "la la la la la la la la la la la"), (13, "zz yy"), (2, "one two three")]
    bench = spark.createDataFrame(item_rows, "item_id long, text string")
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    wins = [(i, tuple(w[k : k + 10])) for i, s in item_rows if (w := split(s)) for k in range(max(1, len(w) - 9))]
    want = {}
    for i, s in t.items():
        w, hit, ids = split(s), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {item} - {None}
        want[i] = (len(w), len(hit), len(ids), sorted(map(str, ids)), bool(hit))
    for block in (100_000, 3):
        got = decontamination.decontaminate(docs, bench, block_windows=block)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in got.collect()} == want
    assert got.count() == len(rows) and decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontamination.decontaminate(docs.select("doc_id", "text", "lang"), bench, keep=["doc_id", "text", "lang"])
    assert sorted(x[0] for x in kept.select("lang").na.fill("-").collect()) == sorted((r[2] or "-") for r in rows)


# -- personal data -----------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(t):
    out, n = [], [0] * 4
    forms = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, form in enumerate(forms):
        for m in re.finditer(form, t):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
                n[k] += 1
    return n, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans(spark, docs, rows, empty):
    r = random.Random(8)
    odd = ["".join(r.choice("a.@-+1 25(%)é") for _ in range(60)) for _ in range(300)] + ["1." * 3000 + "1", "9" * 20_000, "a@" + "b." * 4000 + "c", "+1" + " " * 3000 + "2"]
    df = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    model = pii.Model(0.0, [], float("inf"))
    for frame, texts in ((docs, text_of(rows)), (df, {1000 + k: t for k, t in enumerate(odd)})):
        got = pii.find(frame, model).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
        for x in got:
            n, s = base_spans(texts[x.doc_id])
            assert ([x.n_email, x.n_ip, x.n_card, x.n_phone], x.b, x.s) == (n, s, s), texts[x.doc_id][:200]
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_boosting_adds_spans_and_redacts(spark):
    r = random.Random(3)
    phone = lambda plus: f"{plus}1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    texts = [f"call {phone('+')} now" for _ in range(150)] + [f"sum {r.randint(10**7, 10**8)} of {r.randint(100, 999)} units in {r.randint(10**6, 10**7)}" for _ in range(150)] + [f"call {phone('')} now" for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    assert np.isfinite(model.threshold)
    got = by_id(pii.find(df, model).select("doc_id", "spans", pii.listed("base").alias("b"), pii.listed("spans").alias("s")))
    assert all(set(x.b.split(",")) <= set(x.s.split(",")) for x in got.values() if x.b)
    assert not any(got[k].s for k in range(150, 300))  # plain sums stay
    out = pii.find(df, model).join(df, "doc_id").select("doc_id", pii.redact("spans", "text").alias("t"))
    assert {x.t for x in out.where("doc_id < 150").collect()} == {"call [phone] now"}


def test_boosting_adds_spelled_out_addresses_and_phones(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    phone = lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    texts = [f"write to {word()}{r.choice(['', '7'])}@{word()}.{word()}.com today" for _ in range(150)] + [f"look {word()} at {word()}. {word()} is there" for _ in range(150)]
    texts += [f"call +1 {phone()} now" for _ in range(150)] + [f"sum {r.randint(10**7, 10**8)} of it" for _ in range(150)]
    added = [f"{word()} (at) {word()} (dot) com", f"{word()} [at] {word()} [dot] {word()} [dot] com", f"1 {phone()}"]
    texts += [f"write to {added[0]} today", f"write to {added[1]} today", f"call {added[2]} now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find(df, pii.fit(df)).select("doc_id", pii.listed("spans").alias("s")))
    for k, (kind, low) in enumerate((("handle", 9), ("handle", 9), ("number", 5))):
        assert got[600 + k].s == f"{kind}:{low}:{low + len(added[k])}"
    assert not any(got[k].s for k in [*range(150, 300), *range(450, 600)])


# -- quality -----------------------------------------------------------------------------------------------------------


def statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_statistics(docs, rows, empty):
    got = quality.judge(docs.select("doc_id", "text"), []).collect()
    assert len(got) == len(rows)
    for x in got:
        s = statistics(text_of(rows)[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == s
        assert x.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and x.kept == (not x.base_failed)
    assert quality.judge(empty.select("doc_id", "text"), []).count() == 0
    assert quality.fit(empty.select("doc_id", "text"), empty.selectExpr("doc_id", "1 as quality")) == []
    assert docs.select("doc_id", "text").transform(lambda d: quality.judge(d, [])).where("kept and n_symbols = 0").count() >= 0  # filters on statistics end


def test_rules_separate():
    r = np.random.RandomState(1)
    x = {"a": r.rand(900), "b": r.rand(900)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["b"] > 0.95)
    rules = quality.learn_rules(x, bad)
    said = np.zeros(900, bool)
    for rule in rules:
        said |= quality.covers(rule, x, 900)
    assert (said & bad).sum() > 0.9 * bad.sum() and (said & ~bad).sum() < 0.02 * (~bad).sum()
    assert quality.learn_rules(x, np.zeros(900, bool)) == []


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [2048, 3])
def test_simhash(docs, rows, empty, most):
    f = {i: fingerprint(t) for i, t in text_of(rows).items()}
    ids = [i for i in f if i is not None]
    want = groups(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (f[a] ^ f[b]).bit_count() <= 3])
    got = simhash.near_duplicates(docs, most=most).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.fingerprint == f"{f[x.doc_id]:016x}"
        assert x.component_id == want[3 if x.doc_id is None else x.doc_id]
    assert simhash.near_duplicates(empty).count() == 0


def test_pivots_lose_no_link():
    r = np.random.RandomState(0)
    centre = r.randint(0, 2**63, 6).astype(np.uint64)
    prints = np.concatenate([c ^ (np.uint64(1) << r.randint(0, 64, (60, 4)).astype(np.uint64)).sum(axis=1).astype(np.uint64) for c in centre])
    prints = np.unique(prints)
    ids = np.arange(len(prints))
    a, b = simhash.close_links(np.zeros(len(prints), np.int64), prints, ids, 3)
    want = groups(ids.tolist(), [(i, j) for i, j in itertools.combinations(ids.tolist(), 2) if int(prints[i] ^ prints[j]).bit_count() <= 3])
    assert groups(ids.tolist(), list(zip(map(int, a), map(int, b), strict=True))) == want and len(a) < len(ids)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, s, n):
    b = list(s)
    for _ in range(n):
        p, o = r.randrange(len(b)), r.random()
        if o < 0.3:
            b.insert(p, "z")
        elif o < 0.6:
            b.pop(p)
        else:
            b[p] = "y"
    return "".join(b)


def test_edit_distance_and_segments():
    r = random.Random(4)
    for _ in range(4000):
        a = "".join(r.choice("aab") for _ in range(r.randint(1, 14)))
        b, k = changed(r, a, r.randint(0, 1) if len(a) < 4 else r.randint(0, 3)), r.randint(1, 3)
        assert line_dedup.within(a, b, k) == (edits(a, b) <= k), (a, b, k)
    for _ in range(1500):
        a = "".join(r.choice("abcd") for _ in range(r.randint(18, 30)))
        b = changed(r, a, r.randint(0, 2))
        raws = [s.encode("utf-32-le") for s in (a, b)]
        (x, p), (y, q) = (line_dedup.signatures(raw, len(raw) // 4, 2, 16) for raw in raws)
        assert set(x) & {*y, *q} or set(y) & {*x, *p}
        h = line_dedup.histograms(raws)
        assert line_dedup.histogram_distance(h[:1], h[1:])[0] <= 4


@pytest.mark.parametrize("most", [2048, 4])
def test_line_dedup(spark, docs, rows, empty, most, monkeypatch):
    monkeypatch.setattr(line_dedup.links, "__defaults__", (*line_dedup.links.__defaults__[:-1], most))
    r = random.Random(5)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randint(3, 9))) for _ in range(25)]
    more = [(500 + k, "\n".join(changed(r, r.choice(base), r.randint(0, 3)) for _ in range(r.randint(0, 5)))) for k in range(80)]
    df = docs.select("doc_id", "text", "labels").unionByName(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'x' as labels"))
    texts = text_of(rows) | dict(more)
    occ = sorted(((i is not None, i or 0), k, line) for i, t in texts.items() for k, line in line_dedup.lines(t, 16))
    lines = sorted({x[2] for x in occ})
    close = [(a, b) for a, b in itertools.combinations(lines, 2) if abs(len(a) - len(b)) <= 2 and len(a) < 400 and edits(a, b) <= 2]
    close += [(a, b) for a, b in itertools.combinations([x for x in lines if len(x) >= 400], 2) if line_dedup.within(a, b, 2)]
    cls, first, want = groups(lines, close), {}, {}
    for i, k, line in occ:
        first.setdefault(cls[line], (i, k))
        if first[cls[line]] != (i, k):
            want.setdefault(i, []).append(k)
    got = {(x.doc is not None, x.doc or 0): x.places for x in line_dedup.removals(df).collect()}
    assert got == {i: sorted(v) for i, v in want.items()} and close
    left = line_dedup.deduplicate(df)
    for x in left.collect():
        gone = want.get((x.doc_id is not None, x.doc_id or 0), [])
        assert (x.text or "") == "\n".join(s for k, s in enumerate(texts[x.doc_id].split("\n")) if k not in gone)
    assert left.columns == df.columns and line_dedup.removals(empty).count() == 0


def test_short_lines_go_as_exact_repeats(spark, tmp_path):
    from kinmatch.llm.registry import QUERIES

    texts = ["top\n\nshort line\nsome words of one long line", " short line \nshort lime\n\n", "top\nshort line\nsome words of one long lime", None, "top"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                if line.strip() in seen:
                    want.setdefault(i, []).append(k)
                seen.add(line.strip())
    want[2].append(2)  # within two edits
    got = {x.doc_id: x.removed for x in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(map(str, want.get(i, []))) for i in range(5)}
    assert {x.doc_id: x.text for x in line_dedup.deduplicate(df, exact_chars=1).collect()} == {0: texts[0], 1: "short lime\n\n", 3: None}


def test_simhash_stage_keeps_a_row_of_each_group(spark, docs, rows, empty):
    import corpus_pipeline

    r = random.Random(31)
    one, two = (" ".join(r.choices("abcdefghij", k=40)) for _ in range(2))
    more = [(None, one + " " + two), (None, two + " " + one), (None, two + " " + one), (None, one), (None, two), (None, one), (7, one), (900, two + " x y z"), (900, one + " u v w"), (901, None)]
    df = docs.select("doc_id", "text", "labels").unionByName(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'q' as labels"))
    every = [(x[0], x[1]) for x in rows] + more
    f = [fingerprint(t or "") for _, t in every]
    group = groups(sorted(set(f)), [(a, b) for a, b in itertools.combinations(sorted(set(f)), 2) if (a ^ b).bit_count() <= 3])
    held = {}
    for (i, t), x in zip(every, f, strict=True):
        held.setdefault(group[x], []).append((i is None, i or 0, t))
    got = corpus_pipeline.simhash_dedup(spark, df, "").collect()
    assert len(got) == len(held) and {group[fingerprint(x.text or "")] for x in got} == set(held)
    for x in got:
        assert (x.doc_id is None, x.doc_id or 0) == min(h[:2] for h in held[group[fingerprint(x.text or "")]])
    assert sum(x.doc_id is None for x in got) == sum(all(h[0] for h in v) for v in held.values()) > 0
    assert corpus_pipeline.simhash_dedup(spark, empty, "").count() == 0


@pytest.mark.parametrize("most", [1024, 3])
def test_substring_dedup(docs, rows, empty, most):
    got = substring_dedup.deduplicate(docs, most=most).collect()
    assert len(got) == len(rows) and substring_dedup.deduplicate(empty).count() == 0
    found = {x.doc_id: x for x in got}
    w = {i: (t or "").encode().lower().split() for i, t in text_of(rows).items() if i is not None}
    shared = lambda a, b, n: {tuple(w[a][k : k + n]) for k in range(len(w[a]) - n + 1)} & {tuple(w[b][k : k + n]) for k in range(len(w[b]) - n + 1)}
    links = [(a, b) for a, b in itertools.combinations(w, 2) if len(w[a]) < 1000 and len(w[b]) < 1000 and shared(a, b, 51)]
    must = groups(list(w), links)
    assert links
    for a, b in links:
        assert found[a].component_id == found[b].component_id and found[a].n_repeat_words >= 24
    for i in w:
        assert found[i].component_id <= must[i]
        if found[i].component_id != i:  # a shared paragraph stands behind every link
            assert any(len(shared(i, j, 5)) > 0 for j in w if j != i and found[j].component_id == found[i].component_id)
    assert found[None].n_repeat_words == 0
    clean = [i for i in w if not any(i != j and shared(i, j, 5) for j in w) and statistics(text_of(rows)[i])[4] == 0]
    assert clean and all(found[i].component_id == i and found[i].n_removed_words == 0 for i in clean)


def test_repeats_and_near_copies_are_found_whole(spark):
    r = random.Random(21)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, spots, edited = [], {}, []
    for k in range(120):
        size, n_edits = ((51, 0), (60, 0), (100, 0), (60, 1), (100, 2), (200, 4))[k % 6]
        one = fresh(size)
        two = list(one)
        for at in r.sample(range(5, size - 5), n_edits):
            two[at] = f"x{k}x{at}"
        if len(w5(one) & w5(two)) < 0.8 * len(w5(one) | w5(two)):
            continue
        before = [fresh(r.randint(0, 60)) for _ in range(2)]
        for p, b in zip((one, two), before, strict=True):
            spots[len(texts)] = (len(b), len(b) + size, len(texts) % 2)
            texts.append(" ".join(b + p + fresh(r.randint(0, 60))))
        edited.append(n_edits)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in substring_dedup.deduplicate(df).collect():
        low, high, second = spots[x.doc_id]
        assert x.component_id == x.doc_id - second
        assert high - low <= x.n_repeat_words <= high - low + 4 and (x.n_removed_words, bool(x.removed)) == (second * x.n_repeat_words, bool(second))
        if second:  # a near-copied paragraph may go up to two words past an end
            a, b = map(int, x.removed.split(":"))
            assert low - 2 <= a <= low and high <= b <= high + 2
    assert edited.count(0) > 50 and edited.count(1) > 10 and sum(e > 1 for e in edited) > 10


def w5(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_components(spark):
    r = random.Random(6)
    for n in (0, 40):
        links = [(r.randrange(60), r.randrange(60)) for _ in range(n)] + [(k, k + 1) for k in range(100, 100 + n)] + ([(200, k) for k in range(201, 230)] if n else [])
        nodes = {x for p in links for x in p if p[0] != p[1]}
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = groups(nodes, [p for p in links if p[0] != p[1]])
        assert got == want


def test_large_buckets_lose_nothing(spark):
    df = spark.range(3000).selectExpr("case when id < 900 then 7L when id < 1000 then 8L else id end as bucket", "id as line")
    seen = set()

    def work(part):
        import pyarrow.compute as pc

        return {"key": pc.cast(part.column("key"), "int64").to_pylist(), "line": part.column("line").to_pylist()}

    for most in (10_000, 250, 20):
        got = members(df, ["line"], work, most, lambda d: d.checkpoint()).collect()
        pairs = {}
        for x in got:
            pairs.setdefault(x.key, set()).add(x.line)
        met = {p for g in pairs.values() for p in itertools.combinations(sorted(g), 2)}
        assert met >= {p for p in itertools.combinations(range(880, 900), 2)} | {(0, 899), (1, 450), (900, 999)}
        assert all(len(g) <= max(most * 3, 30) or most == 10_000 for g in pairs.values())
        seen |= met
    assert not any(a >= 1000 for a, _ in seen)


# -- licences and languages --------------------------------------------------------------------------------------------


def test_licences(docs, rows, empty):
    got = licences.scan(docs).collect()
    assert len(got) == len(rows) and licences.scan(empty).count() == 0
    for x in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_of(rows)[x.doc_id]))
        places = [(k, label) for p, label in licences.PHRASES for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        at = [k for k, _ in places]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert x.base_labels == ",".join(sorted({label for _, label in places}))
        share, extra = 0.0, set()
        for label, t, telling in licences.TEMPLATES:
            q = t.split()
            need = set(q)
            for k in range(len(w)):
                block = set(w[max(0, k - len(q) + 1) : k + len(q)])
                if w[k] in need and len(block & need) >= 0.8 * len(need) - 1e-9 and set(telling.split()) <= block:
                    extra.add(label)
                    share = max(share, len(block & need) / len(need))
        # A block about any token of the template is at least as wide as one about a rare one.
        assert set(x.labels.split(",")) - {""} >= {label for _, label in places}
        assert set(x.labels.split(",")) - {""} - {label for _, label in places} <= extra and x.score <= 1
    found = {x.doc_id: x for x in got}
    assert found[len(rows) - 3].labels == "cc-by-nc,mit"


def test_viterbi_is_exact():
    r = np.random.RandomState(0)
    for _ in range(60):
        s = [r.randn(r.randint(0, 6), 3).astype("f4") for _ in range(4)]
        for a, p in zip(s, language_id.viterbi(s, 0.7), strict=True):
            worth = lambda q, a=a: sum(a[i, k] for i, k in enumerate(q)) - 0.7 * sum(x != y for x, y in itertools.pairwise(q))
            if len(a):
                assert abs(worth(p) - max(map(worth, itertools.product(range(3), repeat=len(a))))) < 1e-4


def test_language_id(spark, docs, rows, empty):
    r = random.Random(1)
    en, fr = ["the", "thing", "other", "when", "with"], ["le", "une", "ceci", "eau", "quel"]
    train = [(k, " ".join(r.choices(en if k % 2 else fr, k=30)), "en" if k % 2 else "fr") for k in range(300)] + [(999, None, "en"), (998, "x", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out()))
    got = by_id(language_id.predict(df, model))
    held = [x.doc_id for x in df.where(language_id.held_out()).collect()]
    assert len(held) > 30 and all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in held if i < 300)
    mixed = model.predict([" ".join(en * 4 + fr * 4), None, "12 !", "中文"])
    assert mixed[0][2].tolist() == [0] * 20 + [1] * 20 and mixed[1][:2] == ("und", 0.0) and mixed[2][0] == "und" and mixed[3][0] in ("en", "fr")
    out = language_id.predict(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    none = language_id.fit(empty)
    assert {x.lang_pred for x in language_id.predict(docs, none).collect()} == {"und"} and language_id.predict(empty, model).count() == 0


def test_near_copies_by_brute_force(spark):
    """Recall of near-copied passages of over 50 words at five-word Jaccard 0.8 or more, in other texts, and clean words."""
    r = random.Random(33)
    fresh = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    texts, want = [], []
    while len(want) < 200:
        one = fresh(r.randint(51, 160))
        two = list(one)
        for _ in range(r.randint(1, 3)):
            p, what = r.randrange(len(two)), r.random()
            two[p : p + 1] = fresh(1) if what < 0.4 else [] if what < 0.7 else [two[p], *fresh(1)]
        same, union = len(w5(one) & w5(two)), len(w5(one) | w5(two))
        if same >= 0.8 * union:
            want.append((len(texts), len(texts) + 1))
            texts += [" ".join(fresh(r.randint(0, 70)) + x + fresh(r.randint(0, 70))) for x in (one, two)]
    clean = len(texts)
    texts += [" ".join(fresh(r.randint(40, 300))) for _ in range(50)]
    found = by_id(substring_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    linked = [found[b].component_id == a and found[a].n_repeat_words >= 40 and found[b].n_removed_words >= 40 for a, b in want]
    assert sum(linked) >= 0.95 * len(want)
    assert all(found[k].component_id == k - (k < clean) * (k % 2) or not linked[k // 2] for k in range(clean))
    assert not any(found[k].n_repeat_words for k in range(clean, len(texts)))


def test_removals_leave_the_first_place(spark):
    one = " ".join(f"p{k}" for k in range(60))
    texts = ["la " * 400, one + " end", "start here " + one, None, "", "la " * 30, one]
    rows = [*enumerate(texts), (6, one), (None, one)]
    found = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {x.doc_id: (x.component_id, x.n_repeat_words, x.removed) for x in found}
    assert len(found) == len(rows)
    assert got == {0: (0, 400, "16:400"), 1: (1, 60, ""), 2: (1, 60, "2:62"), 3: (3, 0, ""), 4: (4, 0, ""), 5: (5, 0, ""), 6: (1, 60, "0:60"), None: (None, 0, "")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.sampled_from((5, 16)), st.integers(0, 3), st.integers(-3, 3)), min_size=1, max_size=60))
def test_passages_hold_their_definition(rows):
    at, size, head, shift = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    whole, less, used = substring_dedup.passages(0, at, size, head, at + shift, 0.8)
    word = {k for a, n in zip(at.tolist(), size.tolist(), strict=True) for k in range(a, a + n)}
    for x, y in whole:
        assert y - x >= substring_dedup.LEAST and x in word and y - 1 in word
        gaps = "".join("x" if k in word else " " for k in range(x, y)).split("x")
        assert max(map(len, gaps)) <= substring_dedup.GAP
    inside = {k for x, y in whole for k in range(x, y)}
    assert all(set(range(x, y)) <= inside for x, y in less)
    assert all(n == 16 and a in inside for a, n, u in zip(at.tolist(), size.tolist(), used.tolist(), strict=True) if u)
