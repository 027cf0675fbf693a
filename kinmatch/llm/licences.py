"""Licence scans by an exact set-similarity join of text blocks with templates.

A block is a run of as many consecutive words as the template has (the whole text if it has fewer); it meets the template if
it holds at least ``threshold`` of the template's distinct tokens. Tokens are ordered by their frequency in the whole corpus,
rarest first, ties by the token. A block that meets the template must hold one of its first |T| - need + 1 tokens (prefix
filter). About each place of such a token the words that blocks with it can reach must be ``need`` or more (length filter),
enough of the order must be left from the first token found on (positional filter), and ``need`` tokens must be among them.
What passes is verified block by block. So no block that meets a template is lost and none is added; the score is the
largest containment of those found, else 0.

All is DataFrame expressions: one pass counts the template tokens, one scans; no document is shuffled. Templates are
literals of the plan, so their tokens are bounded by ``MOST_TOKENS``.

The base finds places where a phrase's words stand consecutively; the join adds labels of its own, and base labels stay.
Null text has no words. Every row gives a row, also repeated ones; other columns are not returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOKENS = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices by label, and words that a block must hold beside the threshold, if any. Kin notices of one line differ in one
#: word, so that at the threshold of 0.9 a template of up to ten tokens must be there whole.
TEMPLATES = (
    ("mit", "released under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ""),
    ("apache", "licensed under the apache license version 2 0", ""),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", ""),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ""),
    ("lgpl", "licensed under the gnu lesser general public license", ""),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", ""),
    ("cc-by-sa", "licensed under cc by sa 4 0", ""),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ""),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
)


def words(text_col: str) -> Column:
    """Words with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), GAP, -1), "")


def frequencies(df: DataFrame, tokens: list[str], text_col: str = "text") -> dict[str, int]:
    """Places of each token in all texts; the driver gets a row a token."""
    found = df.select(F.explode(words(text_col)).alias("w")).where(F.col("w").isin(tokens)).groupBy("w").count().collect()
    return {t: 0 for t in tokens} | {r[0]: r[1] for r in found}


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scan(df: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of df."""
    tokens = sorted({w for _, t, _ in templates for w in t.split()})
    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"{len(tokens)} template tokens; at most {MOST_TOKENS} can be literals of a plan")
    count = frequencies(df, tokens, text_col) if tokens else {}
    out = df.select(F.col(id_col), words(text_col).alias("_w"))
    # -- base: places of the phrases, by their last word, which prefilters the texts.
    lasts = sorted({p.split()[-1] for p, _ in phrases})
    at = []
    for p, label in phrases:
        own = p.split()
        same = " and ".join(f"element_at(_w, i + {k + 1}) = '{w}'" for k, w in reversed(list(enumerate(own))))
        at.append(F.expr(f"transform(filter(sequence(0, greatest(size(_w) - {len(own)}, 0)), i -> size(_w) >= i + {len(own)} and {same}), i -> named_struct('at', cast(i as long), 'label', '{label}'))"))
    none = F.expr("cast(array() as array<struct<at: bigint, label: string>>)")
    base = F.when(F.arrays_overlap("_w", strings(lasts)), F.concat(*at)).otherwise(none) if phrases else none
    out = out.withColumn("_base", base)
    # -- join: for each template the largest containment over the blocks at its prefix tokens.
    prefixes, found = set(), []
    for label, text, telling in templates:
        length, own = len(text.split()), sorted(set(text.split()), key=lambda w: (count[w], w))
        need = math.ceil(threshold * len(own) - 1e-9)
        prefix = own[: len(own) - need + 1]
        prefixes |= set(prefix)
        hit = "array(" + ", ".join(f"'{w}'" for w in prefix) + ")"
        whole = "array(" + ", ".join(f"'{w}'" for w in own) + ")"
        # Positional filter: with the first common token at place j of the order, at most |T| - j tokens can be common.
        bound = f"{len(own)} - (array_position({whole}, element_at(array_intersect({whole}, b), 1)) - 1) >= {need}"
        told = "".join(f" and array_contains(b, '{w}')" for w in telling.split())
        # 0-based places of prefix tokens, the words that blocks with them reach, and the blocks themselves.
        places = f"filter(sequence(0, size(_w) - 1), i -> array_contains({hit}, _w[i]))"
        reach = f"slice(_w, greatest(i - {length - 1}, 0) + 1, i + {length} - greatest(i - {length - 1}, 0))"
        passed = f"filter({places}, i -> exists(array({reach}), b -> size(b) >= {need} and {bound} and size(array_intersect({whole}, b)) >= {need}))"
        blocks = f"transform(sequence(greatest(i - {length - 1}, 0), greatest(least(i, size(_w) - {length}), 0)), j -> slice(_w, j + 1, {length}))"
        shares = f"transform({passed}, i -> array_max(transform(filter({blocks}, b -> size(array_intersect({whole}, b)) >= {need}{told}), b -> size(array_intersect({whole}, b)) / {len(own)}D)))"
        share = F.when(F.expr(f"arrays_overlap(_w, {hit})"), F.coalesce(F.expr(f"array_max({shares})"), F.lit(0.0))).otherwise(F.lit(0.0))
        found.append(F.struct(F.lit(label).alias("label"), share.alias("share")))
    nothing = F.expr("cast(array() as array<struct<label: string, share: double>>)")
    join = F.when(F.arrays_overlap("_w", strings(sorted(prefixes))), F.array(*found)).otherwise(nothing) if found else nothing
    out = out.withColumn("_join", join)
    base_labels = F.array_sort(F.array_distinct(F.expr("transform(_base, b -> b.label)")))
    extra = F.expr(f"transform(filter(_join, j -> j.share >= {threshold - 1e-9}D), j -> j.label)")
    return out.select(
        F.col(id_col),
        F.size("_w").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.expr("array_min(transform(_base, b -> b.at))").alias("first_word"),
        F.expr("array_max(transform(_base, b -> b.at))").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, extra)), ",").alias("labels"),
        F.coalesce(F.expr("array_max(transform(_join, j -> j.share))"), F.lit(0.0)).alias("score"),
    )
