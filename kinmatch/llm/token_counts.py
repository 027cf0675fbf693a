"""Token counts by overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded whole. Longer ones are encoded in overlapping chunks with offsets; neighbouring
chunks are spliced at a boundary both share, where white space precedes a token and both encodings go on with the same
tokens. If an overlap has no such boundary it is doubled, at last to all that is left of the text. So a task never holds
the encoding of a huge document, and the count is that of the whole text.

For tokenizers whose own definition drops white space between words (checked from the file), white space is such a
boundary everywhere; words are then encoded once by the library and counted from a bounded cache.

Null or empty text has 0 tokens; every row gives a row, also repeated ones; other columns are not returned.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

#: Characters that Python, the tokenizer libraries and Unicode all take as white space.
BLANKS = " \t\n\r\x0b\x0c"
WORDS = re.compile(f"[^{BLANKS}]+").findall

Spans = tuple[list[int], list[int], list[int]]


def drops_blanks(spec: dict) -> bool:
    """Whether the tokenizer's definition makes tokens from stretches without white space alone, one by one."""

    def parts(x, key):
        return [] if x is None else x[key] if x["type"] == "Sequence" else [x]

    plain = {("NFC", None), ("Lowercase", None), ("Replace", r"\s+")}
    norms = {(n["type"], (n.get("pattern") or {}).get("Regex")) for n in parts(spec["normalizer"], "normalizers")}
    pre = parts(spec["pre_tokenizer"], "pretokenizers")
    split = pre[0] if pre else {}
    own = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and all(
        "\\s" not in x or x.startswith("[^\\s") for x in split["pattern"].get("Regex", "\\s").split("|")
    )
    rest = all(p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in pre[1:])
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(BLANKS) & set(t["content"])) for t in spec["added_tokens"])
    return norms <= plain and bool(own) and rest and added


def resync_count(text: str, encode: Callable[[str], Spans], chunk_chars: int, overlap_chars: int, agree: int = 8) -> int:
    """Number of tokens of text; encode(part) gives ids, starts and ends of tokens, as characters of the part."""
    n = len(text)

    def spans(s: int, e: int) -> Spans:
        ids, a, b = encode(text[s:e])
        return ids, [x + s for x in a], [x + s for x in b]

    def boundary(left: Spans, right: Spans, low: int) -> int | None:
        there = {}
        for j, p in enumerate(right[1]):
            there.setdefault(p, j)
        first = {}
        for i, p in enumerate(left[1]):
            if p > low and p in there:
                first.setdefault(p, i)
        for p, i in sorted(first.items(), reverse=True):
            j = there[p]
            if (text[p - 1] in BLANKS or text[p] in BLANKS) and j > 0 and len(left[0]) - i > agree and left[0][i : i + agree] == right[0][j : j + agree] and left[2][i : i + agree] == right[2][j : j + agree]:
                return p
        return None

    start, end, total = 0, min(n, chunk_chars), 0
    left = spans(0, end)
    while end < n:
        overlap, p = overlap_chars, None
        while True:
            begin, stop = max(start, end - overlap), min(n, end + chunk_chars)
            right = spans(begin, stop)
            p = boundary(left, right, start)
            if p is not None or begin == start:
                break
            overlap *= 2
        if p is None:  # no boundary: what is left goes in one piece
            return total + len(spans(start, n)[0])
        total += sum(start <= a < p for a in left[1])
        start, end, left = p, stop, right
    return total + sum(a >= start for a in left[1])


class Counter:
    """Token counts with one tokenizer file; kept for the life of a Python worker."""

    def __init__(self, path: str, most_words: int = 500_000, longest_word: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.cache: dict[str, int] = {}
        self.most, self.longest = most_words, longest_word
        if path.endswith(".model"):
            import sentencepiece

            self.sp, self.by_word = sentencepiece.SentencePieceProcessor(model_file=path), False
        else:
            from tokenizers import Tokenizer

            self.sp, self.tok = None, Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            with open(path, encoding="utf-8") as f:
                self.by_word = drops_blanks(json.load(f))

    def spans(self, text: str) -> Spans:
        if self.sp is not None:
            pieces = self.sp.encode(text, return_type="proto").pieces  # its offsets count bytes
            raw = np.frombuffer(text.encode(), np.uint8)
            char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            begin = char[[p.begin for p in pieces]] if len(pieces) else char[:0]
            end = char[[p.end for p in pieces]] if len(pieces) else char[:0]
            return [p.id for p in pieces], begin.tolist(), end.tolist()
        e = self.tok.encode(text, add_special_tokens=False)
        off = e.offsets
        return e.ids, [a for a, _ in off], [b for _, b in off]

    def whole(self, texts: list[str]) -> list[int]:
        if self.sp is not None:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)] if texts else []
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.whole(texts)
        lists = [WORDS(t) for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        new = list(set().union(*lists) - self.cache.keys())
        found = dict(zip(new, self.whole(new), strict=True))
        self.cache.update((w, k) for w, k in found.items() if len(w) <= self.longest)
        get, cache = found.get, self.cache
        out = []
        for words in lists:
            try:
                out.append(sum(map(cache.__getitem__, words)))
            except KeyError:
                out.append(sum(cache[w] if w in cache else get(w) for w in words))
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 32_768, overlap_chars: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``tokenizer`` is a .json or .model file on every node."""

    def rows(ids, texts):
        c = counter(tokenizer)
        texts = [t or "" for t in texts]
        n = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
        for i, k in zip(short, c.counts([texts[i] for i in short]), strict=True):
            n[i] = k
        for i, t in enumerate(texts):
            if len(t) > chunk_chars:
                n[i] = resync_count(t, c.spans, chunk_chars, overlap_chars)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    out = map_rows(df, rows, [id_col, text_col], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", arrow)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
