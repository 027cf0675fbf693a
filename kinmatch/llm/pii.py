"""Personal data and secrets by candidate gradient boosting over built-in expressions.

Base spans are format matches that pass their own test (digits, parts, Luhn). Beside them, high-recall generators propose
looser spans: spelled-out addresses, runs of digits with separators, and long runs of mixed letters and digits. Boosted
trees score each candidate by its format and context; a threshold calibrated on held-out candidates selects the redactions
that are added. Base spans stay.

For want of labelled spans the trees learn from examples made of what a sample of texts holds. Personal data are candidates
that overlap a base span, and base spans in a form that their own test does not take, in their places: addresses spelled
out, phones without the plus, cards with a wrong check digit; and secrets made from a text's digest, as keys are written in
code. Not personal data are the other candidates, and slugs, versions and times made from the text's words. A candidate of
the text itself that is formed like an example of personal data (a run with the digits and groups of some card or phone, a
spelled-out address with bracketed marks, a mixed run) is an example of neither. The sample is the ``most_docs`` texts with
candidates of least hashed id; the trees are conditional expressions of the plan. Matching, tests, features and trees are
all DataFrame expressions; nothing is shuffled.

Fixed bounds of the generators: parts of a spelled-out address have up to 64 characters, its last ones 24; runs of digits 7
to 41; mixed runs 16 or more characters; the trees see 24 characters before a candidate and 8 after it.

Places count code points; the end is exclusive. Null text has no spans. Without both kinds of example no span is added.
Every row gives a row, also repeated ones; other columns are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "handle", "number", "secret")

LOCAL = "A-Za-z0-9._%+-"
#: The base forms. Possessive, so that very long matches need no stack; a match of the first can only begin where a run
#: of its characters does or the match before has ended (\G), which keeps the search linear.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HANDLE = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,24}+)+"
NUMBER = r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,40}+(?![0-9A-Za-z])"
#: A run of letters and digits, both of them, as keys have.
SECRET = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9@.])"


def places(text: str, pattern: str, block: int = 512) -> str:
    """SQL of the matches of a pattern in a text column, as an array of (at, to, s).

    What stands between matches and the matches themselves give the places: sums of lengths, over blocks for long arrays.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"named_struct('m', regexp_extract_all({text}, '{p}', 0), 'g', transform(split({text}, '{p}', -1), g -> length(g)))"
    sizes = f"transform(array({parts}), q -> named_struct('m', q.m, 'g', q.g, 'n', transform(q.m, (m, i) -> q.g[i] + length(m))))"
    total = "aggregate({0}, 0, (a, x) -> a + x)"
    sums = f"transform({sizes}, q -> named_struct('m', q.m, 'g', q.g, 'n', q.n, 'b', aggregate(sequence(0, size(q.m) div {block}), array(0), (a, j) -> array_append(a, element_at(a, -1) + {total.format(f'slice(q.n, j * {block} + 1, {block})')}))))"
    start = f"q.b[i div {block}] + {total.format(f'slice(q.n, (i div {block}) * {block} + 1, i % {block})')} + q.g[i]"
    return f"flatten(transform({sums}, q -> transform(q.m, (m, i) -> named_struct('at', {start}, 'to', {start} + length(m), 's', m))))"


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """SQL of the Luhn test of a string of digits."""
    each = f"cast(substring({d}, -i, 1) as int) * (2 - i % 2)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + {each} - if({each} > 9, 9, 0)) % 10 = 0"


NO_SPANS = "cast(array() as array<struct<at: int, to: int, s: string>>)"


def spans(text: str, pattern: str, likely: str, holds: str | None = None) -> Column:
    """Matches where the text is likely to have some, less those that fail a test of m.s."""
    found = places(text, pattern)
    found = found if holds is None else f"filter({found}, m -> {holds})"
    return F.expr(f"if({likely}, {found}, {NO_SPANS})")


def add_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with an array of spans of each kind: email, ip, card, phone, handle, number, secret."""
    d = digits("m.s")
    return df.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumns({
        "email": spans("_t", EMAIL, "contains(_t, '@')"),
        "ip": spans("_t", IP, r"_t rlike '[0-9]\\.[0-9]'", "forall(split(m.s, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast('0' || right(x, 3) as int) <= 255)"),
        "card": spans("_t", CARD, r"_t rlike '[0-9][0-9 -]{10}'", f"length({d}) between 12 and 19 and {luhn(d)}"),
        "phone": spans("_t", PHONE, "contains(_t, '+')", f"length({d}) between 9 and 15"),
        "handle": spans("_t", HANDLE, r"_t rlike '[ (\\[]at[ )\\]]'"),
        "number": spans("_t", NUMBER, r"_t rlike '[0-9][0-9 ().\\-/]{5}'"),
        "secret": spans("_t", SECRET, "_t rlike '[0-9+/_-][A-Za-z]' and _t rlike '[A-Za-z0-9+/_-]{16}'"),
    })


CONTEXT = ("phone|tel|call|fax|mobile", "card|credit|visa|account|iban", "mail|contact|write", "ip|host|server|addr", "token|key|secret|passw|pwd|auth|credential")


def features(c: str) -> dict[str, str]:
    """SQL of a candidate's figures; c is a struct with s, its kind, and the text before and after."""
    d = digits(f"{c}.s")
    return {
        "is_handle": f"if({c}.kind = 'handle', 1, 0)",
        "is_secret": f"if({c}.kind = 'secret', 1, 0)",
        "digit_share": f"length({d}) / length({c}.s)",
        "turns": f"regexp_count({c}.s, '[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])') / length({c}.s)",
        "cuts": f"regexp_count({c}.s, '[_/+-]') / length({c}.s)",
        "quoted": f"""if({c}.before rlike '["\\']$' and {c}.after rlike '^["\\']', 1, 0)""",
        "assigned": f"""if({c}.before rlike '[=:] ?["\\']?$', 1, 0)""",
        "length": f"length({c}.s)",
        "digits": f"length({d})",
        "groups": f"size(split({c}.s, '[^0-9]+'))",
        "longest": f"coalesce(array_max(transform(regexp_extract_all({c}.s, '[0-9]+', 0), x -> length(x))), 0)",
        "plus": f"if(startswith({c}.s, '+') or right({c}.before, 1) = '+', 1, 0)",
        "bracket": f"if(contains({c}.s, '('), 1, 0)",
        "dots": f"length({c}.s) - length(replace({c}.s, '.', ''))",
        "dashes": f"length({c}.s) - length(replace({c}.s, '-', ''))",
        "spaces": f"length({c}.s) - length(replace({c}.s, ' ', ''))",
        "joined": f"if({c}.before rlike '[0-9A-Za-z.,:/$-]$' or {c}.after rlike '^[-/:%$0-9A-Za-z]', 1, 0)",
        "luhn": f"if(length({d}) between 12 and 19 and {luhn(d)}, 1, 0)",
    } | {f"context{k}": f"if(lower({c}.before) rlike '({words})', 1, 0)" for k, words in enumerate(CONTEXT)}


def candidates(df: DataFrame) -> DataFrame:
    """df of add_spans with ``cand``: the looser spans with the text about them and whether they overlap a base span."""
    about = "substring(_t, greatest(m.at - 23, 1), least(m.at, 24))"
    touches = " or ".join(f"exists({k}, b -> b.at < m.to and m.at < b.to)" for k in KINDS[:4])
    one = "transform({k}, m -> named_struct('at', m.at, 'to', m.to, 's', m.s, 'kind', '{k}', 'before', " + about + ", 'after', substring(_t, m.to + 1, 8), 'base', " + touches + "))"
    return df.withColumn("cand", F.expr("concat(" + ", ".join(one.format(k=k) for k in KINDS[4:]) + ")"))


#: How keys are named in code.
NAMES = ("token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "credentials")


def with_examples(df: DataFrame) -> DataFrame:
    """df of candidates with made examples among them, ``base`` telling which are personal data, and without handles that
    may be either."""
    form = "pmod(xxhash64(m.s, m.at), 6)"
    host = f"if({form} < 3, substring_index(m.s, '@', -1), substring_index(m.s, '.', -2))"
    host = f"substring_index({host}, '@', -1)"  # whole, or its last two parts
    at, dot = (f"element_at(array(' ({w}) ', ' [{w}] ', ' {w} '), cast({form} % 3 as int) + 1)" for w in ("at", "dot"))
    spelled = f"concat(substring_index(m.s, '@', 1), {at}, replace({host}, '.', {dot}))"
    about = "substring(_t, greatest(m.at - 23, 1), least(m.at, 24))"
    one = "transform({k}, m -> named_struct('at', m.at, 'to', m.to, 's', {s}, 'kind', '{kind}', 'before', " + about + ", 'after', substring(_t, m.to + 1, 8), 'base', true))"
    unsure = "(c.kind = 'handle' and not c.base and (contains(c.s, '(') or contains(c.s, '['))) or c.kind = 'secret'"
    wrong = "concat(left(m.s, length(m.s) - 1), cast((cast(right(m.s, 1) as int) + 5) % 10 as string))"
    parts = [f"filter(cand, c -> not ({unsure}))", one.format(k="email", s=spelled, kind="handle"), one.format(k="phone", s="substring(m.s, 2)", kind="number"), one.format(k="card", s=wrong, kind="number")]
    # Of each text a secret and three that are none, between the words at a drawn place.
    words = "split(substring(_t, 1, 400), '[^A-Za-z]+')"
    some = lambda k: f"lower(coalesce(get({words}, cast(pmod(xxhash64(_t, {k}), 20) as int)), 'w{k}'))"
    digest = "element_at(array(sha1(_t), md5(_t), regexp_replace(base64(unhex(sha2(_t, 256))), '[^A-Za-z0-9]', ''), substring(sha2(_t, 256), 1, 24)), cast(pmod(xxhash64(_t, 5), 4) as int) + 1)"
    name = "element_at(array(" + ", ".join(f"'{n}'" for n in NAMES) + f"), cast(pmod(xxhash64(_t, 6), {len(NAMES)}) as int) + 1)"
    number = "cast(pmod(xxhash64(_t, 7), 90) + 10 as string)"
    made = (
        (digest, f"concat({some(1)}, ' ', {name}, element_at(array(' = \"', '=\"', ': \"', \" = '\", '='), cast(pmod(xxhash64(_t, 8), 5) as int) + 1))", "element_at(array('\" ', '\" ', '\" ', \"' \", ' '), cast(pmod(xxhash64(_t, 8), 5) as int) + 1)", True),
        (f"concat_ws('-', {some(1)}, {some(2)}, {some(3)}, {some(4)}, {number})", f"concat({some(5)}, ' ')", "' and'", False),
        (f"concat_ws('_', {some(2)}, {some(3)}, 'linux', 'x86', 'v{{}}')", f"concat({some(6)}, ' = \"')", "'\" '", False),
        (f"concat('20', {number}, '-11-26T15-41-', {number}, 'Z')", f"concat({some(7)}, ': ')", "' on'", False),
    )
    parts.append("filter(array(" + ", ".join(f"named_struct('at', -{k + 1}, 'to', 0, 's', {v.replace('{}', '2')}, 'kind', 'secret', 'before', right({before}, 24), 'after', {after}, 'base', {str(y).lower()})" for k, (v, before, after, y) in enumerate(made)) + "), m -> length(m.s) >= 16 and m.s rlike '[0-9]')")
    return df.withColumn("cand", F.expr("concat(" + ", ".join(parts) + ")"))


# -- boosted trees ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A split (feature < cut goes left) or, without a feature, a leaf."""

    value: float
    feature: str | None = None
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def apply(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] < self.cut, self.left.apply(x), self.right.apply(x))

    def sql(self, figure: dict[str, str]) -> str:
        if self.feature is None:
            return f"{self.value!r}D"
        return f"if({figure[self.feature]} < {self.cut!r}D, {self.left.sql(figure)}, {self.right.sql(figure)})"


def grow(x: dict[str, np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rate: float) -> Node:
    """A regression tree on gradients; leaves are Newton steps with a ridge of 1."""
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = Node(float(rate * g / (h + 1)))
    if not depth or len(rows) < 8:
        return leaf
    best, gain = None, 1e-6
    for name, column in x.items():
        v = column[rows]
        for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 15))):
            a = v < cut
            if a.any() and not a.all():
                gl, hl = grad[rows[a]].sum(), hess[rows[a]].sum()
                up = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if up > gain:
                    best, gain = (name, float(cut), a), up
    if best is None:
        return leaf
    name, cut, a = best
    return Node(leaf.value, name, cut, grow(x, grad, hess, rows[a], depth - 1, rate), grow(x, grad, hess, rows[~a], depth - 1, rate))


@dataclass
class Model:
    start: float
    trees: list[Node]
    threshold: float  # of the sum; infinite: nothing is selected

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return self.start + sum((t.apply(x) for t in self.trees), np.zeros(len(next(iter(x.values())))))

    def sql(self, figure: dict[str, str]) -> str:
        return " + ".join([f"{self.start!r}D", *(t.sql(figure) for t in self.trees)])


def boost(x: dict[str, np.ndarray], y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.95, seed: int = 3) -> Model:
    """Logistic boosting on two thirds of the rows; the threshold comes from the calibrated rest.

    Calibration pools adjacent violators on the held-out scores; the threshold is the least score from which on the
    calibrated share of personal data is at least ``precision``.
    """
    none = Model(0.0, [], float("inf"))
    order = np.random.RandomState(seed).permutation(len(y))
    a, b = order[: len(y) * 2 // 3], order[len(y) * 2 // 3 :]
    if not len(b) or y[a].all() or not y[a].any():
        return none
    p = y[a].mean()
    model = Model(float(np.log(p / (1 - p))), [], float("inf"))
    xa = {k: v[a] for k, v in x.items()}
    f = np.full(len(a), model.start)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        tree = grow(xa, y[a] - q, q * (1 - q), np.arange(len(a)), depth, rate)
        model.trees.append(tree)
        f += tree.apply(xa)
    s = model.score({k: v[b] for k, v in x.items()})
    pools: list[list[float]] = []  # least score, positives, rows; from low to high
    for value in np.unique(s):
        pools.append([value, float(y[b][s == value].sum()), float((s == value).sum())])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, pos, n = pools.pop()
            pools[-1][1] += pos
            pools[-1][2] += n
    good = [v for v, pos, n in pools if pos >= precision * n and n >= 5]
    model.threshold = float(min(good)) - 1e-9 if good else float("inf")  # the plan adds trees up in another order
    return model


def fit(df: DataFrame, most_docs: int = 2000, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the candidates of at most ``most_docs`` texts and at most ``most_rows`` candidates."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(r"text rlike '[0-9][0-9 ().\\-/]{5}|[ (\\[]at[ )\\]]|@|[0-9][A-Za-z]'")
    some = texts.select("_id").where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(most_docs)
    rows = with_examples(candidates(add_spans(texts.join(F.broadcast(some.distinct()), "_id"))))  # most_docs ids are broadcast
    figure = features("c")
    rows = rows.select("_id", F.explode("cand").alias("c")).select("_id", "c.at", F.expr("c.base").alias("_y"), *(F.expr(sql).cast("double").alias(k) for k, sql in figure.items()))
    found = rows.orderBy(F.xxhash64("_id", "at"), "_id", "at").limit(most_rows).collect()
    if not found:
        return Model(0.0, [], float("inf"))
    # Numbers that are formed like a card or phone may be one: they are examples of neither.
    form = lambda r: (r["digits"], r["groups"], r["longest"])
    formed = {form(r) for r in found if r["_y"] and not r["is_handle"] and not r["is_secret"]}
    found = sorted((r for r in found if r["_y"] or r["is_handle"] or r["is_secret"] or form(r) not in formed), key=tuple)
    return boost({k: np.array([r[k] for r in found], float) for k in figure}, np.array([r["_y"] for r in found], float))


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): arrays of (at, kind, to), base spans alone and with those added."""
    out = candidates(add_spans(df.select(F.col(id_col), F.col(text_col).alias("text"))))
    as_span = "transform({k}, m -> named_struct('at', m.at, 'rank', {n}, 'to', m.to))"
    base = "concat(" + ", ".join(as_span.format(k=k, n=n) for n, k in enumerate(KINDS[:4])) + ")"
    out = out.withColumn("_base", F.expr(f"sort_array({base})"))
    if np.isfinite(model.threshold):
        # A candidate's figures are made once, as a struct, then the trees read its fields.
        figure = "named_struct(" + ", ".join(f"'{k}', cast({sql} as double)" for k, sql in features("c").items()) + ")"
        open_ = f"transform(filter(cand, c -> not c.base), c -> named_struct('at', c.at, 'to', c.to, 'kind', c.kind, 'x', {figure}))"
        total = model.sql({k: f"c.x.{k}" for k in features("c")})
        chosen = f"filter({open_}, c -> {total} >= {model.threshold!r}D)"
        # Of two that overlap, a handle stays before a secret, and that before a number.
        out = out.withColumn("_chosen", F.expr(chosen))
        clear = "filter(_chosen, c -> c.kind = 'handle' or not exists(_chosen, o -> (o.kind = 'handle' or o.kind = 'secret' and c.kind = 'number') and o.at < c.to and c.at < o.to))"
        extra = f"transform({clear}, c -> named_struct('at', c.at, 'rank', cast(array_position(array('handle', 'number', 'secret'), c.kind) as int) + 3, 'to', c.to))"
        out = out.withColumn("_all", F.expr(f"sort_array(concat(_base, {extra}))"))
    else:
        out = out.withColumn("_all", F.col("_base"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    named = "transform({0}, m -> named_struct('at', m.at, 'kind', " + names + "[m.rank], 'to', m.to))"
    return out.select(F.col(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.expr(named.format("_base")).alias("base"), F.expr(named.format("_all")).alias("spans"))


def listed(spans_col: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans_col}, m -> m.kind || ':' || m.at || ':' || m.to), ',')")


def redact(found: str = "spans", text_col: str = "text") -> Column:
    """The text with each span of the array column ``found`` (of one text, sorted) replaced by its kind in brackets."""
    piece = f"aggregate({found}, named_struct('t', '', 'at', 0), (a, m) -> if(m.at < a.at, a, named_struct('t', a.t || substring({text_col}, a.at + 1, m.at - a.at) || '[' || m.kind || ']', 'at', m.to)), a -> a.t || substring({text_col}, a.at + 1))"
    return F.expr(piece)
