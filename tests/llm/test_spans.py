"""Personal data, secrets and licences: what the learned and joined parts find, against plants and brute force."""

import random

from kinmatch.llm import licences, pii


def test_licence_blocks_both_ways(spark):
    """Every run of a template's length, for every template, ties in token frequency included: labels and scores are equal."""
    r = random.Random(4)
    texts = [None, "", "mit", "licensed x under x cc x 0 x by x nc x x", "x " * 30 + "licensed under cc by nc 4 0"]
    vocabulary = ["x", "y", *sorted({w for _, t, _ in licences.TEMPLATES for w in t.split()})]
    for _ in range(300):
        w = r.choices(vocabulary, k=r.randint(0, 12))
        for _ in range(r.randint(1, 2)):
            own = r.choice(licences.TEMPLATES)[1].split()
            for _ in range(r.choice((0, 0, 1, 2, 3, 6))):
                p, what = r.randrange(len(own)), r.random()
                own[p : p + 1] = [] if what < 0.3 else [r.choice(vocabulary)] if what < 0.6 else [own[p], "z"]
            w += own if r.random() < 0.8 else r.sample(own, len(own))
            w += r.choices(vocabulary, k=r.randint(0, 12))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n_extra = 0
    for x in licences.scan(df).collect():
        w = (texts[x.doc_id] or "").split()
        base = {label for p, label in licences.PHRASES for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q}
        extra, score = set(), 0.0
        for label, t, _ in licences.TEMPLATES:
            q = t.split()
            for k in range(max(1, len(w) - len(q) + 1)):
                share = len(set(w[k : k + len(q)]) & set(q)) / len(set(q))
                if share >= 0.9 - 1e-9:
                    extra.add(label)
                    score = max(score, share)
        assert set(x.labels.split(",")) - {""} == base | extra, texts[x.doc_id]
        assert abs(x.score - score) < 1e-9
        n_extra += len(extra)
    assert n_extra > 100


def test_secrets_and_broken_cards_are_found(spark):
    """Precision and recall of what is added, on plants of a form that no base span has."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmn", k=r.randint(3, 9)))
    some = lambda n: " ".join(word() for _ in range(n))

    def card(valid):
        while True:
            d = str(r.randint(10**15, 10**16 - 1))
            if (sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0) == valid:
                return d

    texts, plants = [], {}
    for k in range(900):
        plant = [None, f'token = "{r.getrandbits(160):040x}"', card(False), card(True), f"{word()}@{word()}.com", f"sum {r.randint(10**7, 10**8)} of", f"{word()}-{word()}-{word()}-{word()}-12", "version v2.1 of 2024-11-26"][k % 8]
        if k % 8 in (1, 2):
            plants[k] = plant.split('"')[1] if '"' in plant else plant
        texts.append(f"{some(12)} {plant} {some(12)}" if plant else some(30))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {}
    for x in pii.find(df, pii.fit(df)).collect():
        base = {(s.at, s.to) for s in x.base}
        added[x.doc_id] = {texts[x.doc_id][s.at : s.to] for s in x.spans if (s.at, s.to) not in base}
    found = sum(plants[k] in added[k] for k in plants)
    said = sum(map(len, added.values()))
    assert found >= 0.95 * len(plants) and found >= 0.95 * said
