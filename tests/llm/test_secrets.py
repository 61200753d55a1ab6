import random
import re

import numpy as np
from pyspark.sql import functions as F

from framewise.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


WORDS = ("alpha", "beta", "gamma", "été", "delta,")
PROSE = """river stone walks quickly through quiet forests while twenty birds sing about warm summer rain and children
build small wooden boats from old planks beside the harbour where fishermen mend nets every morning before sunrise""".split()


def docs_with_secrets(vocabulary=WORDS):
    rng = random.Random(3)
    key = lambda n, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(40)]
        if i % 3 == 0:
            w[20:20] = [rng.choice(["password=", 'token = "', "API_KEY: '", "secret:"]) + key(32, mixed)]
        if i % 5 == 0:
            w[30:30] = ["AKIA" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")]
        if i % 7 == 0:
            w[5:5] = [key(40)]
        rows.append((1000 + i, " ".join(w), "s"))
    rows += [(1, "token:token:abcdefgh token=abc PASSWD = 'x_y-z.1' AKIA" + "Z" * 15 + " " + "0" * 23 + " " + "a" * 24, "s"),
             (2, "toKen=abcdefgh ſecret=abcdefgh secret=abcdefgh", "s")]
    # a value the rules miss: the keyword is followed by another word
    rows.append((3, "alpha beta password := '" + key(32, mixed) + "' delta", "s"))
    return rows


def test_base_spans_and_redaction(make_docs, odd_rows):
    rows = docs_with_secrets() + odd_rows
    docs = make_docs(rows)
    chain = S.train(docs)
    assert (chain.weights != 0).any()
    got = {(r["doc_id"], i): r for i, r in enumerate(S.scan(docs, chain).collect())}
    assert len(got) == len(rows)
    for (doc_id, i), r in got.items():
        text = rows[i][1]
        assert r["doc_id"] == rows[i][0] and r["base"] == brute(text)
        assert set(r["base"]) <= set(r["spans"])
        assert [sum(x.startswith(k) for x in r["base"]) for k in S.KINDS[:3]] == [r["n_assign"], r["n_access"], r["n_hex"]]
    clean = docs.select(S.redacted(F.col("text"), chain).alias("t")).collect()
    for (_, text, _), r in zip(rows, clean):
        assert (r["t"] is None) == (text is None)
        if text is not None:
            assert brute(r["t"]) == [] or "[SECRET]" not in r["t"]
            assert ("[SECRET]" in r["t"]) == bool(got and brute(text)) or "[SECRET]" in r["t"]


def test_chain_finds_what_the_rules_miss(make_docs):
    rows = docs_with_secrets()
    chain = S.train(make_docs(rows[:-1]))           # what the rules miss is no example of a clean text
    found = {r["doc_id"]: r["spans"] for r in S.scan(make_docs(rows), chain).collect()}
    assert any(x.startswith("crf") for x in found[3])
    plain = [i for i, t, _ in rows if i > 999 and not brute(t)]
    assert not any(found[i] for i in plain)         # clean texts stay clean


def test_recall_beyond_the_patterns(make_docs):
    """Secrets that no pattern sees, in texts and forms that the chain was not
    trained on; look-alikes and clean texts stay untouched."""
    chain = S.train(make_docs(docs_with_secrets(PROSE)[:-1]))
    rng = random.Random(11)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ("credential {}", "Authorization: Bearer {}", 'my key is "{}"', "ghp_{}", "'auth' => '{}'", "export AWS_KEY={}", "pwd {}")
    rows, at = [], {}
    for i in range(210):
        w = [rng.choice(["the", "river", "ran", "slowly", "past", "Häuser", "and", "fields."]) for _ in range(60)]
        value = "".join(rng.choices(mixed, k=rng.choice((24, 32, 40))))
        w[rng.randrange(60)] = forms[i % len(forms)].format(value)
        text = " ".join(w)
        at[i] = (text.index(value), text.index(value) + len(value))
        assert brute(text) == []
        rows.append((i, text, "s"))
    harmless = ["getRiverNameFromFields", "river_ran_slowly_12", "2024-10-31", "https://www.river.org/fields/past-12", "+49-171-5550100",
                "ab.12@river1.example.com", "4556737586899855", "THE_RIVER_RAN", "river/fields/past.txt"]
    for i in range(300, 400):
        w = [rng.choice(["the", "river", "ran", "slowly", "past", "Häuser", "and", "fields."]) for _ in range(60)]
        w[rng.randrange(60)] = rng.choice(harmless)
        rows.append((i, " ".join(w), "s"))
    found = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"]] for r in S.scan(make_docs(rows), chain).collect()}
    hit = sum(any(a < at[i][1] and at[i][0] < b for a, b in found[i]) for i in at)
    assert hit >= 0.9 * len(at)
    assert sum(bool(found[i]) for i in range(300, 400)) <= 2


def test_training_repeats_and_ignores_partitions_and_copies(make_docs):
    rows = docs_with_secrets()[:60]
    one = S.train(make_docs(rows).repartition(1))
    many = S.train(make_docs(rows + rows[:20] * 3).repartition(7))
    assert (one.weights == many.weights).all() and (one.moves == many.moves).all()


def test_decoding_equals_full_viterbi():
    rng = np.random.default_rng(0)
    chain = S.Chain(np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)))
    for n in (0, 1, 2, 30):
        scores = rng.normal(size=(n, 3)) * 2
        scores[rng.random(n) < 0.5, 0] += 12
        got = chain.decode(scores, np.array([0, n]))
        if n:
            best, path = chain.moves[0] + scores[0], [[0], [1], [2]]
            for x in scores[1:]:
                way = best[:, None] + chain.moves
                path = [path[int(way[:, k].argmax())] + [k] for k in range(3)]
                best = way.max(axis=0) + x
            assert got.tolist() == path[int((best + chain.moves[:, 0]).argmax())]


def test_empty(make_docs):
    assert S.find_secrets(make_docs([])).count() == 0
    assert [r["spans"] for r in S.find_secrets(make_docs([(1, "nothing here", "s")])).collect()] == [[]]
