import random
import re

import pytest

from framewise.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    runs = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if n:
            runs += [(n, tuple(w[a:a + n]), i) for a in range(len(w) - n + 1)]
    out = []
    for i, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for n, run, item in runs:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) == run:
                    hit |= set(range(a, a + n))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, n int")


def test_against_brute_force(make_docs, make_items, odd_rows):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(30)] + ["Été", "The"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(8, 40)))) for i in range(12)] + [(20, "one two"), (21, ""), (22, None), (23, "..."), (None, "no id here at all"),
                                                                          (24, "same " * 30), (25, "same " * 12), (9, "Twice given")]
    docs = list(odd_rows)
    for i in range(40):
        w = say(30)
        if i % 2:
            source = (items[i % 12][1]).split()
            a = rng.randrange(len(source))
            w[10:10] = [x.upper() if x != "Été" else x for x in source[a:a + rng.randint(5, 14)]]
        docs.append((100 + i, rng.choice([" ", ", ", "\n"]).join(w), "s"))
    docs += [(300, "same " * 25, "s"), (301, "same " * 9, "s"), (302, "x same same twice given", "s")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in contamination(make_docs(docs), make_items(items)).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(make_docs, make_items):
    assert contamination(make_docs([]), make_items([(1, "a b")])).count() == 0
    assert [(r["n_hit"], r["items"], r["spans"]) for r in contamination(make_docs([(1, "a b", "s")]), make_items([])).collect()] == [(0, [], [])]
