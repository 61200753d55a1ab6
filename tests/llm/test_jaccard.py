import random
import re

import pytest

from framewise.llm import jaccard
from framewise.llm.components import components
from framewise.llm.jaccard import Rule, jaccard_components


def brute(rows, n=3, num=90, den=100):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            linked = sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
            if linked or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    ids = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            ids[find(a)] = min(i, ids.get(find(a), i))
    return sorted(((i, len(sets[a]), ids.get(find(a))) for a, (i, _, _) in enumerate(rows)), key=str)


def result(docs, **options):
    return sorted((tuple(r) for r in jaccard_components(docs, **options).collect()), key=str)


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("centers", [(1,), (2, 16), (1, 2, 5)])
def test_against_brute_force(make_docs, odd_rows, centers):
    rng = random.Random(len(centers))
    texts = near_copies(rng, [f"a{i}" for i in range(120)], 60, 6) + near_copies(rng, [f"b{i}" for i in range(40)], 25, 2)
    texts += near_copies(rng, [f"c{i}" for i in range(300)], 20, 14) + [" ".join(f"d{i}" for i in range(9))] * 7
    rng.shuffle(texts)
    rows = odd_rows + [(1000 + i, t, "s") for i, t in enumerate(texts)]
    assert result(make_docs(rows), centers=centers) == brute(rows)


def test_blocks_of_a_large_shingle_group(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    rows = [(i, t, "s") for i, t in enumerate(near_copies(rng, [f"a{i}" for i in range(80)], 90, 7))]
    assert result(make_docs(rows), centers=(1,)) == brute(rows)


def test_other_rule_and_empty(make_docs):
    rng = random.Random(4)
    rows = [(i, t, "s") for i, t in enumerate(near_copies(rng, [f"a{i}" for i in range(60)], 40, 8))]
    assert result(make_docs(rows), rule=Rule(5, 50, 100)) == brute(rows, 5, 50, 100)
    assert result(make_docs([])) == []


def test_filters_are_safe():
    rule = Rule()
    for a in range(1, 60):
        for b in range(1, 60):
            need = rule.least(a, b)
            for both in range(min(a, b) + 1):
                assert (100 * both >= 90 * (a + b - both)) == (both >= need)
        assert rule.prefix(a) == a - -(-90 * a // 100) + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 150: 100, 200: 100, **{500 + i: 500 for i in range(50)}}


def test_rows_of_one_document_and_bridges_without_id(make_docs):
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    shared = [(1, one, "s"), (5, one, "s"), (5, two, "s"), (9, two, "s"), (9, "", "s"), (12, None, "s")]
    assert result(make_docs(shared)) == brute(shared)
    assert {r[0]: r[2] for r in result(make_docs(shared))} == {1: 1, 5: 1, 9: 1, 12: 12}
    base = [f"c{i}" for i in range(200)]
    edit = lambda at: " ".join(x if i not in at else f"new{i}" for i, x in enumerate(base))
    for middle in (2, None):
        chain = [(1, edit({0}), "s"), (middle, edit({0, 199}), "s"), (3, edit({199, 100, 0}), "s"), (None, "alone in its words", "s")]
        assert result(make_docs(chain)) == brute(chain)
