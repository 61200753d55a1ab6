import re
from collections import Counter, defaultdict
from math import gcd

import pytest

from framewise.llm.mixing import golden_step, mix_sources, mixed_counts, schedule_slots, water_fill


def test_water_fill():
    assert water_fill([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert water_fill([], [], 1.5, 2.0) == [] and water_fill([0, 10], [3, 1], 1.5, 2.0) == [0.0, 15.0]


def test_schedule_is_exact_and_even(spark):
    quotas = [20_000, 0, 1, 9_999]
    rows = schedule_slots(spark, quotas).collect()
    assert sorted(r["slot"] for r in rows) == list(range(sum(quotas)))
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["slot"]):
        by[r["sid"]].append(r)
    for sid, own in by.items():
        assert [r["rank"] for r in own] == list(range(quotas[sid]))
        for n, r in enumerate(own):     # never far from its share at any point of the schedule
            assert abs(n - r["slot"] * quotas[sid] / sum(quotas)) < 12
    assert all(gcd(golden_step(q), q) == 1 for q in range(1, 200))


def test_counts(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, "lorem ipsum dolor " * (i % 40), "abc"[i % 3] if i % 7 else None) for i in range(300)]
    got = [tuple(r) for r in mixed_counts(make_docs(rows), block=64, per_bucket=16).collect()]
    again = [tuple(r) for r in mixed_counts(make_docs(rows), block=64, per_bucket=16).collect()]
    assert Counter(got) == Counter(again) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((i, size(t)) for i, t, _ in rows) == Counter((d, n) for d, n, *_ in got)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip([sizes[s] for s in order], water_fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    taken = Counter()
    for _, n, source_size, goal, words in got:
        assert goal == target[source_size] and 0 <= words <= 2 * n
        taken[source_size] += words
    for source_size, goal in target.items():
        assert goal - 1 <= taken[source_size] <= goal


def test_empty(make_docs):
    assert mixed_counts(make_docs([])).count() == 0
    assert [tuple(r) for r in mixed_counts(make_docs([(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_too_many_sources_raise(make_docs):
    with pytest.raises(ValueError):
        mix_sources(make_docs([(i, "a", str(i)) for i in range(5)]), max_sources=4)
