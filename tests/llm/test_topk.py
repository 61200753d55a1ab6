import math
import random

import numpy as np

from pyspark.sql import functions as F

from framewise.llm.topk import Vectors, block_seeds, block_top, quantised, survivors, top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def run(spark, rows, k=5, **options):
    v = spark.createDataFrame([(i, e, "clash") for i, e in rows], SCHEMA) \
        .select("vec_id", quantised(F.col("embedding")).alias("q")).where("vec_id is not null and q is not null")
    return sorted(tuple(r) for r in top_k(v, v.where("vec_id % 50 = 0"), k, **options).collect())


def brute(rows, k=5):
    vectors = {}
    for i, e in sorted(((i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e))):
        vectors[i] = e
    out = []
    for i, q in vectors.items():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors.items() if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def f32(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(24)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 24) for i in range(30)]                      # ties
    rows += [(i, [f32(rng.random() * 1000) for _ in range(7)]) for i in range(1000, 1053)]     # another length
    rows += [(2000, None), (2050, []), (2001, [None] * 24), (2100, [float("nan")] * 24), (2002, [float("inf")] * 24), (None, [1.0] * 24), (5000, [1.0] * 3)]
    rows += [rows[0], rows[50]]                                             # repeated rows
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, candidate_rows=32, query_rows=2, group_blocks=2) == brute(rows)
    assert run(spark, rows[:4]) == brute(rows[:4])                         # fewer than k
    assert run(spark, []) == []


def test_bounds_drop_most_pairs_of_clustered_vectors():
    """Fifty tight clusters: at least nine pairs of ten need no exact score, with
    or without a threshold from other blocks, and the answers are exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (50, 64))
    m = np.floor(centres[rng.integers(0, 50, 4352)] + rng.normal(0, 8, (4352, 64)))
    c, q = Vectors(np.arange(4096), m[:4096]), Vectors(np.arange(4096, 4352), m[4096:])
    exact = (q.m @ c.m.T).astype(int)
    kth = np.sort(exact, axis=1)[:, -5]
    for known in (np.full(256, -np.inf), kth - 1e-9):
        alive, possible = survivors(q, c, 5, known)
        assert possible.sum() <= 0.1 * exact.size
        qi, ci, score = block_top(q, c, 5, known)
        want = {(int(q.ids[i]), int(j), int(exact[i, j])) for i in range(256) for j in np.lexsort((c.ids, -exact[i]))[:5]}
        assert set(zip(qi.tolist(), ci.tolist(), score.tolist())) == want
    ids, least = block_seeds(q, c, 5)
    assert (np.bincount(ids - 4096) == 5).all() and (np.sort(least.reshape(256, 5), axis=1)[:, 0] <= kth).all()
