import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import lm
from framewise.llm.queries import remainder
from framewise.llm.tokens import slices


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_normalised_sequences():
    texts = ["A  bÉ\t c ", "", None, "\n", "x", "two words", " lead"]
    s = next(slices(pa.array(texts)))
    data, offsets = lm.normalised(s)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])] == [" ".join(tokens(t)[:-1]) + "\n" for t in texts]
    keys = lm.grams(data, offsets)
    for a, b in zip(offsets, offsets[1:]):
        padded = b"\n" * 5 + raw[a:b]
        assert [int(k).to_bytes(8, "little")[:6] for k in keys[a:b]] == [padded[i:i + 6][::-1] for i in range(b - a)]


def fold(n):
    return F.coalesce(remainder(F.col("doc_id"), 10), F.lit(1)) == n


def test_base_score_by_definition(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"the cat sat {'on the mat ' * (i % 5)} {i}", "s") for i in range(80)]
    got = sorted((tuple(r) for r in lm.lm_scores(make_docs(rows), fold(0), fold(9)).collect()), key=str)
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    count = collections.Counter(w for (_, t, _), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    exp = []
    for (i, t, _), h in zip(rows, held):
        w = tokens(t)
        exp.append((i, h, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(got) == len(exp)
    for a, b in zip(got, sorted(exp, key=str)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0


def test_probabilities_sum_to_one(make_docs):
    rows = [(i, "the cat sat on the mat and the dog ran " * 3 + str(i), "s") for i in range(60)]
    docs = make_docs(rows)
    model = lm.train(docs.where("doc_id < 50"), docs.where("doc_id >= 50"))
    context = int.from_bytes(b" eht ", "little")
    total = (10.0 ** model.log10(np.array([context << 8 | b for b in range(256)], np.uint64))).sum()
    assert total == pytest.approx(1.0, rel=1e-9)
    # what it has learned is likelier than anything else
    p = {b: model.log10(np.array([int.from_bytes(b" eht ", "little") << 8 | b], np.uint64))[0] for b in b"cdmzq"}
    assert max(p, key=p.get) in b"cdm"


def test_nothing_to_learn_from(make_docs):
    assert lm.lm_scores(make_docs([]), fold(0), fold(9)).count() == 0
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.lm_scores(make_docs([(one, "a b", "s")]), fold(0), fold(9)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (3, 0, 0, True)
    assert r["base_score"] == pytest.approx(0.0) and r["score"] < 0


def test_better_than_the_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 1")
    r = lm.lm_scores(docs, fold(0), fold(9)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
