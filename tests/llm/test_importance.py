import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framewise.llm.importance import gains, ngram_crcs, resample, scan, shifted
from framewise.llm.queries import op12_importance


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text):
    ws = words(text)
    return [" ".join(ws[i:i + k]).encode() for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def by_definition(docs, target, percent=5, least=20, buckets=10_000):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counts.update(zlib.crc32(f) % buckets for f in features(x))
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        own = features(text)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r, (_, x) in zip(rows, docs) if len(words(x)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for n, r in enumerate(fit[:len(fit) * percent // 100]):
        r.append(n + 1)
    return Counter(tuple(r) if len(r) == 5 else (*r, None) for r in rows)


def test_crcs_against_the_definition():
    r = random.Random(1)
    texts = ["".join(r.choice("abcXYZ é中-_ \n09") for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += ["w" * 70_000 + " b " + "c" * 3000, "", " ", "one", "a " * 500, "\0a\0b\0"]
    got = [[] for _ in texts]
    for crcs, row in ngram_crcs(scan(x.encode() for x in texts)):
        for c, at in zip(crcs.tolist(), row.tolist()):
            got[at].append(c)
    assert got == [[zlib.crc32(f) for f in features(x)] for x in texts]


def test_shift_equals_appended_zeros():
    lengths = np.array([0, 1, 5, 63, 64, 65, 127, 4096, 100_003])
    crcs = np.full(len(lengths), zlib.crc32(b"prefix"), np.uint32)
    # crc(prefix + tail) = shift(crc(prefix)) xor crc(tail)
    assert [int(x) ^ zlib.crc32(bytes(int(n))) for x, n in zip(shifted(crcs, lengths), lengths)] == \
        [zlib.crc32(b"prefix" + bytes(int(n))) for n in lengths]


def test_gains_floor_downwards():
    got = gains(np.array([3, 0, 5]), np.array([0, 0, 9]))
    assert got.tolist() == [math.floor(1000 * math.log(x)) for x in (1 * 11 / (4 * 12), 11 / 12, 10 * 11 / (6 * 12))] and got[0] < 0


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    lexicon = [f"w{i}" for i in range(300)] + ["Éa", "中b", "x9"]
    return [(i, " ".join(r.choices(lexicon[: 20 + i % 280], k=r.randint(0, 60))), "s") for i in range(400)]


def test_against_the_definition(spark, make_docs, odd_rows, rows):
    every = odd_rows + rows + [(900, rows[7][1], "s"), (900, rows[7][1], "s")]
    target = ["w1 w2 w3 w4 w5", None, "", "w17 W18, w19. Éa"]
    bench = spark.createDataFrame([(str(i), x, "clash") for i, x in enumerate(target)], "item_id string, text string, weight string")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))
                  for r in resample(make_docs(every), bench, percent=25).collect())
    assert got == by_definition([(i, t) for i, t, _ in every], target, percent=25)


def test_empty_tables(spark, make_docs, rows):
    nothing = make_docs([])
    assert resample(nothing, nothing).count() == 0
    got = resample(make_docs(rows[:50]), nothing)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()) == \
        by_definition([(i, t) for i, t, _ in rows[:50]], [])


def test_query_over_whole_tables(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    assert Counter(map(tuple, op12_importance(spark, small_dir).collect())) == by_definition(docs, bench)
