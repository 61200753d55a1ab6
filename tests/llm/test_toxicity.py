import random

import pytest

from framewise.llm import toxicity as X

INSULTS = ["idiot", "clown", "scum", "worthless"]


def corpus():
    rng = random.Random(8)
    syllables = ["ta", "ren", "lo", "mis", "ka", "vel", "dor", "ni"]
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(INSULTS)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(make_docs, spark):
    rows, labels = corpus()
    docs = make_docs(rows)
    frame = spark.createDataFrame(labels + [(0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return docs, X.train(docs, frame)


def test_scores_separate(trained):
    docs, scorer = trained
    rows, labels = corpus()
    for (_, text, _), (_, _, toxic) in zip(rows, labels):
        assert (scorer.score(text) >= 0.3) == bool(toxic)


@pytest.mark.parametrize("noisy, plain", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("$cum", "scum"),
                                          ("scuuuum", "scum"), ("w0rthle55", "worthless"), ("cl0wn!!", "clown")])
def test_noise_is_read_through(trained, noisy, plain):
    _, scorer = trained
    base = "taren lomis kavel dorni ta ren lo mis"
    assert scorer.score(f"{base} {noisy} {base}") == pytest.approx(scorer.score(f"{base} {plain} {base}"), abs=0.25)
    assert scorer.score(f"{base} {noisy} {base}") >= 0.3 > scorer.score(f"{base} {base}")


def test_columns_and_odd_rows(trained, make_docs, odd_rows):
    from pyspark.sql import functions as F
    _, scorer = trained
    got = make_docs(odd_rows).select(X.score_column(scorer, F.col("text")).alias("s")).collect()
    assert len(got) == len(odd_rows) and all(0.0 <= r["s"] <= 1.0 for r in got)
    assert got[0]["s"] == got[1]["s"] == got[2]["s"] < 0.3


def test_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.train(make_docs([(1, "a b", "s")]), none).score("a b") == 0.0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert X.train(make_docs([(1, "a b", "s")]), one).score("a b") == 1.0
    assert X.train(make_docs([]), none).score("") == 0.0
