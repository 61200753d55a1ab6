"""Similarity against all pairs, on catalogues that strain the blocking."""

import math
import random

import pytest

from framewise.operators import similarity as SIM

FIELDS = ["sku_id", "price_point", *SIM.ATTRS]


def catalogue(kind: str, n: int = 60):
    rng = random.Random(kind)
    rows = []
    for i in range(n):
        r = {"sku_id": f"S{i:03d}", "price_point": rng.choice(["budget", "mid", "premium", "luxury", None])}
        for a in SIM.ATTRS:
            r[a] = rng.choice("xyz")
        if kind == "constant":
            r["category"] = "one"
        if kind == "nulls":
            r |= {a: None for a in SIM.ATTRS if rng.random() < 0.3}
        if kind == "nothing shared":
            r |= {a: f"{a}{i}" for a in SIM.ATTRS}
        if kind == "hot profile" and i % 3:
            r |= {a: "x" for a in SIM.ATTRS} | {"price_point": "mid"}
        if kind == "one price":
            r["price_point"] = "mid"
        rows.append(r)
    return rows


def brute(rows):
    ords = [float({"budget": 1, "mid": 2, "premium": 3, "luxury": 4}.get(r["price_point"], 2)) for r in rows]
    lo, hi = min(ords), max(ords)
    p = [0.0 if hi == lo else (o - lo) / (hi - lo) for o in ords]
    live = [a for a in SIM.ATTRS if len({r[a] for r in rows}) > 1 or rows[0][a] is None]
    k = [sum(r[a] is not None for a in live) for r in rows]
    out = {}
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if i != j:
                m = sum(x[a] is not None and x[a] == y[a] for a in live)
                den = math.sqrt((k[i] + p[i] ** 2) * (k[j] + p[j] ** 2))
                out[x["sku_id"], y["sku_id"]] = (m + p[i] * p[j]) / den if den else 0.0
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], ", ".join(f"{f} string" for f in FIELDS))


KINDS = ["plain", "constant", "nulls", "nothing shared", "hot profile", "one price"]


@pytest.mark.parametrize("kind", KINDS)
def test_top_n_equals_all_pairs(spark, kind):
    rows = catalogue(kind)
    score = brute(rows)
    got = {}
    for r in SIM.similar_skus_all(frame(spark, rows), 5).collect():
        got.setdefault(r["sku_id"], []).append((r["rank"], r["similar_sku_id"], r["similarity_score"]))
    for r in rows:
        s = r["sku_id"]
        exp = sorted((-round(v, 12), b) for (a, b), v in score.items() if a == s)[:5]
        mine = sorted(got[s])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert [round(x[2], 9) for x in mine] == [round(-v, 9) for v, _ in exp]
        assert [x[1] for x in mine] == [b for _, b in exp]


def test_few_skus_and_one_query(spark):
    rows = catalogue("nulls", 4)
    assert SIM.similar_skus_all(frame(spark, rows), 5).count() == 12
    one = SIM.similar_skus(frame(spark, rows), "S002", 2).collect()
    assert [r["sku_id"] for r in one] == ["S002", "S002"]
    assert SIM.similar_skus(frame(spark, rows), "none", 2).count() == 0


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("threshold", [0.7, 0.3, 0.0])
def test_spillover_equals_all_pairs(spark, kind, threshold):
    rows = catalogue(kind, 40)
    score = brute(rows)
    inv = spark.createDataFrame([(r["sku_id"], "st", 40.0, 3) for r in rows],
                                "sku_id string, store_id string, days_of_supply double, quantity_on_hand int")
    asked = ["S001", "S007"]
    got = SIM.demand_spillover(frame(spark, rows), inv, spark.createDataFrame([(x,) for x in asked], "sku_id string"), threshold).collect()
    exp = {(a, b) for (a, b), v in score.items() if a in asked and v >= threshold}
    sure = {(a, b) for (a, b), v in score.items() if a in asked and v >= threshold + 1e-9}
    pairs = [(r["query_sku_id"], r["similar_sku_id"]) for r in got]
    assert len(pairs) == len(set(pairs)) and sure <= set(pairs) <= exp | {x for x in score if abs(score[x] - threshold) < 1e-9}


def lists(df):
    return sorted((r["sku_id"], r["rank"], r["similar_sku_id"], round(r["similarity_score"], 9)) for r in df.collect())


@pytest.mark.parametrize("kind,cut", [("plain", 45), ("nulls", 59), ("hot profile", 30), ("one price", 0)])
def test_index_saved_loaded_and_refreshed_equals_a_rebuild(spark, tmp_path, kind, cut):
    rows = catalogue(kind)
    whole = frame(spark, rows)
    SIM.SimilarityIndex.build(frame(spark, rows[:cut]), 5).save(str(tmp_path / "index"))
    index = SIM.SimilarityIndex.load(spark, str(tmp_path / "index"))
    want = lists(SIM.similar_skus_all(whole, 5))
    assert lists(index.refresh(whole).similar(whole)) == want
    if cut:
        assert lists(index.similar(whole)) == lists(SIM.similar_skus_all(frame(spark, rows[:cut]), 5))


def test_index_refresh_builds_anew_where_profiles_move(spark):
    rows = catalogue("one price", 30)
    index = SIM.SimilarityIndex.build(frame(spark, rows), 3)
    same = index.refresh(frame(spark, rows))
    assert lists(same.similar(frame(spark, rows))) == lists(index.similar(frame(spark, rows)))
    for changed in (rows[:20], rows + [rows[0] | {"sku_id": "T1", "price_point": "luxury"}]):
        now = frame(spark, changed)
        assert lists(index.refresh(now).similar(now)) == lists(SIM.similar_skus_all(now, 3))


def counted(spark, rows):
    """The catalogue as a view that counts the rows it makes."""
    made = spark.sparkContext.accumulator(0)
    rdd = spark.sparkContext.parallelize([tuple(r[f] for f in FIELDS) for r in rows], 2).map(lambda r: (made.add(1), r)[1])
    return spark.createDataFrame(rdd, ", ".join(f"{f} string" for f in FIELDS)), made


def test_catalogue_is_made_once(spark, tmp_path):
    """A catalogue can be a view over all sales: an operator reads it once.
    Two profiles of many SKUs each: the search ends at its first level."""
    rows = [{"sku_id": f"S{i:03d}", "price_point": ("budget", "luxury")[i % 2]} | {a: f"{a}{i % 2}" for a in SIM.ATTRS} for i in range(30)]
    view, made = counted(spark, rows)
    members, profiles = SIM.profile_weights(view)
    assert (members.count(), profiles.count(), made.value) == (30, 2, 30)
    SIM.SimilarityIndex.build(view.where("sku_id < 'S014'"), 5).save(str(tmp_path / "index"))
    assert made.value == 60
    index = SIM.SimilarityIndex.load(spark, str(tmp_path / "index")).refresh(view)
    assert made.value == 90
    got = lists(index.similar(frame(spark, rows)))
    assert len(got) == 150 and got[:5] == [("S000", i, f"S{2 * i:03d}", 1.0) for i in range(1, 6)]
