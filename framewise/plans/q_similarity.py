"""Registered queries: product similarity.

The oracle compares every pair of SKUs with the closed-form cosine (DuckDB
handles the 4 M pairs of the check scale); the Spark side never forms all
pairs (see ``framewise.operators.similarity``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewise.operators import recommend as R
from framewise.operators import similarity as SIM
from framewise.plans.registry import register
from framewise.session import checkpoint_dir, stage

_ATTRS = SIM.ATTRS
PROFILE_CTES = [
    ("ords", """SELECT sku_id, frame_shape, material, color, gender, category,
                       CASE price_point WHEN 'budget' THEN 1.0::DOUBLE WHEN 'mid' THEN 2.0::DOUBLE
                            WHEN 'premium' THEN 3.0::DOUBLE WHEN 'luxury' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS o
                FROM products"""),
    ("st", "SELECT min(o) AS omin, max(o) AS omax, count(*) AS n, "
           + ", ".join(f"count(DISTINCT {a}) AS d_{a}, count({a}) AS c_{a}" for a in _ATTRS) + " FROM ords"),
    ("prof0", "SELECT sku_id, CASE WHEN omax = omin THEN 0.0::DOUBLE ELSE (o - omin) / (omax - omin) END AS p, "
              + ", ".join(f"CASE WHEN d_{a} = 1 AND c_{a} = n THEN NULL ELSE {a} END AS {a}" for a in _ATTRS)
              + " FROM ords, st"),
    ("prof", "SELECT *, " + " + ".join(f"CAST({a} IS NOT NULL AS INTEGER)" for a in _ATTRS) + " AS k FROM prof0"),
]
_M = " + ".join(f"coalesce(CAST(a.{a} = b.{a} AS INTEGER), 0)" for a in _ATTRS)
_SCORE = ("CASE WHEN sqrt((CAST(a.k AS DOUBLE) + a.p * a.p) * (CAST(b.k AS DOUBLE) + b.p * b.p)) = 0 THEN 0.0::DOUBLE "
          f"ELSE (CAST({_M} AS DOUBLE) + a.p * b.p) / sqrt((CAST(a.k AS DOUBLE) + a.p * a.p) * "
          "(CAST(b.k AS DOUBLE) + b.p * b.p)) END")
TOP_CTES = PROFILE_CTES + [
    ("allpairs", f"""SELECT a.sku_id, b.sku_id AS similar_sku_id, {_SCORE} AS similarity_score
                     FROM prof a JOIN prof b ON a.sku_id <> b.sku_id"""),
    ("ranked", """SELECT * FROM (
                    SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY similarity_score DESC, similar_sku_id)
                      AS rank FROM allpairs) r WHERE rank <= 5"""),
    ("top", """SELECT r.sku_id, CAST(r.rank AS INTEGER) AS rank, r.similar_sku_id, r.similarity_score,
                      p.frame_shape, p.material, p.color, p.price_point
               FROM ranked r LEFT JOIN products p ON r.similar_sku_id = p.sku_id"""),
]


@register("similarity_features", floats=["value"], extra=PROFILE_CTES, sql=(
    "SELECT sku_id, 'price_point_enc' AS feature, p AS value FROM prof WHERE p <> 0 "
    + " ".join(f"UNION ALL SELECT sku_id, '{a}_' || {a} AS feature, 1.0::DOUBLE AS value FROM prof "
               f"WHERE {a} IS NOT NULL" for a in _ATTRS)))
def _features(a):
    return SIM.similarity_features(a.products)


@register("similar_skus_all", floats=["similarity_score"], extra=TOP_CTES, sql="SELECT * FROM top")
def _top_all(a):
    return SIM.similar_skus_all(a.products, 5)


@register("similarity_index_refreshed", floats=["similarity_score"], extra=TOP_CTES, sql="SELECT * FROM top")
def _index_refreshed(a):
    # indexed before the last year's launches, saved, loaded, then brought up to the whole catalogue
    spark, launched = a.t.spark, F.col("launch_date").cast("date")
    products = stage(a.products.select("sku_id", "price_point", *_ATTRS, "launch_date"), "products")   # a view over all sales
    last = products.agg(F.max(launched).alias("last")).select(F.add_months("last", -12)).scalar()
    path = f"{checkpoint_dir(spark).rstrip('/')}/similarity-{uuid.uuid4().hex}"
    SIM.SimilarityIndex.build(products.where(launched <= last), 5).save(path)
    return SIM.SimilarityIndex.load(spark, path).refresh(products).similar(products)


_TOP_SELLER = ("(SELECT sku_id FROM (SELECT sku_id, sum(quantity_sold) AS q FROM sales GROUP BY sku_id) s "
               "ORDER BY q DESC, sku_id LIMIT 1)")


@register("similar_skus", floats=["similarity_score"], extra=TOP_CTES,
          sql=f"SELECT * FROM top WHERE sku_id = {_TOP_SELLER}")
def _top_one(a):
    top_seller = (a.sales_lines.groupBy("sku_id").agg(F.sum("quantity_sold").alias("q"))
                  .orderBy(F.col("q").desc(), "sku_id").limit(1).select("sku_id").scalar())
    return SIM.similar_skus(a.products, top_seller, 5)


@register("similar_alternatives", extra=TOP_CTES, sql="""
SELECT sku_id, string_agg(similar_sku_id, ',' ORDER BY rank) AS similar_alternatives
FROM top WHERE rank <= 3 GROUP BY sku_id""")
def _alternatives(a):
    return R.similar_alternatives(SIM.similar_skus_all(a.products, 3), 3)


@register("demand_spillover", floats=["similarity_score", "days_of_supply"], extra=PROFILE_CTES + [
    ("crit", """SELECT sku_id FROM (SELECT sku_id, avg(days_of_supply) AS d FROM inventory GROUP BY sku_id)
                WHERE d < 7 ORDER BY d, sku_id LIMIT 5"""),
], sql=f"""
SELECT a.sku_id AS query_sku_id, b.sku_id AS similar_sku_id, {_SCORE} AS similarity_score,
       i.store_id, i.days_of_supply, i.quantity_on_hand
FROM prof a JOIN prof b ON a.sku_id <> b.sku_id
JOIN inventory i ON i.sku_id = b.sku_id AND i.days_of_supply > 30
WHERE a.sku_id IN (SELECT sku_id FROM crit) AND {_SCORE} >= 0.7
""")
def _spillover(a):
    # the operator takes a short list of SKUs: the five that run out first
    short = (a.inventory.groupBy("sku_id").agg(F.avg("days_of_supply").alias("d")).where("d < 7")
             .orderBy("d", "sku_id").limit(5).select("sku_id"))
    return SIM.demand_spillover(a.products, a.inventory, short, 0.70)


@register("cluster_products", note="KMeans; rows-only check")
def _clusters(a):
    return SIM.cluster_products(a.products).select("sku_id", "cluster_id", "cluster_label", "price_point",
                                                   "material", "frame_shape")


@register("cluster_summary", note="KMeans; rows-only check")
def _cluster_summary(a):
    return SIM.cluster_summary(SIM.cluster_products(a.products))


@register("pca_map", note="PCA; rows-only check")
def _pca(a):
    return SIM.pca_map(a.products)


@register("cluster_check", extra=[("n", "SELECT count(*) AS skus FROM products")], sql="""
SELECT CAST(k AS INTEGER) AS cluster_id, CAST(0 AS BIGINT) AS n_away, true AS in_use, (SELECT skus FROM n) AS n_skus, true AS least_kept
FROM range(10) t(k)""")
def _cluster_check(a):
    """What holds of any right clustering: each SKU belongs to its nearest
    centre, every SKU is in one cluster, all ten are used, and no start was
    better than the one kept."""
    found = SIM.fit_clusters(a.products)
    d = SIM.cluster_distances(found)
    kept = d.agg(F.sum("own")).first()[0]
    per = d.groupBy("cluster_id").agg(F.sum((F.col("own") > F.col("nearest") + 1e-9).cast("long")).alias("n_away"), F.count(F.lit(1)).alias("n"))
    return per.select("cluster_id", "n_away", (F.col("n") > 0).alias("in_use"), F.lit(d.count()).cast("long").alias("n_skus"),
                      F.lit(kept <= min(found.inertias) * (1 + 1e-9) + 1e-9).alias("least_kept"))


SQUARINGS = 20


def _eigen_ctes(matrix: str, out: str) -> list[tuple[str, str]]:
    """The leading eigenvector of the symmetric ``matrix(a, b, x)`` by repeated
    squaring, its sign as the operator has it, and its eigenvalue."""
    ctes = [(f"{out}_p0", f"SELECT a, b, x / (SELECT max(abs(x)) FROM {matrix}) AS x FROM {matrix}")]
    for i in range(SQUARINGS):
        ctes += [(f"{out}_q{i}", f"SELECT l.a, r.b, sum(l.x * r.x) AS x FROM {out}_p{i} l JOIN {out}_p{i} r ON l.b = r.a GROUP BY l.a, r.b"),
                 (f"{out}_p{i + 1}", f"SELECT a, b, x / (SELECT max(abs(x)) FROM {out}_q{i}) AS x FROM {out}_q{i}")]
    last = f"{out}_p{SQUARINGS}"
    return ctes + [
        (f"{out}_u", f"SELECT a AS f, x / sqrt((SELECT sum(x * x) FROM {last} WHERE b = m)) AS l FROM {last}, "
                     f"(SELECT a AS m FROM {last} WHERE a = b ORDER BY x DESC, a LIMIT 1) WHERE b = m"),
        (out, f"SELECT f, l * (SELECT CASE WHEN l > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM {out}_u "
              f"WHERE abs(l) >= (SELECT max(abs(l)) FROM {out}_u) * (1 - 1e-6::DOUBLE) ORDER BY f LIMIT 1) AS l FROM {out}_u"),
        (f"{out}_value", f"SELECT sum(x.l * c.x * y.l) AS value FROM {matrix} c JOIN {out} x ON x.f = c.a JOIN {out} y ON y.f = c.b")]


PCA_CTES = PROFILE_CTES + [
    ("pf", "SELECT sku_id, 'price_point_enc' AS f, p AS v FROM prof WHERE p <> 0 "
           + " ".join(f"UNION ALL SELECT sku_id, '{a}_' || {a}, 1.0::DOUBLE FROM prof WHERE {a} IS NOT NULL" for a in _ATTRS)),
    ("total", "SELECT CAST(count(*) AS DOUBLE) AS n FROM prof"),
    ("means", "SELECT f, sum(v) / (SELECT n FROM total) AS m FROM pf GROUP BY f"),
    ("co_occurs", "SELECT x.f AS a, y.f AS b, sum(x.v * y.v) AS s FROM pf x JOIN pf y ON x.sku_id = y.sku_id GROUP BY x.f, y.f"),
    ("cov", "SELECT x.f AS a, y.f AS b, (coalesce(s, 0) - n * x.m * y.m) / (n - 1) AS x FROM means x CROSS JOIN means y CROSS JOIN total "
            "LEFT JOIN co_occurs ON co_occurs.a = x.f AND co_occurs.b = y.f"),
    *_eigen_ctes("cov", "pc1"),
    ("cov2", "SELECT a, b, c.x - (SELECT value FROM pc1_value) * x.l * y.l AS x FROM cov c JOIN pc1 x ON x.f = c.a JOIN pc1 y ON y.f = c.b"),
    *_eigen_ctes("cov2", "pc2"),
    ("spread", "SELECT sum(x) AS s FROM cov WHERE a = b"),
]


@register("pca_components", floats=["loading", "explained"], digits=6, extra=PCA_CTES, sql="""
SELECT CAST(1 AS INTEGER) AS component, f AS feature, l AS loading, (SELECT value FROM pc1_value) / (SELECT s FROM spread) AS explained FROM pc1
UNION ALL SELECT CAST(2 AS INTEGER), f, l, (SELECT value FROM pc2_value) / (SELECT s FROM spread) FROM pc2""")
def _components(a):
    return SIM.fit_projection(SIM.profile_weights(a.products)[1]).table(a.t.spark)


@register("pca_coordinates", floats=["PC1", "PC2"], digits=6, extra=PCA_CTES, sql="""
SELECT s.sku_id, coalesce(sum(v * pc1.l), 0) - (SELECT sum(m * l) FROM means JOIN pc1 ON pc1.f = means.f) AS "PC1",
       coalesce(sum(v * pc2.l), 0) - (SELECT sum(m * l) FROM means JOIN pc2 ON pc2.f = means.f) AS "PC2"
FROM prof s LEFT JOIN pf ON pf.sku_id = s.sku_id LEFT JOIN pc1 ON pc1.f = pf.f LEFT JOIN pc2 ON pc2.f = pf.f GROUP BY s.sku_id""")
def _coordinates(a):
    return SIM.pca_coordinates(a.products)
