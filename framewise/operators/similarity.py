"""Product similarity without an all-pairs comparison.

The modelled index one-hot encodes five attributes (frame shape, material,
colour, gender, category), adds a min-max scaled price ordinal and takes the
cosine of every pair of SKUs.  With one-hot columns each SKU vector holds k
ones (k = attributes that are non-NULL and not constant over the catalogue;
a constant one-hot column scales to 0) plus the price value p, so

    cos(i, j) = (m_ij + p_i * p_j) / sqrt((k_i + p_i^2) * (k_j + p_j^2))

where m_ij is the number of equal (non-NULL, non-constant) attributes.

Consequences used here:

* SKUs collapse to **profiles** (p, five attributes): similarity depends on
  the profile only, and the number of profiles is bounded by the attribute
  domains, not by the number of SKUs.
* Partners are found by **blocking** on shared attribute values, from all
  five down to none, and only for profiles whose partners could still improve
  (see :func:`_top_partners`).  No pair of SKUs that shares nothing is formed
  unless a partner with less in common can be among the best.
* A threshold (spill-over, >= 0.70) translates into the least number of
  shared attributes with which a profile can reach it.

Each profile keeps at most ``n + 1`` SKUs (smallest ids) via a per-group
row-number limit that Spark applies before the shuffle, so a profile
holding a third of all SKUs never moves whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions.expr import title_case
from framewise.session import stage

# The attributes that are compared.
ATTRS = ["frame_shape", "material", "color", "gender", "category"]
# Ordinal of the price band (NULL / unknown -> 2).
PRICE_POINT_ORD = {"budget": 1, "mid": 2, "premium": 3, "luxury": 4}


def _price_ordinal(c: F.Column) -> F.Column:
    expr = None
    for label, v in PRICE_POINT_ORD.items():
        expr = F.when(c == label, F.lit(float(v))) if expr is None else expr.when(c == label, F.lit(float(v)))
    return expr.otherwise(F.lit(2.0))


def _catalogue(products: DataFrame) -> DataFrame:
    """The columns that similarity compares, staged: ``products`` may be a view
    that sums all sales, and it is read once for the scales, the profiles and
    the partners' attributes."""
    return stage(products.select("sku_id", "price_point", *ATTRS), "catalogue")


def sku_profiles(products: DataFrame) -> DataFrame:
    """Per SKU: scaled price ``p``, the five attributes with constant ones
    set to NULL, and ``k`` (number of active attributes)."""
    ords = products.select("sku_id", *ATTRS, _price_ordinal(F.col("price_point")).alias("_o"))
    stats_aggs = [F.min("_o").alias("_omin"), F.max("_o").alias("_omax"), F.count(F.lit(1)).alias("_n")]
    for a in ATTRS:
        stats_aggs += [F.count_distinct(a).alias(f"_d_{a}"), F.count(a).alias(f"_c_{a}")]
    stats = ords.agg(*stats_aggs)
    j = ords.crossJoin(F.broadcast(stats))
    cols = ["sku_id",
            F.when(F.col("_omax") == F.col("_omin"), F.lit(0.0))
             .otherwise((F.col("_o") - F.col("_omin")) / (F.col("_omax") - F.col("_omin"))).alias("p")]
    for a in ATTRS:
        constant = (F.col(f"_d_{a}") == 1) & (F.col(f"_c_{a}") == F.col("_n"))
        cols.append(F.when(constant, F.lit(None).cast("string")).otherwise(F.col(a)).alias(a))
    prof = j.select(*cols)
    k = reduce(lambda x, y: x + y, [F.col(a).isNotNull().cast("int") for a in ATTRS])
    return prof.withColumn("k", k)


def similarity_features(products: DataFrame) -> DataFrame:
    """Sparse long form of the scaled feature matrix (A51): one row per SKU
    and non-zero feature — ``price_point_enc`` (scaled ordinal) and one
    ``<attribute>_<value>`` row of 1.0 per active attribute."""
    prof = sku_profiles(products)
    price = prof.where(F.col("p") != 0).select("sku_id", F.lit("price_point_enc").alias("feature"),
                                               F.col("p").alias("value"))
    onehots = [prof.where(F.col(a).isNotNull())
                   .select("sku_id", F.concat(F.lit(a + "_"), F.col(a)).alias("feature"), F.lit(1.0).alias("value"))
               for a in ATTRS]
    return reduce(DataFrame.unionByName, [price] + onehots)


def _profile_table(prof: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The SKUs with their profile's id (staged, so that the other two do not
    make the profiles anew), and the profiles with an id, SKU count and their
    ``keep`` smallest SKU ids."""
    key = ["p", *ATTRS]
    pid = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key])
    skus = stage(prof.withColumn("pid", pid), "skus")
    w = Window.partitionBy("pid").orderBy("sku_id")
    members = (skus.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
                   .select("pid", "sku_id", "_rn"))
    profiles = skus.groupBy("pid", *key, "k").agg(F.count(F.lit(1)).alias("n_skus"))
    return skus, profiles, members


def _score(m: F.Column, pa: F.Column, pb: F.Column, ka: F.Column, kb: F.Column) -> F.Column:
    den = F.sqrt((ka + pa * pa) * (kb + pb * pb))
    return F.when(den == 0, F.lit(0.0)).otherwise((m + pa * pb) / den)


def _cells(profiles: DataFrame) -> list[tuple[float, int]]:
    """The (p, k) pairs that occur: at most one per price band, share of the
    band range and attribute count, whatever the number of SKUs."""
    return [(float(r["p"]), int(r["k"])) for r in profiles.select("p", "k").distinct().orderBy("p", "k").collect()]


def _best_at(m: int, cells: list[tuple[float, int]]) -> F.Column:
    """The best score a profile can reach with a partner that shares exactly
    ``m`` attributes, over the (p, k) pairs that occur; -1 where none can."""
    options = [_score(F.lit(float(m)), F.col("p"), F.lit(p), F.col("k").cast("double"), F.lit(float(k))) for p, k in cells if k >= m]
    if not options:
        return F.lit(-1.0)
    best = options[0] if len(options) == 1 else F.greatest(*options)
    return F.when(F.col("k") >= m, best).otherwise(F.lit(-1.0))


def _shared_keys(df: DataFrame, level: int) -> DataFrame:
    """A row per ``level``-subset of the attributes whose values are all
    present: ``mask`` names the subset, ``vals`` holds the values."""
    parts = []
    for subset in combinations(ATTRS, level):
        present = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in subset], F.lit(True))
        key = F.concat_ws("\u0001", *[F.col(c) for c in subset]) if subset else F.lit("")
        parts.append(F.when(present, F.struct(F.lit("".join(str(ATTRS.index(c)) for c in subset)).alias("mask"), key.alias("vals"))))
    return df.withColumn("_key", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull()))) \
        .select("*", F.col("_key.mask").alias("mask"), F.col("_key.vals").alias("vals")).drop("_key")


def _top_partners(profiles: DataFrame, members: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best SKUs for every query profile (itself included), ties
    to the smaller id.

    Level by level from all attributes shared down to none: SKUs are grouped
    by the shared values and by (p, k), and the first ``keep`` ids of a group
    are enough, because within it every SKU scores at least as much as one
    that shares just these values.  A profile is finished once no partner with
    fewer shared attributes can reach its ``keep``-th score; this bound is
    taken over the (p, k) pairs that occur, so it also holds where attributes
    are NULL or constant.  Level 0 groups all SKUs by (p, k), so partners that
    share nothing are found too."""
    cells = _cells(profiles)
    known = members.join(profiles, "pid").select("sku_id", "p", "k", *ATTRS)
    best, pending = None, queries
    for level in range(len(ATTRS), -1, -1):
        first = Window.partitionBy("mask", "vals", "p", "k").orderBy("sku_id")
        group = (_shared_keys(known, level).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep)
                 .select("mask", "vals", *[F.col(c).alias(f"b_{c}") for c in ("sku_id", "p", "k", *ATTRS)]))
        if level == 0:
            group = F.broadcast(group)          # at most ``keep`` rows for each (p, k)
        shared = reduce(lambda x, y: x + y, [F.coalesce((F.col(c) == F.col(f"b_{c}")).cast("double"), F.lit(0.0)) for c in ATTRS])
        found = (_shared_keys(pending, level).join(group, ["mask", "vals"])
                 .select("pid", F.col("b_sku_id").alias("similar_sku_id"),
                         _score(shared, F.col("p"), F.col("b_p"), F.col("k").cast("double"), F.col("b_k").cast("double"))
                         .alias("similarity_score")).distinct())
        every = found if best is None else best.unionByName(found).distinct()
        order = Window.partitionBy("pid").orderBy(F.col("similarity_score").desc(), "similar_sku_id")
        best = every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n").checkpoint()
        if level == 0:
            break
        reached = best.groupBy("pid").agg(F.count(F.lit(1)).alias("_c"), F.min("similarity_score").alias("_t"))
        possible = reduce(F.greatest, [_best_at(m, cells) for m in range(level)]) if level > 1 else _best_at(0, cells)
        pending = (pending.join(reached, "pid", "left")
                   .where((F.coalesce("_c", F.lit(0)) < keep) | (possible >= F.col("_t"))).drop("_c", "_t").checkpoint())
        if pending.isEmpty():
            break
    return best


def _top_table(asked: DataFrame, best: DataFrame, products: DataFrame, top_n: int) -> DataFrame:
    """Partners of the SKUs in ``asked`` (sku_id, pid) from their profiles'.
    SKUs are spread before each becomes ``top_n + 1`` rows: their table can be
    one small file, and the ranks below need them by ``sku_id`` anyway."""
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # a number, as small rows would be merged into one task
    per_sku = asked.select("sku_id", "pid").repartition(parts, "sku_id").join(best, "pid").where(F.col("sku_id") != F.col("similar_sku_id"))
    w2 = Window.partitionBy("sku_id").orderBy(F.col("similarity_score").desc(), F.col("similar_sku_id"))
    top = (per_sku.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= top_n)
                  .select("sku_id", "rank", "similar_sku_id", "similarity_score"))
    meta = products.select(F.col("sku_id").alias("similar_sku_id"), "frame_shape", "material", "color",
                           "price_point")
    return top.join(meta, "similar_sku_id", "left").select(
        "sku_id", "rank", "similar_sku_id", "similarity_score", "frame_shape", "material", "color",
        "price_point")


def similar_skus_all(products: DataFrame, top_n: int = 5, only: F.Column | None = None) -> DataFrame:
    """Top-n most similar other SKUs for **every** SKU (A56), or for the SKUs
    for which ``only`` (over ``sku_id``) holds; ties broken by the smaller SKU
    id; columns ``sku_id, rank, similar_sku_id, similarity_score`` plus the
    partner's frame_shape, material, colour and price point.  There are always
    n partners where the catalogue has n other SKUs."""
    keep = top_n + 1
    products = _catalogue(products)
    skus, profiles, members = _profile_table(sku_profiles(products), keep)
    profiles, members = profiles.checkpoint(), members.checkpoint()
    asked = skus if only is None else skus.where(only)
    queries = profiles if only is None else profiles.join(asked.select("pid").distinct(), "pid", "left_semi")
    best = _top_partners(profiles, members, queries, keep)
    return _top_table(asked, best, products, top_n)


def similar_skus(products: DataFrame, sku_id, top_n: int = 5) -> DataFrame:
    """Top-n similar SKUs of one SKU (A53); empty for an unknown SKU.
    ``sku_id`` may be a literal or a scalar Column.  Partners are searched for
    the profile of this SKU alone."""
    target = sku_id if isinstance(sku_id, F.Column) else F.lit(sku_id)
    return similar_skus_all(products, top_n, only=F.col("sku_id") == target)


@dataclass
class SimilarityIndex:
    """Partners of every profile, kept between runs.

    ``skus`` has a row per SKU with its profile (sku_id, pid, p, k and the
    attributes), ``partners`` the ``top_n + 1`` best SKUs of every profile.
    Both grow with SKUs and profiles, never with pairs."""

    skus: DataFrame
    partners: DataFrame
    top_n: int

    @classmethod
    def build(cls, products: DataFrame, top_n: int = 5) -> "SimilarityIndex":
        skus, profiles, members = _profile_table(sku_profiles(_catalogue(products)), top_n + 1)
        profiles, members = profiles.checkpoint(), members.checkpoint()
        return cls(skus, _top_partners(profiles, members, profiles, top_n + 1), top_n)

    def save(self, path: str) -> None:
        """Write the index; rows of a profile lie together, so that a lookup
        by ``pid`` skips the other files and row groups.  ``path`` must not
        be the one this index was loaded from: Spark reads it while writing."""
        for name, table in (("skus", self.skus), ("partners", self.partners)):
            table.repartitionByRange("pid").sortWithinPartitions("pid").write.mode("overwrite").parquet(f"{path}/{name}")
        self.skus.sparkSession.createDataFrame([(self.top_n,)], "top_n int").write.mode("overwrite").json(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SimilarityIndex":
        top_n = spark.read.schema("top_n int").json(f"{path}/state").first()["top_n"]
        return cls(spark.read.parquet(f"{path}/skus"), spark.read.parquet(f"{path}/partners"), top_n)

    def similar(self, products: DataFrame) -> DataFrame:
        """As :func:`similar_skus_all`, from the index; the partners'
        attributes come from ``products``."""
        return _top_table(self.skus, self.partners, products, self.top_n)

    def refresh(self, products: DataFrame) -> "SimilarityIndex":
        """The index of the catalogue ``products``, which holds new SKUs.

        Known profiles meet the new SKUs alone, and their lists are merged:
        the best of old and new are among the best of each.  New profiles
        search the whole catalogue.  Where an indexed SKU is gone or has
        another profile (its attributes changed, or the price scale or a
        constant attribute did, which moves all), the index is built anew."""
        keep = self.top_n + 1
        products = _catalogue(products)
        skus, profiles, members = _profile_table(sku_profiles(products), keep)
        if not self.skus.join(skus, ["sku_id", "pid"], "left_anti").isEmpty():
            return self.build(products, self.top_n)
        fresh = skus.join(self.skus, "sku_id", "left_anti")
        if fresh.isEmpty():
            return SimilarityIndex(skus, self.partners, self.top_n)
        profiles, members = profiles.checkpoint(), members.checkpoint()
        _, fresh_profiles, fresh_members = _profile_table(fresh.drop("pid"), keep)
        fresh_profiles, fresh_members = fresh_profiles.checkpoint(), fresh_members.checkpoint()
        known = self.skus.select("pid").distinct()
        old = profiles.join(known, "pid", "left_semi").checkpoint()
        unseen = profiles.join(known, "pid", "left_anti").checkpoint()
        parts = [self.partners, _top_partners(fresh_profiles, fresh_members, old, keep)]
        if not unseen.isEmpty():
            parts.append(_top_partners(profiles, members, unseen, keep))
        columns = ["pid", "similar_sku_id", "similarity_score"]
        order = Window.partitionBy("pid").orderBy(F.col("similarity_score").desc(), "similar_sku_id")
        merged = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])
        best = merged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n").checkpoint()
        return SimilarityIndex(skus, best, self.top_n)


def demand_spillover(products: DataFrame, inventory: DataFrame, query_skus: DataFrame,
                     min_similarity: float = 0.70) -> DataFrame:
    """For each of a short list of query SKUs: other SKUs with similarity >=
    ``min_similarity`` joined to their store rows with more than 30 days of
    supply (A58).

    A query profile meets, per level, the profiles that share a subset of
    that many attributes; the level is the least at which its best possible
    score reaches the threshold (0 compares the short list with every
    profile)."""
    skus, profiles, _ = _profile_table(sku_profiles(_catalogue(products)), 1)
    profiles = profiles.checkpoint()
    cells = _cells(profiles)
    q = (query_skus.select("sku_id").distinct().join(skus.select("sku_id", "pid"), "sku_id")
                   .withColumnRenamed("sku_id", "query_sku_id"))
    q_prof = profiles.join(q.select("pid").distinct(), "pid", "left_semi")
    need = reduce(lambda rest, m: F.when(_best_at(m, cells) >= min_similarity, F.lit(m)).otherwise(rest),
                  range(len(ATTRS), -1, -1), F.lit(None).cast("int"))
    q_prof = q_prof.withColumn("_need", need).where("_need is not null").checkpoint()
    shared = reduce(lambda x, y: x + y, [F.coalesce((F.col(c) == F.col(f"b_{c}")).cast("double"), F.lit(0.0)) for c in ATTRS])
    parts = []
    for level in [r["_need"] for r in q_prof.select("_need").distinct().orderBy("_need").collect()]:
        other = _shared_keys(profiles, level).select("mask", "vals", *[F.col(c).alias(f"b_{c}") for c in ("pid", "p", "k", *ATTRS)])
        parts.append(_shared_keys(q_prof.where(F.col("_need") == level), level).join(other, ["mask", "vals"]).select(
            "pid", "b_pid", _score(shared, F.col("p"), F.col("b_p"), F.col("k").cast("double"), F.col("b_k").cast("double"))
            .alias("similarity_score")))
    if not parts:
        scored = q_prof.select("pid", F.col("pid").alias("b_pid"), F.lit(0.0).alias("similarity_score")).limit(0)
    else:
        scored = reduce(DataFrame.unionByName, parts).where(F.col("similarity_score") >= min_similarity).distinct()
    cand = (q.join(scored, "pid")
             .join(skus.select(F.col("pid").alias("b_pid"), F.col("sku_id").alias("similar_sku_id")), "b_pid")
             .where(F.col("similar_sku_id") != F.col("query_sku_id")))
    stocked = inventory.where(F.col("days_of_supply") > 30).select(
        F.col("sku_id").alias("similar_sku_id"), "store_id", "days_of_supply", "quantity_on_hand")
    return cand.join(stocked, "similar_sku_id").select(
        "query_sku_id", "similar_sku_id", "similarity_score", "store_id", "days_of_supply", "quantity_on_hand")


# ---- clustering and projection ------------------------------------------------

MAX_FEATURES = 4096         # distinct attribute labels a projection may have


def profile_weights(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sku_id, pid`` of every SKU, and each profile once with the number of
    its SKUs: what the catalogue's size adds ends here."""
    skus, profiles, _ = _profile_table(sku_profiles(_catalogue(products)), 1)
    return skus.select("sku_id", "pid"), profiles.orderBy("pid").checkpoint()


def feature_vectors(profiles: DataFrame) -> DataFrame:
    """Dense feature vectors (price + one-hot attributes) for ML: StringIndexer
    and OneHotEncoder with the NULL/unseen bucket dropped, so NULL or constant
    attributes contribute zeros as in the modelled scaling."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    idx = [StringIndexer(inputCol=a, outputCol=f"{a}_ix", handleInvalid="keep", stringOrderType="alphabetAsc")
           for a in ATTRS]
    ohe = OneHotEncoder(inputCols=[f"{a}_ix" for a in ATTRS], outputCols=[f"{a}_oh" for a in ATTRS],
                        dropLast=True, handleInvalid="keep")
    asm = VectorAssembler(inputCols=["p"] + [f"{a}_oh" for a in ATTRS], outputCol="features")
    model = Pipeline(stages=[*idx, ohe, asm]).fit(profiles)
    return model.transform(profiles)


@dataclass
class Clusters:
    assigned: DataFrame         # products with cluster_id and cluster_label
    centres: list[list[float]]
    inertias: list[float]       # of each start
    vectors: DataFrame          # pid, features, n_skus
    members: DataFrame          # sku_id, pid


def fit_clusters(products: DataFrame, n_clusters: int = 10, starts: int = 10, seed: int = 42) -> Clusters:
    """KMeans over the profiles, each weighing as many SKUs as it has, from
    ``starts`` initial choices of centres; the start with the least inertia
    (the sum of squared distances, first of equals) is kept."""
    from pyspark.ml.clustering import KMeans

    members, profiles = profile_weights(products)
    vec = feature_vectors(profiles).select("pid", "features", F.col("n_skus").cast("double").alias("n_skus")).persist()
    best, inertias = None, []
    for i in range(starts):
        model = KMeans(k=n_clusters, seed=seed + i, featuresCol="features", predictionCol="cluster_id", weightCol="n_skus",
                       maxIter=50).fit(vec)
        inertias.append(model.summary.trainingCost)
        if inertias[-1] == min(inertias) and inertias.count(inertias[-1]) == 1:
            best = model
    assigned = members.join(best.transform(vec).select("pid", "cluster_id"), "pid").drop("pid")
    df = products.join(assigned, "sku_id")
    labels = df.groupBy("cluster_id").agg(
        F.coalesce(F.mode("price_point", deterministic=True), F.lit("mid")).alias("_pp"),
        F.coalesce(F.mode("material", deterministic=True), F.lit("acetate")).alias("_mat"),
        F.coalesce(F.mode("frame_shape", deterministic=True), F.lit("round")).alias("_fs"),
    ).select("cluster_id", F.concat_ws(" ", title_case("_pp"), title_case("_mat"),
                                       F.initcap(F.regexp_replace("_fs", "_", " "))).alias("cluster_label"))
    return Clusters(df.join(F.broadcast(labels), "cluster_id"),       # a row per cluster
                    [c.tolist() for c in best.clusterCenters()], inertias, vec, members)


def cluster_products(products: DataFrame, n_clusters: int = 10, starts: int = 10, seed: int = 42) -> DataFrame:
    """The products with their cluster and a readable label from the most
    frequent price point, material and frame shape (ties: alphabetical) (A54)."""
    return fit_clusters(products, n_clusters, starts, seed).assigned


def cluster_distances(found: Clusters) -> DataFrame:
    """Per SKU: its cluster, and the squared distance to the centre of its own
    cluster and to the nearest one, computed anew from the vectors."""
    from pyspark.ml.functions import vector_to_array

    centres = F.array(*[F.array(*map(F.lit, c)) for c in found.centres])
    away = F.transform(centres, lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    near = found.vectors.select("pid", vector_to_array("features").alias("x")).select("pid", away.alias("_d"))
    return (found.assigned.select("sku_id", "cluster_id").join(found.members, "sku_id").join(near, "pid")
            .select("sku_id", "cluster_id", F.get("_d", "cluster_id").alias("own"), F.array_min("_d").alias("nearest")))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """SKU count per cluster label."""
    return clustered.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("sku_count"))


def _profile_features(profiles: DataFrame) -> DataFrame:
    """``pid, n_skus, feature, value``: the non-zero features of each profile,
    at most six rows."""
    entries = [F.when(F.col("p") != 0, F.struct(F.lit("price_point_enc").alias("feature"), F.col("p").alias("value")))]
    entries += [F.when(F.col(a).isNotNull(), F.struct(F.concat(F.lit(a + "_"), F.col(a)).alias("feature"), F.lit(1.0).alias("value"))) for a in ATTRS]
    return profiles.select("pid", "n_skus", F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull())))


@dataclass
class Projection:
    features: list[str]
    loadings: list[list[float]]     # one list per component
    means: list[float]
    explained: list[float]          # share of the total variance

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, f, float(x), float(self.explained[k])) for k, own in enumerate(self.loadings) for f, x in zip(self.features, own)]
        return spark.createDataFrame(rows, "component int, feature string, loading double, explained double")


def fit_projection(profiles: DataFrame, components: int = 2) -> Projection:
    """Principal components from co-occurrence counts: with one-hot features
    the covariance follows from how many SKUs have each pair of features, so
    one aggregation over the profiles gives it in closed form.  A component's
    sign makes its largest loading positive (of loadings equal to a millionth,
    the one of the first feature)."""
    import numpy as np

    x = _profile_features(profiles)
    y = x.select("pid", F.col("feature").alias("other"), F.col("value").alias("v"))
    total = profiles.agg(F.sum("n_skus")).first()[0] or 0
    names = [r["feature"] for r in x.select("feature").distinct().orderBy("feature").limit(MAX_FEATURES + 1).collect()]
    if len(names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    at = {f: i for i, f in enumerate(names)}
    mean, second = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in x.groupBy("feature").agg(F.sum(F.col("value") * F.col("n_skus")).alias("s")).collect():
        mean[at[r["feature"]]] = r["s"] / total
    for r in x.join(y, "pid").groupBy("feature", "other").agg(F.sum(F.col("value") * F.col("v") * F.col("n_skus")).alias("s")).collect():
        second[at[r["feature"]], at[r["other"]]] = r["s"]
    cov = (second - total * np.outer(mean, mean)) / max(total - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    loadings = []
    for k in range(1, min(components, len(names)) + 1):
        v = vectors[:, -k]
        lead = int(np.flatnonzero(np.abs(v) >= np.abs(v).max() * (1 - 1e-6))[0])
        loadings.append((v if v[lead] > 0 else -v).tolist())
    share = [float(values[-k] / values.sum()) if values.sum() > 0 else 0.0 for k in range(1, len(loadings) + 1)]
    return Projection(names, loadings, mean.tolist(), share)


def pca_coordinates(products: DataFrame, components: int = 2) -> DataFrame:
    """``sku_id, PC1, PC2``: the centred feature vectors on their first
    principal components, made per profile."""
    members, profiles = profile_weights(products)
    fit = fit_projection(profiles, components)
    names = [f"PC{k + 1}" for k in range(components)]
    offsets = [sum(m * x for m, x in zip(fit.means, own)) for own in fit.loadings]
    rows = [(f, *[float(own[i]) for own in fit.loadings]) for i, f in enumerate(fit.features)]
    loadings = products.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"l{k} double" for k in range(len(fit.loadings))))
    placed = (_profile_features(profiles).join(F.broadcast(loadings), "feature").groupBy("pid")       # at most MAX_FEATURES rows
              .agg(*[F.sum(F.col("value") * F.col(f"l{k}")).alias(f"s{k}") for k in range(len(fit.loadings))]))
    columns = [(F.coalesce(f"s{k}", F.lit(0.0)) - F.lit(offsets[k])).alias(n) if k < len(fit.loadings) else F.lit(0.0).alias(n)
               for k, n in enumerate(names)]
    return members.join(placed, "pid", "left").select("sku_id", *columns)


def pca_map(products: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """2-D PCA of the (centred) feature vectors with cluster and product
    fields for the map (A57)."""
    clustered = clustered if clustered is not None else cluster_products(products)
    return pca_coordinates(products).join(clustered.select("sku_id", "cluster_id", "cluster_label", "name", "frame_shape",
                                                           "price_point"), "sku_id")
