"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors are cut in 1, 4, 16, ... segments.  With segment means m and standard
deviations s, Cauchy-Schwarz bounds the inner product of two segments of
length L by L * (m m' + s s'), which is the same as a lower bound on their
distance.  A block of candidates is compared with a block of queries coarse to
fine; each resolution takes the exact scores of the best bounds it finds, raises
the query's threshold to the k-th of them, drops the pairs whose bound is below
it, and only the pairs that survive get their exact integer score.

Candidates and queries are packed into blocks of bounded size.  They meet twice:
the first time each block only names the exact scores of its best bounds, whose
k-th over all blocks is a threshold that no answer of the query falls below; the
second time every block starts from that threshold.

Defined cases: vectors that are NULL, empty, or hold NULL or non-finite
components, and rows with a NULL vec_id, take no part; rows that share a
vec_id count once (the vector that is greatest by components); vectors meet
only vectors of their own length; fewer than k candidates give all of them;
ties go to the smaller vec_id; a score beyond 64 bits raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import stage

BLOCK_SCHEMA = "dim int, block long, kind string, n long, ids binary, vectors binary"


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; NULL where any component
    is NULL or not finite."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(embedding) > 0)
    return F.when(ok, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def pack(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """One row per block of about ``rows`` vectors (dealt by hash of vec_id),
    integers in the narrowest type that holds them; and the block count."""
    total = vectors.count()
    blocks = max(1, -(-total // rows))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(v=[tuple(x) for x in frame["q"]]).sort_values(["vec_id", "v"]).drop_duplicates("vec_id", keep="last")
        m = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), key[0])
        low, high = int(m.min()), int(m.max())
        kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "kind": [kind], "n": [len(m)],
                             "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [m.astype(kind).tobytes()]})

    return stage(vectors.withColumn("dim", F.size("q")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
                 .groupBy("dim", "block").applyInPandas(build, BLOCK_SCHEMA), "vector-blocks"), blocks


def _open(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), -1).astype(np.float64)


def _statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(L) * mean and sqrt(L) * deviation per segment: the inner
    product of two such rows bounds that of the vectors."""
    parts = np.array_split(np.arange(m.shape[1]), segments)
    means = np.stack([m[:, p].mean(axis=1) * len(p) ** 0.5 for p in parts], axis=1)
    devs = np.stack([m[:, p].std(axis=1) * len(p) ** 0.5 for p in parts], axis=1)
    return np.concatenate([means, devs], axis=1)


def _levels(dim: int) -> list[int]:
    """1, 4, 16, ... segments, then half as many as there are components."""
    out, s = [], 1
    while s < dim // 2:
        out.append(s)
        s *= 4
    return out + [max(dim // 2, 1)]


class Vectors:
    """The vectors of a block with the statistics of each resolution, made once."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[order], m[order]
        self.norms = np.linalg.norm(self.m, axis=1)
        self._made: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def statistics(self, segments: int) -> np.ndarray:
        if segments not in self._made:
            self._made[segments] = _statistics(self.m, segments)
        return self._made[segments]


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if peak < 2 ** 53:
        return (q @ c.T).astype(np.int64)
    exact = q.astype(np.int64).astype(object) @ c.astype(np.int64).astype(object).T
    return exact.astype(np.int64)           # raises OverflowError beyond 64 bits


def _seeds(bound: np.ndarray, possible: np.ndarray, q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of each query's ``k`` best bounds and the candidates' places."""
    best = np.argpartition(-bound, min(k, len(c)) - 1, axis=1)[:, :k]
    return np.where(np.take_along_axis(possible, best, 1), np.einsum("ij,ikj->ik", q, c[best]), -np.inf), best


def _slack(q: Vectors, c: Vectors) -> np.ndarray:
    """Absorbs the rounding of the bounds, which are sums of dim terms."""
    return 1e-9 * (1 + q.norms * c.norms.max(initial=0))[:, None]


def survivors(q: Vectors, c: Vectors, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that some query may still need, and which pairs; ``known``
    holds a score for each query that its k-th answer reaches."""
    alive, possible, slack = np.arange(len(c)), q.ids[:, None] != c.ids[None, :], _slack(q, c)
    known = known - slack[:, 0]
    for segments in _levels(q.m.shape[1]):
        if segments > 16 and possible.mean() > 0.5:
            break                           # the finest bounds cost as much as the scores they could spare
        bound = q.statistics(segments) @ c.statistics(segments)[alive].T + slack
        bound[~possible] = -np.inf
        if len(alive) >= k:
            known = np.maximum(known, _seeds(bound, possible, q.m, c.m[alive], k)[0].min(axis=1) - slack[:, 0])
        possible &= bound >= known[:, None]
        keep = possible.any(axis=0)
        alive, possible = alive[keep], possible[:, keep]
        if not len(alive):
            break
    return alive, possible


def _pair_scores(q: Vectors, c: Vectors, alive: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, exact score) of the possible pairs."""
    qi, ci = np.nonzero(possible)
    peak = float(np.abs(q.m).max(initial=0)) * float(np.abs(c.m).max(initial=0)) * q.m.shape[1]
    if peak < 2 ** 53 and len(qi) < possible.size / 8:
        parts = [np.einsum("ij,ij->i", q.m[qi[i:i + 65_536]], c.m[alive[ci[i:i + 65_536]]]) for i in range(0, len(qi), 65_536)]
        return qi, alive[ci], np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return qi, alive[ci], _scores(q.m, c.m[alive])[qi, ci]


def block_top(q: Vectors, c: Vectors, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best candidates of one block pair,
    less those that ``known`` rules out."""
    alive, possible = survivors(q, c, k, known)
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    qi, ci, score = _pair_scores(q, c, alive, possible)
    order = np.lexsort((ci, -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    first = np.searchsorted(qi, np.arange(len(q)))
    top = np.arange(len(qi)) - first[qi] < k
    return q.ids[qi[top]], c.ids[ci[top]], score[top]


def block_seeds(q: Vectors, c: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query_id, lower bound of a score) of the k best bounds of a middle
    resolution, for every query of one block pair."""
    possible, slack = q.ids[:, None] != c.ids[None, :], _slack(q, c)
    segments = _levels(q.m.shape[1])[:3][-1]
    bound = q.statistics(segments) @ c.statistics(segments).T + slack
    bound[~possible] = -np.inf
    exact, _ = _seeds(bound, possible, q.m, c.m, k)
    return np.repeat(q.ids, exact.shape[1]), (exact - slack).reshape(-1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_rows: int = 4096, query_rows: int = 1024,
          group_blocks: int = 16) -> DataFrame:
    """The k candidates of greatest inner product for every query.  Both
    tables have ``vec_id`` and integer arrays ``q`` (see :func:`quantised`)."""
    (c, c_blocks), (q, q_blocks) = pack(vectors, candidate_rows), pack(queries, query_rows)
    groups = -(-q_blocks // group_blocks)
    left = c.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (q.withColumn("group", F.floor(F.col("block") / group_blocks).cast("int"))
              .withColumnRenamed("block", "q_block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long")))))

    key, names = ["dim", "block", "group"], ("query_id", "vec_id", "score")

    def pairs(a: pd.DataFrame, b: pd.DataFrame):
        for _, cand in a.iterrows():
            candidates = Vectors(*_open(cand))
            for _, query in b.iterrows():
                ids, m = _open(query)
                for i in range(0, len(ids), 256):
                    yield query, Vectors(ids[i:i + 256], m[i:i + 256]), candidates

    def name_seeds(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [block_seeds(x, y, k) for _, x, y in pairs(a, b)]
        dim = int(a["dim"].iloc[0]) if len(a) else 0
        ids, least = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"dim": np.full(len(ids), dim, np.int32), "query_id": ids, "least": least})

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for query, x, y in pairs(a, b):
            known = dict(zip(query["known_ids"], query["known"])) if query["known_ids"] is not None else {}
            start = np.array([known.get(i, -np.inf) for i in x.ids.tolist()])
            found.append(pd.DataFrame(dict(zip(names, block_top(x, y, k, start)))))
        return pd.concat(found) if found else pd.DataFrame({x: pd.Series(dtype="int64") for x in names})

    met = left.groupBy(*key)
    seeds = met.cogroup(right.groupBy(*key)).applyInPandas(name_seeds, "dim int, query_id long, least double")
    place = Window.partitionBy("dim", "query_id").orderBy(F.desc("least"))
    known = (seeds.withColumn("n", F.row_number().over(place)).where(F.col("n") == k)
             .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
             .groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("query_id", "least"))).alias("known"))     # a block's queries
             .select("dim", F.col("block").alias("q_block"), F.col("known.query_id").alias("known_ids"), F.col("known.least").alias("known")))
    started = right.join(stage(known, "topk-known"), ["dim", "q_block"], "left")
    found = met.cogroup(started.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
