"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are laid end to end in shuffled order on a line of
words, repeated until its target is reached, and the line is cut into blocks
of ``block`` words.  A source with q blocks owns q of Q integer points; the
golden-ratio lattice ``i -> i * g mod Q`` (g coprime to Q and nearest Q / phi)
visits each point once and spreads every source evenly over the schedule.  The
r-th slot of a source takes its r-th block, so each source ends exactly at its
(floored) target and no word is taken more often than the line repeats.

Defined cases: NULL and empty text have size 0 and are never taken; NULL is a
source of its own, ranked last; rows with equal ``doc_id`` are separate
documents; an empty table gives an empty schedule; a source without words has
target 0.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import doc_texts, stage

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 8192
PHI = (5 ** 0.5 - 1) / 2


@dataclass
class Mix:
    documents: DataFrame    # doc_id, copy, size, sid
    sources: DataFrame      # sid, source, source_size, target, quota
    schedule: DataFrame     # sid, rank, slot, doc_id, size, copy, epoch, doc_start, n_words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Targets by weight that sum to ``share * sum(sizes)``; a target stops at
    ``cap`` times its size and the excess is shared again by weight."""
    target = [0.0] * len(sizes)
    active = list(range(len(sizes)))
    rest = share * sum(sizes)
    while active:
        unit = rest / sum(weights[i] for i in active)
        over = [i for i in active if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in active:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            rest -= target[i]
        gone = set(over)
        active = [i for i in active if i not in gone]
    return target


def golden_step(q: int) -> int:
    """The step coprime to ``q`` that is nearest ``q`` / phi."""
    near = max(1, round(q * PHI))
    return next(g for d in range(q + 1) for g in (near + d, near - d) if g > 0 and gcd(g, q) == 1)


def _mulmod(i: np.ndarray, g: int, q: int) -> np.ndarray:
    """i * g mod q without overflow for q below 2**42."""
    high, low = divmod(g, 1 << 21)
    return ((i * high % q << 21) + i * low) % q


def _slot_sources(chunk: int, q: int, g: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = np.arange(chunk * CHUNK, min(q, (chunk + 1) * CHUNK), dtype=np.int64)
    return slot, np.searchsorted(edges, _mulmod(slot, g, q), "right")


def schedule_slots(spark, quotas: Sequence[int]) -> DataFrame:
    """(slot, sid, rank): each source's slots in schedule order, ranked within
    the source by chunk counts and a running sum over chunks, so that a source
    with a third of all slots is spread over many tasks."""
    q = int(sum(quotas))
    g, edges = golden_step(max(q, 1)), np.cumsum(np.array(quotas, np.int64))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk in b["id"]:
                sid, n = np.unique(_slot_sources(int(chunk), q, g, edges)[1], return_counts=True)
                yield pd.DataFrame({"chunk": int(chunk), "sid": sid, "n": n})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, bases in zip(b["chunk"], b["bases"]):
                slot, sid = _slot_sources(int(chunk), q, g, edges)
                base = {int(x["sid"]): int(x["base"]) for x in bases}
                order = np.argsort(sid, kind="stable")
                run = sid[order]
                first = np.searchsorted(run, run)
                start = np.array([base[int(s)] for s in np.unique(run)], np.int64)
                rank = np.arange(len(run)) - first + start[np.searchsorted(np.unique(run), run)]
                yield pd.DataFrame({"slot": slot[order], "sid": run, "rank": rank})

    counts = spark.range(-(-q // CHUNK)).mapInPandas(count, "chunk long, sid int, n long")
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (based.groupBy("chunk").agg(F.collect_list(F.struct("sid", "base")).alias("bases"))
                 .mapInPandas(expand, "slot long, sid int, rank long"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                block: int = 1024, per_bucket: int = 1024, seed: int = 17, max_sources: int = 100_000) -> Mix:
    """Plan the mix.  ``max_sources`` bounds the one table that reaches the
    driver (a row per source); more sources raise instead of being cut."""
    spark = docs.sparkSession
    sized = doc_texts(docs.select("doc_id", "text")).select("doc_id", word_count(F.col("text")).alias("size")) \
        if "source" not in docs.columns else docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"))
    if "source" not in sized.columns:
        sized = sized.withColumn("source", F.lit(None).cast("string"))
    # the copy number tells repeated rows apart: (doc_id, source, size, copy) is a key
    copy = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    narrow = stage(sized.withColumn("copy", F.row_number().over(copy)), "mix-docs")

    found = (narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
                   .limit(max_sources + 1).collect())
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in found]
    targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, cap)
    ends = [min(int(t), int(cap * s)) for t, s in zip(targets, sizes)]
    quotas = [-(-e // block) for e in ends]
    sources = spark.createDataFrame(
        [(i, r["source"], s, t, e, q) for i, (r, s, t, e, q) in enumerate(zip(found, sizes, targets, ends, quotas))],
        "sid int, source string, source_size long, target double, line_end long, quota long")
    keyed = narrow.join(F.broadcast(sources.select("sid", F.col("source").alias("_s"))),
                        F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")

    # place each document on its source's line: a running sum over buckets, then inside the bucket
    buckets = max(1, -(-sum(r["n"] for r in found) // per_bucket))
    placed = keyed.where("size > 0").withColumn("h", F.xxhash64("doc_id", "size", "copy", F.lit(seed))) \
        .withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")) \
        .select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    line = (placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                  .join(base, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
                  .join(F.broadcast(sources.select("sid", "source_size", "line_end")), "sid"))
    pieces = (line.withColumn("epoch", F.explode(F.expr("sequence(0L, (line_end - 1) div source_size)")))
                  .where("start + epoch * source_size < line_end")
                  .withColumn("lo", F.expr("start + epoch * source_size"))
                  .withColumn("hi", F.expr("least(lo + size, line_end)"))
                  .withColumn("rank", F.explode(F.expr(f"sequence(lo div {block}L, (hi - 1) div {block}L)")))
                  .select("sid", "rank", "doc_id", "size", "copy", "epoch",
                          F.expr(f"greatest(lo, rank * {block}L) - lo").alias("doc_start"),
                          F.expr(f"least(hi, (rank + 1) * {block}L) - greatest(lo, rank * {block}L)").alias("n_words")))
    schedule = schedule_slots(spark, quotas).hint("merge").join(pieces, ["sid", "rank"])
    return Mix(keyed, sources, schedule)


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken words."""
    mix = mix_sources(docs, **options)
    key = ["doc_id", "sid", "size", "copy"]
    per = (mix.schedule.select(*key, F.col("n_words").alias("taken"))
           .unionByName(mix.documents.select(*key, F.lit(0).cast("long").alias("taken")))
           .groupBy(*key).agg(F.sum("taken").alias("taken")))
    return per.join(F.broadcast(mix.sources.select("sid", "source_size", "target")), "sid") \
        .select("doc_id", "size", "source_size", "target", "taken")
