"""Benchmark decontamination by winnowing.

Words of documents and benchmark items are hashed; every run of ``window``
words holds ``window - k + 1`` k-grams, of which winnowing keeps the one with
the least hash.  A shared run of ``window`` words therefore always shares a
kept fingerprint.  A bitmap of fixed size built from the benchmark's
fingerprints sits on every task; where a document's fingerprint is in it, the
hit is extended to each run of ``window`` words around the fingerprint, and
those runs are joined to the benchmark's runs on a 128-bit digest of their
text.  The bitmap can only let too much through, the join decides.  Items with
fewer than ``window`` words are one run; their lengths are tested at every
position.

Defined cases: NULL or empty texts have no words, an item without words never
occurs, an item with a NULL id hits like any other but is on no list of items,
repeated documents are separate rows, an empty benchmark hits nothing, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import bitmap as bitmaps
from framewise.llm.common import stage, text_batches
from framewise.llm.tokens import ALNUM, U, gram_hashes, slices, word_hashes, words

WINDOW = 10
K = 5
BITS = 24               # bitmap of 2**24 bits, 2 MB, whatever the benchmark's size

RUN_SCHEMA = "item_id string, n int, run binary, slot long"
DOC_SCHEMA = "row_id long, doc_id long, n_words long, runs array<struct<start:int,n:int,run:binary>>"


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h ^ U(salt * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))) >> U(64 - BITS)).astype(np.int64)


def _window_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``g[i : i + w]`` for every start that has ``w`` entries."""
    out, have = g, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _digest(low: np.ndarray, w, a: int, n: int) -> bytes:
    text = b" ".join(low[w.starts[j]:w.ends[j]].tobytes() for j in range(a, a + n))
    return hashlib.blake2b(text, digest_size=16).digest()


def _runs_here(end: np.ndarray, n: int) -> np.ndarray:
    """Word indices at which a run of ``n`` words stays inside its row."""
    return np.flatnonzero(np.arange(len(end)) + n <= end)


def benchmark_runs(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per item and run, and one per item and kept fingerprint (then
    ``run`` is NULL); ``slot`` is the bitmap position."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for s in slices(batch.column(1)):
                low = s.lowered()
                w = words(low, s.offsets, ALNUM)
                h = word_hashes(low, w)
                g = gram_hashes(h, k)
                rows = []
                for r in range(s.last - s.first):
                    a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                    n = min(window, b - a)
                    if n == 0:
                        continue
                    item = ids[s.first + r]
                    full = gram_hashes(h[a:b], n)
                    at = _slots(full, n)
                    rows += [(item, n, _digest(low, w, i, n), int(at[i - a])) for i in range(a, b - n + 1)]
                    if n == window:
                        kept = np.unique(_window_min(g[a:b - k + 1], window - k + 1))
                        rows += [(item, 0, None, int(x)) for x in _slots(kept, 0)]
                item, n, run, slot = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(run, pa.binary()), pa.array(slot, pa.int64())],
                    names=["item_id", "n", "run", "slot"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(build, RUN_SCHEMA)


def candidate_runs(docs: DataFrame, bitmap: np.ndarray, short: list[int], window: int = WINDOW, k: int = K,
                   row: str | None = None) -> DataFrame:
    """One row per document with its word count and the runs whose kept
    fingerprint and own hash are both in the bitmap; ``row`` names a column
    that numbers the rows."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(bitmap)

    def known(at: np.ndarray) -> np.ndarray:
        return bitmaps.test(shared.value, at)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(2)):
                low = s.lowered()
                w = words(low, s.offsets, ALNUM)
                h = word_hashes(low, w)
                end, row = w.row_end(), w.row()
                hits: list[tuple[int, int]] = []
                full = _runs_here(end, window)
                if len(full):
                    g = gram_hashes(h, k)
                    least = _window_min(g[:len(g) - k + 1], window - k + 1)[full]
                    near = full[known(_slots(least, 0))]
                    if len(near):
                        whole = gram_hashes(h, window)[near]
                        hits += [(int(i), window) for i in near[known(_slots(whole, window))]]
                for n in short:
                    at = _runs_here(end, n)
                    if len(at):
                        hits += [(int(i), n) for i in at[known(_slots(gram_hashes(h, n)[at], n))]]
                per: list[list] = [[] for _ in range(s.last - s.first)]
                for i, n in hits:
                    per[row[i]].append({"start": i - int(w.bounds[row[i]]), "n": n, "run": _digest(low, w, i, n)})
                take = slice(s.first, s.last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[take], batch.column(1)[take], pa.array(np.diff(w.bounds), pa.int64()),
                     pa.array(per, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("run", pa.binary())])))],
                    names=["row_id", "doc_id", "n_words", "runs"])

    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(scan, DOC_SCHEMA)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, row: str | None = None) -> DataFrame:
    """Per document row: row_id (from ``row`` where given), doc_id, n_words, n_hit, spans (word intervals
    hit, merged) and items (distinct item ids as sorted strings)."""
    bench = stage(benchmark_runs(items, window, k), "bench-runs")
    short = sorted(r["n"] for r in bench.where(F.col("n").between(1, window - 1)).select("n").distinct().collect())
    found = stage(candidate_runs(docs, bitmaps.build(bench, F.col("slot"), BITS), short, window, k, row), "candidate-runs")
    by_run = bench.where("run is not null").groupBy("run", "n") \
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = found.select("row_id", F.explode("runs").alias("r")).select("row_id", "r.start", "r.n", "r.run")
    joined = hits.join(by_run, ["run", "n"])
    merged = F.aggregate(
        F.array_sort("at"),
        F.lit([]).cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when(
            F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"], F.lit(False)),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                     F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                                      F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["start"] + x["n"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("stop"))))))
    per = joined.groupBy("row_id").agg(
        F.collect_list(F.struct("start", "n")).alias("at"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")) \
        .select("row_id", merged.alias("spans"), "items")
    return found.select("row_id", "doc_id", "n_words").join(per, "row_id", "left").select(
        "row_id", "doc_id", "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]).cast("long")), F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.lit([]).cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.coalesce("items", F.lit([]).cast("array<string>")).alias("items"))


def contaminated_rows(docs: DataFrame, items: DataFrame, row: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """The numbers in column ``row`` of the rows with a hit."""
    return contamination(docs, items, window, k, row).where("n_hit > 0").select(F.col("row_id").alias(row))
