"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words joined by single spaces and one end mark.
Each byte is a path of binary decisions through a Huffman tree of the corpus.
For context orders 1 to 5 a hashed table predicts each decision from how often
it went either way after that context.  The predictions are mixed in the
logistic domain with weights chosen by a gate (the longest context that is
well known, and the place in the word), and an adaptive map from gate and
mixed probability refines the result.  Every decision's two probabilities sum
to one, so the score is the log10 probability of the whole sequence.

Learning: counts come from the training texts of one part, weights (online
gradient steps over the stream of decisions, averaged over tasks) and the
adaptive map from those of the other.  Tables are hashed to a fixed size, so
the model fits a broadcast at any corpus size; what is counted and shuffled
(distinct 6-grams per task, token postings) grows with the corpus.

The base score needs the exact count of every token.  Postings of each chunk
of documents are dealt by token hash; each bucket sums the counts and returns
per-document partial sums, so neither texts nor the vocabulary move as rows.

Defined cases: NULL and empty texts are the end mark alone; repeated rows are
scored separately and counted as often as they occur; with nothing to learn
from, predictions are even and the base follows its formula; NULL doc_ids are
held in training; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import stage, text_batches
from framewise.llm.tokens import LOWER, SPACE_SEPARATED, U, Slice, mix, slices, word_hashes, words

ORDERS = 5
SLOT_BITS = (16, 18, 20, 21, 22)            # of the tables for context orders 1 to 5
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
RANGE_BITS = 16
GRAM_PARTS = 256
PLACES = ORDERS + 1                          # bytes since the last space, at most ORDERS
GATES = (ORDERS + 1) * PLACES
BUCKETS = 33                                # of the adaptive map
SLICE = 3 << 20
END = 10
CHUNK_DOCS = 8192                           # a chunk is full with these; a last batch may add to them, below 2**16
DOCS_PER_BUCKET = 32_000


def normalised(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the modelled sequences of a slice and their offsets."""
    n = len(s.offsets) - 1
    data = np.insert(LOWER[s.data], s.offsets[1:], 32)
    ends = s.offsets[1:] + np.arange(1, n + 1)              # after insertion, exclusive
    word = SPACE_SEPARATED[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    data = np.where(word, data, 32)
    starts = ends - np.diff(s.offsets) - 1
    count = np.concatenate([[0], np.cumsum(word)])
    keep[(ends - 1)[count[ends] == count[starts]]] = True
    # a kept separator belongs to the word before it, never to another text
    offsets = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    out = data[keep].astype(np.uint8)
    out[offsets[1:] - 1] = END
    return out, offsets


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its five predecessors (end marks before the start)."""
    n = len(data)
    wide = data.astype(U)
    key = wide.copy()
    for j in range(1, ORDERS + 1):
        before = np.full(n, END, U)
        before[j:] = wide[:max(n - j, 0)]
        for t in range(j):
            first = offsets[:-1] + t
            before[first[first < offsets[1:]]] = END
        key |= before << U(8 * j)
    return key


@dataclass
class Code:
    """Huffman code over bytes: per symbol the tree nodes passed, the bits
    taken there, and how many."""
    nodes: np.ndarray
    bits: np.ndarray
    length: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, number = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], number, number))
        number += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            for bit, child in enumerate(children[node]):
                stack.append((child, [*path, (node - 256, bit)]))
    width = max(map(len, paths.values()))
    nodes, bits = np.zeros((256, width), np.int64), np.zeros((256, width), np.int8)
    for s, path in paths.items():
        for j, (node, bit) in enumerate(path):
            nodes[s, j], bits[s, j] = node, bit
    return Code(nodes, bits, np.array([len(paths[s]) for s in range(256)]))


def contexts(keys: np.ndarray) -> list[np.ndarray]:
    return [mix((keys >> U(8) & U((1 << 8 * k) - 1)) * U(0x9E3779B97F4A7C15) + U(k)) for k in range(1, ORDERS + 1)]


def slots(context: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    return ((context ^ (node.astype(U) * U(0xD6E8FEB86659FD93))) * U(0xC2B2AE3D27D4EB4F) >> U(64 - SLOT_BITS[order - 1])).astype(np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Model:
    code: Code
    table: np.ndarray       # uint16: 12 bits of stretched probability, 4 bits of log2 count
    weights: np.ndarray     # gate x (orders + bias)
    refine: np.ndarray      # gate x bucket: stretched probability

    def plain(self) -> tuple:
        """Arrays alone, for a broadcast that needs no class to be read."""
        return (self.code.nodes, self.code.bits, self.code.length), self.table, self.weights, self.refine

    @staticmethod
    def of(plain: tuple) -> "Model":
        return Model(Code(*plain[0]), *plain[1:])

    def decisions(self, keys: np.ndarray):
        """Per level of the tree: rows, bits, inputs and gates."""
        symbol = (keys & U(255)).astype(np.int64)
        context = contexts(keys)
        length = self.code.length[symbol]
        rows = np.arange(len(keys))
        place, inside = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for k in range(1, ORDERS + 1):
            inside &= SPACE_SEPARATED[(keys >> U(8 * k) & U(255)).astype(np.int64)]
            place += inside
        for j in range(int(length.max(initial=0))):
            rows = rows[length[rows] > j]
            node, bit = self.code.nodes[symbol[rows], j], self.code.bits[symbol[rows], j]
            inputs = np.empty((ORDERS + 1, len(rows)), np.float32)
            inputs[ORDERS] = 0.3
            known = np.zeros(len(rows), np.int64)
            for k in range(1, ORDERS + 1):
                cell = self.table[STARTS[k - 1] + slots(context[k - 1][rows], node, k)]
                inputs[k - 1] = ((cell >> 4).astype(np.float32) - 2048.0) * (1 / 170.0)
                known[(cell & 15) >= 2] = k
            yield rows, bit, inputs, known * PLACES + place[rows]

    def mixed(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        z = w[gate, ORDERS] * inputs[ORDERS]
        for k in range(ORDERS):
            z += w[gate, k] * inputs[k]
        return np.clip(z, -11.9, 11.9)

    def log10(self, keys: np.ndarray, batch: int = 1 << 16) -> np.ndarray:
        if len(keys) > batch:
            return np.concatenate([self.log10(keys[a:a + batch]) for a in range(0, len(keys), batch)])
        out = np.zeros(len(keys))
        for rows, bit, inputs, gate in self.decisions(keys):
            z = self.mixed(inputs, gate)
            z = 0.5 * (z + self.refine[gate, _bucket(z)])
            out[rows] -= np.logaddexp(0.0, np.where(bit, -z, z))
        return out / np.log(10.0)

    def learn(self, keys: np.ndarray, counts: np.ndarray, rate: float, batch: int = 8192) -> int:
        """Online gradient steps on the mixing weights, in the given order."""
        steps = 0
        for a in range(0, len(keys), batch):
            for rows, bit, inputs, gate in self.decisions(keys[a:a + batch]):
                weight = counts[a:a + batch][rows]
                miss = (bit - squash(self.mixed(inputs, gate))) * weight
                total = np.bincount(gate, weight, GATES) + 64.0
                for k in range(ORDERS + 1):
                    self.weights[:, k] += rate * np.bincount(gate, miss * inputs[k], GATES) / total
                steps += len(rows)
        return steps


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.rint((z + 12.0) * ((BUCKETS - 1) / 24.0)).astype(np.int64)


def _unique(texts: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in texts:
        for s in slices(batch.column(column), SLICE):
            yield np.unique(grams(*normalised(s)), return_counts=True)


def _merge(a, b):
    keys, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([a[1], b[1]])).astype(np.int64)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(part, keys, counts): distinct 6-grams of all texts with their counts,
    dealt by the two bytes before the last, so every longer context of a
    decision lies in one part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = (np.zeros(0, U), np.zeros(0, np.int64))
        for found in _unique(batches, 0):
            have = _merge(have, found)
        part = (mix(have[0] >> U(8) & U(0xFFFF)) >> U(56)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(GRAM_PARTS + 1))
        rows = [(p, have[0][order[a:b]].tobytes(), have[1][order[a:b]].astype(np.uint32).tobytes())
                for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                         names=["part", "keys", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        keys, inverse = np.unique(np.concatenate([np.frombuffer(x, U) for x in frame["keys"]]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.uint32) for x in frame["counts"]])).astype(np.int64)
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "keys": [keys.tobytes()], "counts": [total.tobytes()]})

    return stage(texts.select("text").mapInArrow(count, "part long, keys binary, counts binary")
                 .groupBy("part").applyInPandas(add, "part long, keys binary, counts binary"), "lm-grams")


def _byte_counts(counted: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256)
        for b in batches:
            for k, c in zip(b["keys"], b["counts"]):
                total += np.bincount((np.frombuffer(k, U) & U(255)).astype(np.int64), np.frombuffer(c, np.int64), 256)
        yield pd.DataFrame({"byte": np.arange(256), "n": total})

    out = np.zeros(256)
    for r in counted.mapInPandas(run, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def build_table(counted: DataFrame, code: Code) -> np.ndarray:
    """All orders' tables in one array of fixed length."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, c in zip(b["keys"], b["counts"]):
                keys, count = np.frombuffer(k, U), np.frombuffer(c, np.int64)
                symbol, context = (keys & U(255)).astype(np.int64), contexts(keys)
                length, rows = code.length[symbol], np.arange(len(keys))
                at, taken, n = [], [], []
                for j in range(int(length.max(initial=0))):
                    rows = rows[length[rows] > j]
                    node, bit = code.nodes[symbol[rows], j], code.bits[symbol[rows], j]
                    for o in range(1, ORDERS + 1):
                        at.append(STARTS[o - 1] + slots(context[o - 1][rows], node, o))
                        taken.append(bit)
                        n.append(count[rows])
                key, inverse = np.unique(np.concatenate(at) * 2 + np.concatenate(taken), return_inverse=True)
                n = np.bincount(inverse, np.concatenate(n)).astype(np.int64)
                group = key >> (RANGE_BITS + 1)
                cut = np.flatnonzero(np.diff(group)) + 1
                parts = np.split(np.arange(len(key)), cut)
                yield pd.DataFrame({"range": [int(group[p[0]]) for p in parts],
                                    "at": [(key[p] & ((2 << RANGE_BITS) - 1)).astype(np.uint32).tobytes() for p in parts],
                                    "n": [n[p].tobytes() for p in parts]})

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(2 << RANGE_BITS)
        for a, c in zip(frame["at"], frame["n"]):
            n[np.frombuffer(a, np.uint32)] += np.frombuffer(c, np.int64)
        n0, n1 = n[0::2], n[1::2]
        z = np.log((n1 + 0.4) / (n0 + 0.4))
        level = np.minimum(np.ceil(np.log2(n0 + n1 + 1)), 15).astype(np.int64)
        cell = np.clip(np.rint(z * 170.0) + 2048, 0, 4095).astype(np.int64) << 4 | level
        return pd.DataFrame({"range": [frame["range"].iloc[0]], "cells": [cell.astype(np.uint16).tobytes()]})

    out = np.full(int(STARTS[-1]), 2048 << 4, np.uint16)
    for r in counted.mapInPandas(spread, "range long, at binary, n binary").groupBy("range") \
            .applyInPandas(close, "range long, cells binary").collect():
        a = r["range"] << RANGE_BITS
        out[a:a + (1 << RANGE_BITS)] = np.frombuffer(bytes(r["cells"]), np.uint16)
    return out


def _learn_weights(texts: DataFrame, model: Model, rate: float) -> np.ndarray:
    shared = texts.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own = Model.of(shared.value)
        own.weights = own.weights.copy()
        steps = 0
        for keys, counts in _unique(batches, 0):
            order = np.argsort(mix(keys))           # a fixed order without runs of like contexts
            steps += own.learn(keys[order], counts[order].astype(float), rate)
        if steps:
            w = own.weights.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w * steps), pa.array(np.full(len(w), float(steps)))],
                                             names=["i", "w", "n"])

    out = model.weights.copy().ravel()
    for r in texts.select("text").mapInArrow(run, "i long, w double, n double").groupBy("i") \
            .agg((F.sum("w") / F.sum("n")).alias("w")).collect():
        out[r["i"]] = r["w"]
    return out.reshape(model.weights.shape)


def _learn_refinement(texts: DataFrame, model: Model) -> np.ndarray:
    shared = texts.sparkSession.sparkContext.broadcast(model.plain())
    cells = GATES * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros(2 * cells), Model.of(shared.value)
        for all_keys, all_counts in _unique(batches, 0):
            for a in range(0, len(all_keys), 1 << 16):
                keys, counts = all_keys[a:a + (1 << 16)], all_counts[a:a + (1 << 16)]
                for rows, bit, inputs, gate in now.decisions(keys):
                    at = gate * BUCKETS + _bucket(now.mixed(inputs, gate))
                    total += np.bincount(2 * at + bit, counts[rows], 2 * cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    n = np.zeros(2 * cells)
    for r in texts.select("text").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        n[r["i"]] = r["n"]
    n = n.reshape(GATES, BUCKETS, 2)
    p = squash((np.arange(BUCKETS) * (24.0 / (BUCKETS - 1)) - 12.0))[None, :]
    return np.log((n[:, :, 1] + 16 * p) / (n[:, :, 0] + 16 * (1 - p)))


def train(counting: DataFrame, weighing: DataFrame, rate: float = 0.1) -> Model:
    """``counting`` fills the predictors, ``weighing`` teaches the mixer."""
    counted = gram_counts(counting)
    code = huffman(_byte_counts(counted))
    even = np.tile(np.arange(BUCKETS) * (24.0 / (BUCKETS - 1)) - 12.0, (GATES, 1))
    weights = np.full((GATES, ORDERS + 1), 0.3)
    weights[:, ORDERS] = 0.0
    model = Model(code, build_table(counted, code), weights, even)
    model.weights = _learn_weights(weighing, model, rate)
    model.refine = _learn_refinement(weighing, model)
    return model


SCAN_SCHEMA = "chunk long, bucket int, docs binary, held binary, tokens binary, score binary, ids binary, missing binary, hash binary, train binary, posts binary, times binary"
BINARIES = ("docs", "held", "tokens", "score", "ids", "missing", "hash", "train", "posts", "times")


class _Chunk:
    """Scores and token hashes of consecutive documents, without their texts."""

    def __init__(self):
        self.n, self.parts = 0, []

    def add(self, batch: pa.RecordBatch, model: Model) -> None:
        ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for s in slices(batch.column(2), SLICE):
            data, offsets = normalised(s)
            keys, inverse = np.unique(grams(data, offsets), return_inverse=True)
            score = np.add.reduceat(model.log10(keys)[inverse], offsets[:-1])
            del keys, inverse
            w = words(data, offsets, SPACE_SEPARATED)
            own = ids.slice(s.first, s.last - s.first)
            self.parts.append((own.fill_null(0).to_numpy().astype(np.int64), own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                               held[s.first:s.last], np.diff(w.bounds) + 1, score, word_hashes(data, w), (w.row() + s.first + self.n).astype(np.uint16)))
        self.n += batch.num_rows

    def rows(self, serial: int, buckets: int) -> list[dict]:
        ids, missing, out, tokens, score, h, row = (np.concatenate(x) for x in zip(*self.parts))
        blank = dict.fromkeys(BINARIES, None)
        rows = [blank | {"chunk": serial, "bucket": -1, "held": out.tobytes(), "tokens": tokens.astype(np.int64).tobytes(),
                         "score": score.tobytes(), "ids": ids.tobytes(), "missing": missing.tobytes()}]
        order = np.argsort(h, kind="stable")            # rows ascend within a hash: they came in order
        ho, ro = h[order], row[order]
        new = np.ones(len(ho), bool)
        new[1:] = (ho[1:] != ho[:-1]) | (ro[1:] != ro[:-1])
        post = np.flatnonzero(new)
        times = np.diff(np.append(post, len(ho)))
        ph, pd_ = ho[post], ro[post]
        first = np.flatnonzero(np.concatenate([[True], ph[1:] != ph[:-1]])) if len(ph) else np.zeros(0, np.int64)
        learned = np.add.reduceat(times * (out[pd_] == 0), first) if len(first) else first
        n_posts = np.diff(np.append(first, len(ph)))
        bucket = ((ph[first] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        for b in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            x, y = first[lo], first[hi] if hi < len(first) else len(ph)
            rows.append(blank | {"chunk": serial, "bucket": int(b), "hash": ph[first[lo:hi]].tobytes(),
                                 "train": learned[lo:hi].astype(np.uint32).tobytes(), "posts": n_posts[lo:hi].astype(np.uint32).tobytes(),
                                 "docs": pd_[x:y].tobytes(), "times": times[x:y].astype(np.uint32).tobytes()})
        return rows


def scan(docs: DataFrame, model: Model, held: Column, buckets: int) -> DataFrame:
    """Per chunk of documents: one row (bucket -1) with ids, token counts and
    model scores, and one per token-hash bucket with the chunk's postings."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, now = TaskContext.get().partitionId() << 32, Model.of(shared.value)
        schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in BINARIES)])
        chunk = _Chunk()
        for batch in batches:
            chunk.add(batch, now)
            if chunk.n >= CHUNK_DOCS:
                yield pa.RecordBatch.from_pylist(chunk.rows(serial, buckets), schema=schema)
                serial, chunk = serial + 1, _Chunk()
        if chunk.n:
            yield pa.RecordBatch.from_pylist(chunk.rows(serial, buckets), schema=schema)

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(run, SCAN_SCHEMA), "lm-scan")


def _bucket_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of a bucket's tokens, and per chunk the documents' sums."""
    hashes = [np.frombuffer(x, U) for x in frame["hash"]]
    keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.uint32) for x in frame["train"]]))
    value, known = np.log10(count + 0.1), (count > 0).astype(float)
    out, at = [], 0
    for chunk, h, posts, docs, times in zip(frame["chunk"], hashes, frame["posts"], frame["docs"], frame["times"]):
        mine = np.repeat(inverse[at:at + len(h)], np.frombuffer(posts, np.uint32))
        at += len(h)
        d, t = np.frombuffer(docs, np.uint16).astype(np.int64), np.frombuffer(times, np.uint32)
        who = np.flatnonzero(np.bincount(d))
        out.append((chunk, 0.0, 0, who.astype(np.uint16).tobytes(), np.bincount(d, value[mine] * t)[who].tobytes(),
                    np.bincount(d, known[mine] * t)[who].astype(np.uint32).tobytes()))
    out.append((-1, float(count.sum()), int((count > 0).sum()), b"", b"", b""))
    return pd.DataFrame(out, columns=["chunk", "n", "v", "docs", "sums", "known"])


def lm_scores(docs: DataFrame, held: Column, weighing: Column) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score.  Rows with ``held`` teach nothing; of the others,
    those with ``weighing`` teach the mixer and the rest the predictors."""
    text_batches(docs.sparkSession)
    seen = docs.where(~held)
    model = train(seen.where(~weighing), seen.where(weighing))
    n_docs = docs.count()
    found = scan(docs, model, held, max(32, -(-n_docs // DOCS_PER_BUCKET)))
    sums = stage(found.where("bucket >= 0").select("bucket", "chunk", "hash", "train", "posts", "docs", "times")
                 .groupBy("bucket").applyInPandas(lambda f: _bucket_sums(f.sort_values("chunk")).assign(bucket=int(f["bucket"].iloc[0])),
                                                  "chunk long, n double, v long, docs binary, sums binary, known binary, bucket int"), "lm-sums")
    # the end mark is a token too: one per training text
    ends = docs.where(~held).count()
    total = sums.where("chunk < 0").agg(F.sum("n"), F.sum("v")).first()
    n = int(total[0] or 0) + ends
    v = int(total[1] or 0) + (ends > 0)
    below = float(np.log10(n + 0.1 * (v + 1)))
    end_value = float(np.log10(ends + 0.1))

    def close(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in a.itertuples():
            tokens = np.frombuffer(x.tokens, np.int64)
            sums_, known = np.full(len(tokens), end_value), np.full(len(tokens), int(ends > 0), np.int64)
            for y in b[b["chunk"] == x.chunk].sort_values("bucket").itertuples():
                at = np.frombuffer(y.docs, np.uint16)
                sums_[at] += np.frombuffer(y.sums, np.float64)
                known[at] += np.frombuffer(y.known, np.uint32)
            ids = pd.array(np.frombuffer(x.ids, np.int64).copy(), dtype="Int64")
            ids[np.frombuffer(x.missing, np.uint8) > 0] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(x.held, np.uint8) > 0, "n_tokens": tokens, "n_known": known,
                                     "train_tokens": n, "base_score": sums_ - tokens * below, "score": np.frombuffer(x.score, np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    rows = found.where("bucket < 0").select("chunk", "held", "tokens", "score", "ids", "missing")
    return rows.groupBy("chunk").cogroup(sums.where("chunk >= 0").select("chunk", "bucket", "docs", "sums", "known").groupBy("chunk")) \
        .applyInPandas(close, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
