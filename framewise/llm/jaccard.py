"""N-gram Jaccard join: documents whose distinct word shingles overlap.

Sets are joined by prefix filtering.  Documents with equal sets are one class.
A sketch of shingle counts over all documents orders shingles rare first; a
set's prefix is so short that two similar sets must share a prefix shingle.
Pairs that share one pass a length, a positional and a suffix filter (a
histogram of the whole set bounds the difference from below), and every
surviving pair is verified once on the full sets.

Near copies by the thousand share their prefixes, so pairs are made in rounds.
First every class meets the two least classes of each of its shingles, then
the next ones up to 16, and last all the others, these in blocks of bounded
size.  What a round links is one component, and later rounds make pairs only
between different components.  Pairs inside a component cannot change the
result, so no link between components is lost and no group is expanded into
all pairs.

Defined cases: NULL, empty and wordless texts have the empty set, link with
nothing and are their own component; fewer words than a shingle make one
shingle of the whole sequence; rows that share a doc_id are one document, so
links of any of them join all; a row with a NULL doc_id links like any other,
its component is named by the least doc_id in it, or NULL; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm import bitmap
from framewise.llm.common import doc_texts, partitions_for, stage
from framewise.llm.components import components
from framewise.llm.tokens import SPACE_SEPARATED, U, gram_hashes, slices, word_hashes, words

SKETCH_BITS = 20
RANGES = 64
TOKEN_BITS = 24
HISTOGRAM = 128
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """Link when ``den * intersection >= num * union``."""
    n: int = 3
    num: int = 90
    den: int = 100

    def least(self, a, b):
        """The least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size: int) -> int:
        return size + (self.num * size // -self.den) + 1

    def least_sql(self, a: str, b: str) -> str:
        both = f"({a} + {b})"
        return f"((({self.num}L * {both}) + {self.num + self.den - 1}L) div {self.num + self.den}L)"


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a text column."""
    for s in slices(column):
        low = s.lowered()
        w = words(low, s.offsets, SPACE_SEPARATED)
        h = word_hashes(low, w)
        g = gram_hashes(h, n)
        for r in range(s.last - s.first):
            a, b = int(w.bounds[r]), int(w.bounds[r + 1])
            if b - a >= n:
                yield s.first + r, np.unique(g[a:b - n + 1])
            else:
                yield s.first + r, gram_hashes(h[a:b], b - a)[:1] if b > a else np.zeros(0, U)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def shingle_sketch(texts: DataFrame, n: int) -> np.ndarray:
    """How many sets hold a shingle of each of 2**SKETCH_BITS hash slots."""
    width = (1 << SKETCH_BITS) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            held, size = [], 0
            for _, s in shingle_sets(batch.column(0), n):
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    total += np.bincount(np.concatenate(held) >> U(64 - SKETCH_BITS), minlength=len(total)).astype(np.uint32)
                    held, size = [], 0
            if size:
                total += np.bincount(np.concatenate(held) >> U(64 - SKETCH_BITS), minlength=len(total)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(RANGES)), pa.array([total[i * width:(i + 1) * width].tobytes() for i in range(RANGES)])],
            names=["part", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in frame["counts"])
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "counts": [np.minimum(total, 2 ** 32 - 1).astype(np.uint32).tobytes()]})

    rows = texts.select("text").mapInArrow(count, "part long, counts binary") \
        .groupBy("part").applyInPandas(add, "part long, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out


def prefixes(texts: DataFrame, sketch: np.ndarray, rule: Rule) -> DataFrame:
    """Per row: doc_id, set size, class key, prefix (rare first) and the set's
    histogram."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, prefix, shape = [], [], [], []
            for _, s in shingle_sets(batch.column(1), rule.n):
                first = np.lexsort((s, shared.value[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]))[:rule.prefix(len(s)) if len(s) else 0]
                size.append(len(s))
                key.append(set_key(s))
                prefix.append(s[first].tobytes())
                shape.append(np.minimum(np.bincount((s >> U(57)).astype(np.int64), minlength=HISTOGRAM), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.binary()),
                 pa.array(shape, pa.binary())], names=["doc_id", "n", "key", "prefix", "shape"])

    return texts.mapInArrow(run, "doc_id long, n long, key binary, prefix binary, shape binary")


def _entries(classes: DataFrame, keep: np.ndarray | None) -> DataFrame:
    """A row per class and prefix shingle; with ``keep``, only shingles whose
    bit is set, with its place, class and set size."""
    shared = None if keep is None else classes.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(0)]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            token = np.concatenate([*found, np.zeros(0, np.uint64)])
            pos = np.concatenate([*(np.arange(len(x)) for x in found), np.zeros(0, np.int64)])
            if shared is None:
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64))], names=["token"])
                continue
            # the low bits: the high ones chose the prefix
            ok = bitmap.test(shared.value, (token & U((1 << TOKEN_BITS) - 1)).astype(np.int64))
            at = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[ok].view(np.int64)), pa.array(pos[ok].astype(np.int32)), *(batch.column(i).take(at) for i in (1, 2, 3))],
                names=["token", "pos", "key", "rep", "n"])

    return classes.select("prefix", "key", "rep", "n").mapInArrow(
        run, "token long" if keep is None else "token long, pos int, key binary, rep long, n long")


PAIR_SCHEMA = "a binary, b binary, a_rep long, b_rep long"


def _suffix_filter(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose histograms leave room for the least intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shape = lambda i: np.frombuffer(b"".join(x.as_py() for x in batch.column(i)), np.uint8).reshape(-1, HISTOGRAM).astype(np.int16)
                na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                apart = np.abs(shape(6) - shape(7)).sum(axis=1)
                batch = batch.filter(pa.array(apart <= na + nb - 2 * rule.least(na, nb)))
            yield batch.select([0, 1, 2, 3])

    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("shape").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_rep", "b_rep", "na", "nb", "sa", "sb") \
        .mapInArrow(run, PAIR_SCHEMA)


def _filtered(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs from rows with (key, rep, n, pos) of both sides as x_*
    and y_*, after the length, positional and suffix filters."""
    first = F.col("x_key") < F.col("y_key")
    pick = lambda lo, hi, name: F.when(first, F.col(lo)).otherwise(F.col(hi)).alias(name)
    kept = (pairs.where("x_key <> y_key")
            .where(f"{rule.num}L * greatest(x_n, y_n) <= {rule.den}L * least(x_n, y_n)")
            .where(f"least(x_n - x_pos, y_n - y_pos) >= {rule.least_sql('x_n', 'y_n')}")
            .select(pick("x_key", "y_key", "a"), pick("y_key", "x_key", "b"), pick("x_rep", "y_rep", "a_rep"), pick("y_rep", "x_rep", "b_rep"))
            .dropDuplicates(["a", "b"]))
    return _suffix_filter(kept, classes, rule)


def _open(marked: DataFrame) -> DataFrame:
    """Shingles whose classes lie in more than one component, and how many
    classes hold them."""
    return marked.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")) \
        .where("lo < hi").select("token", "m")


def _marked(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with the component known so far (their own class at first)."""
    if labels is None:
        return entries.withColumn("component", F.col("rep"))
    return entries.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _with_centers(entries: DataFrame, labels: DataFrame | None, past: int, upto: int) -> DataFrame:
    """Rows of both sides of the pairs of a shingle in which one class has a
    rank beyond ``past`` and up to ``upto``, the other a rank beyond ``past``,
    and whose components differ."""
    marked = _marked(entries.where(F.col("rank") > past), labels)
    if labels is not None:
        marked = marked.join(_open(marked).select("token"), "token", "left_semi")
    side = lambda df, x: df.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("pos", "key", "rep", "n", "component")))
    return side(marked, "x").join(side(marked.where(F.col("rank") <= upto), "y"), "token").where("x_component <> y_component")


def verify(pairs: DataFrame, texts: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (staged) that really link.  Sets are made again for the
    classes in the pairs alone; a bitmap over their least doc_ids spares the
    other texts."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = keys.join(classes.select("key", "first_id"), "key")
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap.build(ids, slot_of("first_id"), TOKEN_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(bitmap.test(wanted.value, batch.column(0).to_numpy())))
            found = [(set_key(s), s.tobytes()) for _, s in shingle_sets(some.column(1), rule.n)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["key", "members"])

    sets = stage(texts.select(slot_of("doc_id").alias("slot"), "text").mapInArrow(fetch, "key binary, members binary")
                 .dropDuplicates(["key"]).join(keys, "key", "left_semi"), "jaccard-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                ok.append(rule.den * both >= rule.num * (len(s) + len(t) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return stage(pairs.join(sets.select(F.col("key").alias("a"), F.col("members").alias("ma")), "a")
                 .join(sets.select(F.col("key").alias("b"), F.col("members").alias("mb")), "b")
                 .select("a_rep", "b_rep", "ma", "mb").mapInArrow(check, "a_rep long, b_rep long"), "jaccard-links")


def slot_of(column: str):
    return F.shiftrightunsigned(F.xxhash64(column), 64 - TOKEN_BITS)


def _between_components(entries: DataFrame, labels: DataFrame, classes: DataFrame, centers: int, rule: Rule) -> DataFrame:
    """Pairs of a shingle that no center took part in and whose components
    differ, made block against block, after all three filters."""
    marked = _marked(entries.where(F.col("rank") > centers), labels)
    open_ = _open(marked).select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rest = marked.join(open_, "token").join(classes.select("key", "shape"), "key") \
        .withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def cross(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        frame = frame.sort_values("key", ignore_index=True)
        left, right = frame[frame["mine"] == i], frame[frame["mine"] == j]
        rn, rp, rc = (right[c].to_numpy() for c in ("n", "pos", "component"))
        shapes = np.frombuffer(b"".join(right["shape"]), np.uint8).reshape(-1, HISTOGRAM).astype(np.int16)
        order = right.index.to_numpy()
        out = []
        for x in left.itertuples():
            ok = (rc != x.component) & ((order > x.Index) | (i != j)) & (rule.num * np.maximum(rn, x.n) <= rule.den * np.minimum(rn, x.n))
            least = rule.least(rn, x.n)
            at = np.flatnonzero(ok & (np.minimum(rn - rp, x.n - x.pos) >= least))
            if len(at):
                mine = np.frombuffer(x.shape, np.uint8).astype(np.int16)
                at = at[np.abs(shapes[at] - mine).sum(axis=1) <= rn[at] + x.n - 2 * least[at]]
            for y in right.iloc[at].itertuples():
                a, b = (x, y) if x.key < y.key else (y, x)
                out.append((a.key, b.key, a.rep, b.rep))
        return pd.DataFrame(out, columns=["a", "b", "a_rep", "b_rep"])

    # a fixed number of partitions: small rows, but much work for each
    tasks = partitions_for(entries.sparkSession, 0, 1)
    return rest.select("token", "i", "j", "mine", "pos", "key", "rep", "n", "shape", "component") \
        .repartition(tasks, "token", "i", "j").groupBy("token", "i", "j").applyInPandas(cross, PAIR_SCHEMA).dropDuplicates(["a", "b"])


def _one_document(filled: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges between the classes of rows that share a doc_id; None where no
    doc_id has two texts."""
    shared = stage(filled.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
                   .where("lo < hi"), "jaccard-shared")
    if shared.isEmpty():
        return None
    rep = classes.select("key", "rep")
    return (filled.join(shared.select("doc_id", "lo"), "doc_id").select("lo", "key").distinct()
            .join(rep.withColumnRenamed("rep", "v"), "key").drop("key")
            .join(rep.select(F.col("key").alias("lo"), F.col("rep").alias("u")), "lo").select("u", "v"))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), centers: tuple[int, ...] = (2, 16)) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id."""
    texts = doc_texts(docs)
    rows = stage(prefixes(texts, shingle_sketch(texts, rule.n), rule).withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    filled = rows.where("n > 0")
    classes = stage(filled.groupBy("key").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        F.first("shape").alias("shape")), "jaccard-classes")
    common = stage(_entries(classes, None).groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token"), "jaccard-common")
    keep = bitmap.build(common, F.expr(f"token & {(1 << TOKEN_BITS) - 1}L"), TOKEN_BITS)
    kept = stage(_entries(classes, keep).join(common, "token", "left_semi"), "jaccard-entries")
    # the rank of a shingle's first classes by key; a limited rank is cut before it shuffles
    first = Window.partitionBy("token").orderBy("key")
    ranked = kept.select("token", "key").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(centers))
    entries = stage(kept.join(ranked, ["token", "key"], "left").withColumn("rank", F.coalesce("rank", F.lit(2 ** 31 - 1))), "jaccard-entries")
    links, labels = None, None
    for past, upto in zip((0, *centers), (*centers, None)):
        found = _filtered(_with_centers(entries, labels, past, upto), classes, rule) if upto else \
            _between_components(entries, labels, classes, past, rule)
        pairs = stage(found, "jaccard-pairs")
        if labels is not None and pairs.isEmpty():
            continue
        new = verify(pairs, texts, classes, rule).select(F.col("a_rep").alias("u"), F.col("b_rep").alias("v"))
        links = new if links is None else links.unionByName(new)
        labels = stage(components(links), "jaccard-labels")
    if (same := _one_document(filled, classes)) is not None:
        labels = stage(components(links.unionByName(same)), "jaccard-labels")
    named = classes.select("key", "rep", "first_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.select("key", "component").join(least, "component").select("key", "component_id")
    # a row without words still belongs to the document whose id it bears
    empty = rows.where("n = 0").select("doc_id", "n")
    bears = filled.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("key").alias("key")) \
        .join(named, "key").select("doc_id", "component_id")
    return filled.select("doc_id", "n", "key").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id") \
        .unionByName(empty.join(bears, "doc_id", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
