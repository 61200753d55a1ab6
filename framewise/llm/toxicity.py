"""Toxicity scores over text restored through a noisy channel.

A character model (trigrams over a-z, "other letter" and "boundary", counted
over every document) says what words look like.  Tokens that mix letters with
look-alike digits or symbols, repeat a letter three times or more, or are
spelled out with separators are treated as noisy: each observed character
opens a lattice of readings (itself, the letters it can stand for, deletion as
a repetition or a separator), and Viterbi finds the most probable one under
channel and character model.  Other tokens have a single reading.

The restored words, and their beginnings of 3 to 6 letters (stems), feed a
logistic regression (Spark ML) fitted on at most ``sample`` labelled rows, of
which equal texts count once.  Scores are the sigmoid of one weighted sum.

Defined cases: NULL and empty texts get the score of a text without any
evidence; several labels of a doc_id count as their maximum, NULL labels are
ignored; without labels of both classes every score is the share of toxic
labels (0.0 without any); repeated rows are scored separately; other columns are
never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import doc_texts, stage, text_batches
from framewise.llm.tokens import slices

# Look-alike characters and the letters they stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~·,'\t"
SUBSTITUTE, REPEAT, SEPARATE, KEEP_SYMBOL = -1.5, -1.0, -0.7, -4.0      # channel log-probabilities
SYMBOLS = 28                                                            # boundary, a-z, other letter

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_CLASS[0xC3:] = 27

EDGE = re.compile(r"^[^\w@$|(<€£+]+|[^\w]+$")
NOISY = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+(<€£].*|.*([^\W\d_])\1\1.*|[^\W\d_](?:[.\-_*~·,'][^\W\d_]){2,})$", re.S)
SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[ \t.\-_*~·]+[^\W\d_]){3,}(?!\w)")


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) from the trigram counts of all texts; at most 28**3
    counts leave the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for s in slices(batch.column(0)):
                c = np.zeros(len(s.data) + 4 + len(s.offsets), np.int64)
                raw = _CLASS[s.data]
                keep = (s.data & 0xC0) != 0x80
                # a boundary between texts, none for continuation bytes, one for runs
                at = np.repeat(np.arange(len(s.offsets) - 1), np.diff(s.offsets))
                c = np.zeros(len(raw) + len(s.offsets) + 1, np.int64)
                where = np.arange(len(raw)) + at + 1
                c[where] = raw
                use = np.ones(len(c), bool)
                use[where] = keep
                c = c[use]
                c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
                c = np.concatenate([[0], c, [0]])
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(SYMBOLS ** 3)
    for r in doc_texts(docs).select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = table.sum(axis=0)                       # back-off: the letter after one letter
    backed = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    return np.log((table + 4 * backed[None]) / (table.sum(axis=2, keepdims=True) + 4))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(observed: str, model: list) -> str:
    """The most probable reading of a noisy chunk (lower case), by Viterbi
    over the last two symbols; non-letters that stay become spaces."""
    paths: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    for o in observed:
        arcs = [(o, 0.0)] if o.isalpha() else [(c, SUBSTITUTE) for c in LOOKALIKES.get(o, "")] + [(" ", KEEP_SYMBOL)]
        nxt: dict[tuple[int, int, str], tuple[float, str]] = {}
        for (a, b, last), (score, out) in paths.items():
            ways = [((b, s, c), score + cost + model[a][b][s], out + c) for c, cost in arcs for s in (_symbol(c),)
                    if not (s == 0 and b == 0)]
            if o in SEPARATORS or b == 0 and not o.isalpha():
                ways.append(((a, b, last), score + (KEEP_SYMBOL if o in LOOKALIKES else SEPARATE), out))
            elif last and any(c == last for c, _ in arcs):
                ways.append(((a, b, last), score + REPEAT, out))
            for key, value, text in ways:
                if key not in nxt or nxt[key][0] < value:
                    nxt[key] = (value, text)
        paths = nxt
    return max(((s + model[a][b][0], out) for (a, b, _), (s, out) in paths.items()), default=(0.0, ""))[1]


@dataclass
class Scorer:
    """Restores texts and turns them into evidence.  ``vocabulary`` maps a
    term to its number; ``weights`` holds presence and rate weights."""
    chars: list
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0
    cache: dict[str, tuple] = field(default_factory=dict)

    def words(self, token: str) -> list[str]:
        core = EDGE.sub("", token)
        if core.isalpha() and not re.search(r"(.)\1\1", core):
            return [core]
        if NOISY.match(core):
            return decode(core, self.chars).split()
        return [w for w in re.split(r"[\W\d_]+", core) if w]

    def tokens(self, text: str) -> Counter:
        low = text.lower()
        found = Counter(low.split())
        if sum(n for t, n in found.items() if len(t) == 1 and t.isalpha()) >= 4:
            for m in SPELLED.finditer(low):
                found["".join(decode(m[0], self.chars).split())] += 1
        return found

    def terms(self, token: str) -> list[str]:
        out = []
        for w in self.words(token):
            out.append(w)
            out += [f"{w[:n]}*" for n in (3, 4, 5, 6) if len(w) > n]
        return out

    def evidence(self, text: str) -> dict[int, float]:
        """Per known term: presence at 2t, rate at 2t + 1."""
        found, total, seen = self.tokens(text), 0, Counter()
        for token, n in found.items():
            total += n
            ids = self.cache.get(token)
            if ids is None:
                ids = tuple(self.vocabulary[t] for t in self.terms(token) if t in self.vocabulary)
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[token] = ids
            for i in ids:
                seen[i] += n
        out = {}
        for i, n in seen.items():
            out[2 * i] = 1.0
            out[2 * i + 1] = math.log1p(100.0 * n / total)
        return out

    def score(self, text: str) -> float:
        z = self.bias
        if self.weights is not None:
            for i, x in self.evidence(text).items():
                z += self.weights[i] * x
        if math.isinf(z):
            return float(z > 0)
        return 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def _few(batches: Iterator[pd.DataFrame], rows: int = 128) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most ``rows``: terms are many times a text."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.iloc[a:a + rows]


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = 24_000,
          terms: int = 3_000, min_docs: int = 5, min_z: float = 3.0) -> Scorer:
    """Fit on at most ``sample`` labelled doc_ids (least hash first) for which
    ``allowed`` (over doc_id) holds."""
    spark = docs.sparkSession
    scorer = Scorer(char_model(docs).tolist())
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where("doc_id is not null and toxic is not null")
    if allowed is not None:
        wanted = wanted.where(allowed)
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    rows = doc_texts(docs).join(F.broadcast(wanted), "doc_id") \
        .withColumn("key", F.sha2(F.col("text").cast("binary"), 256))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            yield pd.DataFrame([(k, t, sorted({x for w in scorer.tokens(text) for x in scorer.terms(w)}))
                                for k, t, text in zip(b["key"], b["toxic"], b["text"])], columns=["key", "toxic", "terms"])

    seen = stage(rows.dropDuplicates(["key"]).mapInPandas(gather, "key string, toxic int, terms array<string>"), "labelled-terms")
    size = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(toxic + clean, 1)
        scorer.bias = math.log(share / (1 - share)) if 0 < share < 1 else math.inf if share else -math.inf
        return scorer
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    chosen = (seen.select("toxic", F.explode("terms").alias("term")).groupBy("term")
              .agg(F.sum("toxic").alias("t"), F.sum(F.lit(1) - F.col("toxic")).alias("c"))
              .where(F.col("t") + F.col("c") >= min_docs)
              .withColumn("p", (F.col("t") + F.col("c") + 1.0) / (toxic + clean + 2.0))
              .withColumn("z", (t / (toxic + 1.0) - c / (clean + 1.0)) / F.sqrt(F.col("p") * (1 - F.col("p")) * (1.0 / toxic + 1.0 / clean)))
              .where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "term").limit(terms).select("term").collect())
    scorer.vocabulary = {r["term"]: i for i, r in enumerate(chosen)}
    if not scorer.vocabulary:
        scorer.bias = math.log(toxic / clean)
        return scorer
    width = 2 * len(scorer.vocabulary)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            found = [sorted(scorer.evidence(x).items()) for x in b["text"]]
            yield pd.DataFrame({"label": b["toxic"].astype(float), "i": [[k for k, _ in x] for x in found],
                                "x": [[v for _, v in x] for x in found]})

    as_vector = F.udf(lambda i, x: SparseVector(width, i, x), VectorUDT())
    train_rows = stage(rows.dropDuplicates(["key"]).mapInPandas(vectors, "label double, i array<int>, x array<double>"), "labelled-evidence")
    fitted = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.5, standardization=True) \
        .fit(train_rows.select("label", as_vector("i", "x").alias("features")))
    scorer.weights, scorer.bias = fitted.coefficients.toArray(), float(fitted.intercept)
    return scorer


def score_column(scorer: Scorer, text: Column) -> Column:
    """The score of a text column, one Arrow-batched call per batch."""
    text_batches(SparkSession.getActiveSession())

    @F.pandas_udf(T.DoubleType())
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([scorer.score(x) for x in column.fillna("")], dtype="float64")

    return run.asNondeterministic()(text.cast("string"))
