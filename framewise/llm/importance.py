"""Target-distribution importance resampling over hashed word n-grams.

Each document is normalised once (lower case, words joined by one space) and
scanned once; the running CRC at every word's start and end is kept.  The CRC of
any n-gram follows from two of them: appending ``k`` bytes to a prefix shifts
its CRC, a linear map over GF(2), so

    crc(n-gram) = crc(prefix up to its end) xor shift(crc(prefix up to its start), k)

The shift by ``k`` bytes is four look-ups in a table made from the CRC
polynomial, and one more such step for each power of two from 64 in ``k``.  No
n-gram is ever built.  A task holds a slice of a megabyte, or the longest text.

Bucket counts cover all documents and all target texts; every task sums its own
before they are shuffled.  What the driver and the tasks hold is one number per
bucket.  Weights add floored log ratios, scores add Gumbel noise from a hash of
the id, so the highest scores are a draw without replacement.

Defined cases: NULL and empty texts have no features, weight 0; a NULL doc_id
hashes as an empty id and comes last among ties; rows with equal ids get equal
noise and are told apart by their features; an empty target leaves the ratio of
the smoothed counts; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.ranks import global_row_number
from framewise.llm.common import doc_texts, stage, text_batches
from framewise.llm.tokens import ALNUM, LOWER, Slice, slices

POLYNOMIAL = 0xEDB88320     # fixed value: the reversed polynomial of CRC-32

# Lower-cases A-Z and turns every separator into a space.
NORMALISED = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """The CRC register after one zero byte, for each low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def one_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs after one more byte."""
    r = ~crc
    return ~(byte_table()[(r ^ np.uint32(byte)) & 0xFF] ^ (r >> np.uint32(8)))


def _look_up(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 0xFF]
    for i in (1, 2, 3):
        out = out ^ tables[i][(crc >> np.uint32(8 * i)) & 0xFF]
    return out


@lru_cache(maxsize=1)
def near_tables() -> np.ndarray:
    """For 0 to 63 bytes, the four tables of 256 entries that shift a CRC so far."""
    out = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
    for _ in range(63):
        out.append(byte_table()[out[-1] & 0xFF] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


@lru_cache(maxsize=40)
def far_tables(power: int) -> np.ndarray:
    """The same for 2**power bytes, from 64."""
    half = near_tables()[32] if power == 6 else far_tables(power - 1)
    low = near_tables()[0]
    return np.stack([_look_up(half, _look_up(half, low[i])) for i in range(4)])


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` shifted by ``length`` bytes, each by its own."""
    at, flat = (length & 63) << 10, near_tables().reshape(-1)
    out = flat[at + (crc & 0xFF)]
    for i in (1, 2, 3):
        out ^= flat[at + (256 * i) + ((crc >> np.uint32(8 * i)) & 0xFF)]
    for power in range(6, int(length.max()).bit_length() if len(length) else 0):
        long = np.flatnonzero(length >> power & 1)
        out[long] = _look_up(far_tables(power), out[long])
    return out


@dataclass
class Scan:
    """Running CRCs of normalised texts at the start and the end of each word,
    where those are in the text, and the words of each text."""
    at_start: np.ndarray
    at_end: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray      # words of text r: bounds[r] .. bounds[r + 1]


def scan(texts: Iterable[bytes]) -> Scan:
    """Normalise each text and run over it once."""
    at_end: list[int] = []
    lengths: list[int] = []
    bounds = [0]
    for text in texts:
        # words with the space before them; a normalised text holds no zero byte
        pieces = b" ".join(text.translate(NORMALISED).split()).replace(b" ", b"\0 ").split(b"\0")
        if pieces[0]:
            at_end.extend(islice(accumulate(pieces, lambda crc, w: crc32(w, crc), initial=0), 1, None))
            lengths.extend(map(len, pieces))
        bounds.append(len(at_end))
    edge, crcs = np.array(bounds), np.array(at_end, np.uint32)
    total = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    ends = total[1:] - np.repeat(total[edge[:-1]], np.diff(edge))
    starts = ends - np.array(lengths, np.int64) + 1
    at_start = one_byte(np.concatenate([[0], crcs[:-1]]).astype(np.uint32), 0x20) if len(crcs) else crcs
    first = edge[:-1][np.diff(edge) > 0]
    starts[first], at_start[first] = 0, 0
    return Scan(at_start, crcs, starts, ends, edge)


def ngram_crcs(found: Scan, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRC-32 of all runs of 1 to ``longest`` words and the text each is from."""
    row = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    last = np.repeat(found.bounds[1:], np.diff(found.bounds))
    for k in range(longest):
        at = np.flatnonzero(np.arange(len(row)) + k < last)
        yield found.at_end[at + k] ^ shifted(found.at_start[at], found.ends[at + k] - found.starts[at]), row[at]


def _texts(s: Slice) -> Iterator[bytes]:
    at = s.offsets.tolist()
    for a, b in zip(at, at[1:]):
        yield s.data[a:b].tobytes()


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 3) -> np.ndarray:
    """Features a bucket over all rows of ``text``: at most one row per bucket
    and task is shuffled, one per bucket reaches the driver."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for s in slices(batch.column("text")):
                for crcs, _ in ngram_crcs(scan(_texts(s)), longest):
                    counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, floored."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 3) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)         # one number per bucket

    def run(batches):
        own = shared.value
        for batch in batches:
            for s in slices(batch.column("text")):
                found, rows = scan(_texts(s)), s.last - s.first
                n, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for crcs, row in ngram_crcs(found, longest):
                    n += np.bincount(row, minlength=rows)
                    np.add.at(total, row, own[crcs % np.uint32(len(own))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, rows), *map(pa.array, (np.diff(found.bounds), n, total))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000,
             longest: int = 3, seed: int = 42) -> DataFrame:
    """Draw ``percent`` of the documents with ``least_words`` words, as the
    target's n-grams favour them: ``rank`` is 1, 2, ... by falling score, NULL
    where a document is not drawn."""
    if not 0 < buckets < 1 << 31:
        raise ValueError("buckets must be a positive 32-bit number")
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    gain = gains(bucket_counts(docs.select(text), buckets, longest), bucket_counts(target.select(text), buckets, longest))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = stage(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise), "weights")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    last = F.col("doc_id").isNull().cast("int")
    order = ["-score", "_last", "doc_id", "weight", "n_features", "n_words"]
    ranked = global_row_number(eligible.withColumn("_last", last), order, "rank").drop("_last")
    out = ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
