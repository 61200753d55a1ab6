"""Fill-in-middle transformation of documents with Arrow's compute functions.

Texts are cut into units, units are lists, and everything that happens to them
happens to whole batches: the lists are flattened with the index of their
document, each unit gets its ordinal, units are filtered by their role (prefix,
middle, suffix), rebuilt into lists and joined.  No Python code runs per unit.
Where to cut comes from a hash of the document's id, made by Spark.

Defined cases: NULL and empty texts are plain and give an empty output; texts
that contain a sentinel are plain, so :func:`restore` is exact; a NULL doc_id
hashes as an empty id; rows with equal ids are transformed alike; other columns
are not looked at.  A batch holds about a megabyte, or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import doc_texts
from framewise.llm.tokens import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# A unit on UTF-8 bytes: a run of letters, or one other code point.
UNIT = rb"([A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*)"
CUT = b"\xff"               # never a byte of UTF-8

SCHEMA = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text (binary), as a list array."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=CUT + b"\\1")
    # a split leaves one empty item before the first mark; it is unit 0 below
    return pc.split_pattern(marked, pattern=CUT)


def joined(values: pa.Array, parents: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept units of each document, rebuilt into lists and joined."""
    counts = np.bincount(parents[keep], minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(values, pa.array(keep))), pa.scalar(b"", values.type))


def transform(texts: pa.Array, h: list[np.ndarray], may_cut: pa.Array, spm: pa.Array) -> dict[str, pa.Array]:
    """Pieces and outputs of one batch of binary ``texts``; ``h`` holds the two
    hashes that place the cuts."""
    rows, lists = len(texts), units(texts)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    ordinals = np.arange(len(values)) - starts[parents]          # from 1; 0 is the empty item
    n = np.diff(starts) - 1
    cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
    first, second = ordinals <= cuts[0][parents], ordinals <= cuts[1][parents]
    prefix, middle, suffix = (joined(values, parents, keep, rows) for keep in (first, second & ~first, ~second))
    p, s, m, none = (pa.scalar(x, values.type) for x in (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode(), b""))
    moved = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                       pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    chars = lambda x: pc.if_else(may_cut, pc.cast(pc.utf8_length(x.cast(pa.string())), pa.int64()), None)
    return {"n": pa.array(n), "form": pc.if_else(may_cut, pc.if_else(spm, "spm", "psm"), "plain"),
            "prefix_chars": chars(prefix), "middle_chars": chars(middle), "output": pc.if_else(may_cut, moved, texts)}


def hash_word(key: Column, i: int) -> Column:
    """The ``i``-th group of eight hex digits of ``key``, as a number."""
    return F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row per document: units ``n``, ``form`` (plain, psm or spm), the
    code points of prefix and middle, and the ``output``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    clean = F.col("text") != ""
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        clean &= ~F.contains("text", F.lit(sentinel))
    ready = (doc_texts(docs).withColumn("key", key)
             .select("doc_id", "text", hash_word(F.col("key"), 0).alias("h1"), hash_word(F.col("key"), 1).alias("h2"),
                     (clean & (hash_word(F.col("key"), 2) % 100 < 100 - plain_percent)).alias("may_cut"),
                     (hash_word(F.col("key"), 3) % 100 < spm_percent).alias("spm")))

    def run(batches):
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for s in slices(column):
                own = batch.slice(s.first, s.last - s.first)
                out = transform(column.slice(s.first, s.last - s.first), [own.column(c).to_numpy() for c in ("h1", "h2")],
                                own.column("may_cut"), own.column("spm"))
                out["output"] = out["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *out.values()], ["doc_id", *out])

    return ready.mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  Sentinels neither occur in the
    text nor overlap themselves, so the first of each is the one put there."""
    before = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    left = lambda mark: F.substring_index(before, mark, 1)     # noqa: E731
    right = lambda mark: F.substring_index(before, mark, -1)
    return (F.when(form == "psm", F.concat(F.substring_index(left(SUFFIX), PREFIX, -1), middle, right(SUFFIX)))
             .when(form == "spm", F.concat(right(PREFIX), middle, F.substring_index(left(PREFIX), SUFFIX, -1)))
             .otherwise(output))
