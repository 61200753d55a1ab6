"""Secret scan: rule spans plus a linear-chain conditional random field.

Three patterns give the base spans.  A chain model over tokens with the tags
outside, begin and inside adds more: its features are a token's shape (length,
character classes, changes between them and their rate, share of digits and of
vowels, joints such as "_", hexadecimal or not), the word and the punctuation before and after it,
whether it begins or ends a line, and what kind of file it stands in (how dense
the text is in digits, code marks and line ends).

It is trained on bounded samples drawn by hash over the whole corpus: windows
with a base span (``tagged`` at most, each also with its pattern hidden, see
:mod:`framewise.llm.secret_examples`) and windows of any text without one
(``plain`` at most, each also with harmless look-alikes), by gradient ascent
on the exact log-likelihood, and decoded by Viterbi over every whole text.

Most tokens are so clearly outside that every best path passes through
"outside" there: where its margin exceeds the largest possible gain from the
transitions, the chain falls apart, and only the stretches between such tokens
are decoded.  This is exact, not a beam.

Defined cases: NULL and empty texts have no spans; repeated rows are scored
separately and teach once; an empty table, or one without base spans, leaves a
model that adds nothing.  Other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import doc_texts, stage
from framewise.llm.secret_examples import decoyed, hidden
from framewise.llm.tokens import LOWER, U, slices, word_hashes, words

# Fixed patterns of the scan; group 2 of ASSIGN has at least 6 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")       # AKIA[A-Z0-9]+ of 20 and more: runs are maximal
HEX = re.compile(r"[0-9a-f]{24,}")              # [0-9a-f]+ of 24 and more: runs are maximal
KINDS = ("assign", "access", "hex", "crf")
# True for every text with a base span, and few others: chooses texts to learn from.
MAY_HOLD = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
            r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")

TOKEN = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    TOKEN[_c] = True
TOKEN[0x80:] = True
DIGIT, UPPER, LOW, HEXA = (np.zeros(256, np.int32) for _ in range(4))
VOWEL = np.isin(np.arange(256), list(b"AEIOUYaeiouy")).astype(np.int32)
JOINT = np.isin(np.arange(256), list(b"+/_-")).astype(np.int32)
BEYOND = (np.arange(256) >= 0x80).astype(np.int32)
CODE = np.isin(np.arange(256), list(b"{};<>=")).astype(np.int32)
DIGIT[48:58] = UPPER[65:91] = LOW[97:123] = HEXA[48:58] = HEXA[97:103] = 1

# Feature blocks: (name, width); a token has one active feature in each.
BLOCKS = (("length", 12), ("classes", 32), ("hex", 8), ("changes", 24), ("rate", 224), ("vowels", 40), ("joints", 80), ("digits", 20), ("gap", 16),
          ("before", 4096), ("before_gap", 4096), ("after", 4), ("following", 4096), ("line", 4), ("file", 36))
OFFSETS = np.concatenate([[0], np.cumsum([n for _, n in BLOCKS])])
WINDOW = 24
HIDDEN = 8              # versions of a tagged text with the pattern hidden
DECOYED = 3             # versions of any text with look-alikes
OUT, BEGIN, INSIDE = 0, 1, 2

SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, spans array<string>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _prefix(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=out[1:])
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """Tokens of a slice and their active feature of each block."""
    w = words(data, offsets, TOKEN)
    s, e = w.starts, w.ends
    n = len(s)
    length = e - s
    count = {k: _prefix(t, data) for k, t in (("d", DIGIT), ("u", UPPER), ("l", LOW), ("x", HEXA),
                                               ("v", VOWEL), ("b", BEYOND), ("j", JOINT))}
    inside = lambda k: count[k][e] - count[k][s]
    digits, upper, lower, hexa = inside("d"), inside("u"), inside("l"), inside("x")
    kind = DIGIT[data] + 2 * UPPER[data] + 3 * LOW[data]
    change = np.zeros(len(data) + 1, np.int32)
    if len(data) > 1:
        np.cumsum(kind[1:] != kind[:-1], out=change[2:])
    turns = change[e] - change[np.minimum(s + 1, e)]
    classes = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0)
    long_ = np.digitize(length, [6, 12, 20])
    row = w.row()
    first = w.bounds[:-1][row] == np.arange(n) if n else np.zeros(0, bool)
    last = (w.bounds[1:][row] - 1) == np.arange(n) if n else np.zeros(0, bool)
    gap_from = np.where(first, offsets[row], np.concatenate([[0], e[:-1]])[:n]) if n else s
    gap_to = np.where(last, offsets[row + 1], np.concatenate([s[1:], [0]])[:n]) if n else s
    marks = {c: _prefix((np.arange(256) == c).astype(np.int32), data) for c in b":='\"\n"}
    has = lambda c, a, b: marks[c][b] > marks[c][a]
    gap = (has(58, gap_from, s) + 2 * has(61, gap_from, s) + 4 * (has(39, gap_from, s) | has(34, gap_from, s))
           + 8 * (s - gap_from > 1))
    after = (has(39, e, gap_to) | has(34, e, gap_to)) + 2 * (gap_to - e > 1)
    h = word_hashes(LOWER[data], w)
    before = np.where(first, U(0), np.concatenate([[U(0)], h[:-1]])[:n]) if n else h
    following = np.where(last, U(0), np.concatenate([h[1:], [U(0)]])[:n]) if n else h
    line = (first | has(10, gap_from, s)) + 2 * (last | has(10, e, gap_to))
    size = np.maximum(np.diff(offsets), 1)
    dense = lambda c, at: np.digitize((c[offsets[1:]] - c[offsets[:-1]]) / size, at)
    file = (dense(count["d"], [0.01, 0.05, 0.2]) + 4 * dense(_prefix(CODE, data), [0.005, 0.03])
            + 12 * dense(marks[10], [0.005, 0.03]))
    rate = np.digitize(turns / np.maximum(length - 1, 1), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    voiced = np.digitize(inside("v") / np.maximum(upper + lower, 1), [0.12, 0.22, 0.3, 0.4])
    share = np.digitize(digits / np.maximum(length, 1), [0.001, 0.1, 0.4, 0.8])
    f = np.stack([
        np.digitize(length, [2, 3, 4, 6, 8, 10, 13, 17, 21, 33, 41]),
        classes + 8 * long_,
        (hexa == length) + 2 * long_,
        np.minimum(turns, 5) + 6 * long_,
        rate + 7 * classes + 56 * long_,
        voiced + 5 * long_ + 20 * (inside("b") > 0),
        np.minimum(inside("j"), 3) + 4 * (voiced + 5 * long_),
        share + 5 * long_,
        gap,
        (before >> U(52)).astype(np.int64),
        ((before * U(0x9E3779B97F4A7C15) + gap.astype(U)) * U(0xD6E8FEB86659FD93) >> U(52)).astype(np.int64),
        after,
        (following >> U(52)).astype(np.int64),
        line, file[row] if n else np.zeros(0, np.int64)], axis=1) + OFFSETS[:-1]
    return w, f


@dataclass
class Chain:
    weights: np.ndarray     # feature x 3
    moves: np.ndarray       # 3 x 3: from, to

    @property
    def margin(self) -> float:
        """No path gains more than this from the transitions by leaving
        "outside" at one token."""
        t = self.moves
        return max(t[a, x] + t[x, b] - t[a, OUT] - t[OUT, b] for a in range(3) for b in range(3) for x in (1, 2))

    def scores(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), 3), np.float32)
        for j in range(f.shape[1]):
            out += self.weights[f[:, j]]
        return out

    def decode(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best tag of every token; texts begin and end outside."""
        tags = np.zeros(len(scores), np.int8)
        if not len(scores):
            return tags
        unsure = scores[:, OUT] - scores[:, 1:].max(axis=1) <= self.margin + 1e-4
        edge = np.zeros(len(scores) + 1, bool)
        edge[bounds] = True
        at = np.flatnonzero(unsure)
        if not len(at):
            return tags
        cut = np.flatnonzero((np.diff(at) > 1) | edge[at[1:]]) + 1
        for run in np.split(at, cut):
            tags[run] = self._best(scores[run])
        return tags

    def _best(self, s: np.ndarray) -> list[int]:
        best, back = self.moves[OUT] + s[0], []
        for x in s[1:]:
            way = best[:, None] + self.moves
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + x
        tag = int((best + self.moves[:, OUT]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


def fit(f: np.ndarray, tags: np.ndarray, steps: int = 60, rate: float = 0.2, ridge: float = 2e-5,
        miss: float = 5.0) -> Chain:
    """Exact softmax-margin fit (forward-backward, Adam) on windows of
    ``WINDOW`` tokens; tag -1 pads.  While learning, "outside" is worth ``miss``
    more at every secret token, so the true tag must win by that much."""
    width = int(OFFSETS[-1])
    weights, moves = np.zeros((width, 3)), np.zeros((3, 3))
    if not (tags > 0).any():
        weights[OFFSETS[0]:OFFSETS[1], OUT] = 20.0
        return Chain(weights.astype(np.float32), moves)
    n, t = tags.shape
    real = tags >= 0
    y = np.eye(3)[np.maximum(tags, 0)] * real[..., None]
    pair = np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    columns = np.ascontiguousarray(f.reshape(-1, f.shape[-1]).T)
    for step in range(1, steps + 1):
        s = sum(weights[c] for c in columns).reshape(n, t, 3) * real[..., None]
        s[..., OUT] += miss * (tags > 0)
        step_to = np.exp(moves)
        e = np.exp(s - s.max(axis=2, keepdims=True))
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        alpha, beta = np.ones((n, t, 3)), np.ones((n, t, 3))
        alpha[:, 0] = unit(e[:, 0])
        for i in range(1, t):
            alpha[:, i] = np.where(real[:, i, None], unit(alpha[:, i - 1] @ step_to * e[:, i]), alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(real[:, i + 1, None], unit((e[:, i + 1] * beta[:, i + 1]) @ step_to.T), beta[:, i + 1])
        p = unit(alpha * beta) * real[..., None]
        left, right = alpha[:, :-1].reshape(-1, 3), (e * beta)[:, 1:].reshape(-1, 3)
        weight = real[:, 1:].reshape(-1) / (left @ step_to * right).sum(axis=1)
        joint = step_to * ((left * weight[:, None]).T @ right)
        grad_w = np.zeros_like(weights)
        gap = (y - p).reshape(-1, 3)
        for j, c in enumerate(columns):
            at = slice(OFFSETS[j], OFFSETS[j + 1])
            for k in range(3):
                grad_w[at, k] = np.bincount(c - OFFSETS[j], gap[:, k], minlength=BLOCKS[j][1])
        for x, g, m, v in ((weights, grad_w / n - ridge * weights, state[0], state[1]),
                           (moves, (pair - joint) / n - ridge * moves, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain(weights.astype(np.float32), moves)


def _values(text: str) -> list[tuple[int, int, int]]:
    """(start, value, end) of the base spans: the value is what follows an
    assignment's separator, the whole of the others."""
    spans = [(m.start(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(spans + [(m.start(), m.start(), m.end()) for p in (ACCESS, HEX) for m in p.finditer(text)])


def _tagged(text: str, values: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of a text's tokens, given where its secrets lie."""
    s = next(iter(slices(pa.array([text], pa.string()))))
    w, f = features(s.data, s.offsets)
    tags = np.zeros(len(f), np.int8)
    for lo, hi in values:
        lo, hi = len(text[:lo].encode()), len(text[:hi].encode())
        inside = np.flatnonzero((w.starts < hi) & (w.ends > lo))
        if len(inside):
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
    return f, tags


def _windows(text: str, key: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(tagged, features, tags) of a text's training windows: all with a base
    span, as they are and with the pattern hidden, and one without, as it is
    and with look-alikes."""
    rng = random.Random(key)
    spans = _values(text)
    versions = [(text, [(v, e) for _, v, e in spans])]
    if spans:
        versions += [hidden(text, spans, rng) for _ in range(HIDDEN)]
    for version, values in versions:
        f, tags = _tagged(version, values)
        for at in sorted({int(i) - int(i) % WINDOW for i in np.flatnonzero(tags)}):
            yield True, f[at:at + WINDOW], tags[at:at + WINDOW]
    for version in (text, *(decoyed(text, rng) for _ in range(DECOYED))):
        f, tags = _tagged(version, [(v, e) for _, v, e in _values(version)])
        free = [at for at in range(0, len(f), WINDOW) if not tags[at:at + WINDOW].any()]
        if free:
            at = rng.choice(free)
            yield False, f[at:at + WINDOW], tags[at:at + WINDOW]


def train(docs: DataFrame, tagged: int = 2_000, plain: int = 2_000) -> Chain:
    """Fit the chain on at most ``tagged`` windows with a secret and ``plain``
    others, from as many distinct texts with and of any kind, least hash first
    over the whole corpus; copies of a text count once."""
    texts = doc_texts(docs).withColumn("key", F.xxhash64("text", F.lit(5)))
    may_hold = F.lit(False)
    for pattern in MAY_HOLD:
        may_hold = may_hold | F.col("text").rlike(pattern)
    least = lambda rows, n: rows.select("key").distinct().orderBy("key").limit(n)
    keys = least(texts.where(may_hold), tagged).union(least(texts, plain)).distinct()
    packed = pa.schema([("secret", pa.bool_()), ("tie", pa.int64()), ("f", pa.binary()), ("tags", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, key in zip(batch.column(0), batch.column(1).to_pylist()):
                out = [{"secret": found, "tie": (key + i) * 0x9E3779B1 % (1 << 31), "f": f.astype(np.int32).tobytes(), "tags": t.tobytes()}
                       for i, (found, f, t) in enumerate(_windows(text.as_py(), key))]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=packed)

    windows = stage(texts.join(F.broadcast(keys), "key", "left_semi").select("text", "key")
                         .mapInArrow(build, "secret boolean, tie long, f binary, tags binary").distinct(), "secret-windows")
    rows = [r for kind, n in ((True, tagged), (False, plain))
            for r in windows.where(F.col("secret") == kind).orderBy("tie", "f").limit(n).collect()]
    n = len(rows)
    f = np.zeros((max(n, 1), WINDOW, len(BLOCKS)), np.int64) + OFFSETS[:-1]
    tags = np.full((max(n, 1), WINDOW), -1, np.int8)
    for i, r in enumerate(rows):
        t = np.frombuffer(r["tags"], np.int8)
        tags[i, :len(t)] = t
        f[i, :len(t)] = np.frombuffer(r["f"], np.int32).reshape(len(t), -1)
    return fit(f, tags)


def _chain_spans(tags: np.ndarray, w, a: int, b: int) -> list[tuple[int, int]]:
    """Byte spans of the tagged runs of one text; begin opens a new span."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(tags[a:b]) + a:
        if out and tags[i] == INSIDE and i > a and tags[i - 1] != OUT:
            out[-1] = (out[-1][0], int(w.ends[i]))
        else:
            out.append((int(w.starts[i]), int(w.ends[i])))
    return out


def _all_spans(column: pa.Array, chain: Chain) -> Iterator[tuple[list, list]]:
    """Per row of a text column: base spans and the chain's additions, each as
    (start, kind, end) in code points."""
    for s in slices(column):
        w, f = features(s.data, s.offsets)
        tags = chain.decode(chain.scores(f), w.bounds)
        for r in range(s.last - s.first):
            base, more = base_spans(column[s.first + r].as_py() or ""), []
            a, b = int(w.bounds[r]), int(w.bounds[r + 1])
            if tags[a:b].any():
                raw = s.data[s.offsets[r]:s.offsets[r + 1]]
                point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                for lo, hi in _chain_spans(tags, w, a, b):
                    # the code point that holds the byte
                    lo, hi = int(point[lo - s.offsets[r]]), int(point[hi - s.offsets[r]])
                    if not any(x < hi and lo < y for x, _, y in base):
                        more.append((lo, 3, hi))
            yield base, more


def scan(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per document: base counts, base spans and all spans as
    ``kind:start:end`` in code points.  A chain span that overlaps a base span
    adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda found: [f"{KINDS[k]}:{x}:{y}" for x, k, y in sorted(found)]
        for batch in batches:
            rows = []
            for base, more in _all_spans(batch.column(1), chain):
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), say(base), say(base + more)))
            types = [pa.int64()] * 3 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return doc_texts(docs).mapInArrow(run, SCAN_SCHEMA)


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    return scan(docs, train(docs, **options))


def redacted(text: Column, chain: Chain, mark: str = "[SECRET]") -> Column:
    """The text with every span, base or chain, replaced by ``mark``; of
    overlapping spans the union is replaced once.  NULL stays NULL."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        found = iter(_all_spans(pa.array(column, pa.string(), from_pandas=True), chain))
        out = []
        for text, (base, more) in zip(column, found):
            if text is None:
                out.append(None)
                continue
            at, parts = 0, []
            for lo, _, hi in sorted(base + more):
                if lo >= at:
                    parts += [text[at:lo], mark]
                at = max(at, hi)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return run(text.cast("string"))
