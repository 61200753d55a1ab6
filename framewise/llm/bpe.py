"""Byte-level BPE encoding by backtracking over longest matches, and decoding
by an offset table.

The vocabulary is a file of a public tokenizer; its path is a parameter and the
file is read on the driver only.  A piece of text is encoded as follows.  One
Aho-Corasick pass gives the longest token at every byte.  Tokens are taken from
left to right, the longest first; a token may follow its left neighbour only if
the pair is compatible, that is if the merges would leave the two apart.  A
token that does not fit gives way to the longest token that is a prefix of it;
when none fits, the neighbour is taken back and its end is never tried again.
Every prefix has one encoding, so the first one that reaches the end is the
exact result of the merges, in time linear in the piece.

Defined cases: NULL and empty texts have no tokens; texts equal to an added
token's string become that token; a text is processed whole, in bounded chunks
of pieces; rows with equal or NULL ids are encoded on their own; other columns
are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import doc_texts
from framewise.llm.tokens import slices

# The pattern that splits texts for byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED_PIECES = 1 << 19
CACHED_PAIRS = 1 << 20
CACHED_BYTES = 64
CHUNK = 1 << 16


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it prints, else the next unused one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {chr(b): b for b in prints}, 0x100
    for b in range(256):
        if chr(b) not in out:
            out[chr(spare)] = b
            spare += 1
    return out


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a tokenizer file; hashable, about a megabyte."""
    blob: bytes                 # all tokens end to end, by id
    lengths: bytes              # int32 a token
    merges: bytes               # int32 triples: left id, right id, merged id
    added: tuple[tuple[str, int], ...]
    other: str                  # code points that this library's regex tables call
                                # letters or digits, the tokenizer's do not

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.lengths, np.int32), dtype=np.int64)])

    def tokens(self) -> list[bytes]:
        at = self.offsets().tolist()
        return [self.blob[a:b] for a, b in zip(at, at[1:])]


def _unlike(split) -> str:
    """Letters and digits of the local Unicode tables that ``split`` (the
    tokenizer's own splitter, built on older tables) does not take for such."""
    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    cuts = {start for _, (start, _) in split("".join(f"a{c}1\n" for c in known))}
    # a letter stays with the "a", a digit with the "1"; anything else stands alone
    return "".join(c for i, c in enumerate(known) if 4 * i + 1 in cuts and 4 * i + 2 in cuts)


def _ranges(chars: str) -> str:
    """A character class of ``chars`` in code point order, run by run."""
    at = np.array([ord(c) for c in chars])
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return "[" + "".join(f"\\U{at[a]:08x}-\\U{at[b - 1]:08x}" for a, b in zip(first, [*first[1:], len(at)])) + "]"


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the ``tokenizers`` library; ValueError
    for other kinds."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level BPE vocabulary without normalizer")
    added = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: added tokens that strip or match words only")
    symbols, vocab = byte_symbols(), model["vocab"]
    words: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
    words |= {t["id"]: t["content"].encode() for t in added}
    tokens = [words.get(i, b"") for i in range(max(words) + 1)]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)
    if len({t for t, _ in zip(merges[:, 2], merges)}) != len(merges) or len({bytes([b]) for b in range(256)} - set(tokens)):
        raise ValueError(f"{path}: a token of two merges, or a byte without a token")
    return Vocabulary(b"".join(tokens), np.array([len(t) for t in tokens], np.int32).tobytes(), merges.tobytes(),
                      tuple(sorted((t["content"], t["id"]) for t in added)),
                      _unlike(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str))


class UnlikePiece(Exception):
    """A piece with a code point that the tokenizer's tables class otherwise."""


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """The ids of the pieces met so far; only short ones are kept, and all are
    dropped when there are too many."""

    def __init__(self, own: Encoder):
        super().__init__()
        self.own = own

    def __missing__(self, piece: str) -> bytes:
        if self.own.other and not piece.isascii() and self.own.other.search(piece):
            raise UnlikePiece
        ids = packed(self.own.encode_piece(piece.encode()))
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Tables of one vocabulary and the encoding of single texts."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = vocabulary.tokens()
        rows = np.frombuffer(vocabulary.merges, np.int32).reshape(-1, 3).tolist()
        added = {i for _, i in vocabulary.added}
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(rows)}
        self.made = {t: (r, a, b) for r, (a, b, t) in enumerate(rows)}      # rank and halves of a merged token
        for r, a, b in self.made.values():
            if any(self.made[x][0] >= r for x in (a, b) if x in self.made):
                raise ValueError("a merge that comes before its halves")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, dict[int, list[tuple[int, float]]]] = {1: {}, 2: {}}
        # a token whose halves another merge would tear apart never arises
        arises = {i for i, t in enumerate(tokens) if len(t) == 1 and i not in added}
        for t, (r, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]):
            if a in arises and b in arises and self._apart(a, b, r):
                arises.add(t)
        self.length = [len(t) for t in tokens]
        self.ids = {tokens[i]: i for i in arises}
        self.shorter = [-1] * len(tokens)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.automaton.make_automaton()
        self.added = dict(vocabulary.added)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        self.other, self.split_other = None, None
        if vocabulary.other:
            odd = _ranges(vocabulary.other)
            self.other = re.compile(odd)
            self.split_other = regex.compile(
                SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{odd})").replace(r"?\p", rf"?(?!{odd})\p")
                     .replace(r"\p{L}+", rf"(?:(?!{odd})\p{{L}})+").replace(r"\p{N}+", rf"(?:(?!{odd})\p{{N}})+"))
        self.cache = Pieces(self)

    def _spine(self, token: int, half: int) -> list[tuple[int, float]]:
        """The tokens along one edge of ``token`` and the rank of the merge
        that uses each up (none for the token itself)."""
        known = self.spines[half].get(token)
        if known is None:
            known, used, at = [], float("inf"), token
            while at in self.made:
                known.append((at, used))
                used, at = self.made[at][0], self.made[at][half]
            known.append((at, used))
            self.spines[half][token] = known
        return known

    def _apart(self, left: int, right: int, own: int = -1) -> bool:
        """Do the merges leave ``left`` and ``right`` apart?  A merge across
        the border takes place if it comes before both of its sides are used
        up; on a tie the left one comes first.  ``own`` is let pass."""
        starts, rank = self._spine(right, 1), self.rank
        for x, x_used in self._spine(left, 2):
            for y, y_used in starts:
                if (x, y) in rank:
                    r = rank[x, y]
                    if r != own and r < x_used and r <= y_used:
                        return False
        return True

    def compatible(self, left: int, right: int) -> bool:
        """An entry of the pair-compatibility table, which fills as pairs are met."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known = self._apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(piece), self.length, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token        # ends grow: the last one is the longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if not dead[at + length[token]]:
                    fits = last < 0 or pairs.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def _encode_plain(self, text: str) -> bytes:
        try:
            if len(text) <= CHUNK:
                return b"".join(map(self.cache.__getitem__, self.split.findall(text)))
            found, out = (m.group() for m in self.split.finditer(text)), []
            while pieces := list(islice(found, CHUNK)):
                out.append(b"".join(map(self.cache.__getitem__, pieces)))
            return b"".join(out)
        except UnlikePiece:
            return b"".join(packed(self.encode_piece(m.group().encode())) for m in self.split_other.finditer(text))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self._encode_plain(p) for p in parts)


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


@lru_cache(maxsize=2)
def decoding_table(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(vocabulary.blob, np.uint8), vocabulary.offsets()


def decode_bytes(ids: np.ndarray, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ``ids`` end to end, and where each token ends."""
    if len(ids) and int(ids.max()) >= len(offsets) - 1:
        raise ValueError("an id beyond the vocabulary")
    lengths = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(lengths)
    return blob[np.repeat(offsets[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``tokens`` (ids as little-endian unsigned
    32-bit integers, as token files hold them) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))       # one vocabulary file

    def run(batches):
        own = encoder(shared.value)
        for batch in batches:
            for s in slices(batch.column("text")):
                at = s.offsets.tolist()
                ids = [own.encode(s.data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.last - s.first), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "tokens"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, tokens binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to rows with ``doc_id`` and ``tokens``; bytes that are no
    UTF-8 become replacement characters.  Ids beyond the vocabulary raise."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        blob, offsets = decoding_table(shared.value)
        for batch in batches:
            for s in slices(batch.column("tokens")):
                data, ends = decode_bytes(np.frombuffer(s.data.tobytes(), "<u4").astype(np.int64), blob, offsets)
                at = np.concatenate([[0], ends])[s.offsets // 4].tolist()
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:])]
                own = batch.slice(s.first, s.last - s.first)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_tokens"), own.column("tokens"), pa.array(texts, pa.string())],
                                                 ["doc_id", "n_tokens", "tokens", "text"])

    return encoded.select("doc_id", "n_tokens", F.coalesce("tokens", F.lit(b"")).alias("tokens")).mapInArrow(
        run, "doc_id long, n_tokens long, tokens binary, text string")


def token_ids(encoded: DataFrame) -> DataFrame:
    """``tokens`` as an array of ids."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column("tokens")):
                ids = pa.ListArray.from_arrays(pa.array((s.offsets // 4).astype(np.int32)), pa.array(np.frombuffer(s.data.tobytes(), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.last - s.first), ids], ["doc_id", "ids"])

    return encoded.select("doc_id", F.coalesce("tokens", F.lit(b"")).alias("tokens")).mapInArrow(run, "doc_id long, ids array<int>")
