import hashlib
import random

import numpy as np
import pytest

from framewise.llm import bpe
from framewise.llm.queries import op11_bpe, vocabulary_path

END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load(vocabulary_path()))


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def merged(own, piece):
    """The definition: the earliest merge of the list, leftmost first, until none applies."""
    parts = [own.ids[bytes([b])] for b in piece]
    while found := [(own.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in own.rank]:
        _, i = min(found)
        parts[i:i + 2] = [next(t for t, (_, a, b) in own.made.items() if (a, b) == (parts[i], parts[i + 1]))]
    return parts


def test_pieces_against_the_definition(own):
    r = random.Random(3)
    for _ in range(60):
        piece = bytes(r.choice(b"aeinrst dh.\xc3\xa9\xe4") for _ in range(r.randint(1, 14)))
        assert own.encode_piece(piece) == merged(own, piece)


def test_random_texts_against_the_library(own, library):
    r = random.Random(1)
    letters = "aeinrst  \n\t'sdé中😀<|endoftext|>09zZ՘\xa0 \x85\x1c"
    for i in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        text = text[:9] + END + text[9:] if i % 7 == 0 else text
        assert own.encode(text) == ids_of(library, text)


def test_code_points_of_newer_tables(own, library):
    for c in own_other(own):
        text = f"a{c}1 {c}{c}b"
        assert own.encode(text) == ids_of(library, text)


def own_other(own):
    return [c for c in bpe.load(vocabulary_path()).other][::97]


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, " " * 30_000, "\n" * 4000 + "x", "中文" * 30_000, END * 3, "x " * 200_000])
def test_long_runs(own, library, text):
    assert own.encode(text) == ids_of(library, text)


def test_dropped_caches_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    monkeypatch.setattr(bpe, "CHUNK", 8)
    fresh = bpe.Encoder(bpe.load(vocabulary_path()))
    text = "the quick brown foxes, unbelievably jumpy, jump over 1234 lazy dogs " * 3
    assert fresh.encode(text) == ids_of(library, text)


def test_documents(make_docs, odd_rows, library, spark):
    rows = odd_rows + [(20, END + " and " + END, "a"), (21, "it's we'll 𝔘𝔫𝔦 ՘", "b")]
    path = vocabulary_path()
    encoded = bpe.encode(make_docs(rows), path)
    got = sorted((r["doc_id"] or 0, bytes(r["tokens"]), r["n_tokens"], r["text"]) for r in bpe.decode(encoded, path).collect())
    want = sorted((i or 0, ids_of(library, t or ""), len(ids_of(library, t or "")) // 4, t or "") for i, t, _ in rows)
    assert got == want
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in bpe.token_ids(encoded).collect()) == \
        sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert bpe.encode(make_docs([]), path).count() == 0


def test_decoding_of_any_ids(spark, library):
    path, r = vocabulary_path(), random.Random(5)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 9))] for _ in range(300)]
    rows = spark.createDataFrame([(i, len(x), np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)] + [(-1, 0, None)],
                                 "doc_id long, n_tokens long, tokens binary")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, path).collect()}
    assert got == {-1: ""} | {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_an_id_beyond_the_vocabulary_raises():
    with pytest.raises(ValueError):
        bpe.decode_bytes(np.array([50257]), *bpe.decoding_table(bpe.load(vocabulary_path())))


def test_other_vocabularies_raise():
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))


def test_query_over_the_whole_table(spark, small_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_bpe(spark, small_dir).collect()}
    assert got == {i: (len(ids_of(library, t)) // 4, sha(ids_of(library, t)), sha(t.encode())) for i, t in docs.items()}
