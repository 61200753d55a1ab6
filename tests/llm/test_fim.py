import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewise.llm.fim import fill_in_middle, restore


def by_definition(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    texts = ["", None, "a", "é", "<P>", "x<S>y", "<M", "P><S", "<", ">", "ab1 \n\u0000é😀中 zZ", "<P <S <M ><", "a" * 5000 + "é" * 4000]
    return [(i, texts[i % len(texts)] if i % 3 else (texts[i % len(texts)] or "") + " word, Wort; été " * (i % 9), "s") for i in range(600)]


def test_against_the_definition(make_docs, odd_rows, rows):
    every = odd_rows + rows
    made = fill_in_middle(make_docs(every))
    got = [tuple(r) for r in made.collect()]
    assert Counter(got) == Counter(by_definition(i, t) for i, t, _ in every)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t, _ in every)


def test_parameters(make_docs, rows):
    forms = lambda **k: {r["form"] for r in fill_in_middle(make_docs([(i, "two words", "s") for i in range(50)]), **k).collect()}
    assert forms(plain_percent=100) == {"plain"}
    assert forms(plain_percent=0, spm_percent=100) == {"spm"}
    assert forms(plain_percent=0, spm_percent=0) == {"psm"}


def test_empty_table(make_docs):
    assert fill_in_middle(make_docs([])).count() == 0
