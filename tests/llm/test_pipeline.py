"""The pipeline's stages on the smallest tables, each held against its rule."""

import re
from itertools import combinations

import pytest

import corpus_pipeline as P
from framewise.llm.common import documents, stage
from framewise.llm.mixing import water_fill
from framewise.llm.secrets import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's output over its predecessor's, and the input before."""
    out = {"input": documents(spark, SF)}
    for name, step in P.STAGES:
        out[name] = stage(step(spark, list(out.values())[-1], SF), f"test-{name}")
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def low_words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_order_and_columns(stages):
    assert list(stages) == ["input", "toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["input"].columns
    assert stages["mixing"].columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_toxicity_keeps_clean_documents(stages, spark):
    kept = rows(stages["toxicity"])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)
    assert kept.keys() <= rows(stages["input"]).keys()


def test_one_of_each_group_of_near_copies(stages):
    sets = {}
    for i, r in rows(stages["toxicity"]).items():
        w = low_words(r["text"], r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert set(rows(stages["near_duplicates"])) == {i for i in sets if find(i) == i}


def test_no_benchmark_run_is_left_and_nothing_else_goes(stages, spark):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low_words(r["text"], pattern)
        runs |= {tuple(w[j:j + 10]) for j in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    short = sorted({len(x) for x in runs})

    def hit(text):
        w = low_words(text, pattern)
        return any(tuple(w[j:j + n]) in runs for n in short for j in range(len(w) - n + 1))

    before = rows(stages["near_duplicates"])
    assert set(rows(stages["decontamination"])) == {i for i, r in before.items() if not hit(r["text"])}


def test_secrets_are_replaced(stages):
    before, after = rows(stages["decontamination"]), rows(stages["secrets"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"]) and not base_spans(r["text"].replace("[SECRET]", " "))
        if not base_spans(before[i]["text"]) and "[SECRET]" not in r["text"]:
            assert r["text"] == before[i]["text"]


def test_mix_reaches_its_targets(stages):
    sizes = {}
    for r in stages["secrets"].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water_fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)
    taken = {}
    for r in stages["mixing"].collect():
        assert r["taken"] <= 2 * r["size"]
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(goal), abs=len(goal))


def test_odd_rows_pass_every_stage(spark, make_docs, odd_rows):
    for docs in (make_docs(odd_rows), make_docs([])):
        for name, step in P.STAGES:
            docs = stage(step(spark, docs, SF), f"odd-{name}")
        assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"]
