import re
import textwrap

from framewise.llm.licenses import TEMPLATES, license_matches, template_rows


def grams(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(text, templates, threshold):
    text = text or ""
    units = {text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")}
    out = set()
    for u in units:
        a = grams(u)
        for name, t in templates:
            b = grams(t)
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                out.add((u, name, 2 * len(a & b) / (len(a) + len(b))))
    return len(units), out


def test_against_brute_force(make_docs, odd_rows):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    lines = "\n".join(mit[i:i + 77] for i in range(0, len(mit), 77)).replace("\n", " \n")
    rows = odd_rows + [(i + 100, t, "s") for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(200, f"some words first\n\n{mit}\n\nand more", "s"), (201, mit.replace("Software", "Thing"), "s"), (202, lines, "s"),
             (203, "LICENSED under the apache license -- version 2.0!", "s"), (204, "Released under the MIT License.\nReleased under the MIT License.", "s")]
    for threshold in (0.8, 0.5):
        got = license_matches(make_docs(rows), threshold=threshold).collect()
        assert len(got) == len(rows)
        for (i, text, _), r in zip(rows, got):
            n, found = brute(text, TEMPLATES, threshold)
            assert r["doc_id"] == i and r["n_units"] == n
            assert {(m["unit"], m["license"], round(m["dice"], 12)) for m in r["matches"]} == {(u, x, round(d, 12)) for u, x, d in found}


def test_plan_has_no_python(make_docs):
    plan = license_matches(make_docs([(1, "a", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)


def test_empty_and_size_bounds(make_docs):
    assert license_matches(make_docs([])).count() == 0
    for r in template_rows(TEMPLATES, 0.8):
        assert r["lo"] <= r["n"] <= r["hi"]
        assert 2 * min(r["n"], r["lo"] - 1) / (r["n"] + r["lo"] - 1) < 0.8 and 2 * r["n"] / (r["n"] + r["hi"] + 1) < 0.8


def brute_windows(text, templates, threshold):
    """Every start at a shared bigram, compared without any pruning."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for name, t in templates:
        b = grams(t)
        wide = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
        scores = []
        for p in range(len(ws) - 1):
            if (ws[p], ws[p + 1]) in b:
                a = set(zip(ws[p:p + wide], ws[p + 1:p + wide]))
                scores.append((2 * len(a & b) / (len(a) + len(b)), -p))
        if scores and max(scores)[0] >= threshold:
            best = max(scores)
            out.append((-best[1], wide, name, round(best[0], 12), " ".join(ws[-best[1]:-best[1] + wide])))
    return sorted(out)


def paragraphs(text, width, every):
    """A licence as files have it: broken into lines and paragraphs."""
    lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
    return "\n\n".join("\n".join(lines[i:i + every]) for i in range(0, len(lines), every))


FUNCTIONS = "\n".join(f"def step_{i}(x):\n    return x + {i}\n" for i in range(60))


def full(name):
    return max((t for n, t in TEMPLATES if n == name), key=len)


def test_windows_against_brute_force(make_docs, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 5000]
    rows += [(300 + i, f"Copyright 2020 some one\n\n{t}\n\n{FUNCTIONS[:400]}", "s") for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(400, " ".join(["Released under the MIT License."] * 30), "s"), (401, full("MIT")[: len(full("MIT")) * 7 // 10], "s"),
             (402, "of the software and the use of the software " * 40, "s"), (403, full("MIT") + "\n\n" + full("ISC") + full("MIT"), "s")]
    for threshold in (0.8, 0.6):
        got = license_matches(make_docs(rows), threshold=threshold).collect()
        for (i, text, _), r in zip(rows, got):
            found = sorted((w["start"], w["n_words"], w["license"], round(w["dice"], 12), w["unit"]) for w in r["windows"])
            assert r["doc_id"] == i and found == brute_windows(text, TEMPLATES, threshold), (i, threshold)


def test_licences_inside_longer_files(make_docs):
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "Zlib", "Unlicense", "GPL-3.0"]
    rows = [(i, f"Copyright (c) 2021 A. Author\n\n{paragraphs(full(n), 76, 4)}\n\n{FUNCTIONS}", "s") for i, n in enumerate(names)]
    clean = [(90, FUNCTIONS, "s"), (91, "the use of this software in the work of the author and the terms of the " * 200, "s")]
    got = {r["doc_id"]: r for r in license_matches(make_docs(rows + clean)).collect()}
    for i, n in enumerate(names):
        best = max(got[i]["windows"], key=lambda w: (w["dice"], w["n_words"]))
        assert best["license"] == n and best["dice"] >= 0.9 and best["start"] <= 8, n
    assert all(not got[i]["windows"] and not got[i]["matches"] for i in (90, 91))
