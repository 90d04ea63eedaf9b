"""The license scan against loops over words."""

import math
import random
import re

from tidemark.llm.licenses import PHRASES, TEMPLATES, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, text, threshold):
    w = words(text)
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    met = []
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, t in TEMPLATES:
            own = set(t.split())
            if len(own & have) >= math.ceil(threshold * len(own) - 1e-9):
                met.append((len(own & have) / len(own), label))
    base = {x for _, x in places}
    at = [i for i, _ in places] or [None]
    return (doc, len(w), len(places), at[0], at[-1], ",".join(sorted(base)), ",".join(sorted(base | {x for _, x in met})), 1.0 if places else max([s for s, _ in met], default=0.0))


def texts():
    rng = random.Random(2)
    out = ["MIT License", "mit\nlicense, MIT-LICENSE mit  license", "submit license mit licenses", "émit license", "CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "Kcc by", "cc\x00by İ", "GNU General Public License gnu general public license", "word " * 5000 + "apache license"]
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(6)):
                if w:
                    w.pop(rng.randrange(len(w)))
            w += rng.choices(["other", "words", "the", "of", "Éa"], k=rng.randrange(6))
            if rng.random() < 0.4:
                rng.shuffle(w)
            lines.append(rng.choice([" ", ", ", "-"]).join(x.title() if rng.random() < 0.3 else x for x in w))
        out.append("\n".join(lines))
    return list(enumerate(out))


def test_rows_are_those_of_loops(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for threshold in (0.5, 0.8, 1.0):
        got = sorted(tuple(r) for r in license_scan(docs, threshold=threshold).collect())
        assert got == [brute(i, t, threshold) for i, t in rows]
    assert any(b[6] != b[5] for b in got)


def test_odd_documents(odd_docs, no_docs):
    from tests.llm.conftest import ODD_TEXTS

    got = sorted((tuple(r) for r in license_scan(odd_docs).collect()), key=repr)
    assert got == sorted((brute(i, t, 0.8) for i, t in ODD_TEXTS), key=repr)
    assert license_scan(no_docs).count() == 0
    plan = license_scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_runs(doc, text, threshold):
    row = brute(doc, text, threshold)
    w, met = words(text), [(row[7], x) for x in row[6].split(",") if x]
    for label, t in TEMPLATES:
        own = set(t.split())
        for i in range(len(w)):
            n = len(own & set(w[i : i + len(t.split())]))
            if n >= math.ceil(threshold * len(own) - 1e-9):
                met.append((n / len(own), label))
    return (*row[:6], ",".join(sorted({x for _, x in met})), max([s for s, _ in met], default=0.0))


def wrap(text, width, lead):
    lines = [""]
    for w in text.split():
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] += " " + w
    return "\n".join(lead + x for x in lines)


def test_notices_wrapped_over_lines(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rows = list(enumerate(f"Some code\n{wrap(t.capitalize() + '.', width, lead)}\nand more words of it" for _, t in TEMPLATES for width, lead in ((20, "# "), (40, " * "), (1, ""))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect())
    assert got == [brute_runs(i, t, 0.8) for i, t in rows]
    assert all(TEMPLATES[i // 3][0] in r[6].split(",") and r[7] == 1.0 for i, r in enumerate(got))


def test_runs_are_those_of_loops(spark):
    from tests.llm.conftest import ODD_TEXTS

    rows = texts() + [(1000 + (i or 0), t) for i, t in ODD_TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for threshold in (0.5, 0.8):
        got = sorted(tuple(r) for r in license_scan(docs, threshold=threshold, wrapped=True).collect())
        assert got == sorted(brute_runs(i, t, threshold) for i, t in rows)
