"""Fill-in-the-middle against a direct reading of its rule."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_signal.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def units_of(text, unit):
    if unit == "word":
        return TOKEN.findall(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return list(text)


def expected(key, text, unit="word", seed="42"):
    text = text or ""
    units = units_of(text, unit)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", " \t\r\n", "a", " a", "a ", "a b", "\n\na\n", "<P> here", "x <", "<<S", "a<P", "naïve  café \U0001f600　日本 語\x0b\x0cend\x1c",
             "line\r\nline\n\nlast", "word " * 30_000, "\n" * 500, "é" * 70_000]
    for _ in range(150):
        texts.append("".join(rng.choice("ab<PSM> \t\n\r\x0b\x85 é日😀") for _ in range(rng.randrange(0, 90))))
    return texts


@pytest.mark.parametrize("unit", ["word", "line", "character"])
def test_examples_match_the_rule(spark, unit):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts())] + [(3, " \t\r\n", "y", 2), (None, "no id at all", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    got = fim.fill_in_middle(docs, unit=unit).withColumn("back", fim.restore("output", "form"))
    assert [f for f, _ in got.dtypes] == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = sorted((("" if r.doc_id is None else str(r.doc_id)), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.back) for r in got.collect())
    want = []
    for i, t, _, _ in rows:
        key = "" if i is None else str(i)
        n, form, p, m, out = expected(key, t, unit)
        want.append((key, n, form, p or 0, m or 0, out, t or ""))
    assert found == sorted(want)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_all_rows_cut_and_empty_table(spark):
    docs = spark.createDataFrame([("k1", "some words here"), ("k2", "")], "id string, body string")
    got = {r.doc_id: r.form for r in fim.fill_in_middle(docs, "id", "body", seed="s", rate_pct=100, spm_pct=0).collect()}
    assert got == {"k1": "psm", "k2": "plain"}
    assert fim.fill_in_middle(docs.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, "id", "body", unit="page")


def test_ranks_against_counting():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 7, 5_000).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols)
    at = np.concatenate([[0, 5_000], rng.integers(0, 5_001, 200)])
    for s in range(7):
        assert matrix.rank(s, at).tolist() == [int(np.count_nonzero(symbols[:p] == s)) for p in at]


def test_texts_larger_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 50)
    import pyarrow as pa
    texts = ["aa bb cc " * 30, "", "x y", None, "z" * 200]
    batch = pa.record_batch({"doc_id": pa.array(range(5)), "key": pa.array([str(i) for i in range(5)]), "text": pa.array(texts)})
    rows = [r for out in fim._transform("42", "word", 50, 80)(iter([batch])) for r in out.to_pylist()]
    assert [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows] == [expected(i, t) for i, t in enumerate(texts)]
