"""Collocations against a direct count."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cohort_signal.llm import collocations as col


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counted(rows, max_words):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return f, n


def expected(rows, min_count, max_words, subsumed_pct, top):
    f, n = counted(rows, max_words)
    cands = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= min_count}
    dropped = set()
    for (lang, w), longer in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = (lang, w[i:i + k])
                if 100 * longer >= subsumed_pct * cands[inner]:
                    dropped.add(inner)
    by_lang = defaultdict(list)
    for (lang, w), a in cands.items():
        if (lang, w) in dropped:
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]], cut))
    out = []
    for lang, found in by_lang.items():
        for rank, (s, a, phrase, left, right, cut) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s, cut))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "日本", "A", "a\x01b", "\x00", "x\x1cy", "\x01"]
    rows = []
    for _ in range(160):
        words = [rng.choice(vocab[:rng.choice([4, 12, len(vocab)])]) for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "\x0b"]) for w in words)))
    rows += [("en", None), ("en", ""), ("de", " \t\n .,"), ("en", "Fixed Phrase of words"), (None, "fixed phrase")] * 9
    rows += [("fr", "loop " * 2_000), ("fr", "a b " * 700 + "c" * 50_000)]
    return rows


def test_matches_direct_count(spark):
    rows = corpus()
    docs = spark.createDataFrame([(l, t, "r", 1, 0) for l, t in rows], "lang string, text string, rank string, cnt int, n int").repartition(4)
    for min_count, max_words, pct, top in [(6, 5, 100, 2000), (3, 3, 60, 7)]:
        got = sorted(tuple(r) for r in col.collocations(docs, min_count=min_count, max_words=max_words, subsumed_pct=pct, top=top).collect())
        assert got == expected(rows, min_count, max_words, pct, top)
        assert len(got) > 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert col.collocations(docs).count() == 0
    assert col.collocations(docs.limit(0)).count() == 0


def test_parts_of_split_stretches_add_up(monkeypatch):
    """Sums of a sorted stream do not depend on where it is cut."""
    rng = random.Random(2)
    records = Counter(tuple(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(400))
    stream = sorted((col.JOIN.join(w.encode() for w in r), c) for r, c in records.items())
    want = Counter()
    for r, c in records.items():
        for k in range(2, len(r) + 1):
            want[col.JOIN.join(w.encode() for w in r[:k])] += c
    for stretch in (1, 7, 1000):
        monkeypatch.setattr(col, "STRETCH", stretch)
        batches = [pa.record_batch({"lang": pa.array(["x"] * len(part)), "phrase": pa.array([p for p, _ in part], pa.binary()),
                                    "cnt": pa.array([c for _, c in part], pa.int64())}) for part in (stream[i:i + 5] for i in range(0, len(stream), 5))]
        got = Counter()
        for out in col._prefix_sums(10, 5)(iter(batches)):
            for row in out.to_pylist():
                got[row["phrase"]] += row["cnt"]
        for phrase, c in want.items():
            if c >= 10:
                assert got[phrase] == c
            else:
                assert got[phrase] <= c


def test_large_products_are_exact(spark, monkeypatch):
    """1000 * a * n passes 64 bits."""
    a, n = 3_000_000_019, 9_000_000_000_000_011
    stream = spark.createDataFrame([("en", "x\x00y", 2, a), ("en", "x", 1, a + 5), ("en", "y", 1, a + 9)], "lang string, phrase string, size int, cnt long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    monkeypatch.setattr(col, "frequent_phrases", lambda *args: (totals, stream))
    row = col.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert (row.phrase, row.score) == ("x y", 1000 * a * n // ((a + 5) * (a + 9)))


def test_runs_stop_where_words_are_not_joined():
    keep = np.array([1, 1, 0, 1, 1, 1, 1], dtype=bool)
    joined = np.array([1, 0, 0, 1, 0, 1], dtype=bool)
    assert col._runs(keep, joined, 5).tolist() == [2, 1, 0, 2, 1, 2, 1]
    assert col._runs(keep, joined, 1).tolist() == [1, 1, 0, 1, 1, 1, 1]


def test_tasks_hold_one_slice_at_a_time(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), {}
    written = col.materialise
    monkeypatch.setattr(col, "materialise", lambda df, what: (seen.__setitem__(what, int(spark.conf.get(name))), written(df, what))[1])
    col.frequent_phrases(spark.createDataFrame([("en", "a b c " * 50)], "lang string, text string"), min_count=2)
    assert set(seen) >= {"words", "records"} and set(seen.values()) == {col.SLICE_BYTES} and spark.conf.get(name) == before

    n = 1 << 17
    number = np.random.default_rng(1).integers(0, 50, n + 5)
    tracemalloc.start()
    out = col._summed(pa.array([f"w{i}".encode() for i in range(50)]), pa.array(["en"]), np.zeros(n, dtype=np.int64), number, np.arange(n), np.full(n, 2), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out.column("cnt").to_pylist()) == n and peak < 80 * n, peak / n


def test_pairs_are_not_counted_twice(spark, monkeypatch):
    """Frequent words in changing order, two at a time: many frequent pairs, nothing longer, so no records."""
    rng = random.Random(3)
    rows = [("en", ". ".join(f"w{rng.randrange(8)} v{rng.randrange(8)}" for _ in range(200))) for _ in range(20)] + [("de", "a b c, a b")] * 30
    tables, written = {}, col.materialise

    def kept(df, what):
        tables[what] = written(df, what)
        return tables[what]

    monkeypatch.setattr(col, "materialise", kept)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in col.collocations(docs, min_count=20).collect())
    assert got == expected(rows, 20, 5, 100, 2000)
    assert {(r.lang, bytes(r.phrase)) for r in tables["records"].collect()} == {("de", b"a\x00b\x00c")}


def test_pairs_of_several_slices_are_summed_exactly(monkeypatch):
    """Slices with words and languages of their own share their numbers; spelled in small parts."""
    rows = corpus()[:120]
    f, _ = counted(rows, 2)
    want = {(lang, col.JOIN.join(w.encode().replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for w in words)): c
            for (lang, words), c in f.items() if len(words) == 2}
    batches = [pa.record_batch({"lang": pa.array(["und" if l is None else l for l, _ in part]), "text": pa.array([t for _, t in part])})
               for part in (rows[i:i + 7] for i in range(0, len(rows), 7))]
    everything = np.full(1 << (col.BITS - 6), -1, dtype=np.int64)
    for pairs, slice_bytes in [(1 << 22, 6 << 20), (1 << 22, 100), (50, 300), (1, 6 << 20)]:
        monkeypatch.setattr(col, "PAIRS", pairs)
        monkeypatch.setattr(col, "SLICE_BYTES", slice_bytes)
        out = list(col._pairs(everything)(iter(batches)))
        got = Counter()
        for row in (r for b in out for r in b.to_pylist()):
            got[row["lang"], row["phrase"]] += row["cnt"]
        assert got == want
        if pairs == 1 << 22:
            assert sum(b.num_rows for b in out) == len(want) and (len(out) > 1) == (slice_bytes == 100)
