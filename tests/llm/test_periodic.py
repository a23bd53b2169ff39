"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specloom.llm import periodic


def brute(x):
    """Every period on its own: maximal stretches of equal words that far apart, those of a smaller period left out."""
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and not any(all(x[k] == x[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(r, n):
    """Random words with phrases repeated back to back, some of them of repeats."""
    out = []
    while len(out) < n:
        phrase = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
        if r.random() < 0.3:
            phrase = phrase * r.randint(2, 4) + [r.randrange(50) for _ in range(r.randint(0, 2))]
        out += (phrase * r.randint(1, 8))[: r.randint(1, 400)]
    return out


def test_runs_equal_brute_force():
    r = random.Random(5)
    seen = 0
    for _ in range(120):
        x = made(r, r.randint(20, 500))
        want = brute(x)
        seen += len(want)
        assert periodic.find_runs(x) == want
    assert seen > 300


def test_small_windows_give_the_same_runs(monkeypatch):
    """Long documents are searched in windows; with tiny ones every run crosses some."""
    monkeypatch.setattr(periodic, "WINDOW", 256)
    r = random.Random(6)
    for _ in range(40):
        x = made(r, r.randint(500, 1500))
        assert periodic.find_runs(x) == brute(x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=20, max_size=120))
def test_two_words(x):
    assert periodic.find_runs(x) == brute(x)


@pytest.mark.parametrize("x,want", [([], []), ([1] * 23, []), ([1] * 24, [(0, 24, 1)]), ([1, 2] * 12, [(0, 24, 2)]), (list(range(8)) * 3, [(0, 24, 8)]), (list(range(9)) * 3, [(0, 27, 9)]), ((list(range(9)) * 3)[:-1], [])])
def test_bounds(x, want):
    assert periodic.find_runs(x) == want


def test_long_documents_of_one_word_and_of_one_long_phrase():
    assert periodic.find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    phrase = list(range(70_000))
    assert periodic.find_runs([-1, *phrase * 3, -2]) == [(1, 210_000, 70_000)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{w}" for w in made(r, r.randint(1, 250)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a\n" * 40), (504, "é　ü " * 30), (None, "x y " * 20), (None, None), (503, "a\n" * 40), (505, "A a " * 9 + "b c d " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("runs", "best", "start", "TEXT2", "n_words"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*x) for x in rows), key=key)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert periodic.op13_periodic_runs(spark, str(tmp_path)).count() == 0
