"""Statistics against plain counting, trees against a walk row by row, their constraints, and held-out labels."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import quality_rules as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.01"


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract words them."""
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    r = random.Random(4)
    out = [None, "", " \n\t\n ", "a", "# | <>", "x\n\nx\n \n \nx \nx\r\nx\r", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "z " * 300, "é　ü " * 20, "\x0b\x0c\x1c \x85a"]
    for _ in range(150):
        v = [r.choice(["the", "a#", "Ä|", "b<", "c", "d", "e1"]) for _ in range(r.randint(1, 60))]
        text = "".join(x + r.choice([" ", " ", "  ", "\n", "\t"]) for x in v)
        out.append(text + (text[: r.randint(0, len(text))] if r.random() < 0.5 else ""))
    return out


def test_statistics_equal_plain_counts():
    for t in texts():
        assert Q.statistics(t)[:5] == plain(t), t


def made(seed, n=3000):
    r = np.random.default_rng(seed)
    x = r.random((n, 4)).round(2)
    return x, ((x[:, 0] + np.sin(9 * x[:, 1]) * 0.3 - x[:, 2] + r.normal(0, 0.1, n)) > 0.1).astype(float)


def walk(f, row):
    total = f.base
    for at in f.roots:
        while f.left[at] != at:
            at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
        total += f.value[at]
    return total


def test_flat_trees_score_as_a_walk_does():
    x, y = made(1)
    f = Q.fit(x, y, (0, 0, 0, 0))
    assert np.allclose(f.score(x[:200]), [walk(f, row) for row in x[:200]])
    assert ((f.score(x) >= 0) == (y > 0)).mean() > 0.93


@pytest.mark.parametrize("sign,column", [(1, 0), (-1, 2), (1, 1), (-1, 1)])
def test_constraints_hold_everywhere(sign, column):
    x, y = made(2)
    signs = tuple(sign if k == column else 0 for k in range(4))
    f = Q.fit(x, y, signs, depth=4)
    r = np.random.default_rng(3)
    for row in r.random((60, 4)):
        line = np.repeat(row[None], 101, 0)
        line[:, column] = np.linspace(0, 1, 101)
        assert (sign * np.diff(f.score(line)) >= -1e-12).all()


def test_no_labels_and_one_class_give_no_trees():
    x, _ = made(1, 50)
    for y in (np.zeros(0), np.ones(50), np.zeros(50)):
        assert not len(Q.fit(x[: len(y)], y, (0, 0, 0, 0)).roots)


def test_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    test = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    f = Q.learn(docs, labels.where(~test))
    got = Q.judged(Q.text_statistics(docs, f)).join(labels.where(test), "doc_id").where("NOT base_failed").select("kept", (F.col("quality") > 0).alias("good")).collect()
    good = [r.kept for r in got if r.good]
    bad = [not r.kept for r in got if not r.good]
    assert len(good) > 100 and np.mean(good) >= 0.98 and len(bad) > 5 and np.mean(bad) >= 0.85


def test_query(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "plain words " * 3), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "y", "id", "hash", "rank", "TEXT2"):
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(100)] + [(None, 1, 0), (5, None, 0), (6, 0, 1), (6, 1, 1), (10**6, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op11_quality_rules(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = got.collect()
    want = [(i, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]) for i, t in rows for s in [plain(t)]]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert Q.op11_quality_rules(spark, str(tmp_path)).count() == 0
