"""The manifest against a plain tree built level by level, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom.llm import merkle

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """Root and, per leaf, the (siblings left, siblings right) of each level."""
    proofs, where, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            proofs[i].append((run[: at % 8], run[at % 8 + 1 :]))
        where = [at // 8 for at in where]
        level = [H(*level[a : a + 8]) for a in range(0, len(level), 8)]
    return level[0], proofs


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        made.append((own, *tree([leaf_of(*r) for r in own])))
    if not made:
        return []
    root, above = tree([m[1] for m in made])
    out = []
    for (own, subroot, proofs), upper in zip(made, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            leaf, proof = leaf_of(*r), proof + upper
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            got = leaf_of(r[0], r[1] and r[1].translate(LOWER), *r[2:]) if changed else leaf
            for left, right in proof:
                got = H(*left, got, *right)
            out.append((r[0], leaf, subroot, root, H(*(d for left, right in proof for d in left + right)), got, got == root))
    return out


def made(counts, seed=1):
    r, rows = random.Random(seed), []
    for lang, n in counts.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i, r.choice([None, "", "Abc É", "lower only", "X" * 50]) if i % 3 else f"Text {i}", lang, r.choice([None, "s", "ü"]), r.choice([None, 3, -7])))
    r.shuffle(rows)
    return rows


CASES = {
    "one row": {"en": 1},
    "lone leaves": {"en": 1, "de": 1},
    "sizes at bounds": {"a": 1, "b": 7, "c": 8, "d": 9, "e": 63, "f": 64, "g": 65, None: 73, "": 2, "é": 3, "z": 130},
    "many languages": {f"l{i}": 1 + i % 3 for i in range(90)},
    "none": {},
}


def write(spark, rows, path):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "digest", "pos", "size", "block", "root", "TEXT2"):
        df = df.withColumn(c, F.lit(c))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("levels", [1, 4])
def test_equals_plain_trees(spark, tmp_path, case, levels):
    """With blocks of one level every tree takes several rounds."""
    rows = made(CASES[case])
    if case == "sizes at bounds":
        rows += [(None, "A", "d", None, None), (None, "A", "d", None, None), (None, None, None, None, None), *rows[:5]]
    write(spark, rows, tmp_path)
    got = merkle.op12_merkle_manifest(spark, str(tmp_path), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(got.collect()) == by_text(expected(rows))


@pytest.mark.parametrize("case", ["one row", "lone leaves", "sizes at bounds", "many languages"])
def test_sql(tmp_path, spark, case):
    rows = made(CASES[case], 2)
    write(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert by_text(con.execute(merkle.OP12_SQL).fetchall()) == by_text(expected(rows))


def test_tampering_shows_only_where_text_changes(spark, tmp_path):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(300)]
    write(spark, rows, tmp_path)
    got = {r.doc_id: r.verified for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(300)}
