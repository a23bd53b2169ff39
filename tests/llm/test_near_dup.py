"""Groups, odd ids and recall of the near-duplicate operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import near_dup

SCHEMA = "doc_id long, text string"


def variants(r, base, n, most):
    """Copies of a list of words with up to ``most`` words changed."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def brute(texts, size, percent):
    """The smallest number of each text's component, by all pairs."""
    sets = [set(near_dup.shingles(t, size).tolist()) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile,members,items,size,percent", [(1024, 512, 400_000, 3, 85), (8, 4, 300, 5, 80)])
def test_large_groups_in_blocks(spark, monkeypatch, tile, members, items, size, percent):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    monkeypatch.setattr(near_dup, "ITEMS", items)
    r = random.Random(7)
    texts = []
    for _ in range(4):
        texts += variants(r, [f"w{r.randrange(10**6)}" for _ in range(90)], 60, 12)
    texts += [" ".join(f"u{r.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    want = brute(texts, size, percent)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark, docs, size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 60 < len(set(want)) < len(texts)


def test_links_of_rows_without_id(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    changed = lambda words, at: [*words[:at], f"n{at}", *words[at + 1 :]]
    one, bridge = base, changed(changed(changed(base, 20), 60), 100)
    three = changed(changed(changed(bridge, 30), 70), 110)
    rows = [(1, " ".join(one)), (None, " ".join(bridge)), (3, " ".join(three)), (None, " ".join(f"z{k}" for k in range(50)))]
    out = near_dup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in out) == [(-1, -1, False), (-1, 1, False), (1, 1, True), (3, 1, False)]


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue white black grey pink teal")
    rows = [(7, a), (7, b), (5, a), (9, c), (9, c), (None, b), (None, c), (8, None), (8, ""), (None, "... "), (4, "...")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tag", F.lit("t")).withColumn("__first", F.lit(1))
    out = near_dup.keep_first(spark, docs)
    assert out.columns == docs.columns
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.text or "") for x in out.collect()))
    # "..." is a word without letters or digits: a shingle like any other
    assert got == sorted([(False, 5, a), (False, 7, b), (False, 9, c), (False, 8, ""), (False, 8, ""), (False, 4, "...")])
    assert near_dup.keep_first(spark, docs.where("false")).count() == 0


def test_recall_of_the_prefix_at_the_threshold():
    """Pairs just at the threshold share a rare key and reach the count, for both settings."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        matches = near_dup.matches_for(percent)
        length, found, n = near_dup.COORDINATES - matches + 1, 0, 400
        for _ in range(n):
            size = int(rng.integers(40, 400))
            both = -(-percent * size // 100)
            values = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            spare = size - both
            x, y = np.unique(values[: both + spare // 2]), np.unique(np.concatenate([values[:both], values[both + spare // 2 :]]))
            k = near_dup.keys_of([x, y])
            order = np.sort(k >> np.uint64(8), axis=1)[:, :length]
            found += bool((k[0] == k[1]).sum() >= matches and np.intersect1d(order[0], order[1]).size)
        assert found == n


def test_a_template_links_nothing_and_costs_no_more_than_its_documents(spark, monkeypatch):
    """Documents of which three quarters are one template: lists of signatures hold all of them, blocks none."""
    r = random.Random(13)
    template = [f"t{k}" for k in range(225)]
    texts = [" ".join([*template, *(f"d{r.randrange(10**9)}" for _ in range(75))]) for _ in range(400)]
    texts += variants(r, texts[0].split(), 5, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    seen = []
    routes = near_dup._routes
    monkeypatch.setattr(near_dup, "TILE", 64)
    monkeypatch.setattr(near_dup, "_routes", lambda blocks, matches: seen.append(blocks.count()) or routes(blocks, matches))
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark, docs, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 85)
    assert seen[0] <= 2 * 10 * near_dup.COORDINATES


def test_rarest_shingles_of_linked_sets_meet(spark):
    r = random.Random(17)
    texts = []
    for _ in range(30):
        texts += variants(r, [f"w{r.randrange(3000)}" for _ in range(r.randint(5, 120))], 4, 5)
    sets = {i: near_dup.shingles(t, 3) for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "node long, items binary")
    own = {}
    for x in near_dup.rarest(spark, df, 85).collect():
        own.setdefault(x.node, set()).add(x.s)
    for i, x in sets.items():
        assert len(own[i]) == len(x) - -(-85 * len(x) // 100) + 1
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 85 * (len(x) + len(sets[j]) - both):
                assert own[i] & own[j]
