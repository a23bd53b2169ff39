"""Each operator against brute force or the library, on texts with every odd case; see ``odd_documents``."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import chat, decontaminate, html_text, language_id, near_dup, piece_codec, substring_dedup, suffix_dedup, token_store, vector_dup
from specloom.llm.components import connected_components
from specloom.llm.repeats import cut_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def vocabulary(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(1, 9))) for _ in range(n)]


def odd_documents() -> list[tuple[int | None, str | None]]:
    """Plain texts, exact and near copies, shared passages, repeats inside a text, and empty, null, odd and long ones."""
    r, v = random.Random(3), vocabulary(1)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    docs: list[tuple[int | None, str | None]] = [(i, text(r.randint(1, 150))) for i in range(60)]
    base, passage, line = text(120), text(60), text(12)
    for i in range(100, 130):
        w = base.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(v)
        docs.append((i, " ".join(w)))
    docs += [(200 + i, f"{text(r.randint(1, 40))}\n{passage}\n{line}\n{text(r.randint(1, 40))}") for i in range(12)]
    docs += [(300 + i, f"{line}\n{text(50)}\n{line}") for i in range(20)]
    docs += [(400, base), (401, base), (402, base.upper()), (402, text(40)), (402, text(40)), (403, base), (403, base)]
    docs += [(500, None), (501, ""), (502, " \n\t "), (503, "..."), (504, "word"), (505, "two words"), (506, "ab" * 700), (507, f"{text(45)} {passage} {passage}"), (508, "a " * 5000), (509, text(20000)), (510, "12 34 é ñ   x  "), (None, base), (None, None), (511, "Ωmega ﬁ 　 x\x00y <|endoftext|> </s> it's")]
    return docs


@pytest.fixture(scope="module")
def rows():
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in ("id", "tag", "spans", "node", "keys", "sig", "label", "n", "key", "component_id", "TEXT2"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def covered(seqs, length):
    count = Counter(s[i : i + length] for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_suffix_dedup(spark, docs, rows, empty):
    seqs = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), s, gone in zip(rows, seqs, covered(seqs, 200)):
        kept = bytes(c for c, g in zip(s, gone) if not g)
        want[i, len(s), len(s) - len(kept), sum(b and not a for a, b in zip([False, *gone], gone)), hashlib.sha256(kept).hexdigest()] += 1
    cut = lambda d: cut_texts(d, suffix_dedup.repeated_bytes(spark, d), suffix_dedup._cut, "a bigint, b bigint, c bigint, d string", ["a", "b", "c", "d"])
    assert multiset(cut(docs)) == want
    assert cut(empty).count() == 0
    kept = suffix_dedup.remove_repeats(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert kept.where("doc_id = 504").first().text == "word" and kept.where("doc_id = 500").first().text is None
    assert kept.where("doc_id = 400").first().n_chars == len(kept.where("doc_id = 400").first().text)


def test_substring_dedup(spark, docs, rows, empty):
    seqs = [tuple(WORDS.findall(t or "")) for _, t in rows]
    want = Counter()
    for (i, _), s, gone in zip(rows, seqs, covered(seqs, 35)):
        kept = [w for w, g in zip(s, gone) if not g]
        want[i, len(s), len(s) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    cut = lambda d: cut_texts(d, substring_dedup.repeated_words(spark, d), substring_dedup._cut, "a bigint, b bigint, d string", ["a", "b", "d"])
    assert multiset(cut(docs)) == want
    assert cut(empty).count() == 0


def test_long_texts_are_cut_in_blocks(spark, monkeypatch):
    from specloom.llm import windows

    monkeypatch.setattr(windows, "BLOCK", 97)
    r = np.random.default_rng(0)
    seqs = [r.integers(0, 4, n).astype(np.uint64) for n in (500, 20, 0, 333)]
    hashes = []
    for b in windows.blocks(seqs, 20):
        a = windows.Anchors(seqs, b, 20, 5)
        h, count = a.window_hashes(np.arange(len(a.lo)))
        at = np.concatenate([np.arange(lo, hi + 1) - off for lo, hi, off in zip(a.lo, a.hi, a.base)])
        hashes += list(zip(np.repeat(a.seq, count).tolist(), at.tolist(), h.tolist()))
    assert len(hashes) == sum(max(0, len(s) - 19) for s in seqs) == len({x[:2] for x in hashes})
    content = {}
    for i, s, h in hashes:
        assert content.setdefault(h, seqs[i][s : s + 20].tolist()) == seqs[i][s : s + 20].tolist()


def sets_of(rows, size):
    out = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, empty, size, percent):
    sets = sets_of(rows, size)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k), i) if sets[k] else i
        want[i, len(sets[k]), c, i is not None and i == c] += 1
    assert multiset(near_dup.near_duplicates(spark, docs, size, percent)) == want
    assert near_dup.near_duplicates(spark, empty, size, percent).count() == 0


def test_near_duplicates_join_a_spread_group(spark):
    """A chain whose neighbours are linked and whose ends are not: more rounds than one, and long lists in tiles."""
    v = vocabulary(5, 900)
    rows = [(i, " ".join(v[2 * i : 2 * i + 200])) for i in range(40)] + [(100 + i, " ".join(v[700 + i : 712 + i])) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    old, near_dup.TILE = near_dup.TILE, 8
    try:
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, d, 3, 85).collect()}
    finally:
        near_dup.TILE = old
    assert {got[i] for i in range(40)} == {0} and got[100] == 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[k] == 100 for k in range(100, 130))


def test_sentencepiece(spark, docs, rows, empty):
    c = piece_codec.codec(piece_codec.model_path())
    want = Counter()
    for i, t in rows:
        ids = [*c.sp.encode(t or ""), 2]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.sp.decode(ids).encode()).hexdigest()] += 1
    assert multiset(piece_codec.digest_documents(docs)) == want
    assert piece_codec.digest_documents(empty).count() == 0
    r = piece_codec.encode_documents(docs).where("doc_id = 505").first()
    assert r.ids[-1] == 2 and r.decoded == "two words"


def test_sentencepiece_odd_blanks():
    c = piece_codec.codec(piece_codec.model_path())
    r = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "日", " ", "\t", "<s>", "the", "\x00", "😀"]
    for _ in range(1500):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert c.encode(x) == [*c.sp.encode(x), 2], repr(x)


def test_token_store(spark, docs, rows, empty):
    tok = token_store.tokenizer(token_store.TOKENIZER).tok
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, at = Counter(), 0
    for i, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    folder, shards = token_store.write_store(spark, docs)
    assert multiset(token_store.read_store(spark, folder, shards)) == want
    shard = min(r["shard"] for r in shards.collect())
    reader = token_store.ShardReader(folder, shard)
    assert reader.batch_ids(0).base is not None  # a view of the mapped file
    batch = reader.file.get_batch(reader.file.num_record_batches - 1)
    assert batch.schema.field("ids").type.list_size == token_store.SEQUENCE
    assert sum(int(b.column(1).values.to_numpy(zero_copy_only=False).sum()) for b in map(reader.file.get_batch, range(reader.file.num_record_batches))) == int(reader.starts[-1])
    folder, shards = token_store.write_store(spark, empty)
    assert token_store.read_store(spark, folder, shards).count() == 0


def test_word_tokenizer_odd_characters():
    w = token_store.tokenizer(token_store.TOKENIZER)
    r = random.Random(1)
    parts = ["a", "B", "'s", " ", "\n", "é", "é", "日", " ", "<|endoftext|>", "the", "\x00", "ﬁ", "1", "!", "\x1c", "İ", "ß", "\x85", "́", "Σ", "|", ".", ","]
    for _ in range(1500):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(w.encode(x), w.dtype).tolist() == w.tok.encode(x, add_special_tokens=False).ids, repr(x)


def test_language_id(spark, docs, empty):
    langs = {k: vocabulary(s) for k, s in (("aa", 11), ("bb", 12), ("cc", 13))}
    r = random.Random(2)
    make = lambda k, n: " ".join(r.choice(langs[k]) for _ in range(n))
    model = language_id.fit({k: [make(k, 60) for _ in range(40)] for k in langs})
    texts = [(k, make(k, 15)) for k in langs for _ in range(30)]
    pred, score = language_id.predict([t for _, t in texts], model)
    assert sum(a == k for a, (k, _) in zip(pred, texts)) >= 0.95 * len(texts)
    assert all(0 <= x <= 1 for x in score)
    odd, s = language_id.predict([None, "", "12 !", "x"], model)
    assert odd[:3] == ["und"] * 3 and s[:3] == [0.0] * 3 and odd[3] in langs
    # slices of a long text cost what the whole costs
    old, long = language_id.SCAN, make("bb", 3000)
    whole = language_id.predict([long], model)
    language_id.SCAN = 1000
    try:
        assert language_id.predict([long], model)[0] == whole[0] == ["bb"]
    finally:
        language_id.SCAN = old
    kept = language_id.keep_identified(spark, docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (500, 501, 502, 503)").count() == 0 and kept.where("doc_id = 504").count() == 1
    assert language_id.fit(language_id.sample(empty))["langs"] == [] and language_id.identify(spark, empty, model).count() == 0
    assert language_id.predict(["abc"], language_id.fit({})) == (["und"], [0.0])


def plain_ppm(training, order=3):
    """Context dictionaries of all lengths, filled byte by byte; gives a function of a text's bits."""
    counts = {}
    for text in training:
        data = bytes(order) + text.encode()
        for i in range(order, len(data)):
            for n in range(order + 1):
                counts.setdefault(data[i - n : i], Counter())[data[i]] += 1

    def bits(text):
        data, total = bytes(order) + text.encode(), 0.0
        for i in range(order, len(data)):
            for n in range(order, -1, -1):
                seen = counts.get(data[i - n : i])
                if seen is None:
                    continue
                all_ = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / all_)
                    break
                total -= math.log2(len(seen) / all_)
            else:
                total += 8
        return total

    return bits


def test_code_lengths_are_those_of_plain_ppm():
    r = random.Random(4)
    make = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    training = {k: [make(v, 30) for _ in range(12)] for k, v in (("aa", vocabulary(31, 60)), ("bb", ["данные", "язык", "слово", "и"]), ("cc", ["زبان", "کلمه", "و"]), ("ee", ["x"]))}
    training["dd"] = []
    model = language_id.fit(training)
    want = {k: plain_ppm(v) for k, v in training.items()}
    texts = [make(vocabulary(31, 60), 20), "язык и слово, данные?", "و زبان abc", "\0\0\0z", "日本語 xx", "e"]
    got = language_id._bits(texts, [True] * len(texts), model, 0)
    assert np.allclose(got, [[want[k](t) for k in model["langs"]] for t in texts], rtol=1e-12)
    # of equal code lengths the language that sorts first
    assert language_id.predict(["abc"], language_id.fit({"b": ["abcd"], "a": ["abcd"]})) == (["a"], [0.5])


def test_languages_of_one_script_and_many_copies(spark):
    """Three languages of Cyrillic letters; one has a single text many times over, one only rows without id."""
    r = random.Random(8)
    letters = "абвгдежзиклмнопрстуфхцчшя"
    v = {k: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(50)] for k in ("bg", "ru", "uk")}
    make = lambda k, n: " ".join(r.choice(v[k]) for _ in range(n))
    one = make("uk", 300)
    rows = [(i, make("bg", 40), "bg") for i in range(300)] + [(7000, one, "uk")] * 5000 + [(None, make("ru", 40), "ru") for _ in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(d)
    assert model["langs"] == ["bg", "ru", "uk"]
    texts = [(k, make(k, 25)) for k in v for _ in range(40)]
    pred, _ = language_id.predict([t for _, t in texts], model)
    assert sum(a == k for a, (k, _) in zip(pred, texts)) >= 0.95 * len(texts)
    nothing = language_id.learn(d.withColumn("lang", F.lit(None).cast("string")))
    assert language_id.keep_identified(spark, d.limit(9).union(spark.createDataFrame([(1, "12", "xx")], d.schema)), nothing).count() == 9


def test_language_held_out(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = language_id.op4_language_id(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert out and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_decontaminate(spark, docs, empty):
    v = vocabulary(1)
    base = next(t for i, t in odd_documents() if i == 400)
    items = [(1, " ".join(base.split()[10:40])), (2, " ".join(reversed(v[:30]))), (3, None), (4, ""), (5, "short one"), (6, " ".join(v[100:109]))]
    swapped = v[29::-1][:30]
    swapped = list(reversed(v[:30]))
    swapped[7] = swapped[15] = "zzz"
    more = spark.createDataFrame([(900, "before " + " ".join(swapped) + " after"), (901, " ".join(v[100:109]).upper()), (902, " ".join(reversed(v[:12])))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    all_docs = docs.select("doc_id", "text").union(more)
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_agree) for r in decontaminate.overlaps(spark, all_docs, bench).collect()}
    assert (400, 1) in got and (402, 1) in got and got[900, 2] == (30, 28) and (901, 6) in got
    assert not any(d in (902, 504, 500) or d is not None and d < 60 for d, _ in got)
    kept = decontaminate.keep_clean(spark, docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id = 400").count() == 0 and kept.where("doc_id = 500").count() == 1
    assert decontaminate.overlaps(spark, docs, bench.where("false")).count() == 0 and decontaminate.overlaps(spark, empty, bench).count() == 0
    # the same in blocks of one item
    old, decontaminate.item_blocks.__defaults__ = decontaminate.item_blocks.__defaults__, (1,)
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark, all_docs, bench).collect()} == set(got)
    finally:
        decontaminate.item_blocks.__defaults__ = old


def test_short_items_are_found_word_for_word(spark):
    r, v = random.Random(12), vocabulary(3, 30)
    items = [(i, " ".join(r.choice(v) for _ in range(1 + i % 7))) for i in range(40)] + [(90, None), (91, " . "), (92, v[0]), (92, v[0])]
    docs = [(i, " ".join(r.choice(v) for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, None), (101, items[6][1].upper()), (102, items[6][1] + "x")]
    got = decontaminate.overlaps(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            x = [] if x is None or x == " . " else x.split()
            at = next((k for k in range(len(w) - len(x) + 1) if x and w[k : k + len(x)] == x), None)
            if at is not None:
                want.add((d, i, at, len(x), len(x)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(n == 7 for *_, n in want)


def test_numerals_are_no_letters():
    model = language_id.fit({"de": ["der die das"], "en": ["the a an"]})
    assert language_id.predict(["½ ² ③", "Ⅷ", "12 _ -", "", None], model) == (["und"] * 5, [0.0] * 5)
    assert language_id.predict(["the ½"], model)[0] == ["en"]


def test_html():
    for page, text in html_text.LABELLED:
        assert html_text.extract(page).replace(" .", ".") == text.replace(" .", ".")
    x = html_text.extract
    assert x(None) == x("") == x("<p></p>") == ""
    assert x("<script>a</script><p>b&amp;c <b>d</b>e</p><p>f&nbsp;g</p>") == "b&c de f g"
    assert x("plain  words\nhere") == "plain words here"
    assert x("<article>x<div class='ad'>buy</div>y<form>z</form></article><footer>many more words than that</footer>") == "x y"
    assert x("<div class=menu>a b c</div><div><h1>T</h1><p>one two three four</p></div><div id=comments><p>c d e f g h i j k l m n</p></div>") == "T one two three four"
    assert x("<article><p>unclosed <b>bold<p>next <a href='x>y") in ("unclosed bold next", "unclosed bold next y", "unclosed bold next <a href='x>y")
    assert x("<p>" * 3000 + "deep") == "deep"
    assert x('<article><script>var t="</p>";</script>ok</article>') == "ok"


def test_html_frame(spark):
    d = spark.createDataFrame([(1, "u", "<article>a é</article>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(d).orderBy("page_id").collect()] == [(1, "a é", 3), (2, "", 0)]


def test_chat(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "s", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "s", "b"), (4, 0, "u", "a"), (4, 1, "s", "c"), (4, 1, "s", "c"), (5, 0, None, None), (None, 0, "u", "q"), (6, 5, "u", "a"), (6, 9, "s", "b")]
    t = chat.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)))
    out = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(t, chat.maximal(t)).collect()}
    assert set(out) == {1, 4, 5, None} and out[1][:2] == (2, 3) and out[4][0] == 2
    assert out[1][2] == "<|u|>\na\n<|end|>\n<|s|>\nb\n<|end|>\n" and out[5][2] == "<||>\n\n<|end|>\n"
    # a turn logged with null and with empty text is one turn
    t = chat.number_turns(spark.createDataFrame([(1, 0, "u", None), (1, 0, "u", ""), (1, 1, None, "x"), (1, 1, "", "x")], "conv_id long, turn long, role string, text string"))
    assert [(r.n_turns, r.rendered) for r in chat.render(t, chat.maximal(t)).collect()] == [(2, "<|u|>\n\n<|end|>\n<||>\nx\n<|end|>\n")]
    e = chat.number_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.render(e, chat.maximal(e)).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 16))
    for k in range(100):
        x[300 + k] = x[k % 10] + 0.12 * r.standard_normal(16)
    rows = [(i, [float(np.float32(v)) for v in row], i % 3) for i, row in enumerate(x)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, None, 0), (503, [0.0] * 16, 0), (504, [float("nan")] * 16, 0), (505, [1.0, None] + [0.0] * 14, 0), (506, [1.0], 0), (507, [], 0), (508, [float("inf")] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    ids = [i for i, _ in good]
    label = np.arange(len(ids))
    while True:
        new = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = {i: (int(link[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
    old = vector_dup.LEAF, vector_dup.TILE
    vector_dup.LEAF, vector_dup.TILE = 24, 16
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dup.link_vectors(spark, d).collect()}
    finally:
        vector_dup.LEAF, vector_dup.TILE = old
    assert len(got) == len(rows) and all(got[i] == (0, i) for i in range(502, 509))
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(got[i][0] for i in ids) >= 0.98 * sum(w for w, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.98 * len(ids)
    assert vector_dup.link_vectors(spark, d.where("false")).count() == 0


def test_vectors_of_other_lengths_and_ids(spark):
    a, b, c, d2 = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-1.0, 0.5, 0.0], [1.0, 2.0]
    rows = [(5, a), (5, c), (5, c), (7, b), (None, b), (9, d2), (4, [2.0, 4.0]), (3, [5.0]), (None, [0.0, 1.0, -3.0]), (2, [1.0, 2.0, 3.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in vector_dup.link_vectors(spark, t).collect())
    # the rows of id 5: a is linked with both b, the two c with each other
    assert got == sorted([(5, 2, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 2, 5, False), (0, 2, 5, False), (9, 1, 4, False), (4, 1, 4, True), (3, 0, 3, True), (0, 0, 0, False), (2, 0, 2, True)])


def test_vectors_of_a_large_group(spark):
    """A third of the vectors are distinct near copies of one: no tree may part them."""
    r = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(r.standard_normal((6000, 64)))
    x[:2000] = unit(x[0] + 0.28 * unit(r.standard_normal((2000, 64))))
    x = x.astype(np.float32)
    u = unit(x.astype(np.float64))
    want = (u @ u.T >= 0.9).sum(1) - 1
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dup.link_vectors(spark, d).collect()}
    assert want[:2000].min() > 1900 and sum(got[i][0] for i in range(6000)) >= 0.999 * want.sum()
    assert all(got[i][1] == 0 for i in range(2000))


def test_decontaminate_finds_every_similar_stretch():
    """Planted passages of 8 to 30 words with as many changed words as the rule allows, and clean ones, by brute force."""
    r = random.Random(9)
    v = vocabulary(4, 60)
    words = lambda n: [r.choice(v) for _ in range(n)]
    items = [(i, words(r.choice([8, 9, 10, 11, 12, 13, 20, 40]))) for i in range(60)]
    index = decontaminate.Index([(i, decontaminate.word_hashes(" ".join(w))) for i, w in items])
    planted = 0
    for _ in range(300):
        i, w = r.choice(items)
        n = len(w) if len(w) <= 13 else r.randint(13, min(30, len(w)))
        at = r.randint(0, len(w) - n)
        passage = w[at : at + n]
        for k in r.sample(range(1, n - 1), r.randint(0, n // 5)):
            passage[k] = "zzz"
        text = words(r.randint(0, 20)) + passage + words(r.randint(0, 20))
        want = set()
        for j, x in items:
            for shift in range(-len(x) + 1, len(text)):
                same = [text[p + shift] == x[p] for p in range(max(0, -shift), min(len(x), len(text) - shift))]
                if len(same) == len(x) and 5 * sum(same) >= 4 * len(x) or any(same[s] and same[e - 1] and 5 * sum(same[s:e]) >= 4 * (e - s) for s in range(len(same)) for e in range(s + 13, len(same) + 1)):
                    want.add(j)
        planted += i in want
        assert {x[0] for x in index.overlaps(" ".join(text))} == want
    assert planted == 300
    assert decontaminate.stretch(np.array([c == "1" for c in "111011101110111"]), 40) == (0, 15, 12)


def test_html_landmarks_do_not_bypass_the_scan():
    body = "body words of this page " * 10
    two = f"<article><p>{body}</p></article>" * 2
    assert html_text.extract(two) == " ".join((body * 2).split())
    teaser = f"<main><p>{body}</p><article><p>a teaser</p></article></main>"
    assert html_text.extract(teaser).startswith(" ".join(body.split()))


def test_language_id_learns_every_language(spark):
    """Twenty languages: more than a worker holds tables of."""
    r = random.Random(6)
    v = {f"l{k:02}": vocabulary(50 + k, 40) for k in range(20)}
    rows = [(100 * k + i, " ".join(r.choice(v[lang]) for _ in range(30)), lang) for k, lang in enumerate(v) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(d)
    assert model["langs"] == sorted(v)
    whole = language_id.fit(language_id.sample(d))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole["grams"], model["grams"], strict=True))
    want = {i: lang for i, _, lang in rows}
    got = {x.doc_id: x.lang_pred for x in language_id.identify(spark, d, model).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_hot_windows_are_dealt_to_parts(spark, monkeypatch):
    """Every anchor counts as hot: windows are told apart one by one, in parts, with few and with many of each."""
    from specloom.llm import repeats

    for module in (repeats, suffix_dedup, substring_dedup):
        monkeypatch.setattr(module, "HOT", 0)
    monkeypatch.setattr(repeats, "HELD", 50)
    r, v = random.Random(12), vocabulary(14)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    shared, twice, once = text(50), text(50), text(50)
    texts = [f"{text(r.randint(0, 30))} {shared} {text(r.randint(0, 30))}" for _ in range(90)] + [f"{text(9)} {twice}", f"{twice} {text(9)}", once, f"{text(3)} {shared} {shared}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for module, seqs, length, cut in (
        (suffix_dedup, [t.encode() for t in texts], 200, suffix_dedup.repeated_bytes),
        (substring_dedup, [tuple(WORDS.findall(t)) for t in texts], 35, substring_dedup.repeated_words),
    ):
        want = {i: sum(g) for i, g in enumerate(covered(seqs, length)) if any(g)}
        got = {x.id: sum(e - s for s, e in repeats.merge([y.asDict() for y in x.spans])) for x in cut(spark, d).collect()}
        assert got == want, module


def test_own_keys_of_documents_beyond_the_filter(spark, docs, rows, monkeypatch):
    """With more keys than a filter tells apart, documents are joined with their own: the same spans, fewer windows."""
    from specloom.llm import repeats

    sent = []
    inner = repeats.repeated_windows

    def counted(spark, windows, length):
        sent.append(windows.count())
        return inner(spark, windows, length)

    def spans(find):
        return {(x.id, x.tag): tuple(repeats.merge([y.asDict() for y in x.spans])) for x in find(spark, docs).collect()}

    for module, find in ((suffix_dedup, suffix_dedup.repeated_bytes), (substring_dedup, substring_dedup.repeated_words)):
        monkeypatch.setattr(module, "repeated_windows", counted)
        want = spans(find)
        monkeypatch.setattr(repeats, "MAX_FILTER_BITS", 6)
        assert spans(find) == want
        monkeypatch.setattr(repeats, "MAX_KEYS", -1)
        monkeypatch.setattr(suffix_dedup, "SEEN", 0)
        assert spans(find) == want
        monkeypatch.undo()
        few, full, own = sent[-3:]
        # a filter of 64 bits lets every window pass; own keys go on about as with a filter that holds them all
        assert own < full and own <= 1.5 * few, (module, sent)


def test_words_of_letters_need_no_mark_and_each_word_one_lookup(monkeypatch):
    """New words of ASCII letters are cut by the ids that end a word; odd words as the tokenizer itself has them."""
    from specloom.llm import token_store as T

    tok = T.WordTokenizer(T.model_path(T.TOKENIZER))
    odd = ["a b. C, ΣΑΣ ς. x|y <|endoftext|> ÀÉ ǅ ﬁ İ it's 12,3 a.b . , .. क़ क़. K", "q" * 300 + " " + "Q" * 300 + ".", "", " \x1ca b", "don't DON'T. A A, a."]
    want = [e.ids for e in tok.tok.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode_many(odd)] == want
    seen = []
    whole = tok._segment
    monkeypatch.setattr(tok, "_segment", lambda words: seen.extend(words) or whole(words))
    text = "Quagmire zebrafish, Quagmire. upholstery ZEBRAFISH"
    assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == tok.tok.encode(text, add_special_tokens=False).ids
    assert seen == []
