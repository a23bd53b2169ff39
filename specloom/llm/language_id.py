"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order: contexts of up to ``ORDER`` bytes with the counts of what
followed them. A byte seen in the longest known context is coded with count / (n + d), another one pays the escape
d / (n + d) (method C; n counts, d distinct followers) and is coded in the next shorter context, down to the uniform
distribution over 256 bytes. Texts begin in a context of null bytes. Statistics are frozen after fitting, so the code
length of every text is exact, in double precision, and order does not matter. The language with the shortest code wins.

A tree is kept as sorted arrays: the (ORDER + 1)-grams and 3-grams that any language of a group knows with their bits in
each, the escapes of their contexts, and dense tables below. Each Python worker builds them once from the counts.

The classifier is fitted on a bounded sample of labelled rows: for each language the ``SAMPLE_DOCS`` distinct rows of
smallest hash, of each at most ``SAMPLE_CHARS`` characters. Prediction reads whole texts.

Defined results: null text, or text without a letter: ``und`` with score 0. Equal code lengths: the language that sorts
first. Score: the winner's share of the likelihoods. No labelled row at all: ``und``. Rows without doc_id are learned
from like any other; repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import documents, pieces, to_bytes, trim, with_columns_of

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
#: Languages whose tables a worker holds at once; more are taken in groups of so many, over texts of GROUP_BYTES together.
AT_ONCE = 8
GROUP_BYTES = 32_000_000
SCAN = 1_000_000

_LETTER = regex.compile(r"\p{L}")


def codes_of(data: np.ndarray) -> np.ndarray:
    """For each byte after the first ORDER the (ORDER + 1)-gram that ends there, as a number."""
    n = max(0, len(data) - ORDER)
    code = np.zeros(n, np.uint32)
    for k in range(ORDER + 1):
        code = (code << np.uint32(8)) | data[k : n + k]
    return code


def fit(texts: dict[str, list[str]]) -> dict:
    """The frozen statistics: each language's (ORDER + 1)-grams and their counts."""
    model: dict = {"langs": sorted(texts), "grams": []}
    for lang in model["langs"]:
        # grams that span two texts are not counted: each text stands behind ORDER null bytes of its own
        codes = [codes_of(np.frombuffer(bytes(ORDER) + to_bytes(x), np.uint8)) for x in texts[lang]]
        model["grams"].append(np.unique(np.concatenate([np.zeros(0, np.uint32), *codes]), return_counts=True))
    return model


def _merged_counts(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(codes, return_inverse=True)
    return u, np.bincount(at, counts, minlength=len(u))


def _known(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trees:
    """The context trees of some languages: ``bits(codes)`` has a row of exact code lengths for each."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(grams)
        #: bits of grams of one and two bytes, and per order the grams any language knows, their bits, and the escapes
        self.dense = np.empty((self.n, 1 << 16))
        byte = np.arange(1 << 16) & 255
        for k, (codes, counts) in enumerate(grams):
            lower = np.full(256, 8.0)
            for order, size in ((0, 256), (1, 1 << 16)):
                seen = np.bincount(codes & np.uint32(size - 1), counts, minlength=size).reshape(-1, 256)
                n, d = seen.sum(1, keepdims=True), np.count_nonzero(seen, axis=1)[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    own, escape = -np.log2(seen / (n + d)), np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                lower = np.where(seen > 0, own, escape + (lower if order == 0 else lower[byte].reshape(-1, 256))).ravel()
            self.dense[k] = lower
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(2, ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            own = [_merged_counts(codes & mask, counts) for codes, counts in grams]
            union = np.unique(np.concatenate([np.zeros(0, np.uint32), *(u for u, _ in own)]))
            contexts = np.unique(union >> np.uint32(8))
            escapes = np.zeros((self.n, len(contexts)))
            known = np.full((self.n, len(union)), -1.0)
            for k, (u, c) in enumerate(own):
                if not len(u):
                    continue
                context, first, d = np.unique(u >> np.uint32(8), return_index=True, return_counts=True)
                n = np.add.reduceat(c, first)
                escapes[k, np.searchsorted(contexts, context)] = -np.log2(d / (n + d))
                known[k, np.searchsorted(union, u)] = -np.log2(c / np.repeat(n + d, d))
            level = union, known, contexts, escapes
            rest = self._escaped(level, union)
            known[:] = np.where(known < 0, rest, known)
            self.levels.append(level)

    def _escaped(self, level, codes: np.ndarray) -> np.ndarray:
        """Bits of grams that are not coded at this level: the escape, and what shorter contexts take."""
        _, _, contexts, escapes = level
        at, ok = _known(contexts, codes >> np.uint32(8))
        shorter = codes & np.uint32((1 << (8 * (len(self.levels) + 2))) - 1)
        lower = self._bits(shorter, len(self.levels))
        if len(contexts):
            lower = lower + np.where(ok, escapes[:, at], 0.0)
        return lower

    def _bits(self, codes: np.ndarray, levels: int) -> np.ndarray:
        if not levels:
            return self.dense[:, codes]
        union, known, contexts, escapes = self.levels[levels - 1]
        at, ok = _known(union, codes)
        out = np.empty((self.n, len(codes)))
        if len(union):
            out[:, ok] = known[:, at[ok]]
        rest = codes[~ok]
        if len(rest):
            lower = self._bits(rest & np.uint32((1 << (8 * (levels + 1))) - 1), levels - 1)
            at, some = _known(contexts, rest >> np.uint32(8))
            out[:, ~ok] = lower + (np.where(some, escapes[:, at], 0.0) if len(contexts) else 0.0)
        return out

    def bits(self, codes: np.ndarray) -> np.ndarray:
        return self._bits(codes, len(self.levels))


_trees: dict[int, Trees] = {}


def trees(model: dict, first: int = 0) -> Trees:
    """The trees of at most AT_ONCE languages from the one numbered ``first``; only these are held."""
    grams = model["grams"][first : first + AT_ONCE]
    key = hash((first, tuple(model["langs"]), *(g.tobytes() for g, _ in grams)))
    if key not in _trees:
        _trees.clear()
        _trees[key] = Trees(grams)
    return _trees[key]


def buffered(batches, model: dict):
    """Small parts of the batches; for more languages than AT_ONCE large ones, as each needs all groups of tables anew."""
    if len(model["langs"]) <= AT_ONCE:
        yield from pieces(batches)
        return
    held: list[pa.RecordBatch] = []
    for b in pieces(batches):
        held.append(b)
        if sum(x.nbytes for x in held) >= GROUP_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    langs = model["langs"]
    known = [x is not None and bool(_LETTER.search(x)) and bool(langs) for x in texts]
    bits = np.concatenate([np.zeros((len(texts), 0)), *(_bits(texts, known, model, k) for k in range(0, len(langs), AT_ONCE))], axis=1)
    pred, score = [], []
    for i, ok in enumerate(known):
        if not ok:
            pred.append("und")
            score.append(0.0)
            continue
        b = bits[i] - bits[i].min()
        best = int(np.argmin(b))
        pred.append(langs[best])
        score.append(float(1 / np.exp2(-np.minimum(b, 1000)).sum()))
    return pred, score


def _bits(texts: list[str | None], known: list[bool], model: dict, first: int) -> np.ndarray:
    """The code lengths of the known texts in at most AT_ONCE languages from the one numbered ``first``."""
    group = trees(model, first)
    bits = np.zeros((len(texts), group.n))
    pad = bytes(ORDER)
    held: list[tuple[int, bytes]] = []
    size = 0

    def add(rows: list[int], data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """The grams from each start to each end belong to a row; those between an end and the next start to none."""
        u, at = np.unique(codes_of(np.frombuffer(data, np.uint8)), return_inverse=True)
        cost = group.bits(u)
        edges = np.stack([starts, ends], 1).ravel()
        edges = edges[:-1] if edges[-1] == len(at) else edges
        for k in range(group.n):
            bits[rows, k] += np.add.reduceat(cost[k][at], edges)[::2]

    def flush() -> None:
        nonlocal held, size
        if held:
            n = np.array([len(x) for _, x in held])
            starts = np.cumsum(n + ORDER) - n - ORDER
            add([i for i, _ in held], b"".join(pad + x for _, x in held), starts, starts + n)
        held, size = [], 0

    for i, x in enumerate(texts):
        if not known[i]:
            continue
        data = to_bytes(x)
        if len(data) <= SCAN:
            held.append((i, data))
            size += len(data)
        else:
            for s in range(0, len(data), SCAN):  # a very long text in slices, each with the bytes before it
                part = (pad + data)[s : s + SCAN + ORDER]
                add([i], part, np.array([0]), np.array([len(part) - ORDER]))
        if size > SCAN:
            flush()
    flush()
    return bits


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(held_out(), F.lit(False)) == F.lit(False)))


def languages(docs: DataFrame) -> dict[str, int]:
    """All languages of the labelled rows with about how many distinct rows each has, the most frequent first."""
    rows = labelled(docs).groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n"))
    return {r["lang"]: r["n"] for r in rows.orderBy(F.desc("n"), "lang").collect()}


def sample(docs: DataFrame, counts: dict[str, int] | None = None) -> dict[str, list[str]]:
    """A bounded number of labelled training texts of each language, or of those in ``counts``: distinct rows of smallest hash."""
    counts = languages(docs) if counts is None else counts
    langs = list(counts)
    rows = labelled(docs).where(F.col("lang").isin(langs)).select("lang", F.xxhash64("doc_id", "text").alias("rank"), "text")
    # a hash bound that some 4 * SAMPLE_DOCS rows of each language keep, so that the ranking sees no more
    bound = F.lit(None).cast("bigint")
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, int(-(1 << 63) + min(1.0, 4 * SAMPLE_DOCS / max(1, n)) * ((1 << 64) - 2048))).otherwise(bound)
    near = rows.where(F.col("rank") <= bound).select("lang", "rank").distinct()
    ids = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("k") <= SAMPLE_DOCS).select("lang", "rank")
    chosen = rows.join(F.broadcast(ids), ["lang", "rank"], "left_semi").select("lang", "rank", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    out: dict[str, list[str]] = {k: [] for k in langs}
    for r in chosen.groupBy("lang", "rank").agg(F.min("text").alias("text")).collect():
        out[r["lang"]].append(r["text"])
    return {k: sorted(v) for k, v in out.items()}


def learn(docs: DataFrame) -> dict:
    """The model of all languages of ``docs``; the driver holds the texts of AT_ONCE of them at a time."""
    counts = list(languages(docs).items())
    grams = {}
    for k in range(0, len(counts), AT_ONCE):
        part = fit(sample(docs, dict(counts[k : k + AT_ONCE])))
        grams.update(zip(part["langs"], part["grams"], strict=True))
    return {"langs": sorted(grams), "grams": [grams[k] for k in sorted(grams)]}


def identify(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``; ``model`` is bounded by the sample of each language."""
    frozen = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in buffered(batches, frozen.value):
            pred, score = predict(b.column(1).to_pylist(), frozen.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
        trim()

    source = with_columns_of(docs, "doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns as they are but for lang, which is the one predicted.

    Without any labelled row to learn from, rows whose text has a letter stay, and lang is as it was."""
    frozen = spark.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        learned = bool(frozen.value["langs"])
        for b in buffered(batches, frozen.value):
            texts = b.column(at).to_pylist()
            if learned:
                pred, _ = predict(texts, frozen.value)
                if lang is not None:
                    b = b.set_column(lang, b.schema.field(lang), pa.array(pred, b.schema.field(lang).type))
            else:
                pred = ["" if x is not None and _LETTER.search(x) else "und" for x in texts]
            yield b.filter(pa.array([x != "und" for x in pred], pa.bool_()))
        _trees.clear()
        trim()

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_columns_of(documents(spark, sf_dir), "doc_id", "text", "lang")
    return identify(spark, docs, learn(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
