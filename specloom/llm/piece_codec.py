"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so merges never cross from a word into the
marker of the next: a text falls into marked words (any markers, then the characters up to the next marker) that are
encoded independently. Each task keeps a table of the distinct marked words it has met; a word is segmented when it is
first met, and ids join back by position. The table is emptied at ``TABLE_WORDS`` entries, so
memory is bounded and results do not depend on it. A model whose pieces do cross markers, or that normalises, is
encoded text by text instead.

Null text counts as empty; an empty text has the end id only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from specloom.llm.common import documents, trim, with_columns_of

TABLE_WORDS = 250_000
TABLE_CHARS = 100
MODEL = "piece_bpe_32k.model"

class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.sp.eos_id()
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        probe = " Á 　Ａﬁ▁  b "
        self.chunked = not any("▁" in p.lstrip("▁") or " " in p for p in pieces) and self.sp.encode(" x", out_type=str)[0] != "▁x" and self.sp.decode(self.sp.encode(probe)) == probe.replace("▁", " ")
        # a chunk's first piece is the only one that begins with a marker
        self.starts = np.array([self.sp.id_to_piece(i).startswith("▁") for i in range(self.sp.get_piece_size())])
        self.decimals = [str(i) for i in range(self.sp.get_piece_size())]
        self.table: dict[str, bytes] = {}

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of words without blanks, segmented in one call as one text."""
        if not words:
            return []
        ids = np.array(self.sp.encode(" ".join(words)), np.int32)
        cut = np.flatnonzero(self.starts[ids])
        if len(cut) != len(words):
            return [np.array(self.sp.encode(w), np.int32).tobytes() for w in words]
        data, at = ids.tobytes(), [*(4 * cut).tolist(), 4 * len(ids)]
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` with the end id."""
        if not self.chunked or not text or "▁" in text or "\0" in text or "  " in text or text[0] == " " or text[-1] == " ":
            # blanks that stand together belong to one chunk with the word after them: rare, encoded as a whole
            return [*self.sp.encode(text), self.end]
        chunks = text.split(" ")
        table = self.table
        try:
            data = b"".join([table[c] for c in chunks])
        except KeyError:
            new = [c for c in dict.fromkeys(chunks) if c not in table]
            own = dict(zip(new, self._segment(new), strict=True))
            data = b"".join([own.get(c) or table[c] for c in chunks])
            if len(table) + len(new) > TABLE_WORDS:
                table.clear()
            table.update((k, v) for k, v in own.items() if len(k) <= TABLE_CHARS)
        ids = np.frombuffer(data, np.int32).tolist()
        ids.append(self.end)
        return ids

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join([self.decimals[i] for i in ids]).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def model_path(name: str = MODEL) -> str:
    """Where the installed tokenizer package keeps the model on this machine; resolved on each executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, n_tokens, ids (with the end id), decoded of every row."""

    def run(batches):
        c = codec(model_path(model))
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b = big.slice(at, 200)
                ids = [c.encode(x.as_py() or "") for x in b.column(1)]
                own = [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *own], names=["doc_id", *keep, "n_tokens", "ids", "decoded"])
        c.table.clear()
        trim()

    source = with_columns_of(docs, "doc_id", "text", *keep)
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return source.mapInArrow(run, f"{kinds}, n_tokens bigint, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again."""

    def run(batches):
        c = codec(model_path(model))
        for b in batches:
            n, a, d = [], [], []
            for x in b.column(1):
                ids = c.encode(x.as_py() or "")
                n.append(len(ids))
                a.append(c.digest(ids))
                d.append(hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = with_columns_of(docs, "doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir))
