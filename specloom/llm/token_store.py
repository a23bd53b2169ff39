"""Token ids in Arrow files of equal-length sequences.

Documents are taken in ascending order of their ids, encoded, closed with an end id and packed one after another into
sequences of ``SEQUENCE`` ids. A shard holds a contiguous range of documents as an Arrow IPC file: each record batch
has ``ids``, a fixed-size list of unsigned 16- or 32-bit integers (by vocabulary), and ``mask``, a fixed-size list of
booleans, false in the padding after the shard's last document. Equal lengths make the position of any id a
multiplication, so a memory-mapped file is read without copying. Next to it stands a file with each document's number
of ids. A shard is written under a temporary name and renamed, so a repeated or speculative task leaves one whole file.

No token crosses white space, so each distinct word is encoded by the tokenizer once per task and table (of at most
``TABLE_WORDS`` entries) and the ids of a text are joined from it.

Null text counts as empty and has the end id only. Rows of equal doc_id are ordered by text and all kept; rows without
doc_id come first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from specloom.llm.common import documents, fresh_path, materialize, n_partitions, with_columns_of
from specloom.llm.piece_codec import model_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 64
TABLE_WORDS = 1_000_000
TABLE_CHARS = 100
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "|"
# blanks to str.split() that the tokenizer's \s is not sure to share
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "᠎", "​", "﻿")


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.table: dict[str, bytes] = {}
        self.mark = np.frombuffer(self._ids([MARK])[0], self.dtype)[0]
        self.tails = {c: self._ids([c])[0] for c in ".,"}
        #: Whether an id ends a word.
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _segment(self, words: list[str]) -> list[bytes]:
        """Words encoded as one text with a mark between them, which none of them holds, and cut at its id."""
        out: list[bytes] = []
        size = self.dtype.itemsize
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part) - 1:
                out += self._ids(part)
                continue
            data = ids.tobytes()
            start, stop = [0, *(size * (cut + 1)).tolist()], [*(size * cut).tolist(), len(data)]
            out += [data[i:j] for i, j in zip(start, stop, strict=True)]
        return out

    def _segment_letters(self, words: list[str]) -> list[bytes]:
        """Words of ASCII letters alone: each is one piece to the tokenizer, so its last id, and no other, ends a word."""
        out: list[bytes] = []
        size = self.dtype.itemsize
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                out += self._segment(part)
                continue
            data, stop = ids.tobytes(), (size * cut).tolist()
            out += [data[i:j] for i, j in zip([0, *stop[:-1]], stop, strict=True)]
        return out

    def _learn(self, new: set[str]) -> None:
        """Add words to the table. A word of letters, lower-cased and without a point or comma after it, is encoded once
        for all its forms: the tokenizer lower-cases and splits them so itself."""
        table, tails = self.table, self.tails
        letters: dict[str, None] = {}
        others: dict[str, None] = {}
        forms: list[str] = []
        stems: list[str] = []
        for w in new:
            stem = w[:-1] if w[-1] in tails and len(w) > 1 else w
            if stem.isalpha():
                low = stem.lower()
                ascii_ = low.isascii() and stem.isascii()
                if low == w:
                    (letters if ascii_ else others)[w] = None
                    continue
                if ascii_ or len(low) == len(stem) and "\u03c3" not in low and "\u03c2" not in low:
                    forms.append(w)
                    stems.append(low)
                    if low not in table:
                        (letters if ascii_ else others)[low] = None
                    continue
            if MARK in w or "<|" in w:
                table[w] = self._ids([w])[0]
            else:
                others[w] = None
        table.update(zip(letters, self._segment_letters(list(letters)), strict=True))
        table.update(zip(others, self._segment(list(others)), strict=True))
        for w, low in zip(forms, stems, strict=True):
            table[w] = table[low] + tails[w[-1]] if len(w) > len(low) else table[low]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers; words new to the table are encoded together."""
        table = self.table
        plain = [x.isascii() or not any(c in x for c in _ODD) for x in texts]
        plain = [p and not any(c in x for c in _ODD[:4]) for p, x in zip(plain, texts, strict=True)]
        split = [x.split() if p else [] for p, x in zip(plain, texts, strict=True)]
        found = [list(map(table.get, ws)) for ws in split]
        gaps = [[i for i, data in enumerate(f) if data is None] for f in found]
        new = {ws[i] for ws, g in zip(split, gaps, strict=True) for i in g}
        if len(table) + len(new) > TABLE_WORDS:
            table.clear()
        self._learn(new)
        for ws, f, g in zip(split, found, gaps, strict=True):
            for i in g:
                f[i] = table[ws[i]]
        out = [b"".join(f) if p else self._ids([x])[0] for p, x, f in zip(plain, texts, found, strict=True)]
        for w in new:
            if len(w) > TABLE_CHARS:
                del table[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(name: str) -> WordTokenizer:
    if name not in _tokenizers:
        _tokenizers[name] = WordTokenizer(model_path(name))
    return _tokenizers[name]


def portions(column: pa.Array, chars: int = 1_000_000):
    """The texts of a column, nulls as empty, in lists of about so many characters."""
    out, size = [], 0
    for x in column:
        out.append(x.as_py() or "")
        size += len(out[-1])
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Packs documents into the sequences of one shard."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, sequence: int = SEQUENCE):
        self.fs, self.root = _store(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.sequence, self.dtype = f"{self.root}/shard-{shard:06d}", sequence, dtype
        self.tmp = f"{self.name}.{np.random.default_rng().integers(1 << 62)}.tmp"
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.kind = kind
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = self.fs.open_output_stream(self.tmp)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.parts: list[bytes] = []
        self.size = 0
        self.tokens = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // self.dtype.itemsize
        if self.size >= 4 * BATCH * self.sequence * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.parts)
        step = BATCH * self.sequence * self.dtype.itemsize
        whole = len(data) // step * step
        for k in range(0, whole, step):
            self._batch(data[k : k + step], BATCH * self.sequence)
        rest = data[whole:]
        if last and rest:
            n = len(rest) // self.dtype.itemsize
            pad = -n % self.sequence
            self._batch(rest + bytes(pad * self.dtype.itemsize), n)
            rest = b""
        self.parts, self.size = [rest], len(rest)

    def _batch(self, data: bytes, real: int) -> None:
        n = len(data) // self.dtype.itemsize
        mask = np.zeros(n, bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(self.kind, n, [None, pa.py_buffer(data)]), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self, doc_ids: list, counts: list[int], id_type: pa.DataType) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        with self.fs.open_output_stream(f"{self.tmp}.docs") as f, pa.ipc.new_file(f, pa.schema([("doc_id", id_type), ("n_tokens", pa.int64())])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, id_type), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]))
        self.fs.move(f"{self.tmp}.docs", f"{self.name}.docs.arrow")
        self.fs.move(self.tmp, f"{self.name}.arrow")


class ShardReader:
    """Random access to a shard; local files are mapped, not read."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        store, root = _store(folder)
        name = f"{root}/shard-{shard:06d}"
        local = isinstance(store, fs.LocalFileSystem)
        source = pa.memory_map(f"{name}.arrow") if local else store.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(source)
        docs = pa.ipc.open_file(store.open_input_file(f"{name}.docs.arrow")).read_all()
        self.docs, self.sequence = docs, self.file.schema.field("ids").type.list_size
        self.counts = docs.column("n_tokens").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def batch_ids(self, k: int) -> np.ndarray:
        """All ids of record batch ``k``, a view of the file."""
        column = self.file.get_batch(k).column(0)
        return column.values.to_numpy()[column.offset * self.sequence : (column.offset + len(column)) * self.sequence]

    def slices(self, start: int, stop: int):
        """Ids start..stop of the shard as views, one per record batch they touch."""
        step = BATCH * self.sequence
        while start < stop:
            k, at = divmod(start, step)
            piece = self.batch_ids(k)[at : at + stop - start]
            yield piece
            start += len(piece)


def write_store(spark: SparkSession, docs: DataFrame, name: str = TOKENIZER, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Write all documents; the folder and a table (shard, n_docs, n_tokens) with a row per shard."""
    folder = fresh_path(spark, "tokens")
    source = with_columns_of(docs, "doc_id", "text")
    ordered = source.repartitionByRange(n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        shard = TaskContext.get().partitionId()
        tok = tokenizer(name)
        end = np.array([end_id], tok.dtype).tobytes()
        writer, ids, counts, kind = None, [], [], pa.int64()
        for b in batches:
            if writer is None:
                writer, kind = ShardWriter(folder, shard, tok.dtype), b.column(0).type
            ids += b.column(0).to_pylist()
            for texts in portions(b.column(1)):
                for data in tok.encode_many(texts):
                    counts.append(len(data) // tok.dtype.itemsize + 1)
                    writer.add(data + end)
        if writer is not None and ids:
            writer.close(ids, counts, kind)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    return folder, materialize(spark, ordered.mapInArrow(run, "shard int, n_docs bigint, n_tokens bigint"), "shards")


def read_store(spark: SparkSession, folder: str, shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one row per shard passes the driver."""
    at, rows = 0, []
    for r in sorted(shards.collect()):
        rows.append((r["shard"], at))
        at += r["n_tokens"]
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not rows:
        return spark.createDataFrame([], schema)
    work = spark.createDataFrame(rows, "shard int, base bigint").repartition(min(len(rows), n_partitions(spark)))

    def run(batches):
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = ShardReader(folder, shard)
                crcs = []
                for i in range(len(r.counts)):
                    c = 0
                    for piece in r.slices(int(r.starts[i]), int(r.starts[i + 1])):
                        c = zlib.crc32(piece.astype("<u4").tobytes(), c)
                    crcs.append(c)
                yield pa.RecordBatch.from_arrays([r.docs.column("doc_id").combine_chunks(), pa.array(r.starts[:-1] + base, pa.int64()), pa.array(r.counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return work.mapInArrow(run, schema)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder, shards = write_store(spark, docs)
    return read_store(spark, folder, shards, docs.schema["doc_id"].dataType.simpleString())
