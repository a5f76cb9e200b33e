"""Token ids in Arrow files of equal-length sequences.

Documents are laid end to end in ascending id order and cut into sequences of
``length`` ids.  Each partition is one Arrow IPC file, uncompressed, whose
batches hold ``BATCH`` rows of two fixed-size lists: the ids, and a mask that
is false where the last sequence of a file is filled up.  Any sequence is
found by division, and reading it copies nothing.  An index (a Parquet table)
holds, for each document, its file and its first id there.

Files are written by the tasks under names of their own into the shared
folder; only the index, which Spark commits, says which of them count, so a
task that runs twice leaves at most a file that nobody reads.

Null texts are empty: they have the end id only.  Documents without an id come
first.  Rows with the same id stand side by side, in no fixed order.
"""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrel.llm.runtime import setup, wide
from petrel.session import scratch_dir

BATCH = 64          # sequences of a batch
#: Answered words that a worker keeps, in two generations.
KEEP = 600_000
#: Characters at which str.split() cuts and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + (uri[len("file:"):] if uri.startswith("file:") else uri)
    return pafs.FileSystem.from_uri(uri)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level model: printable
    Latin-1 characters for themselves, the others for 256 and up, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer(dict):
    """The ids of each word, by a tokenizers model whose pre-tokens never span white space.

    The ids of a text are those of its words, one after the other.  A word that
    is not held goes through the library: one of Latin-1 letters alone (lower
    case, one pre-token) straight through its merges, any other through all of
    it.  Answers are kept in two generations of at most ``KEEP`` words.
    """

    def __init__(self, model: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.library = Tokenizer.from_str(model)
        self.merges = self.library.model.tokenize
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) < 100:
            if len(self) >= KEEP:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if word.isalpha():
            try:
                word.encode("latin-1")
                letters = word.lower().encode().decode("latin-1").translate(self.letters)
                return np.array([t.id for t in self.merges(letters)], "<u4").tobytes()
            except UnicodeEncodeError:
                pass
        elif len(word) > 1 and word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]       # two pre-tokens
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for t in texts:
            yield b"".join(map(self.__getitem__, [t] if _ODD.search(t) else t.split()))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(model: str) -> WordTokenizer:
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(model)
    return _TOKENIZERS[key]


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """One file: takes ids, writes full batches of sequences."""

    def __init__(self, uri: str, length: int, kind: np.dtype):
        fs, path = file_system(uri)
        self.schema = file_schema(length, pa.from_numpy_dtype(kind))
        self.sink = fs.open_output_stream(path, compression=None)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.length, self.kind, self.held, self.size, self.total = length, kind, [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH * self.length:
            rest = np.concatenate(self.held)
            full = len(rest) // (BATCH * self.length) * BATCH * self.length
            for i in range(0, full, BATCH * self.length):
                self._put(rest[i:i + BATCH * self.length], BATCH * self.length)
            self.held, self.size = [rest[full:]], len(rest) - full

    def _put(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            rest = np.concatenate(self.held)
            self._put(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
        self.file.close()
        self.sink.close()


INDEX = "part int, file string, doc_id long, at long, n_tokens long"


def _write(folder: str, length: int, kind: str, end_id: int, model):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        tokenizer, end = word_tokenizer(model.value), np.array([end_id], "<u4").tobytes()
        uri, writer = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            writer = writer or _Writer(uri, length, np.dtype(kind))
            at, n = [], []
            for ids in tokenizer.encode(t or "" for t in texts):
                ids = np.frombuffer(ids + end, "<u4")
                at.append(writer.total)
                n.append(len(ids))
                writer.add(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), pa.array([uri] * len(n)), batch.column(0),
                 pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["part", "file", "doc_id", "at", "n_tokens"])
        if writer:
            writer.close()
    return run


def write_tokens(docs: DataFrame, model_path: str, folder: str, end_id: int, length: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize, and write sequences and index into ``folder``; an ``end_id`` ends each document."""
    spark = docs.sparkSession
    setup(spark)
    with open(model_path, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    fs, path = file_system(folder)
    fs.create_dir(path + "/data", recursive=True)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id, or without one, are told apart by their place in the input, so that they fill several partitions
    order = ["doc_id", "place"]
    src = src.withColumn("place", F.monotonically_increasing_id())
    src = src.repartitionByRange(wide(spark), *order).sortWithinPartitions(*order).drop("place")
    model = spark.sparkContext.broadcast(text)      # the tokenizer's file, of fixed size
    src.mapInArrow(_write(folder + "/data", length, kind, end_id, model), INDEX).write.parquet(folder + "/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, at (first id in the file), start (ids of all documents before it), n_tokens."""
    rows = spark.read.schema(INDEX).parquet(folder + "/index")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))   # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", "file", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


class Sequences:
    """Random access to a file's sequences, and to runs of ids across them."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem)
                                     else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.number, self.held = -1, None

    def batch(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number != self.number:
            b = self.file.get_batch(number)
            self.number, self.held = number, (b.column(0).flatten().to_numpy(),
                                              b.column(1).flatten().to_numpy(zero_copy_only=False))
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of the i-th sequence."""
        ids, mask = self.batch(i // BATCH)
        at = i % BATCH * self.length
        return ids[at:at + self.length], mask[at:at + self.length]

    def run(self, at: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from ``at`` on, a piece per batch; the mask must hold for each of them."""
        size = BATCH * self.length
        while n:
            ids, mask = self.batch(at // size)
            begin = at % size
            piece = ids[begin:begin + n]
            if not mask[begin:begin + n].all() or not len(piece):
                raise ValueError("the index points beyond the file's ids")
            yield piece
            at, n = at + len(piece), n - len(piece)


def _read(batches):
    uri, source = None, None
    for batch in batches:
        crc = []
        for file, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4))):
            if file != uri:
                uri, source = file, Sequences(file)
            c = 0
            for piece in source.run(at, n):
                c = zlib.crc32(piece.astype("<u4").tobytes(), c)
            crc.append(c)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), batch.column(4), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    return read_index(spark, folder).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "tokens")
