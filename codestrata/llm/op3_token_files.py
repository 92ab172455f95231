"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, written in order of doc_id and memory-mapped back.

Documents are dealt into ranges of doc_id and each range is encoded and written by one task as three little-endian files:
``NAME.bin`` (all ids, 16 bits each where the vocabulary allows it, else 32), ``NAME.idx`` (64-bit offsets of the documents in this
file, and the file's length) and ``NAME.doc`` (64-bit doc ids; a null id is the least 64-bit number). A task reports its counts;
prefix sums over the files give the base of each, which the ``manifest`` table holds, so that base + offset is a position in the
whole corpus. Names carry a random part, and only files that a finished task reported are in the manifest: a task that is run
again leaves the result as it is.

Encoding is the tokenizers library's. White space always separates its pre-tokens, so a text's ids are those of its words at ASCII
white space one after the other, and each worker remembers the ids of words that it has seen.

Defined results: a null or empty text has the end id only; rows of equal doc_id are ordered by a hash of their texts; null ids come first.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm._common import cut, read, scratch, text_or_empty

VOCABULARY, END_ID = "word_bpe_49k.json", 1
NULL_ID = -(2**63)
#: Words and stems that a worker remembers before it starts anew (about 200 bytes each), and texts encoded at a time.
MEMO, CHUNK = 800_000, 128
#: Marks that are a pre-token of their own after letters; letters that the normaliser only lowers, one by one, and that are one pre-token.
_MARKS = b".,;:!?#$%&*"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SUMMARY = "file string, first long, range int, n_docs long, n_tokens long, width int"


class Encoder:
    """Texts to ids with a memo of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}

    def _stems(self, stems: list[str]) -> None:
        """Learns lower-case words of one pre-token each: encoded as one text, cut after the tokens that end a word."""
        for at in range(0, len(stems), 4096):
            some = stems[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # not a vocabulary that marks the ends of words
                self._others(some)
                continue
            data, begin = ids.tobytes(), 0
            for stem, end in zip(some, (ends * self.width).tolist(), strict=True):
                self.memo[stem.encode()] = data[begin:end]
                begin = end

    def _others(self, words: list[str]) -> None:
        if not words:
            return
        encoding = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoding.ids, self.dtype)
        ends = (np.searchsorted(np.array(encoding.word_ids, np.int64), np.arange(len(words) + 1)) * self.width).tolist()
        data = ids.tobytes()
        for word, a, b in zip(words, ends[:-1], ends[1:], strict=True):
            self.memo[word.encode()] = data[a:b]

    def _learn(self, words: set[bytes]) -> None:
        memo, split = self.memo, []
        stems: dict[bytes, None] = {}
        others: dict[bytes, None] = {}
        for word in words:
            core = word.rstrip(_MARKS)
            if core.isalpha():  # ASCII letters
                stem = core.lower()
            elif _LETTERS.fullmatch(text := core.decode("utf-8")):
                stem = text.lower().encode()
            else:
                others[word] = None
                continue
            if stem not in memo:
                stems[stem] = None
            if core != word:
                tail = word[len(core) :]
                if tail not in memo:
                    others[tail] = None
                split.append((word, stem, tail))
            elif stem != word:
                split.append((word, stem, None))
        self._stems([x.decode("utf-8") for x in stems])
        self._others([x.decode("utf-8") for x in others])
        for word, stem, tail in split:
            memo[word] = memo[stem] + memo[tail] if tail else memo[stem]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of this encoder's width."""
        words = [text.encode("utf-8").split() for text in texts]
        own = set(chain.from_iterable(words))
        if new := own.difference(self.memo):
            if len(self.memo) + 3 * len(new) > MEMO:
                self.memo.clear()
                new = own
            self._learn(new)
        of = self.memo.__getitem__
        return [b"".join(map(of, ws)) for ws in words]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, so that its memo outlives a task."""
    return Encoder(path)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, vocabulary: str, end_id: int):
    def write(batches):
        encoder = None
        sinks, offsets, ids = [], [0], []
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not docs:
                continue
            if encoder is None:
                encoder = encoder_of(vocabulary)
                end = np.array([end_id], encoder.dtype).tobytes()
                where, root = _open(folder)
                where.create_dir(root, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                sinks = [where.open_output_stream(f"{root}/{name}.{kind}") for kind in ("bin", "idx", "doc")]
            for at in range(0, len(docs), CHUNK):
                coded = encoder.encode(texts[at : at + CHUNK])
                sinks[0].write(b"".join([x + end for x in coded]))
                ends = np.cumsum([len(x) // encoder.width + 1 for x in coded]) + offsets[-1]
                sinks[1].write(np.array([offsets[-1], *ends[:-1]], "<i8").tobytes())
                own = [NULL_ID if d is None else d for d in docs[at : at + CHUNK]]
                sinks[2].write(np.array(own, "<i8").tobytes())
                offsets[-1] = int(ends[-1])
                ids.append(len(own))
        if encoder is not None:
            sinks[1].write(np.array([offsets[-1]], "<i8").tobytes())
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "first": None, "range": TaskContext.get().partitionId(), "n_docs": sum(ids), "n_tokens": offsets[-1], "width": encoder.width}],
                pa.schema([("file", pa.string()), ("first", pa.int64()), ("range", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]),
            )

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the files of ``docs(doc_id, text, ...)`` to ``folder`` (any address that pyarrow opens) and return the manifest ``(file, base, n_docs, n_tokens, width)``.

    One row a file; the window over them has as many rows as there are write tasks.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = cut(rows.mapInArrow(_writer(folder, vocabulary, end_id), _SUMMARY))
    base = F.sum("n_tokens").over(Window.orderBy("range")) - F.col("n_tokens")
    manifest = files.select("file", base.alias("base"), "n_docs", "n_tokens", "width")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _column(folder: str, name: str, dtype: str) -> np.ndarray:
    """A whole file as an array: memory-mapped where it is a local file."""
    where, root = _open(folder)
    path = f"{root}/{name}"
    if where.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with where.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def _reader(folder: str):
    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = _column(folder, f"{row['file']}.bin", f"<u{row['width']}")
                ends = _column(folder, f"{row['file']}.idx", "<i8")
                docs = _column(folder, f"{row['file']}.doc", "<i8")
                for at in range(0, len(docs), 4096):
                    cuts = ends[at : at + 4097]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    own = docs[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(cuts[:-1] + row["base"]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return documents


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, public_tokenizers.path(VOCABULARY)), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(read(spark, sf_dir, "documents"))
