"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by range of id and sorted, so part files follow each other in id order
and stripes prune by id. Each row keeps its place within its part; the places of the parts
come from one row per part, so starts need no pass over the ids.

The tokenizer parts words at white space whatever stands around them, so a word's ids are
taken from the library once and kept; ids of a text are its words' ids joined. A word of letters only is
one piece for the tokenizer's model, which is asked for it directly.

Defined cases: a null text is empty and holds the end id only; null ids come first; rows
with an equal id keep one fixed order (by text), equal rows any; a long text is one row of ids, as long as 2 ** 31 of them at
most; other columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, sized_slices

KEPT_WORDS = 200_000  # of a generation; those of the one before are still known
SLICE_BYTES = 32 << 20  # texts encoded together: far fewer ids than Arrow's list offsets can count
SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, place long"
ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


LETTERS = re.compile("[a-zß-öø-ÿ]+")  # normal forms in lower case: the vocabulary's normalizer leaves them as they are
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)  # the tokenizer parts letters from marks; an apostrophe may stand with letters
# the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
ALPHABET = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, which the vocabulary has only; special tokens keep their case."""
    raw = (text or "").encode()
    return [w if b"<|" in w else w.lower() for w in raw.split()] if b"<|" in raw else raw.lower().split()


class WordIds(dict):
    """The ids of words as 32-bit integers, taken from the library when they are first asked for."""

    def __init__(self, vocabulary_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.before = Tokenizer.from_file(vocabulary_path), {}
        self.tokenize = self.whole.model.tokenize

    def bound(self) -> None:
        """Let go of the words that have not been met for a generation."""
        if len(self) > KEPT_WORDS:
            self.before = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        if ids := self.before.get(word):
            self[word] = ids
            return ids
        if word.isalpha():
            found = self.tokenize(word.decode("ascii"))
        elif b"<|" not in word and len(bare := word.rstrip(MARKS)) < len(word) and bare[-1:].isalpha():
            ids = self[word] = self[bare] + self[word[len(bare) :]]
            return ids
        elif LETTERS.fullmatch(text := word.decode()):
            found = self.tokenize(word.decode("latin-1").translate(ALPHABET))
        else:
            ids = self[word] = array("i", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            return ids
        ids = self[word] = array("i", [t.id for t in found]).tobytes()
        return ids


@lru_cache(maxsize=1)
def kept_words(vocabulary_path: str) -> WordIds:
    """What a worker keeps of one vocabulary from task to task."""
    return WordIds(vocabulary_path)


def _encode(vocabulary_path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = kept_words(vocabulary_path)
        end, part, place = np.int32(end_id).tobytes(), TaskContext.get().partitionId(), 0
        for batch in sized_slices(batches, "text", 128, SLICE_BYTES):
            known.bound()
            parts = [b"".join(map(known.__getitem__, words_of(t))) + end for t in batch.column("text").to_pylist()]
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(sizes), pa.array(np.full(len(sizes), part, np.int32)), pa.array(place + ends - sizes)], schema=ARROW)
            place += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 1, bloom_fpp: float = 0.01) -> None:
    """Write ids of all documents to ORC files under path, in ascending order of id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(_encode(vocabulary_path, end_id), SCHEMA)
    writer = tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp)).option("orc.create.index", "true")
    writer.option("orc.row.index.stride", "2000").option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids, n_tokens, start``: start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("held")).collect()  # a row for each file
    starts, at = [], 0
    for r in sorted(parts):
        starts.append((r["part"], at))
        at += r["held"]
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    return rows.join(base, "part").select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("place")).alias("start"))


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    path = fresh_path(docs.sparkSession, "op5-tokens")
    write_tokens(docs, path, vocabulary())
    return token_digest(read_tokens(docs.sparkSession, path))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
