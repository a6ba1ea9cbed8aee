"""Token ids on disk: each document a zstandard frame of its own under one shared dictionary.

A folder of the format holds three tables:

* ``dictionary``: one row, the dictionary's bytes and their SHA-256.
* ``blocks``: rows of about a megabyte. ``payload`` is the frames of consecutive documents, one
  after another; the arrays beside it are the offset index: document ids, first byte of each
  frame, token count and first token counted from the start of the shard.
* ``shards``: for each shard the number of tokens before it.

Documents ascend by id over shards, blocks and arrays. The first and last id of a block are
columns, so a reader of a few short documents prunes by Parquet statistics and opens only their
frames. Ids are little-endian unsigned 32-bit integers. Spark's own writers commit the tables,
so a lost executor costs only its tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_limit, id_and_text, landed, scratch, small_or_plain, texts

END_ID = 1
BLOCK_BYTES = 1 << 20
DICTIONARY_BYTES = 112 << 10
#: The dictionary is trained on this many documents of at most so many characters, drawn by hash.
#: It bears on the compression ratio only.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
#: Distinct words remembered by a worker; the memory is emptied when it is full. An executor may hold several workers.
WORDS_KEPT = 400_000
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER = rb"[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]"
SIMPLE = re.compile(rb"(?:[!-@\[-`{-~]|%b)+" % LETTER)
#: The tokenizer's split, for such words.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:%b)+|[0-9]|[!-/:-@\[-`{-~]+" % LETTER)
#: Bytes, read as Latin-1, to the characters that stand for them in the vocabulary.
BYTE_LEVEL = dict(zip([*range(0x21), *range(0x7F, 0xA1), 0xAD], range(0x100, 0x144)))

BLOCK_SCHEMA = (
    "shard int, first_doc long, last_doc long, dictionary_sha256 string, doc_ids array<long>, "
    "starts array<long>, n_tokens array<long>, offsets array<long>, payload binary"
)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    return own


class WordIds(dict):
    """Word -> its ids as bytes, by the library, asked once for each distinct word.

    The tokenizer's split never joins characters across ASCII white space and drops the white
    space, so a text's ids are those of its words in order. A letter or digit and the symbols at a
    word's end are parted by it. Of a word of printable ASCII and small Latin-1 letters, which the
    normalizer leaves alone, the pieces of the split are known too, so the library's model is asked
    for a piece without the other steps. Other words take all steps.
    """

    def __init__(self, path: str):
        super().__init__()
        self.own = tokenizer(path)
        self.model = self.own.model
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.own.get_vocab(with_added_tokens=False).values()) + 1)]

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            ids = self.of_piece(word.decode())
        elif (stem := word.rstrip(SYMBOLS)) != word and stem[-1:].isalnum():
            ids = self[stem] + self[word[len(stem) :]]
        elif not SIMPLE.fullmatch(word):
            ids = np.asarray(self.own.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        elif len(pieces := PIECES.findall(word)) == 1:
            ids = self.of_piece(word.decode("latin-1").translate(BYTE_LEVEL))
        else:
            ids = b"".join(map(self.__getitem__, pieces))
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids

    def of_piece(self, piece: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(piece)])

    def texts(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, plain(t).split())) for t in texts]


def plain(text: str) -> bytes:
    """UTF-8 in lower case as far as A-Z, which the tokenizer does anyhow; not where a combining
    mark could first compose with a capital."""
    raw = text.encode()
    return raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from serialized id arrays of a bounded sample; empty if there is nothing to learn from."""
    # Drawn by hashes that need no pass over the texts; rows are counted from the files' footers.
    drawn = F.xxhash64("doc_id", F.octet_length("text"))
    share = min(1.0, 2 * (SAMPLE_DOCS + 50) / max(docs.count(), 1))
    few = docs.where(drawn <= hash_limit(share)).where(F.length("text").between(1, SAMPLE_CHARS))
    sample = few.orderBy(drawn, "doc_id", "text").limit(SAMPLE_DOCS).select("text").collect()
    words = word_ids(tokenizer_path)
    arrays = [x for x in words.texts([r.text for r in sample]) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the arrays themselves serve
        return b"".join(arrays)[-DICTIONARY_BYTES:]


def compression(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every row and write the three tables.

    A null text counts as empty: the end id alone. Rows that repeat an id lie side by side,
    ordered by their number of ids and a hash of the text; rows without an id come first. An empty table gives tables without blocks.
    """
    docs = id_and_text(docs, id_column, text_column)
    raw = train_dictionary(docs, tokenizer_path)
    sha = hashlib.sha256(raw).hexdigest()

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One frame for each text, made where the text is read: only frames are sorted."""
        words, shared = word_ids(tokenizer_path), compression(raw)
        pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch, values in texts(batches):
            arrays = [array + end for array in words.texts(values)]
            columns = [pa.array([len(a) // 4 for a in arrays], pa.int64()), pa.array([pack.compress(a) for a in arrays], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "text_key", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        ids, starts, counts, offsets, frames, size = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            named = [i for i in ids if i is not None] or [None]
            row = [shard, named[0], named[-1], sha, ids, starts, counts, offsets, b"".join(frames)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, n_tokens, frame in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(doc_id), starts.append(start), counts.append(n_tokens), offsets.append(size), frames.append(frame)
                start, size = start + n_tokens, size + len(frame)
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, starts, counts, offsets, frames, size = [], [], [], [], [], 0
        if ids:
            yield block()

    spark = docs.sparkSession
    spark.createDataFrame([(sha, bytearray(raw))], "sha256 string, raw binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    with scratch(spark):
        keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        frames = landed(keyed.mapInArrow(framed, "doc_id long, text_key long, n_tokens long, frame binary"), "token-frames")
        order = ["doc_id", "n_tokens", "text_key"]
        ordered = frames.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
        ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    # One row for each shard, so one task can number them.
    sums = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("shard", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (raw little-endian bytes) from the files.

    ``start`` is the number of ids of all documents before. With ``low`` and ``high`` only the
    blocks that can hold such ids are opened, and only the wanted frames are unpacked.
    """
    known = {r.sha256: bytes(r.raw) for r in spark.read.parquet(f"{folder}/dictionary").collect()}
    found = spark.read.parquet(f"{folder}/blocks")
    if low is not None:
        found = found.where(F.col("last_doc") >= low)
    if high is not None:
        found = found.where(F.col("first_doc") <= high)
    base = spark.read.parquet(f"{folder}/shards").select("shard", "before")
    found = found.join(small_or_plain(base), "shard").select(
        "before", "dictionary_sha256", "doc_ids", "starts", "n_tokens", "offsets", "payload"
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = {k: zstandard.ZstdDecompressor(dict_data=compression(v)) for k, v in known.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                before, sha, ids, starts, counts, offsets, payload = (batch.column(c)[row] for c in range(7))
                ids, starts, counts, offsets = ids.as_py(), starts.as_py(), counts.as_py(), offsets.as_py()
                opened, view = packers[sha.as_py()], memoryview(payload.as_py())
                want = [n for n, i in enumerate(ids) if (low is None or i is not None and i >= low) and (high is None or i is not None and i <= high)]
                ends = [*offsets[1:], len(view)]
                arrays = [opened.decompress(view[offsets[n] : ends[n]]) for n in want]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[n] for n in want], pa.int64()),
                        pa.array([before.as_py() + starts[n] for n in want], pa.int64()),
                        pa.array([counts[n] for n in want], pa.int64()),
                        pa.array(arrays, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return found.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
