"""Byte-level BPE: whole texts to token ids by a local rank file, and ids back to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import id_and_text, texts

#: Longer texts are cut at safe boundaries, so that no single call holds a very long one.
CHUNK_CHARS = 1 << 16
#: Before a blank or line feed that follows a non-space character no match of the split pattern
#: goes on: none of its branches has a space after a non-space, and its only look-ahead
#: concerns a run of spaces, which begins at this boundary.
SAFE_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder for each worker process; the rank file is a local parameter and is never copied."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in order, cut only where the split pattern has a boundary too."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(own: tiktoken.Encoding, text: str) -> np.ndarray:
    parts = [own.encode_to_numpy(part, disallowed_special=()) for part in chunks(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row.

    A null text counts as empty and gives an empty array; repeated rows are encoded each for
    itself; a null id stays null; other columns are not read. No special tokens are recognised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks_path, pattern)
        for batch, values in texts(batches):
            each = [encode_text(own, t) for t in values]
            ends = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) for x in each], out=ends[1:])
            flat = np.concatenate(each) if each else np.zeros(0, np.uint32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """All columns but ``ids_column``, and ``decoded`` (the raw bytes; not every id sequence is valid UTF-8).

    Null ids decode to no bytes. An id that the rank file doesn't have is an error. A column
    ``decoded`` of the input is replaced.
    """
    kept = [c for c in encoded.columns if c not in (ids_column, "decoded")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in kept] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks_path, pattern)
        for batch in batches:
            raw = [own.decode_bytes(x or []) for x in batch.column(len(kept)).to_pylist()]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], [*kept, "decoded"])

    return encoded.select(*kept, ids_column).mapInArrow(run, schema)
