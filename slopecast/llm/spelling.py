"""Spelling variants: words of the corpus one edit apart, each with its far more frequent form.

Near words are found by scanning sorted lists. A word is compared with those behind it by an edit matrix of
which only the three cells next to the diagonal can matter; adjacent words share the rows of their
common prefix, and once all cells of a row exceed one edit, every word with that prefix is skipped.

The vocabulary is divided so that no list is long. Of two words one edit apart, with the shorter of
length f, either the first f // 2 code points agree or the last f - f // 2, so both stand in the list of
one common part. A word joins the lists of its own length and of one less, as the shorter or the longer one.
A list of more than ``LIST_WORDS`` is divided again in the same way by what is still free between
the common parts, without losing a pair, until at most one code point is free.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.session import materialise

from .common import id_and_text, landed, scratch, small_or_plain, texts

RUN = re.compile("[a-zÀ-ÿ]{6,}")
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: The run whose hash this divides loses one code point.
DROP_EVERY = 199
#: A form occurs at least so many times as often as the word.
FORM_TIMES = 5
LIST_WORDS = 64
#: Distinct words that a task counts before it hands them on.
WORDS_HELD = 200_000
KEY = ["short", "low", "high", "head", "tail"]


def document_words(doc_id: int | None, text: str) -> Counter:
    """Counts of the words of a text that are long enough, with their hashed deletions."""
    runs = Counter(RUN.findall(text.encode().lower().decode()))  # bytes: A-Z only
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, n`` of all words with at least ``LEAST_COUNT`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch, values in texts(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), values):
                held.update(document_words(doc_id, text))
                if len(held) >= WORDS_HELD:
                    yield counted()
                    held.clear()
        yield counted()

    parts = id_and_text(docs, id_column, text_column).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def common_prefixes(words: list[str]) -> list[int]:
    """Length of the prefix that each word shares with the one before; 0 for the first."""
    out = [0]
    for a, b in zip(words, words[1:]):
        most, n = min(len(a), len(b)), 0
        while n < most and a[n] == b[n]:
            n += 1
        out.append(n)
    return out


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places i < j of all words of a sorted list of distinct ones that are one edit apart."""
    shared = common_prefixes(words)
    size = len(words)
    # The next word that shares less with its predecessor than this one does.
    lower, stack = [size] * size, []
    for j in range(size - 1, -1, -1):
        while stack and shared[stack[-1]] >= shared[j]:
            stack.pop()
        lower[j] = stack[-1] if stack else size
        stack.append(j)
    for i in range(size - 1):
        own = words[i]
        length = len(own)
        # Row k has the edits between the first k code points of a word and k - 1, k, k + 1 of the own ones.
        rows = [(2, 0, 1)]
        j = i + 1
        reuse = 0
        while j < size:
            word = words[j]
            del rows[reuse + 1 :]
            dead = 0
            for k in range(reuse + 1, len(word) + 1):
                a, b, c = rows[-1]
                letter = word[k - 1]
                left = 2 if k - 1 > length else min(a + (letter != own[k - 2]), b + 1) if k > 1 else 1
                middle = 2 if k > length else min(b + (letter != own[k - 1]), c + 1, left + 1)
                right = 2 if k + 1 > length else min(c + (letter != own[k]), middle + 1)
                rows.append((left, middle, right))
                if left > 1 and middle > 1 and right > 1:
                    dead = k
                    break
            if not dead:
                gap = length - len(word)
                if -1 <= gap <= 1 and rows[len(word)][gap + 1] == 1:
                    yield i, j
                reuse = shared[j + 1] if j + 1 < size else 0
                j += 1
                continue
            reuse = dead
            j += 1
            while j < size and shared[j] >= dead:
                j = lower[j]
            if j < size:
                # Words skipped over may share less than the last one read.
                reuse = min(dead - 1, shared[j])


def divided(rows: DataFrame) -> DataFrame:
    """Each row of ``word, n, short, low, high`` under its two parts of the free code points."""
    free = F.col("short") - F.col("low") - F.col("high")
    half = F.floor(free / 2).cast("int")
    parts = F.array(
        F.struct((F.col("low") + half).alias("low"), F.col("high").alias("high")),
        F.struct(F.col("low").alias("low"), (F.col("high") + free - half).alias("high")),
    )
    rows = rows.select("word", "n", "short", F.explode(parts).alias("p")).select("word", "n", "short", "p.low", "p.high")
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("low")), "tail": F.right("word", F.col("high"))})


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of rows that come list by list in the order of their words."""
    key, words, counts = None, [], []
    near: list[tuple[str, str, int]] = []

    def scanned() -> None:
        for i, j in near_pairs(words):
            if len(words[i]) == key[0] or len(words[j]) == key[0]:
                near.append((words[i], words[j], counts[j]))
                near.append((words[j], words[i], counts[i]))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*near)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "near_n"])

    for batch in batches:
        own = [c.to_pylist() for c in batch.columns]
        for *place, word, n in zip(*own):
            if place != key:
                if len(words) > 1:
                    scanned()
                key, words, counts = place, [], []
            words.append(word), counts.append(n)
        if len(near) > 50_000:
            yield batch_of()
            near.clear()
    if len(words) > 1:
        scanned()
    yield batch_of()


def near_words(vocab: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``word, near, near_n``: every two words of ``word, n`` one edit apart, both ways round, once."""
    length = F.length("word")
    shorts = F.array(F.struct(length.alias("short")), F.struct((length - 1).alias("short")))
    rows = vocab.select("word", "n", F.inline(shorts)).where(f"short >= {LEAST_LENGTH}")
    rows = rows.select("word", "n", "short", F.lit(0).alias("low"), F.lit(0).alias("high"))
    found = None
    while True:
        below = landed(divided(rows), "spelling-lists")
        free = F.col("short") - F.col("low") - F.col("high")
        sized = below.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
        full = landed(sized.where((F.col("size") > list_words) & (free > 1)).select(*KEY), "spelling-full")
        more = full.limit(1).count() > 0
        if more:
            rows = landed(below.join(small_or_plain(full), KEY, "left_semi").select("word", "n", "short", "low", "high"), "spelling-divided")
            below = below.join(small_or_plain(full), KEY, "left_anti")
        ordered = below.repartition(*KEY).sortWithinPartitions(*KEY, "word").select(*KEY, "word", "n")
        part = landed(ordered.mapInArrow(listed, "word string, near string, near_n long").distinct(), "spelling-near")
        found = part if found is None else found.unionAll(part)
        if not more:
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms of each ``word, form``.

    Each step of a chain is several times as frequent as the one before, so chains are short, have no
    cycle and are halved by every join.
    """
    at = landed(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = landed(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = step.drop("moved")
        if step.where("moved").limit(1).count() == 0:
            return at


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    Words are runs of letters of ASCII and Latin-1's upper half (with the two signs among them), in lower case as
    far as A-Z, of six code points or more and at least five occurrences; a run whose hash with its
    document's id is a multiple of 199 loses one code point first. ``form`` is the near word of the largest
    n (of equal ones the smallest) if it has five times the word's n, else null; ``root`` follows forms
    to the last. Null and empty texts have no words, a null id hashes like an empty one, repeated
    rows count as often as they stand, other columns are not read, and an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        vocab = landed(vocabulary(docs, id_column, text_column), "spelling-words")
        best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
        nearest = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        enough: Column = -F.col("best.minus") >= FORM_TIMES * F.col("n")
        joined = vocab.join(nearest, "word", "left").select(
            "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")
        )
        joined = landed(joined, "spelling-forms")
        ends = roots(joined.where("form IS NOT NULL"))
        out = joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialise(out, "spelling-variants")
