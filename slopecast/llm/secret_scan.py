"""Secret scans: fixed credential patterns, and guess costs of values in credential contexts.

The guess cost of a value is the least number of guesses over all its segmentations into
dictionary words, dates, repeats, keyboard walks and brute-force spans, by dynamic programming
over positions. A value in a credential context that the fixed patterns miss counts as a secret
when it would take many guesses; placeholders and plain words do not. Plain words are a short fixed
list and the letter words that several texts of the table have outside such values.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, landed, scratch, texts

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE_CHARS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 16
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run starts at its first character, so shorter runs need no match
KINDS = ("assign", "access", "hex", "guess")

#: Other places where a credential is written: a name, a link and a value of printable characters.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credentials?|bearer|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?secret|auth(?:orization|[_ -]?token)?)"""
    r"""(?:["']?[ \t]{0,8}(?:[:=]|=>|->|is|was)[ \t]{0,8}|[ \t]{1,8})["']?(?=([^\s"'<>]))""",
    re.I | re.A,
)
VALUE = re.compile(r"""[^\s"'<>]+""", re.A)
#: A lower-cased text without any of these has neither an assignment nor such a context.
HINTS = ("pass", "pw", "secret", "token", "credential", "bearer", "key", "auth")
#: Decimal logarithm of the guesses from which a value counts as a secret.
SECRET_GUESSES = 10.0

# Common passwords and words, most frequent first; the rank is the cost.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou princess football baseball "
    "sunshine shadow superman michael trustno1 test guest root user default changeme secret token example sample dummy "
    "the and for that this with from have not are was you your value string null none true false todo here name key "
    "api access private public client server service account auth bearer basic credential credentials hidden redacted "
    "removed placeholder insert enter required optional required field column table data base local host prod production "
    "dev development stage staging release version summer winter spring autumn monday friday january march april may june july "
    "august october love money house computer internet football hello world"
).split()
RANK = {w: n + 1 for n, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = 24
LETTERS = re.compile(rf"[^\W\d_]{{3,{LONGEST_WORD}}}")
#: How many texts must have a word, at least and of so many; and how many words are kept, the most frequent first.
LEAST_TEXTS, OF_TEXTS, PLAIN_WORDS = 5, 10_000, 50_000
#: Words that a task holds with their counts; beyond that it passes them on and starts anew.
HELD_WORDS = 500_000
# Rows of the common keyboard; neighbours in a row make a walk.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEIGHBOURS = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])} | {b + a for row in KEY_ROWS for a, b in zip(row, row[1:])}
LEET = str.maketrans("0134578@$!", "oieastbasi")
DATE = re.compile(
    r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)
DATE_GUESSES, YEAR_GUESSES = math.log10(365 * 120), math.log10(120)
#: Repeats and walks longer than this are weighed whole, from places and to places this near to their ends.
LONGEST_RUN = 64


def brute(char: str) -> float:
    """Decimal logarithm of the alphabet that a character is drawn from."""
    if char.isdigit():
        return 1.0
    return math.log10(26) if char.isalpha() else math.log10(33)


def ends(i: int, first: int, last: int, step: int = 1) -> Iterator[int]:
    """Ends of segments from i: the first ones and, of a run longer than ``LONGEST_RUN``, also its last ones."""
    yield from range(first, min(last, i + LONGEST_RUN) + 1, step)
    yield from range(last, max(last - LONGEST_RUN, i + LONGEST_RUN), -step)


def guess_cost(value: str, ranks: dict[str, int] = RANK, enough: float = math.inf) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation; each pattern in it adds a factor of two.

    A repeat or walk is one segment however long it is. In a long one, segments start and end near its two
    ends only, so a value costs time in proportion to its length. ``enough`` itself as soon as the cost
    is known to reach it: as many positions in turn as other segments span do, and no long one goes beyond.
    """
    low = value.lower()
    low = low if len(low) == len(value) else value
    n, plain = len(value), low.translate(LEET)
    each = math.log10(2)
    best = [0.0] + [math.inf] * n
    reached = far = 0
    # Of a walk (0) and of repeats by their width: where the present run started, and its last place that agrees with none behind it.
    start, stop = [0] * 5, [-1] * 5
    for i in range(n):
        here = best[i]
        reached = reached + 1 if here >= enough else 0
        if reached >= LONGEST_RUN and i >= far:
            return enough
        for width in range(5):
            if i > stop[width]:
                k = start[width] = i
                while k + 1 < n and low[k : k + 2] in NEIGHBOURS if not width else k + width < n and value[k] == value[k + width]:
                    k += 1
                stop[width] = k
        if here >= enough or any(s + LONGEST_RUN < i < e - LONGEST_RUN for s, e in zip(start, stop)):
            continue
        best[i + 1] = min(best[i + 1], here + brute(value[i]))
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            leet = 0.0
            if rank is None:
                rank, leet = ranks.get(plain[i:j]), math.log10(4)
            if rank is not None:
                upper = 0.0 if value[i:j] == low[i:j] else math.log10(2 if value[i:j] in (low[i:j].upper(), low[i:j].capitalize()) else 2 ** min(j - i, 10))
                best[j] = min(best[j], here + each + math.log10(rank) + leet + upper)
        if found := DATE.match(low, i):
            j = found.end()
            best[j] = min(best[j], here + each + (YEAR_GUESSES if j - i == 4 else DATE_GUESSES))
        for j in ends(i, i + 3, stop[0] + 1):
            cost = here + each + math.log10(47 * 2 * (j - i))
            best[j] = min(best[j], cost)
            far = max(far, j) if cost < enough else far
        for width in range(1, 5):
            if stop[width] - i >= width:
                unit_cost = sum(map(brute, value[i : i + width]))
                last = i + width * (1 + (stop[width] - i) // width)
                for j in ends(i, i + width * max(2, -(-3 // width)), last, width):
                    cost = here + each + unit_cost + math.log10((j - i) // width)
                    best[j] = min(best[j], cost)
                    far = max(far, j) if cost < enough else far
    return min(best[n], enough)


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE_CHARS] if hinted(text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def contexts(text: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in credential contexts; ``send(True)`` goes on behind the value, else within it."""
    run = 0
    while m := CONTEXT.search(text, at):
        at = m.start(1)
        if at >= run:  # contexts within one value share its end
            run = VALUE.match(text, at).end()
            end = run
            while end > at and text[end - 1] in ".,;:!?)]}":
                end -= 1
        if (yield at, end):
            at = run


def guessed_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """Values in credential contexts that no base span touches and that would take many guesses.

    The search goes on at the start of a value that does not count, which may be the next context.
    """
    out = []
    if not hinted(text):
        return out
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    values, taken = contexts(text), None
    while True:
        try:
            start, end = values.send(taken)
        except StopIteration:
            return out
        before = bisect_left(starts, end)
        taken = not (before and ends[before - 1] > start) and guess_cost(text[start:end], ranks, SECRET_GUESSES) >= SECRET_GUESSES
        if taken:
            out.append((start, 3, end))


def words_of(text: str) -> list[str]:
    """Distinct letter words in lower case, without those of values in credential contexts."""
    parts, at = [], 0
    if hinted(text):
        for start, end in contexts(text):
            if start >= at:
                parts.append(text[at:start])
            at = max(at, end)
    parts.append(text[at:])
    return sorted(set(LETTERS.findall(" ".join(parts).lower())))


def plain_words(docs: DataFrame) -> dict[str, int]:
    """Rank of each plain word: the fixed ones, and those of all texts by the number of texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts_seen = Counter(), 0
        for _, values in texts(batches, 0):
            for text in values:
                held.update(words_of(text))
            texts_seen += len(values)
            if len(held) >= HELD_WORDS:
                yield from counted(held)
                held.clear()
        yield from counted(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([texts_seen], pa.int64())], ["word", "n"])

    def counted(held: Counter) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for start in range(0, whole.num_rows, 10_000):
            yield whole.slice(start, 10_000)

    words = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with scratch(docs.sparkSession):
        words = landed(words.where(F.col("word").isNull() | (F.col("n") >= LEAST_TEXTS)), "words")
        n = words.where("word is null").agg(F.sum("n")).first()[0] or 0
        frequent = words.where(F.col("word").isNotNull() & (F.col("n") >= max(LEAST_TEXTS, n * LEAST_TEXTS / OF_TEXTS)))
        top = frequent.orderBy(F.col("n").desc(), "word").limit(PLAIN_WORDS).collect()
    return {r.word: n + 1 for n, r in reversed(list(enumerate(top)))} | RANK


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``found`` (array of kind, start, end in code points, end exclusive) of every row.

    Ordered by start, then kind as in ``KINDS``. Plain words come from the same table. Whole texts are scanned; a null or empty text has
    no spans; repeated rows are scanned each for itself; other columns are not read.
    """
    given = id_and_text(docs, id_column, text_column)
    ranks = plain_words(given)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            out = []
            for text in values:
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + guessed_spans(text, base, ranks))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["doc_id", "found"])

    return given.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")
