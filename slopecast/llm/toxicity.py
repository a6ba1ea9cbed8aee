"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words counts their common subsequences of four characters; one that spreads over
``g`` more places than four weighs ``DECAY ** g``, so ``id-iot`` or ``i.diot`` still look like
``idiot``. A word's own mark opens it, digits and signs read as the letters they stand for, and
letters written apart are put together. Landmark words span the feature space: with K their own
kernel matrix, a word x becomes ``K^(-1/2) k(x, landmarks)``, in which a linear machine is trained.
Since the kernel is a product of explicit counts, the trained decision folds into one weight for
each subsequence, and a word costs a few table reads.

Labels belong to documents. A sentence is as toxic as its most toxic word, and a document is judged
by its ``TOP`` most toxic words. Evidence are the words of toxic training documents that begin like
words of many of these and of hardly any other. Training alternates: fit, take the most suspicious
words of the other documents as counter-evidence, and fit again.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_limit, id_and_text, texts

ALPHABET, OPENING = 64, 63
DECAY, SPREAD = 0.5, 5
#: Subsequences are counted under a hash of so many bits.
HASH_BITS = 19
#: Longer words are read through overlapping windows of this many characters.
LONGEST = 40
LANDMARKS, ROUNDS, RIDGE = 384, 5, 2e-3
#: Training: at most so many labelled documents of either kind, of at most so many characters, drawn by hash.
TOXIC_DOCS, OTHER_DOCS, DOC_CHARS = 1200, 2000, 30_000
RANDOM_WORDS, SEED = 6000, 11
WORDS_KEPT = 1_000_000
#: Words that decide on a document, and the margin that stands for one that a text lacks.
TOP, NO_WORDS = 2, -0.5
#: Words and openings of so many characters are evidence at these odds, and with this log likelihood beyond the best of all by chance.
UNIT_CHARS, EVIDENT_ODDS, EVIDENT_GAIN = (4, 5, 6), 10.0, -3.0

# Signs and digits that stand for letters.
READ_AS = str.maketrans("013457@$!|", "oieastasil")
EDGES = ".,;:!?\"'()[]{}<>*_-~`"
APART = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def codes_of(chars: np.ndarray) -> np.ndarray:
    """1..26 for a-z, 27..58 for other letters by code point, 59..62 for the rest of ASCII."""
    return np.where((chars >= 97) & (chars <= 122), chars - 96, np.where(chars >= 128, 27 + chars % 32, 59 + chars % 4))


def places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places [4, n] of every subsequence of a word with its mark, and their weights over the word's norm."""
    found = [(i, *inner, k) for i in range(length) for k in range(i + 3, min(length, i + SPREAD)) for inner in combinations(range(i + 1, k), 2)]
    at = np.array(found, np.int64).reshape(-1, 4).T
    weight = DECAY ** (at[3] - at[0] - 3).astype(float)
    return at, weight / np.sqrt((weight**2).sum()) if len(found) else weight


PLACES = [places(n) for n in range(LONGEST + 2)]


def plain(word: str) -> str:
    return word.strip(EDGES).translate(READ_AS)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in ``words``, subsequence numbers [word, n], weights [n]) by length; words under three characters have none."""
    pieces: dict[int, list[tuple[int, str]]] = {}
    for n, word in enumerate(words):
        own = plain(word)
        readings = [own]
        if not own.isalnum() and own:  # read with and without signs inside
            bare = "".join(filter(str.isalnum, own))
            readings += [bare] if len(bare) >= 3 else []
        for read in readings:
            for at in range(0, max(1, len(read) - LONGEST // 2), LONGEST // 2) if len(read) > LONGEST else (0,):
                part = read[at : at + LONGEST]
                if len(part) >= 3:
                    pieces.setdefault(len(part), []).append((n, part))
    for length, own in pieces.items():
        at_places, weight = PLACES[length + 1]
        for at in range(0, len(own), 4096):
            some = own[at : at + 4096]
            chars = np.frombuffer("".join(p for _, p in some).encode("utf-32-le", "replace"), np.uint32).reshape(len(some), length)
            codes = np.concatenate([np.full((len(some), 1), OPENING), codes_of(chars.astype(np.int64))], axis=1).astype(np.uint32)
            number = np.zeros((len(some), len(weight)), np.uint32)
            for own_place in at_places:
                number = number * np.uint32(ALPHABET) + codes[:, own_place]
            yield np.array([n for n, _ in some]), ((number * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.int64), weight


def margins(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words), bias)
    best = np.full(len(words), -np.inf)
    for rows, numbers, weight in subsequences(words):
        np.maximum.at(best, rows, table[numbers] @ weight.astype(table.dtype))
    found = best > -np.inf
    out[found] += best[found]
    return out


def tokens(text: str) -> set[str]:
    """Distinct words in lower case, and letters written apart put together."""
    low = text.lower()
    found = set(low.split())
    for run in APART.findall(low):
        found.add(run.replace(" ", ""))
    return found


class Model:
    """One weight for each subsequence, a bias, and the logistic scale of a document's margin."""

    def __init__(self):
        self.table = np.zeros(1 << HASH_BITS, np.float32)
        self.bias, self.scale = NO_WORDS, np.array([1.0] + [0.0] * TOP)

    def word_margins(self, words: list[str]) -> np.ndarray:
        return margins(words, self.table, self.bias)

    def score(self, top: np.ndarray) -> np.ndarray:
        """Scores of documents by their ``TOP`` largest margins, largest first."""
        return 1 / (1 + np.exp(-np.clip(top @ self.scale[:-1] + self.scale[-1], -60, 60)))

    def fit(self, docs: list[tuple[str, int]]) -> Model:
        """From (text, label) pairs; with labels of one kind only, every score is that of no evidence."""
        labels = np.array([y for _, y in docs], int)
        if len(set(labels.tolist())) < 2:
            return self
        random = np.random.default_rng(SEED)
        held = [sorted(tokens(t)) for t, _ in docs]
        words = sorted(set().union(*held))
        number = {w: n for n, w in enumerate(words)}
        members = [np.array([number[w] for w in own], np.int64) for own in held]
        toxic, other = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        positive, times = self.evidence(words, members, toxic, other)
        in_other = np.bincount(np.concatenate([members[d] for d in other]), minlength=len(words))
        elsewhere = np.flatnonzero(in_other)
        if not len(positive) or not len(elsewhere):  # nothing sets toxic documents apart
            return self
        suspicious = np.zeros(0, np.int64)
        drawn = random.choice(elsewhere, min(RANDOM_WORDS, len(elsewhere)), replace=False)
        for _ in range(ROUNDS):
            self.machine([words[n] for n in positive], times, [words[n] for n in suspicious], in_other[suspicious], [words[n] for n in drawn], random)
            margin = self.word_margins(words)
            against = [members[d][np.argsort(-margin[members[d]], kind="stable")[:3]] for d in other if len(members[d])]
            suspicious = np.union1d(suspicious, np.concatenate(against))
        self.calibrate(np.array([largest(margin[m].tolist()) for m in members]), labels)
        return self

    @staticmethod
    def evidence(words: list[str], members: list[np.ndarray], toxic: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of toxic documents that are, or begin with, what many of these and hardly any other have; and in how many they are."""
        read = [plain(w) for w in words]
        units: dict[str, int] = {}
        own = [[units.setdefault(u, len(units)) for u in {w, *(w[:n] for n in UNIT_CHARS)} if len(u) >= min(UNIT_CHARS)] for w in read]
        found = np.zeros((2, len(units)))
        for row, kind in enumerate((other, toxic)):
            for d in kind:
                found[row, sorted({u for n in members[d] for u in own[n]})] += 1
        ratio = (found[1] + 0.5) / (len(toxic) + 1) / ((found[0] + 0.5) / (len(other) + 1))
        # Log likelihood against chance, beyond what the best of as many units would have by chance.
        docs, base = found.sum(0), np.array([len(other), len(toxic)]) / (len(other) + len(toxic))
        gain = sum(f * np.log(np.maximum(f, 1e-9) / docs / b) for f, b in zip(found, base))
        evident = (gain >= np.log(len(units)) + EVIDENT_GAIN) & (ratio >= EVIDENT_ODDS)
        times = np.bincount(np.concatenate([members[d] for d in toxic]), minlength=len(words))
        chosen = np.array([n for n in range(len(words)) if times[n] and any(evident[u] for u in own[n])], np.int64)
        return chosen, times[chosen]

    def machine(self, positive: list[str], times: np.ndarray, suspicious: list[str], others: np.ndarray, drawn: list[str], random: np.random.Generator) -> None:
        """Linear machine with squared hinge loss on the Nyström features of the words.

        ``times`` and ``others`` are the documents that have a positive or a suspicious word, and weigh it.
        """
        landmarks = [positive[n] for n in np.argsort(-times, kind="stable")[: LANDMARKS // 2]]
        for some, most in ((suspicious, 3 * LANDMARKS // 4), (drawn, LANDMARKS)):
            rest = sorted(set(some) - set(landmarks))
            landmarks += [rest[n] for n in sorted(random.choice(len(rest), min(max(0, most - len(landmarks)), len(rest)), replace=False))]
        # Rows of explicit counts over the subsequences that any landmark has; the last column is for all others.
        parts = list(subsequences(landmarks))
        used = np.unique(np.concatenate([numbers.ravel() for _, numbers, _ in parts]))
        column = np.full(1 << HASH_BITS, len(used))
        column[used] = np.arange(len(used))
        dense = np.zeros((len(landmarks), len(used) + 1), np.float32)
        for rows, numbers, weight in parts:
            np.add.at(dense, (rows[:, None], column[numbers]), weight.astype(np.float32)[None])
        values, vectors = np.linalg.eigh((dense @ dense.T).astype(float))
        use = values > values.max() * 1e-6
        root = vectors[:, use] / np.sqrt(values[use])
        examples = positive + suspicious + drawn
        kernel = np.zeros((len(examples), len(landmarks)))
        by_column = np.ascontiguousarray(dense.T)
        for rows, numbers, weight in subsequences(examples):
            for at in range(0, len(rows), 256):
                part = by_column[column[numbers[at : at + 256]]]
                np.add.at(kernel, rows[at : at + 256], np.einsum("rnl,n->rl", part, weight.astype(np.float32)))
        x = np.concatenate([kernel @ root, np.ones((len(examples), 1))], axis=1)
        y = np.repeat([1.0, -1.0, -1.0], [len(positive), len(suspicious), len(drawn)])
        weights = (np.sqrt(times), np.sqrt(others), np.ones(len(drawn)))
        cost = np.concatenate([w / max(w.sum(), 1.0) for w in weights])
        w = np.zeros(x.shape[1])
        ridge = RIDGE * np.eye(len(w))
        for _ in range(30):  # Newton steps of the squared hinge
            slack = 1 - y * (x @ w)
            active = slack > 0
            xa, ca = x[active], cost[active]
            step = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
            if np.abs(step - w).max() < 1e-8:
                break
            w = step
        self.table = np.zeros(1 << HASH_BITS, np.float32)
        self.table[used] = ((root @ w[:-1]) @ dense)[:-1]
        self.bias = float(w[-1])

    def calibrate(self, top: np.ndarray, labels: np.ndarray) -> None:
        """Logistic of the top margins, towards smoothed labels so that a clean split stays finite."""
        n1, n0 = (labels == 1).sum(), (labels == 0).sum()
        goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x = np.concatenate([top, np.ones((len(top), 1))], axis=1)
        w, ridge = np.zeros(x.shape[1]), 0.05 * np.diag([1.0] * TOP + [0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (goal - p) - ridge @ w)
            w = w + step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        self.scale = w


def largest(margin: list[float]) -> list[float]:
    """The ``TOP`` largest, largest first, none below ``NO_WORDS`` or beyond the machine's own margin of 1."""
    return [min(1.0, m) for m in sorted([*heapq.nlargest(TOP, margin), *[NO_WORDS] * TOP], reverse=True)[:TOP]]


class Margins(dict):
    """Word -> margin, remembered by a worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def texts(self, values: list[str]) -> np.ndarray:
        held = [tokens(t) for t in values]
        seen = set().union(*held)
        if len(self) + len(seen) > WORDS_KEPT:
            self.clear()
        new = [w for w in seen if w not in self]
        self.update(zip(new, self.model.word_margins(new).tolist()))
        return np.array([largest(list(map(self.__getitem__, own))) for own in held]).reshape(-1, TOP)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 by 5; a null id counts as empty text, so it is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model trained on a bounded sample of labelled documents that are not held out."""
    own = labels.select(labels["doc_id"].cast("long").alias("labelled"), labels[label_column].cast("int").alias("toxic"))
    own = own.where("toxic IN (0, 1) AND labelled IS NOT NULL").where(~held_out(F.col("labelled"))).distinct()
    counts = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    drawn, chosen = F.xxhash64("labelled"), F.lit(False)
    for kind, most in ((1, TOXIC_DOCS), (0, OTHER_DOCS)):
        share = min(1.0, 1.5 * (most + 50) / max(counts.get(kind, 0), 1))
        chosen = chosen | ((F.col("toxic") == kind) & (drawn <= hash_limit(share)))
    # At most some thousand ids by the shares above, so they may be broadcast.
    wanted = F.broadcast(own.where(chosen).select("labelled", "toxic", drawn.alias("drawn")))
    given = id_and_text(docs, id_column, text_column).where(F.length("text") <= DOC_CHARS)
    rows = given.join(wanted, F.col("doc_id") == F.col("labelled")).select("drawn", "text", "toxic").collect()
    kept: dict[int, list] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r.drawn, r.text)):
        if len(kept[r.toxic]) < (TOXIC_DOCS if r.toxic else OTHER_DOCS):
            kept[r.toxic].append((r.text, r.toxic))
    return Model().fit(kept[1] + kept[0])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Whole texts are scored. A null or empty text has no evidence and scores as ``TOP`` times ``NO_WORDS``; repeated
    rows are scored each for itself; only the text bears on a score, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Margins(model)
        for batch, values in texts(batches):
            found = model.score(known.texts(values)) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
