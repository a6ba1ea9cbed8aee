"""Language identification: a bidirectional gated recurrent network over bytes.

Two recurrent layers read the bytes of a text, one from either end. At every position their states
give a probability for each language; the probabilities at the letters of a document are pooled
into its own. The network is trained in numpy by backpropagation through time on windows of a
bounded sample, and applied to whole texts: windows of ``STRIDE`` labelled positions, each read
with ``CONTEXT`` bytes before (or, backwards, behind) it, so memory does not depend on a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import hash_limit, id_and_text, texts

UNITS = 8
STRIDE, CONTEXT = 128, 16
#: Windows that run through the network together.
TOGETHER = 1024
UNKNOWN = "und"

#: Training: at most so many documents of a language and of all, drawn by hash, and so many characters
#: from somewhere in each.
DOCS_PER_LANGUAGE, DOCS_IN_ALL, CHARS_PER_DOC = 400, 20_000, 1500
STEPS, BATCH, LENGTH, RATE, SEED = 400, 192, 64, 0.02, 7

LETTERS = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Layer:
    """One direction: an input row per byte (update, reset, candidate) and the recurrent weights."""

    def __init__(self, random: np.random.Generator, units: int):
        self.units = units
        self.table = random.normal(0, 0.3, (256, 3 * units))
        self.weights = random.normal(0, 1 / np.sqrt(units), (units, 3 * units))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States [position, row, unit] of windows [row, position], and what ``backward`` needs."""
        n, h = self.units, np.zeros((len(x), self.units))
        states, steps = [], []
        for t in range(x.shape[1]):
            own, held = self.table[x[:, t]], h @ self.weights
            gates = sigmoid(own[:, : 2 * n] + held[:, : 2 * n])
            update, reset, inner = gates[:, :n], gates[:, n:], held[:, 2 * n :]
            candidate = np.tanh(own[:, 2 * n :] + reset * inner)
            steps.append((h, update, reset, inner, candidate))
            h = candidate + update * (h - candidate)
            states.append(h)
        return np.stack(states), steps

    def backward(self, x: np.ndarray, steps: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of the table and the weights, through time."""
        d_weights, d_h, d_inputs = np.zeros_like(self.weights), np.zeros_like(d_states[0]), []
        for t in reversed(range(len(steps))):
            before, update, reset, inner, candidate = steps[t]
            d_h = d_h + d_states[t]
            d_candidate = d_h * (1 - update) * (1 - candidate**2)
            d_update = d_h * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * inner * reset * (1 - reset)
            d_held = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            d_inputs.append(np.concatenate([d_update, d_reset, d_candidate], axis=1))
            d_weights += before.T @ d_held
            d_h = d_h * update + d_held @ self.weights.T
        bytes_read, rows = x.T[::-1].ravel(), np.concatenate(d_inputs)
        d_table = np.stack([np.bincount(bytes_read, c, 256) for c in rows.T], axis=1)
        return [d_table, d_weights]


class Network:
    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.layers = [Layer(random, units), Layer(random, units)]
        self.out = random.normal(0, 0.3, (2 * units, len(languages)))
        self.bias = np.zeros(len(languages))

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in (layer.table, layer.weights)] + [self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions of all windows, and its gradients."""
        ahead, ahead_steps = self.layers[0].forward(x)
        back, back_steps = self.layers[1].forward(x[:, ::-1])
        states = np.concatenate([ahead, back[::-1]], axis=2)
        logits = states @ self.out + self.bias
        logits -= logits.max(2, keepdims=True)
        shares = np.exp(logits)
        shares /= shares.sum(2, keepdims=True)
        count, rows = x.size, np.arange(len(y))
        loss = -np.log(shares[:, rows, y] + 1e-12).mean()
        shares[:, rows, y] -= 1
        shares /= count
        d_states = shares @ self.out.T
        units = self.layers[0].units
        d_out = np.tensordot(states, shares, ([0, 1], [0, 1]))
        grads = self.layers[0].backward(x, ahead_steps, d_states[:, :, :units])
        grads += self.layers[1].backward(x[:, ::-1], back_steps, d_states[::-1, :, units:])
        return loss, [*grads, d_out, shares.sum((0, 1))]

    def train(self, samples: list[tuple[bytes, int]], steps: int = STEPS) -> None:
        """Adam over random windows, drawn evenly by language."""
        random = np.random.default_rng(SEED + 1)
        by_language = [[np.frombuffer(raw.ljust(LENGTH), np.uint8) for raw, own in samples if own == n and raw] for n in range(len(self.languages))]
        usable = [n for n, own in enumerate(by_language) if own]
        parameters = self.parameters()
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, steps + 1) if usable else ():
            y = random.choice(usable, BATCH)
            x = np.empty((BATCH, LENGTH), np.uint8)
            for row, n in enumerate(y):
                raw = by_language[n][random.integers(len(by_language[n]))]
                at = random.integers(len(raw) - LENGTH + 1)
                x[row] = raw[at : at + LENGTH]
            _, grads = self.gradients(x, y)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(parameters, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def run(self, x: np.ndarray, layer: Layer) -> np.ndarray:
        """States [position, unit, window] at the positions behind the context, in single precision.

        Units lie along the rows here, so that every gate is one contiguous block.
        """
        n = layer.units
        # The logistic function is 1 / (1 + exp(-x)) and tanh(x) is 2 / (1 + exp(-2x)) - 1; the factors go into the weights.
        factors = np.repeat([-1.0, -1.0, -2.0], n)
        table, weights = (layer.table * factors).astype(np.float32), np.ascontiguousarray((layer.weights * factors).T.astype(np.float32))
        h = np.zeros((n, len(x)), np.float32)
        states = np.empty((STRIDE, n, len(x)), np.float32)
        places = np.ascontiguousarray(x.T).astype(np.intp)
        with np.errstate(over="ignore"):  # an infinite power gives the limit
            for t in range(STRIDE + CONTEXT):
                own = np.ascontiguousarray(table.take(places[t], axis=0).T)
                held = weights @ h
                gates, candidate = own[: 2 * n], own[2 * n :]
                gates += held[: 2 * n]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                held[2 * n :] *= gates[n:]
                candidate += held[2 * n :]
                np.exp(candidate, out=candidate)
                candidate += 1
                np.divide(2, candidate, out=candidate)
                candidate -= 1
                h -= candidate
                h *= gates[:n]
                h += candidate
                if t >= CONTEXT:
                    states[t - CONTEXT] = h
        return states

    def label(self, windows: np.ndarray) -> np.ndarray:
        """Summed probabilities [window, language] over the letters of each window's labelled positions."""
        ahead = self.run(windows[:, : STRIDE + CONTEXT], self.layers[0])
        back = self.run(np.ascontiguousarray(windows[:, ::-1][:, : STRIDE + CONTEXT]), self.layers[1])
        units = self.layers[0].units
        out = self.out.T.astype(np.float32)
        shares = out[:, :units] @ ahead + out[:, units:] @ back[::-1] + self.bias[:, None].astype(np.float32)
        shares -= shares.max(1, keepdims=True)
        np.exp(shares, out=shares)
        weight = LETTERS[windows[:, CONTEXT : CONTEXT + STRIDE].T] / shares.sum(1)
        return np.einsum("pln,pn->nl", shares, weight, dtype=np.float64)

    def pooled(self, values: list[str]) -> np.ndarray:
        """Mean probabilities [text, language] over the letters of each text; zeros without a letter."""
        raws = [np.frombuffer(t.encode(), np.uint8) for t in values]
        counts = np.array([-(-len(r) // STRIDE) for r in raws], np.int64)
        total, owner = np.zeros((len(raws), len(self.languages))), np.repeat(np.arange(len(raws)), counts)
        ends = np.cumsum(counts)
        for at in range(0, len(owner), TOGETHER):
            some = owner[at : at + TOGETHER]
            parts = []
            for n in np.unique(some):  # texts without a byte have no window
                first = ends[n] - counts[n]
                parts.append(cut(raws[n], max(at - first, 0), min(at + TOGETHER - first, counts[n])))
            np.add.at(total, some, self.label(np.concatenate(parts)))
        letters = np.array([LETTERS[r].sum() for r in raws])
        return total / np.maximum(letters, 1)[:, None]


def cut(raw: np.ndarray, first: int, end: int) -> np.ndarray:
    """Windows of the strides from ``first`` to ``end``, with the bytes around them; zeros beyond the text."""
    low, high = first * STRIDE - CONTEXT, end * STRIDE + CONTEXT
    padded = np.zeros(high - low, np.uint8)
    padded[max(0, -low) : min(len(raw), high) - low] = raw[max(0, low) : min(len(raw), high)]
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + STRIDE + CONTEXT)[::STRIDE]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 by 5; a null id counts as empty text, so it is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> list[tuple[str, str]]:
    """(language, passage) of a bounded sample of each language, from a hash range sized by its count."""
    given = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"), docs[lang_column].cast("string").alias("lang"))
    given = given.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r.lang: r["count"] for r in given.groupBy("lang").count().collect()}
    if not counts:
        return []
    most = min(DOCS_PER_LANGUAGE, max(1, DOCS_IN_ALL // len(counts)))
    drawn = F.xxhash64("doc_id", "lang")
    shares = [(n, hash_limit(min(1.0, 2 * (most + 20) / c))) for n, c in counts.items()]
    limits = F.broadcast(given.sparkSession.createDataFrame(shares, "lang string, share_to long"))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - CHARS_PER_DOC, F.lit(1))).cast("int") + 1
    passage = F.substring("text", start, F.lit(CHARS_PER_DOC))
    rows = given.join(limits, "lang").where(drawn <= F.col("share_to")).select("lang", drawn.alias("drawn"), passage.alias("passage")).collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.drawn, r.passage)):
        if len(own := kept.setdefault(r.lang, [])) < most:
            own.append((r.lang, r.passage))
    return [x for own in kept.values() for x in own]


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network:
    """A network trained on documents that are not held out and have a language."""
    rows = training_rows(docs, id_column, text_column, lang_column)
    languages = sorted({lang for lang, _ in rows})
    network = Network(languages or [UNKNOWN])
    network.train([(passage.encode(), languages.index(lang)) for lang, passage in rows])
    return network


def judged(network: Network, values: list[str]) -> tuple[pa.Array, pa.Array]:
    """Language and score of each text."""
    shares = network.pooled(values) if values else np.zeros((0, 1))
    best = shares.argmax(1)
    names = [network.languages[b] if any(map(str.isalpha, t)) else UNKNOWN for b, t in zip(best, values)]
    scores = [min(1.0, float(s[b])) if n != UNKNOWN else 0.0 for s, b, n in zip(shares, best, names)]
    return pa.array(names, pa.string()), pa.array(scores, pa.float64())


def identify(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``score`` is the pooled probability of ``lang_pred``. A null text, or one without a letter, is
    ``und`` with score 0; so is every text if there was no document to learn from. Ties go to the
    language that sorts first. Repeated rows are judged each for itself; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *judged(network, values)], ["doc_id", "lang_pred", "score"])

    found = id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, network: Network, text_column: str = "text") -> DataFrame:
    """``row`` (all columns as given, in one struct), ``lang_pred`` and ``score``, judged as by ``identify``; no join is needed."""
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [t or "" for t in batch.column(0).field(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *judged(network, values)], ["row", "lang_pred", "score"])

    packed = docs.select(F.struct("*").alias("row"))
    return packed.mapInArrow(run, StructType([*packed.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
