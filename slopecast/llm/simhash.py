"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical index.

The upper nodes of the index are masked bit patterns. Two fingerprints within ``RADIUS`` bits agree on
at least one of ``RADIUS + 1`` runs of bits, so each fingerprint lies below one pattern of every run,
and a pair to be linked meets below a common one. A pattern with more than ``NODE_ROWS``
fingerprints is refined: its free bits are divided into runs in the same way, which again loses no
pair and ends when the free bits cannot hold more.

Below a pattern the fingerprints stand in Gray order, where neighbours share most bits. Every
``FANOUT`` neighbours make a node that keeps the bits they share; nodes of nodes go up to one root. A
pair of nodes differs at least in the shared bits that differ, accumulated on the way down, and
is pruned as a whole when these are too many; a pair that cannot differ by more than the radius
is linked as a whole.

Copies fold into one fingerprint first. Below a pattern only a spanning forest of the links leaves the
task, and classes are joined by alternating star contractions, so no list of all pairs ever exists.
Fingerprints, links and classes stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.session import materialise

from .common import landed, scratch, small_or_plain, texts

WORDS, SEED = 4, 42
RADIUS = 4
NODE_ROWS = 4096
FANOUT = 8
#: Rows, and pairs of nodes, that a task works on at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 19


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bits set in over half the shingle hashes; 0 without words."""
    own = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not own:
        return 0
    joined = b" ".join(own)
    ends = list(accumulate(map(len, own), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :] or ends[-1:])], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the long columns ``extra`` as they are, and ``fingerprint`` (the 64 bits as a long) of every row.

    A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            found = pa.array([fingerprint(t, words) for t in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], found], ["doc_id", *extra, "fingerprint"])

    given = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"), *[docs[c].cast("long").alias(c) for c in extra])
    return given.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in extra) + "fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 3]: owners [0, 0, 1, 1, 1] and places [0, 1, 0, 1, 2]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a and b, each labelled by its least member."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while (jumped := label[label]).tobytes() != label.tobytes():
            label[:] = jumped


def local_classes(pattern: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each code the place of a representative of its class among the codes of the same pattern.

    ``pattern`` is a group number per code, in ascending order.
    """
    order = np.lexsort((gray_rank(codes), pattern))
    codes, pattern = codes[order], pattern[order]
    label = np.arange(len(codes))
    # Levels from the leaves up: what all codes below a node share as ones, what any of them has, first child, children.
    levels = [(codes, codes, None, None)]
    groups = pattern
    while len(groups) > len(np.unique(groups)):
        sizes = np.unique(groups, return_counts=True)[1]
        _, place = expand(sizes)
        first = np.flatnonzero(place % FANOUT == 0)
        ones, some = levels[-1][:2]
        levels.append((np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(some, first), first, np.diff(np.append(first, len(groups)))))
        groups = groups[first]
    roots = np.arange(len(groups))
    work = [(len(levels) - 1, roots, roots)] if len(levels) > 1 else []
    while work:
        depth, left, right = work.pop()
        if len(left) > PAIRS_AT_ONCE // FANOUT**2:
            half = len(left) // 2
            work += [(depth, left[:half], right[:half]), (depth, left[half:], right[half:])]
            continue
        first, count = levels[depth][2:]
        owner, place = expand(count[left] * count[right])
        width = count[right][owner]
        below_left, below_right = first[left][owner] + place // width, first[right][owner] + place % width
        once = below_left < below_right if depth == 1 else below_left <= below_right
        once |= (left != right)[owner]
        below_left, below_right = below_left[once], below_right[once]
        ones, some, starts, _ = levels[depth - 1]
        shared = ~((ones[below_left] ^ some[below_left]) | (ones[below_right] ^ some[below_right]))
        least = np.bitwise_count((ones[below_left] ^ ones[below_right]) & shared)
        near = least <= radius
        below_left, below_right = below_left[near], below_right[near]
        if depth == 1:
            merge(label, below_left, below_right)
            continue
        # All codes below both nodes are within the radius: one class, without going further down.
        whole = (least + np.bitwise_count(~shared))[near] <= radius
        for node, other in ((below_left, below_right), (below_right, below_right)):
            low, high = leaves(levels, depth - 1, node[whole]), leaves(levels, depth - 1, node[whole] + 1)
            owner, place = expand(high - low)
            merge(label, low[owner] + place, leaves(levels, depth - 1, other[whole])[owner])
        if not whole.all():
            work.append((depth - 1, below_left[~whole], below_right[~whole]))
    out = np.empty(len(codes), np.int64)
    out[order] = order[label]
    return out


def leaves(levels: list, depth: int, nodes: np.ndarray) -> np.ndarray:
    """First leaf below each node; the number of leaves for a node past the end."""
    for level in range(depth, 0, -1):
        first = np.append(levels[level][2], len(levels[level - 1][0]))
        nodes = first[nodes]
    return nodes


def divided(mask: int, radius: int) -> list[int]:
    """The mask with, each time, one of ``radius + 1`` runs of its free bits added."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * n // (radius + 1) for n in range(radius + 2)]
    return [mask | sum(1 << b for b in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def below_patterns(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """``mask, pattern, code`` of each code below the patterns of the divided masks."""
    finer = [(signed(m), signed(f)) for m in masks for f in divided(m, radius)]
    choices = F.array(*[F.struct(F.lit(m).alias("of"), F.lit(f).alias("mask")) for m, f in finer])
    rows = rows.select("code", F.explode(F.filter(choices, lambda c: c["of"] == F.col("mask")) if "mask" in rows.columns else choices).alias("c"))
    return rows.select("c.mask", F.col("code").bitwiseAND(F.col("c.mask")).alias("pattern"), "code")


def links(codes: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``a, b``: a spanning forest below every pattern of the links between distinct codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(mask, pattern, code):
            new = np.append(True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
            found = local_classes(np.cumsum(new), code.view(np.uint64), radius)
            # The least code stands for its class, as in the contractions that follow.
            order = np.lexsort((code, found))
            head = order[np.append(True, found[order][1:] != found[order][:-1])]
            least = np.empty(len(code), np.int64)
            least[found[head]] = code[head]
            other = least[found]
            apart = other != code
            return pa.RecordBatch.from_arrays([pa.array(code[apart]), pa.array(other[apart])], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                mask, pattern, code = (np.concatenate(c) for c in zip(*held))
                ends = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
                if len(ends):  # all but the last pattern are complete
                    cut = ends[-1]
                    yield linked(mask[:cut], pattern[:cut], code[:cut])
                    mask, pattern, code = mask[cut:], pattern[cut:], code[cut:]
                held, rows = [(mask, pattern, code)], len(code)
        if held:
            yield linked(*(np.concatenate(c) for c in zip(*held)))

    masks, rows, found = [0], codes, None
    while True:
        below = below_patterns(rows, masks, radius)
        full = landed(below.groupBy("mask", "pattern").count().where(F.col("count") > node_rows).select("mask", "pattern"), "simhash-full")
        masks = [r.mask % (1 << 64) for r in full.select("mask").distinct().collect()]  # at most radius + 1 times as many as before
        if masks:
            rows = landed(below.join(small_or_plain(full), ["mask", "pattern"], "left_semi"), "simhash-refined")
            below = below.join(small_or_plain(full), ["mask", "pattern"], "left_anti")
        sorted_rows = below.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
        part = landed(sorted_rows.mapInArrow(run, "a long, b long").distinct(), "simhash-links")
        found = part if found is None else found.unionAll(part)
        if not masks:
            return found


def stars(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of an undirected graph, root being its least reachable node.

    Large-star and small-star contractions until nothing changes; each is a minimum per node,
    combined before the shuffle, and a join that adaptive execution can split at a hot node.
    """

    def least(edges: DataFrame, purpose: str) -> DataFrame:
        return landed(edges.groupBy("u").agg(F.min("v").alias("m")), purpose).hint("merge")

    edges = landed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star-edges")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both, "star-large").withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = landed(large, "star-edges")
        low = least(large, "star-small")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        edges = landed(small.distinct(), "star-edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fingerprint, root, component_id`` of every distinct fingerprint of ``doc_id, fingerprint``."""
    with scratch(marked.sparkSession):
        return materialise(_classes(marked, radius), "simhash-classes")


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    codes = landed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-codes")
    joined = stars(links(codes.select(F.col("fingerprint").alias("code")), radius))
    rooted = codes.join(joined.hint("merge"), codes["fingerprint"] == joined["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    rooted = landed(rooted, "simhash-roots")
    smallest = landed(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components")
    return rooted.join(smallest.hint("merge"), "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (long) and ``component_id`` of every row.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits, the row's
    own included. Null and empty texts have fingerprint 0 and are linked like any other. A null
    id is never smallest; a class of null ids alone has a null component. Rows that repeat an
    id are rows of their own. Other columns are not read; an empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, words, id_column, text_column), "simhash-fingerprints")
    return marked.join(classes(marked, radius).drop("root").hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
