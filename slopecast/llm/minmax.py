"""Near-duplicates by min-max hashing: banded signatures of minima and maxima, links confirmed on whole sets.

A text's set holds the hashes of its distinct word shingles. Each of ``PERMUTATIONS`` permutations is evaluated once
and gives two signature values, the set's minimum and its maximum under it, so a signature of 64 values
costs 32 evaluations; the share of equal values is an unbiased estimate of the Jaccard similarity.
Bands of ``BAND`` values propose pairs: two sets of similarity 0.8 share none of the 21 bands with a probability of
3e-7. Before whole sets are compared, pairs whose signatures agree in fewer than ``AGREE`` of 64 values are
dropped (at 0.8 with a probability of 1e-6), as are pairs whose sizes exclude the similarity.

Equal sets fold first. Three rounds confirm links and contract them. The first compares every member of a bucket
with its least one. The second goes through the buckets that still hold several classes and takes as leaders the
members that agree with most of a sample. The last compares every two members of different classes: signatures
alone tell which members have a likely pair, and only their whole sets are sent, once for a bucket, not for
each pair. A bucket of more than ``BUCKET`` members is first divided by a second band that a pair must share as
well (which a pair at 0.8 fails with a probability of 6e-6).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.session import materialise

from .common import id_and_text, landed, scratch, small_or_plain, texts
from .simhash import stars

WORDS, SEED = 4, 42
PERMUTATIONS, BAND = 32, 3
BANDS = 2 * PERMUTATIONS // BAND
#: Least Jaccard similarity, in percent.
LEAST = 80
#: Of the signature's 64 values, so many must agree before sets are compared.
AGREE = 36
#: Members of a bucket of several classes from which it is divided by a second band.
BUCKET = 2048
#: Members that others are held against when leaders are chosen, and leaders of a bucket. They decide the order of the work only.
JURY, LEADERS = 256, 8
#: Pairs that a task compares at once.
PAIRS_AT_ONCE = 1 << 16
_RANDOM = np.random.default_rng(SEED)
FLIPS = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, (2, PERMUTATIONS), dtype=np.uint64) | np.uint64(1)
HASHES_AT_ONCE = 1 << 13


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; with fewer words the whole sequence, without words none."""
    own = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not own:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(b" ".join(own), SEED)], np.uint64)
    shifted = [own[i : len(own) - words + 1 + i] for i in range(words)]
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*shifted)), np.uint64, len(own) - words + 1))


def signature(own: np.ndarray) -> np.ndarray:
    """The least value of a set under every permutation, then the greatest under every one."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(own), HASHES_AT_ONCE):
        x = (own[at : at + HASHES_AT_ONCE, None] ^ FLIPS) * FACTORS[0]
        x ^= x >> np.uint64(32)
        x *= FACTORS[1]
        low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One hash for each band, its number included. No band holds both values of a permutation."""
    raw = values[: BANDS * BAND].reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(raw)], np.uint64)


MARKED = "rid long, doc_id long, n long, digest binary, bands array<long>, sketch array<smallint>, own array<long>"


def marks(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of every row its number, id, set size, set digest, band hashes, signature and whole set.

    The signature is kept as 16 bits of each value, the band hashes are of whole values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches, 2):
            sets = [shingles(t, words) for t in values]
            signatures = [signature(s) for s in sets]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([band_keys(v).view(np.int64) if len(s) else [] for s, v in zip(sets, signatures)], pa.list_(pa.int64())),
                pa.array([(v >> np.uint64(48)).astype(np.uint16).view(np.int16) if len(s) else [] for s, v in zip(sets, signatures)], pa.list_(pa.int16())),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [c.split()[0] for c in MARKED.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, MARKED)


def fits(n: Column, m: Column) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= LEAST * F.greatest(n, m)


def confirmed(pairs: DataFrame, unique: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough.

    Signatures go first; then each whole set is sent once, and once more for each pair in which it is ``b``.
    """
    left = unique.select(F.col("rid").alias("a"), F.col("sketch").alias("x"))
    right = unique.select(F.col("rid").alias("b"), F.col("sketch").alias("y"))
    agreeing = F.size(F.filter(F.zip_with("x", "y", lambda u, v: u == v), lambda e: e)) >= AGREE
    alike = landed(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(agreeing).select("a", "b"), "minmax-alike")
    needed = small_or_plain(landed(alike.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "minmax-needed"))
    sets = marked.select("rid", "own").join(needed, "rid", "left_semi")
    left, right = sets.select(F.col("rid").alias("a"), F.col("own").alias("x")), sets.select(F.col("rid").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = 100 * both >= LEAST * (F.size("x") + F.size("y") - both)
    return landed(alike.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(similar).select("a", "b"), "minmax-links")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal signature values of every row of x with every row of y."""
    out = np.empty((len(x), len(y)), np.int16)
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), step):
        out[at : at + step] = (x[at : at + step, None, :] == y[None, :, :]).sum(axis=2, dtype=np.int16)
    return out


def likely(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where signatures and sizes leave the similarity possible."""
    return (agreeing >= AGREE) & (100 * np.minimum.outer(n, m) >= LEAST * np.maximum.outer(n, m))


def led(rid: np.ndarray, n: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a few leaders and the members of other classes that are likely to be linked to them."""
    jury = np.argsort(rid * np.int64(-7046029254386353131))[:JURY]  # as good as random, the same on every layout
    standing = (agreement(sketch, sketch[jury]) >= 64 * LEAST // 100).sum(axis=1)
    open_ = np.ones(len(rid), bool)
    for _ in range(LEADERS):
        if not open_.any():
            return
        leader = int(np.flatnonzero(open_)[np.argmax(standing[open_])])
        near = likely(agreement(sketch[leader : leader + 1], sketch), n[leader : leader + 1], n)[0]
        other = np.flatnonzero(near & (root != root[leader]))
        yield np.full(len(other), leader), other
        open_ &= ~near
        open_[leader] = False


def across(h: int, n: np.ndarray, root: np.ndarray, sketch: np.ndarray, bands: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all likely pairs of different classes; a pair that an earlier band also holds is left to that one."""
    kinds, sizes = np.unique(root, return_counts=True)
    rest = np.flatnonzero(root != kinds[np.argmax(sizes)])
    place = np.full(len(root), len(root))
    place[rest] = np.arange(len(rest))
    band = np.flatnonzero(bands[0] == h)  # none in a divided bucket
    step = max(1, PAIRS_AT_ONCE // len(root))
    for at in range(0, len(rest), step):
        own = rest[at : at + step]
        good = likely(agreement(sketch[own], sketch), n[own], n) & (root[own, None] != root) & (place[own, None] < place)
        a, b = np.nonzero(good)
        a = own[a]
        if len(band) and len(a):
            first = ~(bands[a, : band[0]] == bands[b, : band[0]]).any(axis=1)
            a, b = a[first], b[first]
        yield a, b


def held_against(a: np.ndarray, b: np.ndarray, own: pa.ListArray) -> np.ndarray:
    """Which of the pairs of places are similar enough, by their whole sets."""
    ends = np.cumsum(np.diff(own.offsets.to_numpy()))
    codes = np.unique(own.flatten().to_numpy(), return_inverse=True)[1]
    starts = np.append(0, ends[:-1])
    size = ends - starts
    marked = np.zeros(codes.max() + 1, bool)
    good = np.zeros(len(a), bool)
    for one in np.unique(a):
        at = np.flatnonzero(a == one)
        mine = codes[starts[one] : ends[one]]
        marked[mine] = True
        others = b[at]
        spread = np.repeat(starts[others] - np.append(0, np.cumsum(size[others])[:-1]), size[others]) + np.arange(size[others].sum())
        both = np.add.reduceat(marked[codes[spread]], np.append(0, np.cumsum(size[others])[:-1]), dtype=np.int64)
        good[at] = 100 * both >= LEAST * (size[one] + size[others] - both)
        marked[mine] = False
    return good


def by_bucket(members: DataFrame, made: Callable[[int, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``made`` gives for every bucket, of rows that begin with ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            h = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1), len(h)]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    if held and h[start] != last:
                        yield made(last, pa.Table.from_batches(held).combine_chunks())
                        held = []
                    last = h[start]
                    held.append(batch.slice(start, end - start))
        if held:
            yield made(last, pa.Table.from_batches(held).combine_chunks())

    return members.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def columns_of(bucket: pa.Table) -> tuple[np.ndarray, ...]:
    """``rid, n, root`` and the matrices of signatures and band hashes."""
    rid, n, root = (bucket.column(c).to_numpy() for c in ("rid", "n", "root"))
    return rid, n, root, *(bucket.column(c).combine_chunks().flatten().to_numpy().reshape(len(rid), -1) for c in ("sketch", "bands"))


def joined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = zip(*found) if (found := list(found)) else ((), ())
    return tuple(np.concatenate([np.empty(0, np.int64), *p]) for p in (a, b))


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def pairs_of_leaders(h: int, bucket: pa.Table) -> pa.RecordBatch:
    rid, n, root, sketch, _ = columns_of(bucket)
    a, b = joined(led(rid, n, root, sketch))
    return pair_batch(rid[a], rid[b])


def undecided(h: int, bucket: pa.Table) -> pa.RecordBatch:
    """The bucket's members that a likely pair of different classes needs."""
    rid, *rest = columns_of(bucket)
    own = rid[np.unique(np.concatenate(joined(across(h, *rest))))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), h)), pa.array(own)], ["h", "rid"])


def links_across(h: int, bucket: pa.Table) -> pa.RecordBatch:
    """The links of different classes in a bucket, by the whole sets of its undecided members."""
    rid, *rest = columns_of(bucket)
    a, b = joined(across(h, *rest))
    good = held_against(a, b, bucket.column("own").combine_chunks()) if len(a) else np.zeros(0, bool)
    return pair_batch(rid[a[good]], rid[b[good]])


def mixed_buckets(unique: DataFrame, roots: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """``h, rid, n, root, sketch, bands`` of the members of buckets of more than one class, and their rows without ``h``."""
    rooted = unique.join(small_or_plain(roots.select(F.col("node").alias("rid"), "root")), "rid", "left")
    rooted = rooted.select("rid", "n", F.coalesce("root", "rid").alias("root"), "sketch", "bands")

    def mixed(members: DataFrame) -> DataFrame:
        """Buckets of more than one class."""
        sized = members.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        return landed(sized.where("r0 < r1").select("h", "size"), "minmax-buckets")

    members = rooted.select(F.explode("bands").alias("h"), *rooted.columns)
    found = mixed(members.select("h", "root"))
    plain = members.join(small_or_plain(found.where(F.col("size") <= bucket).select("h")), "h")
    crowded = found.where(F.col("size") > bucket).select("h")
    if crowded.limit(1).count():
        further = F.explode(F.array_except("bands", F.array("h"))).alias("also")
        divided = members.join(small_or_plain(crowded), "h").select(further, "h", *rooted.columns)
        divided = divided.select(F.xxhash64(F.least("h", "also"), F.greatest("h", "also")).alias("h"), *rooted.columns).distinct()
        plain = plain.unionAll(divided.join(small_or_plain(mixed(divided.select("h", "root")).select("h")), "h"))
    return plain.select("h", *rooted.columns), rooted


def near_duplicates(
    docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``kept`` (the id is its class's) of every row.

    Sets of a Jaccard similarity of 0.8 or more are linked, ``component_id`` is the smallest id reachable, the
    row's own included. A text without words, null ones too, has an empty set and no link, so it stands for
    itself. A null id is never smallest; a class of null ids alone has a null component, and its rows are
    kept. Rows that repeat an id are rows of their own with equal sets or not. Other columns are not read; an
    empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        marked = landed(marks(id_and_text(docs, id_column, text_column), words), "minmax-marks")
        sets = landed(marked.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first")), "minmax-digests")
        unique = marked.join(small_or_plain(sets.select("rid")), "rid").select("rid", "n", "bands", "sketch")
        unique = landed(unique, "minmax-unique")

        keyed = unique.select(F.explode("bands").alias("h"), "rid", "n")
        least = keyed.groupBy("h").agg(F.min(F.struct("rid", "n")).alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1")
        least = small_or_plain(landed(least.select("h", "x"), "minmax-least"))
        tried = keyed.join(least, "h").where(F.expr("x.rid < rid") & fits(F.col("x.n"), F.col("n")))
        tried = landed(tried.select(F.col("x.rid").alias("a"), F.col("rid").alias("b")).distinct(), "minmax-tried")
        links = confirmed(tried, unique, marked)
        members, _ = mixed_buckets(unique, landed(stars(links), "minmax-roots"), bucket)
        more = by_bucket(members, pairs_of_leaders, "a long, b long").distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
        links = links.unionAll(confirmed(landed(more, "minmax-led"), unique, marked))

        members, rooted = mixed_buckets(unique, landed(stars(links), "minmax-roots"), bucket)
        open_ = landed(by_bucket(members, undecided, "h long, rid long"), "minmax-undecided")
        needed = small_or_plain(landed(open_.select("rid").distinct(), "minmax-needed"))
        whole = rooted.join(marked.select("rid", "own").join(needed, "rid", "left_semi"), "rid")
        whole = open_.join(whole.hint("merge"), "rid").select("h", *rooted.columns, "own")
        links = links.unionAll(landed(by_bucket(whole, links_across, "a long, b long").distinct(), "minmax-across"))
        roots = landed(stars(links), "minmax-roots")

        rooted = sets.join(roots.withColumnRenamed("node", "rid").hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        rooted = landed(rooted, "minmax-rooted")
        smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        component = landed(rooted.join(smallest, "root").select("digest", "component_id"), "minmax-components")
        rows = marked.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(small_or_plain(component, 200_000), "digest", "left")
        own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        rows = rows.select("doc_id", "n_shingles", own.alias("component_id"))
        return materialise(rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "minmax-classes")
