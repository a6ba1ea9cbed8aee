"""Benchmark decontamination: spaced-seed hashing of words, and substitution-tolerant verification.

A seed is a fixed mask over neighbouring words that reads some places and ignores the others. The
hashes of all seeds of all benchmark items meet those of every position of every text. Around each
hit the item is laid over the text, and a window of ``WINDOW`` item words, of which ``MATCHES`` are
equal at their places, proves an overlap. The two masks are such that any window with at most
three substituted words holds a hit of one of them, so none is missed.

Only DataFrame operations are used. Beyond a hit only the words travel that a window with the hit can
hold, from the item and from the text, so neither is copied whole. With a benchmark of up to ``SEED_ROWS``
seeds that carry up to ``SEED_BYTES`` of words, which are counted, its seeds are broadcast and texts are
neither shuffled nor stored: positions are unfolded, hashed, looked up and verified within one stage. Of a
larger benchmark only the hashes are broadcast, ``KEY_ROWS`` of them in each pass over the texts, and the
positions that meet one are shuffled to their seeds.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, landed

# 1 reads a word, 0 ignores it.
MASKS = ("11111", "110101001")
WINDOW, MATCHES = 15, 12
#: Items of fewer words are no evidence and have no seed.
MIN_ITEM_WORDS = 5
SEED_ROWS, SEED_BYTES, KEY_ROWS = 200_000, 64 << 20, 1_000_000
PUNCTUATION = ".,;:!?\"'()[]"


def words_of(text: Column) -> Column:
    """Words in lower case without common punctuation; null has none."""
    blanks = "\t\n\r\x0b\x0c"
    plain = F.translate(F.lower(text), blanks + PUNCTUATION, " " * len(blanks))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " ", -1), "")


def seed_keys(words: str, at: str) -> Column:
    """One hash for each mask that fits from place ``at``; null where it runs over the end."""
    keys = []
    for n, mask in enumerate(MASKS):
        read = [F.get(words, F.col(at) + i) for i, bit in enumerate(mask) if bit == "1"]
        keys.append(F.when(F.col(at) + len(mask) <= F.size(words), F.xxhash64(F.lit(n), *read)))
    return F.array(*keys)


def around(words: str, at: str, part: str, place: str) -> list[Column]:
    """The words that a window which holds place ``at`` can hold, and that place among them."""
    before = F.least(F.col(at), F.lit(WINDOW - 1))
    return [F.slice(words, F.col(at) - before + 1, before + WINDOW).alias(part), before.alias(place)]


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """``key, item_id, n, part, place`` of every seed of every item: its words, and those around the seed."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= MIN_ITEM_WORDS).distinct()
    placed = worded.select("item_id", "words", F.posexplode("words").alias("at", "word"))
    keyed = placed.select("item_id", F.size("words").alias("n"), *around("words", "at", "part", "place"), F.explode(seed_keys("words", "at")).alias("key"))
    return keyed.where("key IS NOT NULL").select("key", "item_id", "n", "part", "place")


def best_window() -> Column:
    """Most equal words in a window of the item that holds the place of the hit.

    ``n``, ``part`` and ``place`` are of the item's seed, ``near`` and ``near_place`` of the text. ``near`` is named twice, which
    keeps the optimizer from cutting it out of the text in here: whole texts would be copied to this step for each hit.
    """
    return F.expr(
        f"""
        transform(array(least({WINDOW}, n)), w ->
          transform(array(transform(sequence(0, size(part) - 1),
                    i -> CASE WHEN near_place - place + i < size(near) AND get(part, i) = get(near, near_place - place + i) THEN 1 ELSE 0 END)), same ->
            array_max(transform(sequence(0, greatest(0, size(same) - w)), s -> aggregate(slice(same, s + 1, w), 0, (a, x) -> a + x)))
          )[0])[0]
        """
    )


def overlaps(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed_rows: int = SEED_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """``doc_id, text_key, item_id, matched``: every text and item with a proven overlap, and its most equal words.

    ``items`` has ``item_id`` and ``text``. Items of fewer than ``WINDOW`` words must be there with all
    their words; items of fewer than ``MIN_ITEM_WORDS`` words overlap nothing. Null and empty texts overlap nothing; an empty benchmark gives no rows; rows that
    repeat an id and a text give one row; a null id is an id. Other columns are not read.
    """
    docs = id_and_text(docs, id_column, text_column)
    seeds = landed(benchmark_seeds(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))), "seeds")
    size = seeds.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.array_join("part", " ")) + 24 * F.size("part")).alias("bytes")).first()
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    # The outer form keeps the optimizer from splitting each text twice to skip empty ones first.
    placed = worded.select("doc_id", "text_key", "words", F.posexplode_outer("words").alias("at", "word")).drop("word")
    keyed = placed.select("doc_id", "text_key", "words", "at", F.explode(seed_keys("words", "at")).alias("key")).where("key IS NOT NULL")
    near = around("words", "at", "near", "near_place")
    if size.rows <= seed_rows and (size.bytes or 0) <= SEED_BYTES:
        hits = keyed.join(F.broadcast(seeds), "key").select("doc_id", "text_key", "item_id", "n", "part", "place", *near)
    else:
        keys = landed(seeds.select("key").distinct(), "seed-keys")
        passes, met = max(1, ceil(keys.count() / key_rows)), None
        for one in range(passes):
            own = keys.where(F.pmod("key", F.lit(passes)) == one)
            part = landed(keyed.join(F.broadcast(own), "key", "left_semi").select("key", "doc_id", "text_key", *near), "seed-hits")
            met = part if met is None else met.unionAll(part)
        hits = met.join(seeds, "key")
    # The bound follows the aggregate, so that the join keeps to compiled code.
    scored = hits.select("doc_id", "text_key", "item_id", "n", best_window().alias("matched"))
    best = scored.groupBy("doc_id", "text_key", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("n").alias("n"))
    return best.where(F.col("matched") >= F.when(F.col("n") >= WINDOW, F.lit(MATCHES)).otherwise(F.col("n"))).drop("n")
