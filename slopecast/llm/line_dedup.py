"""Line dedup: equal lines, and lines within one word of an earlier line, by a deletion-neighbourhood join.

Every line emits its variants within the bound: itself, and itself without one word, each as a
hashed key. Lines that meet in a key are candidates; the edit distance in words is then verified
on the texts. A line goes when an earlier line (by document id, then line number) is equal or
within the bound; the earliest stays.

Only DataFrame operations are used. Three things keep this linear for any data:

* Equal lines fold first, so variants are emitted once for a distinct line.
* Of two lines within one word, the longer of n words, either the first m or the last m words are
  equal for any m up to n / 2. A distinct line that shares neither its first nor its last m words
  with another distinct line has no partner and emits nothing.
* In a group of equal keys, a member needs only the earliest other member, never all pairs. All
  lines that lose the word at one position and are then equal differ in that word alone.
  All variants that equal an undiminished line are one insertion away from it.

Lines of fewer than ``MIN_WORDS`` words are only ever equal, since one word is too much of them.
Words are what single spaces part. Lines of white space are neither compared nor removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.session import materialise

from .common import id_and_text, landed, scratch, small_or_plain

MIN_WORDS = 8


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, line_no, line`` of every line that is not white space."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = given.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return each.where(F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "")


def line_hashes() -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def half_keys() -> Column:
    """Hashes of the first and the last m words; m is the power of two in (n/4, n/2], also that of n + 1 words."""
    m = "shiftleft(1, length(bin({n})) - 2)"
    keys = "xxhash64('first', {m}, substring_index(line, ' ', {m})), xxhash64('last', {m}, substring_index(line, ' ', -{m}))"
    own, next_ = (keys.format(m=m.format(n=n)) for n in ("n_words", "n_words + 1"))
    return F.expr(
        f"CASE WHEN n_words < {MIN_WORDS} THEN CAST(array() AS array<bigint>) "
        f"WHEN bit_count(n_words + 1) = 1 THEN array({own}, {next_}) ELSE array({own}) END"
    )


def variants(lines: DataFrame) -> DataFrame:
    """Keys of each line without the word at ``gap``, and of the whole line (``gap`` -1).

    A key combines the hashes of (place, word) by exclusive or, so all keys of a line come from
    running combinations: places before the gap as they are, those behind it one lower.
    """
    words = lines.select("h1", "h2", "doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("at", "word"))
    words = words.select("h1", "h2", "doc_id", "line_no", "at", F.xxhash64("at", "word").alias("here"), F.xxhash64(F.col("at") - 1, "word").alias("lower"))
    own = Window.partitionBy("h1", "h2").orderBy("at")
    before, to, whole = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    combined = words.select(
        "h1", "h2", "doc_id", "line_no", "at",
        F.coalesce(F.bit_xor("here").over(before), F.lit(0)).alias("head"),
        F.bit_xor("here").over(to).alias("full"),
        F.bit_xor("lower").over(to).alias("lower_to"),
        F.bit_xor("lower").over(whole).alias("lower_all"),
        F.max("at").over(whole).alias("last"),
    )
    tail = F.col("lower_all").bitwiseXOR(F.col("lower_to"))
    without = F.struct(F.col("head").bitwiseXOR(tail).alias("key"), F.col("last").alias("length"), F.col("at").alias("gap"))
    itself = F.struct(F.col("full").alias("key"), (F.col("last") + 1).alias("length"), F.lit(-1).alias("gap"))
    both = F.when(F.col("at") == F.col("last"), F.array(without, itself)).otherwise(F.array(without))
    return combined.select("h1", "h2", "doc_id", "line_no", F.explode(both).alias("v")).select("h1", "h2", "doc_id", "line_no", "v.*")


def candidates(keyed: DataFrame) -> DataFrame:
    """(line, earlier line) by hashes; a line has at most one earlier line for each of its keys and kinds of meeting."""
    place = F.struct("doc_id", "line_no", "h1", "h2")
    deleted, whole = F.col("gap") >= 0, F.col("gap") < 0
    one_word = keyed.where(deleted).groupBy("key", "length", "gap").agg(F.min(place).alias("first"), F.min("h1").alias("a"), F.max("h1").alias("b"))
    inserted = keyed.groupBy("key", "length").agg(F.min(F.when(whole, place)).alias("full"), F.min(F.when(deleted, place)).alias("first")).where("full IS NOT NULL AND first IS NOT NULL")
    one_word, inserted = landed(one_word.where("a <> b").drop("a", "b"), "line-groups"), landed(inserted, "line-groups")
    members = keyed.where(deleted)
    by_word = members.join(small_or_plain(one_word), ["key", "length", "gap"]).select(place.alias("line"), F.col("first").alias("earlier"))
    by_gap = members.join(small_or_plain(inserted.drop("first")), ["key", "length"]).select(place.alias("line"), F.col("full").alias("earlier"))
    longer_first = inserted.select(F.col("full").alias("line"), F.col("first").alias("earlier"))
    pairs = by_word.unionAll(by_gap).unionAll(longer_first).where("line > earlier")
    return pairs.select("line.h1", "line.h2", F.col("earlier.h1").alias("e1"), F.col("earlier.h2").alias("e2")).distinct()


def within_one_word(a: str, b: str) -> Column:
    """Edit distance in words of two arrays is at most one: what is not common at either end is one word at most."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    back = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x.eqNullSafe(y))
    longest = F.greatest(F.size(a), F.size(b))
    common = [F.when(F.array_position(x, F.lit(False)) == 0, longest).otherwise(F.array_position(x, F.lit(False)) - 1) for x in (same, back)]
    return common[0] + common[1] >= longest - 1


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Hashes of the distinct lines that are within one word of an earlier one."""
    keyed = distinct.select("h1", "h2", "doc_id", "line_no", F.explode("keys").alias("half"))
    shared = landed(keyed.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"), "line-halves")
    hopeful = landed(keyed.join(small_or_plain(shared), "half", "left_semi").select("h1", "h2", "doc_id", "line_no").distinct(), "line-hopeful")
    wanted = small_or_plain(hopeful.withColumnsRenamed({"doc_id": "d", "line_no": "n", "h1": "own", "h2": "other"}))
    met = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("n")) & (F.col("h1") == F.col("own")) & (F.col("h2") == F.col("other"))
    lines = numbered_lines(docs).select("doc_id", "line_no", "line", *line_hashes()).join(wanted, met)
    lines = landed(lines.select("h1", "h2", "doc_id", "line_no", "line").distinct(), "line-texts")
    pairs = candidates(landed(variants(lines), "line-variants"))
    text = lines.select("h1", "h2", F.split("line", " ", -1).alias("words"))
    earlier = text.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("earlier_words"))
    verified = pairs.join(text, ["h1", "h2"]).join(earlier, ["e1", "e2"]).where(within_one_word("words", "earlier_words"))
    return verified.select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_key, removed``: for each document that loses lines their numbers in order, from 0.

    The earliest line of equal or near lines stays; equal lines of one document count too. A null
    or empty text has no line to lose. Rows that repeat an id and a text share their places, so
    they lose the same lines. A null id comes before all others. Other columns are not read.
    """
    docs = id_and_text(docs, id_column, text_column)
    lines = numbered_lines(docs)
    counted = lines.withColumn("n_words", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    placed = landed(counted.select("doc_id", "text_key", "line_no", *line_hashes(), half_keys().alias("keys")), "line-places")
    place = F.struct("doc_id", "line_no", "keys")
    folded = placed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = landed(folded.select("h1", "h2", "first.*", "copies"), "line-distinct")
    near = landed(near_lines(distinct, docs), "line-near").withColumn("near", F.lit(True))
    marked = distinct.join(small_or_plain(near), ["h1", "h2"], "left").where("near OR copies > 1")
    marked = landed(marked.select("h1", "h2", F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"), F.coalesce("near", F.lit(False)).alias("near")), "line-marked")
    gone = placed.drop("keys").join(small_or_plain(marked), ["h1", "h2"])
    gone = gone.where(F.col("near") | ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without the lines of the sorted numbers: the runs between them, joined again."""
    lines = F.split(text, "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
    runs = F.transform(
        F.sequence(F.lit(0), F.size(removed)),
        lambda k: F.slice(lines, F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1),
    )
    return F.array_join(F.flatten(runs), "\n")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row`` (all columns as given, in one struct), ``removed`` (line numbers) and ``kept_text`` of every row.

    ``kept_text`` is null where the text is. A row without a removed line keeps its text as it is.
    """
    with scratch(docs.sparkSession):
        gone = materialise(removed_lines(docs, id_column, text_column), "line-removed")
    rows = docs.select(
        F.struct("*").alias("row"), docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"),
        F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit(""))).alias("text_key"),
    )
    gone = small_or_plain(gone.withColumnsRenamed({"doc_id": "of", "text_key": "key"}))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")), "left")
    none = F.expr("CAST(array() AS array<int>)")
    return joined.select("row", F.coalesce("removed", none).alias("removed"), F.when(F.col("removed").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("removed"))).alias("kept_text"))
