"""A training corpus from raw documents: five stages, each written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of the documents that they keep. ``run`` applies them to the
``documents`` table. The last stage's rows are the tokenized documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.llm import byte_bpe, decontaminate, language_id, line_dedup, queries, simhash
from slopecast.llm.common import landed, prepare, scratch, small_or_plain, table
from slopecast.session import materialise, release, shared_dir

#: A document whose language is less probable than this is rejected, as is one without a letter.
LEAST_PROBABLE = 0.5


def packed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns as given, and the id and text under fixed names: safe from clashing names."""
    text = docs["text"].cast("string")
    return docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def less(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Packed documents without those of ``gone`` (``doc_id, text_key``); ids are compared null-safe."""
    gone = small_or_plain(gone.withColumnsRenamed({"doc_id": "of", "text_key": "key"}))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")), "left_anti")


def with_field(docs: DataFrame, name: str, value: Column) -> Column:
    """The packed row with one column replaced, in the type that it had."""
    return F.col("row").withField(f"`{name}`", value.cast(docs.schema[name].dataType))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a clear language; a null language is filled in.

    The network learns from the stage's own documents, as in the operator. With none to learn from
    no language is clear, and nothing stays.
    """
    prepare(spark)
    found = language_id.with_language(docs, language_id.fit(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_PROBABLE))
    row = with_field(docs, "lang", F.coalesce(F.col("row.lang").cast("string"), F.col("lang_pred")))
    return kept.select(row.alias("row")).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines, and their new length.

    A document that loses all its lines goes; one that had none, or has no text, stays as it is.
    """
    prepare(spark)
    done = line_dedup.deduplicate(docs)
    left = F.btrim("kept_text", F.lit(" \t\n\r\x0b\x0c")) != ""
    kept = done.where((F.size("removed") == 0) | left)
    row = with_field(docs, "text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size("removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text"))
        row = row.withField("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return kept.select(row.alias("row")).select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, a null id last.

    Groups are those of ``op2_simhash``: fingerprints of four-word shingles, linked at four bits or fewer.
    Rows that share that id are told apart by the hash of their texts. Rows that share both are one.
    """
    prepare(spark)
    given = packed(docs)
    with scratch(spark):
        marked = landed(simhash.fingerprints(given, extra=("text_key",)), "pipeline-fingerprints")
        groups = simhash.classes(marked).select("fingerprint", "root").hint("merge")
        rows = marked.groupBy("doc_id", "text_key", "fingerprint").agg(F.count(F.lit(1)).alias("n")).join(groups, "fingerprint")
        rows = landed(rows.select("root", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key").alias("place"), "n"), "pipeline-places")
        first = landed(rows.groupBy("root").agg(F.min("place").alias("first")), "pipeline-first").hint("merge")
        compared = rows.join(first, "root")
        gone = materialise(compared.where("place <> first").select("place.doc_id", "place.text_key").distinct(), "pipeline-gone")
        repeated = materialise(compared.where("place = first AND n > 1").select("place.doc_id", "place.text_key").distinct(), "pipeline-repeated")
    kept = less(given, gone)
    if repeated.limit(1).count() == 0:
        return kept.select("row.*")
    twice = repeated.withColumnsRenamed({"doc_id": "of", "text_key": "key"})
    one = kept.join(small_or_plain(twice), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")))
    one = one.groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return less(kept, repeated).select("row.*").unionAll(one.select("row.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return less(packed(docs), landed(found.select("doc_id", "text_key").distinct(), "pipeline-overlaps")).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their count and digest, and the digest of the decoded bytes."""
    prepare(spark)
    encoded = byte_bpe.encode(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), queries.joined_sha256("ids").alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode(digests.withColumn("again", F.col("ids")), queries.BYTE_RANKS, public_tokenizers.PATTERN, "again")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage before has been read for the last time
            release(spark, before)
        before = path
    return docs


#: A recurrent network and a tokenizer are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
