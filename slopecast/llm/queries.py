"""The corpus operators on their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.session import shared_dir

from . import byte_bpe, decontaminate, language_id, license_scan, line_dedup, minmax, quality_rules, secret_scan, simhash, spelling, token_files, toxicity, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def joined_sha256(ids: str):
    """Lowercase hex SHA-256 of decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256)


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_sha256("ids").alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode(digests, BYTE_RANKS, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "token-files")
    token_files.write(docs, folder, WORD_BPE)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def of_kinds(*kinds: str):
    return F.filter("found", lambda s: s["kind"].isin(*kinds))


def joined_spans(kinds: tuple[str, ...]):
    return F.array_join(F.transform(of_kinds(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = secret_scan.KINDS[:3]
    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(secret_scan.KINDS).alias("spans"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents")).where(F.size("licenses") > 0)
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["name"], s["first_word"].cast("string"), s["last_word"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["name"])))
    return scanned.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("names"), F.array_join(spans, ",").alias("spans"))


@query(
    "op4_line_dedup",
    f"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT * FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
f AS (SELECT line, min((doc_id, line_no)) AS first, string_split(line, ' ') AS w FROM k GROUP BY line),
n AS (SELECT * FROM f WHERE len(w) >= {line_dedup.MIN_WORDS}),
d AS (SELECT line, first, w, unnest(range(1, len(w) + 1)) AS gap FROM n),
v AS (SELECT line, first, gap, list_concat(w[1:gap - 1], w[gap + 1:]) AS rest FROM d),
e AS (SELECT v.line FROM v JOIN (SELECT rest, gap, min(first) AS first FROM v GROUP BY rest, gap) g ON v.rest = g.rest AND v.gap = g.gap WHERE g.first < v.first
  UNION SELECT v.line FROM v JOIN n ON v.rest = n.w WHERE n.first < v.first
  UNION SELECT n.line FROM v JOIN n ON v.rest = n.w WHERE v.first < n.first),
r AS (SELECT k.doc_id, k.line_no FROM k JOIN f USING (line) WHERE (k.doc_id, k.line_no) <> f.first OR k.line IN (SELECT line FROM e))
SELECT l.doc_id, count(r.line_no) AS n_removed, coalesce(string_agg(r.line_no::VARCHAR, ',' ORDER BY r.line_no), '') AS removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE r.line_no IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.line_no = r.line_no GROUP BY l.doc_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return done.select(
        "row.doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def plain_words(text: str) -> str:
    """SQL for the words of ``decontaminate.words_of``."""
    marks = decontaminate.PUNCTUATION.replace("'", "''")
    blanks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"string_split_regex(trim(translate(translate(lower(coalesce({text}, '')), {blanks}, '     '), '{marks}', '')), ' +')"


@query(
    "op7_decontamination",
    f"""
WITH i AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {plain_words('text')} AS w FROM benchmark) WHERE len(w) >= {decontaminate.MIN_ITEM_WORDS}),
iw AS (SELECT item_id, n, generate_subscripts(w, 1) AS j, unnest(w) AS word FROM i),
dw AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM (SELECT doc_id, {plain_words('text')} AS w FROM documents)),
m AS (SELECT doc_id, item_id, n, p - j AS diagonal, j FROM dw JOIN iw USING (word)),
c AS (SELECT doc_id, item_id, n, diagonal FROM m GROUP BY ALL HAVING count(*) >= least({decontaminate.MATCHES}, n)),
s AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING) AS matched FROM m SEMI JOIN c USING (doc_id, item_id, diagonal))
SELECT doc_id, item_id, max(matched) AS matched FROM s WHERE matched >= CASE WHEN n >= {decontaminate.WINDOW} THEN {decontaminate.MATCHES} ELSE n END GROUP BY doc_id, item_id""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query(
    "op11_minmax",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS shingle FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))
