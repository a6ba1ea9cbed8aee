"""The corpus pipeline: each stage against brute force on its own input, and the odd rows through all of them."""

import hashlib

import corpus_pipeline
import duckdb
import pytest
from odd_rows import CLASHING, ODD_ROWS, passage
from test_lines import ITEMS, leaks, plain_dedup, plain_overlaps
from test_simhash import plain_classes, plain_fingerprint
from test_tokens import OWN

from slopecast.llm import language_id, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near duplicates", "benchmark", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_what_has_a_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = language_id.fit(docs)
    want = {r.doc_id for r in language_id.identify(docs, network).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    got = stage("language")(spark, docs, sf_dir)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
    assert len(want) >= 0.98 * docs.count()


def test_line_stage(spark, docs_of, folder):
    text = passage(1, 20)
    rows = [(1, text + "\n" + passage(2, 20)), (2, text), (3, passage(3, 12) + "\n\n" + text), (4, ""), (5, None), (6, "\n \n")]
    got = {r.doc_id: (r.text, r.n_chars) for r in stage("lines")(spark, docs_of(rows), folder).collect()}
    gone = plain_dedup(rows)
    kept = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in rows if i != 2}
    assert {i: t for i, (t, _) in got.items()} == kept
    assert all(n == len(t or "") for t, n in got.values())


def test_near_stage_keeps_one_of_each_group(spark, docs_of, folder):
    rows = [(n, passage(1, 150) + f" end{n % 2}") for n in range(9)] + [(20 + n, passage(2 + n, 40)) for n in range(9)]
    rows += [(30, passage(30, 40)), (30, passage(30, 40)), (30, passage(31, 40)), (None, passage(32, 40)), (None, passage(32, 40)), (None, passage(33, 40)), (None, passage(21, 40))]
    got = sorted((str(r.doc_id), r.text) for r in stage("near duplicates")(spark, docs_of(rows), folder).collect())
    groups = {}
    for (i, t), root in zip(rows, plain_classes([plain_fingerprint(t) for _, t in rows])):
        groups.setdefault(root, []).append((i is None, i or 0, t))
    want = [min(own) for own in groups.values()]
    assert sorted(i for i, _ in got) == sorted("None" if none else str(i) for none, i, _ in want)
    assert len({plain_fingerprint(t) for _, t in got}) == len(got) == len(groups)


def test_benchmark_stage(spark, docs_of, folder):
    got = {r.doc_id for r in stage("benchmark")(spark, docs_of(leaks()), folder).collect()}
    hit = {i for i, _, _ in plain_overlaps(leaks(), ITEMS)}
    assert got == {i for i, _ in leaks()} - hit and 1 in got and 2 not in got


def test_token_stage(spark, docs_of, folder):
    rows = [r for r in ODD_ROWS if r[0] is not None]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in stage("tokens")(spark, docs_of(rows), folder).collect())
    want = []
    for i, t in rows:
        ids = OWN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(spark, odd_docs, no_docs, folder, name):
    got = stage(name)(spark, odd_docs, folder)
    if name != "tokens":
        assert got.columns == odd_docs.columns
        assert all(set(r[c] for c in CLASHING) == {"clash"} for r in got.collect())
    assert got.count() > 0
    assert stage(name)(spark, no_docs, folder).count() == 0


def test_run_is_the_stages_in_turn(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, sf_dir)
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(str, (dict(sorted(zip(columns, r))) for r in cursor.fetchall())))
    assert sorted(str(dict(sorted(r.asDict().items()))) for r in queries.QUERIES[name](spark, sf_dir).collect()) == want
