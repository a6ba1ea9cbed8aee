"""A geocoder answer is parsed once a row."""

import io
from contextlib import redirect_stdout

from slopecast.functions import place_document, place_fields
from slopecast.plans import QUERIES


def test_answers_are_parsed_once(spark, tmp_path):
    spark.range(5).selectExpr("id AS c_custkey", "'n' AS c_name", "'s' AS c_mktsegment", "1 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    text = io.StringIO()
    with redirect_stdout(text):
        QUERIES["p19_place_fields"](spark, str(tmp_path)).explain()
    assert text.getvalue().count("from_json(") == 1


def test_parsed_answers_give_the_same_fields(spark):
    texts = ['{"address":{"village":"A","state":"S"}}', '{"name":"N","display_name":""}', "{}", "broken", None, '{"address":{"village":"","town":"T"}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    plain = df.select("i", *[c.alias(n) for n, c in place_fields("j", "Somewhere").items()])
    once = df.select("i", place_document("j").alias("d")).select("i", *[c.alias(n) for n, c in place_fields("d", "Somewhere", parsed=True).items()])
    assert sorted(plain.collect(), key=str) == sorted(once.collect(), key=str)
