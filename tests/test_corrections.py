"""Cases that were wrong once."""

from tripleweave.operators.links import discover_numeric_links
from tripleweave.operators.prepare import profile
from tripleweave.operators.reason import materialise


def test_deviation_of_large_numbers(spark):
    df = spark.range(1000).selectExpr("1000000000.0D + id % 2 AS x")
    assert abs(profile(df).first()["std"] - 0.50025) < 1e-4


def test_links_of_equal_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double")
    out = discover_numeric_links(df, df, "id", "id", ["x"], ["x"], 1.0, 1.0).collect()
    assert sorted((r["id_1"], r["id_2"]) for r in out) == [(1, 1), (2, 2)]


def test_a_literal_is_no_subject(spark):
    triples = [("urn:a", "urn:name", '"Ann"'), ("urn:name", "http://www.w3.org/2002/07/owl#inverseOf", "urn:nameOf")]
    closed = materialise(spark.createDataFrame(triples, "s string, p string, o string"))
    assert closed.where("startswith(s, '\"')").count() == 0
