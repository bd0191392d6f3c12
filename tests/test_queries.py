import pytest
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SMOKE = ["mb_wep", "match_cosine", "kg_subrelations", "rdf_validate", "lk_rerank", "schema_jaccard_fuzzy", "el_annotate", "down_sample"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SMOKE)
def test_smoke(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_sample_is_stable_under_repartitioning(spark):
    from tripleweave.operators.prepare import split_train_test

    df = spark.range(500)
    a = {r["id"] for r in split_train_test(df, ["id"], 0.3).where("part = 'train'").collect()}
    b = {r["id"] for r in split_train_test(df.repartition(7), ["id"], 0.3).where("part = 'train'").collect()}
    assert a == b and 100 < len(a) < 200
