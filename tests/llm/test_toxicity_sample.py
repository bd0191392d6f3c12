"""The bounded sample of labelled rows."""

import pytest
from tripleweave.llm import toxicity


def corpus(spark, copies=1):
    rows = [(i, ("vile hateful slur" if i % 2 else "kind warm greeting") + f" number{i}") for i in range(40)] * copies
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def examples(spark, monkeypatch):
    """The ids and labels of what a fit puts into the model."""
    monkeypatch.setattr(toxicity, "Model", lambda terms, idf, found, k, rate: found)

    def fit(docs, labels):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        return [(i, label) for i, label, _ in toxicity.fit(docs, table, max_examples=30)]

    return fit


def test_labels_without_a_document_take_no_place(spark, examples):
    known = [(i, i % 2) for i in range(40)]
    missing = [(1000 + i, i % 2) for i in range(500)]
    found = examples(corpus(spark), known)
    assert examples(corpus(spark), known + missing) == found and len(found) == 30 and all(i % 2 == label for i, label in found)


def test_repeated_rows_do_not_widen_the_sample(spark, examples):
    labels = [(i, i % 2) for i in range(40)]
    found = examples(corpus(spark, 20), labels)
    assert found == examples(corpus(spark), labels) and len(found) == 30
