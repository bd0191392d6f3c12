import json
import tempfile
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F
from tripleweave.functions import text as tx
from tripleweave.operators import extract as ex
from tripleweave.operators import linking as lk
from tripleweave.operators import matching as mt
from tripleweave.operators import mentions as mn
from tripleweave.operators import reason as rs
from tripleweave.operators import schema as sc
from tripleweave.sources import records as rd


def scratch() -> Path:
    return Path(tempfile.mkdtemp(prefix="run-"))


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_clean_value(spark):
    assert one(spark, " 'Crème-brûlée', a/b:c\n d' ", tx.clean_value) == "cremebrulee a b c d"
    assert one(spark, "\"Straße  Ælf\"", tx.clean_value) == "strasse aelf"
    assert one(spark, "-,'", tx.clean_value) is None
    assert one(spark, "$12.50", tx.parse_price) == 12.5
    assert one(spark, "Who Wrote It?", tx.normalise_question) == "who Wrote It"


def test_read_records_keeps_blanks_and_falls_back(spark):
    d = scratch()
    (d / "t.csv").write_bytes("id|name|x\n1|Caf\xe9|\n2|NA|\"\"\n".encode("iso-8859-1"))
    got = rows(rd.read_records(spark, str(d / "t.csv"), "|"))
    assert got == [("1", "Café", ""), ("2", "NA", "")]


def test_ntriples(spark):
    d = scratch()
    (d / "a.nt").write_text(
        '# comment\n<urn:a> <urn:p> "say \\"hi\\"\\n\\u00e9 \\\\" .\n_:b1 <urn:p> "chat"@fr .\n<urn:a> <urn:q> <urn:b> . # end\n'
        '<urn:a> <urn:n> "5"^^<urn:int> .\nnot a triple .\n\n'
    )
    got = {(r["s"], r["o"], r["lang"], r["datatype"]) for r in rd.read_ntriples(spark, str(d)).where("NOT malformed").collect()}
    assert got == {("urn:a", 'say "hi"\né \\', None, None), ("_:b1", "chat", "fr", None), ("urn:a", "urn:b", None, None), ("urn:a", "5", None, "urn:int")}
    assert rd.read_ntriples(spark, str(d)).where("malformed").count() == 1


def test_seed_alignment_last_line_wins(spark):
    d = scratch()
    (d / "seed.tsv").write_text("a\tx\t0.4\nb\ty\na\tx\t0.2\n")
    assert rows(rd.read_seed_alignment(spark, str(d))) == [("a", "x", 0.2), ("b", "y", 1.0)]


def test_labelled_pairs(spark):
    d = scratch()
    pair = lambda a, b: {"__class__": "tuple", "__value__": [{"unique_id": a, "price": None}, {"unique_id": b, "price": 2.0}]}
    (d / "t.json").write_text(json.dumps({"distinct": [pair("1", "2")], "match": [pair("3", "4"), pair("5", "6")]}))
    got = rd.read_labelled_pairs(spark, str(d), "unique_id string, price double").collect()
    assert sorted((r["left"]["unique_id"], r["right"]["unique_id"], r["label"]) for r in got) == [("1", "2", 0), ("3", "4", 1), ("5", "6", 1)]


def test_generated_key_counts_on(spark):
    df, key = rd.with_key(spark.range(10).repartition(3).withColumnRenamed("id", "v"), "id", start=5)
    assert sorted(r[key] for r in df.collect()) == list(range(5, 15))
    assert rd.check_key(df, key).first()["is_key"]


def plain_triples(text):
    out, subj, obj, rel, mode = [], "", "", "", "x"
    for t in text.replace("<s>", "").replace("<pad>", "").replace("</s>", "").split():
        if t in ("<triplet>", "<subj>"):
            if rel:
                out.append((subj.strip(), rel.strip(), obj.strip()))
            if t == "<triplet>":
                mode, subj, rel = "t", "", ""
            else:
                mode, obj = "s", ""
        elif t == "<obj>":
            mode, rel = "o", ""
        else:
            subj, obj, rel = subj + f" {t}" * (mode == "t"), obj + f" {t}" * (mode == "s"), rel + f" {t}" * (mode == "o")
    if subj and rel and obj:
        out.append((subj.strip(), rel.strip(), obj.strip()))
    return out


def test_linearised_triples(spark):
    texts = [
        "<s><triplet> a b <subj> c <obj> born in <subj> d <obj> q</s><pad>",
        "<triplet> a <subj> b <obj> r <subj> c <triplet> x <subj> y",
        "<triplet> a <subj> b", "noise <obj> r", "<triplet> a <subj> b <obj> r <subj> c <subj> d <obj> z",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, generated string")
    got = [tuple(r)[1:] for r in ex.parse_linearised_triples(df).orderBy("doc_id").collect()]
    assert sorted(got) == sorted(t for text in texts for t in plain_triples(text))


STOP = ["the", "of", "and", "is", "in", "a", "did", "name"]


def tokens(spark, *texts, verbs=()):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return mn.annotate_tokens(df, STOP, spark.createDataFrame([(v,) for v in verbs], "w string") if verbs else None)


def chunk_texts(df):
    return [(r["doc_id"], r["chunk"]) for r in df.orderBy("doc_id", "chunk_no").collect()]


def test_compounds(spark):
    got = chunk_texts(mn.chunk_compounds(tokens(spark, "the red car of big Bob", "just words here", "name of it")))
    assert got == [(0, "red car"), (0, "big Bob"), (1, "just"), (1, "words"), (1, "here"), (2, "name"), (2, "it")]


def test_split_rules(spark):
    toks = tokens(spark, "the king Bob's wife wrote taller NASA book in x", verbs=["wrote"])
    chunks, verbs = mn.split_on_verbs(mn.chunk_compounds(toks))
    assert [v["phrase"] for v in verbs.collect()] == ["wrote"]
    assert [c for _, c in chunk_texts(mn.split_possessive(chunks))] == ["king Bob", "wife", "taller NASA book", "x"]
    assert [c for _, c in chunk_texts(mn.split_on_comparison(chunks))] == ["king Bob's wife", "NASA book", "x"]
    assert [c for _, c in chunk_texts(mn.extract_abbreviations(chunks))] == ["king Bob's wife", "taller", "NASA", "book", "x"]


def test_merge_over_stopwords(spark):
    labels = spark.createDataFrame([("capital",), ("birth of place",)], "label string")

    def run(text):
        toks = tokens(spark, text)
        merged, rel = mn.merge_over_stopwords(mn.chunk_compounds(toks), toks, labels)
        return [c for _, c in chunk_texts(merged)], sorted(r["phrase"] for r in rel.collect())

    assert run("the lord of the rings") == (["lord of the rings"], [])
    assert run("the lord of the of rings") == (["lord", "rings"], [])
    assert run("the lord is rings") == (["lord", "rings"], [])
    assert run("the red lord and rings") == (["red lord", "rings"], [])
    assert run("the capital of France") == (["France"], ["capital"])
    assert run("a birth of place of Bob") == (["Bob"], ["birth of place"])


def test_person_determiner_case(spark):
    toks = tokens(spark, "the Barack Obama speech in the Beatles", verbs=["speech"])
    chunks = mn.chunk_compounds(toks)
    names = spark.createDataFrame([("Obama",)], "n string")
    split, rel = mn.split_on_person(chunks, names)
    assert [c for _, c in chunk_texts(split)] == ["Barack Obama", "speech", "Beatles"]
    assert [r["phrase"] for r in rel.collect()] == ["speech"]
    assert [c for _, c in chunk_texts(mn.merge_determiner(split, toks))] == ["The Barack Obama", "speech", "The Beatles"]
    assert [c for _, c in chunk_texts(mn.case_chunks(split))] == ["Barack obama", "speech", "Beatles"]


def test_spots_prefer_longer_and_do_not_overlap(spark):
    texts = spark.createDataFrame([(1, "new york city hall of new york")], "doc_id int, text string")
    surfaces = spark.createDataFrame([("new york",), ("york city hall",), ("hall",), ("new",)], "surface string")
    got = sorted((r["start"], r["length"], r["surface"]) for r in lk.spot_mentions(texts, surfaces).collect())
    assert got == [(0, 3, "new"), (4, 14, "york city hall"), (22, 8, "new york")]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,town\n1,München\n".encode())
    (tmp_path / "b.csv").write_bytes("id,town\n2,Köln\n".encode("latin-1"))
    assert sorted(rows(rd.read_records(spark, str(tmp_path)))) == [("1", "München"), ("2", "Köln")]


def test_long_labels_names_and_surfaces_are_found(spark):
    label = "beta gamma delta epsilon zeta eta theta"
    toks = tokens(spark, f"a {label} of Bob")
    merged, rel = mn.merge_over_stopwords(mn.chunk_compounds(toks), toks, spark.createDataFrame([(label,)], "label string"))
    assert [r["phrase"] for r in rel.collect()] == [label] and [c for _, c in chunk_texts(merged)] == ["Bob"]
    chunks = mn.chunk_compounds(tokens(spark, "the Anna Maria von der Leyen speech", verbs=["speech"]))
    split, _ = mn.split_on_person(chunks, spark.createDataFrame([("anna maria von der leyen",)], "n string"))
    assert "Anna Maria von der Leyen" in [c for _, c in chunk_texts(split)]
    texts = spark.createDataFrame([(1, "x one two three four five six y")], "doc_id int, text string")
    spots = lk.spot_mentions(texts, spark.createDataFrame([("one two three four five six",)], "surface string")).collect()
    assert [(r["start"], r["length"]) for r in spots] == [(2, 27)]
    assert lk.spot_mentions(texts, spark.createDataFrame([], "surface string")).count() == 0


def test_evaluate_matches(spark):
    pred = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.8), (3, 1, 0.7), (4, 9, 0.6)], "id_1 int, id_2 int, score double")
    truth = spark.createDataFrame([(1, 1), (2, 2), (5, 5)], "id_1 int, id_2 int")
    r = mt.evaluate_matches(pred, truth, (50,)).first()
    assert (r["precision"], r["precision_top_50"], round(r["recall"], 6), r["correct"]) == (0.5, 1.0, 0.666667, 2)


def test_closure(spark):
    t = [
        ("x", sc.RDF_TYPE, "A"), ("A", rs.SUB_CLASS, "B"), ("B", rs.SUB_CLASS, "C"), ("B", rs.SUB_CLASS, "A"),
        ("p", sc.RDF_TYPE, sc.OWL + "TransitiveProperty"), ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"),
        ("m", sc.RDF_TYPE, sc.OWL + "FunctionalProperty"), ("k", "m", "u"), ("k", "m", "v"), ("v", "q", "w"),
    ]
    got = set(rows(rs.materialise(spark.createDataFrame(t, "s string, p string, o string"))))
    assert {("x", sc.RDF_TYPE, "C"), ("a", "p", "d"), ("v", rs.SAME, "u"), ("u", "q", "w"), ("k", "m", "v")} <= got
    assert ("d", "p", "a") not in got
