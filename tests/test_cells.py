"""Tables of a directory as cells."""

from tripleweave.sources.records import read_cells


def test_many_files_make_one_plan(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"t{i}.csv").write_text(f"a,b{i}\n{i},x\n" + ("y,\n" if i % 2 else ""))
    out = read_cells(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
    got = {(r["table"].rsplit("/", 1)[1], r["column"], r["value"]) for r in out.collect()}
    want = {(f"t{i}.csv", c, v) for i in range(120) for c, v in [("a", str(i)), (f"b{i}", "x")] + ([("a", "y"), (f"b{i}", "")] if i % 2 else [])}
    assert got == want


def test_uneven_records_quotes_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"n,m",k\n"1 ""q""",2,3\n4\n,\n')
    (tmp_path / "header.csv").write_text("only,names\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.txt").write_text("a\n1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "same.csv").write_text("k\nk\n")
    got = sorted((r["table"].rsplit("/", 1)[1], r["column"], r["value"]) for r in read_cells(spark, str(tmp_path)).collect())
    assert got == [("a.csv", "k", ""), ("a.csv", "k", ""), ("a.csv", "k", "2"), ("a.csv", "n,m", ""), ("a.csv", "n,m", '1 "q"'), ("a.csv", "n,m", "4"), ("same.csv", "k", "k")]


def test_directory_without_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert read_cells(spark, str(tmp_path)).count() == 0


def test_overlaps_are_the_same_listed_and_counted_and_long_tables_are_not_sent(spark, monkeypatch):
    import random

    from conftest import rows

    from tripleweave.operators import blocking as bl

    rng = random.Random(5)
    made = [[(i % 25 if i % 9 else None, " ".join(rng.sample("abcdefgh", rng.randint(0, 6)))) for i in range(30)] for _ in range(2)]
    a, b = [spark.createDataFrame(m, "id long, v string") for m in made]
    wanted = sorted(
        (x, y, len({*v.split()} & {*w.split()})) for x, v in made[0] for y, w in made[1] if None not in (x, y) and len({*v.split()} & {*w.split()}) >= 2
    )
    counted = bl.overlap_blocking(a, b, "id", "id", "v", "v", overlap_size=2)
    assert "FlatMapGroupsInArrow" in counted._jdf.queryExecution().executedPlan().toString()
    assert rows(counted) == wanted
    monkeypatch.setattr(bl, "FEW", 0)
    made = [[(i, f"w{i % 40} x{i % 40}") for i in range(n)] for n in (200, 90)]
    a, b = [spark.createDataFrame(m, "id long, v string") for m in made]
    listed = bl.overlap_blocking(a, b, "id", "id", "v", "v", overlap_size=2)
    assert "Broadcast" not in listed._jdf.queryExecution().executedPlan().toString()
    assert rows(listed) == sorted((i, j, 2) for i in range(200) for j in range(90) if i % 40 == j % 40)
