"""Reading tables, texts, triples and labelled pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.plans.rounds import cut, row_numbers

# Fixed value: a control character stands for NULL, so that a quoted blank stays a blank.
NO_NULL = "\u0001"


def read_records(
    spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Header CSV, every column a string, blanks kept as ``''``.

    Without an explicit encoding each file is taken as UTF-8 unless that yields replacement
    characters, in which case this file is read as ISO-8859-1. ``multi_line`` allows line breaks
    in quotes, at the price of one task per file.
    """

    def load(enc: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", enc)
        reader = reader.option("inferSchema", False).option("nullValue", NO_NULL).option("escape", '"')
        return reader.option("multiLine", multi_line).csv(path)

    if encoding:
        return load(encoding).na.fill("")
    df, latin = load("UTF-8"), load("ISO-8859-1")
    broken = " or ".join(f"contains(`{c}`, '�')" for c in df.columns)
    names = [b if "�" in a else a for a, b in zip(df.columns, latin.columns, strict=True)]
    files = df.where(broken).select(F.col("_metadata.file_path").alias("_file")).distinct()
    if names == df.columns and files.isEmpty():
        return df.na.fill("")
    well = df.withColumn("_file", F.col("_metadata.file_path")).join(files, "_file", "left_anti")
    other = latin.withColumn("_file", F.col("_metadata.file_path")).join(files, "_file", "left_semi")
    return well.drop("_file").toDF(*names).unionAll(other.drop("_file").toDF(*names)).na.fill("")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a table comes in fewer files than there are cores.

    For tables whose rows are worked on at length (texts): one big file would otherwise be one
    task. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def cap_rows(df: DataFrame, cutoff: int | str | None, key: list[str]) -> DataFrame:
    """First ``cutoff`` rows in key order; no cap when it is not a positive number."""
    try:
        n = int(cutoff)
    except (TypeError, ValueError):
        return df
    return df.orderBy(*key).limit(n) if n > 0 else df


def with_key(df: DataFrame, key: str | None = None, start: int = 0) -> tuple[DataFrame, str]:
    """The table and its key column: the given one, ``id`` if generated, else the first."""
    if key is None:
        return df, df.columns[0]
    if key in df.columns:
        return df, key
    return row_numbers(df, key, start), key


def check_key(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, missing keys, and whether the column is a key."""
    out = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.col(key)).alias("distinct_keys"),
        F.count(F.when(F.col(key).isNull(), 1)).alias("missing"),
    )
    return out.withColumn("is_key", (F.col("missing") == 0) & (F.col("rows") == F.col("distinct_keys")))


def read_cells(spark: SparkSession, directory: str, sep: str = ",", glob: str = "*.csv") -> DataFrame:
    """All tables of a directory as cells ``(table, column, value)``, in one plan for any number of files.

    The headers may differ: the first line of each file is a row of a header table, which the lines meet by file. The files
    are read once as lines, to learn the widest header, and once as records of that width. Values a short record
    lacks are ``''``, values beyond its header are left out. A file that cannot be read, or has a header only, contributes no rows.
    """
    options = {"pathGlobFilter": glob, "recursiveFileLookup": True, "ignoreCorruptFiles": True}
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.options(**options).text(directory).select(F.col("_metadata.file_path").alias("table"), place.alias("at"), "value")
    first = lines.groupBy("table").agg(F.min(F.struct("at", "value")).alias("_f"))
    widest = first.agg(F.max(F.size(F.split("_f.value", f"\\Q{sep}\\E", -1)))).first()[0] or 0
    if not widest:
        return spark.createDataFrame([], "table string, column string, value string")
    names = [f"_c{i}" for i in range(widest)]
    reader = spark.read.options(**options).option("sep", sep).option("encoding", "UTF-8").option("nullValue", NO_NULL).option("escape", '"')
    records = reader.schema(", ".join(f"{n} string" for n in names)).csv(directory)
    records = cut(records.select(F.col("_metadata.file_path").alias("table"), place.alias("at"), F.array(*names).alias("fields")), "records")
    headers = records.groupBy("table").agg(F.min(F.struct("at", "fields")).alias("_h"))
    headers = headers.select("table", F.col("_h.at").alias("_first"), F.col("_h.fields").alias("names"))
    body = records.join(headers, "table").where(F.col("at") != F.col("_first"))
    cells = body.select("table", F.explode(F.arrays_zip("names", "fields")).alias("_c")).where("_c.names IS NOT NULL")
    return cells.select("table", F.col("_c.names").alias("column"), F.coalesce("_c.fields", F.lit("")).alias("value"))


def pairwise_tables(
    spark: SparkSession, left_dir: str, right_dir: str, matcher: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """One job for every (left file, right file) pair: the matcher gets the cells of both."""
    return matcher(read_cells(spark, left_dir), read_cells(spark, right_dir))


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """``(doc_id, text)`` with the file path as id."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


# --- triples ---------------------------------------------------------------------------

# The term patterns of the N-Triples format.
RESOURCE = r"(<[^<>\x00-\x20]*>|_:[^\s<>\"]+)"
LITERAL = r'"(.*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\x00-\x20]*)>)?'
TRIPLE = rf"^\s*{RESOURCE}\s*<([^<>\x00-\x20]*)>\s*(?:{RESOURCE}|{LITERAL})\s*\.\s*(?:#.*)?$"


def _resource(col: Column) -> Column:
    return F.regexp_replace(col, r"^<|>$", "")


def unescape_literal(col: Column) -> Column:
    """Decode the escapes of a literal; they are those of JSON, apart from two spellings."""
    plain = F.regexp_replace(col, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    plain = F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    doc = F.concat(F.lit('{"v":"'), plain, F.lit('"}'))
    return F.from_json(doc, "v string", {"allowUnquotedControlChars": "true"})["v"]


def escape_literal(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def parse_ntriples(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(s, p, o, o_is_literal, lang, datatype, malformed)``; blank and comment lines vanish."""
    text = F.col(col)
    part = lambda i: F.regexp_extract(text, TRIPLE, i)
    body = F.replace(F.replace(part(4), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    bad = ~text.rlike(TRIPLE) | F.contains(body, F.lit('"'))
    is_literal = part(3) == ""
    return lines.where(~text.rlike(r"^\s*(#.*)?$")).select(
        F.when(~bad, _resource(part(1))).alias("s"),
        F.when(~bad, part(2)).alias("p"),
        F.when(~bad, F.when(is_literal, unescape_literal(part(4))).otherwise(_resource(part(3)))).alias("o"),
        F.when(~bad, is_literal).alias("o_is_literal"),
        F.when(~bad, F.nullif(part(5), F.lit(""))).alias("lang"),
        F.when(~bad, F.nullif(part(6), F.lit(""))).alias("datatype"),
        bad.alias("malformed"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Facts of N-Triples files; count the ``malformed`` rows before dropping them."""
    return parse_ntriples(spark.read.text(path))


def format_ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per ``(s, p, o, o_is_literal)``."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    literal = F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'))
    obj = F.when(F.col("o_is_literal"), literal).otherwise(node("o"))
    return triples.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("value"))


def read_relation_files(spark: SparkSession, relations: str, attributes: str | None = None) -> DataFrame:
    """Tab-separated relation triples and attribute triples as ``(s, p, o, o_is_literal)``."""

    def load(path: str, literal: bool) -> DataFrame:
        parts = F.split("value", "\t", 3)
        return spark.read.text(path).select(
            parts[0].alias("s"), parts[1].alias("p"), parts[2].alias("o"), F.lit(literal).alias("o_is_literal")
        ).where("o IS NOT NULL")

    out = load(relations, False)
    return out.unionByName(load(attributes, True)) if attributes else out


def read_seed_alignment(spark: SparkSession, path: str) -> DataFrame:
    """``(e1, e2, score)`` from tab-separated lines; score 1.0 by default, the later line wins."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(
        F.get(parts, 0).alias("e1"), F.get(parts, 1).alias("e2"), F.get(parts, 2).try_cast("double").alias("score"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"),
    )
    last = lines.where("e2 IS NOT NULL").groupBy("e1", "e2").agg(F.max_by(F.coalesce("score", F.lit(1.0)), "_at").alias("score"))
    return last


def read_labelled_pairs(spark: SparkSession, path: str, record: str, multi_line: bool = True) -> DataFrame:
    """``(left, right, label)`` from ``{match: [...], distinct: [...]}`` documents.

    ``record`` is the DDL of a record; a pair is ``{"__class__", "__value__": [record, record]}``.
    """
    pair = f"array<struct<`__value__`: array<struct<{record}>>>>"
    docs = spark.read.schema(f"`match` {pair}, `distinct` {pair}").option("multiLine", multi_line).json(path)

    def side(name: str, label: int) -> DataFrame:
        return docs.select(F.explode(name).alias("p")).select(
            F.col("p.__value__")[0].alias("left"), F.col("p.__value__")[1].alias("right"), F.lit(label).alias("label")
        )

    return side("match", 1).unionByName(side("distinct", 0))
