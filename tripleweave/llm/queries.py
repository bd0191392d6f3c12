"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import byte_bpe, chat, cws, decontaminate, line_dedup, near_dup, phrases, pii, repeats, substrings, token_files, toxicity, variants
from tripleweave.plans.rounds import new_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op2_minhash_near_dup")
def op2(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=80)


@query("op3_token_files")
def op3(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.token_offsets(spark, path)


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())


@query("op4_weighted_fingerprints")
def op4(spark, sf_dir):
    return cws.fingerprints(table(spark, sf_dir, "documents"))


@query(
    "op5_chat_format",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), marked AS (
        SELECT *, regexp_replace(role, '<(~*)\|', '<~\1|', 'g') AS r, regexp_replace(text, '<(~*)\|', '<~\1|', 'g') AS t FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('<|turn|>' || r || '<|says|>' || t || '<|done|>'))::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
    """.replace("\\\\", "\\"),
)
def op5(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    path = new_path(spark, "chat")
    chat.write_pieces(chat.render(chat.fold_events(chat.as_events(turns.unionAll(more)))), path)
    return chat.digest(chat.read_pieces(spark, path))


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")
    )


@query("op10_pii")
def op10(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op6_line_dedup")
def op6(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


@query("op8_repeated_passages")
def op8(spark, sf_dir):
    return repeats.digest(table(spark, sf_dir, "documents"))


@query(
    "op11_word_repeats",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
    firsts AS (SELECT g, min((doc_id, i)) AS f FROM windows GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM windows JOIN firsts USING (g) WHERE (doc_id, i) > f),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """.replace("\\\\", "\\"),
)
def op11(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"), size=20)


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query(
    "op12_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    sizes AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
    grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
        SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)),
    f AS (SELECT lang, phrase, any_value(m) AS m, count(*)::HUGEINT AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
    inner_ AS (SELECT DISTINCT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, f FROM (
        SELECT lang, string_split(phrase, ' ') AS ws, f, k, unnest(range(1, m - k + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS k) WHERE k < m)),
    stay AS (SELECT * FROM f WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = f.lang AND x.phrase = f.phrase AND 100 * x.f >= 100 * f.f)),
    cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM (
        SELECT lang, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM stay)),
    scored AS (SELECT c.lang, c.phrase, c.a, n, k, l.f AS l, r.f AS r, (1000 * c.a * n) // (l.f * r.f) AS score
        FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = rest JOIN sizes s ON s.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
    """.replace("\\\\", "\\"),
)
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
