"""Defined results of every operator on odd rows and on empty tables."""

import hashlib

import pytest

import __spark_entry__  # noqa: F401  (path)
from tripleweave.llm import byte_bpe, chat, cws, decontaminate, line_dedup, near_dup, pii, repeats, token_files, toxicity
from tripleweave.llm.queries import split_pattern, tokenizer_file
from tripleweave.plans.rounds import new_path

EMPTY = hashlib.sha256(b"").hexdigest()
RANKS = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with names used inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20000))
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base + " more", None), (4, None, "b"), (5, "", "b"),
        (None, base, "c"), (6, long, "c"), (7, "x", "c"), (8, "first line here\nfirst line here\n\nother", "c"), (None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "'q' AS key", "1 AS row", "2 AS n", "'z' AS lid", "'z' AS item", "3 AS kept", "4L AS n_chars"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out


def test_decontaminate(spark, odd, none):
    item = " ".join(f"word{i}" for i in range(20, 35))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Other")], "item_id long, text string")
    r = by_id(decontaminate.digest(decontaminate.find_contamination(odd, bench)))
    assert r[1][0]["n_hit"] == 15 and len(r[2]) == 2 and r[3][0]["contaminated"]
    assert r[4][0]["n_words"] == 0 and r[8][0]["n_items"] == 1 and r[8][0]["n_hit"] == 1
    split = by_id(decontaminate.digest(decontaminate.find_contamination(odd, bench, block_words=10)))
    assert {k: len(v) for k, v in split.items()} == {k: len(v) for k, v in r.items()} and split[1] == r[1] and split[8] == r[8]
    assert not any(x["contaminated"] for v in by_id(decontaminate.digest(decontaminate.find_contamination(odd, bench.limit(0)))).values() for x in v)
    assert decontaminate.find_contamination(none, bench).count() == 0
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and {x["doc_id"] for x in left.collect()} == {None, 4, 5, 6, 7}
    cut = {x["doc_id"]: x["text"] for x in decontaminate.decontaminate(odd, bench, remove="spans").collect()}
    assert cut[1] == " ".join(f"word{i}" for i in range(20)) + "  " + " ".join(f"word{i}" for i in range(35, 60))


@pytest.mark.parametrize(("remove", "share"), [("documents", 0.0), ("documents", 0.3), ("spans", 0.0)])
def test_decontaminate_takes_a_benchmark_of_many_blocks(spark, odd, monkeypatch, remove, share):
    items = [(k, " ".join(f"word{i}" for i in range(k, k + 12))) for k in (5, 14, 40)] + [(9, "Other"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def rows():
        left = decontaminate.decontaminate(odd, bench, remove=remove, max_hit_share=share)
        assert left.columns == odd.columns
        return sorted(map(str, left.collect()))

    want = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    assert rows() == want


def test_near_dup(odd, none):
    r = by_id(near_dup.near_duplicates(odd, size=4))
    assert [x["component_id"] for x in r[1] + r[2] + r[3]] == [1] * 4 and r[1][0]["kept"] and not r[3][0]["kept"]
    assert r[4][0]["n_shingles"] == 0 and r[4][0]["kept"] and r[7][0]["n_shingles"] == 1
    assert near_dup.near_duplicates(none).count() == 0


def test_token_files(spark, odd, none):
    path = new_path(spark, "tokens")
    token_files.write_tokens(odd, path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    rows = sorted((x for v in by_id(token_files.token_offsets(spark, path)).values() for x in v), key=lambda x: x["start"])
    at = 0
    for x in rows:
        assert x["start"] == at
        at += x["n_tokens"]
    assert len(rows) == odd.count() and rows[0]["doc_id"] is None
    path = new_path(spark, "tokens")
    token_files.write_tokens(none, path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    assert token_files.token_offsets(spark, path).count() == 0


def test_fingerprints(odd, none):
    r = by_id(cws.fingerprints(odd))
    assert r[1][0]["fingerprint"] == r[2][0]["fingerprint"] and r[4][0]["fingerprint"] == ""
    assert r[4][0]["near_next"] == 1.0 and r[5][0]["near_next"] == 0.0 and r[1][0]["near_next"] == 1.0
    assert cws.fingerprints(none).count() == 0


def test_chat(spark):
    rows = [(1, None, "user", "a <|done|> <~|x"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, "<|")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = new_path(spark, "chat")
    chat.write_pieces(chat.render(chat.fold_events(chat.as_events(turns, 3))), path)
    r = {x["conv_id"]: x for x in chat.digest(chat.read_pieces(spark, path)).collect()}
    said = "user\na <|done|> <~|x\nassistant\n\nassistant\nb\nassistant\nb\n"
    assert r[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r[1]["loss_chars"] == 2
    assert r[None]["loss_sha256"] == EMPTY
    log = [(1, 1, 0, s, k, "assistant", t) for s, k, t in [(0, "start", ""), (1, "delta", "x"), (2, "regenerate", ""), (4, "delta", "c"), (3, "delta", "b"), (5, "edit", "e"), (6, "delta", "f")]]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, message long, turn long, seq long, kind string, role string, text string"))
    assert [x["text"] for x in folded.collect()] == ["ef"]


def test_line_dedup(odd, none):
    kept = {}
    for x in line_dedup.dedup_lines(odd).collect():
        kept.setdefault(x["doc_id"], []).append(x["text"])
    assert kept[8] == ["first line here\n\nother"] and kept[4] == [None] and kept[1] == [""] and kept[5] == [""]
    assert line_dedup.dedup_lines(odd).columns == odd.columns and line_dedup.digest(none).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(None, "A\nB"), (None, "C\nA"), (None, None), (7, "D\nE"), (7, "F\nD"), (7, "F\nD"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = by_id(line_dedup.dedup_lines(docs))
    lines = {i: sorted(x for r in left[i] for x in (r["text"] or "").split("\n") if x) for i in left}
    assert lines[None] == ["A", "B", "C"] and [r["text"] for v in left.values() for r in v].count(None) == 2
    assert lines[7] in (["D", "E", "F", "F"], ["D", "D", "E", "F", "F"]) and sum(len(v) for v in left.values()) == len(rows)
    counts = by_id(line_dedup.digest(docs))
    assert sorted((r["n_lines"], r["n_removed"]) for r in counts[None]) == [(0, 0), (2, 0), (2, 1)]
    # equal rows of one id are one document: what stays in one stays in both
    assert sorted((r["n_lines"], r["n_removed"]) for r in counts[7]) in ([(0, 0), (2, 0), (2, 1), (2, 1)], [(0, 0), (2, 0), (2, 0), (2, 1)])


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (4, 1), (6, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    scores = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= x["score"] <= 1 for x in scores)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_repeats(odd, none):
    r = by_id(repeats.digest(odd))
    assert r[1][0]["n_removed"] == 0 and r[2][0]["kept_sha256"] == EMPTY and len(r[2]) == 2
    assert r[3][0]["n_bytes"] - r[3][0]["n_removed"] == len(" more") and r[None][0]["n_removed"] == 0
    assert repeats.digest(none).count() == 0


def test_merged_transforms_give_the_intervals_of_a_full_sort():
    import random

    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 40))).encode() for _ in range(30)]
    owners = [rng.randint(0, 9) for _ in strings]
    old, repeats.SHARD_BYTES = repeats.SHARD_BYTES, 100
    try:
        found = repeats.least_owners(strings, owners, 6)
    finally:
        repeats.SHARD_BYTES = old
    least = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - 5):
            least[s[i : i + 6]] = min(least.get(s[i : i + 6], 99), o)
    assert [list(x) for x in found] == [[least[s[i : i + 6]] for i in range(len(s) - 5)] for s in strings]


def test_a_phrase_in_many_contexts_is_merged_in_bounded_collections(spark, monkeypatch):
    import random

    rng = random.Random(8)
    around = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(70)) for _ in range(24)]
    phrase = "a phrase of some forty bytes, found often"
    texts = [rng.choice(around)[rng.randint(0, 9) :] + phrase + rng.choice(around)[: rng.randint(40, 70)] for _ in range(240)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        windows = [t[k : k + 50] for k in range(len(t) - 49)]
        gone = {p for k, w in enumerate(windows) if w in seen for p in range(k, k + 50)}
        want[i] = "".join(c for p, c in enumerate(t) if p not in gone)
        seen.update(windows)
    limit, merge = 2000, repeats.least_owners

    def bounded(strings, owners, length):
        assert sum(map(len, strings)) < 3 * limit
        return merge(strings, owners, length)

    monkeypatch.setattr(repeats, "COLLECTION_BYTES", limit)
    monkeypatch.setattr(repeats, "least_owners", bounded)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs).collect()} == want


@pytest.mark.parametrize("text", ["", None, "a" * 3000, "é" * 50 + " the  the\n\n", "it's  42 naïve…"])
def test_bpe_equals_the_library(text):
    import base64

    import numpy as np
    import tiktoken

    with open(tokenizer_file(RANKS), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    want = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")
    bpe = byte_bpe.codec(data, split_pattern())
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want and bpe.decode(bpe.encode(text)) == (text or "").encode()


def test_bpe_rows(odd, none):
    assert byte_bpe.round_trip(odd, tokenizer_file(RANKS), split_pattern()).count() == odd.count()
    assert byte_bpe.round_trip(none, tokenizer_file(RANKS), split_pattern()).count() == 0


def test_pii(spark, odd, none):
    text = "mail a@b.c_d@e.f or 1.2.3.4.5.6.7.8, 999.1.1.1 card 4111 1111 1111 1111 tel +1 (415) 555-0100."
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    r = by_id(pii.digest(pii.find_pii(docs)))
    assert len(r[1]) == 2 and (r[1][0]["n_email"], r[1][0]["n_ip"], r[1][0]["n_card"], r[1][0]["n_phone"]) == (2, 2, 1, 1)
    assert r[2][0]["spans"] == "" and r[2][0]["base_sha256"] == EMPTY
    assert pii.digest(pii.find_pii(odd)).count() == odd.count() and pii.digest(pii.find_pii(none)).count() == 0


def test_long_secrets_are_whole_candidates(spark):
    secrets = ["0a1b2c3d" * 4, "0a1b2c3d" * 16, "sk-" + "Ab3_" * 30, "ghp_" + "x9" * 2000]
    docs = spark.createDataFrame([(i, f"api key {x} end") for i, x in enumerate(secrets)] + [(9, "0a1b2c3d" * 16 + "g")], "doc_id long, text string")
    found = [(r["doc_id"], r["start"], r["match"]) for r in pii.candidates(docs).where("kind = 'secret'").collect()]
    assert sorted(found) == [(i, 8, x) for i, x in enumerate(secrets)]
    spans = [(r["doc_id"], r["match"]) for r in pii.find_pii(docs).where("kind = 'secret'").collect()]
    assert sorted(spans) == list(enumerate(secrets))


def test_line_dedup_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    # one crowd of variants of a line, each with its own word; they link with one another, through chains or not at all
    for _ in range(90):
        parts = lines[0].split()
        for _ in range(rng.randint(1, 3)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        lines.append(" ".join(parts))
    texts = [(i, "\n".join(rng.choice(lines).replace(" ", rng.choice([" ", "  "])) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    at = {}
    for i, t in texts:
        for k, x in enumerate(line_dedup.norm_lines(t)):
            at.setdefault(x, []).append((i, k))
    names = list(at)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in names]
    root = list(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    groups = {}
    for x, r in zip(names, root, strict=True):
        groups.setdefault(r, []).extend(at[x])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(docs).collect()} == gone
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts}


def test_lines_of_a_crowd_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LISTED", 2)
    test_line_dedup_equals_brute_force(spark)
