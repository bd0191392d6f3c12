"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripleweave.llm import phrases, substrings, variants
from tripleweave.llm.words import BitTable, mix, rolled, sliding_min

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, lang string, text string, row string, runs int, key int, part int"


def odd(spark, rows):
    """Rows with extra columns under names the operators use inside."""
    return spark.createDataFrame([(d, g, t, f"r{i}", i, 7, 8) for i, (d, g, t) in enumerate(rows)], ODD).repartition(3)


def sample(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["Ab", "cé", "lon", "grü", "x"]) + rng.choice(["a", "bet", "über", "st"]) + rng.choice(["", "s", "ing"]) for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.4:
            words[:0] = passage[rng.randint(0, 5):]
        glue = [rng.choice([" ", "  ", "\t", "\n", ", ", ". "]) for _ in words]
        rows.append((i, rng.choice(["en", "de", None]), "".join(w + g for w, g in zip(words, glue))))
    return rows + [(n, "en", None), (n + 1, "en", ""), (n + 2, None, " \n\t ")]


def plain_repeats(rows, size):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: r[0]):
        words, hit, = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            hit.update(range(i, i + size) if window in seen else ())
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in hit)
        out.append((d, len(words), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [1, 3, 4, 7, 20])
def test_repeats_equal_plain_version(spark, size):
    rows = sample(size)
    got = substrings.digest(odd(spark, rows), size)
    assert sorted(map(tuple, got.collect())) == plain_repeats([(d, t) for d, _, t in rows], size)


def test_repeats_with_small_slices_and_hot_prefixes(spark, monkeypatch):
    rows = sample(5)
    monkeypatch.setattr(substrings, "SLICE", 500)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2000)
    want = plain_repeats([(d, t) for d, _, t in rows], 6)
    for limit in (100_000, 3):
        monkeypatch.setattr(substrings, "HOT_WINDOWS", limit)
        assert sorted(map(tuple, substrings.digest(odd(spark, rows), 6).collect())) == want
    monkeypatch.setattr(BitTable, "MOST", 16)
    monkeypatch.setattr(BitTable, "has", lambda self, h: np.ones(len(h), bool))  # a full table only costs work
    assert sorted(map(tuple, substrings.digest(odd(spark, rows), 6).collect())) == want


def test_repeats_of_one_word_and_very_long_texts(spark):
    rows = [(1, "en", "a " * 50), (2, "en", "b" * 200_000 + " " + "w " * 5000), (3, "en", "a " * 20)]
    got = substrings.digest(odd(spark, rows), 20)
    assert sorted(map(tuple, got.collect())) == plain_repeats([(d, t) for d, _, t in rows], 20)


def test_removed_texts_keep_other_columns_and_null_ids_come_last(spark):
    line = " ".join(f"w{i}" for i in range(25))
    rows = [(None, "en", line + " z"), (4, None, line), (4, None, line), (5, "x", None), (6, "x", "")]
    docs = odd(spark, rows)
    out = substrings.remove_word_repeats(docs)
    assert out.columns == docs.columns and out.count() == 5
    texts = {r["row"]: r["text"] for r in out.collect()}
    assert texts == {"r0": "z", "r1": line, "r2": line, "r3": None, "r4": ""}  # equal rows of one id are one document
    assert substrings.remove_word_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.find_repeats(docs, 0)


def plain_collocations(rows, least, top):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    count[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= f[p[i : i + m]]}
        found = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, i + 1, p, -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(2, 5), (3, 40), (1, 3), (6, 2000)])
def test_collocations_equal_plain_version(spark, least, top):
    rows = sample(least)
    got = phrases.collocations(odd(spark, rows), least, top)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(g, t) for _, g, t in rows], least, top)


def test_collocations_in_blocks(spark, monkeypatch):
    rows = sample(9)
    monkeypatch.setattr(phrases, "BLOCK", 40)
    monkeypatch.setattr(phrases, "SLICE", 700)
    got = phrases.collocations(odd(spark, rows), 3, 50)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(g, t) for _, g, t in rows], 3, 50)


def test_collocations_of_nothing(spark):
    docs = odd(spark, [(1, None, None), (2, "en", "., !")])
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_variants(rows, shortest, least):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: min(x, key=lambda v: (-words[v], v)) if x else None for w, x in close.items()}
    form = {w: f if f is not None and words[f] >= 2 * words[w] else None for w, f in form.items()}
    out = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, c, len(close[w]), form[w], words.get(form[w]), root))
    return sorted(out)


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("crowd", [50_000, 4])
def test_variants_equal_plain_version(spark, crowd):
    rng = random.Random(crowd)
    stems = ["banana", "übermass", "aaaaa", "abaaba", "lettres", "élève", "ÿþÿþÿ"]
    words = []
    for _ in range(700):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "é", ""])
        words += ["".join(w)] * rng.choice([1, 1, 2, 5])
    rows = [(i, None, " ".join(rng.sample(words, 300)) + " " + "Q" * 120) for i in range(4)] + [(None, "en", "banana Banana"), (9, "en", None)]
    got = variants.spelling_variants(odd(spark, rows), least=2, crowd=crowd).select(COLUMNS)
    want = plain_variants([(d, t) for d, _, t in rows], 5, 2)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60


def test_variants_of_nothing_and_short_words(spark):
    docs = odd(spark, [(1, "en", None), (2, "en", "abc 123")])
    assert variants.spelling_variants(docs).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(docs, shortest=3)


def test_minimised_acceptor_shares_endings(spark):
    words = sorted(["tapes", "taps", "tops", "topes", "t"])
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    a = variants.Acceptor(np.zeros(len(words), np.int64), points, np.array([len(w) for w in words]))
    assert len(a.final) == 6  # start, after t, after ta and to, after p, after e, end
    found = {(words[i], words[j], ins) for x, y, ins in variants.one_edit_pairs(a, np.array([99])) for i, j in zip(x, y)}
    assert found == {("tapes", "topes", False), ("taps", "tops", False), ("taps", "tapes", True), ("tops", "topes", True)}


def test_word_helpers():
    h = mix(np.arange(1, 90, dtype=np.uint64))
    for size in (1, 2, 3, 5, 17, 20):
        r = rolled(np.tile(h, 2), size)
        assert (r[:60] == r[89:149]).all() and len(set(r[:89].tolist())) == 89
        assert (sliding_min(h, size) == [h[i : i + size].min() for i in range(len(h) - size + 1)]).all()
