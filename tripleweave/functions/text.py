"""Column functions over strings: cleaning, tokens, q-grams, string similarity.

Everything here is a Column -> Column function built from JVM-side expressions, so it
stays inside the scan/project stage of whatever plan uses it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# Letters and marks that do not decompose but have a usual ASCII spelling.
ASCII_SPELLING = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D",
    "ı": "i", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--",
    "…": "...", " ": " ",
}


def latin_fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters to fold one-to-one (from, to) and the ones that need a longer spelling."""
    src, dst = [], []
    for code in range(0x00C0, 0x0250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and base.isascii():
            src.append(chr(code))
            dst.append(base)
    longer = {}
    for char, spelling in ASCII_SPELLING.items():
        if len(spelling) == 1:
            src.append(char)
            dst.append(spelling)
        else:
            longer[char] = spelling
    return "".join(src), "".join(dst), longer


def fold_accents(col: Column) -> Column:
    src, dst, longer = latin_fold_tables()
    out = F.translate(col, src, dst)
    for char, spelling in longer.items():
        out = F.replace(out, F.lit(char), F.lit(spelling))
    return out


def clean_value(col: Column) -> Column:
    """Comparable form of a field; a value with nothing left becomes NULL."""
    out = F.translate(fold_accents(col), "\n/:-',", "   ")
    out = F.regexp_replace(out, " {2,}", " ")
    for chars in (r"\s", '"', "'"):
        out = F.regexp_replace(out, f"^{chars}+|{chars}+$", "")
    return F.nullif(F.regexp_replace(F.lower(out), r"^\s+|\s+$", ""), F.lit(""))


def parse_price(col: Column) -> Column:
    """Number after a one-character currency sign; NULL when there is none."""
    return F.substring(col, 2, 1 << 20).try_cast("double")


def normalise_question(col: Column) -> Column:
    """Lower-case the first letter and drop the sentence marks."""
    lowered = F.concat(F.lower(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))
    return F.translate(lowered, "?.!\\#", "")


def words(col: Column) -> Column:
    """Lower-case words in text order, repeats kept."""
    return F.filter(F.split(F.lower(col), TOKEN_SPLIT), lambda t: t != "")


def tokens(col: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(words(col))


def qgrams(col: Column, q: int = 3) -> Column:
    """Character q-grams in order; a string shorter than q is its own gram."""
    # Shifted character arrays side by side: linear in the text, where one substring per
    # position would walk a long text from its start every time.
    chars = F.split(col, "")
    grams = chars
    for shift in range(1, q):
        grams = F.zip_with(grams, F.slice(chars, shift + 1, F.greatest(F.length(col), F.lit(1))), lambda a, b: F.concat(a, b))
    return (
        F.when(F.length(col) >= q, F.slice(grams, 1, F.length(col) - q + 1))
        .when(F.length(col) > 0, F.array(col))
        .otherwise(F.array().cast("array<string>"))
    )


def suffixes(col: Column, length: int) -> Column:
    """Suffixes of at least the given length."""
    return F.when(
        F.length(col) >= length,
        F.transform(F.sequence(F.lit(1), F.length(col) - length + 1), lambda i: F.substring(col, i, F.length(col))),
    ).otherwise(F.array().cast("array<string>"))


def substrings(col: Column, length: int) -> Column:
    """Distinct substrings of at least the given length."""
    starts = F.sequence(F.lit(1), F.length(col) - length + 1)
    cut = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(F.sequence(F.lit(length), F.length(col) - i + 1), lambda n: F.substring(col, i, n)),
        )
    )
    return F.when(F.length(col) >= length, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def set_dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def set_cosine(a: Column, b: Column) -> Column:
    product = F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))
    return F.when(product > 0, F.size(F.array_intersect(a, b)) / F.sqrt(product.cast("double"))).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).when(longest == 0, F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, summed in element order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def local_name(iri: Column) -> Column:
    """Last part of an IRI after '/' or '#'."""
    return F.regexp_extract(iri, r"([^/#]*)$", 1)
