"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of language detection: markers, and letters with what they add.
MARKERS = {
    "pl": [" oraz ", " jest ", " nie ", " przez ", " umow", " wykonawc", " zamawiaj", " zgodnie ", " który", " która", " będzie "],
    "en": [" and ", " is ", " not ", " shall ", " agreement ", " contractor ", " pursuant ", " which ", " with ", " from "],
    "de": [" und ", " ist ", " nicht ", " vertrag ", " auftrag", " gemäß ", " wird ", " welche", " durch ", " mit "],
    "fr": [" et ", " est ", " pas ", " contrat ", " conformément ", " sera ", " avec ", " pour ", " dans ", " laquelle "],
    "es": [" y ", " es ", " no ", " contrato ", " conforme ", " será ", " con ", " para ", " que ", " por "],
}
LETTERS = {"pl": ("ąćęłńóśźż", 5), "de": ("äöüß", 4), "fr": ("àâçéèêëîïôûùüÿœ", 3), "es": ("áéíñóúü¿¡", 3)}
#: Writing systems, the first one met counts.
SCRIPTS = [
    ("Cyrillic", "[Ѐ-ӿ]"), ("Greek", "[Ͱ-Ͽ]"), ("Arabic", "[؀-ۿ]"), ("Han", "[一-鿿]"),
    ("Japanese", "[぀-ヿ]"), ("Hangul", "[가-힯]"), ("Latin", "[A-Za-zÀ-ž]"),
]
#: Secrets that are seen in texts, and what stands in their place.
SECRETS = (
    (r"\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{12,}=*\b", "Bearer [REDACTED]"),
    (r"(?i)([a-z][a-z0-9+.-]*://[^:/\s]+:)[^@\s]+@", r"\1[REDACTED]@"),
)


def folded(text: Column) -> Column:
    """Lower case, white space runs as one space, a space at either end: what language markers are looked for in."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(" "))


def language_scores(low: Column) -> dict[str, Column]:
    """The score of each language; low is a column that holds what marked() found in a text."""
    out = {}
    for lang, markers in MARKERS.items():
        parts = [F.when(F.array_contains(low["words"], m.strip() if m.endswith(" ") else m), max(1.0, len(m.strip()) / 4)).otherwise(0.0) for m in markers]
        if lang in LETTERS:
            letters, bonus = LETTERS[lang]
            parts.append(F.when(low["letters"].rlike(f"[{letters}]"), float(bonus)).otherwise(0.0))
        out[lang] = reduce(lambda a, b: a + b, parts)
    return out


def marked(low: Column) -> Column:
    """What of a text bears on its language: the marker words it has, the markers that are beginnings of words (kept with
    their leading space), and its letters beyond ASCII. low is a column that holds folded() text, so that it is worked out once."""
    every = [m for markers in MARKERS.values() for m in markers]
    whole, starts = sorted({m.strip() for m in every if m.endswith(" ")}), [m for m in every if not m.endswith(" ")]
    words = F.array_intersect(F.split(low, " "), F.array(*map(F.lit, whole)))
    begun = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), m) for m in starts]))
    return F.struct(F.concat(words, begun).alias("words"), F.regexp_replace(low, r"[\x00-\x7F]+", "").alias("letters"))


def script(text: Column) -> Column:
    return reduce(lambda rest, s: F.when(text.rlike(s[1]), s[0]).otherwise(rest), reversed(SCRIPTS), F.lit("Unknown"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def tokens(text: Column, pattern: str = r"[\p{L}\p{N}_-]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def redacted(text: Column) -> Column:
    for pattern, instead in SECRETS:
        text = F.regexp_replace(text, pattern, instead.replace("\\1", "$1"))
    return F.when(F.length(text) > 4000, F.concat(F.substring(text, 1, 4000), F.lit("…[TRUNCATED]"))).otherwise(text)


def chunk_list(text: Column, size: int = 2000) -> Column:
    """Pieces of size characters; the empty text is one empty piece."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def hash_id(prefix: str, *parts: Column) -> Column:
    """A name made of its parts, of which missing ones are empty."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unaccent_table() -> tuple[str, str]:
    """Characters that fall into one other character and marks, with that character, by compatibility decomposition."""
    pairs = []
    for code in (*range(0xA0, 0x1100), *range(0x1200, 0xAC00), *range(0xF900, 0x10000)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c)[0] != "M")
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(text: Column) -> Column:
    """Letters without their accents, whatever the script; characters that fall into several stay as they are."""
    return F.regexp_replace(F.translate(text, *_unaccent_table()), r"\p{M}+", "")


def primary_language(text: Column) -> Column:
    """The language with the highest score, if that is 2 or more and 45 % or more of all scores, else und."""

    def best(found: Column) -> Column:
        scores = language_scores(found)
        top, total = F.greatest(*scores.values()), reduce(lambda a, b: a + b, scores.values())
        return F.when((top >= 2) & (top >= 0.45 * total), F.coalesce(*[F.when(c == top, name) for name, c in scores.items()])).otherwise("und")

    return F.transform(F.transform(F.array(folded(text)), marked), best)[0]
