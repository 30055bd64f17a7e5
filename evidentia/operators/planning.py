"""What a question asks for: intent, references, filters, the parts it falls into, and a standalone form of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import primary_language, unaccented
from .passages import TURNS, compacted

#: Exact references of a question.
REFERENCES = (
    r"(?iu)\b(?:article|art\.?|section|sec\.?|clause|annex|appendix|§|artykuł|rozdział)\s*[\w.-]+(?:\([\w.-]+\))*",
    r"\b[A-Z]{2,8}[-/]\d{2,}(?:[-/]\d+)*\b",
    r"(?iu)\b(?:NIP|VAT|KRS|REGON)\s*[:#]?\s*[A-Z0-9-]{6,}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?iu)\b[\w.+-]+@[\w.-]+\.[A-Z]{2,}\b",
    r"(?iu)\b(?:PLN|EUR|USD|GBP|CHF)\s*\d[\d .,]*(?:[.,]\d{2})?\b",
    r"(?iu)\b\d[\d .,]*(?:[.,]\d{2})?\s*(?:PLN|EUR|USD|GBP|CHF|zł|€|\$|£)\b",
    r"(?:[A-Za-z]:\\|/)[^\s\"'<>|]{3,}",
)
#: Names, quoted text, and the intents with what shows them, first match first.
ENTITY = r"\b(?:[\p{Lu}][\p{L}\p{M}'’-]+)(?:\s+[\p{Lu}][\p{L}\p{M}'’-]+){1,4}\b"
QUOTED = r"[\"“”„](.{2,160}?)[\"“”]"
INTENTS = (
    ("as_of", r"(?iu)\b(?:as of|on \d{4}-\d{2}-\d{2}|na dzień|według stanu na|zum stand)\b"),
    ("comparison", r"(?iu)\b(?:compare|difference|versus|vs\.?|porównaj|różnic|vergleich)\b"),
    ("diagnostic", r"(?iu)\b(?:diagnose|diagnosis|debug|root cause|why (?:does|did|is|was)|fail(?:s|ed|ure)?|error|exception|retry|workaround|napraw|błąd|awari|fehler|ursache)\b"),
    ("exact_reference", r"[\"“”„].+[\"“”]"),
    ("broad_synthesis", r"(?iu)\b(?:summarize|overview|across|all documents|podsumuj|przegląd|wszystkich dokument)\b"),
)
#: Where a comparison falls apart, and the words that only say that it is one.
APART = r"(?iu)\b(?:versus|vs\.?|compared with|compared to|and|oraz|kontra|gegenüber|und)\b"
COMPARING = r"(?iu)\b(?:compare|difference|same|porównaj|różnic|vergleich)\b"
#: Terms of the law with what they are called in other languages.
EXPANSIONS = {
    "termination": {"pl": ["wypowiedzenie", "rozwiązanie umowy"], "de": ["kündigung", "vertragsbeendigung"]},
    "wypowiedzenie": {"en": ["termination", "notice of termination"], "de": ["kündigung"]},
    "payment": {"pl": ["płatność", "zapłata"], "de": ["zahlung"]},
    "płatność": {"en": ["payment"], "de": ["zahlung"]},
    "liability": {"pl": ["odpowiedzialność"], "de": ["haftung"]},
    "odpowiedzialność": {"en": ["liability"], "de": ["haftung"]},
}
#: The eight variants of retrieval, each with the lanes that it fuses and the steps that follow. Scoped lanes
#: look in the routed documents, collection lanes in the routed collections, lazy asks for the sections that lack vectors.
_HYBRID = ("lexical", "exact", "dense")
_ROUTED = ("lexical_scoped", "exact", "lexical_collection", "dense_scoped", "dense_collection", "dense", "translated", "rerank")
VARIANTS = {
    "flat_dense_baseline": ("dense",),
    "lexical_only": ("lexical", "exact"),
    "dense_only": ("dense",),
    "hybrid_rrf": _HYBRID,
    "hybrid_translated": (*_HYBRID, "translated"),
    "hybrid_reranked": (*_HYBRID, "translated", "rerank"),
    "hierarchical": _ROUTED,
    "hierarchical_lazy": (*_ROUTED, "lazy"),
}
STEPS = ("rerank", "lazy")
#: Reasons of decomposed questions and of lexical variants, and what is added to questions.
REASONS = {
    "subject": "comparison subject decomposition", "coverage": "comparison entity coverage", "symptom": "diagnostic exact symptom", "cause": "diagnostic cause search",
    "remedy": "diagnostic remediation search", "drill": "broad synthesis entity drill-down", "reference": "exact-reference recovery", "entity": "entity recovery",
    "conflict": "conflict resolution across current authoritative sources", "evidence": "low-evidence recovery search", "folded": "diacritic-folded exact expansion",
    "term": "controlled legal terminology expansion for ",
}
ADDED = {"cause": " root cause", "remedy": " fix workaround resolution", "conflict": " current authoritative version effective date", "evidence": " supporting evidence explanation"}
#: Fixed values of conversation rewriting: what shows a follow-up, questions that are short, the label before the context, and lengths.
FOLLOW_UP = (
    r"(?iu)\b(?:it|that|this|those|these|there|then|same|older|newer|previous|former|latter|she|he|they|them|her|his|their|again|also|what about|how about|and what|a co|co z|tam|wtedy|starsz|nowsz"
    r"|poprzedn|ona|on|oni|sie|dasselbe|älter|neuer|vorher|sie|er)\b"
)
PLAIN_QUESTION, NAMED = r"^[?\p{L}\p{N}\s]+\?$", r"[A-Z][\p{L}\p{M}]{2,}"
SHORT_QUESTION, CONTEXT_LABEL, QUESTION_CHARS, CONTEXT_CHARS, REWRITTEN_CHARS = 8, "Conversation context needed to resolve references:", 1_200, 2_400, 3_200
#: Variants of a question that the translated lane looks for.
MOST_VARIANTS = 3


#: A word edge between ASCII word characters and all else, which the patterns mean by \\b; the JVM's own knows other letters too.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def edged(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def cleaned(text: Column, most: int) -> Column:
    """White space runs as one space, trimmed, so many characters at most."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def unique(values: Column) -> Column:
    """An array's distinct values in their order, trimmed, without blanks and nulls."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def references(question: Column) -> Column:
    return unique(F.concat(*[F.regexp_extract_all(question, F.lit(edged(p)), F.lit(0)) for p in REFERENCES]))


def quoted(question: Column) -> Column:
    return unique(F.regexp_extract_all(question, F.lit(QUOTED), F.lit(1)))


def entities(question: Column) -> Column:
    return unique(F.regexp_extract_all(question, F.lit(edged(ENTITY)), F.lit(0)))


def intent(question: Column, found: Column) -> Column:
    """The first intent that shows; found are the question's references, which show one of their own."""
    tests = [question.rlike(edged(p)) | (F.size(found) > 0 if name == "exact_reference" else F.lit(False)) for name, p in INTENTS]
    return reduce(lambda rest, k: F.when(tests[k], INTENTS[k][0]).otherwise(rest), reversed(range(len(INTENTS))), F.lit("fact_lookup"))


def filters(question: Column) -> Column:
    """The types and jurisdictions that a question states as type: x or type: "x y", as they are written, and its first ISO
    date as the day that it asks for."""

    def stated(word: str) -> Column:
        found = F.regexp_extract_all(question, F.lit(rf"(?iu){EDGE}{word}\s*:\s*(?:[\"'][^\"']+[\"']|[\p{{L}}\p{{N}}_.-]+)"), F.lit(0))
        return unique(F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(v, rf"(?iu)^{word}\s*:\s*", ""), "^[\"']|[\"']$", "")))

    day = F.nullif(F.regexp_extract(question, edged(r"\b(\d{4}-\d{2}-\d{2})\b"), 1), F.lit(""))
    return F.struct(stated("type").alias("types"), stated("jurisdiction").alias("jurisdictions"), day.alias("as_of"))


def decomposed(question: Column, kind: Column, refs: Column, names: Column) -> Column:
    """At most four further questions (query, reason), other than the question itself and each once."""
    item = lambda q, reason: F.struct(cleaned(q, 800).alias("query"), F.lit(reason).alias("reason"))
    each = lambda values, n, reason, make=lambda v: v: F.transform(F.slice(values, 1, n), lambda v: item(make(v), reason))
    parts = F.filter(F.transform(F.split(question, edged(APART)), lambda p: F.trim(F.regexp_replace(p, edged(COMPARING), ""))), lambda p: F.size(F.split(p, r"\s+")) >= 2)
    every = (
        F.when(kind == "comparison", F.concat(each(parts, 3, REASONS["subject"]), each(names, 3, REASONS["coverage"], lambda v: F.concat(v, F.lit(" "), question))))
        .when(kind == "diagnostic", F.concat(each(refs, 3, REASONS["symptom"]), F.array(item(F.concat(question, F.lit(ADDED["cause"])), REASONS["cause"]), item(F.concat(question, F.lit(ADDED["remedy"])), REASONS["remedy"]))))
        .when(kind == "broad_synthesis", each(names, 3, REASONS["drill"]))
        .otherwise(F.concat(each(refs, 3, REASONS["reference"]), each(names, 2, REASONS["entity"])))
    )
    asked = F.transform(every, lambda e: e["query"])
    first = F.filter(every, lambda e, i: (e["query"] != "") & (e["query"] != question) & (F.array_position(asked, e["query"]) == i + 1))
    return F.slice(first, 1, 4)


def planned(questions: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """id, query, references, quoted, entities, intent, filters and parts of every question: one pass, no shuffle."""
    q = questions.select(F.col(id_column).alias("id"), cleaned(F.coalesce(F.col(text), F.lit("")), 1200).alias("query"))
    found = q.select("*", references(F.col("query")).alias("references"), quoted(F.col("query")).alias("quoted"), entities(F.col("query")).alias("entities"), filters(F.col("query")).alias("filters"))
    known = found.withColumn("intent", intent(F.col("query"), F.col("references")))
    return known.withColumn("parts", decomposed(F.col("query"), F.col("intent"), F.col("references"), F.col("entities")))


def lexical_variants(question: Column) -> Column:
    """An array of (language, query, reason): the question without accents, if it has any, then for each known term in it the
    question with all that the term is called in another language, a variant a language."""
    plain = unaccented(question)
    variant = lambda lang, query, reason: F.struct(lang.alias("language"), query.alias("query"), F.lit(reason).alias("reason"))
    every = [F.when(plain != question, variant(primary_language(question), plain, REASONS["folded"]))]
    for term, by in EXPANSIONS.items():
        for lang, names in by.items():
            every.append(F.when(F.contains(F.lower(question), F.lit(term)), variant(F.lit(lang), F.concat(question, F.lit(" " + " ".join(names))), REASONS["term"] + term)))
    return F.array_compact(F.array(*every))


def translations(question: Column, most: int = MOST_VARIANTS) -> Column:
    """The queries of the translated lane: the first lexical variants."""
    return F.transform(F.slice(lexical_variants(question), 1, most), lambda v: v["query"])


def standalone(turns: DataFrame, group: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The last question of each conversation, and a form of it that stands alone: (group, question, query, method, turns_used).

    A question needs the conversation if there is one and it refers back (FOLLOW_UP), is short, or is a plain question
    without a name. It then gets the compacted turns before it, oldest first, as labelled context. Null texts are empty; a
    conversation without a question of the user gives no row; turns of one number are taken by role and text.
    """
    age = Window.partitionBy(group).orderBy(F.col(order).desc(), F.col("role").desc(), F.col(text).desc())
    rows = turns.select(group, order, "role", F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("_age", F.row_number().over(age))
    asked = rows.where(F.col("role") == "user").groupBy(group).agg(F.min_by(F.struct(cleaned(F.col(text), QUESTION_CHARS).alias("question"), "_age"), "_age").alias("q"))
    before = rows.join(asked.select(group, F.col("q._age").alias("_asked")), group).where(F.col("_age") > F.col("_asked")).where(F.col("_age") <= F.col("_asked") + TURNS)
    short = compacted(before.withColumn("_order", -F.col("_age")).drop("_age", "_asked"), group, "_order", text)
    line = F.struct("_order", F.concat("role", F.lit(": "), F.col(text)).alias("line"))
    context = short.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("context"), F.count("*").alias("n"))
    found = asked.select(group, "q.question").join(context, group, "left")
    question = F.col("question")
    refers = question.rlike(edged(FOLLOW_UP)) | (F.size(F.split(question, r"\s+")) <= SHORT_QUESTION) | (question.rlike(PLAIN_QUESTION) & ~question.rlike(NAMED))
    needs = F.col("n").isNotNull() & refers
    rewritten = cleaned(F.concat_ws("\n", question, F.lit(CONTEXT_LABEL), cleaned(F.col("context"), CONTEXT_CHARS)), REWRITTEN_CHARS)
    return found.select(
        group, "question", F.when(needs, rewritten).otherwise(question).alias("query"), F.when(needs, "deterministic").otherwise("identity").alias("method"), F.when(needs, F.col("n")).otherwise(0).cast("int").alias("turns_used")
    )
