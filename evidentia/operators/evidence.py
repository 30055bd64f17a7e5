"""What becomes of ranked hits: federation, reranking, greedy diversity, answerability; and the small indexes beside the lanes."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .retrieval import RRF_K

# Words that tell a claim from its denial, words that a fact is not found by, and their spellings.
POSITIVE = ("must", "required", "supported", "enabled", "allowed", "applies", "shall", "yes", "wymaga", "dozwolon", "obowiązuje", "aktiviert", "zulässig")
NEGATIVE = (
    "must not", "not required", "unsupported", "disabled", "prohibited", "does not apply", "shall not", "no", "nie wolno", "zabronion", "nie obowiązuje",
    "deaktiviert", "unzulässig",
)
STOP_WORDS = (
    "a an and are as at be but by do does for from has have how i in is it its me my of on or our please tell that the their this to what when where which "
    "who why with you your"
).split()
PRONOUNS = ("user", "users", "user's", "my", "mine", "me")
STEM, FACT_THRESHOLD, FACT_LIMIT = 5, 0.35, 5
VECTOR_DIMENSIONS = 384
DOCUMENT_CAP, SECTION_CAP, NEAR, LEAST_WORDS = 8, 4, 0.92, 8
EXCLUDED = {
    "budget": "evidence budget reached",
    "hash": "duplicate content hash",
    "near": "near-duplicate passage",
    "document": "maximum passages per document",
    "section": "maximum passages per section",
}


def federated(responses: list[DataFrame], limit: int = 50) -> DataFrame:
    """Rank fusion over sources: rows (workspace_id, source_id, id, rank) of each response, a hit's key being all three; best first."""
    key = ["workspace_id", "source_id", "id"]
    union = reduce(DataFrame.unionByName, [r.select(*key, "rank") for r in responses])
    scored = union.groupBy(*key).agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id", "source_id", "workspace_id").limit(max(1, min(50, limit)))


def reranked(hits: DataFrame, scores: DataFrame, first: int = 100) -> DataFrame:
    """hits (id, rank) with new_rank: the first so many by outside scores (id, score; missing is zero), ties and the rest as they were."""
    best = scores.groupBy("id").agg(F.max("score").alias("_s"))
    front = hits.where(F.col("rank") <= first).orderBy("rank").limit(first).join(best, "id", "left")
    order = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("_s", F.lit(0.0)).desc(), "rank")  # over first rows at most
    return front.withColumn("new_rank", F.row_number().over(order)).drop("_s").unionByName(hits.where(F.col("rank") > first).withColumn("new_rank", F.col("rank").cast("int")))


def _word_set(text: str, most: int | None) -> frozenset:
    found = regex.findall(r"[\p{L}\p{N}]{2,}", text.lower())
    return frozenset(found if most is None else found[:most])


def _close(a: frozenset, b: frozenset) -> bool:
    shared = len(a & b)
    return min(len(a), len(b)) >= LEAST_WORDS and shared >= NEAR * (len(a) + len(b) - shared)


def diversified(hits: DataFrame, limit: int, words: int | None = 1000) -> DataFrame:
    """For each hit whether evidence keeps it, and if not why: columns query_id, id, rank, kept, exclusion.

    hits has query_id, id, rank, document_id, section_id, text. Hits are taken best first; one is left out past the limit, as a
    copy or near copy (Jaccard 0.92 of the first so many words, eight words at least) of one kept, or when its document
    or section is full. A query's hits are a fused list, which its cut bounds, and so one group. Null texts are empty; a
    hit without a section counts for its document.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        chosen: list[frozenset] = []
        copies: set[str] = set()
        filled: dict[tuple, int] = {}
        verdicts = []
        for row in group.sort_values(["rank", "id"]).itertuples():
            text = row.text if isinstance(row.text, str) else ""
            section = row.document_id if pd.isna(row.section_id) else row.section_id
            bag, places = _word_set(text, words), (("document", row.document_id, DOCUMENT_CAP), ("section", section, SECTION_CAP))
            full = [kind for kind, name, cap in places if filled.get((kind, name), 0) >= cap]
            tests = {"budget": len(chosen) >= limit, "hash": text in copies, "near": any(_close(bag, c) for c in chosen)} | dict.fromkeys(full, True)
            why = next((k for k, hit in tests.items() if hit), None)
            if why is None:
                chosen.append(bag)
                copies.add(text)
                for kind, name, _ in places:
                    filled[kind, name] = filled.get((kind, name), 0) + 1
            verdicts.append((row.query_id, row.id, row.rank, why is None, EXCLUDED.get(why)))
        return pd.DataFrame(verdicts, columns=["query_id", "id", "rank", "kept", "exclusion"])

    kinds = dict(hits.dtypes)
    return hits.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, id {kinds['id']}, rank {kinds['rank']}, kept boolean, exclusion string")


def polarity_pattern(words: tuple[str, ...]) -> str:
    return f"(?:^|[^A-Za-z0-9_])(?:{'|'.join(words)})(?:$|[^A-Za-z0-9_])"


def polarity(text: Column) -> tuple[Column, Column]:
    """Whether a text claims something, and whether it denies something."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(polarity_pattern(POSITIVE)).alias("positive"), low.rlike(polarity_pattern(NEGATIVE)).alias("negative")


def answerability(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, status, score and abstained of each question (query_id, intent).

    evidence has query_id, rank, document_id, section_id, exact, positive, negative. Comparisons and diagnoses need two
    passages, an exact reference one that its lane found, a comparison two documents or sections. Polarity conflicts
    count among the first thirty passages of two documents or more. A question without evidence abstains with score 0.
    """
    top = F.col("rank") <= 30
    found = evidence.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_distinct("document_id").alias("docs"), F.count_distinct(F.coalesce(F.col("section_id").cast("string"), F.lit(""))).alias("sections"),
        F.coalesce(F.bool_or("exact"), F.lit(False)).alias("exact"), (F.bool_or(top & F.col("positive")) & F.bool_or(top & F.col("negative"))).alias("both"),
    )
    joined, intent = questions.select("query_id", "intent").join(found, "query_id", "left"), F.col("intent")
    n = F.coalesce("n", F.lit(0))
    need = F.when(intent.isin("comparison", "diagnostic"), 2).otherwise(1)
    short = (n < need) | ((intent == "exact_reference") & ~F.col("exact")) | ((intent == "comparison") & (F.col("docs") < 2) & (F.col("sections") < 2))
    lacking, conflict = F.coalesce(short, F.lit(False)), F.coalesce((F.col("docs") >= 2) & F.col("both"), F.lit(False))
    return joined.select(
        "query_id",
        F.when(lacking, "insufficient").when(conflict, "conflicting").otherwise("sufficient").alias("status"),
        F.round(F.when(lacking, F.least(F.lit(0.49), n / need * 0.49)).when(conflict, 0.65).otherwise(F.least(F.lit(1.0), 0.75 + n * 0.05)), 6).alias("score"),
        lacking.alias("abstained"),
    )


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition; ł has none and is named."""
    bases = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)} | {"ł": "l"}
    pairs = [(a, b) for a, b in bases.items() if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fact_text(text: Column) -> Column:
    """A fact or question in lower case, accents folded, the first person made the user."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_fold_table())
    return F.regexp_replace(F.regexp_replace(folded, "[̀-ͯ]", ""), rf"\b({'|'.join(PRONOUNS)})\b", " user ")


def fact_stems(text: Column) -> Column:
    """The distinct words of a fact, without stop words and single letters, cut to their stem."""
    words = F.regexp_extract_all(fact_text(text), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, STEM)))


def stems_of(text: str) -> list[str]:
    """fact_stems() of a text at hand."""
    low = regex.sub("[\u0300-\u036f]", "", text.lower().translate(str.maketrans(*_fold_table())))
    words = regex.findall("[a-z0-9]+", regex.sub(rf"\b({'|'.join(PRONOUNS)})\b", " user ", low))
    return list(dict.fromkeys(w[:STEM] for w in words if len(w) > 1 and w not in STOP_WORDS))


def recalled(facts: DataFrame, question: str, threshold: float = FACT_THRESHOLD, limit: int = FACT_LIMIT) -> DataFrame:
    """The facts (id, fact, created_at) that a question recalls: id, score, best first, newest first among equals, copies once.

    A stem weighs ln((N + 1) / (1 + facts with it)) + 1. A fact scores the weight of shared stems over its own or the
    question's known weight, whichever is more, if two stems are shared or one that no other fact has.
    """
    total = facts.agg(F.count("*").alias("total"))
    asked = stems_of(question)
    stems = facts.select("id", F.explode(fact_stems(F.col("fact"))).alias("stem"))
    weighed = stems.groupBy("stem").agg(F.count("*").alias("df")).join(F.broadcast(total)).withColumn("w", F.log((F.col("total") + 1) / (1 + F.col("df"))) + 1).drop("total")
    known = weighed.where(F.col("stem").isin(asked)).agg(F.sum("w").alias("known")).where("known > 0")  # one row, or none
    hit = F.col("stem").isin(asked)
    sums = stems.join(weighed, "stem").groupBy("id").agg(
        F.sum("w").alias("own"), F.sum(F.when(hit, F.col("w"))).alias("shared"), F.count_if(hit).alias("hits"),
        F.bool_or(hit & (F.col("df") <= 1) & (F.length("stem") >= STEM)).alias("rare"),
    )
    scored = sums.where("hits >= 2 or rare").select("id", "shared", "own").join(F.broadcast(known)).select("id", F.round(F.col("shared") / F.least("own", "known"), 9).alias("score")).where(F.col("score") >= threshold)
    key = F.trim(F.regexp_replace(fact_text(F.col("fact")), "[^a-z0-9]+", " "))
    order = F.struct("score", "created_at", "id")
    best = scored.join(facts, "id").groupBy(key.alias("_key")).agg(F.max(order).alias("best"))
    return best.select("best.*").orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(limit).select("id", "score")


def merged(entries: DataFrame, limit: int = 12) -> DataFrame:
    """Entries (type, uuid, content, confidence, ordinal) by confidence and source boost, each type, uuid and content once, ordinal breaking ties."""
    boost = F.when(F.col("type") == "mem0", 2).when(F.col("type") == "file-index", 1).otherwise(0)
    scored = entries.withColumn("score", F.coalesce("confidence", F.lit(0.0)) + boost)
    best = scored.groupBy("type", "uuid", "content").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("_at"))).alias("b"))
    out = best.select("type", "uuid", "content", F.col("b.score").alias("score"), (-F.col("b._at")).alias("ordinal"))
    return out.orderBy(F.col("score").desc(), "ordinal").limit(limit)


def looked_up(entries: DataFrame, terms: list[str], share: float = 0.5) -> DataFrame:
    """Entries (id, content) by how often they hold the terms, best first until they hold a share of all occurrences: id, score.

    Running sums go over the histogram of scores; only entries of the score at which the share is met are numbered.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    score = sum(((F.length(low) - F.length(F.replace(low, F.lit(t.lower())))) / len(t) for t in terms if t), F.lit(0)).cast("long")
    scored = entries.select("id", score.alias("score")).where("score > 0")
    histogram = scored.groupBy("score").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    mass = F.col("score") * F.col("n")
    edge = (
        histogram.withColumn("upto", F.sum(mass).over(w.orderBy(F.col("score").desc()))).withColumn("goal", share * F.sum(mass).over(w))
        .where("upto >= goal").orderBy(F.col("score").desc()).first()
    )
    if edge is None:
        return scored
    missing = math.ceil((edge.goal - (edge.upto - edge.score * edge.n)) / edge.score)
    ties = scored.where(F.col("score") == edge.score).orderBy("id").limit(max(1, missing))
    return scored.where(F.col("score") > edge.score).unionByName(ties)


def file_search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Chunks (id, path, content) by two points for each term in the content and three for each in the path: id, score."""
    terms = [t for t in regex.split(r"[^a-z0-9_.:\\-]+", query.lower()) if t]
    content, path = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    score = sum((F.contains(content, F.lit(t)).cast("int") * 2 + F.contains(path, F.lit(t)).cast("int") * 3 for t in terms), F.lit(0))
    return chunks.select("id", score.cast("long").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(limit)


#: Words whose bucket a worker remembers at most.
REMEMBERED = 500_000


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    pattern = re.compile("[a-z0-9À-ɏ]{2,}")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, buckets, weights = [], [], []
            for k, text in enumerate(part.column(1)):
                words = Counter(pattern.findall(text.as_py() or ""))
                counts: Counter[int] = Counter()
                for word, n in words.items():
                    if word not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = int.from_bytes(hashlib.sha1(word.encode()).digest()[:4], "big") % VECTOR_DIMENSIONS
                    counts[known[word]] += n
                norm = math.sqrt(sum(n * n for n in counts.values()))
                ids += [k] * len(counts)
                buckets += counts
                weights += [n / norm for n in counts.values()]
            yield pa.record_batch([part.column(0).take(pa.array(ids, pa.int64())), pa.array(buckets, pa.int64()), pa.array(weights, pa.float64())], names=["id", "bucket", "weight"])


def hash_vectors(df: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """The hashed word counts of each text, of unit length, as rows (id, bucket, weight) of its non-zero buckets; a text
    without words has none. A vector is folded where its row is, so nothing is shuffled."""
    rows = df.select(F.col(id_column).alias("id"), F.lower(F.col(text)).alias("text"))
    found = rows.mapInArrow(_hash_rows, f"id {rows.schema['id'].dataType.simpleString()}, bucket long, weight double")
    return found.withColumn("weight", F.round("weight", 9))


def fingerprints(df: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """A 64-bit fingerprint of each text by the first bits of its words' SHA-256, ties one: id, fingerprint (16 hex digits).

    Every word of the whole text counts. A text without words, or null, has all bits set, as ties do.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    digest = F.sha2("w", 256)
    halves = df.select(F.col(id_column).alias("id"), F.explode_outer(words).alias("w")).select(
        "id", *[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(2)]
    )
    votes = [F.sum(F.shiftright(f"h{i}", 31 - b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"v{32 * i + b}") for i in range(2) for b in range(32)]
    bit = [F.when(F.coalesce(f"v{k}", F.lit(0)) >= 0, 1).otherwise(0) for k in range(64)]
    nibbles = [F.hex(bit[k] * 8 + bit[k + 1] * 4 + bit[k + 2] * 2 + bit[k + 3]) for k in range(0, 64, 4)]
    return halves.groupBy("id").agg(*votes).select("id", F.lower(F.concat(*nibbles)).alias("fingerprint"))


def suite_scores(results: DataFrame, pass_threshold: float = 1.0) -> DataFrame:
    """Results (run_id, score, weight, passed, required) by run: weighted score, pass rate, and whether the run passed."""
    rate = F.count_if("passed") / F.count("*")
    hard = F.coalesce(F.bool_or(~F.col("passed") & F.coalesce("required", F.lit(True))), F.lit(False))
    weighted = F.when(F.sum("weight") == 0, 0.0).otherwise(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"))
    return results.groupBy("run_id").agg(F.round(weighted, 6).alias("score"), F.round(rate, 6).alias("pass_rate"), (~hard & (rate >= pass_threshold)).alias("passed"))


ship(__name__)
