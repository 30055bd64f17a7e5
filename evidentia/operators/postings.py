"""A posting index: for every term the documents that have it, with weights by field, written once by term."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..session import saved, shared_dir, ship
from .blocks import Best
from .retrieval import query_terms, ranked

#: What an occurrence weighs in a field of each label.
LABELS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Folders that terms are dealt to, and parts of each, so that a term that all documents have fills several tasks.
BUCKETS, PARTS = 32, 8
#: Questions of a block, postings of the index for each block of documents, numbers of a dense matrix.
QUESTIONS, POSTINGS, DENSE = 512, 400_000, 4_000_000
#: Terms and blocks of questions that are broadcast at most.
BROADCAST_TERMS, BROADCAST_BLOCKS = 200_000, 64


@dataclass(frozen=True)
class PostingIndex:
    """postings: bucket, term, id, tf (an entry a field, in order) and n (tokens of the document), in a folder a bucket."""

    postings: DataFrame
    fields: tuple[str, ...]
    weights: tuple[float, ...]
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, fields: dict[str, str], id_column: str = "id", buckets: int = BUCKETS) -> PostingIndex:
    """Index the fields of docs, named with their labels (A to D). Null fields have no terms; rows without an id are left out.

    A document's terms are sorted and counted in its own row, so that postings are shuffled once and occurrences never.
    Postings are dealt by bucket and a part drawn from the document, sorted by term: a lookup reads the folders of its terms' buckets
    and, by the files' statistics, little else of them.
    """
    names = tuple(fields)
    lists = docs.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), *[tokens(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(f"_t{k}") for k, name in enumerate(names)]
    )
    every = [f"_t{k}" for k in range(len(names))]
    of_field = lambda k: lambda w: F.struct(w.alias("term"), F.lit(k).alias("field"))
    in_field = lambda k: lambda x: x["field"] == k
    term = (lambda x: x["term"]) if len(names) > 1 else (lambda x: x)
    total = sum((F.size(t) for t in every), F.lit(0))
    words = F.flatten(F.array(*[F.transform(t, of_field(k)) for k, t in enumerate(every)])) if len(names) > 1 else F.col(every[0])
    row = lists.select("id", total.alias("n"), F.sort_array(words).alias("s")).where(F.size("s") > 0)
    # equal terms lie side by side: a run begins where the term before is another one
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (term(F.get("s", i)) != term(F.get("s", i - 1))))
    row = row.select("id", "n", "s", begins.alias("b"))

    def posting(begin: Column, k: Column) -> Column:
        length = F.coalesce(F.get("b", k + 1), F.size("s")) - begin
        run = F.slice("s", begin + 1, length)
        tf = [F.size(F.filter(run, in_field(f))) for f in range(len(names))] if len(names) > 1 else [length]
        return F.struct(term(F.get("s", begin)).alias("term"), F.array(*[c.cast("long") for c in tf]).alias("tf"))

    counted = row.select("id", "n", F.explode(F.transform("b", posting)).alias("p")).select("id", "n", "p.term", "p.tf").withColumn("bucket", _bucket(F.col("term"), buckets))
    path = shared_dir(docs.sparkSession)
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    counted.repartition("bucket", part).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    postings = docs.sparkSession.read.schema(f"id {lists.schema['id'].dataType.simpleString()}, n int, term string, tf array<bigint>, bucket int").parquet(path)
    return PostingIndex(postings, names, tuple(LABELS[label] for label in fields.values()), buckets)


def matching(index: PostingIndex, terms: list[str]) -> DataFrame:
    """id, n and tf, summed over the terms, of the documents that have any of them; other buckets and terms are not read."""
    if not terms:
        return index.postings.where("false").select("id", "n", "tf")
    spark = index.postings.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), index.buckets)).distinct().collect()]
    found = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    sums = [F.sum(F.col("tf")[k]).alias(f"f{k}") for k in range(len(index.fields))]
    return found.groupBy("id", "n").agg(*sums).select("id", "n", F.array(*[f"f{k}" for k in range(len(sums))]).alias("tf"))


def lexical(index: PostingIndex, query: str, limit: int) -> DataFrame:
    """The lexical lane of retrieval.lexical(), over all fields, from the index alone: no text is read."""
    terms = query_terms(query)
    hits = F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)
    scored = matching(index, terms).withColumn("score", F.round(hits / F.sqrt(F.lit(float(len(terms))) * F.col("n")), 9))
    return ranked(scored, "lexical", limit)


def weighted(index: PostingIndex, query: str, limit: int, require_all: bool = False) -> DataFrame:
    """The lane of field weights: occurrences of the query's terms times the weight of their field, over the square root of
    the document's tokens, brought below one as s / (s + 1). require_all wants every term of the query in the document."""
    terms = query_terms(query)
    weights = F.array(*map(F.lit, index.weights))
    found = matching(index, terms)
    if require_all:
        rows = index.postings.where(F.col("term").isin(terms)).groupBy("id").agg(F.count_distinct("term").alias("_k")).where(F.col("_k") == len(terms))
        found = found.join(rows, "id", "left_semi")
    mass = F.aggregate(F.zip_with("tf", weights, lambda t, w: t * w), F.lit(0.0), lambda s, x: s + x) / F.sqrt("n")
    return ranked(found.withColumn("score", F.round(mass / (mass + 1), 9)), "weighted_lexical", limit)


def _scores(limit: int, ids_type: pa.DataType):
    """For mapInArrow: pairs of a block of postings and a block of questions to the best documents of each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = {}, {}
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda name: batch.column(name)[row]  # noqa: B023, E731
                block = of("block").as_py()
                if block not in asked:
                    lists = of("terms").values
                    sizes = np.diff(lists.offsets.to_numpy()[: len(lists) + 1])
                    terms, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                    a = np.zeros((len(terms), len(lists)))
                    np.add.at(a, (at, np.repeat(np.arange(len(lists)), sizes)), 1)
                    asked[block], best[block] = (terms, a, of("k").values.to_numpy().astype(float)), Best(len(lists), limit, 9)
                terms, a, k = asked[block]
                p = of("postings").values
                no, m, n = (p.field(c).to_numpy() for c in ("no", "m", "n"))
                ids = p.field("id").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(terms, no), len(terms) - 1)
                known = terms[at] == no
                at, m, n, ids = at[known], m[known], n[known], ids[known]
                order = np.lexsort((n, ids))
                at, m, n, ids = at[order], m[order], n[order], ids[order]
                begins = np.append(True, (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])) if len(ids) else np.empty(0, bool)
                doc, first = np.cumsum(begins) - 1, np.nonzero(begins)[0]
                kind = np.float32 if m.sum() < 1 << 24 else np.float64  # whole numbers, which both hold exactly
                rows = max(1, DENSE // max(len(terms), len(k)))
                for start in range(0, len(first), rows):
                    stop = min(start + rows, len(first))
                    part = slice(first[start], first[stop] if stop < len(first) else len(doc))
                    w = np.zeros((stop - start, len(terms)), kind)
                    np.add.at(w, (doc[part] - start, at[part]), m[part])
                    hits = (w @ a.astype(kind)).T.astype(float)
                    best[block].add(hits / np.sqrt(k[:, None] * n[first[start:stop]][None, :]), ids[first[start:stop]])
        for block, found in best.items():
            if found.id is not None:
                columns = [pa.array(np.full(len(found.query), block), pa.int32()), pa.array(found.query, pa.int32()), pa.array(found.id, ids_type), pa.array(found.score)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "nth", "id", "score"])

    return run


def lexical_many(index: PostingIndex, questions: DataFrame, limit: int, id_column: str = "query", text: str = "text") -> DataFrame:
    """The lexical lanes of a table of questions at once: query, rank, score, id.

    Postings of the questions' terms meet in blocks of documents and are multiplied with blocks of questions, so what is
    shuffled are postings, however many questions share a term; each task hands on the best documents of a question alone.
    """
    asked = questions.select(F.col(id_column).alias("query"), F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))).alias("terms"))
    each = saved(asked.select("query", F.size("terms").alias("k"), F.explode("terms").alias("term")))
    numbered = saved(each.select("term").distinct().select("term", F.monotonically_increasing_id().alias("no"), _bucket(F.col("term"), index.buckets).alias("bucket")))
    per_question = each.join(numbered, "term").groupBy("query", "k").agg(F.collect_list("no").alias("terms"))
    blocks = max(1, -(-each.select("query").distinct().count() // QUESTIONS))
    dealt = per_question.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("query", "k", "terms")).alias("q"))
    asked = saved(dealt.select("block", "q.query", "q.k", "q.terms"))
    parts = max(1, -(-index.postings.count() // POSTINGS))
    terms = F.broadcast(numbered) if numbered.count() <= BROADCAST_TERMS else numbered
    hits = F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)
    met = index.postings.join(terms, ["bucket", "term"]).select("id", "n", "no", hits.alias("m"))
    packed = met.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "n", "no", "m")).alias("postings"))
    side = F.broadcast(asked.select("block", "k", "terms")) if blocks <= BROADCAST_BLOCKS else asked.select("block", "k", "terms")
    kind = index.postings.schema["id"].dataType
    found = packed.crossJoin(side).select("block", "k", "terms", "postings").mapInArrow(_scores(limit, to_arrow_type(kind)), f"block int, nth int, id {kind.simpleString()}, score double")
    best = found.join(asked.select("block", "query"), "block").select(F.get("query", F.col("nth")).alias("query"), "id", "score")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= limit)
    return best.select("query", "rank", "score", "id")


ship(__name__)
