"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, one_each, remainder, saved, small_batches, without

#: Features are hashed to this many bits. A model holds the non-zero weights alone, at most 12 bytes each.
BITS = 20
#: At most this many labelled rows are learned from, those with the smallest hash of their doc_id.
MAX_TRAINING_ROWS = 6_000
THRESHOLD = 0.7
#: Bytes of a word that make a stem.
STEMS = (5, 7)
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
#: Odd multipliers that tell the places of a feature's words, and the kinds of feature, apart.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed features of a text, repeats included: words, pairs of neighbours, pairs with one or two words between, and
    the stems of longer words, by which their inflections are told to belong together.

    Words are lower-cased runs of letters. Null and empty texts have no features.
    """
    found = LETTERS.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
    first = h * MIX[0]
    grams = [first]
    for gap in (1, 2, 3):
        if len(h) > gap:
            grams.append((first[:-gap] ^ (h[gap:] * MIX[gap])) * MIX[1])
    for k in STEMS:
        stems = [zlib.crc32(w[:k], k) for w in found if len(w) > k]
        grams.append(np.array(stems, np.uint64) * MIX[2])
    shift = np.uint64(64 - bits)
    return (np.concatenate(grams) >> shift).astype(np.int32) if found else np.empty(0, np.int32)


@dataclass(frozen=True)
class Weights:
    """A sparse linear model: sorted feature numbers, their weights, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def dense(index: np.ndarray, weight: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The weight of every feature number."""
    table = np.zeros(1 << bits, np.float32)
    table[index] = weight
    return table


def ftrl(
    rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 4.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.0, epochs: int = 10, lift: float = 4.0
) -> Weights:
    """FTRL-proximal: each coordinate has its own rate, alpha / (beta + sqrt(sum of squared gradients)), and L1 zeroes it
    until its gradients outweigh l1. Toxic rows, which are few, weigh lift times as much. Features count once per row. Rows are taken in the order given, epochs times over."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    last = 1 << bits  # the intercept, without penalty
    rows = [(np.append(np.unique(x), np.int32(last)).astype(np.int32), y) for x, y in rows]

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.where(i == last, zi, np.sign(zi) * np.maximum(np.abs(zi) - l1, 0))
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for i, y in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (lift if y else 1.0)
            before = n[i]
            z[i] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * w
            n[i] = before + g * g
    w = weights(np.arange(last + 1))
    index = np.flatnonzero(w[:last])
    return Weights(index.astype(np.int32), w[index].astype(np.float32), float(w[last]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, bits: int = BITS) -> Weights:
    """Learn from the labelled rows outside the held-out fold (crc32 of doc_id modulo 3 is 1), max_rows of them at most.

    The rows are a hash sample of the labels, joined to their texts and hashed where the texts are; one task learns from
    that bounded sample and returns the non-zero weights. Without any label the model is the intercept 0.
    """
    chosen = saved(
        labels.where("doc_id is not null and toxic is not null")
        .where(remainder(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    schema = "doc_id long, toxic int, ids binary"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = [np.unique(features(t.as_py(), bits)).astype(np.int32).tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = one_each(texts.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = known.select("doc_id", "toxic", "text").mapInArrow(hashed, schema)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id")
        order = np.argsort([zlib.crc32(str(i).encode()) for i in pdf["doc_id"]], kind="stable")
        rows = [(np.frombuffer(pdf["ids"].iloc[k], np.int32), int(pdf["toxic"].iloc[k])) for k in order]
        del pdf
        model = ftrl(rows, bits)
        return pd.DataFrame({"index": [model.index.tobytes()], "weight": [model.weight.tobytes()], "bias": [model.bias]})

    one = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "index binary, weight binary, bias double").collect()
    if not one:
        return Weights(np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
    return Weights(np.frombuffer(one[0]["index"], np.int32), np.frombuffer(one[0]["weight"], np.float32), one[0]["bias"])


def score_texts(texts, table: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Probabilities for texts, by a dense table of weights; a feature counts once however often it occurs."""
    out = np.empty(len(texts))
    for k, text in enumerate(texts):
        ids = features(text, bits)
        hit = ids[table[ids] != 0]
        out[k] = bias + table[np.unique(hit)].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def scored(docs: DataFrame, model: Weights, bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """key and score of every row and whole text; null and empty texts score the intercept."""
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = dense(*sent.value[:2], bits), sent.value[2]
        for batch in small_batches(batches):
            yield pa.record_batch([batch.column(0), pa.array(score_texts(batch.column(1).to_pylist(), table, bias, bits))], names=[key, "score"])

    return docs.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(score, f"{key} long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold, else 0).

    Labels are the only supervision, and only those outside the held-out fold. A null doc_id is scored like any other,
    with held_out null. Repeated rows get a row each. Empty tables give empty results. Other columns are not looked at.
    """
    model = train(docs, labels)
    return scored(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they are. Rows are judged by themselves, whatever their id."""
    model = train(docs, labels)
    docs, key = keyed(docs)
    return without(docs, scored(docs, model, key=key).where(F.col("score") >= threshold), key).drop(key)
