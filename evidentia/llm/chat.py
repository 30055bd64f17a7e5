"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers, processors

from .common import small_batches

#: A turn is OPEN, its role, HEAD, its text, CLOSE. Texts and roles are escaped so that they hold none of these.
OPEN, HEAD, CLOSE = "### ", ":\n", "\n</turn>\n"
TAUGHT = "assistant"
ESCAPED = re.compile(r"[\\#<:]")
UNESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*):\n((?:[^\\#<]|\\.)*)\n</turn>\n", re.S)
#: A last conversation whose texts hold control strings, to show that they come back as they were.
TRAP = r"\### Assistant: </turn> ok"


def escaped(text: str) -> str:
    """Put a backslash before every backslash and before every character a control string could start with."""
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return UNESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The rendered conversation and the (start, end) character spans of its taught texts, sorted."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role)}{HEAD}", escaped(text)
        if role == TAUGHT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(rendered)]


@dataclass(frozen=True)
class Masked:
    """What the mask covers: pieces (start, end) of characters inside turn spans, in order, and the numbers of their tokens."""

    pieces: np.ndarray
    tokens: np.ndarray


def mask(spans: np.ndarray, offsets: np.ndarray) -> Masked:
    """Intersect sorted turn spans with token spans, both in characters, by binary search.

    A token that reaches over the edge of a turn is clipped to it. The tokens of one character share its span, so each
    starts no earlier than its predecessor ended. Tokens that touch make one piece, so that a turn whose tokens leave
    nothing out is one piece.
    """
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    pieces, tokens = [], []
    for (a, b), i, j in zip(spans, first, last):
        tokens.append(np.arange(i, j))
        cut = np.clip(offsets[i:j], a, b)
        if len(cut) > 1:
            cut[1:, 0] = np.maximum(cut[1:, 0], np.maximum.accumulate(cut[:-1, 1]))
        cut = cut[cut[:, 0] < cut[:, 1]]
        if len(cut):
            new = np.flatnonzero(np.concatenate(([True], cut[1:, 0] != cut[:-1, 1])))
            pieces.append(np.stack((cut[new, 0], cut[np.append(new[1:], len(cut)) - 1, 1]), axis=1))
    return Masked(np.concatenate(pieces or [np.empty((0, 2), np.int64)]), np.concatenate(tokens or [np.empty(0, np.int64)]))


def _tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    found.post_processor = processors.ByteLevel(trim_offsets=False)
    return found


SCHEMA = "conv_id long, n_turns long, rendered string, token_ids array<int>, loss_mask array<boolean>, loss_pieces array<struct<start:long,end:long>>"


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, rendered, token_ids, loss_mask (per token), loss_pieces (characters).

    Rows are ordered by turn, nulls first, then role and text, so ties and repeated rows have one outcome; null roles
    and texts count as empty. Rows without a conv_id are left out. A conversation, which is one training example, is
    rendered whole and encoded once, with offsets. tokenizer is the path of a byte-level BPE in the tokenizers format.
    An empty table gives an empty result; other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    turns = (
        conversations.where("conv_id is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
        .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(path)
        for part in small_batches(batches):
            rendered, ids, flags, pieces = [], [], [], []
            for roles, texts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                text, spans = render(list(zip(roles, texts)))
                coded = encoder.encode(text, add_special_tokens=False)
                found = mask(spans, np.array(coded.offsets, np.int64).reshape(-1, 2))
                flag = np.zeros(len(coded.ids), bool)
                flag[found.tokens] = True
                rendered.append(text)
                ids.append(np.array(coded.ids, np.int32))
                flags.append(flag)
                pieces.append(found.pieces)
            ends = np.concatenate(pieces)
            spans = pa.StructArray.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["start", "end"])
            yield pa.record_batch(
                [part.column(0), pc.list_value_length(part.column(1)).cast(pa.int64()), pa.array(rendered, pa.string()), _lists(ids, pa.array(np.concatenate(ids))),
                 _lists(flags, pa.array(np.concatenate(flags))), _lists(pieces, spans)],
                names=["conv_id", "n_turns", "rendered", "token_ids", "loss_mask", "loss_pieces"],
            )

    return turns.mapInArrow(build, SCHEMA)


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    """One list per part over the values of all parts."""
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32), values)


def digests(rows: DataFrame) -> DataFrame:
    """Read the formatted output back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            out = []
            for rendered, pieces in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                turns = parse(rendered)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = unescaped("".join(rendered[p["start"] : p["end"]] for p in pieces))
                hexed = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
                out.append((len(turns), hexed[0], len(loss), hexed[1], len(rendered)))
            yield pa.record_batch([part.column(0), *map(pa.array, zip(*out))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "rendered", "loss_pieces").mapInArrow(read, schema)


def with_trap(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, a user and an assistant row that both say TRAP."""
    extra = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TAUGHT).alias("role"), F.lit(TRAP).alias("text")
    )
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
