"""Byte-level BPE by a global shuffle of distinct words: encode each once, join its ids back, reassemble by position."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: The white space that \s means to the tokenizer, spelled out for the JVM, whose \s is ASCII alone.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
#: public_tokenizers.PATTERN in the JVM's dialect.
JVM_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Parts that words are dealt to for each shuffle partition, and bytes of text to a part if that makes more of them.
PARTS, PART_BYTES = 4, 16 << 20
#: Rows and bytes of a block of documents, whose distinct words travel together.
BLOCK_ROWS, BLOCK_BYTES = 3072, 18 << 20


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode_word(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: merge the neighbouring parts of lowest rank, leftmost first, until none is in the table."""
    if word in table:
        return [table[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 512:
        return _encode_long(parts, table)
    far = 1 << 40
    scores = [table.get(a + b, far) for a, b in zip(parts, parts[1:])]
    while scores:
        best = min(scores)
        if best == far:
            break
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = table.get(parts[i] + parts[i + 1], far)
        if i:
            scores[i - 1] = table.get(parts[i - 1] + parts[i], far)
    return [table[p] for p in parts]


def _encode_long(parts: list[bytes], table: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for pre-tokens so long that scanning for the minimum would be quadratic."""
    import heapq

    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := table.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, merged = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or parts[i] + parts[j] != merged:
            continue
        parts[i], alive[j], after[i] = merged, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := table.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i] + parts[after[i]]))
        if before[i] >= 0 and (r := table.get(parts[before[i]] + parts[i])) is not None:
            heapq.heappush(heap, (r, before[i], parts[before[i]] + parts[i]))
    return [table[p] for p, a in zip(parts, alive) if a]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its length before it, compressed."""
    raw = b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _planes(numbers: np.ndarray) -> np.ndarray:
    """32-bit numbers with their lowest bytes first, then their second ones, and so on."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _strings(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of a string array."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if words.buffers()[2] else np.empty(0, np.uint8)
    return np.diff(ends), data


def _binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """The inverse of _strings()."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


BLOCKS = "block long, doc_ids array<long>, places binary, words binary"
WORDS = "block long, part int, body binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Explode pre-tokens with positions, a block of documents at a time; a row for each block.

    words has the block's distinct words, most frequent first; places has each document's number of pre-tokens and, for
    every position, the number of its word. Texts with characters that the JVM's tables lack are split here, the others
    in the JVM.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = text.rlike(r"\p{Cn}")
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(~odd, F.regexp_extract_all(text, F.lit(JVM_PATTERN), F.lit(0))).alias("words"),
        F.when(odd, text).alias("odd"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, number = regex.compile(public_tokenizers.PATTERN), TaskContext.get().partitionId() << 32
        for part in small_batches(batches, BLOCK_ROWS, BLOCK_BYTES):
            lists = part.column(1)
            if part.column(2).null_count < part.num_rows:
                lists = pa.array([pattern.findall(o) if o is not None else w for w, o in zip(lists.to_pylist(), part.column(2).to_pylist())], pa.list_(pa.string()))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            place = coded.indices.to_numpy(zero_copy_only=False)
            # positions name words by frequency, in planes of bytes: most are then small numbers and the planes pack well
            often = np.argsort(-np.bincount(place, minlength=len(coded.dictionary)), kind="stable")
            named = np.empty(len(often), np.int32)
            named[often] = np.arange(len(often), dtype=np.int32)
            bodies = _pack(counts, _planes(named[place])), _pack(*_strings(coded.dictionary.take(pa.array(often))))
            out = pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in bodies)],
                names=["block", "doc_ids", "places", "words"],
            )
            number += 1
            # the next part comes while this generator waits: nothing of this one should still be held then
            del part, lists, coded, place, often, named, bodies
            pa.default_memory_pool().release_unused()
            yield out

    return split.mapInArrow(build, BLOCKS)


def _dealt(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each word, and the order that puts parts together."""
    part = (pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object)) % parts).astype(np.int32) if len(words) else np.empty(0, np.int32)
    return part, np.argsort(part, kind="stable")


def distinct_words(found: DataFrame, parts: int) -> DataFrame:
    """The distinct words of every block, dealt out to parts by hash: a row for each block and part that has any.

    All columns of found are taken, so that both readers of found share its exchange.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(3)):
                words = _binaries(*_unpack(body.as_buffer(), np.int64, np.uint8))
                if not len(words):
                    continue
                part, order = _dealt(words, parts)
                words, part = words.take(pa.array(order)), part[order]
                edges = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0, [True])))
                rows = [_pack(*_strings(words.slice(a, z - a))) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.record_batch([pa.repeat(pa.scalar(block, pa.int64()), len(rows)), pa.array(part[edges[:-1]]), pa.array(rows, pa.binary())], names=["block", "part", "body"])

    return found.mapInArrow(deal, WORDS)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """For every row of distinct_words() the ids of its words, in their order. A part's rows are neighbours in one task,
    which streams over them and encodes each word once: it holds the part's distinct words, never its rows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, known = ranks(path), None, {}
        for batch in small_batches(batches):
            out = []
            for part, body in zip(batch.column(1).to_pylist(), batch.column(2)):
                if part != now:
                    now, known = part, {}
                lengths, data = _unpack(body.as_buffer(), np.int64, np.uint8)
                raw, ends, found = data.tobytes(), np.cumsum(lengths).tolist(), []
                for a, b in zip([0, *ends], ends):
                    ids = known.get(raw[a:b])
                    if ids is None:
                        ids = known[raw[a:b]] = np.array(encode_word(raw[a:b], table), "<u4").tobytes()
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
                out.append(_pack(sizes, np.frombuffer(b"".join(found), np.uint32)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "part", "body"])

    return words.repartition("part").sortWithinPartitions("part").mapInArrow(encode, WORDS)


def token_table(spark: SparkSession, ranks_path: str | None = None) -> DataFrame:
    """id and bytes of every token: as many rows as the vocabulary has."""
    rows = sorted((i, b) for b, i in ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")).items())
    return spark.createDataFrame(rows, "id int, bytes binary")


def _sent(tokens: DataFrame):
    """The token table as a broadcast, which the vocabulary bounds: the bytes of each id, ids from 0 on."""
    return tokens.sparkSession.sparkContext.broadcast([bytes(r["bytes"]) for r in tokens.orderBy("id").collect()])


def join_tokens(ids: np.ndarray, counts: np.ndarray, known: pa.Array) -> pa.Array:
    """The bytes of texts whose ids lie end to end, counts of them each: every id meets its row of the token table, in order."""
    sizes, data = _strings(known.take(pa.array(ids)))
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
    return _binaries(np.diff(ends), data)


def encoded(docs: DataFrame, ranks_path: str | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens and token_ids (unsigned 32-bit, little-endian, as binary) of every row and whole text.

    A block's distinct words are shuffled to the tasks that encode each word of the corpus once, and their ids are joined
    back to the block, where positions put them in order. So no occurrence is shuffled, only a block's list and its
    positions. No task holds more than a block, the distinct words of a part or a very long text.
    Null texts count as empty. A null doc_id is kept as null, repeated rows get a row each, an empty table gives an empty
    result. ranks_path must be readable by every executor. With a token table (id, bytes), the column decoded is added,
    what decoded() makes of the ids, while they are at hand.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = blocks(docs).repartition("block")  # one exchange: the words are taken from it, and the positions wait in it
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ids = encoded_words(distinct_words(found, parts), path)
    sent = _sent(tokens) if tokens is not None else None
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary())] + [("decoded", pa.binary())] * (sent is not None))

    def assemble(block: pa.Table, coded: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        known, out = pa.array(sent.value, pa.large_binary()) if sent else None, []
        body = {n: block.column(n)[0] for n in ("doc_ids", "places", "words")}
        counts, numbers = _unpack(body["places"].as_buffer(), np.int32, np.uint8)
        lists = [_unpack(b.as_buffer(), np.int32, np.uint32) for b in coded.take(pc.sort_indices(coded.column("part"))).column("body")]
        size, flat = (np.concatenate([x[k] for x in lists] or [np.empty(0, np.int32)]) for k in range(2))
        # the ids come in the order of parts, in which the block's words were dealt
        where = _dealt(_binaries(*_unpack(body["words"].as_buffer(), np.int64, np.uint8)), parts)[1]
        sizes, starts = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        sizes[where], starts[where] = size, np.cumsum(size.astype(np.int64)) - size
        place, ids, ends = _numbers(numbers), body["doc_ids"].values, np.concatenate(([0], np.cumsum(counts)))
        for a, z in _runs(counts, 1 << 18):
            p = place[ends[a] : ends[z]]
            stops = np.concatenate(([0], np.cumsum(sizes[p])))
            got = flat[np.repeat(starts[p] - stops[:-1], sizes[p]) + np.arange(stops[-1])].astype("<u4")
            n = np.diff(stops[ends[a : z + 1] - ends[a]])
            found = [ids.slice(a, z - a), pa.array(n), _binaries(4 * n, got.view(np.uint8))] + ([join_tokens(got, n, known)] if sent else [])
            out.append(pa.record_batch(found, schema=schema))
        return pa.Table.from_batches(out, schema)

    pairs = found.groupBy("block").cogroup(ids.groupBy("block"))
    return pairs.applyInArrow(assemble, "doc_id long, n_tokens long, token_ids binary" + ", decoded binary" * (sent is not None))


def _runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring documents, from a to z, with about so many pre-tokens together."""
    a, total = 0, 0
    for z, n in enumerate(counts.tolist()):
        if z > a and total + n > most:
            yield a, z
            a, total = z, 0
        total += n
    if len(counts):
        yield a, len(counts)


def decoded(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """rows with the column decoded (binary): the bytes of each id, joined to the token table (id, bytes).

    The table is broadcast and met by a whole batch of ids at a time, in their order: exploding every token into a row
    would shuffle them all to put them back.
    """
    sent, names = _sent(tokens if tokens is not None else token_table(rows.sparkSession)), rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", decoded binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.large_binary())
        for part in small_batches(batches):
            sizes, data = _strings(part.column(names.index("token_ids")))
            yield pa.record_batch([*part.columns, join_tokens(data.view("<u4"), sizes // 4, known)], names=[*names, "decoded"])

    return rows.mapInArrow(decode, schema)


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    """encoded() with the column decoded, without a second Python process beside the first."""
    return encoded(docs, tokens=token_table(docs.sparkSession))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, from the encoded and decoded documents."""
    return encoded_and_decoded(docs).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
