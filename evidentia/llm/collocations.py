"""Phrase collocations by vertical positional lists: frequent phrases are extended by the postings of the words after them."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release
from .common import saved

#: Words of a phrase at most, occurrences that make it frequent, and phrases returned for each language.
LONGEST, FREQUENT, TOP = 5, 100, 2000
#: Bytes of text in a block at most, but for single documents. A block's lists are what a task holds at once.
BLOCK_BYTES = 8 << 20
#: Occurrences of phrases for each bucket in which lengths are added up: what a task holds of them at once.
BUCKET_PAIRS = 2_000_000
#: And words of blocks for each bucket in which words are counted.
BUCKET_WORDS = 1_000_000
#: The top list of a language is found over so many parts first.
PARTS = 64

#: Bytes that part pieces become full stops, which then stand for themselves alone: no word has one.
_STOP = bytes(46 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
#: In the lists of a block: no frequent phrase starts here.
_NONE = -1


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed: as they are or by differences, what is shorter, their bytes by significance."""
    out = []
    for a in arrays:
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, a.itemsize).T) for x in (np.ascontiguousarray(a), np.diff(a, prepend=a.dtype.type(0)))]
        short = [zstandard.ZstdCompressor(level=3).compress(p) for p in planes]
        best = int(len(short[1]) < len(short[0]))
        out += [np.array([best, len(short[best])], np.int64).tobytes(), short[best]]
    return b"".join(out)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    at, out = 0, []
    for kind in kinds:
        differs, size = np.frombuffer(blob, np.int64, 2, at).tolist()
        raw = zstandard.ZstdDecompressor().decompress(blob[at + 16 : at + 16 + size])
        values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        out.append(np.cumsum(values, dtype=kind) if differs else values)
        at += 16 + size
    return out


class _Numbers(dict):
    """The words of one language in a block; a new one gets the next number of the block."""

    def __init__(self, take: Callable[[], int]):
        super().__init__({b".": _NONE})
        self.take = take

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.take()
        return n


class _Words:
    """The words of one block: numbers of its own for (language, word), and the text as a list of such numbers."""

    def __init__(self):
        self.numbers: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.counter, self.size = count(), 0

    def add(self, text: bytes, lang: str) -> None:
        """The words of a text, _NONE between its pieces and after its end."""
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(self.counter.__next__)
        words = text.lower().translate(_STOP).replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(np.fromiter(map(self.numbers[lang].__getitem__, words), np.int32, len(words)))
        self.size += len(text)

    def rows(self) -> Iterator[tuple[str, bytes, bytes, int, bytes | None]]:
        """For each language its words in order, a line each, their numbers and counts, and how many they are; the text with
        the first. Words are numbered anew, the most frequent first, which makes the text shorter."""
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[ids != _NONE], minlength=next(self.counter)).astype(np.int32)
        rank = np.empty(len(counts) + 1, np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        rank[-1] = _NONE
        text = packed(rank[ids])
        for lang, known in self.numbers.items():
            del known[b"."]
            words = sorted(known)
            own = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
            yield lang, zstandard.ZstdCompressor(level=3).compress(b"\n".join(words)), packed(rank[own], counts[own]), len(own), text
            text = None


BLOCKS = "lang string, words binary, numbers binary, n_words int, ids binary, part int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _Words.rows(), with the number of the block in its task."""
    number = count()

    def flush(block: _Words) -> pa.RecordBatch:
        lang, words, numbers, n, ids = zip(*block.rows())
        columns = pa.array(lang, pa.string()), pa.array(words, pa.binary()), pa.array(numbers, pa.binary()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array([next(number)] * len(n), pa.int32())
        return pa.record_batch(list(columns), names=[c.split()[0] for c in BLOCKS.split(", ")])

    block = _Words()
    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang")):
            block.add(text.as_py(), lang.as_py())
            if block.size >= BLOCK_BYTES:
                yield flush(block)
                block = _Words()
    if block.parts:
        yield flush(block)


def blocks(docs: DataFrame) -> DataFrame:
    """The corpus as blocks, written once, a row for each block and language. What later steps read is this, whatever the
    order of rows in another evaluation."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    block = (F.spark_partition_id().cast("long") * F.lit(2**32) + F.col("part")).alias("block")
    return saved(rows.mapInArrow(_blocks, BLOCKS).select(block, "lang", "words", "numbers", "n_words", "ids"))


def _words_sent(buckets: int):
    """(bucket, lang, block, words, numbers): the words of each block with their numbers and counts, packed by bucket."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "lang", "block", "words", "numbers"]
        for batch in batches:
            for block, lang, words, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "words", "numbers"))):
                own = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
                number, n = unpacked(numbers, np.int32, np.int32)
                if not len(number):
                    continue
                bucket = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % buckets
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
                rows = []
                for a, z in zip(edges[:-1], edges[1:]):
                    part = order[a:z]
                    text = zstandard.ZstdCompressor(level=3).compress(b"\n".join([own[i] for i in part.tolist()]))
                    rows.append((int(bucket[part[0]]), lang, block, text, packed(number[part], n[part])))
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)

    return sent


#: What the buckets of words give back: frequent words, replies to blocks (numbers in the block, and in the corpus), and for
#: every language the number of all words (word and reply null).
COUNTED_WORDS = "lang string, block long, word string, f long, id long, reply binary"


def _words_summed(least: int):
    """Over rows in order of bucket and language: exact counts, numbers for the frequent words, replies, totals."""
    names = [c.split()[0] for c in COUNTED_WORDS.split(", ")]

    def of_lang(lang: str, first: int, rows: list[tuple[int, list[bytes], np.ndarray, np.ndarray]]) -> tuple[int, pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for _, words, _, n in rows:
            for word, k in zip(words, n.tolist()):
                total[word] += k
        frequent = {word: first + k for k, word in enumerate(sorted(w for w, k in total.items() if k >= least))}
        out = [(lang, _NONE, word.decode("utf-8", "surrogatepass"), total[word], k, None) for word, k in frequent.items()]
        for block, words, number, _ in rows:
            ids = np.fromiter((frequent.get(w, _NONE) for w in words), np.int64, len(words))
            out.append((lang, block, None, None, None, packed(number[ids != _NONE], ids[ids != _NONE])))
        out.append((lang, _NONE, None, sum(total.values()), None, None))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return first + len(frequent), pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, rows = (None, None), 0, []
        for batch in batches:
            for bucket, lang, block, words, numbers in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "block", "words", "numbers"))):
                if rows and (bucket, lang) != last:
                    first, found = of_lang(last[1], first, rows)
                    yield found
                    rows = []
                if bucket != last[0]:
                    first = bucket << 32
                last = bucket, lang
                rows.append((block, zstandard.ZstdDecompressor().decompress(words).split(b"\n"), *unpacked(numbers, np.int32, np.int32)))
        if rows:
            yield of_lang(last[1], first, rows)[1]

    return summed


#: The inverted lists of a block, packed: keys (of words or phrases, corpus-wide), the length of each list, and the places.
LISTS = (np.int64, np.int32, np.int32)
STATE = "block long, words binary, lists binary"


def _vertical(keys: np.ndarray, places: np.ndarray) -> bytes:
    """Occurrences (key, place), by place, as inverted lists: the keys, how long each list is, and the lists one after the other.

    The longest list comes first, as lists whose places are about as far apart are packed best side by side.
    """
    every, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return packed(every[order], times[order].astype(np.int32), places[np.argsort(rank[which], kind="stable")].astype(np.int32))


def _state(batch: pa.RecordBatch, k: int, words: bytes, lists: bytes | None) -> pa.RecordBatch:
    return pa.record_batch([batch.column("block").slice(k, 1), pa.array([words], pa.binary()), pa.array([lists], pa.binary())], names=["block", "words", "lists"])


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of the frequent words of each block, by the replies. They are the lists of the phrases of one word too,
    which therefore are left out."""
    for batch in batches:
        for k in range(batch.num_rows):
            (ids,) = unpacked(batch.column("ids")[k].as_py(), np.int32)
            number = np.full(int(ids.max(initial=-1)) + 2, _NONE, np.int64)
            for reply in batch.column("replies")[k].as_py():
                own, known = unpacked(reply, np.int32, np.int64)
                number[own] = known
            places = np.flatnonzero(number[ids] != _NONE)
            yield _state(batch, k, _vertical(number[ids[places]], places), None)


@dataclass(frozen=True)
class Extensions:
    """The phrases of a block, one word longer than its lists: each once, by bucket, phrase and word, with the length of its
    list (n); and of every occurrence its place and its number among them (which)."""

    phrase: np.ndarray
    word: np.ndarray
    n: np.ndarray
    bucket: np.ndarray
    place: np.ndarray
    which: np.ndarray


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _followed(places: np.ndarray) -> np.ndarray:
    """Whether the place after each one is among them."""
    ordered = np.sort(places)
    behind = np.minimum(np.searchsorted(ordered, places + 1), max(len(ordered) - 1, 0))
    return ordered[behind] == places + 1


def extensions(words: bytes, lists: bytes | None, length: int, buckets: int) -> Extensions:
    """Every list's places, length further on, merged with the postings of all frequent words, put in order of place once.

    A phrase is no more frequent than what is left without its first word, so only places count whose next place starts a
    listed phrase too: a merge of the lists with themselves.
    """
    word, times, at = unpacked(words, *LISTS)
    order = np.argsort(at, kind="stable")
    at, behind = at[order], np.repeat(np.arange(len(word)), times)[order]
    phrase, times, places = unpacked(lists or words, *LISTS)
    found = np.minimum(np.searchsorted(at, places + length), max(len(at) - 1, 0))
    met = (at[found] == places + length if len(at) else np.zeros(len(places), bool)) & _followed(places)
    pair = np.repeat(np.arange(len(phrase)), times)[met] * np.int64(len(word)) + behind[found[met]]
    every, which, n = np.unique(pair, return_inverse=True, return_counts=True)
    head, tail = phrase[every // len(word)], word[every % len(word)]
    mixed = (head.view(np.uint64) * _MIX[0]) ^ (tail.view(np.uint64) * _MIX[1])
    bucket = ((mixed ^ (mixed >> np.uint64(32))) * _MIX[0] >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((tail, head, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Extensions(head[order], tail[order], n[order].astype(np.int32), bucket[order].astype(np.int64), places[met], rank[which])


def _sent(length: int, buckets: int):
    """(bucket, block, pairs): of each block the lengths of the lists of all extensions by one word, packed by bucket."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                e = extensions(batch.column("words")[k].as_py(), batch.column("lists")[k].as_py(), length, buckets)
                edges = np.flatnonzero(np.concatenate(([True], e.bucket[1:] != e.bucket[:-1], [True]))) if len(e.bucket) else np.zeros(1, np.int64)
                blobs = [packed(e.phrase[a:z], e.word[a:z], e.n[a:z]) for a, z in zip(edges[:-1], edges[1:])]
                block = np.full(len(blobs), batch.column("block")[k].as_py(), np.int64)
                yield pa.record_batch([pa.array(e.bucket[edges[:-1]], pa.int64()), pa.array(block), pa.array(blobs, pa.binary())], names=["bucket", "block", "pairs"])

    return sent


#: What a bucket gives back: its frequent phrases, and for every block (phrase -1) which of the pairs it sent are among them.
COUNTED = "block long, bucket long, phrase long, word long, f long, id long, reply binary"


def _summed(least: int):
    """Over rows in order of bucket: the exact frequencies, numbers for the frequent phrases, and replies to the blocks."""

    def of_bucket(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(blob, np.int64, np.int64, np.int32) for _, blob in rows]
        phrase, word, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((word, phrase))
        phrase, word = phrase[order], word[order]
        new = np.concatenate(([True], (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])))
        firsts = np.flatnonzero(new)
        f = np.add.reduceat(n[order].astype(np.int64), firsts)
        frequent = f >= least
        ids = np.where(frequent, (np.int64(bucket) << 32) + np.cumsum(frequent), _NONE)
        of_pair = np.empty(len(order), np.int64)
        of_pair[order] = ids[np.cumsum(new) - 1]
        at, replies = 0, []
        for part in parts:
            own = of_pair[at : at + len(part[0])]
            at += len(own)
            there = np.flatnonzero(own != _NONE)
            replies.append(packed(there.astype(np.int32), own[there]))
        m, k = int(frequent.sum()), len(replies)
        hits = firsts[frequent]
        none = np.full(k, _NONE)
        columns = [
            np.concatenate((np.full(m, _NONE), [block for block, _ in rows])), np.full(m + k, bucket), np.concatenate((phrase[hits], none)),
            np.concatenate((word[hits], none)), np.concatenate((f[frequent], none)), np.concatenate((ids[frequent], none)),
        ]
        names = [c.split()[0] for c in COUNTED.split(", ")]
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array([None] * m + replies, pa.binary())], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for bucket, block, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "pairs"))):
                if rows and bucket != last:
                    yield from of_bucket(last, rows)
                    rows = []
                last = bucket
                rows.append((block, blob))
        if rows:
            yield from of_bucket(last, rows)

    return summed


def _longer(length: int, buckets: int, longest: int):
    """Blocks with the lists of the frequent phrases of length + 1 words, by the replies, in place of the shorter ones, and
    the postings at such places alone as longer phrases can reach."""

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("words")[k].as_py()
                e = extensions(words, batch.column("lists")[k].as_py(), length, buckets)
                ids = np.full(len(e.phrase), _NONE, np.int64)
                for reply in batch.column("replies")[k].as_py():
                    there, own = unpacked(reply["reply"], np.int32, np.int64)
                    ids[np.searchsorted(e.bucket, reply["bucket"]) + there] = own
                met = np.flatnonzero(ids[e.which] != _NONE)
                met = met[np.argsort(e.place[met], kind="stable")]
                word, times, at = unpacked(words, *LISTS)
                reached = np.zeros(int(at.max(initial=0)) + longest + 1, bool)
                starts = e.place[met]
                starts = starts[_followed(starts)]
                for d in range(length + 1, longest):
                    reached[starts + d] = True
                order = np.argsort(at, kind="stable")
                order = order[reached[at[order]]]
                yield _state(batch, k, _vertical(np.repeat(word, times)[order], at[order]), _vertical(ids[e.which[met]], e.place[met]))

    return longer


def frequent_phrases(docs: DataFrame, least: int = FREQUENT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of up to longest words that occurs least times, and (lang, n), all words counted.

    Level by level. A block has an inverted list of places for every frequent phrase and the postings of all frequent words.
    Merging each list, moved on by the length of the phrase, with the postings gives the lists of all extensions. Their
    lengths travel packed to buckets of phrases and are added up over the blocks: the exact frequency. Extensions that reach
    least get a number, which goes back to the blocks, and their lists replace the shorter ones. As no part of a frequent
    phrase is rarer than the phrase, nothing else needs lists. Phrases never cross pieces or documents.
    """
    cut = blocks(docs)
    buckets = max(1, -(-(cut.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    sent = cut.select("block", "lang", "words", "numbers").mapInArrow(_words_sent(buckets), "bucket long, lang string, block long, words binary, numbers binary")
    counts = saved(sent.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_words_summed(least), COUNTED_WORDS))
    totals = saved(counts.where("word is null and reply is null").groupBy("lang").agg(F.sum("f").alias("n")))
    level = saved(counts.where("word is not null").select("id", "lang", F.col("word").alias("phrase"), "f"))
    named = level
    levels = [level.select("lang", "phrase", F.lit(1).alias("size"), "f")]
    replies = counts.where("reply is not null").groupBy("block").agg(F.collect_list("reply").alias("replies"))
    state = saved(cut.where("ids is not null").select("block", "ids").join(replies, "block").mapInArrow(_by_word, STATE))
    release(cut)
    release(counts)
    for length in range(1, longest):
        buckets = max(1, -(-(level.agg(F.sum("f")).first()[0] or 0) // BUCKET_PAIRS))
        sent = state.mapInArrow(_sent(length, buckets), "bucket long, block long, pairs binary")
        counts = saved(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed(least), COUNTED))
        frequent = counts.where(F.col("phrase") != _NONE)
        first = level.select(F.col("id").alias("phrase"), "lang", F.col("phrase").alias("head"))
        last = named.select(F.col("id").alias("word"), F.col("phrase").alias("tail"))
        level = saved(frequent.select("phrase", "word", "f", "id").join(first, "phrase").join(last, "word").select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"))
        levels.append(level.select("lang", "phrase", F.lit(length + 1).alias("size"), "f"))
        if length + 1 == longest:
            release(state)
            break
        replies = counts.where(F.col("phrase") == _NONE).groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
        shorter, state = state, saved(state.join(replies, "block").mapInArrow(_longer(length, buckets, longest), STATE))
        release(shorter)
        release(counts)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)), in decimals of 38 digits; as no part is rarer than the whole, the quotient is no more than 10 n."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"cast({wide(a)} * {wide(n)} * 1000 as decimal(38,0)) div cast({wide(left)} * {wide(right)} as decimal(38,0))")


def collocations(docs: DataFrame, least: int = FREQUENT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The phrases of 2 to longest words that hold together best: lang, rank, phrase, a, l, r, n and score.

    A-Z are lower-cased, texts are cut into pieces at [.,;:!?] and line ends and those into words at blanks and tabs.
    Everything is by lang (null: und): n counts all words, a the occurrences of the phrase, of which there are least or
    more. A cut after k words gives l and r, the occurrences of its two sides, and floor(1000 a n / (l r)); the lowest of
    them (then the smallest k) is the score. Phrases go that lie in a longer one that is as frequent. Of the rest, the first
    top of each lang come back, by score and a falling, then phrase in order of bytes. Products are decimals of 38 digits.

    Null and empty texts have no words; repeated rows and ids count each time; a very long text is a block of its own, held
    by one task; a language of few words, like an empty table, gives nothing. Other columns are not looked at.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    phrases = saved(phrases)
    words = F.split("phrase", " ")
    cuts = (
        phrases.where("size > 1")
        .select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .select("lang", "phrase", "size", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size)"), " ").alias("right"))
    )
    counts = phrases.select("lang", "phrase", "f")
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", score("a", "n", "l", "r"))
        .groupBy("lang", "phrase", "size", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    ends = F.explode(F.array(F.array_join(F.expr("slice(w, 1, size - 1)"), " "), F.array_join(F.expr("slice(w, 2, size - 1)"), " "))).alias("phrase")
    inside = phrases.where("size > 2").select("lang", words.alias("w"), "size", F.col("f").alias("a")).select("lang", ends, "a").distinct()
    left = scored.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = left.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("k") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
