"""Spelling variants: automata over both halves of every word find the words at an edit distance of one."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Code points and occurrences that a word has at least; how much more frequent a word's form is.
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: A run goes through a planted slip where this divides its checksum.
SLIP = 199
#: Characters by which halves are dealt to shards, and the words of one such group, or of small groups together, in one automaton.
START, SHARD_WORDS = 3, 40_000
#: Distinct words that a task counts before it sends the counts on.
HELD_WORDS = 500_000

#: Runs of letters of A to z and of the Latin-1 letters block, signs of multiplication and division included; A-Z are a-z already.
RUN = re.compile("[a-zÀ-ÿ]+")


def slipped(run: str, checksum: int) -> str:
    """The run without one code point if SLIP divides the checksum (of doc_id and run), else as it is."""
    if checksum % SLIP:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{doc_id.as_py()}:".encode()) if doc_id.is_valid else None
            for run, n in Counter(RUN.findall(text.as_py().lower().decode("utf-8", "surrogatepass"))).items():
                found[run if seed is None else slipped(run, zlib.crc32(run.encode(), seed))] += n
            if len(found) >= HELD_WORDS:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n): the distinct words of so many code points and occurrences, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").where(F.char_length("word") >= chars)
    return saved(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def halves(word: str) -> tuple[str, str]:
    """A word's two segments, the first the shorter one; ^ and $ stand for its ends, which hold a segment to its offset."""
    half = len(word) // 2
    return "^" + word[:half], word[half:] + "$"


def starts(word: str) -> list[str]:
    """The groups in which a word can meet the halves of another one at distance one: a group is ^ or $ and the first
    START characters of the half. The first half of such a word begins where this word begins; the second half ends where
    it ends and is as long as that of a word one character shorter or longer."""
    n = len(word)
    return ["^" + word[:START], *{"$" + word[n - size :][:START] for length in (n - 1, n, n + 1) if 2 <= (size := length - length // 2) <= n}]


class Shard:
    """An automaton over halves of words, and for every half what stands at the other side of it.

    A word that holds a half at its offset, with one edit in the other half, has an other half at distance one. That is told
    by deletions: two strings are at distance one if one is the other less one character, or if both are equal less
    one character at the same place. So a hit is verified by a few looks at the words with that half, however many there are.
    """

    def __init__(self, holders: list[tuple[str, int, bool]]):
        """holders: word, its count, and whether it is here with its first half."""
        self.words = holders
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[tuple[int, str], int] = {}
        self.shorter: dict[tuple[int, str], set[int]] = defaultdict(set)
        self.replaced: dict[tuple[int, int, str], list[int]] = defaultdict(list)
        numbers: dict[str, int] = {}
        for k, (word, _, first) in enumerate(holders):
            one, two = halves(word)
            half, rest = (one, two[:-1]) if first else (two, one[1:])
            at = numbers.setdefault(half, len(numbers))
            self.whole[at, rest] = k
            for i in range(len(rest)):
                less = rest[:i] + rest[i + 1 :]
                self.shorter[at, less].add(k)
                self.replaced[at, i, less].append(k)
        for half, at in numbers.items():
            self.automaton.add_word(half, (at, half))
        if numbers:
            self.automaton.make_automaton()

    def near(self, word: str) -> set[int]:
        """The holders that differ from word by one edit outside their half; each pair once, over all shards.

        Where both halves of a holder are in the word at their offsets, only its first half counts.
        """
        found: set[int] = set()
        for end, (at, half) in self.automaton.iter(f"^{word}$") if self.words else ():
            size = len(half) - 1
            first = half[0] == "^"
            if end != (size if first else len(word) + 1):  # the offset
                continue
            rest = word[size:] if first else word[: len(word) - size]
            for k in self._by_rest(at, rest):
                other = self.words[k][0]
                if not -1 <= len(other) - len(word) <= 1 or len(other) // 2 != (size if first else len(other) - size):
                    continue
                if first or not word.startswith(other[: len(other) // 2]):
                    found.add(k)
        return found

    def _by_rest(self, at: int, rest: str) -> Iterator[int]:
        yield from self.shorter.get((at, rest), ())
        for less in {rest[:i] + rest[i + 1 :] for i in range(len(rest))}:
            if (k := self.whole.get((at, less))) is not None:
                yield k
        same = self.whole.get((at, rest))
        for i in range(len(rest)):
            for k in self.replaced.get((at, i, rest[:i] + rest[i + 1 :]), ()):
                if k != same:
                    yield k


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of shard, holders first: for every word that is scanned how many holders are near, and the best."""
    shard, holders, automaton = None, [], None
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for place, holder, word, n, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "holder", "word", "n", "first"))):
            if place != shard:
                shard, holders, automaton = place, [], None
            if holder:
                holders.append((word, n, first))
                continue
            if automaton is None:
                automaton, holders = Shard(holders), []
            if near := automaton.near(word):
                most, form = min((-automaton.words[k][1], automaton.words[k][0]) for k in near)
                out.append((word, len(near), form, -most))
        words, counts, forms, most = zip(*out) if out else ((), (), (), ())
        yield pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(most, pa.int64())], names=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words; form is the most frequent of them, ties to the smallest.

    Every word's halves go to the group of their kind and first START characters. Groups are counted: a large one is cut
    into parts of about shard_words, small ones share a shard. Each word then is scanned by the automata of the groups that
    can hold a half of a near word, in every part of them, as a stream: a task holds one automaton and no group.
    """
    both = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    half = F.floor(F.char_length("word") / 2).cast("int")
    begin = F.when(F.col("first"), F.concat(F.lit("^"), F.substring("word", 1, START))).otherwise(F.concat(F.lit("$"), F.expr("word").substr(half + 1, F.lit(START))))
    holders = saved(both.withColumn("start", begin))
    groups = saved(holders.groupBy("start").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / shard_words)))
    total = groups.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    place = lambda part: F.when(F.col("parts") == 1, F.concat_ws(":", F.pmod(F.xxhash64("start"), F.lit(shards)))).otherwise(F.concat_ws(":", "start", part))
    held = holders.join(groups, "start").select(place(F.pmod(F.xxhash64("word"), "parts")).alias("shard"), F.lit(True).alias("holder"), "word", "n", "first")
    n = F.char_length("word")
    tail = lambda m: F.concat(F.lit("$"), F.expr("word").substr(n - F.ceil((n + m) / 2).cast("int") + 1, F.lit(START)))
    routes = F.array_distinct(F.array(F.concat(F.lit("^"), F.substring("word", 1, START)), tail(-1), tail(0), tail(1)))
    sent = words.select("word", F.explode(routes).alias("start")).join(groups, "start").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    scans = sent.select(place(F.col("part")).alias("shard"), F.lit(False).alias("holder"), "word", F.lit(0).cast("long").alias("n"), F.lit(False).alias("first")).distinct()
    dealt = held.unionByName(scans).repartition("shard").sortWithinPartitions("shard", F.desc("holder"))
    met = dealt.mapInArrow(_scanned, "word string, n_near long, form string, form_n long")
    best = F.struct((-F.col("form_n")).alias("most"), "form")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best")).select("word", "n_near", "best.form", (-F.col("best.most")).alias("form_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by doubling: counts grow along forms, so there is no circle, and few steps are needed."""
    now = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = saved(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, least: int = LEAST_COUNT, chars: int = LEAST_CHARS, times: int = TIMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per distinct word: word, n, n_near, form, form_n and root.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of which one code point is left out where SLIP
    divides the CRC-32 of `<doc_id>:<run>`; they count from chars code points and least occurrences on. Near words differ by
    one code point inserted, deleted or replaced. A word's form is its near word of largest n (ties: the smallest), if that
    is times its n or more, else null with form_n; root follows forms to the end.

    Null texts have no words; in rows without a doc_id nothing is left out; repeated rows count each time; a very long text
    is read whole by one task. An empty table gives an empty result. Other columns are not looked at.
    """
    words = vocabulary(docs, least, chars)
    near = near_words(words, shard_words)
    fits = F.col("form_n") >= times * F.col("n")
    named = saved(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")
        )
    )
    roots = _rooted(named.where("form is not null"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
