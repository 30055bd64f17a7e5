"""What suffix-tree and suffix-array deduplication share: finding, gathering and judging repeated windows of tokens.

Documents are dealt out once, evenly, into blocks of a few MB. Three passes read those blocks:

1. Each window of L tokens is assigned an anchor, the k-token prefix inside it with the smallest hash (leftmost of ties).
   Equal windows have equal anchors at equal places. The windows of a run that share an anchor make one context; a block
   sends the anchor and the 128-bit BLAKE2 digest of each of its contexts.
2. Anchors that occur once in the corpus prove their windows unique. Of the others, the first occurrence of each distinct
   context is sent, by its block, to the partition of its anchor prefix, where a suffix structure judges its windows.
   Prefixes vary in length: one that more than MOST distinct contexts share is lengthened, and its contexts are cut
   again into runs that share the longer prefix, until the groups fit or the prefix is the whole window.
3. The verdicts come back to the blocks, which remove what they say.

Anchors, the distinct contexts of repeated anchors and the verdicts are all that is shuffled besides the one dealing of
the texts. How much there is of each grows with the corpus and not with the number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bytes of text in a block, of contexts in a group, and of contexts that are judged at once.
BLOCK_BYTES, GROUP_BYTES, PART_BYTES = 2 << 20, 4 << 20, 1 << 20
#: A prefix that more distinct contexts than this share is lengthened.
MOST = 4096
#: The place of a document without a doc_id: after all others.
LAST = 2**63 - 1
#: A context: its prefix, digest, copies (in the block, or in the corpus), and its first place: block, document, window and windows.
CONTEXT = "b int, key long, d1 long, d2 long, n long, doc long, lo int, size int"
VERDICT = "b int, lo int, size int, bits binary"

_BASE, _INVERSE, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64), 0xC2B2AE3D27D4EB4F))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its length before it, compressed."""
    raw = b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def rolling(a: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every run of length tokens, from differences of running sums; entries near the end are zero."""
    n, out = len(a), np.zeros(len(a), np.uint64)
    if n < length:
        return out
    power = lambda base: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a * power(_BASE))))
    h = (total[length:] - total[:-length]) * power(_INVERSE)[: n - length + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    out[: len(h)] = h
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width neighbours from each place on; entries near the end mean nothing."""
    best, size = h.copy(), 1
    while size * 2 <= width:
        np.minimum(best[:-size], best[size:], out=best[:-size])
        size *= 2
    rest = width - size
    if rest:
        best[:-rest] = np.minimum(best[:-rest], best[rest:])
    return best


@dataclass
class Runs:
    """Windows lo..hi (places in the block) that share an anchor, and its hash."""

    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray


def find_runs(tokens: np.ndarray, sizes: np.ndarray, length: int, anchor: int) -> Runs:
    """The runs of a block of documents with the given token counts, laid end to end.

    A window's anchor is the leftmost of its places whose hash is smallest in the upper 32 bits: with the place in the
    lower ones, a minimum over the window's places tells it. What it hangs on is inside the window alone.
    """
    long = sizes >= length
    if not long.any():
        return Runs(*(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64))
    h = rolling(tokens, anchor)
    least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
    counts = (sizes - length + 1)[long]
    windows = _spread((np.cumsum(sizes) - sizes)[long], counts)
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    last = np.append(new[1:], len(windows)) - 1
    return Runs(windows[new], windows[last], h[at[new]])


@dataclass
class Block:
    """Documents as tokens laid end to end: token k is raw[starts[k]:stops[k]], its hash is hashes[k]; sizes are theirs in tokens."""

    raw: bytes
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    doc: np.ndarray | None = None
    known: np.ndarray | None = None

    def doc_ids(self) -> pd.array:
        """The doc_id of every document, missing where it is not known."""
        return pd.arrays.IntegerArray(self.doc, ~self.known)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The number of the document at places."""
        return np.searchsorted(np.cumsum(self.sizes), places, side="right")


@dataclass(frozen=True)
class Method:
    """How texts become tokens, how long windows and their prefixes are, and how the contexts of a group are judged.

    classes(contexts, keys) gives, for every window of the contexts in turn, a number, equal where windows are equal; the
    contexts come in the order of keys, and only windows of one key can be equal.
    keep_first: whether the first occurrence of a window stays, or every occurrence goes.
    """

    length: int
    prefixes: tuple[int, ...]
    block: Callable[[list[bytes]], Block]
    classes: Callable[[list[bytes], np.ndarray], np.ndarray]
    finish: Callable[[Block, np.ndarray], pd.DataFrame]
    keep_first: bool

    def blocked(self, pdf: pd.DataFrame) -> Block:
        """A block's documents, by doc_id, then by a hash of their texts, or by place in the table where ids are missing."""
        pdf = pdf.sort_values(["doc", "row"], kind="stable")
        block = self.block([t.encode("utf-8", "surrogatepass") for t in pdf["text"]])
        block.doc, block.known = pdf["doc"].to_numpy(np.int64), pdf["known"].to_numpy(bool)
        return block

    def contexts(self, block: Block, prefix: int) -> tuple[Runs, Callable[[int], bytes]]:
        """The runs of windows of a block that share a prefix, and what cuts out the text of run r."""
        runs = find_runs(block.hashes, block.sizes, self.length, prefix)
        a, z = block.starts[runs.lo].tolist(), block.stops[runs.hi + self.length - 1].tolist()
        return runs, lambda r: block.raw[a[r] : z[r]]


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places lo, lo + 1, ... of each run, size of them."""
    size = size.astype(np.int64)
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _columns(b: int, block: Block, runs: Runs, at: np.ndarray, digests: list[bytes], n: np.ndarray) -> dict:
    """The columns of CONTEXT for the runs at the numbers at."""
    halves = _halves(digests)
    return {
        "b": b, "key": runs.key[at].view(np.int64), "d1": halves[:, 0], "d2": halves[:, 1], "n": n,
        "doc": block.doc[block.owner(runs.lo[at])], "lo": runs.lo[at], "size": runs.hi[at] - runs.lo[at] + 1,
    }


def _announce(method: Method) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def announce(pdf: pd.DataFrame) -> pd.DataFrame:
        """The distinct contexts of a block, each with its first place there and the number of its copies."""
        block = method.blocked(pdf)
        runs, text = method.contexts(block, method.prefixes[0])
        first: dict[bytes, int] = {}
        which = np.fromiter((first.setdefault(digest(text(r)), r) for r in range(len(runs.lo))), np.int64, len(runs.lo))
        at = np.fromiter(first.values(), np.int64, len(first))
        return pd.DataFrame(_columns(pdf["b"].iloc[0], block, runs, at, list(first), np.bincount(which, minlength=len(runs.lo))[at]))

    return announce


def elected(contexts: DataFrame) -> DataFrame:
    """Contexts whose prefix occurs more than once, with the copies of each in the corpus (n), whether the row is its first
    occurrence (first) and how many distinct contexts share the prefix (variants). The rows are of a fixed small size."""
    same, prefix = Window.partitionBy("key", "d1", "d2"), Window.partitionBy("key")
    return (
        contexts.repartition("key")
        .withColumn("first", F.row_number().over(same.orderBy("doc", "b", "lo")) == 1)
        .withColumn("copies", F.sum("n").over(same))
        .withColumn("all", F.sum("n").over(prefix))
        .withColumn("variants", F.sum(F.col("first").cast("int")).over(prefix))
        .where("all > 1")
        .drop("n", "all")
        .withColumnRenamed("copies", "n")
    )


def _send(method: Method) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    names = ["b", "key", "n", "doc", "lo", "size", "variants", "body"]

    def send(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The texts of the contexts that this block has first, and in one row the places of copies of known contexts."""
        if not len(docs) or not len(found):
            return pd.DataFrame([], columns=names)
        block, b = method.blocked(docs), int(docs["b"].iloc[0])
        runs, text = method.contexts(block, method.prefixes[0])
        halves = np.stack((found["d1"].to_numpy(), found["d2"].to_numpy()), axis=1)
        known = {h.tobytes(): k for k, h in enumerate(halves)}
        first, n, variants = found["first"].to_numpy(), found["n"].to_numpy(), found["variants"].to_numpy()
        at, which, texts, copies = [], [], [], []
        taken: set[int] = set()
        for r in np.flatnonzero(np.isin(runs.key.view(np.int64), found["key"].to_numpy())).tolist():
            body = text(r)
            k = known[digest(body)]
            if first[k] and k not in taken:
                taken.add(k)
                at.append(r)
                which.append(k)
                texts.append(body)
            else:
                copies.append(r)
        at, which, copies = (np.array(x, np.int64) for x in (at, which, copies))
        columns = _columns(b, block, runs, at, [b"\0" * 16] * len(at), n[which])
        out = pd.DataFrame({c: columns[c] for c in names[:6]} | {"variants": variants[which], "body": texts})
        if len(copies):
            places = pack(runs.lo[copies].astype(np.int32), (runs.hi - runs.lo + 1)[copies].astype(np.int32))
            out = pd.concat([out, pd.DataFrame([(b, None, None, None, None, None, None, places)], columns=names)])
        return out.astype({c: "Int64" for c in names[:-1]})

    return send


def _judge(method: Method) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each context of a group a bit per window: whether it goes. Contexts without such a window give no row."""
        pdf = pdf.sort_values(["key", "doc", "b", "lo"], kind="stable")
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        bodies = [bytes(x) for x in pdf["body"]]
        keys, total, gone = pdf["key"].to_numpy(np.int64), np.cumsum([len(x) for x in bodies]), []
        # parts of about PART_BYTES, cut where a key begins: windows of different keys differ
        marks = np.searchsorted(total, np.arange(PART_BYTES, total[-1], PART_BYTES))
        cuts = sorted({0, len(pdf), *np.searchsorted(keys, keys[marks]).tolist()})
        for a, z in zip(cuts[:-1], cuts[1:]):
            kind = method.classes(bodies[a:z], keys[a:z])
            sizes = size[a:z]
            if method.keep_first:
                rank = np.lexsort((pdf["lo"].to_numpy()[a:z], pdf["b"].to_numpy()[a:z], pdf["doc"].to_numpy()[a:z]))
                place = np.empty(z - a, np.int64)
                place[rank] = np.arange(z - a)
                order = np.lexsort((np.arange(sizes.sum()), np.repeat(place, sizes), kind))
                flags = np.empty(len(kind), bool)
                flags[order] = np.concatenate(([False], kind[order][1:] == kind[order][:-1]))
            else:
                flags = np.bincount(kind, np.repeat(n[a:z], sizes).astype(float))[kind] > 1
            gone.append(flags)
        gone = np.concatenate(gone)
        ends = np.cumsum(size)
        bits = [np.packbits(gone[a:z]).tobytes() if gone[a:z].any() else None for a, z in zip((ends - size).tolist(), ends.tolist())]
        return pd.DataFrame({"b": pdf["b"].to_numpy(), "lo": pdf["lo"].to_numpy(), "size": size, "bits": bits}).dropna(subset=["bits"])

    return judge


def judged(sent: DataFrame, method: Method) -> DataFrame:
    """The verdicts on distinct contexts, in groups of prefixes whose contexts have about GROUP_BYTES together."""
    total = sent.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = sent.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(1 + total // GROUP_BYTES)))
    return groups.select("g", "b", "key", "n", "doc", "lo", "size", "body").groupBy("g").applyInPandas(_judge(method), VERDICT)


def _lengthened(method: Method, prefix: int) -> Callable:
    def cut(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                bodies = [bytes(x) for x in part["body"]]
                block = method.block(bodies)
                runs, text = method.contexts(block, prefix)
                own = block.owner(runs.lo)
                texts = [text(r) for r in range(len(runs.lo))]
                halves = _halves([digest(t) for t in texts])
                first = (np.cumsum(block.sizes) - block.sizes)[own]
                yield pd.DataFrame(
                    {
                        "b": part["b"].to_numpy()[own], "key": runs.key.view(np.int64), "d1": halves[:, 0], "d2": halves[:, 1], "n": part["n"].to_numpy()[own],
                        "doc": part["doc"].to_numpy()[own], "lo": part["lo"].to_numpy()[own] + runs.lo - first, "size": runs.hi - runs.lo + 1, "body": texts,
                    }
                )

    return cut


def verdicts(sent: DataFrame, method: Method, most: int) -> DataFrame:
    """The verdicts on all contexts that were sent; prefixes that too many of them share are lengthened step by step."""
    pending = sent.where("key is not null")
    out = judged(pending.where(F.col("variants") <= most), method)
    pending = pending.where(F.col("variants") > most)
    for prefix in method.prefixes[1:]:
        if pending.isEmpty():
            break
        names = "b", "key", "n", "doc", "lo", "size", "body"
        parts = saved(elected(pending.select(*names).mapInPandas(_lengthened(method, prefix), CONTEXT + ", body binary")))
        # what is not the first of its kind goes whole
        ones = F.lit(b"\xff" * ((method.length + 7) // 8))
        out = out.unionByName(parts.where("not first").select("b", "lo", "size", ones.alias("bits")))
        fits = F.lit(True) if prefix == method.prefixes[-1] else F.col("variants") <= most
        out = out.unionByName(judged(parts.where("first").where(fits), method))
        pending = parts.where("first").where(~fits)
    return out


def _finish(method: Method) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def finish(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        block = method.blocked(docs)
        n = len(block.starts)
        gone = np.zeros(n, bool)
        copies = found["size"].isna()
        for body in found.loc[copies, "bits"]:
            gone[_spread(*unpack(body, np.int32, np.int32))] = True
        some = found[~copies]
        if len(some):
            size = some["size"].to_numpy(np.int64)
            flags = [np.unpackbits(np.frombuffer(x, np.uint8))[:k] for x, k in zip(some["bits"], size.tolist())]
            gone[_spread(some["lo"].to_numpy(np.int64), size)[np.concatenate(flags).astype(bool)]] = True
        change = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(gone)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + method.length, -1)
        return method.finish(block, np.cumsum(change[:-1]) > 0)

    return finish


def removed(docs: DataFrame, method: Method, schema: str, block_bytes: int = BLOCK_BYTES, most: int = MOST) -> DataFrame:
    """Run the three passes over docs (doc_id, text) and return what method.finish makes of each block.

    Null texts count as empty. Rows without a doc_id come after all others; rows of one doc_id follow each other in the
    order of a hash of their texts. The dealt-out texts are one exchange that all three passes read. Rows are dealt by
    doc_id and text, so that every evaluation deals them alike, whatever order the source gives them in, and copies under
    different ids fall to different blocks. Rows without a doc_id, of which copies could fill a block, are dealt by their
    place in the table.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.when(F.col("known"), F.xxhash64("text")).otherwise(F.monotonically_increasing_id()))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(2 * partitions, -(-size // block_bytes))
    by_block = texts.withColumn("b", F.pmod(F.xxhash64("doc", "row"), F.lit(blocks)).cast("int")).repartition("b").groupBy("b")
    found = elected(by_block.applyInPandas(_announce(method), CONTEXT)).select("b", "key", "d1", "d2", "n", "first", "variants")  # reads the exchange that the next line reads
    sent = saved(by_block.cogroup(found.groupBy("b")).applyInPandas(_send(method), "b int, key long, n long, doc long, lo int, size int, variants long, body binary"))
    copies = sent.where("key is null").select("b", "lo", "size", F.col("body").alias("bits"))
    return by_block.cogroup(verdicts(sent, method, most).unionByName(copies).groupBy("b")).applyInPandas(_finish(method), schema)
