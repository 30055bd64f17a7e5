"""A census that is kept as sketches: each snapshot's are stored, and any of them are united without its files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a hash that choose a register, bins for each doubling of size, files kept as largest and as representatives.
PRECISION, BINS, LARGEST, REPRESENTATIVES = 14, 32, 100, 200
#: Percentiles, size classes (MiB, up to), ages (days, up to) and path classes.
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
SIZES = ((1, "0-1MiB"), (20, "1-20MiB"), (250, "20-250MiB"))
LARGE, HUGE = "250MiB-2GiB", ">2GiB"
AGES = ((7, "<=7d"), (30, "8-30d"), (90, "31-90d"), (365, "91-365d"))
OLD = ">365d"
CLASSES = ((r"(?:^|/)(?:archive|archived|history|old)(?:/|$)", "archive"), (r"(?:^|/)(?:authority|official|signed|approved)(?:/|$)", "authority"))
#: Hexadecimal digits of a similarity fingerprint that count: its first 48 bits.
NEAR_DIGITS = 12


def size_class(size: Column) -> Column:
    mib = size / (1024 * 1024)
    return reduce(lambda rest, s: F.when(mib < s[0], s[1]).otherwise(rest), reversed(SIZES), F.when(mib <= 2048, LARGE).otherwise(HUGE))


def age_class(modified: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(modified.cast("timestamp"))) / 86_400e6)
    return reduce(lambda rest, a: F.when(days <= a[0], a[1]).otherwise(rest), reversed(AGES), F.lit(OLD))


def source_class(path: Column) -> Column:
    return reduce(lambda rest, c: F.when(F.lower(path).rlike(c[0]), c[1]).otherwise(rest), reversed(CLASSES), F.lit("current"))


def register(value: Column) -> tuple[Column, Column]:
    """Which register a value falls to, by the first bits of its SHA-256, and its rank: the place of the first 1 in the next 50."""
    digest = F.sha2(value, 256)
    high, low = (F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(2))
    rest = 32 - PRECISION
    first = high.bitwiseAND(F.lit((1 << rest) - 1))
    place = lambda x, bits: bits - F.length(F.bin(x)) + 1
    rank = F.when(first > 0, place(first, F.lit(rest))).when(low > 0, rest + place(low, F.lit(32))).otherwise(rest + 33)
    return F.shiftright(high, rest).cast("int"), rank.cast("int")


def sketched(files: DataFrame) -> DataFrame:
    """The sketches of a snapshot as rows (kind, key, n, path): what a file adds is a few of them, and equal keys are one row.

    files has path, size, modified_at, scanned_at, content_sha256 and similarity (16 hex digits). Kinds: files and bytes (sums),
    size, age and class (counts), bin (counts by size), exact and near (registers: the greatest rank), largest (size)
    and sample (hash of the path). Null sizes and hashes add nothing to what they bear on.
    """
    files = files.where("path is not null")
    exact, near = register(F.col("content_sha256")), register(F.concat(F.substring("similarity", 1, NEAR_DIGITS), F.lit("0" * (16 - NEAR_DIGITS))))
    size = F.col("size")
    bin_ = F.when(size.isNotNull(), F.least(F.lit(1023), F.floor(F.log2(size + 1) * BINS)).cast("string"))
    sized, aged = F.when(size.isNotNull(), size_class(size)), F.when(F.col("modified_at").isNotNull(), age_class(F.col("modified_at"), F.col("scanned_at")))
    text = lambda c: c.cast("string")
    item = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.cast("long").alias("n"))
    none = F.lit("")
    counts = F.array(
        item("files", none, F.lit(1)), item("bytes", none, size), item("size", sized, F.lit(1)), item("age", aged, F.lit(1)),
        item("class", source_class(F.col("path")), F.lit(1)), item("bin", bin_, F.lit(1)), item("exact", text(exact[0]), exact[1]), item("near", text(near[0]), near[1]),
    )
    rows = files.select(F.explode(counts).alias("c")).select("c.*").where("key is not null and n is not null").withColumn("path", F.lit(None).cast("string"))
    largest = files.where("size is not null").orderBy(F.col("size").desc(), "path").limit(LARGEST).select(F.lit("largest").alias("kind"), F.lit("").alias("key"), size.cast("long").alias("n"), "path")
    sample = files.select(F.lit("sample").alias("kind"), F.sha2("path", 256).alias("key"), size.cast("long").alias("n"), "path").orderBy("key", "path").limit(REPRESENTATIVES)
    return united([rows, largest, sample])


def united(sketches: list[DataFrame]) -> DataFrame:
    """The sketches of several snapshots as one: the same rows as those of all their files together."""
    every = reduce(DataFrame.unionByName, sketches)
    merged = every.where("path is null").groupBy("kind", "key").agg(F.when(F.col("kind").isin("exact", "near"), F.max("n")).otherwise(F.sum("n")).alias("n"))
    largest = every.where("kind = 'largest'").orderBy(F.col("n").desc(), "path").limit(LARGEST)
    sample = every.where("kind = 'sample'").orderBy("key", "path").limit(REPRESENTATIVES)
    return merged.withColumn("path", F.lit(None).cast("string")).unionByName(largest).unionByName(sample)


def estimate(ranks: Column, filled: Column) -> Column:
    """The distinct values that registers tell of: ranks is the sum of 2^-rank of those that are filled."""
    m = float(1 << PRECISION)
    inverse = ranks + (m - filled)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / inverse
    return F.when((raw <= 2.5 * m) & (filled < m), m * F.log(m / F.nullif(m - filled, F.lit(0.0)))).otherwise(raw)


def summary(sketch: DataFrame) -> DataFrame:
    """One row: files, bytes, largest, percentiles of size from the bins (a bin's middle), and the rates of exact and near copies.

    A rate is 1 less the estimated distinct over the files, at least 0; the near rate is at least the exact one. Sketches are
    a fixed number of rows however many files they tell of. No files: zeros.
    """
    of = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
    powers = {k: (F.sum(F.when(F.col("kind") == k, F.pow(F.lit(2.0), -F.col("n")))), F.sum((F.col("kind") == k).cast("double"))) for k in ("exact", "near")}
    sums = sketch.agg(
        F.coalesce(F.sum(of("files")), F.lit(0)).alias("files"), F.coalesce(F.sum(of("bytes")), F.lit(0)).alias("bytes"), F.coalesce(F.max(of("largest")), F.lit(0)).alias("largest"),
        *[F.coalesce(x, F.lit(0.0)).alias(f"{k}_{n}") for k, pair in powers.items() for n, x in zip(("ranks", "filled"), pair)],
    )
    bins = sketch.where("kind = 'bin'").select(F.col("key").cast("int").alias("bin"), "n")
    upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin")))  # 1,024 bins at most
    total = F.max("upto").over(Window.partitionBy(F.lit(0)))
    edges = upto.withColumn("total", total)
    middle = lambda b: F.round(F.pow(F.lit(2.0), (b + 0.5) / BINS) - 1).cast("long")
    shares = edges.agg(*[F.coalesce(middle(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * s)), F.col("bin")))), F.lit(0)).alias(p) for p, s in SHARES.items()])
    files = F.col("files")
    rate = lambda k: F.when(files > 0, 1 - F.least(files.cast("double"), estimate(F.col(f"{k}_ranks"), F.col(f"{k}_filled"))) / files).otherwise(0.0)
    exact = F.greatest(F.lit(0.0), rate("exact"))
    return sums.join(shares).select("files", "bytes", "largest", *SHARES, F.round(exact, 6).alias("exact_rate"), F.round(F.greatest(exact, rate("near")), 6).alias("near_rate"))
