"""Shared helpers of the training-data operators: tables, materialised steps, byte-level numpy kernels."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.steps import new_path, remove, save

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch. By rows alone (10,000), a batch of long texts takes hundreds of MB in the JVM and in Python.
BATCH = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Batches sent to Python end after BATCH bytes (or one longer row), so a task's memory does not follow text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


class Steps:
    """Written tables in the shared folder. They cut the lineage and survive lost executors; `drop` frees those used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        bounded_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        save(df, path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and the int64 offsets of each; null counts as empty. No Python strings are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int):
    """Ranges (i, j) of rows of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Spans longer than this are hashed one by one, so that a round below never serves one long span alone.
LONG = 2048


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes first to last (excluded) of each span.

    Eight bytes at a time go into the hash so far, which is scrambled each time. That is not linear in the bytes, so no
    pattern of texts collides by construction, as it does under polynomials modulo 2^64.
    """
    size = (last - first).astype(np.int64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))
    salts = constants(2, 61 + seed)
    out = mix(size.astype(np.uint64) * salts[0] + salts[1])
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[first[k] : last[k]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        chunk = eight[first[live] + at]
        part = left < 8
        chunk[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] ^ chunk)
        live, at = live[left > 8], at + 8
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits parts words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased (A-Z) words of the rows in `data`, and the word offsets of each row.

    between: for each byte, whether it parts words.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(_LOWER[data], first, last), np.searchsorted(first, offsets)


def _stars(e: DataFrame) -> bool:
    """Whether every node of the edges (a, b), a > b, hangs on one node, which hangs on none."""
    ends = e.select(F.col("a").alias("node"), "b").union(e.select("b", F.lit(None).cast("long")))
    odd = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n"), F.count("b").alias("up"))
    return odd.where("low <> high or (up > 0 and up < n)").isEmpty()


def connected_components(steps: Steps, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star until all is stars: each round hangs neighbours on the smallest one seen, so
    paths halve. Each round is a written table of at most as many edges as there were.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    k = 0
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        k += 1
        e = steps.write(small.where("a <> b").distinct(), f"{name}-{k}")
        if k > 1:
            steps.drop(f"{name}-{k - 1}")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


#: A hash sets the bits named by its bits from these places on.
PROBES = (0, 20, 40)


def bitmap(df: DataFrame, column: str, per_hash: int = 16, most: int = 1 << 28) -> np.ndarray:
    """A Bloom filter of 64-bit hashes with `per_hash` bits for each, but `most` at most (32 MB): that bounds what is
    sent to tasks. It says yes to every member. Fuller than planned it only says yes more often; an exact join follows.
    """
    bits = 1 << 20
    n = df.count()
    while bits < min(per_hash * n, most):
        bits *= 2
    at = df.select(F.explode(F.array(*[F.shiftrightunsigned(F.col(column), p) for p in PROBES])).alias("h")).select(F.pmod("h", F.lit(bits)).alias("at"))
    words = at.select((F.col("at") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in it."""
    hashes, mask = hashes.astype(np.int64, copy=False).view(np.uint64), np.uint64(64 * len(bits) - 1)
    left = None
    for p in PROBES:
        at = ((hashes if left is None else hashes[left]) >> np.uint64(p)) & mask
        yes = np.flatnonzero((bits[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
        left = yes if left is None else left[yes]
    return left


class Maybe:
    """A bitmap in the tasks. `holds` is a column function: whether a hash may be in it; null is not. `end` frees it once
    what asked for it is written: it can be sent anew until then, should an executor be lost."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self.shared = shared = spark.sparkContext.broadcast(bits)

        @F.pandas_udf("boolean")
        def found(hashes: pd.Series) -> pd.Series:
            out = np.zeros(len(hashes), bool)
            out[in_bitmap(shared.value, hashes.fillna(0).to_numpy(np.int64))] = True
            return pd.Series(out & hashes.notna().to_numpy())

        self.holds = found

    def end(self) -> None:
        self.shared.destroy()


def maybe_in(spark: SparkSession, bits: np.ndarray):
    """The same column function, for plans that the caller runs later; the bitmap goes when it is no longer referred to."""
    return Maybe(spark, bits).holds
