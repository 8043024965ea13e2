"""Near-duplicate embeddings by cross-polytope hashing.

A vector, zero-padded to a power of two, is turned by three rounds of random signs and a fast Hadamard transform; its hash
is the signed axis nearest to it. DEPTH such hashes make a key, TABLES independent keys a vector. A vector stands in the
bucket of its own key and, as a probe, in the buckets of the PROBES keys that are next nearest; two vectors meet where one
of them has its own key. Each pair that meets is verified by its cosine in double precision.

Vectors alike in every component are one vector from the start. Large buckets are dealt out in blocks of about BLOCK
vectors, block against block. A pair that meets in several buckets counts in the first one, which every task works out
from the two vectors alone; so pairs are never written out: tasks return each vector's links and a spanning forest.

Measured for pairs at cosine 0.95 in 64 dimensions: one table misses 40 of 100, all 16 about 1 in 2,000,000. Longer keys
(from 2,097,152 vectors on) and more dimensions miss more in one table, so there are more tables then (`tables_for`).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import Steps, connected_components, constants, mix, partitions, table

TABLES, DEPTH, PROBES, BLOCK = 16, 3, 3, 512
#: Runner-up axes looked at in each hash for the probes.
RUNNERS = 3
#: A pair at the least cosine meets in no table with this chance at most, whatever the depth and the dimensions.
MISSED = 7e-7
#: Random pairs, and tables for each, from which one table's misses are measured.
TRIED = 4096, 8


def _turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for round_ in signs:
        x = x * round_
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(x.shape)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def keys(x: np.ndarray, depth: int, tables: int = TABLES) -> np.ndarray:
    """Bucket ids (vector, table, own key and then its probes) of unit vectors of one dimension."""
    d = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(20_05)
    combos = [c for c in itertools.product(range(min(RUNNERS + 1, d)), repeat=depth) if 0 < sum(map(bool, c)) <= 2]
    own = constants(depth, 41)
    out = np.empty((len(x), tables, PROBES + 1), np.uint64)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(depth):
            y = _turned(x, rng.choice([-1.0, 1.0], (3, d)))
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, : RUNNERS + 1]
            top = np.take_along_axis(size, near, 1)
            axes.append((near * 2 + (np.take_along_axis(y, near, 1) < 0)).astype(np.uint64))
            gaps.append((top[:, :1] - top) ** 2)
        cost = np.stack([sum(g[:, k] for g, k in zip(gaps, c)) for c in combos], 1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        base = sum(a[:, 0] * w for a, w in zip(axes, own))
        out[:, t, 0] = base
        every = np.stack([sum(a[:, k] * w for a, k, w in zip(axes, c, own)) for c in combos], 1)
        out[:, t, 1:] = np.take_along_axis(every, best, 1)
        out[:, t] = mix(out[:, t] * np.uint64(tables) + np.uint64(t) + constants(1, 42 + x.shape[1]))
    return out


def missed(depth: int, d: int, least: float, seed: int = 20_06) -> float:
    """Share of one table's misses among random pairs at cosine `least` in d dimensions."""
    rng = np.random.default_rng(seed)
    lost, (pairs, tables) = 0, TRIED
    for _ in range(0, pairs, 512):
        x, y = rng.normal(size=(2, 512, d))
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        y -= x * (x * y).sum(axis=1, keepdims=True)
        y = least * x + np.sqrt(1 - least * least) * y / np.sqrt((y * y).sum(axis=1, keepdims=True))
        a, b = keys(x, depth, tables), keys(y, depth, tables)
        lost += int((~((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2))).sum())
    return max(lost, 1) / (pairs * tables)


@functools.lru_cache(maxsize=None)
def tables_for(depth: int, d: int, least: float) -> int:
    """Tables, TABLES at least, that keep the chance of missing a pair under MISSED; d dimensions or fewer."""
    if depth <= DEPTH and d <= 64 and least >= 0.95:
        return TABLES
    return max(TABLES, int(np.ceil(np.log(MISSED) / np.log(missed(depth, d, least)))))


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column as doubles, padded with zeros to the longest, and their lengths; unit length each."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sizes


def _by_size(x, sizes):
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, x[at, :d]


def _place(depth: int, tables: int):
    def run(batches):
        for batch in batches:
            x, sizes = _unit(batch.column("embedding"))
            reps = batch.column("rep").to_numpy()
            for at, own in _by_size(x, sizes):
                for k in range(0, len(at), 1024):
                    found = keys(own[k : k + 1024], depth, tables).reshape(-1, tables * (PROBES + 1))
                    main = np.tile(np.arange(PROBES + 1) == 0, tables * len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), pa.array(np.repeat(reps[at[k : k + 1024]], found.shape[1])), pa.array(main)], names=["bucket", "rep", "main"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket that counts for each pair: of the first table where they meet, the lesser one."""
    none = np.uint64((1 << 64) - 1)
    out = np.full(len(a), none, np.uint64)
    for t in range(a.shape[1] - 1, -1, -1):
        x, y = a[:, t], b[:, t]
        one = np.where((y == x[:, :1]).any(axis=1), x[:, 0], none)
        two = np.where((x == y[:, :1]).any(axis=1), y[:, 0], none)
        here = np.minimum(one, two)
        out = np.where(here != none, here, out)
    return out


def _link(depth: int, tables: int, least: float):
    def links(group, bucket, block_a, block_b, own, rep, mult, x, sizes):
        left, right = [], []
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        n = np.diff(np.append(starts, len(group)))
        for d in range(1, int(n.max()) if len(n) else 0):
            i = np.flatnonzero(group[d:] == group[:-d])
            left.append(i)
            right.append(i + d)
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        # Two blocks meet here: pairs within one block are met where that block stands alone.
        keep = ((own[i] != own[j]) | (block_a[i] == block_b[i])) & (sizes[i] == sizes[j])
        i, j = i[keep], j[keep]
        near = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
        i, j = i[near >= least], j[near >= least]
        if len(i):
            used = np.unique(np.concatenate([i, j]))
            codes = np.zeros((len(used), tables, PROBES + 1), np.uint64)
            for at, own_x in _by_size(x[used], sizes[used]):
                codes[at] = keys(own_x, depth, tables)
            meet = _first_meeting(codes[np.searchsorted(used, i)], codes[np.searchsorted(used, j)])
            now = meet == bucket[i].view(np.uint64)
            i, j = i[now], j[now]
        nodes, at = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
        count = np.bincount(at, np.concatenate([mult[j], mult[i]]), len(nodes)).astype(np.int64)
        root = np.arange(len(nodes))
        a, b = at[: len(i)], at[len(i) :]
        while len(a):
            least_ = root.copy()
            np.minimum.at(least_, a, root[b])
            np.minimum.at(least_, b, root[a])
            least_ = least_[least_]
            if np.array_equal(least_, root):
                break
            root = least_
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(count, pa.int64()), pa.array(nodes[root], pa.int64())], names=["rep", "links", "root"])

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            whole = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest is not None or batch is not None else None
            if whole is None or not whole.num_rows:
                continue
            cols = {c: whole.column(c).to_numpy() for c in ("bucket", "a", "b", "own", "rep", "mult")}
            change = (cols["bucket"][1:] != cols["bucket"][:-1]) | (cols["a"][1:] != cols["a"][:-1]) | (cols["b"][1:] != cols["b"][:-1])
            group = np.concatenate([[0], np.cumsum(change)])
            done = whole.num_rows if batch is None else int(np.searchsorted(group, group[-1]))
            if done:
                x, sizes = _unit(whole.column("embedding").slice(0, done).combine_chunks())
                yield links(group[:done], *(cols[c][:done] for c in ("bucket", "a", "b", "own", "rep", "mult")), x, sizes)
            rest = whole.slice(done).combine_chunks().to_batches()[0] if done < whole.num_rows else None

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors; other columns are left out.

    Links join rows whose vectors have equal length and a cosine of `least` or more. Null, empty and zero vectors, those
    with null or non-finite components, and rows with a null id link with nothing: their component is their own id (null
    if that is null) and they are kept. Rows of one id count as one vector if alike; else each has its links, and they
    share a component. An empty table gives an empty one. Keys get longer with the number of vectors, so that buckets of
    unrelated vectors stay small, and tables more, so that no more pairs are missed.
    """
    spark = vectors.sparkSession
    steps = Steps(spark)
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(embedding).alias("embedding"))
    fit = F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    sound = rows.where("fit")
    classes = steps.write(sound.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    n, d = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    depth = max(DEPTH, int(np.ceil(np.log(max(n, 2)) / np.log(128))))
    tables = tables_for(depth, d or 2, least)
    placed = steps.write(classes.select("rep", "embedding").mapInArrow(_place(depth, tables), "bucket long, rep long, main boolean"), "placed")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("main").alias("any")).where("n > 1 and any")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = placed.join(shared, "bucket").select("bucket", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep")
    full = met.join(classes, "rep").repartition(partitions(spark), "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    linked = steps.write(full.select("bucket", "a", "b", "own", "rep", "mult", "embedding").mapInArrow(_link(depth, tables, least), "rep long, links long, root long"), "linked")
    joined = connected_components(steps, linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), "joined")
    steps.drop("placed")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = sound.select("vec_id", "embedding").join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fit FROM embeddings),
f AS (SELECT vec_id, e FROM v WHERE fit),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
