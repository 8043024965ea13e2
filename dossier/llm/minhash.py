"""Near-duplicate documents by min-max hashing.

A document's words give its set of distinct shingles. Each permutation of the shingles' hashes is evaluated once and
yields two values of the signature, the minimum and the maximum, so SIZE values cost SIZE / 2 evaluations. Bands of
ROWS values put documents into buckets; of documents with one and the same set only the first goes on. Pairs that share
a bucket are verified on their full sets.

Within a bucket, pairs are not all written out. First each member meets the bucket's first one, and those that do not
link with it meet another pivot; links that hold join documents into components. Only where a bucket still holds several
components, members of different ones meet, and of these only those that share a shingle rare enough for a link. Pairs
within one component could not change it. So every link between candidates takes effect, while a large group of copies
costs about one pair for each copy.

Odds that a pair at the threshold 0.8 shares no bucket: (1 - 0.8^6)^40, under 1 in 100,000.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import Maybe, Steps, bitmap, connected_components, constants, mix, slices, table, text_buffer, word_hashes

BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
#: Pivots that a bucket's members meet before the rest meet one another.
PIVOTS = 2
BLOCK = 1 << 18

SIGNATURE = "doc_id long, n int, s1 long, s2 long, buckets array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and their offsets. Fewer than k words make one shingle, none make none."""
    words, at = word_hashes(data, offsets)
    order = constants(k, 11)
    n = np.diff(at)
    many = np.zeros(len(words), np.uint64)
    for j in range(k):
        many[: max(0, len(words) - j)] += words[j:] * order[j]
    many = mix(many)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - at[of]
    keep = place <= n[of] - k
    short = np.flatnonzero((n > 0) & (n < k))
    for r in short:  # few words: their number keeps them apart from longer ones
        own = words[at[r] : at[r + 1]]
        many[at[r]] = mix((own * order[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
        keep[at[r]] = True
    many, of = many[keep], of[keep]
    ends = np.searchsorted(of, np.arange(len(n) + 1))
    out = [np.unique(many[i:j]) for i, j in zip(ends[:-1], ends[1:])]
    return (np.concatenate(out) if out else many), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def bands(shingles: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket ids (rows of the batch by bands); rows without shingles get zeros."""
    full = np.flatnonzero(np.diff(at) > 0)
    values = np.zeros((len(at) - 1, bands * rows), np.uint64)
    if len(full):
        starts = at[full]
        for p, (a, b) in enumerate(zip(constants(bands * rows // 2, 21), constants(bands * rows // 2, 22))):
            hashed = (shingles ^ b) * a
            values[full, 2 * p] = np.minimum.reduceat(hashed, starts)
            values[full, 2 * p + 1] = np.maximum.reduceat(hashed, starts)
    weights = constants(rows, 23)
    # Minima and maxima of one permutation go to different bands: 2p and 2p + 1 are far apart after this turn.
    values = values.reshape(len(values), bands * rows // 2, 2).transpose(0, 2, 1).reshape(len(values), bands, rows)
    return mix((values * weights).sum(axis=2, dtype=np.uint64) + constants(bands, 24))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2, buckets): the set's size, two 64-bit sums that name it, and its buckets."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK):
                for lo in range(i, j, 2048):
                    hi = min(lo + 2048, j)
                    sets, at = shingle_sets(data, offsets[lo : hi + 1], k)
                    n = np.diff(at)
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (sets, mix(sets ^ constants(1, 31)))]
                    s1, s2 = (s[at[1:]] - s[at[:-1]] for s in sums)
                    buckets = bands(sets, at)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(buckets.reshape(-1).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], names=["doc_id", "n", "s1", "s2", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE)


#: Words of the bitmap that stands for a set in a first comparison.
WORDS = 16


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles, bits): each row's set as ascending signed hashes, and a bitmap with one bit for each hash."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK):
                found, at = shingle_sets(data, offsets[i : j + 1], k)
                found = found.view(np.int64)
                half = [np.sort(found[a:b]) for a, b in zip(at[:-1], at[1:])]
                lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.concatenate(half) if half else found)).cast(pa.list_(pa.int64()))
                bits = np.zeros((j - i, 64 * WORDS), bool)
                bits[np.repeat(np.arange(j - i), np.diff(at)), (found.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * WORDS)] = True
                maps = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * WORDS), pa.array(np.packbits(bits, axis=1).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists, maps], names=["doc_id", "shingles", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>, bits array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(), at


def _shared(batches):
    """Pairs with the size of the intersection of their sets. Pairs with one set of `a` that stand together are counted at once."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b")
        (own, own_at), (its, its_at) = _flat(batch.column("set_a")), _flat(batch.column("set_b"))
        shared = np.zeros(len(a), np.int64)
        name = batch.column("name_a").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(a) else []
        for lo, hi in zip(starts, [*starts[1:], len(a)]):
            one, all_ = own[own_at[lo] : own_at[lo + 1]], its[its_at[lo] : its_at[hi]]
            hit = one[np.minimum(np.searchsorted(one, all_), len(one) - 1)] == all_
            sums = np.concatenate([[0], np.cumsum(hit)])
            shared[lo:hi] = np.diff(sums[its_at[lo : hi + 1] - its_at[lo]])
        n = np.diff(own_at), np.diff(its_at)
        yield pa.RecordBatch.from_arrays([batch.column("a"), b, pa.array(shared), pa.array(n[0] + n[1] - shared)], names=["a", "b", "both", "either"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with `linked`: whether 100 * intersection >= percent * union on full sets."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    full = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    counted = full.select("a", "b", F.xxhash64("set_a").alias("name_a"), "set_a", "set_b").mapInArrow(_shared, "a long, b long, both long, either long")
    return counted.select("a", "b", (F.col("both") * 100 >= F.col("either") * percent).alias("linked"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are left out).

    Null or blank texts have an empty set and link with nothing. Rows with a null doc_id link with nothing, keep a null
    component_id and are kept. Rows of one doc_id are one document, which links wherever one of its texts does; all of
    them that have words stand in one component. Ties are settled by the smallest doc_id. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    signed = steps.write(signatures(docs, k), "signatures")
    real = signed.where("n > 0 and doc_id is not null")
    first = real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"))
    reps = steps.write(first, "classes")
    in_bucket = reps.select(F.posexplode("buckets").alias("band", "hash"), "rep").select(F.xxhash64("band", "hash").alias("bucket"), "rep")
    shared = in_bucket.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count("*").alias("n")).where("pivot <> last")
    members = steps.write(in_bucket.join(shared.select("bucket", "pivot", "n"), "bucket"), "members")

    candidates = members.select(F.col("rep").alias("doc_id")).distinct()
    maybe = Maybe(spark, bitmap(candidates.select(F.xxhash64("doc_id").alias("h")), "h"))
    texts = docs.select("doc_id", "text").where(maybe.holds(F.xxhash64("doc_id"))).join(candidates, "doc_id", "left_semi")
    full = steps.write(sets(texts.dropDuplicates(["doc_id", "text"]), k).where("size(shingles) > 0"), "sets")
    maybe.end()

    met = steps.write(_verified(_ordered(members.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))), full, percent), "met-0")
    for round_ in range(1, PIVOTS):
        direct = met.where("linked").select(F.col("a").alias("pivot"), F.col("b").alias("rep"))
        apart = members.where("n > 2 and rep <> pivot").join(direct, ["pivot", "rep"], "left_anti")
        other = apart.groupBy("bucket").agg(F.min_by("rep", F.xxhash64("rep", F.lit(round_))).alias("other"), F.count("*").alias("c")).where("c > 1")
        pairs = apart.join(other.select("bucket", "other"), "bucket").select(F.col("other").alias("a"), F.col("rep").alias("b"))
        pairs = _ordered(pairs).join(met.select("a", "b"), ["a", "b"], "left_anti")
        met = met.union(steps.write(_verified(pairs, full, percent), f"met-{round_}"))
    links, one_id = met.where("linked").select("a", "b"), _one_id(steps, real, reps)
    links = links if one_id is None else links.union(one_id)
    joined = steps.write(connected_components(steps, links, "joined").groupBy("node").agg(F.min("component").alias("component")), "components")
    of = members.where("n > 2").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_ = of.join(mixed.select("bucket"), "bucket", "left_semi").select("rep", "component").distinct()
    open_ = steps.write(open_, "open")
    pairs = _all_that_can_link(open_, full, percent).join(met.select("a", "b"), ["a", "b"], "left_anti")
    late = steps.write(_verified(pairs, full, percent).where("linked"), "late")
    if late.isEmpty():
        found = joined
    else:  # only components that a late link joins change
        named = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        between = late.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        over = connected_components(steps, between, "over").groupBy("node").agg(F.min("component").alias("over"))
        found = joined.join(over.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
        found = found.union(over.join(joined, "node", "left_anti").select("node", "over"))
    steps.drop("sets", "members", "open")
    named = reps.drop("buckets").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = real.join(named, ["n", "s1", "s2"])
    rest = signed.where("n = 0 or doc_id is null").withColumn("component", F.col("doc_id"))
    out = out.select("doc_id", "n", "component").union(rest.select("doc_id", "n", "component"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _one_id(steps: Steps, real: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links (a, b) between a doc_id that stands before several texts and the first documents of these texts' classes."""
    name = F.struct("n", "s1", "s2")
    several = real.groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("doc_id")
    several = steps.write(several, "several")
    if several.isEmpty():
        return None
    return real.join(several, "doc_id").join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _all_that_can_link(open_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open documents (rep, component), of different components, that can link.

    Shingles are ordered, those in the fewest open documents first. Two sets that share percent of their union share one
    of the first n - ceil(n * percent / 100) + 1 shingles of each, n its size: whoever lacks all of the other's first ones
    lacks too many. So documents meet by these shingles alone, the rarest they have. Two more bounds hold for a pair: what
    stands before the place of the shingle at which it meets first is not shared, and each bit in which two bitmaps differ
    stands for a shingle of one set that the other lacks. None of the bounds loses a link.
    """
    full = full.withColumnRenamed("doc_id", "rep")
    held = full.join(open_.select("rep"), "rep", "left_semi").select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    often = held.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    ranked = held.join(often, "x").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("order"))
    # Shingles that no other open document has stand before all others, and nobody meets by them.
    alone = F.col("n") - F.size("order")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    first = ranked.where(reach > 0).select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), reach)).alias("k", "s"))
    first = first.select("rep", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("s.x").alias("x")).join(open_, "rep").join(full.select("rep", "bits"), "rep")
    differ = " + ".join(f"bit_count(l.bits[{w}] ^ r.bits[{w}])" for w in range(WORDS))
    can = " and ".join(
        [
            "l.x = r.x and l.component < r.component",
            f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)",
            f"{100 + percent} * least(l.n - l.at, r.n - r.at) >= {percent} * (l.n + r.n)",
            f"{100 + percent} * (l.n + r.n - ({differ})) >= {2 * percent} * (l.n + r.n)",
        ]
    )
    return first.alias("l").join(first.alias("r"), F.expr(can)).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), k=4)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
"""
