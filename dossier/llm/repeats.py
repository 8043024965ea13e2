"""Removal of repeated byte strings by merging Burrows-Wheeler transforms within shards of the corpus.

1. Each document is cut into segments by minimisers: of the K-byte grams in a WINDOW-byte window the one of least hash is
   the window's anchor; neighbouring windows with one anchor form a segment. The anchor depends on the window's bytes
   alone, so equal windows, wherever they stand, share it. Windows whose anchor occurs once are unique: nothing is lost.
2. Segments that occur twice or more, by a 128-bit name of anchor and bytes, are repeated in whole.
3. Segments that share an anchor with other ones go, by anchor, to one bucket: a shard of the corpus. There the
   interleave of all its strings is refined from depth 0 to 200; see `repeated`. Plainly: no transform of a single shard
   is built first and merged with another; each round re-sorts the open places by the four bytes before them, which is a
   radix sort of 200-byte windows from the right. Only places within windows are carried, and settled ones drop out.

Buckets get some 2 MB each, so more data makes more buckets; all different segments of one anchor share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import Steps, bitmap, constants, maybe_in, mix, partitions, slices, span_hashes, table, text_buffer

WINDOW, K = 200, 64
SPAN = WINDOW - K + 1
#: Bytes of a symbol in the merge.
STEP = 4
#: Bytes of strings that are merged at once, and that a task gets at least, one bucket after the other.
BUCKET, TASK = 2 << 20, 64 << 20
BLOCK = 1 << 17

RUNS = "id long, h long, first int, last int, anchor long, name long"


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, from block-wise running minima."""
    n = len(values) - w + 1
    size = -(-len(values) // w) * w
    padded = np.full(size, (1 << 64) - 1, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the K bytes from each place on: of eight bytes, then of twice as many by scrambling two halves."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    out = mix(np.ndarray(len(data), "<u8", wide, strides=(1,)) ^ constants(1, 71))
    size = 8
    for salt in constants(K.bit_length() - 4, 72):
        out = mix(out[:-size] * salt ^ out[size:])
        size *= 2
    return out[: len(data) - K + 1]


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the rows in data: row, first and last window start, anchor hash, name. Rows of at most BLOCK-ish bytes.

    Positions are relative to `offsets[0]`'s row starts.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = gram_hashes(data)
    low = np.uint64((1 << 22) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_least(packed, SPAN) & low).astype(np.int64)
    starts = np.arange(len(anchors))
    row = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + WINDOW <= offsets[row + 1]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    new &= inside
    end = inside.copy()
    end[:-1] &= (anchors[1:] != anchors[:-1]) | ~inside[1:] | (row[1:] != row[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    name = span_hashes(data, first, last + WINDOW, 3)
    anchor = mix(grams[anchors[first]] + np.uint64(1))
    return row[first], first - offsets[row[first]], last - offsets[row[first]], anchor, name


def segments(docs: DataFrame) -> DataFrame:
    """RUNS of docs (id, h, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids, hs = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for i, j in slices(offsets, BLOCK):
                if j - i > 1 or offsets[j] - offsets[i] <= 2 * BLOCK:
                    parts = [(0, runs_of(data, offsets[i : j + 1]))]
                else:  # a very long text goes in pieces that overlap by a window less one
                    lo, hi = int(offsets[i]), int(offsets[j])
                    cuts = range(lo, hi - WINDOW + 1, BLOCK)
                    parts = [(c - lo, runs_of(data, np.array([c, min(c + BLOCK + WINDOW - 1, hi)]))) for c in cuts]
                for shift, (row, first, last, anchor, name) in parts:
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[i + row]), pa.array(hs[i + row]), pa.array((first + shift).astype(np.int32)), pa.array((last + shift).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64))],
                            names=["id", "h", "first", "last", "anchor", "name"],
                        )

    return docs.mapInArrow(run, RUNS)


def repeated(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the WINDOW bytes at each position of the strings (joined in data, up to ends) start at two places or more.

    The strings' transforms are merged all at once. The places after all windows, one string's after another's, are the
    interleave by 0 bytes: a single block. From the interleave by the first d bytes of the places WINDOW - d into their
    windows, the symbols before them, distributed stably, give that by d + STEP bytes of the places STEP earlier. A block
    parts where symbols differ or the blocks that follow did; common prefixes are the depths at which places part. A
    place that is alone in its block is settled, for whatever stands before it will be alone too. Blocks that are left
    at WINDOW bytes are the repeated intervals.
    """
    n = len(data)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    grams = np.zeros(n, np.uint32)
    wide = np.concatenate([data, np.zeros(STEP, np.uint8)])
    for k in range(STEP):
        grams = (grams << np.uint32(8)) | wide[k : n + k]
    kinds, symbols = np.unique(grams, return_inverse=True)
    symbols = symbols.astype(np.uint16 if len(kinds) < 1 << 16 else np.uint32)
    del grams, kinds, wide
    place = np.flatnonzero(left >= WINDOW).astype(np.int32) + np.int32(WINDOW)
    block = np.zeros(len(place), np.int32)
    for _ in range(0, WINDOW, STEP):
        place -= np.int32(STEP)
        before = symbols[place]
        order = np.argsort(before, kind="stable")
        before, block, place = before[order], block[order], place[order]
        parts = np.ones(len(place) + 1, bool)
        parts[1:-1] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        held = ~(parts[:-1] & parts[1:])
        place, block = place[held], np.cumsum(parts[:-1][held], dtype=np.int32)
        if not len(place):
            break
    out = np.zeros(n, bool)
    out[place] = True
    return out


def _marks(batches):
    """Window starts to remove, of the segments of one bucket after the other."""
    held: list[tuple] = []

    def flush():
        sizes = np.array([len(r[4]) for r in held], np.int64)
        data, ends = np.frombuffer(b"".join(r[4] for r in held), np.uint8), np.cumsum(sizes)
        hits = repeated(data, ends)
        out = []
        for (i, h, first, _, _, n, _), lo, hi in zip(held, ends - sizes, ends):
            if n > 1:
                continue  # it is marked in whole already
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hits[lo:hi].astype(np.int8), [0]])))
            out += [(i, h, first + int(a), first + int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]
        held.clear()
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "h", "first", "last"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "first", "anchor", "bytes", "n", "bucket"))):
            if held and row[6] != held[-1][6]:
                yield flush()
            held.append(row)
    if held:
        yield flush()


def _cut(batches):
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        out = []
        for r, (i, h, wanted) in enumerate(zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("wanted").to_pylist())):
            text = data[offsets[r] : offsets[r + 1]]
            out += [(i, h, w["first"], w["anchor"], text[w["first"] : w["last"] + WINDOW].tobytes(), w["n"]) for w in wanted]
        columns = list(zip(*out)) if out else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "h", "first", "anchor", "bytes", "n"])


def _removed(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        out = []
        for r, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[r] : offsets[r + 1]]
            change = np.zeros(len(text) + 1, np.int32)
            for s in spans or ():
                change[s["first"]] += 1
                change[s["last"] + WINDOW] -= 1
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept = text[~gone].tobytes()
            out.append((len(text), int(gone.sum()), [[int(a), int(b)] for a, b in zip(edge[::2], edge[1::2])], kept))
        columns = list(zip(*out)) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of docs (doc_id, text; other columns are left out).

    spans: maximal removed runs (first byte, byte after the last); kept: the other bytes, which may begin or end within
    a character. Null texts are empty. Texts under 200 bytes lose nothing. Repeated rows are documents of their own, so
    each makes the other repeated. Rows may share a doc_id, also null. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    # Two rows are one text if id and h agree; h tells a null doc_id from the number that stands for it.
    null = F.lit(-(1 << 63)).cast("long")
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", null).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"))
    found = steps.write(segments(rows.select("id", "h", "text").where("octet_length(text) >= 200")), "found")
    # Counts are summed in the map tasks first, so that a frequent anchor is a few rows. They are written, for a join with a
    # table can split a frequent anchor among tasks, but one with an aggregate of its own stage can't.
    anchors = found.groupBy("anchor").agg(F.count("*").alias("all"), F.min("name").alias("low"), F.max("name").alias("high")).where("all > 1")
    anchors = steps.write(anchors.select("anchor", (F.col("low") != F.col("high")).alias("open")), "anchors")
    again = steps.write(found.join(anchors, "anchor"), "again")
    names = again.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.first("open").alias("open"), F.min(F.struct("id", "h", "first", "last")).alias("at"))
    names = steps.write(names, "names")
    shared = again.join(names.where("n > 1").select("anchor", "name"), ["anchor", "name"], "left_semi").select("id", "h", "first", "last")
    open_ = names.where("open")
    wanted = open_.groupBy("at.id", "at.h").agg(F.collect_list(F.struct("at.first", "at.last", "anchor", "n")).alias("wanted"))
    wanted = steps.write(wanted, "wanted")
    texts = rows.where(maybe_in(spark, bitmap(wanted.select(F.xxhash64("id").alias("x")), "x"))(F.xxhash64("id"))).select("id", "h", "text")
    pieces = wanted.join(texts, ["id", "h"]).dropDuplicates(["id", "h"]).mapInArrow(_cut, "id long, h long, first int, anchor long, bytes binary, n long")
    pieces = steps.write(pieces, "pieces")
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")).repartition(int(max(partitions(spark), -(-total // TASK))), "bucket").sortWithinPartitions("bucket", "anchor")
    marks = dealt.mapInArrow(_marks, "id long, h long, first int, last int").union(shared)
    spans = steps.write(marks.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    maybe = maybe_in(spark, bitmap(spans.select(F.xxhash64("id").alias("x")), "x"))
    hit = rows.withColumn("maybe", maybe(F.xxhash64("id")))
    joined = hit.where("maybe").join(spans, ["id", "h"], "left").select("doc_id", "text", "spans")
    alone = hit.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans"))
    steps.drop("found", "anchors", "again", "names", "wanted", "pieces")
    return joined.union(alone).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept binary")


def op9_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 200 bytes, as hexadecimal digits and by their MD5.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, p, md5(substring(h, 2 * p + 1, 400)) AS m FROM d, unnest(range(greatest(n - 199, 0))) AS u(p)),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, p, coalesce(lag(p) OVER (PARTITION BY r ORDER BY p) + 200, 0) AS e, lag(p) OVER (PARTITION BY r ORDER BY p) IS NULL AS first FROM w JOIN again USING (m)),
cut AS (
  SELECT r, sum(least(200, p + 200 - CASE WHEN first THEN p ELSE e END))::BIGINT AS n_removed, count(*) FILTER (WHERE first OR p > e) AS n_spans, max(p) + 200 AS last,
    list((e, p) ORDER BY p) FILTER (WHERE first OR p > e) AS gaps FROM hit GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gaps IS NULL THEN h ELSE array_to_string(list_transform(gaps, lambda g: substring(h, 2 * struct_extract_at(g, 1) + 1, 2 * (struct_extract_at(g, 2) - struct_extract_at(g, 1)))), '') || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
