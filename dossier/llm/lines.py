"""Line deduplication by pairwise alignment.

Each document is compared with every earlier one that shares a line, by patience diff: lines that stand once in both, in
the longest common order, are anchors; anchors grow over equal neighbours, and the gaps between them are aligned in turn.
Aligned blocks of FEWEST words or more are deleted from the later document.

Pairs that can delete nothing are not aligned, and no others are left out. A block that deletes a line holds one of the
line's tags: the shortest runs of lines around it, without a blank one, that have FEWEST words. So only documents with a
common tag are pairs. Of a rare tag (at most RARE documents) all pairs are aligned. A more common tag first pairs its
documents with pivots, the first document and then in turn the next one that still keeps a line with this tag, as long as
that settles lines; those that still keep such a line then meet every earlier document of the tag, but one of those that
would align alike. What aligns alike depends on the pair: of earlier documents that share nothing with the later one but
the lines of the tag, one for each order of these lines is enough.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, Steps, bitmap, constants, maybe_in, mix, table

RARE = 8
FEWEST = 5
#: Rounds of pivots end when fewer than one in SETTLED of what was left is settled.
SETTLED = 10
#: Of the documents that have a tag's lines in one order, so many are tried first as the one that stands for all.
STANDS = 4


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j), ascending in both, of equal items of a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        places: dict = {}
        for i in range(i0, i1):
            places.setdefault(a[i], [[], []])[0].append(i)
        for j in range(j0, j1):
            if b[j] in places:
                places[b[j]][1].append(j)
        once = [(x[0], y[0]) for x, y in places.values() if len(x) == 1 and len(y) == 1]
        tops: list[int] = []  # longest ascending run of j, by patience sorting
        at: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(once):
            p = bisect.bisect_left(tops, j)
            back.append(at[p - 1] if p else -1)
            if p == len(tops):
                tops.append(j)
                at.append(k)
            else:
                tops[p], at[p] = j, k
        k, chain = (at[-1] if at else -1), []
        while k >= 0:
            chain.append(once[k])
            k = back[k]
        chain.reverse()
        if not chain:
            continue
        out += chain
        edges = [(i0 - 1, j0 - 1), *chain, (i1, j1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges[:-1], edges[1:])]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], fewest: int = FEWEST) -> list[int]:
    """The j of all pairs that stand in runs, without a gap in i or j, of `fewest` words or more."""
    out, run = [], []
    for p in [*pairs, None]:
        if run and (p is None or p[0] != run[-1][0] + 1 or p[1] != run[-1][1] + 1):
            if sum(words[j] for _, j in run) >= fewest:
                out += [j for _, j in run]
            run = []
        if p is not None:
            run.append(p)
    return out


def _align(fewest: int):
    def run(batches):
        for batch in batches:
            gone = []
            for la, lb, wb in zip(*(batch.column(c).to_pylist() for c in ("lines_a", "lines_b", "words_b"))):
                gone.append(blocks(patience(la, lb), wb, fewest))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(gone, pa.list_(pa.int32()))], names=["id", "h", "gone"])

    return run


def tags(keys: np.ndarray, words: np.ndarray, row: np.ndarray, kept: np.ndarray, fewest: int = FEWEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes, first lines and numbers of lines of the tags of all kept places; lines of all rows stand one after
    another, blank ones have no words."""
    n = len(keys)
    sums = np.concatenate([[0], np.cumsum(words)])
    blank = np.concatenate([[0], np.cumsum(words == 0)])
    order = constants(fewest, 61)
    rows, found, starts, sizes = [], [], [], []
    for before in range(fewest):
        for size in range(before + 1, fewest + 1):
            p = np.flatnonzero(kept[before : n - size + before + 1]) + before if n >= size else np.zeros(0, np.int64)
            s, e = p - before, p - before + size
            total = sums[e] - sums[s]
            good = (row[s] == row[e - 1]) & (blank[s] == blank[e]) & (total >= fewest)
            if before:
                good &= total - words[s] < fewest
            if size > before + 1:
                good &= total - words[e - 1] < fewest
            s = s[good]
            whole = np.full(len(s), size, np.uint64)
            for k in range(size):
                whole += mix(keys[s + k] * order[k])
            rows.append(row[s])
            found.append(mix(whole))
            starts.append(s)
            sizes.append(np.full(len(s), size))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(starts), np.concatenate(sizes)


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of all rows of a batch one after another, and the words, the row and the offset of each row."""
    n = batch.column("lines").value_lengths().to_numpy(zero_copy_only=False)
    keys = batch.column("lines").flatten().fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    words = batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return keys, words, np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])


def _tags(fewest: int):
    def run(batches):
        for batch in batches:
            keys, words, row, begins = _listed(batch)
            gone = batch.column("gone")
            kept = np.ones(len(row), bool)
            kept[np.repeat(begins[:-1], gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + gone.flatten().to_numpy(zero_copy_only=False)] = False
            at, found, *_ = tags(keys, words, row, kept, fewest)
            at, found = np.unique(np.stack([at, found.view(np.int64)]), axis=1) if len(at) else (at, found.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), batch.column("h").take(pa.array(at)), pa.array(found, pa.int64())], names=["id", "h", "tag"])

    return run


def _spelt(fewest: int):
    def run(batches):
        for batch in batches:
            keys, words, row, _ = _listed(batch)
            _, found, starts, sizes = tags(keys, words, row, np.ones(len(row), bool), fewest)
            _, once = np.unique(found, return_index=True)
            spelt = [keys[s : s + n].view(np.int64).tolist() for s, n in zip(starts[once], sizes[once])]
            yield pa.RecordBatch.from_arrays([pa.array(found[once].view(np.int64), pa.int64()), pa.array(spelt, pa.list_(pa.int64()))], names=["tag", "spelt"])

    return run


def split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _order(lines: str) -> list[Column]:
    """Two hashes of the order of lines; -1 matches nothing, and all that is left of a stretch of these is that it parts others."""
    short = F.filter(lines, lambda v, i: (v != -1) | (i == 0) | (F.get(lines, i - 1) != -1))
    return [F.xxhash64(short).alias("one"), F.xxhash64(short, F.lit(1)).alias("two")]


def _first_alike(steps: Steps, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, rep): of the given documents those that align alike with any other, under the first of them.

    A line that no other of the documents has, or a blank one, matches nothing; all that is left of a stretch of such lines is
    that it parts what stands around it. Documents with the same lines in the same order but for such stretches are alike.
    """
    held = lines.join(docs, "doc", "left_semi").select("doc", F.posexplode("lines").alias("at", "x"))
    shared = held.where("x is not null").groupBy("x").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
    # Written tables, for a join with one can split a frequent line, or a large class, among tasks.
    shared = steps.write(shared.select("x", F.lit(True).alias("other")), "shared-lines")
    marked = held.join(shared, "x", "left").select("doc", "at", F.when(F.col("other"), F.col("x")).alias("x"))
    whole = marked.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("x", F.lit(-1).cast("long")).alias("x")))).alias("s")).select("doc", F.col("s.x").alias("s"))
    named = steps.write(whole.select("doc", *_order("s")), "alike")
    return named.join(steps.write(named.groupBy("one", "two").agg(F.min("doc").alias("rep")), "first-alike"), ["one", "two"]).select("doc", "rep")


def _meetings(steps: Steps, lines: DataFrame, left: DataFrame, others: DataFrame, spelt: DataFrame) -> DataFrame:
    """(a, b): for each (tag, doc) of `left` the earlier ones of `others` (tag, a), but one of those that would align alike.

    Documents that share nothing but the lines of the tag align by the order of these lines in each. So those that share
    more are pairs by a join on what they share, and of all others one for each order in which they have the tag's lines.
    It is looked for among the first STANDS; if each of these shares more, all of that order are pairs.
    spelt: (tag, spelt), the lines of each tag.
    """
    held = others.join(spelt, "tag").join(lines.select(F.col("doc").alias("a"), "lines"), "a")
    order = held.select("tag", "a", F.transform("lines", lambda x: F.when(F.array_contains("spelt", x), x).otherwise(F.lit(-1).cast("long"))).alias("s"))
    order = steps.write(order.select("tag", "a", *_order("s")), "orders")
    more = lambda df, doc: df.select("tag", doc, F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull() & ~F.array_contains("spelt", x)))).alias("x"))
    late = left.select("tag", F.col("doc").alias("b"))
    theirs = more(late.join(spelt, "tag").join(lines.select(F.col("doc").alias("b"), "lines"), "b"), "b")
    also = steps.write(theirs.join(more(held, "a"), ["tag", "x"]).where("a < b").select("tag", "a", "b").distinct(), "share-more")
    by = Window.partitionBy("tag", "one", "two").orderBy("a")
    first = steps.write(order.withColumn("k", F.row_number().over(by)).where(f"k <= {STANDS}"), "stand")
    tried = late.join(first, "tag").where("a < b").join(also.withColumn("more", F.lit(True)), ["tag", "a", "b"], "left")
    found = steps.write(tried.groupBy("tag", "one", "two", "b").agg(F.count("*").alias("n"), F.min(F.when(F.col("more").isNull(), F.col("a"))).alias("a")), "stood")
    rest = found.where(f"a is null and n = {STANDS}").select("tag", "one", "two", "b").join(order, ["tag", "one", "two"]).where("a < b")
    return also.select("a", "b").union(found.where("a is not null").select("a", "b")).union(rest.select("a", "b"))


def dedup_lines(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """All rows with struct column `lines`: n (lines), removed (their places from 0, ascending), text (what is kept).

    Lines end at \\n and are compared without white space at their ends; blank ones are neither compared nor removed.
    Documents go by doc_id, then by hash of their text. Repeated rows are one document and come out alike; rows that
    share a doc_id but not the text are two. Null texts and rows of null doc_id are left as they are (a null text is
    empty, one blank line). Any further columns are kept, whatever their names but `lines`. Aligned
    blocks of under `fewest` words stay.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text").where("id is not null and text is not null")
    listed = rows.select("id", "h", F.transform(split(F.col("text")), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).alias("x"))
    listed = listed.select("id", "h", F.transform("x", lambda x: F.when(x != "", F.xxhash64(x))).alias("lines"), F.transform("x", lambda x: F.regexp_count(x, F.lit(WORD)).cast("int")).alias("words"))
    listed = steps.write(listed, "listed")
    doc = F.struct("id", "h")
    none = F.array().cast("array<int>")
    tagged = lambda df: df.mapInArrow(_tags(fewest), "id long, h long, tag long").select(doc.alias("doc"), "tag")
    seen = tagged(listed.select("id", "h", "lines", "words", none.alias("gone"))).distinct()
    common = seen.groupBy("tag").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first <> last")
    shared = steps.write(seen.join(common.select("tag", "first", "n"), "tag"), "shared")
    wanted = shared.select("doc").distinct()
    lines = steps.write(listed.withColumn("doc", doc).join(wanted, "doc", "left_semi").dropDuplicates(["id", "h"]).select("doc", "lines", "words"), "lines")
    # A blank line is unlike any other, so it gets a number of its own in each document of a pair.
    apart = lambda c, salt: F.transform(c, lambda x, i: F.coalesce(x, F.xxhash64(F.lit(salt), i)))

    def align(pairs: DataFrame, k: int) -> DataFrame:
        both = pairs.join(lines.select(F.col("doc").alias("b"), apart("lines", "b").alias("lines_b"), F.col("words").alias("words_b")), "b")
        both = both.join(lines.select(F.col("doc").alias("a"), apart("lines", "a").alias("lines_a")), "a")
        found = both.select(F.col("b.id").alias("id"), F.col("b.h").alias("h"), "lines_a", "lines_b", "words_b").mapInArrow(_align(fewest), "id long, h long, gone array<int>")
        return steps.write(found.where("size(gone) > 0"), f"gone-{k}")

    def together(found: DataFrame) -> DataFrame:
        return found.select("id", "h", F.explode("gone").alias("g")).groupBy("id", "h").agg(F.sort_array(F.collect_set("g")).alias("gone"))

    rare = shared.where(f"n <= {RARE}").groupBy("tag").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    every = rare.select(F.posexplode("docs").alias("k", "b"), "docs").select(F.explode(F.slice("docs", F.lit(1), F.col("k"))).alias("a"), "b")
    hot = shared.where(f"n > {RARE}")
    left = hot.where("doc <> first").select("tag", "doc", "first")
    done = steps.write(left.select(F.col("first").alias("a"), F.col("doc").alias("b")).union(every).distinct(), "pairs-0")
    found, before, k = align(done, 0), left.count(), 0
    pivots = []
    while before:
        # What is left: documents with a common tag at a line that they still keep.
        rest = lines.join(left.select("doc").distinct(), "doc", "left_semi").select("doc.*", "lines", "words").join(together(found), ["id", "h"], "left")
        kept = tagged(rest.select("id", "h", "lines", "words", F.coalesce("gone", none).alias("gone")))
        left = steps.write(left.select("tag", "doc").join(kept, ["tag", "doc"], "left_semi"), f"left-{k}")
        now = left.count()
        last = SETTLED * (before - now) < before
        before, k = now, k + 1
        if last:
            # Of holders that would align alike the first one stands for all.
            reps = _first_alike(steps, lines, hot.select("doc").distinct())
            still = steps.write(left.select("tag").distinct(), "still")
            others = hot.select("tag", "doc").join(still, "tag", "left_semi").join(reps, "doc").select("tag", F.col("rep").alias("a")).distinct()
            firsts = lines.join(hot.join(still, "tag", "left_semi").select(F.col("first").alias("doc")).distinct(), "doc", "left_semi")
            spelt = firsts.select("lines", "words").mapInArrow(_spelt(fewest), "tag long, spelt array<long>").join(still, "tag", "left_semi").dropDuplicates(["tag"])
            met = _meetings(steps, lines, left, steps.write(others, "others"), steps.write(spelt, "spelt"))
        else:
            # A pivot keeps its line, as no pivot before deletes it, so the next one comes after it.
            after = left.join(pivots[-1], "tag", "left").where("a is null or doc > a") if pivots else left
            pivots.append(steps.write(after.groupBy("tag").agg(F.min("doc").alias("a")), f"pivots-{k}"))
            met = left.withColumnRenamed("doc", "b").join(pivots[-1], "tag").where("a < b").select("a", "b")
        met = steps.write(met.distinct(), f"met-{k}")  # once, before those done are left out: the plan would turn that round
        pairs = steps.write(met.join(done, ["a", "b"], "left_anti"), f"pairs-{k}")
        done = done.union(pairs)
        found = found.union(align(pairs, k))
        if last:
            break
    gone = steps.write(together(found), "gone")
    steps.drop(*[name for name in steps.paths if name != "gone"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    whole = whole.withColumn("maybe", maybe_in(spark, bitmap(gone.select(F.xxhash64("id").alias("x")), "x"))(F.xxhash64("id")))
    kept = F.filter(split(F.col("text")), lambda x, i: ~F.array_contains("gone", i))
    told = lambda removed, text: F.struct(F.size(split(F.col("text"))).cast("long").alias("n"), removed.alias("removed"), text.alias("text"))
    joined = whole.where("maybe").join(gone, ["id", "h"], "left").withColumn("gone", F.coalesce("gone", none))
    hit = joined.select("row", told(F.col("gone"), F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))).alias("lines"))
    rest = whole.where("not maybe").select("row", told(none, F.coalesce("text", F.lit(""))).alias("lines"))
    return hit.union(rest).select("row.*", "lines")


def op6_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines.n").alias("n_lines"), F.size("lines.removed").cast("long").alias("n_removed"), F.sha2("lines.text", 256).alias("kept_sha256"))
