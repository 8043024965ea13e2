"""Benchmark decontamination by spaced-seed hashing.

A window of 13 words is hashed under 13 masks. Mask t ignores the four places t, t + 1, t + 3, t + 9 (modulo 13): the lines
of the projective plane of order 3, in which any two places lie on exactly one line. So whatever two words of a window
were substituted, one mask ignores both and its hash still agrees. Hashes of documents and of benchmark items are joined;
around each hit the item is laid beside the document, and every window that agrees in 11 of 13 words or more counts.

An item of fewer than 13 words has a single window, itself. With 7 words or more it has masks that ignore one place each,
and may differ in one word; with 5 or 6 every word has to agree. One of fewer words says too little to be found within a
text, so only a text that consists of these words alone holds it.

Only hashes that pass a bitmap of the benchmark's hashes (of bounded size) leave the first scan; the join is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import PUNCTUATION, Steps, bitmap, constants, in_bitmap, maybe_in, mix, slices, table, text_buffer, word_hashes

WIDTH, SUBSTITUTED = 13, 2
#: A difference set modulo 13 (fixed values).
LINE = (0, 1, 3, 9)
#: Items with fewer words than this are only found where they are the whole text.
FEWEST = 5
BLOCK = 1 << 18


def allowed(width: int) -> int:
    """Words of a window of `width` that may be substituted."""
    return SUBSTITUTED * width // WIDTH


def masks(width: int) -> list[tuple[int, ...]]:
    """The places that each mask of a window ignores."""
    if width == WIDTH:
        return [tuple((d + t) % WIDTH for d in LINE) for t in range(WIDTH)]
    return [(t,) for t in range(width)] if allowed(width) else [()]


def seeds(words: np.ndarray, at: np.ndarray, lengths=()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (window, mask) of the WIDTH-word windows and the place of each window's first word; then, for each shorter
    length given, of windows of that length, and of rows that have no other words if it is under FEWEST. Windows don't
    cross rows."""
    n = len(words)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    begin, end = at[of], at[of + 1]
    hashes, places = [], []
    order = constants(WIDTH, 51)
    for width in (WIDTH, *sorted(lengths)):
        if n < width:
            continue
        m = n - width + 1
        terms = [words[j : m + j] * order[j] for j in range(width)]
        whole = np.zeros(m, np.uint64)
        for t in terms:
            whole += t
        start = np.arange(m)
        place = np.flatnonzero((start == begin[:m]) & (start + width == end[:m]) if width < FEWEST else start + width <= end[:m])
        for ignored, salt in zip(masks(width), constants(WIDTH, 52 if width == WIDTH else 53 + width)):
            seen = whole.copy()
            for d in ignored:
                seen -= terms[d]
            hashes.append(mix(seen[place] ^ salt))
            places.append(place)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def overlap(item: np.ndarray, text: np.ndarray, shift: int) -> int:
    """Words of the item in agreeing windows, with the item's first word laid on the text's word number `shift`."""
    if len(item) < FEWEST and (shift or len(text) != len(item)):
        return 0
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    same = item[lo:hi] == text[lo + shift : hi + shift]
    width = min(WIDTH, len(item))
    if len(same) < width:
        return 0
    need = width - allowed(width)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= need)
    covered = np.zeros(len(same), bool)
    for g in good:
        covered[g : g + width] = True
    return int(covered.sum())


def _items(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        words, at = word_hashes(data, offsets, PUNCTUATION)
        out = []
        for r, i in enumerate(batch.column("item_id").to_pylist()):
            own = words[at[r] : at[r + 1]]
            if not len(own):
                continue
            short = (len(own),) if len(own) < WIDTH else ()
            hashes, places = seeds(own, np.array([0, len(own)]), short)
            out.append((i, own.view(np.int64).tolist(), hashes.view(np.int64).tolist(), places.tolist()))
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())))], names=["item_id", "words", "hashes", "places"])


def _scan(bits, lengths):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK):
                words, at = word_hashes(data, offsets[i : j + 1], PUNCTUATION)
                hashes, places = seeds(words, at, lengths)
                hit = in_bitmap(bits.value, hashes.view(np.int64))
                hashes, places = hashes[hit], places[hit]
                row = np.searchsorted(at, places, side="right") - 1
                order = np.argsort(row, kind="stable")
                hashes, places, row = hashes[order], places[order], row[order]
                rows, first = np.unique(row, return_index=True)
                last = np.append(first[1:], len(row))
                lists = lambda parts, t: pa.array([p.tolist() for p in parts], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("content").take(pa.array(i + rows)),
                        lists([words[at[r] : at[r + 1]].view(np.int64) for r in rows], pa.int64()),
                        lists([hashes[a:b].view(np.int64) for a, b in zip(first, last)], pa.int64()),
                        lists([places[a:b] - at[r] for r, a, b in zip(rows, first, last)], pa.int32()),
                    ],
                    names=["content", "words", "hashes", "places"],
                )

    return run


def _verify(batches):
    """The best place of each item in each text, from the item's words and all shifts at which a seed agrees."""
    for batch in batches:
        out = []
        for content, i, words, item, shifts in zip(*(batch.column(c) for c in ("content", "item_id", "words", "item", "shifts"))):
            text, own = (np.array(x.values.to_numpy(), np.int64) for x in (words, item))
            n, back, shift = max((overlap(own, text, s), -s, s) for s in shifts.as_py())
            if n:
                out.append((content.as_py(), i.as_py(), n, max(0, shift), len(own)))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["content", "item_id", "n_words", "at_word", "item_words"])


def contaminated(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(content, item_id, n_words, at_word, item_words): which text holds which item, over texts (text) and benchmark (item_id, text).

    content: md5 of the text, so equal texts are judged once. n_words: the item's words in agreeing windows, where they
    are most (first of equals); at_word: the word of the text at which the item begins there. Null or empty texts and
    items agree with nothing, items under FEWEST words only with whole texts; the items of null id count like others;
    items that repeat under one id are one item each. Words are runs of letters and digits, A-Z lower-cased.
    """
    spark = texts.sparkSession
    steps = Steps(spark)
    items = steps.write(benchmark.select("item_id", "text").where("text is not null").mapInArrow(_items, "item_id long, words array<long>, hashes array<long>, places array<int>"), "items")
    lengths = [r[0] for r in items.select(F.size("words")).where(F.size("words") < WIDTH).distinct().collect()]
    known = items.select("item_id", "words", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("item_id", "words", F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_at"))
    bits = spark.sparkContext.broadcast(bitmap(known.select("hash").distinct(), "hash", per_hash=256))
    scanned = texts.where("text is not null").select("text", F.md5("text").alias("content"))
    scanned = scanned.mapInArrow(_scan(bits, tuple(lengths)), "content string, words array<long>, hashes array<long>, places array<int>")
    scanned = steps.write(scanned, "scanned").dropDuplicates(["content"])
    hits = scanned.select("content", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("content", F.col("s.hashes").alias("hash"), F.col("s.places").alias("text_at"))
    pairs = hits.join(known.select("item_id", "hash", "item_at", F.xxhash64("words").alias("name")), "hash").select("content", "item_id", "name", (F.col("text_at") - F.col("item_at")).alias("shift")).distinct()
    pairs = pairs.groupBy("content", "item_id", "name").agg(F.collect_list("shift").alias("shifts"))
    named = items.select(F.col("item_id").alias("i"), F.xxhash64("words").alias("w"), F.col("words").alias("item")).dropDuplicates(["i", "w"])
    found = pairs.join(named, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("name") == F.col("w"))).join(scanned.select("content", "words"), "content")
    found = found.select("content", "item_id", "words", "item", "shifts").mapInArrow(_verify, "content string, item_id long, n_words long, at_word long, item_words long")
    best = F.max(F.struct("n_words", (-F.col("at_word")).alias("o"), "at_word", "item_words")).alias("b")
    return found.groupBy("content", "item_id").agg(best).select("content", "item_id", "b.n_words", "b.at_word", "b.item_words")


def op3_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds; clean documents have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Steps(spark).write(contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated")
    named = docs.select("doc_id", F.md5("text").alias("content"))
    return named.join(found, "content").select("doc_id", "item_id", "n_words", "at_word", "item_words").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item; null texts stay. Only rows that a bitmap of the found texts may hold are joined."""
    spark = docs.sparkSession
    leaked = Steps(spark).write(contaminated(docs.select("text"), benchmark).select("content", F.xxhash64("content").alias("hash")).distinct(), "leaked")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.md5("text").alias("content"))
    rows = rows.withColumn("maybe", maybe_in(spark, bitmap(leaked, "hash"))(F.xxhash64(F.coalesce("content", F.lit("")))))
    checked = rows.where("maybe").join(leaked.select("content"), "content", "left_anti")
    return checked.select("row").union(rows.where("not maybe").select("row")).select("row.*")


#: For items of WIDTH words and more. A window that agrees in 11 of 13 words agrees in four consecutive ones, so laying
#: items on documents wherever four words agree finds all windows.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS dw FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS iw FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, p, array_to_string(dw[p + 1 : p + 4], ' ') AS g FROM dw, unnest(range(greatest(len(dw) - 3, 0))) AS u(p)),
ig AS (SELECT item_id, p, array_to_string(iw[p + 1 : p + 4], ' ') AS g FROM iw, unnest(range(greatest(len(iw) - 3, 0))) AS u(p)),
met AS (SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS s FROM dg JOIN ig USING (g)),
laid AS (
  SELECT doc_id, item_id, s, len(iw) AS n, len(dw) AS m, list_transform(range(len(iw)), lambda j: CASE WHEN s + j >= 0 AND dw[s + j + 1] = iw[j + 1] THEN 1 ELSE 0 END) AS x
  FROM met JOIN dw USING (doc_id) JOIN iw USING (item_id)),
good AS (SELECT *, list_filter(range(n - 12), lambda k: s + k >= 0 AND s + k + 13 <= m AND list_sum(x[k + 1 : k + 13]) >= 11) AS w FROM laid),
told AS (SELECT doc_id, item_id, s, n, len(list_distinct(flatten(list_transform(w, lambda k: range(k, k + 13))))) AS n_words FROM good WHERE len(w) > 0)
SELECT doc_id, item_id, n_words::BIGINT AS n_words, greatest(s, 0)::BIGINT AS at_word, n::BIGINT AS item_words
FROM told QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, s) = 1
"""
