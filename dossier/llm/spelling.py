"""Spelling variants of words by rolling-hash deletions.

Two words differ by one replaced code point if they agree once each has lost the code point at that place, and by one
inserted or deleted code point if one of them is the other less a code point. So each word gives a key for itself and one
for each of its deletions. The key of a deletion is the polynomial of the code points before the place plus that of the
code points after it, moved by one: prefix and suffix sums of a whole batch give all of them in a few NumPy operations.

Keys are dealt to tasks by their bits and sorted there; only words that share a key go on. Then the strings decide: the
word less its code point is the group, the key only finds it. A group holds at most as many words as there are code
points (times the places of an insertion), for all words are distinct, and no pair of them is written out: each member
takes the group's size and its best other member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import Steps, mix, slices, table, text_buffer

RUN = "[A-Za-zÀ-ÿ]+"
#: The polynomials' base modulo 2^64, and its inverse. They only find groups; strings decide.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of words whose keys are made at once.
BLOCK = 1 << 18


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted_words(docs: DataFrame, every: int = 97, least: int = 5, often: int = 3) -> DataFrame:
    """(word, n): words of at least `least` code points with `often` occurrences or more in docs (doc_id, text).

    Words are the lower-cased runs of letters; where `every` divides the CRC-32 of `doc_id:run`, the run loses the code
    point that the checksum names. Occurrences are summed in the map tasks, so a frequent word is a row of each.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run")).where(F.char_length("run") >= least)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    runs = runs.select("run", F.when(h % every == 0, (h % F.char_length("run")).cast("int")).alias("cut"))
    word = F.when(F.col("cut").isNull(), F.col("run")).otherwise(F.concat(F.substr("run", F.lit(1), F.col("cut")), F.substr("run", F.col("cut") + 2)))
    return runs.groupBy(word.alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= often) & (F.char_length("word") >= least))


def deletion_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, row, place (-1: the word itself) and whether the deletion is the first of its run of equal code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.int64)
    size = np.diff(np.append(lead, len(data)))
    points = np.where(size == 1, points, points & (0x7F >> size))
    for k in range(1, 4):
        more = size > k
        points[more] = points[more] << 6 | (data[lead[more] + k] & 0x3F)
    at = np.searchsorted(lead, offsets)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(points)) - at[row]
    up = np.full(int(count.max(initial=0)) + 1, BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64)) * up[place], out=sums[1:])
    prefix = sums[:-1] - sums[at[row]]
    suffix = (sums[at[row + 1]] - sums[1:]) * np.uint64(INVERSE)
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (row[1:] != row[:-1])
    whole = sums[at[1:]] - sums[at[:-1]]
    length = mix(np.arange(len(up) + 1, dtype=np.uint64))
    keys = np.concatenate([mix(whole + length[count]), mix(prefix + suffix + length[count[row] - 1])])
    rows = np.concatenate([np.arange(len(count)), row])
    return keys, rows, np.concatenate([np.full(len(count), -1), place]), np.concatenate([np.ones(len(count), bool), first])


def keyed(words: DataFrame) -> DataFrame:
    """(key, id, place, first) for each key of words (id, word)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("word"))
            ids = batch.column("id").to_numpy()
            for i, j in slices(offsets, BLOCK):
                keys, rows, place, first = deletion_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(0, len(keys), BLOCK):
                    part = slice(k, k + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(ids[i + rows[part]]), pa.array(place[part].astype(np.int32)), pa.array(first[part])], names=["key", "id", "place", "first"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, place int, first boolean")


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best) for words (id, word, n) that have near words; best is (word, n, id) of the most frequent one.

    Words are distinct. Ties go to the smallest word in code-point order.
    """
    by_key = Window.partitionBy("key")
    shared = keyed(words).withColumn("of", F.count("*").over(by_key)).where("of > 1").drop("of")
    rows = shared.join(words, "id")
    cut = F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr("word", F.col("place") + 2))
    rows = rows.withColumn("less", F.when(F.col("place") < 0, F.col("word")).otherwise(cut)).withColumn("own", F.struct((-F.col("n")).alias("m"), "word", "id"))
    same = Window.partitionBy("key", "less")
    alike = Window.partitionBy("key", "less", "place")
    ranked = alike.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_word = F.col("place") < 0
    rows = rows.select(
        "id",
        "own",
        is_word.alias("is_word"),
        "first",
        F.count("*").over(alike).alias("replaced"),
        F.first("own").over(ranked).alias("one"),
        F.nth_value("own", 2).over(ranked).alias("two"),
        F.max(F.when(is_word, F.col("own"))).over(same).alias("shorter"),
        F.sum(F.when(~is_word & F.col("first"), 1).otherwise(0)).over(same).alias("n_longer"),
        F.min(F.when(~is_word & F.col("first"), F.col("own"))).over(same).alias("longer"),
    )
    shorter = F.when(F.col("first"), F.col("shorter"))
    other = F.when(F.col("one.id") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    found = rows.select(
        "id",
        F.when(F.col("is_word"), F.col("n_longer")).otherwise(F.col("replaced") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("n_near"),
        F.when(F.col("is_word"), F.col("longer")).otherwise(F.array_min(F.array_compact(F.array(other, shorter)))).alias("best"),
    )
    found = found.where("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("id", "n_near", F.struct(F.col("best.word").alias("word"), (-F.col("best.m")).alias("n"), F.col("best.id").alias("id")).alias("best"))


def _roots(steps: Steps, forms: DataFrame) -> DataFrame:
    """(id, root): where the links (id, to) end. Each round doubles what a link spans; n doubles along each link at least,
    so a chain has 63 links at most and there are six rounds at most."""
    links = steps.write(forms.select("id", F.col("to").alias("root")), "links-0")
    k = 0
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("on"))
        moved = links.join(ahead, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved"))
        k += 1
        moved = steps.write(moved, f"links-{k}")
        steps.drop(f"links-{k - 1}")
        links = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word, n; other columns are left out), words distinct.

    Near words differ by one inserted, deleted or replaced code point. form: the near word of largest n (ties: the
    smallest in code-point order), if that is at least `times` (2 or more) the word's own; else null. root: from the word
    along forms to the last one. Rows with a null word or n are left out. An empty table gives an empty one.
    """
    if times < 2:
        raise ValueError("forms lead on for ever unless n grows along them")
    steps = Steps(words.sparkSession)
    named = words.where("word is not null and n is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    named = steps.write(named, "words")
    found = near(named).withColumnRenamed("id", "near_id")
    joined = named.join(found, F.col("id") == F.col("near_id"), "left")
    form = F.when(F.col("best.n") >= times * F.col("n"), F.col("best"))
    joined = steps.write(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form")), "forms")
    roots = _roots(steps, joined.where("form is not null").select("id", F.col("form.id").alias("to")))
    ends = roots.join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = joined.join(ends, "id", "left")
    return out.select("word", F.col("form.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark)
    return variants(steps.write(counted_words(table(spark, sf_dir, "documents")), "counted"))


#: DuckDB has no CRC-32, so its table (polynomial 0xEDB88320, a fixed value) is worked out first. Runs hold two-byte letters at most.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b
  FROM runs WHERE length(run) >= 5),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, t),
cut AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, p AS at, substring(word, 1, p) || substring(word, p + 2) AS v FROM words, unnest(range(length(word))) AS u(p)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.v = b.v AND a.at = b.at AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON words.word = less.v
  UNION SELECT words.word, less.word FROM less JOIN words ON words.word = less.v),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, {'n': -o.n, 'w': other}) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form, CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
ends AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT ends.word, formed.form FROM ends JOIN formed ON formed.word = ends.root WHERE formed.form IS NOT NULL),
roots AS (SELECT ends.word, root FROM ends JOIN formed ON formed.word = root WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN roots ON roots.word = formed.word
"""
