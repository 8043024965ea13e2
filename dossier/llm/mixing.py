"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sources share a total by weight. A target stops at `most` times its source's size, and what is over goes to the others
by weight until none is above: with sources sorted by limit over weight, that is one prefix sum. Every document of a
source expects target / size copies. Documents are laid out by size, so that each stretch of the layout holds documents
alike; their expected copies are prefix-summed, one random offset per source is added, and a document is emitted once
per integer boundary that its stretch crosses. The words taken then miss the target by about one document's size.

Prefix sums never bring a source into one task: counts per (source, size, salt) are summed first, and only within such
a cell are documents ranked. The counts are a written table, so texts are read twice: to count and to draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, Steps, table

#: Weights of the sources in order, repeated.
WEIGHTS = (3, 1, 2)
#: Documents of one size in one source are ranked in so many parts.
SALTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source that depends on the seed alone."""
    name = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = 150, most: int = 2, seed: int = 0) -> DataFrame:
    """One row per source: source, source_size, target, u (its offset), from rows (source, size). Null is a source, the last.

    The sum of targets is share_percent of all sizes, or `most` times all sizes if that is less. Integers throughout,
    but for the last division. The windows without keys run over one row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w.cast("long")).withColumn("limit", F.col("source_size") * most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    by = by.withColumn("total", F.sum("source_size").over(everything) * share_percent)
    by = by.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 100)
    by = by.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("free", (F.col("total") - F.col("before")) * F.col("weight") <= F.col("limit") * 100 * F.col("rest"))
    by = by.withColumn("level", F.first(F.when(F.col("free"), F.struct("total", "before", "rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shared = (F.col("level.total") - F.col("level.before")).cast("double") * F.col("weight") / (F.col("level.rest") * 100).cast("double")
    return by.select("source", "source_size", F.coalesce(shared, F.col("limit").cast("double")).alias("target"), _offset(F.col("source"), seed).alias("u"))


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = 150, most: int = 2, seed: int = 0, doc_id: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """All rows with struct column `mixed`: size, source_size, target, copies, taken (size times copies).

    size: words of column text, if not given. Null or empty texts have size 0; a source of such texts alone gets target
    0 and no copies. Null doc_ids are ranked first, rows of one doc_id by a hash of their columns. Further columns are
    kept, whatever their names but `mixed`; an empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"))
    # A key without nulls lets the ranks and the join use one shuffle.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("salt", F.coalesce(F.pmod("id", F.lit(SALTS)), F.lit(-1)).cast("int"))
    cells = rows.groupBy("key", "size", "salt").agg(F.first("source").alias("source"), F.count("*").alias("n"))
    cells = Steps(docs.sparkSession).write(cells, "cells")
    goals = targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share_percent, most, seed)
    goals = goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", "u")
    sizes = cells.groupBy("key", "size").agg(F.sum("n").alias("n_size"))
    sizes = sizes.withColumn("before_size", F.sum("n_size").over(Window.partitionBy("key").orderBy("size")) - F.col("n_size"))
    cells = cells.withColumn("before_salt", F.sum("n").over(Window.partitionBy("key", "size").orderBy("salt")) - F.col("n"))
    cells = cells.join(sizes, ["key", "size"]).join(goals, "key")
    cells = cells.select("key", "size", "salt", (F.col("before_size") + F.col("before_salt")).alias("before"), "source_size", "target", "u")
    # Rows of one id are told apart by their content, so that reruns draw the same ones whatever the order of the input.
    content = F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(F.col("id").asc_nulls_first(), content)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("before") + F.col("rank")).cast("double")
    crossed = F.floor(place * rate + F.col("u")) - F.floor((place - 1) * rate + F.col("u"))
    drawn = ranked.join(cells, ["key", "size", "salt"]).withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return drawn.select("row.*", F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")).alias("mixed"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it was drawn, with the columns of `docs`."""
    drawn = mix(docs, **options).where("mixed.copies > 0")
    return drawn.withColumn("mixed", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mixed.copies")))).drop("mixed")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(docs, size=F.col("size"))
    return mixed.select("doc_id", "size", "mixed.source_size", "mixed.target", "mixed.taken", "mixed.copies")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(((doc_id % 256) + 256) % 256, -1), doc_id NULLS FIRST) AS place FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, (sum(source_size) OVER ())::BIGINT * 150 AS total FROM per),
levels AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 100 AS before,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM weighed WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
free AS (
  SELECT total, before, rest FROM levels WHERE (total - before) * weight <= 2 * source_size * 100 * rest
  ORDER BY 2 * source_size / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT l.source, l.source_size,
    CASE WHEN (l.total - l.before) * l.weight <= 2 * l.source_size * 100 * l.rest OR l.before > f.before
      THEN (f.total - f.before)::DOUBLE * l.weight / (f.rest * 100)::DOUBLE ELSE (2 * l.source_size)::DOUBLE END AS target,
    ('0x' || substr(md5('0:' || coalesce('=' || l.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM levels l LEFT JOIN free f ON true),
drawn AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, g.u, r.place::DOUBLE AS place,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT *, least((floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT, 2::BIGINT) AS copies FROM drawn)
"""
