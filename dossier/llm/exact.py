"""Exact deduplication by two passes of a Bloom filter; DataFrame functions only.

First pass: each text's hash names a block of the filter and three places in it, and places that two rows or more hit
are set. Second pass: a row is possibly repeated if all its places are set. Only such rows are shuffled and compared by
the SHA-256 of their normalised texts; all others pass straight through. A copy hits every place of its original, so no
copy is missed; a row that is taken for repeated by chance is found alone and stays.

The filter ends at `most_bits` (32 MB), whatever the data, which bounds what is broadcast. Fuller than planned (beyond
16 million rows) it lets more rows be shuffled, with identical results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import Steps, table

#: Bits of a block of the filter, as bitmap_construct_agg has them; places that a hash has in its block.
BLOCK_BITS, PLACES = 1 << 15, 3
#: Bits for each row, up to MOST_BITS in all.
PER_ROW, MOST_BITS = 16, 1 << 28


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _block(hash_: Column, blocks: int) -> Column:
    return hash_.bitwiseAND(F.lit(blocks - 1))


def _places(hash_: Column) -> list[Column]:
    return [F.shiftrightunsigned(hash_, 19 + 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PLACES)]


def blocks_for(rows: int, most_bits: int = MOST_BITS) -> int:
    """Blocks of the filter: a power of two, up to 2^19, as block and places share 64 bits."""
    blocks = 1
    while blocks * BLOCK_BITS < min(PER_ROW * rows, most_bits) and blocks < 1 << 19:
        blocks *= 2
    return blocks


def repeated_places(hashes: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter, (block, bits): a bit for each place that two rows or more of `hashes` hit. Copies are summed in the map tasks."""
    h = F.col(column)
    hit = hashes.select(_block(h, blocks).alias("block"), F.explode(F.array_distinct(F.array(*_places(h)))).alias("place"))
    often = hit.groupBy("block", "place").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def flagged(rows: DataFrame, column: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows with `maybe`: whether all places of their hash are set. The filter has `blocks` rows of 4 KB at most."""
    h, named = F.col(column), filter_.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    joined = rows.join(F.broadcast(named), _block(h, blocks) == F.col("__block"), "left")
    set_ = F.lit(True)
    for place in _places(h):
        byte = F.conv(F.hex(F.substr("__bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        set_ = set_ & (F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return joined.withColumn("maybe", F.coalesce(F.col("__bits").isNotNull() & set_, F.lit(False))).drop("__block", "__bits")


def groups(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text; other columns are left out).

    Of equal texts, white space apart, the row of the smallest doc_id stays; a null doc_id comes after all others. Of
    rows that share text and doc_id one stays. Null and empty texts are equal. An empty table gives an empty one.
    """
    steps = Steps(docs.sparkSession)
    rows = docs.select("doc_id", digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = steps.write(rows.withColumn("hash", F.xxhash64("text_sha256")), "digests")
    blocks = blocks_for(rows.count(), most_bits)
    filter_ = steps.write(repeated_places(rows, "hash", blocks), "filter")
    seen = flagged(rows, "hash", filter_, blocks)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    again = seen.where("maybe").select("doc_id", "text_sha256", "row")
    # Copies are summed in the map tasks; the groups are a written table, so that a join can split a large group.
    found = again.groupBy("text_sha256").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = steps.write(found.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n"), "groups")
    judged = again.join(found, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    alone = seen.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return judged.union(alone)


def distinct(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the row of the smallest doc_id.

    A null doc_id comes last; rows that share text and doc_id are told apart by a hash of their columns. Only possibly
    repeated rows are shuffled with their columns, and of these one of each text leaves a map task.
    """
    steps = Steps(docs.sparkSession)
    hash_ = F.xxhash64(normalised(F.col("text")))
    hashes = steps.write(docs.select(hash_.alias("hash")), "hashes")
    blocks = blocks_for(hashes.count(), most_bits)
    filter_ = steps.write(repeated_places(hashes, "hash", blocks), "filter")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(row.alias("row"), digest(F.col("text")).alias("name"), hash_.alias("hash"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), content.alias("content")).alias("order"))
    seen = flagged(rows, "hash", filter_, blocks)
    first = seen.where("maybe").groupBy("name").agg(F.min_by("row", "order").alias("row"))
    return first.select("row.*").union(seen.where("not maybe").select("row.*"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""
