"""Facets in one pass, version groups, implicit windows, sorts and set operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import ids
from dossier.functions.calc import date_value
from dossier.functions.text import collapse, is_stamp_line, line_signature, natural_key, s, sub
from dossier.steps import written


def facet_counts(df: DataFrame, **facets: Column) -> DataFrame:
    """(facet, value, n): each facet is a string column or an array of strings; empty values are left out.

    One scan: each row becomes its (facet, value) pairs, which are counted on the map side first.
    """
    many = lambda c: df.select(c).schema[0].dataType.typeName() == "array"
    named = lambda f: lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    pairs = [F.transform(c if many(c) else F.array(c.cast("string")), named(f)) for f, c in facets.items()]
    rows = df.select(F.explode(F.concat(*pairs)).alias("p")).select("p.facet", "p.value").where("value is not null and value <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def top_values(counts: DataFrame, facet: str, k: int = 40) -> DataFrame:
    return counts.where(F.col("facet") == facet).orderBy(F.col("n").desc(), "value").limit(k)


def version_key() -> Column:
    """What the versions of a document have in common: its canonical number, or the row's id if it has none."""
    return F.when(s("li") == "", F.concat(F.lit("id:"), F.col("id"))).otherwise(ids.document_key(F.col("li")))


def version_groups(documents: DataFrame) -> DataFrame:
    """(key, first_id, versions newest first, starred if any is, needsReview by the newest). Texts are not gathered."""
    item = F.struct((-ids.version_number(F.col("ver"))).alias("o"), "id", "ver", "li", "title", "reason", "fgroup", "date", "star", "size")
    starred = F.bool_or(F.coalesce("star", F.lit(False))).alias("starred")
    groups = documents.groupBy(version_key().alias("key")).agg(F.array_sort(F.collect_list(item)).alias("versions"), F.min("id").alias("first_id"), starred)
    head = F.col("versions")[0]
    lacks = (s(head["li"]) == "") | (s(head["title"]) == "") | (s(head["fgroup"]) == "") | (s(head["date"]) == "")
    return groups.withColumn("needsReview", lacks)


def by_vin(files: DataFrame) -> DataFrame:
    """(vin, n, series): series from the number, else from the first datacard number that has one."""
    from dossier.functions.vin import series

    rows = files.select("id", F.explode(F.array_distinct("vins")).alias("vin"), F.filter(F.transform("fins", series), lambda x: x != "").alias("of_fins"))
    firsts = F.min(F.when(F.size("of_fins") > 0, F.struct("id", F.get("of_fins", F.lit(0)).alias("x"))))["x"]
    return rows.groupBy("vin").agg(F.count("*").alias("n"), firsts.alias("f")).select("vin", "n", F.coalesce(F.nullif(series(F.col("vin")), F.lit("")), "f", F.lit("")).alias("series"))


def number_conflicts(orders: DataFrame, key: str, created: str, id: str) -> DataFrame:
    """Rows whose number another row holds already, with the first holder; blank numbers never clash.

    The first one is a minimum that map tasks work out, so a number that many rows have is a row of each of them.
    """
    rows = orders.withColumn("__k", ids.canon_order(F.col(key))).where("__k <> ''")
    first = rows.groupBy(F.col("__k").alias("__f")).agg(F.min(F.struct(created, id)).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    held = rows.join(first, F.col("__k") == F.col("__f")).where(~F.struct(created, id).eqNullSafe(F.col("__first")))
    return held.withColumn("holder", F.col("__first")[id]).drop("__k", "__f", "__first", "__n")


#: Rows of a stretch, which is what one task sorts, ranks or packs, and bytes of its texts and binary values.
STRETCH, WIDTH = 100_000, 64 << 20


def laid(df: DataFrame, *by: str) -> DataFrame:
    """Adds __stretch: rows in the order of `by` (nulls first), cut at sampled quantiles into stretches of some STRETCH rows,
    fewer if they are wide.

    Stretches are numbered in order, whatever the columns' types, and a value that many rows share runs over many of them
    if a later column tells its rows apart. They are a written table: cut anew for each reader, they might differ.
    """
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")).cast("long"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary") and f.name not in by]
    told = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(wide, F.lit(0).cast("long"))), F.lit(0)).alias("bytes")).first()
    n = max(-(-told.n // STRETCH), min(-(-told.bytes // WIDTH), told.n))
    if n <= 1:
        return df.withColumn("__stretch", F.lit(0))
    return written(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in by]).withColumn("__stretch", F.spark_partition_id()), "laid")


def _summed(rows: DataFrame, key: str, what: Column, name: str, within: Column) -> DataFrame:
    """Adds `name` to rows of `laid`: the sum of `what` in the key's stretches before, plus `within`. One row for each key
    and stretch is all that meets in one place."""
    sums = rows.groupBy(key, "__stretch").agg(F.sum(what).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(key).alias("__k"), F.col("__stretch").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.withColumn(name, within)
    rows = rows.join(sums, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__stretch") == F.col("__s")))
    return rows.withColumn(name, F.col(name) + F.col("__before")).drop("__k", "__s", "__before")


def ranked(df: DataFrame, key: Column, order: str, name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... in each key by `order`; null is a key. A key with a third of all rows is spread over many tasks."""
    rows = laid(df.withColumn("__key", key), "__key", order)
    within = F.row_number().over(Window.partitionBy("__key", "__stretch").orderBy(F.col(order).asc_nulls_first()))
    return _summed(rows, "__key", F.lit(1), name, within).drop("__key", "__stretch")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: the second row of a name gets " (2)" before its extension, and so on; case makes no difference."""
    ext = F.regexp_extract(F.col(name), r"(\.[A-Za-z0-9]{1,8})$", 1)
    base = F.expr(f"substring(`{name}`, 1, length(`{name}`) - length(regexp_extract(`{name}`, '([.][A-Za-z0-9]{{1,8}})$', 1)))")
    return ranked(df, F.lower(name), order, "__n").withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(base, F.lit(" ("), F.col("__n"), F.lit(")"), ext))).drop("__n")


def running_offsets(df: DataFrame, group: str, pos: str, length: str) -> DataFrame:
    """Adds offset: where each payload begins in its container. A container of any length is spread over many tasks."""
    rows = laid(df.withColumn("__key", F.col(group)), "__key", pos)
    order = Window.partitionBy("__key", "__stretch").orderBy(F.col(pos).asc_nulls_first())
    within = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _summed(rows, "__key", F.col(length), "offset", within).drop("__key", "__stretch")


def parts_by_count(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return ranked(df, F.col(group), order, "part").withColumn("part", F.floor((F.col("part") - 1) / n))


def _chains(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item, if a part began there: the item at which the next one begins (the number of items: none), how many
    parts begin from there on, it included, and what the last one holds. One more entry stands for no part at all."""
    n = len(sizes)
    sums = np.cumsum(sizes)
    before = sums - sizes
    some = np.append(np.where(sizes > 0, np.arange(n), n), n)
    full = np.minimum.accumulate(some[::-1])[::-1][:n]  # the first item from there on that has a size
    after = np.minimum(np.maximum(full + 1, np.searchsorted(sums, before + most, side="right")), n)
    count, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    held = (sums[-1] if n else 0) - before
    for k, j in zip(range(n - 1, -1, -1), after[::-1].tolist()):
        count[k], last[k] = (1, held[k]) if j == n else (1 + count[j], last[j])
    return np.append(after, n), count, last


def _entry(sums: np.ndarray, first_full: int, held: int, most: int) -> int:
    """The item at which the first part of a stretch begins, if the one before holds `held`; the number of items if none."""
    if held:
        return int(np.searchsorted(sums, most - held, side="right"))
    return min(max(first_full + 1, int(np.searchsorted(sums, most, side="right"))), len(sums))


def _known(sizes: pa.Array) -> tuple[np.ndarray, bool]:
    """Sizes up to the first null, and whether there is one: from there on no part begins."""
    nulls = np.flatnonzero(sizes.is_null().to_numpy(zero_copy_only=False))
    end = int(nulls[0]) if len(nulls) else len(sizes)
    return sizes.slice(0, end).to_numpy(zero_copy_only=False).astype(np.int64), bool(len(nulls))


def _outcomes(most: int):
    """For each stretch what becomes of a held size: from (bound, parts, held) on, in descending order of the size held on
    entry; a size at most the last bound starts no part. Neighbours with one outcome are one, so few are left."""

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                sizes, ends = _known(batch.column("items")[k].values.field("size"))
                _, count, last = _chains(sizes, most)
                sums = np.cumsum(sizes)
                full = np.flatnonzero(sizes > 0)
                zero = _entry(sums, int(full[0]) if len(full) else len(sizes), 0, most)
                bounds, n = most - sums, len(sizes)  # entered with more than bounds[j], a part begins at j or before
                new = np.flatnonzero((count[:n][1:] != count[:n][:-1]) | (last[:n][1:] != last[:n][:-1])) if n > 1 else np.zeros(0, np.int64)
                at = np.append(new, n - 1) if n else new  # the last item of each run of one outcome
                total = int(sums[-1]) if n else 0
                out.append((bounds[at].tolist(), count[at].tolist(), last[at].tolist(), int(count[zero]), int(last[zero]) if zero < n else total, total, ends))
            columns = list(zip(*out)) if out else [[]] * 7
            types = (*[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__stretch"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["__key", "__stretch", *_OUTCOME])

    return run


_OUTCOME = ("bounds", "counts", "helds", "zero_count", "zero_held", "total", "ends")


def _entries(batches):
    """(key, stretch, part, held) on entry to each stretch of a key, from the outcomes of those before in order."""
    for batch in batches:
        of, out = [], []
        for k, stretches in enumerate(batch.column("stretches").to_pylist()):
            part, held, over = 0, 0, False
            for x in stretches:
                of.append(k)
                out.append((x["__stretch"], part, held, over))
                if over:
                    continue
                at = next((j for j, b in enumerate(x["bounds"]) if held > b), None) if held else None
                if not held:
                    part, held = part + x["zero_count"], x["zero_held"]
                elif at is None:
                    held += x["total"]
                else:
                    part, held = part + x["counts"][at], x["helds"][at]
                over = x["ends"]
        columns = list(zip(*out)) if out else [[]] * 4
        types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(of, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["__key", "__stretch", "part", "held", "over"])


def _packed(most: int):
    def run(batches):
        for batch in batches:
            lists = []
            for k in range(batch.num_rows):
                items = batch.column("items")[k].values
                sizes, _ = _known(items.field("size"))
                parts = np.full(len(items), batch.column("part")[k].as_py(), np.int64)
                if not batch.column("over")[k].as_py():
                    after, _, _ = _chains(sizes, most)
                    full = np.flatnonzero(sizes > 0)
                    at = _entry(np.cumsum(sizes), int(full[0]) if len(full) else len(sizes), batch.column("held")[k].as_py(), most)
                    starts = np.zeros(len(items), np.int64)
                    while at < len(sizes):
                        starts[at] = 1
                        at = int(after[at])
                    parts += np.cumsum(starts)
                lists.append(parts.astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("items"), pa.array(lists, pa.list_(pa.int32()))], names=["__key", "items", "parts"])

    return run


def parts_by_size(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """(group, order, size, part): next-fit parts that stay within `most` unless one item alone exceeds it.

    Where a part ends depends on where it began, but a stretch of items turns what is held when it is entered into a
    number of parts and what is held at its end; most entries soon lead to the same starts, so that is a short table.
    Stretches are judged at once, their tables are followed from stretch to stretch, and then all are packed at once. So a
    group of any length is spread. Sizes are not negative; from a null one on no part begins.
    """
    rows = laid(df.select(F.col(group).alias("__key"), F.col(order).alias("order"), F.col(size).cast("long").alias("size")), "__key", "order")
    sql = {c: rows.schema[c].dataType.simpleString() for c in ("__key", "order")}
    items = rows.groupBy("__key", "__stretch").agg(F.array_sort(F.collect_list(F.struct("order", "size"))).alias("items"))
    told = items.mapInArrow(_outcomes(most), f"__key {sql['__key']}, __stretch int, bounds array<long>, counts array<long>, helds array<long>, zero_count long, zero_held long, total long, ends boolean")
    told = told.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__stretch", *_OUTCOME))).alias("stretches"))
    entries = told.mapInArrow(_entries, f"__key {sql['__key']}, __stretch int, part long, held long, over boolean")
    entries = entries.select(F.col("__key").alias("__k"), F.col("__stretch").alias("__s"), "part", "held", "over")
    whole = items.join(entries, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__stretch") == F.col("__s"))).select("__key", "items", "part", "held", "over")
    packed = whole.mapInArrow(_packed(most), f"__key {sql['__key']}, items array<struct<order: {sql['order']}, size: long>>, parts array<int>")
    each = packed.select(F.col("__key").alias(group), F.explode(F.arrays_zip("items", "parts")).alias("x"))
    return each.select(group, F.col("x.items.order").alias("order"), F.col("x.items.size").alias("size"), F.col("x.parts").alias("part"))


def furniture(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, signature, pages): line signatures on two pages or more."""
    rows = lines.select(doc, page, line_signature(F.col(text)).alias("signature"))
    # What is no signature is left out at the end, so that signatures are worked out once.
    return rows.groupBy(doc, "signature").agg(F.countDistinct(page).alias("pages")).where("pages >= 2 and signature <> ''")


def banded_furniture(lines: DataFrame) -> DataFrame:
    """(doc, signature) of lines (doc, page, ry, text) that stand at one height on two pages, within a fortieth of the page.

    Lines of dates and times alone count whatever letters they have. Each line stands at its band and the next one, so two
    lines share a place if their bands are equal or neighbours.
    """
    stamp = is_stamp_line(F.col("text"))
    signature = F.when(stamp, collapse(sub(F.lower(s("text")), r"\d+", "#"))).otherwise(line_signature(F.col("text")))
    band = F.floor(F.col("ry") * 40 + 0.5).cast("int")
    rows = lines.select("doc", "page", signature.alias("signature"), F.explode(F.array(band, band + 1)).alias("at"))
    met = rows.groupBy("doc", "signature", "at").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low <> high and signature <> ''")
    return met.select("doc", "signature").distinct()


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): of an even number of values the upper one of the middle two. Values are counted, not gathered."""
    by = Window.partitionBy(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__until", F.sum("__n").over(by.orderBy(value))).withColumn("__all", F.sum("__n").over(by))
    return counts.where("__until > floor(__all / 2)").groupBy(group).agg(F.min(value).alias("median"))


def islands(df: DataFrame, group: str, start: str, end: str, gap: Column) -> DataFrame:
    """Adds island, from 0 in each group: a row that starts more than `gap` beyond all ends before it begins a new one."""
    order = Window.partitionBy(group).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - reached > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def recent(df: DataFrame, k: int = 40) -> DataFrame:
    return df.orderBy(F.col("updatedAt").desc(), "id").limit(k)


#: Collations of names (accents and case aside) and of other texts, as locale-aware comparison has them.
NAMES, TEXTS = "UNICODE_CI_AI", "UNICODE"


def sort_key(df: DataFrame, by: str) -> list[Column]:
    """Total orders of the views: name (natural, accents and case aside), size, updated, price (none first), star."""
    keys = {
        "name": [F.collate(natural_key(F.col("name")), NAMES), F.col("name")],
        "size": [F.coalesce("size", F.lit(0)).desc()],
        "updated": [F.col("updatedAt").desc()],
        "price": [F.coalesce("price", F.lit(-1.0))],
        "star": [F.coalesce("star", F.lit(False)).desc()],
    }
    return [*keys[by], F.col("id")]


def group_sort_key(by: str, descending: bool = False) -> Column:
    """The order of version groups by a field of the newest version: star (any version's, starred first), ver and size as
    numbers (0 if none), date as a day (none first), others as texts; ties by key. One sortable column."""
    head = F.col("versions")[0]
    if by == "star":
        return F.struct((F.col("starred") if descending else ~F.col("starred")).alias("o"), F.col("key"))
    if by in ("ver", "size"):
        number = ids.version_number(head["ver"]) if by == "ver" else F.coalesce(head["size"].cast("double"), F.lit(0.0))
        return F.struct((-number if descending else number).alias("o"), F.col("key"))
    if by == "date":
        day = F.coalesce(date_value(head["date"]), F.lit(0))
        return F.struct((-day if descending else day).alias("o"), F.col("key"))
    if descending:
        raise ValueError("texts are sorted in ascending order; turn the view's order round")
    return F.struct(F.collate(s(head[by]), TEXTS).alias("o"), F.col("key"))


def mixed_sort_key(c: Column) -> Column:
    """Numbers before texts, numbers by value, texts as a locale has them: a total order in place of a rule between pairs."""
    number = F.regexp_extract(s(c), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$", 1).try_cast("double")
    return F.struct(number.isNull().alias("text"), F.coalesce(number, F.lit(0.0)).alias("number"), F.collate(s(c), TEXTS).alias("collated"), s(c).alias("plain"))


def merge_values(new: Column, old: Column) -> Column:
    """New values, then the old ones that are not among them, first places kept."""
    return F.array_union(F.coalesce(new, F.array().cast("array<string>")), F.coalesce(old, F.array().cast("array<string>")))


def carry_over(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Union in which rows of the target win."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"), allowMissingColumns=True)
