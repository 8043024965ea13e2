"""Differences of pairs of texts, with moved blocks.

`diff` aligns the items (lines or words) of each pair. `revisions` goes in two levels, as rows: lines are aligned first,
by their hashes; the stretches between aligned lines become rows of their own, whose words are aligned one stretch at a
time, so a large pair is worked on by many tasks and no word is matched across an aligned line. Then, on what is left of
each pair, short coincidences between changes dissolve and runs that were taken out here and put in there are moves.

Alignments are longest common subsequences by bit-parallel rows: a row of the table is one integer, whose zeros tell where
the length grows. The time is the product of the lengths over the width of a machine's addition of long integers, and every
so many rows are kept, so that memory follows the root of it. Steps are those of the whole table; of equal choices a
removal comes first.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import WS, collapse, line_signature, sub
from dossier.steps import written

RUN = "op string, a int, b int, n int"
#: Items that occur more often have their places held as one integer.
OFTEN = 64


class _Rows:
    """Rows of the table of longest common subsequences of a's and b's ends. Bit p of a row stands for the last p + 1 items
    of b; it is 0 where they have one more in common with a's end than the last p."""

    def __init__(self, a: list, b: list):
        self.a, self.m = a, len(b)
        self.full = (1 << self.m) - 1
        self.places: dict = {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(self.m - 1 - j)
        self.masks: dict = {}

    def mask(self, x) -> int:
        """The places of x in b."""
        if x in self.masks:
            return self.masks[x]
        out, found = 0, self.places.get(x, ())
        for p in found:
            out |= 1 << p
        if len(found) > OFTEN:
            self.masks[x] = out
        return out

    def before(self, lo: int, hi: int, row: int):
        """Rows hi - 1 down to lo, from row hi."""
        for i in range(hi - 1, lo - 1, -1):
            found = self.mask(self.a[i])
            if found:
                both = row & found
                row = ((row + both) | (row - both)) & self.full
            yield row

    def shared(self, row: int, j: int) -> int:
        """What b from j on has in common with the row's end of a."""
        left = self.m - j
        return left - (row & ((1 << left) - 1)).bit_count()


def _walk(a: list, b: list) -> list[tuple[str, int, int]]:
    n, m = len(a), len(b)
    rows = _Rows(a, b)
    every = max(1, math.isqrt(n))
    held = {n: rows.full}
    for i, row in zip(range(n - 1, -1, -1), rows.before(0, n, rows.full)):
        if i % every == 0:
            held[i] = row
    left = rows.shared(held[0], 0)
    out: list[tuple[str, int, int]] = []
    i = j = 0
    while left:
        last = min(n, i + every)
        piece, first = [held[last], *rows.before(i, last, held[last])][::-1], i
        while left and i < last:
            if a[i] == b[j]:
                out.append(("=", i, j))
                i, j, left = i + 1, j + 1, left - 1
            elif not piece[i - first] >> (m - 1 - j) & 1 or rows.shared(piece[i + 1 - first], j) == left:
                out.append(("-", i, j))
                i += 1
            else:
                out.append(("+", i, j))
                j += 1
    return [*out, *(("-", k, j) for k in range(i, n)), *(("+", n, k) for k in range(j, m))]


def steps(a: list, b: list, trim: bool = True) -> list[tuple[str, int, int]]:
    """Steps (op, i, j), op = - +, from a to b in order. trim: what is alike at both ends is aligned first."""
    i0, i1, j0, j1 = 0, len(a), 0, len(b)
    while trim and i0 < i1 and j0 < j1 and a[i0] == b[j0]:
        i0, j0 = i0 + 1, j0 + 1
    while trim and i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
        i1, j1 = i1 - 1, j1 - 1
    middle = [(op, i0 + i, j0 + j) for op, i, j in _walk(a[i0:i1], b[j0:j1])]
    return [*(("=", k, k) for k in range(i0)), *middle, *(("=", i1 + k, j1 + k) for k in range(len(a) - i1))]


class Block:
    """A stretch of a pair: kept (whole: with a line that is kept whole), changed, or moved whole (< from a, > to b)."""

    __slots__ = ("a", "b", "kind", "na", "nb", "whole")

    def __init__(self, kind: str, a: int, na: int, b: int, nb: int, whole: bool = False):
        self.kind, self.a, self.na, self.b, self.nb, self.whole = kind, a, na, b, nb, whole


def joined(blocks: list[Block]) -> list[Block]:
    """Neighbours of one kind as one block."""
    out: list[Block] = []
    for x in blocks:
        if out and out[-1].kind == x.kind:
            y = out[-1]
            out[-1] = Block(y.kind, y.a, y.na + x.na, y.b, y.nb + x.nb, y.whole or x.whole)
        else:
            out.append(x)
    return out


def blocks_of(found: list[tuple[str, int, int]], a: int = 0, b: int = 0) -> list[Block]:
    """Blocks of steps; a and b are what the steps' places count from."""
    return joined([Block("=" if op == "=" else "~", a + i, int(op != "+"), b + j, int(op != "-")) for op, i, j in found])


#: A kept stretch of up to SHORT items between changes of LEAST items or more each and TOGETHER in all is a coincidence.
SHORT, LEAST, TOGETHER, PASSES = 2, 2, 6, 6


def without_coincidences(blocks: list[Block]) -> list[Block]:
    """Short kept stretches between large changes become part of the change, but lines kept whole stay. What joins may make
    a neighbour's change larger, so it is done again, PASSES times at most."""
    for _ in range(PASSES):
        size = [x.na + x.nb if x.kind == "~" else 0 for x in blocks]
        odd = [x.kind == "=" and not x.whole and x.na <= SHORT and 0 < k < len(blocks) - 1 and min(size[k - 1], size[k + 1]) >= LEAST and size[k - 1] + size[k + 1] >= TOGETHER for k, x in enumerate(blocks)]
        if not any(odd):
            break
        blocks = joined([Block("~", x.a, x.na, x.b, x.nb) if dissolves else x for x, dissolves in zip(blocks, odd)])
    return blocks


def _ranks(items: np.ndarray, most: int) -> list[np.ndarray]:
    """For each k, numbers that are equal where the 2^k items from a place on are; as suffix arrays are made by doubling."""
    out = [np.unique(items, return_inverse=True)[1].astype(np.int64)]
    while 2 << len(out) - 1 <= most:
        half, size = out[-1], 1 << len(out) - 1
        after = np.full(len(half), -1, np.int64)
        after[:-size] = half[size:]
        out.append(np.unique(half * (len(half) + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
    return out


def moved(gone: list[list], come: list[list], least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Which items of the removed runs and of the added runs are moves (flags over all runs' items, one after the other).

    The longest run that a removed and an added one have in common is a move, of equals the one that is first in the
    removed and then in the added runs; then the longest of what is left, down to `least` items. Then single items that
    stand beside a moved one on both sides are moved too (beside one on the removed side if they have no letter or
    digit), five times at most; and if six tenths of all are moved, whatever is left on both sides is.
    """
    both = [*gone, *come]
    sizes = np.array([len(r) for r in both], np.int64)
    split = int(sizes[: len(gone)].sum())
    tokens = [x for r in both for x in r]
    total = len(tokens)
    used = np.zeros(total, bool)
    if not split or split == total:
        return used[:split], used[split:]
    numbers: dict = {}
    items = np.array([numbers.setdefault(x, len(numbers)) for x in tokens], np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)  # of the run of each item
    begin = end - np.repeat(sizes, sizes)
    ranks = _ranks(items, int(sizes.max()))

    def held(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which n unused items of one run begin that stand on both sides, and their names."""
        taken = np.concatenate([[0], np.cumsum(used)])
        at = np.arange(total)
        at = at[end - at >= n]
        at = at[taken[at + n] == taken[at]]
        k = n.bit_length() - 1
        name = ranks[k][at] * (total + 1) + ranks[k][at + n - (1 << k)]
        shared = np.intersect1d(name[at < split], name[at >= split])
        keep = np.isin(name, shared)
        return at[keep], name[keep]

    top = int(min(sizes[: len(gone)].max(), sizes[len(gone) :].max()))
    while top >= least:
        low, high = least - 1, top  # the longest length that both sides share: whoever shares n share n - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(held(middle)[0]) else (low, middle - 1)
        top = low
        if top < least:
            break
        at, name = held(top)
        targets: dict = {}
        for j, x in zip(at[at >= split].tolist(), name[at >= split].tolist()):
            targets.setdefault(x, deque()).append(j)
        for i, x in zip(at[at < split].tolist(), name[at < split].tolist()):
            if used[i : i + top].any():
                continue
            while targets[x] and used[targets[x][0] : targets[x][0] + top].any():
                targets[x].popleft()
            if targets[x]:
                j = targets[x].popleft()
                used[i : i + top] = used[j : j + top] = True
        top -= 1

    beside = lambda k: (k > begin[k] and used[k - 1]) or (k + 1 < end[k] and used[k + 1])
    bare = np.array([re.fullmatch(r"[^A-Za-z0-9]+", str(x)) is not None for x in numbers])
    free: dict = {}  # added items that are left, by item; near: those beside a moved one
    near: dict = {}
    for j in range(split, total):
        if not used[j]:
            free.setdefault(int(items[j]), deque()).append(j)
            if beside(j):
                near.setdefault(int(items[j]), []).append(j)

    def take(i: int, j: int) -> None:
        used[i] = used[j] = True
        for k in (j - 1, j + 1):
            if begin[j] <= k < end[j] and not used[k]:
                heapq.heappush(near.setdefault(int(items[k]), []), k)

    def first(found) -> int | None:
        while found and used[found[0]]:
            found.popleft() if isinstance(found, deque) else heapq.heappop(found)
        return found[0] if found else None

    for _ in range(5):
        before = int(used.sum())
        for i in range(split):
            if not used[i] and beside(i):
                x = int(items[i])
                j = first(free.get(x)) if bare[x] else first(near.get(x))
                if j is not None:
                    take(i, j)
        if used.sum() == before:
            break
    if used.sum() >= 0.6 * total:
        for i in range(split):
            if not used[i] and (j := first(free.get(int(items[i])))) is not None:
                used[i] = used[j] = True
    return used[:split], used[split:]


def _pieces(op: str, moved_op: str, first: int, flags: np.ndarray, other: int, of_a: bool) -> list[tuple]:
    """Runs of one side of a change, parted where what is moved begins or ends."""
    cuts = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)] if len(flags) else [0]
    out = [(moved_op if flags[i] else op, first + i, other, j - i) for i, j in zip(cuts, cuts[1:])]
    return out if of_a else [(o, y, x, n) for o, x, y, n in out]


def finished(blocks: list[Block], a, b, moves: int | None = 3) -> list[tuple[str, int, int, int]]:
    """Runs (op, a, b, n) of blocks: = kept, - removed, + added, < moved from, > moved to. Of a change, what is removed comes
    first. a and b give the items of a stretch."""
    changes = [x for x in blocks if x.kind == "~"]
    gone, come = [a(x.a, x.na) for x in changes], [b(x.b, x.nb) for x in changes]
    flags = moved(gone, come, moves) if moves else tuple(np.zeros(sum(map(len, r)), bool) for r in (gone, come))
    out: list[tuple[str, int, int, int]] = []
    p = q = 0
    for x in blocks:
        if x.kind == "~":
            out += _pieces("-", "<", x.a, flags[0][p : p + x.na], x.b, True) + _pieces("+", ">", x.b, flags[1][q : q + x.nb], x.a + x.na, False)
            p, q = p + x.na, q + x.nb
        else:
            out.append((x.kind, x.a, x.b, max(x.na, x.nb)))
    return out


def runs(a: list, b: list, moves: int | None = 3) -> list[tuple[str, int, int, int]]:
    """Runs of two lists; runs of `moves` items or more that were removed here and added there are moves, none if null."""
    return finished(blocks_of(steps(a, b)), lambda k, n: a[k : k + n], lambda k, n: b[k : k + n], moves)


def diff(pairs: DataFrame, a: str = "a", b: str = "b", by: str = "line", ignore_case: bool = False, ignore_space: bool = False, moves: int | None = 3) -> DataFrame:
    """Adds runs: array of (op, a, b, n) for each pair of texts, whose items are lines or words. Null texts are empty."""

    def cut(t):
        t = t or ""
        parts = t.split() if by == "word" else t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if ignore_case:
            parts = [p.lower() for p in parts]
        return [" ".join(p.split()) for p in parts] if ignore_space else parts

    @F.pandas_udf(f"array<struct<{RUN}>>")
    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("op", "a", "b", "n"), r)) for r in runs(cut(p), cut(q), moves)] for p, q in zip(x, y)])

    return pairs.withColumn("runs", work(F.col(a), F.col(b)))


def content_lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, side, line, start, tokens) for texts (key, side, text): the words of each line that has any, in one form.

    Lines that stand on two pages or more of either side of a key (pages end at form feeds) are left out, and words
    parted by a hyphen at the end of a line are joined. start: words of the side before the line.
    """
    rows = texts.select(key, "side", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "x"))
    rows = rows.withColumn("page", F.sum((F.col("x") == "\f").cast("int")).over(Window.partitionBy(key, "side").orderBy("at")))
    rows = rows.where("x <> '\f'").withColumn("signature", line_signature(F.col("x")))
    again = rows.where("signature <> ''").groupBy(key, "side", "signature").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low <> high")
    rows = rows.join(again.select(key, "signature").distinct(), [key, "signature"], "left_anti")
    whole = rows.groupBy(key, "side").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("x"))
    text = sub(F.array_join("x.x", "\n"), rf"([A-Za-zÀ-ɏ])[\-‐‑­]\n([^{WS}]+)", "$1$2")
    lines = whole.select(key, "side", F.posexplode(F.split(text, "\n", -1)).alias("line", "x"))
    bare = lambda t: F.coalesce(F.nullif(sub(sub(t, "[\\-\u2010\u2011\u00ad]"), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+\z"), F.lit("")), t)
    lines = lines.select(key, "side", "line", F.transform(F.filter(F.split(collapse(F.col("x")), " "), lambda t: t != ""), bare).alias("tokens")).where("size(tokens) > 0")
    until = F.sum(F.size("tokens")).over(Window.partitionBy(key, "side").orderBy("line"))
    return lines.withColumn("start", (until - F.size("tokens")).cast("int"))


def _line_blocks(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """(kind, first line of a, lines, first line of b, lines): = kept, < and > moved whole, ~ changed.

    A removed line that is also added somewhere is moved: the first one is laid on the first added one, and so on.
    """
    found = steps(a, b)
    targets: dict = {}
    for k, (op, _, j) in enumerate(found):
        if op == "+":
            targets.setdefault(b[j], deque()).append(k)
    whole: set = set()
    for k, (op, i, _) in enumerate(found):
        if op == "-" and targets.get(a[i]):
            whole |= {k, targets[a[i]].popleft()}
    out: list[list] = []
    for k, (op, i, j) in enumerate(found):
        kind = "=" if op == "=" else {"-": "<", "+": ">"}[op] if k in whole else "~"
        if not out or out[-1][0] != kind:
            out.append([kind, i, 0, j, 0])
        out[-1][2] += op != "+"
        out[-1][4] += op != "-"
    return [tuple(x) for x in out]


REGION = "seq int, kind string, a int, na int, b int, nb int, la int, nla int, lb int, nlb int"


def _regions(batches):
    """Rows (key, REGION) of pairs (key, x, y), whose lines (line, start, n, name) are sorted: words and lines of each stretch."""
    for batch in batches:
        out, of = [], []
        for pair, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
            at = lambda side, k: side[k]["start"] if k < len(side) else side[-1]["start"] + side[-1]["n"] if side else 0
            for seq, (kind, i, n, j, m) in enumerate(_line_blocks([r["name"] for r in x], [r["name"] for r in y])):
                out.append((seq, kind, at(x, i), at(x, i + n) - at(x, i), at(y, j), at(y, j + m) - at(y, j), i, n, j, m))
                of.append(pair)
        columns = list(zip(*out)) if out else [[]] * 10
        types = [pa.int32(), pa.string(), *[pa.int32()] * 8]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["key", *[f.split()[0] for f in REGION.split(", ")]])


def _aligned(batches):
    """Each stretch as blocks (kind, a, na, b, nb, whole); the words of a changed one are aligned."""
    block = pa.struct([("kind", pa.string()), *[(c, pa.int32()) for c in ("a", "na", "b", "nb")], ("whole", pa.bool_())])

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["kind"] == "~":
                found = blocks_of(steps(r["x"] or [], r["y"] or [], trim=False), r["a"], r["b"])
            else:
                found = [Block(r["kind"], r["a"], r["na"], r["b"], r["nb"], r["kind"] == "=")]
            out.append([{"kind": f.kind, "a": f.a, "na": f.na, "b": f.b, "nb": f.nb, "whole": f.whole} for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), pa.array(out, pa.list_(block)), *[batch.column(c) for c in ("a", "x", "b", "y")]], names=["key", "seq", "blocks", "a", "x", "b", "y"])


def _revised(batches):
    """The runs of each pair from its stretches in order."""
    run_type = pa.struct([("op", pa.string()), *[(c, pa.int32()) for c in "abn"]])

    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            blocks = joined([Block(**f) for p in parts for f in p["blocks"]])
            words = [{p[s] + k: w for p in parts for k, w in enumerate(p[t] or ())} for s, t in (("a", "x"), ("b", "y"))]
            of = [lambda first, n, own=own: [own[k] for k in range(first, first + n)] for own in words]
            out.append([dict(zip(("op", "a", "b", "n"), r)) for r in finished(without_coincidences(blocks), *of)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(run_type))], names=["key", "runs"])


def revisions(pairs: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Adds runs, array of (op, a, b, n) over the words of `content_lines`, to each pair of texts; see the module's text.

    key: a column that tells the pairs apart; rows of a null key get null runs. Null texts are empty. Lines of a pair are
    told apart by two 64-bit hashes.
    """
    keyed = pairs.select(F.col(key).alias("key"), F.col(a).alias("x"), F.col(b).alias("y")).where("key is not null")
    lines = written(content_lines(keyed.select("key", F.posexplode(F.array("x", "y")).alias("side", "text")), "key"), "lines")
    line = F.array_join("tokens", " ")
    name = F.concat_ws(":", F.xxhash64(line), F.xxhash64(line, F.lit(1)))
    row = F.struct("line", "start", F.size("tokens").alias("n"), name.alias("name"))
    per_side = [F.array_sort(F.collect_list(F.when(F.col("side") == k, row))).alias(c) for k, c in enumerate("xy")]
    sql = keyed.schema["key"].dataType.simpleString()
    listed = lines.groupBy("key").agg(*per_side)
    regions = written(listed.mapInArrow(_regions, f"key {sql}, {REGION}"), "regions")
    # Lines of a side are numbered by their place among those with words.
    numbered = lines.withColumn("k", F.row_number().over(Window.partitionBy("key", "side").orderBy("line")) - 1).select("key", "side", "k", "tokens")
    of = lambda side, first, n: F.transform(F.when(F.col(n) > 0, F.sequence(F.col(first), F.col(first) + F.col(n) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.lit(side).alias("side"), k.alias("k")))
    wanted = regions.where("kind = '~'").select("key", "seq", F.explode(F.concat(of(0, "la", "nla"), of(1, "lb", "nlb"))).alias("l")).select("key", "seq", "l.side", "l.k")
    words = [F.flatten(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("k", "tokens"))))["tokens"]).alias(c) for side, c in enumerate("xy")]
    changed = wanted.join(numbered, ["key", "side", "k"]).groupBy("key", "seq").agg(*words)
    whole = regions.select("key", "seq", "kind", "a", "na", "b", "nb").join(changed, ["key", "seq"], "left")
    block = "array<struct<kind: string, a: int, na: int, b: int, nb: int, whole: boolean>>"
    parts = whole.mapInArrow(_aligned, f"key {sql}, seq int, blocks {block}, a int, x array<string>, b int, y array<string>")
    parts = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "blocks", "a", "x", "b", "y"))).alias("parts"))
    found = parts.mapInArrow(_revised, f"key {sql}, runs array<struct<{RUN}>>")
    out = pairs.join(found.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn("runs", F.when(F.col(key).isNotNull(), F.coalesce("runs", F.array().cast(f"array<struct<{RUN}>>"))))


def totals(diffed: DataFrame) -> DataFrame:
    """Adds removed, added, moved and same item counts."""
    count = lambda ops: F.aggregate(F.filter("runs", lambda r: r["op"].isin(*ops)), F.lit(0), lambda t, r: t + r["n"])
    return diffed.withColumns({"removed": count("-"), "added": count("+"), "moved": count(">"), "same": count("=")})
