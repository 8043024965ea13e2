"""Language identification by prediction by partial matching over bytes.

For each language the learning texts give a tree of byte contexts up to ORDER bytes long. A byte is coded in the longest
known context; a context that has not seen it codes an escape (method C) and the next shorter one codes it without the
bytes already excluded, down to a uniform code over the bytes never seen. Counts are frozen after learning, so the code
length of a byte depends on its ORDER + 1 last bytes alone; it is computed once for each such string and is exact: over
all 256 bytes the probabilities of a context sum to 1. A text goes to the language with the shortest code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, slices, table, text_buffer

ORDER = 4
#: At most so many texts of each language are learnt from: those with the smallest hash of their text.
LEARNT = 600
BLOCK = 1 << 18


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as one integer, and the offsets of the rows in it. Texts begin after zeros."""
    n, rows = int(offsets[-1] - offsets[0]), len(offsets) - 1
    shift = np.arange(1, rows + 1, dtype=np.int64) * ORDER
    padded = np.zeros(n + rows * ORDER, np.uint64)
    own = np.ones(len(padded), bool)
    first = offsets[:-1] - offsets[0] + shift
    for k in range(1, ORDER + 1):
        own[first - k] = False
    padded[own] = data[offsets[0] : offsets[-1]]
    keys = padded.copy()
    for k in range(1, ORDER + 1):
        keys[k:] |= padded[:-k] << np.uint64(8 * k)
    return keys[own], offsets - offsets[0]


def _count(batches):
    for batch in batches:
        texts = batch.column("text")
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, offsets = text_buffer(texts)
        for i, j in slices(offsets, BLOCK):
            keys, own = _grams(data, offsets[i : j + 1])
            of = np.repeat(np.arange(j - i), np.diff(own))
            for lang in sorted(set(langs[i:j])):
                found, counts = np.unique(keys[langs[i:j][of] == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


class Tree:
    """Frozen statistics of one language: sorted strings and contexts of each order with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        self.grams, self.contexts = [], []
        for k in range(ORDER + 1):
            cut = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            found, at = np.unique(cut, return_inverse=True)
            n = np.bincount(at, counts, len(found))
            nodes, of = np.unique(found >> np.uint64(8), return_inverse=True)
            self.grams.append((found, n))
            self.contexts.append([nodes, np.bincount(of, n, len(nodes)), np.bincount(of, minlength=len(nodes)).astype(np.float64), None])
        for k in range(ORDER):  # what a context of order k + 1 excludes in its parent
            longer, nodes = self.grams[k + 1][0], self.contexts[k + 1][0]
            seen = self.grams[k][1][np.searchsorted(self.grams[k][0], longer & np.uint64((1 << 8 * (k + 1)) - 1))]
            self.contexts[k + 1][3] = np.bincount(np.searchsorted(nodes, longer >> np.uint64(8)), seen, len(nodes))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length in bits of the last byte of each string after the others."""
        cost, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        out_n, out_t = np.zeros(len(keys)), np.zeros(len(keys))  # excluded here: occurrences, bytes
        for k in range(ORDER, -1, -1):
            (grams, n), (nodes, total, kinds, parent) = self.grams[k], self.contexts[k]
            cut = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(nodes, cut >> np.uint64(8)), len(nodes) - 1)
            known = open_ & (nodes[at] == cut >> np.uint64(8))
            g = np.minimum(np.searchsorted(grams, cut), len(grams) - 1)
            left, new = np.where(known, total[at] - out_n, 0), np.where(known, kinds[at] - out_t, 0)
            hit = known & (grams[g] == cut)
            cost[hit] += np.log2((left[hit] + new[hit]) / n[g[hit]])
            open_ &= ~hit
            escape = known & open_ & (new > 0)
            cost[escape] += np.log2((left[escape] + new[escape]) / new[escape])
            out_n, out_t = (np.where(known, parent[at], 0), np.where(known, kinds[at], 0)) if k else (out_n, out_t)
        cost[open_] += np.log2(256 - self.contexts[0][2][0])
        return cost


class Model:
    """Code lengths of every learnt string in every language, in a hash table; any other string is worked out when met."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs, self.trees = sorted(trees), trees
        keys = np.unique(np.concatenate([t.grams[ORDER][0] for t in trees.values()]))
        self.shift = np.uint64(64 - max(10, int(2 * len(keys)).bit_length()))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, slot = keys[order], slot[order]
        self.starts = np.searchsorted(slot, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.probes = int(np.diff(self.starts).max())
        self.table = np.stack([trees[x].bits(self.keys) for x in self.langs], axis=1).astype(np.float32)
        self.keys = np.append(self.keys, np.full(self.probes, (1 << 64) - 1, np.uint64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts[self._slot(keys)]
        left = np.flatnonzero(self.keys[at] != keys)
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        at[left] = 0
        out = self.table[at]
        if len(left):
            new, of = np.unique(keys[left], return_inverse=True)
            out[left] = np.stack([self.trees[x].bits(new) for x in self.langs], axis=1)[of]
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row in each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in slices(offsets, BLOCK):
            for lo in range(int(offsets[i]), int(offsets[j]) + 1, 4 * BLOCK) if j - i == 1 else [int(offsets[i])]:
                hi = min(lo + 4 * BLOCK, int(offsets[j])) if j - i == 1 else int(offsets[j])
                back = min(ORDER, lo - int(offsets[i])) if j - i == 1 else 0
                own = np.array([lo - back, hi]) if j - i == 1 else offsets[i : j + 1]
                keys, at = _grams(data, own)
                if not len(keys):
                    continue
                costs = self.bits(keys)[back:] if back else self.bits(keys)
                full = np.flatnonzero(np.diff(at) > 0)
                out[i + full] += np.add.reduceat(costs, np.maximum(at[full] - back, 0), axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, learnt: int = LEARNT) -> Model | None:
    """A model from docs (text, lang); None if no row has both. At most `learnt` different texts of each language are read,
    whole; repeats of a text count once."""
    known = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    # Hashes of different texts are even, so twice the share needed leaves enough of them, and few are ranked.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * learnt / max(n, 1)))])
    some = known.where((F.col("h").cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")])).groupBy("lang", "h").agg(F.first("text").alias("text"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= learnt).select("text", "lang")
    grams = some.repartition(8).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(grams.column("lang").to_pylist(), dtype=object)
    keys, counts = grams.column("gram").to_numpy(), grams.column("n").to_numpy()
    return Model({x: Tree(keys[langs == x], counts[langs == x]) for x in sorted(set(langs))}) if len(langs) else None


def _judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, language): each whole row, whatever its columns are called, and the verdict on its text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = docs.select(row, F.col("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def score(batches):
        m = shared.value if shared else None
        for batch in batches:
            letter = np.asarray(batch.column("letter").to_pylist(), bool)
            data, offsets = text_buffer(batch.column("text"))
            if m is None or not len(letter):
                best, sure, bits = np.full(len(letter), "und", object), np.zeros(len(letter)), np.full(len(letter), np.nan)
            else:
                lengths = m.lengths(data, offsets)
                k = lengths.argmin(axis=1)
                least = lengths[np.arange(len(k)), k]
                sure = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
                bits = least / np.maximum(np.diff(offsets), 1)
                best = np.where(letter, np.array(m.langs, object)[k], "und")
                sure[~letter] = 0
            found = pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(sure), pa.array(bits, mask=~letter | np.isnan(bits))], names=["lang", "score", "bits"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "language"])

    schema = scored.select("row", F.lit(None).cast("struct<lang:string,score:double,bits:double>").alias("language")).schema
    return scored.mapInArrow(score, schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows with struct column `language`: lang, score, bits (a byte), from column text alone.

    score: the language's probability if all were as likely before. A null text, one without a letter, or any text
    without a model, gives `und`, score 0 and null bits. Equal code lengths go to the first language by code point.
    A column `language` of docs is replaced.
    """
    return _judged(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "language"], "language")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(docs.where("not held_out and doc_id is not null"))
    found = predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", F.col("language.bits").alias("bits_per_byte"))


def keep_known(docs: DataFrame, model: Model | None, most_bits: float | None = None) -> DataFrame:
    """The rows whose text is in one of the learnt languages, that is, not `und`. With most_bits, also those go that cost
    more bits a byte than that in their best language; it drops texts by a bound, so none is set unless asked for."""
    known = F.col("language.bits").isNotNull() if most_bits is None else F.col("language.bits") <= most_bits
    return _judged(docs, model).where(known).select("row.*")
