"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id, so files, stripes and row groups hold disjoint id ranges: their statistics and
Bloom filters prune what a lookup reads, and any stripe can be read by a task of its own.

A text is cut where the tokenizer parts it anyway: where a space or line feed follows another character, and before
punctuation after an ASCII letter or digit. Pieces are found, named by a 64-bit hash and replaced by their ids in whole
arrays; only pieces that a worker has not met go through the tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import Steps, bounded_batches, new_path, partitions, slices, span_hashes, table, text_buffer

END = 2
VOCABULARY = "byte_bpe_50k.json"

#: Known pieces kept by a worker, some 40 bytes each; beyond it they are forgotten and encoded anew.
KEPT = 600_000
#: Bytes of text whose pieces are looked up at once, and bytes of text for each file.
BLOCK, FILE = 1 << 20, 128 << 20

ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}

_bytes = np.arange(256)
_SPACE = np.isin(_bytes, [10, 32])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in _bytes])
#: Not the apostrophe, which contractions begin with, nor the bar, which stands within names of special tokens.
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in "'|" for b in _bytes])
#: White space but for space and line feed: beside it the cuts could change the ids, so such a text is encoded whole.
_CONTROL = np.isin(_bytes, [9, 11, 12, 13, 28, 29, 30, 31])
_LEADS = np.isin(_bytes, [0xC2, 0xE1, 0xE2, 0xE3])
_WIDE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def _other_space(data: np.ndarray) -> np.ndarray:
    """Places of white space other than space and line feed."""
    found = [np.flatnonzero(_CONTROL[data])]
    lead = np.flatnonzero(_LEADS[data])
    for c in _WIDE:
        at = lead[lead + len(c) <= len(data)]
        for k, b in enumerate(c):
            at = at[data[at + k] == b]
        found.append(at)
    return np.concatenate(found)


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte of the rows, which stand one after another."""
    space = _SPACE[data]
    out = space.copy()
    out[1:] &= ~space[:-1]
    out[1:] |= _PUNCTUATION[data[1:]] & _ALNUM[data[:-1]]
    out[offsets[:-1][np.diff(offsets) > 0]] = True
    return out


class Encoder:
    """A tokenizer with the ids of the pieces met so far. Pieces are found by a 64-bit hash of their bytes and confirmed by
    another one; a row with a piece that is not the one known by its first hash is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)  # in byte-level vocabularies a character stands for a byte
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        by = told.get("pre_tokenizer") or {}
        special = [np.frombuffer(t["content"].encode(), np.uint8) for t in told.get("added_tokens") or ()]
        #: Whether the cuts are the tokenizer's own; texts are encoded whole if not.
        self.cuts = by.get("type") == "ByteLevel" and by.get("use_regex", True) and not by.get("add_prefix_space") and not told.get("normalizer") and all(_starts(t, np.array([0, len(t)])).sum() == 1 for t in special)
        self.forget()

    def forget(self) -> None:
        self.names, self.second, self.first, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, names: np.ndarray, second: np.ndarray, pieces: list[bytes], in_row: np.ndarray) -> None:
        """Ids of new pieces; those in_row begin with white space and end without, so a row of them parts where they do."""
        first, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        parts, size = [self.pool], len(self.pool)
        alone, rows = np.flatnonzero(~in_row).tolist(), np.flatnonzero(in_row).tolist()
        own = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in alone], add_special_tokens=False)]
        count[alone] = [len(x) for x in own]
        first[alone] = size + np.cumsum(count[alone]) - count[alone]
        parts += own
        size += int(count.sum())
        chunks = [rows[k : k + 1000] for k in range(0, len(rows), 1000)]
        for some, e in zip(chunks, self.tokenizer.encode_batch_fast([b"".join([pieces[k] for k in c]).decode() for c in chunks], add_special_tokens=False)):
            found = np.array(e.ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.sizes[found]), np.cumsum([len(pieces[k]) for k in some])) + 1
            count[some] = np.diff(ends, prepend=0)
            first[some] = size + ends - count[some]
            parts.append(found)
            size += len(found)
        self.pool = np.concatenate(parts)
        at = np.searchsorted(self.names, names)
        self.names, self.second, self.first, self.count = (np.insert(old, at, new) for old, new in ((self.names, names), (self.second, second), (self.first, first), (self.count, count)))

    def _known(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the known pieces, and whether each is known (its place is 0 if not)."""
        place = np.searchsorted(self.names, names)
        place[place == len(self.names)] = 0
        return place, (self.names[place] == names if len(self.names) else np.zeros(len(names), bool))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in data, each row's followed by `end`, and the offsets of each row's ids."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        rows, last = len(offsets) - 1, np.array([] if end is None else [end], np.int32)
        aside = np.searchsorted(offsets, _other_space(data), side="right") - 1 if self.cuts else np.flatnonzero(np.diff(offsets))
        aside = np.unique(aside)
        at = np.flatnonzero(_starts(data, offsets)) if len(data) else np.zeros(0, np.int64)
        if len(aside):
            out = np.zeros(rows, bool)
            out[aside] = True
            at = at[~out[np.searchsorted(offsets, at, side="right") - 1]]
        of = np.searchsorted(offsets, at, side="right") - 1
        until = np.minimum(np.append(at[1:], len(data)), offsets[of + 1]) if len(at) else at
        if len(self.names) > KEPT:
            self.forget()
        hashes, seconds = span_hashes(data, at, until, 1), span_hashes(data, at, until, 2)
        names, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._known(names)
        other = seconds != np.where(known, self.second[place] if len(self.second) else 0, seconds[one])[which]
        if other.any():
            aside = np.union1d(aside, of[other])
            keep = ~np.isin(of, aside)
            at, until, of, hashes, seconds = at[keep], until[keep], of[keep], hashes[keep], seconds[keep]
            names, one, which = np.unique(hashes, return_index=True, return_inverse=True)
            place, known = self._known(names)
        if not known.all():
            new = one[~known]
            begin, stop = at[new], until[new]
            self._learn(names[~known], seconds[new], [data[i:j].tobytes() for i, j in zip(begin.tolist(), stop.tolist())], _SPACE[data[begin]] & ~_SPACE[data[stop - 1]])
            place, _ = self._known(names)
        more = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in aside], add_special_tokens=False)]
        # Runs in the pool, row by row: the pieces, or all of a row that was encoded whole, and an end after each row.
        pool = np.concatenate([self.pool, *more, last])
        sizes = np.array([len(x) for x in more], np.int64)
        row = np.concatenate([aside, np.arange(rows)])
        order = np.argsort(row, kind="stable")
        after = np.searchsorted(of, row[order], side="right")
        first = np.insert(self.first[place][which], after, np.concatenate([len(self.pool) + np.cumsum(sizes) - sizes, np.full(rows, len(pool) - len(last))])[order])
        count = np.insert(self.count[place][which], after, np.concatenate([sizes, np.full(rows, len(last))])[order])
        until = np.cumsum(count)
        ids = pool[np.arange(until[-1] if len(until) else 0) + np.repeat(first - until + count, count)]
        # A row's end is the last of its runs.
        ends = (after + np.arange(len(row)))[np.append(row[order][1:] != row[order][:-1], True)] if rows else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], until[ends]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, without the end id; null is empty."""
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    ids, at = encoder(path).encode(data, offsets, None)
    return [ids[i:j].astype("<i4").tobytes() for i, j in zip(at[:-1], at[1:])]


def encode_rows(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text); ids end with the end id."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK):
                ids, at = encoder(tokenizer).encode(data, offsets[i : j + 1], end)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Writes ids in ascending doc_id order (nulls first); files are numbered in that order, and ordered within. There
    are as many as shuffle partitions, more where one would hold over FILE bytes of text.

    Rows are dealt by range of doc_id, so a long run of one doc_id is the one thing that stays together.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.select("doc_id", "text").repartitionByRange(max(partitions(spark), -(-size // FILE)), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = encode_rows(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")), tokenizer, end)
    rows.write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all documents before.

    Prefix sums go by file: only one number per file meets in one place. Within a file rows stand in order.
    """

    def sums(batches):
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("pos"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "pos", "doc_id", "n_tokens", "ids_crc32"])

    rows = read(spark, path).select(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("file"), F.monotonically_increasing_id().alias("pos"), "doc_id", "ids")
    rows = Steps(spark).write(rows.mapInArrow(sums, "file long, pos long, doc_id long, n_tokens long, ids_crc32 long"), "digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n")).select("file", "before")
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "pos")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(files, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text, any further columns are left out) and returns the digests read back from the files.

    Null texts are empty and get the end id alone. Null doc_ids come first. Rows of one doc_id are written one after the
    other, by hash of their text. An empty table gives files without rows.
    """
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer or vocabulary())
    return digests(docs.sparkSession, path)


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))
