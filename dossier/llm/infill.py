"""Fill-in-middle transformation with rank and select on packed bitvectors.

The bytes at which code points start are a bitvector, packed 64 to a word, with the number of set bits before each block
of eight words in a directory. The rank at a row's end less that at its start is the row's number of code points; select
on the ranks of the two cuts gives the bytes at which to cut. No text is decoded or walked through code point by code
point, and rows of a batch share one bitvector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, slices, table, text_buffer

MARKERS = ("<P>", "<S>", "<M>")
#: Words of a block, and bytes of text that share a bitvector.
WORDS, BLOCK = 8, 1 << 20


class Starts:
    """The bytes of a buffer at which code points start."""

    def __init__(self, data: np.ndarray):
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        words = np.zeros((len(data) // (64 * WORDS) + 1) * WORDS, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words, self.size = words, len(data)
        self.counts = np.bitwise_count(words).astype(np.int64).reshape(-1, WORDS)
        self.directory = np.concatenate([[0], np.cumsum(self.counts.sum(axis=1))])
        self.within = np.cumsum(self.counts, axis=1) - self.counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before each byte; `at` may be the buffer's size."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.directory[word // WORDS] + self.within[word // WORDS, word % WORDS] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte at which code point number k (from 0) starts; the buffer's size if there are only k."""
        k = np.asarray(k, np.int64)
        over = k >= self.directory[-1]
        k = np.where(over, 0, k)
        block = np.searchsorted(self.directory, k, side="right") - 1
        block = np.minimum(block, len(self.within) - 1)
        left = k - self.directory[block]
        inner = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, inner]
        word, at = self.words[block * WORDS + inner], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left >= low
            left, at = left - np.where(go, low, 0), at + np.where(go, width, 0)
            word = np.where(go, word >> np.uint64(width), word)
        return np.where(over, self.size, (block * WORDS + inner) * 64 + at)


def _holding(data: np.ndarray, offsets: np.ndarray, marker: bytes) -> np.ndarray:
    """Rows whose bytes hold the marker."""
    at = np.flatnonzero(data[: max(0, len(data) - len(marker) + 1)] == marker[0])
    for k, b in enumerate(marker[1:], 1):
        at = at[data[at + k] == b]
    row = np.searchsorted(offsets, at, side="right") - 1
    return row[at + len(marker) <= offsets[row + 1]]


def _numbers(ids: list, seed: int) -> np.ndarray:
    """Four unsigned integers of each row: the first 16 bytes of the SHA-256 of `seed:doc_id`; a null id counts as empty."""
    found = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(found, ">u4").reshape(-1, 4).astype(np.int64)


def _check(markers: tuple[str, ...]) -> list[bytes]:
    """The output can be parted only at its markers if none of them holds, or begins with the end of, another one or itself."""
    found = [m.encode() for m in markers]
    if len(set(found)) != 3 or not all(found):
        raise ValueError("three different markers are needed")
    for a in found:
        for b in found:
            if (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b)) if not (a == b and k == len(b))):
                raise ValueError(f"the markers {a.decode()} and {b.decode()} overlap")
    return found


def infill(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs (doc_id, text; other columns are left out).

    n code points are cut at two places drawn from the SHA-256 of `seed:doc_id` alone, so reruns and lost executors
    change nothing, and rows of one doc_id are cut by the same draws. Prefix or middle or suffix may be empty. `percent`
    of documents are transformed, `spm_percent` of these with the suffix first. A text stays plain (counts null) if it
    is null or empty, which gives an empty output, or holds a marker. A null doc_id counts as the empty string. An empty
    table gives an empty one.
    """
    p, s, m = _check(markers)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h = _numbers(batch.column("doc_id").slice(i, j - i).to_pylist(), seed)
                starts = Starts(own)
                ranks = starts.rank(at)
                n = np.diff(ranks)
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                lo, hi = (np.where(cuts[:, k] == n, at[1:], starts.select(ranks[:-1] + cuts[:, k])) for k in (0, 1))
                plain = (n == 0) | (h[:, 2] % 100 >= percent)
                for marker in (p, s, m):
                    plain[_holding(own, at, marker)] = True
                spm = ~plain & (h[:, 3] % 100 < spm_percent)
                raw, out = own.tobytes(), []
                for r, (a, b, c, d) in enumerate(zip(at[:-1].tolist(), lo.tolist(), hi.tolist(), at[1:].tolist())):
                    if plain[r]:
                        out.append(raw[a:d])
                    elif spm[r]:
                        out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                    else:
                        out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string())]
                columns += [pa.array(x, pa.int64(), mask=plain) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that `infill` gave this output and form: the parts between the first markers, in their first order."""
    p, s, m = markers

    def parted(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(third) + 1)

    prefix, suffix, middle = parted(p, s, m)
    suffix_, prefix_, middle_ = parted(s, p, m)
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(F.concat(prefix, middle, suffix))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
o AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""
