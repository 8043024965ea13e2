"""Exact duplicates, spelling variants and fill-in-middle: SQL, brute force, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import exact, infill, spelling
from dossier.llm.common import text_buffer
from tests.helpers import same_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, output string, n string, row string, name string"
LONG = " ".join(f"wörd{i % 977} and{i % 13}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, None),
    (2, "", "x", "a", None, "q"),
    (3, " \n\t ", None, "a", None, None),
    (4, " ", None, "a", None, None),
    (5, "one  two\tthree", "x", "a", None, None),
    (5, "one two three", "y", None, None, None),
    (5, "one two three", "y", None, None, None),
    (None, "one two\n\nthree", None, "b", None, None),
    (None, "only a null id", None, "b", None, None),
    (6, LONG, None, "b", None, None),
    (7, LONG.replace(" ", "\n"), None, "b", None, None),
    (8, "\0\0 éü ñ 日本 😀 </s> <P> kept plain", None, "c", None, None),
    (-9, "日本語のテキスト 😀😀 é", None, "c", None, None),
    (-10, "one two three", None, "c", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_against_sql(spark, duck):
    same_rows(exact.op11_exact_dedup(spark, SF), duck(SF, exact.ORACLE_SQL))


def brute_groups(rows):
    name = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by: dict = {}
    for i, t in rows:
        by.setdefault(name(t), []).append(i)
    first = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in by.items()}
    out, stays = [], set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = name(t)
        kept = t not in stays
        stays.add(t)
        out.append((i, first[t], len(by[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [exact.MOST_BITS, 1])
def test_exact_odd_rows(odd, none, bits):
    """Also with a filter of one block."""
    got = exact.groups(odd, bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups([r[:2] for r in ODD])
    assert exact.groups(none).count() == 0 and exact.distinct(none).columns == none.columns
    kept = exact.distinct(odd, bits)
    want = {(r[0], r[4]) for r in brute_groups([r[:2] for r in ODD]) if r[3]}
    assert kept.columns == odd.columns and {(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()} == want
    assert kept.count() == len(want)


def test_exact_large_groups(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).when(F.col("id") % 3 == 1, F.concat(F.lit("pair "), (F.col("id") / 6).cast("long"))).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    for bits in (exact.MOST_BITS, 1 << 15):  # the second is far too full, and says yes to nearly all
        sizes = {r.group_size: r["count"] for r in exact.groups(df, bits).groupBy("group_size").count().collect()}
        assert sizes == {10_000: 10_000, 2: 10_000, 1: 10_000}
    assert exact.distinct(df).count() == 1 + 5_000 + 10_000


def test_filter_never_misses_a_repeat_and_spares_most_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(F.col("id"))).alias("hash"), (F.col("id") < 2000).alias("again"))
    blocks = exact.blocks_for(20_000)
    found = exact.flagged(rows, "hash", exact.repeated_places(rows, "hash", blocks), blocks)
    counts = {(r.again, r.maybe): r["count"] for r in found.groupBy("again", "maybe").count().collect()}
    assert counts[(True, True)] == 2000 and (True, False) not in counts and counts.get((False, True), 0) < 0.02 * 18_000


def test_exact_runs_no_python(spark, docs_plan=("Python", "Arrow", "Pandas")):
    plan = exact.op11_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in docs_plan)


def test_infill_against_sql(spark, duck):
    same_rows(infill.op13_fill_in_middle(spark, SF), duck(SF, infill.ORACLE_SQL))


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        text = "".join(rng.choice(list("ab é日😀\0"), size)).encode()
        data = np.frombuffer(text, np.uint8)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        starts = infill.Starts(data)
        at = np.arange(len(data) + 1)
        assert (starts.rank(at) == np.searchsorted(begins, at)).all()
        assert (starts.select(np.arange(len(begins) + 1)) == np.append(begins, len(data))).all()


def plain_infill(i, text, percent=90):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(x in text for x in infill.MARKERS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infill_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    more = [(100 + k, "<" * (k % 5) + "é<P" + "😀>S>"[k % 3 :] + "x" * k, None, None, None, None) for k in range(60)] + [(200 + k, t, None, None, None, None) for k, t in enumerate(("<P>", "a<S>", "<M", "M>", "<", "é"))]
    df = odd.union(spark.createDataFrame(more, DOCS))
    out = infill.infill(df)
    got = out.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted([(r[0], *plain_infill(*r[:2])) for r in [*ODD, *more]], key=key)
    assert sorted([(r.doc_id, r.again) for r in got], key=key) == sorted([(r[0], r[1] or "") for r in [*ODD, *more]], key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infill(none).count() == 0


def test_infill_options(spark):
    df = spark.createDataFrame([(k, f"text number {k} ü") for k in range(300)], "doc_id long, text string")
    forms = {r.form: r["count"] for r in infill.infill(df, percent=100, spm_percent=50).groupBy("form").count().collect()}
    assert "plain" not in forms and 100 < forms["psm"] < 200
    assert {r.form for r in infill.infill(df, percent=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "x<P>", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            infill.infill(df, markers=bad)


def plain_words(rows, every=97, least=5, often=3):
    n: dict = {}
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= often}


def one_apart(a, b):
    """Whether the words differ by exactly one edit: what is left once common ends are cut off."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(n):
    by: dict = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by.get(len(w) + d, ()) if one_apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_spelling_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in spelling.op12_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = plain_variants(plain_words(rows))
    assert got == want and sum(r[4] for r in want) > 0


def test_spelling_against_sql(spark, duck):
    same_rows(spelling.op12_spelling_variants(spark, SF), duck(SF, spelling.ORACLE_SQL))


def test_variants_of_dense_words(spark):
    """All words of few letters, where nearly each is near to many; runs of one letter; two-byte letters; long chains."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(4, 8))): int(rng.integers(1, 40)) for _ in range(700)}
    words |= {"a" * k: 2**k for k in range(5, 30)} | {"aaaaz": 3, "x" * 3000: 4, "x" * 1500 + "y" + "x" * 1499: 9, "x" * 2999: 4, "ÿ\u00d7÷é": 4}
    df = spark.createDataFrame([*words.items(), (None, 5), ("lost", None)], "word string, n long")
    got = spelling.variants(df.withColumn("id", df.n).withColumn("form", df.word))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_variants(words)
    with pytest.raises(ValueError):
        spelling.variants(df, times=1)


def test_variants_are_decided_by_strings(spark, monkeypatch):
    """With keys of two bits nearly all words share one; the result is the same."""
    words = {f"{a}{b}{c}word": ord(a) * 7 % 31 for a in "abcd" for b in "abcd" for c in "ab"}
    real = spelling.deletion_keys
    df = spark.createDataFrame([*words.items()], "word string, n long")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("word"))
            keys, rows, place, first = real(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(62)).view(np.int64)), pa.array(batch.column("id").to_numpy()[rows]), pa.array(place.astype(np.int32)), pa.array(first)], names=["key", "id", "place", "first"])

    monkeypatch.setattr(spelling, "keyed", lambda words: words.select("id", "word").mapInArrow(run, "key long, id long, place int, first boolean"))
    assert sorted((tuple(r) for r in spelling.variants(df).collect()), key=str) == plain_variants(words)


def test_spelling_odd_rows(spark, odd, none):
    got = spelling.counted_words(odd)
    assert {r.word: r.n for r in got.collect()} == plain_words([r[:2] for r in ODD])
    rows = sorted((tuple(r) for r in spelling.variants(got).collect()), key=str)
    assert rows == plain_variants(plain_words([r[:2] for r in ODD]))
    assert spelling.variants(spelling.counted_words(none)).count() == 0
