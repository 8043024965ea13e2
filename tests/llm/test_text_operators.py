"""Training-data operators over texts: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import decontaminate, langid, lines, minhash, mixing, repeats, tokens
from dossier.llm.common import PUNCTUATION, Steps, span_hashes, text_buffer, word_hashes
from tests.helpers import same_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one two three four five six seven", "en", "a", 3),
    (5, "one two three four five six seven", "en", None, 3),
    (5, "one two three four five six seven", "en", None, 3),
    (None, "one two three four five six seven", "en", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + " tail", "fr", "b", len(LONG) + 5),
    (8, "\0\0 éü ñ 日本 😀 </s>", "de", "c", 9),
    (9, "12345 !!", "de", "c", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_code_lengths_are_exact():
    rng = np.random.default_rng(3)
    text = np.frombuffer(b"the theory of the thing then there " * 40, np.uint8)
    keys, _ = langid._grams(text, np.array([0, len(text)]))
    tree = langid.Tree(*np.unique(keys, return_counts=True))
    for context in [*rng.choice(keys >> np.uint64(8), 20), np.uint64(0), np.uint64(0xFFFF)]:
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs(np.exp2(-tree.bits(every)).sum() - 1) < 1e-9


def test_model_table_agrees_with_trees():
    a, b = (np.frombuffer(t * 30, np.uint8) for t in (b"der die das und ", b"le la les et "))
    trees = {}
    for name, t in (("de", a), ("fr", b)):
        trees[name] = langid.Tree(*np.unique(langid._grams(t, np.array([0, len(t)]))[0], return_counts=True))
    model = langid.Model(trees)
    text = np.frombuffer(b"die dose und la table xyz", np.uint8)
    keys, _ = langid._grams(text, np.array([0, len(text)]))
    want = np.stack([trees[x].bits(keys) for x in model.langs], 1)
    assert np.allclose(model.bits(keys), want, atol=1e-4)
    assert np.allclose(model.lengths(text, np.array([0, 10, 10, len(text)]))[1], 0)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    t = np.frombuffer(b"alpha beta gamma " * 500, np.uint8)
    keys, _ = langid._grams(t, np.array([0, len(t)]))
    model = langid.Model({"x": langid.Tree(*np.unique(keys, return_counts=True))})
    whole = model.lengths(t, np.array([0, len(t)]))
    monkeypatch.setattr(langid, "BLOCK", 256)
    assert np.allclose(model.lengths(t, np.array([0, len(t)])), whole, rtol=1e-6)


def test_language_held_out(spark):
    got = {r.doc_id: r for r in langid.op1_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [d for d in got if got[d].held_out]
    assert held and all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(odd, none, docs):
    model = langid.learn(docs)
    got = {(r.doc_id, r.text): r.language for r in langid.predict(odd, model).collect()}
    assert all(got[k].lang == "und" and got[k].score == 0 for k in got if not re.search(r"[^\W\d_]", k[1] or ""))
    assert got[(4, ODD[3][1])].lang in model.langs
    assert langid.learn(none) is None and langid.predict(none, model).count() == 0
    assert {r.language.lang for r in langid.predict(odd, None).collect()} == {"und"}
    clash = odd.withColumnRenamed("source", "score")
    assert langid.predict(clash, model).columns == [*clash.columns, "language"]


class PlainCoder:
    """Prediction by partial matching, method C with exclusion, from a dictionary of contexts: one byte after the other."""

    def __init__(self, texts, order=4):
        self.order, self.seen = order, {}
        for t in texts:
            padded = bytes(order) + t
            for k in range(order, len(padded)):
                for n in range(order + 1):
                    context = self.seen.setdefault(padded[k - n : k], {})
                    context[padded[k]] = context.get(padded[k], 0) + 1

    def bits(self, text):
        padded, total = bytes(self.order) + text, 0.0
        for k in range(self.order, len(padded)):
            excluded = set()
            for n in range(self.order, -1, -1):
                counts = {b: c for b, c in self.seen.get(padded[k - n : k], {}).items() if b not in excluded}
                whole = sum(counts.values()) + len(counts)
                if padded[k] in counts:
                    total -= np.log2(counts[padded[k]] / whole)
                    break
                if counts:
                    total -= np.log2(len(counts) / whole)
                excluded |= set(counts)
            else:
                total += np.log2(256 - len(excluded))
        return total


def test_language_against_a_plain_coder(spark):
    learnt = {"de": ["der die das und nicht", "auch die Bahn ist da", "Öl und Übel"], "en": ["the and of that", "this is not that", "oil and the rest"], "fr": ["le la les et", "une île et la mer"]}
    texts = ["that is the thing", "die und der Rest", "la mer et le port", "Übel", "x", "zzz 12 qqq", "the", None, "12", "île"]
    rows = [(i, t, lang) for lang, own in learnt.items() for i, t in enumerate(own)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    coders = {lang: PlainCoder([t.encode() for t in own]) for lang, own in learnt.items()}
    got = {r.text: r.language for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for t in texts:
        if t is None or not re.search(r"[^\W\d_]", t):
            assert got[t].lang == "und"
            continue
        bits = {lang: c.bits(t.encode()) for lang, c in coders.items()}
        assert got[t].lang == min(bits, key=bits.get) and abs(got[t].bits * len(t.encode()) - min(bits.values())) < 1e-2
        assert abs(got[t].score - 1 / sum(2 ** (min(bits.values()) - b) for b in bits.values())) < 1e-2


def test_a_language_of_one_repeated_text_is_learnt(spark):
    rows = [("one sentence of english that comes again and again", "en")] * 5000 + [(f"ein deutscher Satz mit der Nummer {k}", "de") for k in range(50)]
    assert langid.learn(spark.createDataFrame(rows, "text string, lang string")).langs == ["de", "en"]


def test_language_columns_may_clash(spark, docs):
    model = langid.learn(docs)
    df = docs.selectExpr("doc_id", "text", "lang AS language", "source AS `__letter`", "n_chars AS row")
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "__letter", "row", "language"] and got.where("language.lang is null").count() == 0
    assert langid.keep_known(df, model).columns == df.columns
    noise = bytes(range(33, 127)).decode() * 3
    mixed = spark.createDataFrame([("the and of that",), (noise,), ("12",), (None,)], "text string")
    small = langid.learn(spark.createDataFrame([("the and of that", "en")], "text string, lang string"))
    assert {r.text for r in langid.keep_known(mixed, small).collect()} == {"the and of that", noise}
    assert {r.text for r in langid.keep_known(mixed, small, most_bits=5.0).collect()} == {"the and of that"}


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    want, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.op2_orc_tokens(spark, SF).collect()) == want


def test_tokens_odd_rows(spark, odd, none):
    got = tokens.tokenize(odd).collect()
    assert len(got) == len(ODD) and sum(r.n_tokens == 1 for r in got) == 2
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1])
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in ODD), key=lambda d: (d is not None, d or 0))
    assert tokens.tokenize(none).count() == 0


def test_token_pieces_match_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    texts = ["a\t  b", " \n\n x  y  z", "<|endoftext|> a", "  ", "\n", "a  \n\n b \n", "é  ü'll don't   ", "\x1c a  b", "x <|endoftext|>y", "", "   a b", LONG]
    assert [np.frombuffer(a, "<i4").tolist() for a in tokens.encode(texts, tokens.vocabulary())] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_orc_lookup_prunes(spark, docs):
    from dossier.llm.common import new_path

    path = new_path(spark, "orc-test")
    tokens.write(docs, path, tokens.vocabulary())
    plan = tokens.read(spark, path).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan


def test_orc_files_have_row_index_and_bloom_filter(spark, tmp_path):
    from pyarrow import orc

    path = f"{tmp_path}/orc"
    rows = spark.range(30_000).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text")
    tokens.write(rows, path, tokens.vocabulary())
    files = sorted(f for f in tmp_path.glob("orc/part-*"))
    found = [orc.ORCFile(f) for f in files]
    assert sum(f.nrows for f in found) == 30_000 and all(f.nstripes >= 1 and f.compression == "ZSTD" for f in found)
    # Spark's own ORC library reads what the footers and indexes hold.
    jvm = spark._jvm
    hits, bounds = 0, []
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        ids = reader.getStatistics()[1]
        bounds.append((ids.getMinimum(), ids.getMaximum()))
        hits += bounds[-1][0] <= 300 <= bounds[-1][1]
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            streams = {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
            assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= streams and stripe.getIndexLength() > 0
            assert [str(footer.getColumns(k).getKind()) for k in (1, 3)] == ["DIRECT_V2", "DIRECT_V2"]  # run-length encoding of integers
        assert reader.getRowIndexStride() == 10_000
    # Ranges of files are apart, so a look-up opens one file, and one of an id that is in no document finds nothing.
    assert hits == 1 and all(x[1] < y[0] for x, y in zip(sorted(bounds), sorted(bounds)[1:]))
    assert tokens.read(spark, path).where("doc_id = 300").count() == 1 and tokens.read(spark, path).where("doc_id = 301").count() == 0


def words_of(text, pattern=rb"[^\x20\x09-\x0d]+"):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(pattern, low)


def test_near_duplicates_against_sql(spark, duck):
    same_rows(minhash.op4_minmax_near_dedup(spark, SF), duck(SF, minhash.ORACLE_SQL))


def test_near_duplicates_in_one_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        t = list(base)
        for p in rng.choice(150, rng.integers(0, 9), replace=False):
            t[p] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(t))
    texts += [texts[0]] * 40
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.components(df, k=4).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_duplicates_odd_rows(odd, none):
    got = minhash.components(odd).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(ODD)
    assert [by[d].n_shingles for d in (1, 2, 3, 4)] == [0, 0, 0, 3] and by[5].component_id == 4 and not by[5].kept
    assert by[7].component_id == 6 and [r for r in got if r.doc_id is None][0].kept
    assert minhash.components(none).count() == 0


def test_rows_of_one_id_stand_in_one_component(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b), (11, None), (11, b), (12, "alone here")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 26): 3, (7, 26): 3, (9, 26): 3, (11, 0): 11, (11, 26): 3, (12, 1): 12}
    # Two texts that both stand first under one id: each keeps its own links.
    near = a + " tail"
    rows = [(5, a), (5, b), (8, near), (9, b + " tail")]
    assert {r.component_id for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {5}


def test_open_documents_meet_by_rare_shingles(spark, monkeypatch):
    """Every bucket holds all documents, so only the last step keeps unlike ones apart."""
    monkeypatch.setattr(minhash, "bands", lambda shingles, at, **_: np.ones((len(at) - 1, minhash.BANDS), np.uint64))
    rng = np.random.default_rng(12)
    texts = []
    for g in range(12):
        base = [f"g{g % 4}w{k}" for k in range(60)] + [f"own{g}w{k}" for k in range(40)]
        for _ in range(5):
            t = list(base)
            for p in rng.choice(100, rng.integers(0, 4), replace=False):
                t[p] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(t))
    sets_ = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for w in map(str.split, texts)]
    first = list(range(len(texts)))
    for _ in texts:
        first = [min(first[j] for j in range(len(texts)) if 100 * len(sets_[i] & sets_[j]) >= 80 * len(sets_[i] | sets_[j])) for i in range(len(texts))]
    got = {r.doc_id: r.component_id for r in minhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=4).collect()}
    assert [got[i] for i in range(len(texts))] == first


def test_spaced_seeds_find_every_two_substitutions():
    order = [f"t{i}" for i in range(13)]
    data = lambda ws: (np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))]))
    base = set(decontaminate.seeds(*word_hashes(*data(order), PUNCTUATION))[0].tolist())
    for i in range(13):
        for j in range(i):
            changed = [("z" if k in (i, j) else w) for k, w in enumerate(order)]
            assert base & set(decontaminate.seeds(*word_hashes(*data(changed), PUNCTUATION))[0].tolist())


def test_leaks_against_brute_force(spark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.op3_spaced_seed_leaks(spark, SF).collect()}
    low = lambda t: words_of(t, rb"[a-z0-9\x80-\xff]+")
    numbers: dict = {}
    code = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in low(t)], np.int64)
    windows = [(r.item_id, code(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bank = np.stack([w[k : k + 13] for _, w in windows for k in range(len(w) - 12)])
    owner = np.array([i for i, w in windows for k in range(len(w) - 12)])
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = code(r.text)
        for v in np.lib.stride_tricks.sliding_window_view(n, 13) if len(n) >= 13 else []:
            want |= {(r.doc_id, int(i)) for i in owner[(bank == v).sum(1) >= 11]}
    assert got == want and got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_leaks_against_sql(spark, duck, sf):
    """Items and documents with the words, the place and the length of each."""
    same_rows(decontaminate.op3_spaced_seed_leaks(spark, f"/root/testdata/{sf}"), duck(f"/root/testdata/{sf}", decontaminate.ORACLE_SQL))


def test_leaks_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two three four five six"), (None, ODD[3][1]), (4, "two three"), (4, LONG[:400])], "item_id long, text string")
    got = {(r.item_id, r.n_words) for r in decontaminate.contaminated(odd.select("text"), items).collect()}
    assert got == {(3, 5), (None, 7), (4, len(words_of(LONG[:400])))}
    kept = decontaminate.clean(odd.withColumnRenamed("source", "content"), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 8, 9] and "content" in kept.columns
    assert decontaminate.clean(none, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == len(ODD)


def test_short_items(spark):
    items = [(1, "what is the largest inland lake"), (2, "name the seven seas of old"), (3, "two words"), (4, "how many legs has a common garden spider got")]
    texts = ["So: what is the largest inland lake? X.", "what is the largest inland sea", "Two, words!", "with two words in it", "see: how many legs has a common house spider got?", "how many arms has a common house spider got", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.item_id, r.content, r.n_words) for r in found.collect()}
    md5 = lambda k: hashlib.md5(texts[k].encode()).hexdigest()
    assert got == {(1, md5(0), 6), (3, md5(2), 2), (4, md5(4), 9)}
    for width in range(7, 13):
        order = [f"t{k}" for k in range(width)]
        data = lambda ws: (np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))]))
        base = set(decontaminate.seeds(*word_hashes(*data(order), PUNCTUATION), (width,))[0].tolist())
        for i in range(width):
            assert base & set(decontaminate.seeds(*word_hashes(*data([("z" if k == i else w) for k, w in enumerate(order)]), PUNCTUATION), (width,))[0].tolist())


def test_patience_is_a_common_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 9, rng.integers(0, 25)).tolist() for _ in range(2))
        p = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in p)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert lines.patience(list("abcde"), list("xabyde")) == [(0, 1), (1, 2), (3, 4), (4, 5)]


def plain_patience(a, b):
    """Patience diff by its definition, in recursion: equal ends, then the longest ascending run of items unique in both, by a
    table over all pairs of anchors (of equal choices the one that stands first in b), then the gaps between anchors."""

    def walk(i0, i1, j0, j1):
        if i0 >= i1 or j0 >= j1:
            return []
        if a[i0] == b[j0]:
            return [(i0, j0), *walk(i0 + 1, i1, j0 + 1, j1)]
        if a[i1 - 1] == b[j1 - 1]:
            return [*walk(i0, i1 - 1, j0, j1 - 1), (i1 - 1, j1 - 1)]
        left, right = a[i0:i1], b[j0:j1]
        anchors = [(i0 + i, j0 + right.index(x)) for i, x in enumerate(left) if left.count(x) == 1 and right.count(x) == 1]
        if not anchors:
            return []
        size, back = [], []
        for k, (_, j) in enumerate(anchors):
            before = [e for e in range(k) if anchors[e][1] < j]
            longest = max((size[e] for e in before), default=0)
            size.append(longest + 1)
            back.append(min((e for e in before if size[e] == longest), key=lambda e: anchors[e][1], default=None))
        k, chain = min((e for e in range(len(anchors)) if size[e] == max(size)), key=lambda e: anchors[e][1]), []
        while k is not None:
            chain.insert(0, anchors[k])
            k = back[k]
        out, i, j = [], i0, j0
        for x, y in [*chain, (i1, j1)]:
            out += walk(i, x, j, y) + ([(x, y)] if x < i1 else [])
            i, j = x + 1, y + 1
        return out

    return walk(0, len(a), 0, len(b))


def all_pairs_lines(rows):
    """The whole definition without Spark or the operator's code: every document against every earlier one."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    edge = " \t\n\v\f\r"
    keys = [[x.strip(edge) or None for x in t.split("\n")] for _, t in docs]
    held = [set(k) - {None} for k in keys]
    gone = [set() for _ in docs]
    for b in range(len(docs)):
        words = [len(x.split()) if x else 0 for x in keys[b]]
        for a in range(b):
            if not held[a] & held[b]:
                continue
            la, lb = ([x if x is not None else (s, k) for k, x in enumerate(keys[d])] for s, d in (("a", a), ("b", b)))
            run = []
            for p in [*plain_patience(la, lb), None]:
                if run and (p is None or (p[0] - run[-1][0], p[1] - run[-1][1]) != (1, 1)):
                    gone[b] |= {j for _, j in run} if sum(words[j] for _, j in run) >= 5 else set()
                    run = []
                run += [p] if p else []
    return {docs[d][0]: sorted(g) for d, g in enumerate(gone)}


def test_lines_keep_the_other_text(spark, docs):
    for r in lines.dedup_lines(docs.select("doc_id", "text")).collect():
        assert r.lines.text == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in r.lines.removed)


def test_common_lines_meet_every_earlier_holder(spark):
    x, y = "the first line of five words", "another line of at least five"
    short = ["a b", "c", "d e", "f"]
    rows = [(k, "\n".join(v)) for k, v in enumerate([[x, y]] * 3 + [[y, x]] * 12)]  # other order than the first holder's
    rows += [(100 + k, f"head {k}\n{x}\nmiddle {k}\n{x}\ntail {k}") for k in range(12)]  # no anchor: it stands twice
    rows += [(200 + k, "\n".join([f"own {k}", *short[k % 2 :], f"end {k}"])) for k in range(30)]  # blocks of short lines
    rng = np.random.default_rng(8)
    bag = [x, y, *short, "", "g h i", "one two three four five six", "  c "]
    rows += [(300 + k, "\n".join(rng.choice(bag, rng.integers(1, 9)))) for k in range(150)]
    want = all_pairs_lines(rows)
    got = {r.doc_id: list(r.lines.removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and all(want[d] == [0, 1] for d in range(4, 15))


def test_holders_that_align_alike_meet_others_once(spark):
    """Documents that hold a line twice between lines of their own are one class; other orders and gaps are others."""
    rows = [(k, [1, 100 + k, 2, 200 + k, 300 + k, 2]) for k in range(50)] + [(60, [1, 2, 2]), (61, [2, 1, 999, 2]), (62, [1, None, 2, 998, 2]), (63, [997, 1, 996, 2, 995, 2])]
    lines_ = spark.createDataFrame([((i, 0), x) for i, x in rows], "doc struct<id:long,h:long>, lines array<long>")
    got = {r.doc.id: r.rep.id for r in lines._first_alike(Steps(spark), lines_, lines_.select("doc")).collect()}
    assert got == {k: 0 for k in range(50)} | {60: 60, 61: 61, 62: 0, 63: 63}


def test_holders_that_share_one_line_meet_once_for_each_order(spark, monkeypatch):
    """Documents of many orders that share only a line which each holds twice: one alignment each, not one with each order."""
    x, n = "a line that all of them have", 160
    rows = [(k, f"own {k}\n{x}\nmiddle {k}\npart {k // 2} of two documents only\nthen {k}\n{x}\nend {k}") for k in range(n)]
    rows += [(n + k, f"{x}\nown {k}\npart {k} of two documents only\n{x}") for k in range(0, 60, 3)]
    aligned, write = [], Steps.write

    def counted(self, df, name):
        out = write(self, df, name)
        aligned.append(out.count() if name.startswith("pairs-") else 0)
        return out

    monkeypatch.setattr(Steps, "write", counted)
    got = {r.doc_id: list(r.lines.removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs_lines(rows)
    assert sum(aligned) < 8 * len(rows)


def test_fewest_words_of_a_block(spark):
    rows = spark.createDataFrame([(1, "a b c\nown 1\nd e"), (2, "x\na b c\ny\nd e")], "doc_id long, text string")
    removed = lambda n: {r.doc_id: list(r.lines.removed) for r in lines.dedup_lines(rows, fewest=n).collect()}
    assert removed(5) == {1: [], 2: []} and removed(3) == {1: [], 2: [1]} and removed(1) == {1: [], 2: [1, 3]}


def test_lines_against_all_pairs(spark, docs):
    want = all_pairs_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: list(r.lines.removed) for r in lines.dedup_lines(docs).collect()} == want


def test_lines_odd_rows(odd, none):
    got = lines.dedup_lines(odd.withColumnRenamed("source", "gone")).collect()
    assert len(got) == len(ODD) and "gone" in got[0].asDict()
    by = {r.doc_id: r.lines for r in got}
    assert by[1].text == "" and by[1].n == 1 and by[3].text == " \n\t " and by[5].text == "" and by[None].text == ODD[3][1]
    assert lines.dedup_lines(none).count() == 0


def brute_repeats(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict = {}
    for _, b in texts:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark, docs):
    got = sorted((tuple(r) for r in repeats.op9_bwt_repeats(spark, SF).collect()), key=str)
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_against_sql(spark, duck):
    same_rows(repeats.op9_bwt_repeats(spark, SF), duck(SF, repeats.ORACLE_SQL))


def test_repeats_odd_rows(spark, none, monkeypatch):
    rng = np.random.default_rng(2)
    noise = "".join(map(chr, rng.integers(97, 123, 5000)))
    rows = [(1, "a" * 450), (2, "a" * 199), (3, None), (4, noise), (5, noise[100:700] + "b" + noise[900:1101]), (5, "\0" * 300), (None, "é" * 150), (6, noise[1:250]), (6, noise[1:250])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda out: sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=str)
    assert digest(repeats.remove(df)) == brute_repeats(rows)
    assert repeats.remove(none).count() == 0


def test_repeats_tell_null_ids_apart(spark):
    rng = np.random.default_rng(7)
    noise = ["".join(map(chr, rng.integers(97, 123, 400))) for _ in range(3)]
    rows = [(None, noise[0] + noise[1]), (-(1 << 63), noise[1] + noise[2]), (None, noise[2]), (-(1 << 63), noise[2]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove(df).collect()), key=str)
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_that_polynomials_confuse(spark, size):
    """The Thue-Morse word and its swap have one polynomial hash modulo 2^64 under every odd base; they are told apart."""
    from tokenizers import Tokenizer

    one = "".join("ab"[k.bit_count() % 2] for k in range(size))
    two = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    plain = Tokenizer.from_file(tokens.vocabulary())
    ids = [np.frombuffer(x, "<i4").tolist() for x in tokens.encode([one, two, f"{one} {two}"], tokens.vocabulary())]
    assert ids == [plain.encode(x, add_special_tokens=False).ids for x in (one, two, f"{one} {two}")]
    assert [(r.doc_id, r.component_id) for r in minhash.components(df, k=4).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]
    items = spark.createDataFrame([(7, two)], "item_id long, text string")
    assert [r.item_id for r in decontaminate.contaminated(df.where("doc_id = 1"), items).collect()] == []
    assert decontaminate.contaminated(df, items).count() == 1
    rows = [(1, one), (2, two), (3, one[: size // 2] + "c"), (4, two[100 : size // 2 + 150])]
    repeats_of = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove(repeats_of).collect()), key=str)
    assert got == brute_repeats(rows)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """With a first hash of three bits nearly all pieces clash; the second one sends their rows to the tokenizer whole."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "span_hashes", lambda data, first, last, seed: span_hashes(data, first, last, seed) >> np.uint64(61 if seed == 1 else 0))
    texts = ["a few words here", "a few other words there, and more", "", "words words words", "x y z"] * 3
    plain, coder = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    for _ in range(2):
        data, offsets = text_buffer(pa.array(texts))
        ids, at = coder.encode(data, offsets, 2)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [[*plain.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_span_hashes_depend_on_bytes_and_length_alone():
    data = np.frombuffer(b"\0" * 40 + b"abcdefghijklmnopq" * 2 + b"z" * 5000, np.uint8)
    spans = [(0, k) for k in range(20)] + [(k, k + 17 - d) for k in (40, 57) for d in range(16)] + [(74, 74 + 2040 + k) for k in range(20)]
    first, last = (np.array(x) for x in zip(*spans))
    hashes = span_hashes(data, first, last).tolist()
    texts = [data[i:j].tobytes() for i, j in spans]
    assert {(a == b) == (x == y) for a, x in zip(texts, hashes) for b, y in zip(texts, hashes)} == {True}


def test_a_very_long_row_is_cut_with_overlap(spark):
    """The branch for rows of over two blocks: repeats across both internal cuts, and a long run of one letter."""
    rng = np.random.default_rng(14)
    noise = "".join(map(chr, rng.integers(97, 123, 330_000)))
    text = noise[:131_000] + "q" * 900 + noise[131_000:] + noise[130_900:131_400] + noise[262_000:262_300]
    rows = [(1, text), (2, noise[5000:5300]), (3, "q" * 250)]
    assert len(text) > 2 * repeats.BLOCK
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_repeats(rows)


def test_rows_of_one_id_are_drawn_alike_in_any_order(spark):
    rows = [(1, f"word number {k} {'x' * (k % 3)}", "a") for k in range(9)] + [(2, "one two three", "b")] * 2
    schema = "doc_id long, text string, source string"
    drawn = [sorted(map(str, mixing.sample(spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(k + 1)).collect())) for k in range(4)]
    assert drawn[0] == drawn[1] == drawn[2] == drawn[3]


def test_segments_cover_each_window_once():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    whole = repeats.runs_of(data, np.array([0, 4000]))
    covered = np.zeros(4000, int)
    for first, last in zip(whole[1], whole[2]):
        covered[first : last + 1] += 1
    assert (covered[: 4000 - 199] == 1).all() and not covered[4000 - 199 :].any()


def test_merge_of_transforms():
    rng = np.random.default_rng(6)
    for _ in range(10):
        base = [rng.integers(97, 99, rng.integers(150, 420)).astype(np.uint8).tobytes() for _ in range(4)]
        segs = [b[rng.integers(0, 40) : len(b) - rng.integers(0, 40)] for b in base for _ in range(4)] + [b"\0" * 260]
        seen: dict = {}
        for s in segs:
            for k in range(len(s) - 199):
                seen[s[k : k + 200]] = seen.get(s[k : k + 200], 0) + 1
        want = np.concatenate([[seen.get(s[k : k + 200], 0) >= 2 and k + 200 <= len(s) for k in range(len(s))] for s in segs])
        assert (repeats.repeated(np.frombuffer(b"".join(segs), np.uint8), np.cumsum([len(s) for s in segs])) == want).all()


def test_mix_against_sql(spark, duck):
    same_rows(mixing.op10_systematic_mix(spark, SF), duck(SF, mixing.ORACLE_SQL))


def test_mix_comes_near_its_targets(spark):
    rows = mixing.op10_systematic_mix(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, goal, most = {}, {}, {}
    for r in rows:
        s = docs[r.doc_id]
        taken[s], goal[s], most[s] = taken.get(s, 0) + r.taken, r.target, max(most.get(s, 0), r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - goal[s]) <= 2 * most[s] for s in goal)


def test_mix_odd_rows(spark, odd, none):
    got = mixing.mix(odd.withColumnRenamed("n_chars", "size")).collect()
    assert len(got) == len(ODD) and "size" in got[0].asDict()
    assert {r.mixed.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.sample(none).columns == none.columns
    again = mixing.mix(odd.withColumnRenamed("n_chars", "size")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.sample(odd).count() == sum(r.mixed.copies for r in got)
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.mixed.target, r.mixed.copies) for r in mixing.mix(blank).collect()} <= {(0.0, 0)}
