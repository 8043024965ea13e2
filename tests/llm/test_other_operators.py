"""Chat formatting, URL rules, embeddings and the pipeline."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import chat, embeddings, tokens, urls
from tests.helpers import same_rows

SF = "/root/testdata/sf0.001"


def test_chat_against_sql(spark, duck):
    same_rows(chat.op7_chat_format(spark, SF), duck(SF, chat.ORACLE_SQL))


def test_chat_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<|end|><\\|end|>", "<<SYS>>", "a<", "|>", "", None, "😀 <s>\n<|turn|>x<|says|>"]
    rows = [(1, k, r, t) for k, t in enumerate(texts) for r in ["assistant" if k % 2 else "us<|says|>er"]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r, t or "") for _, _, r, t in rows]
    assert got.loss_text == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    for s in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert s not in got.formatted
    assert got.formatted.count("<|turn|>") == len(rows)


def test_chat_parts(spark):
    part = lambda **k: {**dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages")), **k}
    rows = [
        (1, 0, "user", [part(type="text", text="see "), part(type="image", ref="i1", width=57, height=28), None, part(type="audio", ref="a1", seconds=1.5), part(type="document", ref="d1", pages=3)]),
        (1, 1, "assistant", None),
        (None, None, None, [part(type="odd", text="<s>")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got[1].turns[0].text == "see <|image:1|><|audio:2|><|document:3|>"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(1, 1, "image", "i1", 3), (1, 2, "audio", "a1", 38), (1, 3, "document", "d1", 3072)]
    assert got[1].loss_text == "" and got[None].turns[0].text == "<s>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_urls_against_sql(spark, duck):
    same_rows(urls.op8_url_rules(spark, SF), duck(SF, urls.ORACLE_SQL))


def test_urls_with_many_rules(spark):
    rng = np.random.default_rng(3)
    labels = ["a", "b", "c", "www", "x"]
    hosts = [".".join(rng.choice(labels, rng.integers(1, 5))) + rng.choice([".com", ".net", ""]) for _ in range(120)]
    paths = ["/", "/en", "/en/", "/en/a", "/d"]
    rules = [(h, str(rng.choice(paths)), str(rng.choice(["allow", "block"]))) for h in hosts]
    addresses = [f"{s}://{h.upper() if k % 3 else h}{p}{t}" for k, h in enumerate(hosts * 3) for s, p, t in [(rng.choice(["http", "ftp"]), rng.choice([*paths, "", "/en/abc"]), rng.choice(["", "?q=/en", "#x"]))]]
    addresses += [None, "", "no scheme", "://", "http://", "http://.com/", "http://com", "http://a.com:80/en", addresses[0], addresses[0]]
    df = spark.createDataFrame([(u,) for u in addresses], "url string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, action string")).collect()}
    held: dict = {}
    for h, p, a in rules:
        held[(h, p)] = min(a, held.get((h, p), a))
    for u in set(addresses):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest)) if rest is not None else 0
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]) if rest is not None else ""
        path = rest[cut:].split("?")[0].split("#")[0] if rest is not None else ""
        fits = [(len(h + p), h + p, a) for (h, p), a in held.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[u][:2] == (host, path)
        if fits:
            longest = max(f[0] for f in fits)
            assert got[u][2:] in [(r, a) for n, r, a in fits if n == longest], u
        else:
            assert got[u][2:] == (None, "allow"), u


def test_urls_odd_tables(spark):
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    assert urls.judge(spark.createDataFrame([], "url string"), rules).count() == 0
    long = "http://example.com/en/" + "x" * 200_000
    df = spark.createDataFrame([(long,), (long,), (None,)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got == {long: ("example.com/en/", "block"), None: (None, "allow")}
    assert {r.verdict for r in urls.judge(df, rules.limit(0)).collect()} == {"allow"}
    many = spark.createDataFrame([("example.com", f"/p{k}/", "block") for k in range(3000)], "host string, path string, action string")
    got = urls.judge(spark.createDataFrame([("http://a.example.com/p2999/x",), ("http://a.example.com/p3000/x",)], "url string"), many)
    assert {r.rule for r in got.collect()} == {"example.com/p2999/", None}


def test_chat_long_texts(spark):
    text = "<s>[INST] \\ " * 40_000
    df = spark.createDataFrame([(1, k, "assistant", text) for k in range(3)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert got.loss_text == text * 3 and len(got.turns) == 3


def test_embeddings_against_sql(spark, duck):
    same_rows(embeddings.op5_cross_polytope(spark, SF), duck(SF, embeddings.ORACLE_SQL))


def test_embeddings_links_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 64))
    x = np.repeat(centre, 120, axis=0) + rng.normal(size=(720, 64)) * 0.18
    x = np.concatenate([x, x[:20], rng.normal(size=(200, 64))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64), (9006, [float("inf")] * 64), (None, x[0].tolist()), (9007, [1.0, 0.0]), (9008, [2.0, 0.01])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
    for i in range(len(x)):
        assert all(got[int(j)].component_id == got[i].component_id for j in np.flatnonzero(linked[i]))
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006, None))
    assert got[9008].component_id == 9007 and got[None].component_id is None
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", None), (10**6 + 1, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.union(extra)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        if name == "language":
            assert kept.count() == before.count() - 2
        if name == "near_duplicates":
            texts = [r.text for r in kept.collect()]
            assert len(set(texts)) == len(texts) and kept.exceptAll(before).count() == 0
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in kept.collect() for i in items)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count()


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_near_duplicates(rows):
    """The smallest id that each document reaches by links of five-word shingles, over all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows:
        w = plain_words((r["text"] or "").translate(low))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    first, ids = {i: i for i in sets}, sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    return first


def plain_leaks(rows, items):
    """Ids of documents with 13 consecutive words of which at least 11 are an item's, place by place."""
    low = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    numbers: dict = {}
    code = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in low(t)], np.int64)
    bank = np.stack([w[k : k + 13] for w in map(code, items) for k in range(len(w) - 12)])
    found = set()
    for r in rows:
        n = code(r["text"])
        if len(n) >= 13 and any(((bank == v).sum(1) >= 11).any() for v in np.lib.stride_tricks.sliding_window_view(n, 13)):
            found.add(r["doc_id"])
    return found


def plain_mix(rows):
    """How often each document is drawn: targets by repeated sharing, then running sums document by document."""
    size = {r["doc_id"]: len(plain_words(r["text"])) for r in rows}
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    held = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in names}
    left, target = set(names), {}
    while left:
        rest = Fraction(sum(held.values()) * 150, 100) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * held[s]}
        target |= {s: Fraction(2 * held[s]) for s in over} or share
        left = left - over if over else set()
    out = {}
    for s in names:
        u = int(hashlib.md5(f"0:{'null' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = float(target[s]) / held[s] if held[s] else 0.0
        own = sorted((size[r["doc_id"]], r["doc_id"] % 256, r["doc_id"]) for r in rows if r["source"] == s)
        for k, (_, _, i) in enumerate(own):
            out[i] = min(2, math.floor((k + 1) * rate + u) - math.floor(k * rate + u))
    return out


def test_pipeline_against_plain_python(spark):
    """Each stage's decisions worked out anew, document by document, from what the stage before kept."""
    from tokenizers import Tokenizer

    kept, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = [r.asDict() for r in kept.collect()], stage(spark, kept, SF).cache()
        seen[name] = before, [r.asDict() for r in kept.collect()]
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    before, after = seen["language"]
    assert ids(after) == ids(r for r in before if re.search(r"[^\W\d_]", r["text"] or ""))
    before, after = seen["near_duplicates"]
    first = plain_near_duplicates(before)
    assert ids(after) == sorted(i for i in first if first[i] == i) and len(after) < len(before)
    before, after = seen["decontamination"]
    leaked = plain_leaks(before, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert ids(after) == ids(r for r in before if r["doc_id"] not in leaked) and leaked
    before, after = seen["mix"]
    drawn = plain_mix(before)
    assert ids(after) == sorted(i for i, n in drawn.items() for _ in range(n)) and max(drawn.values()) == 2
    before, after = seen["tokens"]
    t = Tokenizer.from_file(tokens.vocabulary())
    coded = [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in sorted(before, key=lambda r: r["doc_id"])]
    starts = np.cumsum([0, *[len(x) for _, x in coded]])
    want = sorted((i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), s in zip(coded, starts))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in after) == want
    run = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert run == want


def test_pipeline_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (None, "a text of several words", None, None, None), (5, "a text of several words", "en", "s", 1), (5, "a text of several words", "en", "s", 1), (6, "", "en", None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs.withColumn("kept", F.lit(1)), SF)
            assert docs.columns == schema.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", ["op1_language_id", "op10_systematic_mix"])
def test_registered(name):
    from dossier.llm import registry

    assert name in registry.QUERIES


def test_longer_keys_get_more_tables(spark, monkeypatch):
    assert embeddings.tables_for(3, 64, 0.95) == embeddings.TABLES and embeddings.missed(3, 32, 0.95) < embeddings.missed(3, 64, 0.95)
    for depth, d in ((3, 64), (4, 64), (3, 128)):
        n = embeddings.tables_for(depth, d, 0.95)
        assert embeddings.missed(depth, d, 0.95, seed=3) ** n < 1e-6
    # The whole operator with the keys of a large table.
    monkeypatch.setattr(embeddings, "DEPTH", 4)
    used = []
    keys = embeddings.keys
    monkeypatch.setattr(embeddings, "tables_for", lambda *a: used.append(a) or 28)
    assert embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).where("n_links = 1").count() == 2
    assert used == [(4, 2, 0.95)] and keys(np.eye(4), 4, 28).shape == (4, 28, embeddings.PROBES + 1)


def test_further_columns_and_clashing_names_change_nothing(spark):
    """Rows with columns named like those that operators make inside: results are those without them."""
    from dossier.llm import embeddings, exact, infill, minhash, repeats, tokens

    long = " ".join(f"w{k}" for k in range(90))
    texts = [(1, long, "x"), (2, long + " end", "y"), (3, None, "z"), (4, "", None), (5, "short text", "s")]
    plain = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    names = ["id", "h", "n", "bucket", "anchor", "name", "file", "pos", "start", "hash", "row", "maybe", "kept", "content", "component", "ids", "lines", "output", "form"]
    more = plain.withColumns({c: F.lit(None).cast("string") if k % 2 else F.col("doc_id") for k, c in enumerate(names)})
    for f in (tokens.tokenize, repeats.remove, lambda d: minhash.components(d, k=4), exact.groups, infill.infill):
        assert sorted(map(str, f(more).collect())) == sorted(map(str, f(plain).collect()))
    vectors = spark.createDataFrame([(k, [1.0, 0.001 * k, 0.0, 0.0]) for k in range(6)], "vec_id long, embedding array<double>")
    wide = vectors.withColumns({c: F.lit("x") for c in ("rep", "bucket", "fit", "links", "own", "node", "label")})
    assert sorted(map(str, embeddings.near_duplicates(wide).collect())) == sorted(map(str, embeddings.near_duplicates(vectors).collect()))
    turns = spark.createDataFrame([(1, k % 2, "user" if k % 2 else "assistant", f"t{k}") for k in range(6)], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    odd = turns.withColumns({c: F.lit(1) for c in ("spans", "n", "formatted", "turns_", "at", "k")})
    want = chat.read_back(chat.format_chats(turns)).first()
    assert str(chat.read_back(chat.format_chats(odd)).first()) == str(want)
    pages = spark.createDataFrame([("http://www.a.com/en/x",), (None,), ("no url",)], "url string")
    rules = spark.createDataFrame([("a.com", "/en/", "block")], "host string, path string, action string")
    clash = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "key", "action", "verdict")})
    assert sorted(map(str, urls.judge(clash, rules).collect())) == sorted(map(str, urls.judge(pages, rules).collect()))


def test_tied_turns_come_in_one_order(spark):
    """Turns of one number stand by role and text, whatever the order of the rows."""
    rows = [(1, t, r, f"said {k}") for k, (t, r) in enumerate([(0, "user"), (0, "user"), (0, "assistant"), (None, "user"), (1, "assistant"), (1, "assistant")])]
    schema = "conv_id long, turn long, role string, text string"
    formatted = {chat.format_chats(spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3).withColumn("parts", chat.text_part(F.col("text")))).first().formatted for k in range(5)}
    assert len(formatted) == 1


def test_pipeline_very_long_texts(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long = " ".join(f"the word number {k * 7919 % 100_003}" for k in range(60_000))
    rows = [(1, long, "en", "a", len(long)), (2, long + " and a tail", "en", "a", len(long) + 11), (3, long[::-1], "en", "b", len(long)), (4, "x" * 300_000 + " the word", "en", "b", 300_009), (5, "the word of one line", "en", "b", 20)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [1, 3, 4, 5]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.n_tokens for r in last) > 4 * 60_000
