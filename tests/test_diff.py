"""Alignment, moves, coincidences and revisions against plain, quadratic versions of their definitions."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import diff


def plain_steps(a, b, trim=True):
    """From the whole table of longest common subsequences of the ends; of equal choices a removal comes first."""
    head = tail = 0
    if trim:
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i, j] = best[i + 1, j + 1] + 1 if x[i] == y[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [("=", k, k) for k in range(head)], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            op = "="
        else:
            op = "-" if j == len(y) or (i < len(x) and best[i + 1, j] >= best[i, j + 1]) else "+"
        out.append((op, head + i, head + j))
        i, j = i + (op != "+"), j + (op != "-")
    return out + [("=", len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def test_steps_are_those_of_the_whole_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(30))] for _ in range(2))
        for trim in (True, False):
            assert diff.steps(a, b, trim) == plain_steps(a, b, trim)
    a, b = ["x", *["p", "q"] * 1100, "y"], ["u", *["p", "q"] * 1050, "v"]
    assert sum(op == "=" for op, _, _ in diff.steps(a, b)) == 2100


def test_long_lists_with_few_changes_take_under_a_second():
    rng = random.Random(2)
    a = [f"line {rng.randrange(9000)}" for _ in range(20_000)]
    b = list(a)
    for _ in range(100):
        b[rng.randrange(len(b))] = f"new {rng.random()}"
    began = time.process_time()
    found = diff.steps(a, b)
    assert time.process_time() - began < 1
    assert sum(op == "=" for op, _, _ in found) >= 19_900 and [b[j] for op, _, j in found if op != "-"] == b


def plain_moved(gone, come, least=3):
    """All pairs of places, again and again: the longest run in common, the first of equals; then the two rules that follow."""
    d = [(r, x) for r, run in enumerate(gone) for x in run]
    i = [(r, x) for r, run in enumerate(come) for x in run]
    used = [set(), set()]
    while True:
        best = (0, 0, 0)
        for x in range(len(d)):
            for y in range(len(i)):
                n = 0
                while x + n < len(d) and y + n < len(i) and d[x + n] == (d[x][0], i[y + n][1]) and i[y + n][0] == i[y][0] and x + n not in used[0] and y + n not in used[1]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        if best[0] < least:
            break
        for k in range(best[0]):
            used[0].add(best[1] + k)
            used[1].add(best[2] + k)

    def beside(stream, own, k):
        return any(0 <= o < len(stream) and o in own and stream[o][0] == stream[k][0] for o in (k - 1, k + 1))

    for _ in range(5):
        before = len(used[0])
        for x in range(len(d)):
            if x in used[0] or not beside(d, used[0], x):
                continue
            for y in range(len(i)):
                if y not in used[1] and i[y][1] == d[x][1] and (not re.search("[A-Za-z0-9]", d[x][1]) or beside(i, used[1], y)):
                    used[0].add(x)
                    used[1].add(y)
                    break
        if len(used[0]) == before:
            break
    if 10 * (len(used[0]) + len(used[1])) >= 6 * (len(d) + len(i)):
        for x in range(len(d)):
            y = next((y for y in range(len(i)) if y not in used[1] and i[y][1] == d[x][1]), None)
            if x not in used[0] and y is not None:
                used[0].add(x)
                used[1].add(y)
    return [k in used[0] for k in range(len(d))], [k in used[1] for k in range(len(i))]


def test_moves_against_all_pairs():
    rng = random.Random(3)
    some = 0
    for _ in range(400):
        letters = ["a", "b", "c", "-", "d", "e", "f", "g"][: rng.randrange(2, 9)]
        gone, come = ([[rng.choice(letters) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(4))] for _ in range(2))
        gone, come = [r for r in gone if r], [r for r in come if r]
        if rng.random() < 0.5 and gone:
            come.append(list(rng.choice(gone)))
        got = [x.tolist() for x in diff.moved(gone, come)]
        assert got == list(plain_moved(gone, come))
        some += any(got[0])
    assert some > 100


def test_many_moves_have_no_limit():
    blocks = [[f"w{k}-{n}" for n in range(3)] for k in range(300)]
    flags = diff.moved([x for b in blocks for x in [b]], [x for b in reversed(blocks) for x in [b]])
    assert flags[0].all() and flags[1].all()
    long = [f"t{k % 5000}" for k in range(60_000)]
    began = time.process_time()
    flags = diff.moved([long], [long[30_000:], long[:30_000]])
    assert flags[0].all() and time.process_time() - began < 20


def plain_cleanup(ops):
    """ops: (op, i, j, whole). Runs are found anew in each pass."""
    kind = lambda o: {"=": "=", "-": "~", "+": "~"}.get(o[0], "m")

    def parted(ops):
        out = []
        for o in ops:
            out.append([o]) if not out or kind(out[-1][0]) != kind(o) else out[-1].append(o)
        return out

    for _ in range(6):
        runs, new = parted(ops), []
        for k, r in enumerate(runs):
            around = [len(runs[n]) for n in (k - 1, k + 1) if 0 <= n < len(runs) and kind(runs[n][0]) == "~"]
            if kind(r[0]) == "=" and len(r) <= 2 and not any(o[3] for o in r) and len(around) == 2 and min(around) >= 2 and sum(around) >= 6:
                new += [("-", *o[1:]) for o in r] + [("+", *o[1:]) for o in r]
            else:
                new += r
        if new == ops:
            break
        ops = new
    return [o for r in parted(ops) for o in (sorted(r, key=lambda o: o[0] == "+") if kind(r[0]) == "~" else r)]


def plain_content(x, y):
    """Words and their line numbers of both texts."""
    signature = lambda t: re.sub(r"\s+", " ", re.sub(r"\d+", "#", t.lower())).strip() if len(re.sub("[^a-z]", "", t.lower())) >= 4 else ""
    twice = set()
    for t in (x, y):
        pages: dict = {}
        for n, page in enumerate(re.split(r"(?:^|(?<=\n))\f(?=\n|$)", t)):
            for sig in {signature(line) for line in page.split("\n")} - {""}:
                pages.setdefault(sig, set()).add(n)
        twice |= {sig for sig, found in pages.items() if len(found) > 1}
    out = []
    for t in (x, y):
        kept = "\n".join(line for line in t.split("\n") if line != "\f" and signature(line) not in twice)
        kept = re.sub(r"([A-Za-zÀ-ɏ])[-‐‑­]\n(\S+)", r"\1\2", kept)
        words = [(w, n) for n, line in enumerate(kept.split("\n")) for w in line.split()]
        bare = lambda w: re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", re.sub("[-‐‑­]", "", w)) or w
        out.append(([bare(w) for w, _ in words], [n for _, n in words]))
    return out


def plain_revision(x, y):
    (a, la), (b, lb) = plain_content(x or "", y or "")

    def lines(words, at):
        out = {}
        for k, n in enumerate(at):
            out.setdefault(n, []).append(k)
        return [(v[0], v[-1] + 1, " ".join(words[v[0] : v[-1] + 1])) for v in out.values()]

    ra, rb = lines(a, la), lines(b, lb)
    found = plain_steps([r[2] for r in ra], [r[2] for r in rb])
    whole, free = set(), [(k, rb[j][2]) for k, (op, _, j) in enumerate(found) if op == "+"]
    for k, (op, i, _) in enumerate(found):
        hit = next((f for f in free if f[1] == ra[i][2]), None) if op == "-" else None
        if hit:
            free.remove(hit)
            whole |= {k, hit[0]}
    ops, k = [], 0
    while k < len(found):
        op, i, j = found[k]
        if op == "=":
            ops += [("=", ra[i][0] + q, rb[j][0] + q, True) for q in range(ra[i][1] - ra[i][0])]
        elif k in whole:
            ops += [("<", q, None, False) for q in range(*ra[i][:2])] if op == "-" else [(">", None, q, False) for q in range(*rb[j][:2])]
        else:
            first, gone, come = k, [], []
            while k < len(found) and found[k][0] != "=" and k not in whole:
                gone += range(*ra[found[k][1]][:2]) if found[k][0] == "-" else []
                come += range(*rb[found[k][2]][:2]) if found[k][0] == "+" else []
                k += 1
            for o, p, q in plain_steps([a[g] for g in gone], [b[c] for c in come], trim=False):
                ops.append((o, gone[p] if o != "+" else None, come[q] if o != "-" else None, False))
            assert k > first
            continue
        k += 1
    ops = plain_cleanup(ops)
    runs = {"-": [], "+": []}
    for k, o in enumerate(ops):
        if o[0] in runs:
            if k and ops[k - 1][0] == o[0]:
                runs[o[0]][-1].append(o)
            else:
                runs[o[0]].append([o])
    flags = plain_moved([[a[o[1]] for o in r] for r in runs["-"]], [[b[o[2]] for o in r] for r in runs["+"]])
    moved = {id(o) for side, flag in (("-", flags[0]), ("+", flags[1])) for o, f in zip([o for r in runs[side] for o in r], flag) if f}
    out = []
    for o in ops:
        op = {"-": "<", "+": ">"}[o[0]] if id(o) in moved else o[0]
        place = o[1] if op in "=-<" else o[2]
        if out and out[-1][0] == op and out[-1][1] + out[-1][2] == place:
            out[-1][2] += 1
        else:
            out.append([op, place, 1])
    return [tuple(x) for x in out]


def told(runs):
    """(op, place on its own side, length), so that both versions read alike; neighbours joined."""
    out = []
    for r in runs:
        place = r.a if r.op in "=-<" else r.b
        if out and out[-1][0] == r.op and out[-1][1] + out[-1][2] == place:
            out[-1][2] += r.n
        else:
            out.append([r.op, place, r.n])
    return [tuple(x) for x in out]


def test_revisions_against_plain_python(spark):
    rng = random.Random(4)
    words = ["bolt", "M8", "25", "Nm,", "check", "the", "gap:", "-", "equip-", "ment.", "(see", "note)", "é", "torque"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(7)))
    rows = [(0, None, None), (1, "", "a b"), (2, "a b c", None), (3, "same\ntext", "same\ntext")]
    for k in range(4, 90):
        a = [line() for _ in range(rng.randrange(1, 14))]
        if k % 3 == 0:
            for at in (0, len(a) // 2, len(a) - 1):
                a[at : at + 1] = ["\f", f"Page footer {at} of this manual", a[at]]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b))
            change = rng.randrange(4)
            if change == 0:
                b[at] = " ".join(w for w in b[at].split() if rng.random() < 0.6)
            elif change == 1:
                b.insert(rng.randrange(len(b)), b.pop(at))
            elif change == 2:
                b.insert(at, line())
            else:
                b[at] = b[at] + " " + line()
        rows.append((k, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows, "key long, a string, b string").repartition(3)
    got = {r.key: told(r.runs) for r in diff.revisions(df, "key").collect()}
    want = {k: plain_revision(x, y) for k, x, y in rows}
    assert got == want
    ops = {op for x in want.values() for op, _, _ in x}
    assert ops == {"=", "-", "+", "<", ">"}


def test_revisions_keep_words_apart_at_aligned_lines(spark):
    """The second text has the words of the first line also after the line that both share; they do not match across it."""
    df = spark.createDataFrame([("k", "alpha beta\nthe shared line stays\nother", "new\nthe shared line stays\nalpha beta words"), (None, "x", "y")], "key string, a string, b string")
    got = {r.key: r for r in diff.totals(diff.revisions(df, "key")).collect()}
    assert (got["k"].same, got["k"].removed, got["k"].added, got["k"].moved) == (4, 3, 4, 0)
    assert got[None].runs is None


def test_a_large_pair_is_spread(spark):
    """A pair of 100,000 lines with few changes: each changed stretch is a row of its own."""
    lines = [f"line {k} says {k * 7919 % 1000003} and more" for k in range(100_000)]
    other = list(lines)
    for k in range(0, 100_000, 2000):
        other[k] = f"line {k} was changed here"
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join(other))], "key long, a string, b string")
    got = diff.totals(diff.revisions(df, "key")).first()
    assert got.same == 6 * (100_000 - 50) + 2 * 50 and got.moved == 0
    assert got.removed == 4 * 50 and got.added == 3 * 50


@pytest.mark.parametrize("by", ["line", "word"])
def test_runs_rebuild_both_sides(spark, by):
    rng = random.Random(8)
    texts = [["".join(rng.choice("abcde") for _ in range(rng.randrange(30))) for _ in range(2)] for _ in range(60)]
    sep = "\n" if by == "line" else " "
    df = spark.createDataFrame([(k, sep.join(x), sep.join(y)) for k, (x, y) in enumerate(texts)], "k long, a string, b string")
    for r in diff.diff(df, by=by).where(F.col("k").isNotNull()).collect():
        a, b = (t.split("\n") if by == "line" else t.split() for t in (r.a, r.b))
        assert [x for o in r.runs if o.op in "=-<" for x in a[o.a : o.a + o.n]] == a
        assert [x for o in r.runs if o.op in "=+>" for x in b[o.b : o.b + o.n]] == b
        assert sum(o.n for o in r.runs if o.op == "<") == sum(o.n for o in r.runs if o.op == ">")


def test_document_queries_against_plain_python(spark):
    from dossier.plans import catalogue

    sf = "/root/testdata/sf0.001"
    copies = {r.doc_id: (r.x, r.y) for r in catalogue._near_copies(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = {k: {x for x in (t or "").split("\n") if x.strip()} for k, t in texts.items()}
    near = {k: min((j for j in lines if j < k and lines[j] and 100 * len(lines[j] & lines[k]) >= 80 * len(lines[j] | lines[k])), default=None) for k in lines}
    assert copies == {k: (texts[j], texts[k]) for k, j in near.items() if j is not None} and len(copies) > 5
    count = lambda runs, op: sum(n for o, _, n in runs if o == op)
    want = set()
    for k, (x, y) in copies.items():
        runs = plain_revision(x, y)
        want.add((k, *(count(runs, op) for op in "-+>=")))
    got = {(r.doc_id, r.removed, r.added, r.moved, r.same) for r in catalogue.QUERIES["document_revisions"](spark, sf).collect()}
    assert got == want
    want = set()
    for k, (x, y) in copies.items():
        a, b = x.split("\n"), y.split("\n")
        found = plain_steps(a, b)
        gone, come = [], []
        for n, (op, i, j) in enumerate(found):
            new = n == 0 or found[n - 1][0] == "="
            if op != "=" and new:
                gone.append([])
                come.append([])
            gone[-1].append(a[i]) if op == "-" else come[-1].append(b[j]) if op == "+" else None
        flags = plain_moved([r for r in gone if r], [r for r in come if r])
        ops = [op for op, _, _ in found]
        want.add((k, ops.count("-") - sum(flags[0]), ops.count("+") - sum(flags[1]), sum(flags[1]), ops.count("=")))
    assert {(r.doc_id, r.removed, r.added, r.moved, r.same) for r in catalogue.QUERIES["document_diff"](spark, sf).collect()} == want
