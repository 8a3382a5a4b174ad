"""Conversation repair, fill-in-the-middle and toxicity against brute force, SQL and gradients."""
from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from routegrid.llm import middle, repair, toxicity
from routegrid.llm.hashing import text_buffer
from routegrid.llm.suite import ORACLES, QUERIES
from pyspark.sql import functions as F

LEGAL = re.compile(r"(s?(ua)+)?")


def every_way(pattern, entry, exits):
    """All ways to edit, with at most three insertions in a row, as (cost, audit); written without a lattice."""
    found = []

    def go(i, state, inserts, cost, audit):
        if i == len(pattern) and state in exits:
            found.append((cost, audit))
        if inserts < 3:
            for x in "ua":
                if (state, x) in repair._AFTER:
                    go(i, repair._AFTER[state, x], inserts + 1, cost + 3, audit + "I")
        if i < len(pattern):
            code = pattern[i]
            go(i + 1, state, 0, cost + 4, audit + "D")
            if code != "d":
                more = 3 if code.isupper() else 0
                if (state, code.lower()) in repair._AFTER:
                    go(i + 1, repair._AFTER[state, code.lower()], 0, cost + more, audit + "K")
                for x in "ua":
                    if (state, x) in repair._AFTER:
                        go(i + 1, repair._AFTER[state, x], 0, cost + more + 3, audit + "R")
    go(0, entry, 0, 0, "")
    return min(found) if found else None


def test_cheapest_is_the_least_of_all_ways():
    for n in range(4):
        for letters in itertools.product("suaxdSUA", repeat=n):
            assert repair.cheapest("".join(letters), 0, repair.ENDS) == every_way("".join(letters), 0, repair.ENDS), letters
    rng = random.Random(3)
    for _ in range(60):
        pattern = "".join(rng.choice("suaxdUA") for _ in range(rng.randrange(4, 6)))
        entry, exit_ = rng.randrange(4), rng.randrange(4)
        assert repair.cheapest(pattern, entry, (exit_,)) == every_way(pattern, entry, (exit_,)), (pattern, entry, exit_)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash", "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int, _conv string, fault string, audit string")


def some_conversations():
    rng = random.Random(8)
    rows = []
    for c in range(40):
        turns = list(range(rng.randrange(0, 12)))
        for t in turns:
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Fine.", "open", "What?", "", " \t", None, "same text!", f"text {t}.  \n", "x. "])
            rows.append((c, rng.choice([t, t, t, None, 5]), role, text))
    rows += [(None, None, None, None), (None, 3, "user", "lost."), (None, 3, "user", "lost."), (99, 0, "system", "s" * 200_000 + "."), (98, None, "user", "hm.")]
    rows += [(97, i, "user" if i % 2 else "assistant", f"turn {i % 50}." if i % 7 else "cut") for i in range(60)]
    return rows


def test_repair_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = some_conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    want = sorted(map(str, con.sql(ORACLES["op11_conversation_repair"]).fetchall()))
    given = conversations(spark, rows)
    found = repair.repaired_conversations(given, repair.damage(given)).withColumn("text", F.sha2(F.col("text").cast("binary"), 256))
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    none = repair.repaired_conversations(given.where("false"), repair.damage(given.where("false")))
    assert none.count() == 0


def test_repair_in_slices(spark):
    given = conversations(spark, some_conversations())
    summary, rows = repair.repair(given)
    cut_summary, cut_rows = repair.repair(given, slice_rows=2)
    assert sorted(map(str, summary.collect())) == sorted(map(str, cut_summary.collect()))
    assert sorted(map(str, rows.collect())) == sorted(map(str, cut_rows.collect()))
    for r in rows.groupBy("_conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: F.left(x["role"], F.lit(1))), "").alias("roles")).collect():
        assert LEGAL.fullmatch(r["roles"]), r


def test_words_marks_and_select():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 64, 1000):
        buf = rng.choice(np.array([10, 11, 9, 0, 138, 194, 255, 65], np.uint8), n)
        for marks, want in ((middle.marks_of(middle.as_words(buf), 10), buf == 10), (middle.starts_of(middle.as_words(buf)), (buf & 0xC0) != 0x80)):
            m = middle.Marks(marks)
            at = np.arange(n + 1)
            assert (m.rank(at) == np.append(0, np.cumsum(want))).all()
            assert (m.select(np.arange(1, want.sum() + 1)) == np.flatnonzero(want)).all()


TEXTS = [
    None, "", "\n", "one", "one\n", "a\nb", "\n\n\n", "é\n漢字\n🙂", "x <P> y\nz", "<S>", "<M>\n", "<<P\n>S>\n<M\n>", " a\u0085b\r\nc\n", "tail\n\nlast",
    *["\n".join(f"line {i} ü{'<' * (i % 3)}" for i in range(n)) + "\n" * (n % 2) for n in range(1, 40)], "long line " * 30_000 + "\nend", "\n" * 70_000,
]


def test_middle_matches_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id\nhere", "clash", 1), (3, "one", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int")
    found = middle.fill_in_middle(docs).withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect()
    want = []
    for i, t, *_ in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[k:k + 8], 16) for k in (0, 8, 16, 24)]
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            want.append((i, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < 50:
            want.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.where("false")).count() == 0
    assert {r["form"] for r in middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network(3, word_size=3, char_size=3, hidden=4)
    for k, v in net.weights.items():
        net.weights[k] = v.astype(np.float64)
    rng = np.random.default_rng(1)
    given = rng.normal(0, 1, (2, 5, 3, 12))
    present = np.arange(5)[:, None] < np.array([5, 3, 0])
    slope = rng.normal(0, 1, 3)

    def loss():
        return float(net.forward(given, present)[0] @ slope)

    grad, d_given = net.backward(slope, net.forward(given, present, keep=True)[1])
    for k in ("round", "look", "out", "base"):
        for at in [tuple(rng.integers(0, s) for s in net.weights[k].shape) for _ in range(6)]:
            value = net.weights[k][at]
            net.weights[k][at] = value + 1e-3
            up = loss()
            net.weights[k][at] = value - 1e-3
            assert abs((up - loss()) / 2e-3 - grad[k][at]) < 2e-3, (k, at)
            net.weights[k][at] = value
    for at in [(d, t, b, h) for d in (0, 1) for t in (0, 2, 4) for b in (0, 1) for h in (0, 5, 11)]:
        value = given[at]
        given[at] = value + 1e-3
        up = loss()
        given[at] = value - 1e-3
        assert abs((up - loss()) / 2e-3 - d_given[at]) < 2e-3, at
        given[at] = value


def test_windows_cover_every_word():
    texts = [None, "", " ", "one", " ".join(f"w{i}" for i in range(32)), " ".join(f"w{i}" for i in range(33)), "ab\n" * 500, "x" * 5000]
    words = toxicity.tokenised(texts)
    assert np.diff(words.text_offs).tolist() == [len((t or "").split()) for t in texts]
    for i, t in enumerate(texts):
        mine = np.flatnonzero(words.owner == i)
        covered = sorted({j for w in mine for j in range(words.window[w], words.window[w] + words.length[w])})
        assert covered == list(range(words.text_offs[i], words.text_offs[i + 1])) and len(mine) >= 1
        assert len(mine) == 1 or (words.length[mine[:-1]] == toxicity.WINDOW).all()
    word, gram, first = words.inputs(0, len(words.start))
    same = toxicity.tokenised(["AB ab"]).inputs(0, 2)
    assert same[0][0] == same[0][1] and (same[1][:2] == same[1][2:]).all() and len(word) == len(words.start)
    alone = toxicity.Words(*text_buffer(pa.array(["ab", "ab"], pa.string()))).inputs(0, 2)
    assert (alone[1] == same[1]).all()  # no 4-gram crosses from one text to the next


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 150))]
        if i % 2:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vexword", "zwy" + rng.choice(plain)]))
        out.append((i, " ".join(w), i % 2))
    return out


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_rows(400, 1)
    docs = spark.createDataFrame([(i, t, "clash", 2.0) for i, t, _ in rows] + [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (None, "fine words", "x", 0.0), (1002, rows[1][1] * 2000, "x", 0.0)],
                               "doc_id bigint, text string, label string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, None, 0), (7777, 1, 0)], "doc_id bigint, toxic int, quality int")
    learned, named = docs.where(~toxicity.held_out()), labels.select("doc_id", F.col("toxic").alias("label"))
    net = toxicity.fit(learned, named, fit_chars=90_000)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, net).withColumn("held", toxicity.held_out()).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(y, got[i]["score"] >= 0.5) for i, _, y in rows if got[i]["held"]]
    assert len(held) > 50 and sum(y == p for y, p in held) / len(held) > 0.95
    assert got[1002]["score"] >= 0.5 and got[1000]["score"] == got[1001]["score"] < 0.5
    again = toxicity.fit(learned.repartition(7), named.unionByName(named), fit_chars=90_000)
    assert {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, again).collect()} == {k: r["score"] for k, r in got.items()}
    assert toxicity.score_texts(docs.where("false"), net).count() == 0
    for few in (named.where("false"), named.where("label = 0"), named.where("doc_id = 1")):
        scores = {r["score"] for r in toxicity.score_texts(docs, toxicity.fit(docs, few)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_the_sample_is_bounded(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "concat('text ', id % 2000) text", "cast(id % 3 = 0 as int) label")
    got = toxicity._bounded(rows.select("doc_id", "text"), rows.select("doc_id", "label"), 2000, 100).groupBy("label").agg(F.sum(F.length("text")).alias("n"), F.count_distinct("text").alias("d"), F.count("text").alias("c")).collect()
    assert len(got) == 2 and all(2000 <= r["n"] <= 4000 and r["d"] == r["c"] for r in got)
    assert "op13_toxicity" in QUERIES
