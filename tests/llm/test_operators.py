"""The operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""
from __future__ import annotations

import collections
import contextlib
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from routegrid.llm import bpe, chat, decontaminate, html, jaccard, language, sampling, scoring, suffixes, urls
from routegrid.llm.suite import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, node string, _spans string"


def documents(spark, texts, langs=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, langs[i] if langs else "xx", "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(rng, n, size=40):
    return " ".join(rng.choice(["tok", "Tik", "lo", "ma", "éü", "漢"]) + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words_of(rng, rng.randrange(20, 160)) for _ in range(12)]
    out = list(base)
    for t in base[:8]:
        w = t.split(" ")
        out.append(t)  # exact copies
        w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
        out.append("intro words here " + t[: len(t) // 2])
    passage = words_of(rng, 120)
    out += [words_of(rng, 15) + " " + passage + " " + words_of(rng, 9), passage[3:], words_of(rng, 30) + passage]
    out += [None, "", " ", "one", "ONE", "two words", "Two  words", "a b c", "x" * 900, "x" * 401, "ab" * 300, "\n\t .", None]
    out.append("long " * 6000)
    return out


def test_bpe_matches_the_library(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocabulary = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary.load(path)
    more = [*texts, "<|endoftext|> a<|endoftext|>\n", "it's we'LL  \r\n \u00a0x\u2028 1٣ 🙂́", "ª\x85b\x1cc", "a" * 5000]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(documents(spark, more), vocabulary), vocabulary).collect()}
    for i, t in enumerate(more):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["text"] == library.decode(ids, skip_special_tokens=False) == (t or "")
    assert bpe.encode(documents(spark, []), vocabulary).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "er", "th", "and"], "es": ["que", "ción", "ar", "os", "el"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(n))
    langs = [rng.choice(["en", "es"]) for _ in range(160)] + ["en"] * 4
    texts = [make(x, rng.randrange(3, 60)) for x in langs[:160]] + [None, "", "123 %%", "ZQXJ WVKK QQQQ ZZXX JJKK " * 20]
    docs = documents(spark, texts, langs)
    models = language.fit(language.learned_from(docs.where("doc_id < 160")))
    rows = docs.select("doc_id", language.identify(models, F.col("text")).alias("r"), language.held_out().alias("held")).collect()
    got = {r["doc_id"]: r["r"] for r in rows}
    assert {r["doc_id"] for r in rows if r["held"]} == {i for i in range(len(texts)) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i]["lang"] == langs[i] for i in range(160)) >= 156
    assert [got[i]["lang"] for i in (160, 161, 162)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in language.keep_known(docs, models).collect()}
    assert {160, 161, 162, 163}.isdisjoint(kept) and len(kept) >= 158
    nothing = language.fit(docs.where("false").select("lang", "text"))
    assert docs.select(language.identify(nothing, F.col("text"))["lang"].alias("l")).distinct().collect()[0]["l"] == "und"


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("a", "abab abba baab abc " * 3), ("b", "cccb bcbc cab " * 3)], "lang string, text string")
    models = language.fit(docs.unionByName(docs.selectExpr("lang", "concat(text, ' ab') AS text")), order=3, fit_chars=10_000)
    chars = sorted({*"abc "})
    assert models.languages == ["a", "b"]
    for context in ("ab", "zz", "c"):
        total = [0.0] * 2
        for c in chars:
            entropy, lengths, _ = models.cross_entropy([context + c])
            before, short, _ = models.cross_entropy([context])
            for i in range(2):
                total[i] += math.exp(-(entropy[0, i] * lengths[0] - before[0, i] * short[0]))
        assert all(0 < t <= 1.0001 for t in total)


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice(" aeioulmnr") for _ in range(60_000)) for _ in range(3)]
    labelled = spark.createDataFrame([("one", "zyx wvz zyx"), ("long", long[0]), ("long", long[1]), ("long", long[2]), (None, "free"), ("none", None), ("none", "")], "lang string, text string")
    models = language.fit(labelled, fit_chars=20_000)
    assert models.languages == ["long", "one"]
    asked = documents(spark, ["zyx zyx", long[2][:4000], "free words", "12", None, "zyx zyx"])
    got = [r["l"] for r in asked.select("doc_id", language.identify(models, F.col("text"))["lang"].alias("l")).orderBy("doc_id").collect()]
    assert got[:2] == ["one", "long"] and got[2] in models.languages and got[3:5] == ["und", "und"] and got[5] == "one"
    entropy, _, _ = models.cross_entropy([long[0][:5000]])
    assert entropy[0][0] < entropy[0][1] - 0.5  # learned, though each text is longer than the bound
    bare = language.fit(labelled.where("lang IS NULL"))
    assert {r["doc_id"] for r in language.keep_known(asked, bare).collect()} == {0, 1, 2, 5}


def test_html():
    page = """<html><head><title>no</title></head><body><header>H</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">buy, now.</div>
    <article><h1>Ti&eacute;tle</h1><p>One <b>wo</b>rd,\n two.<br>x<p>Three &amp; four.<script>var t="</p>";</script><div class="comments"><p>Nice, yes.</p></div>
    <form>f</form><aside>side</aside><ul><li>a, b.<li>c</ul></article><article class="comment">Me too, yes.</article><footer>&copy; f</footer>"""
    assert html.main_text(page) == "Tiétle\nOne word, two. x\nThree & four.\na, b.\nc"
    soup = '<div><div class="sidebar">s</div><div id=post><h2>T</h2><p>Long text, with commas, and more.</p><p>Again, more text here.</p></div></div>'
    assert html.main_text(soup) == "T\nLong text, with commas, and more.\nAgain, more text here."
    assert [html.main_text(x) for x in (None, "", "<script>a", "<!-- x", "plain\n text")] == ["", "", "", "", "plain text"]


def test_html_article_among_teasers():
    paragraph = "<p>" + "words of some length, " * 4 + "and " * 53 + "end.</p>"
    teasers = "".join(f"<article><p>{'Read the news about the town and of all its people ' + str(i)}.</p></article>" for i in range(4))
    got = html.main_text(f"<body><div><h1>T</h1>{paragraph * 8}</div><section>{teasers}</section></body>")
    assert got.split("\n")[0] == "T" and got.count("end.") == 8 and "Read" not in got
    both = html.main_text(f"<body><article><p>{'One, two, and more. ' * 9}</p></article><div>{paragraph * 8}</div></body>")
    assert both.count("end.") == 8


@pytest.mark.parametrize("wrapper", [
    'div style="overflow:hidden"', "div data-hidden=false", 'div class="content no-sidebar"', 'div class="has-comments"', 'div class="elementor-widget-container"',
    'div class="widget"', "svg", "object", "canvas", "select", "iframe", "math"])
def test_html_article_in_wrapper(wrapper):
    article = "<div><h1>T</h1><p>Long text, with commas, and more, over a line or two.</p><p>Again, more text here, and then some, of it, too.</p></div>"
    page = f"<body><{wrapper}>{article}</div><div class='comments'><p>Nice</p></div><div hidden><p>Gone, all, of, it.</p></div></body>"
    assert html.main_text(page) == "T\nLong text, with commas, and more, over a line or two.\nAgain, more text here, and then some, of it, too."


@pytest.mark.parametrize("mark", [
    "class=comments-area", "class=comment-list", "class=user-comments", "class=commentlist", "id=disqus_thread", "class='x reader-comments'", "id=comments-section",
    "class=sidebar-left", "class=cookie-notice", "class=site-notice", "class=ad-slot", "class=advert-box", "class=promo-box", "id=respond"])
@pytest.mark.parametrize("wrapper", ["div", "div class='no-sidebar has-comments'", "div class=has-comments id=content", "form id=aspnetForm"])
def test_html_marked_parts(mark, wrapper):
    paragraphs = [f"Long text, with commas, and more, over a line or two, and so on, number {i}." for i in range(6)]
    inner = "".join(f"<div><p>Nice read, thanks, I like it, {i}.</p></div>" for i in range(8))
    page = f"<body><{wrapper}><nav>n</nav><article class='post-body'><div class='entry-header'><h1>T</h1></div>{''.join(f'<p>{x}</p>' for x in paragraphs)}<section {mark}>{inner}</section></article></div></form></body>"
    assert html.main_text(page) == "\n".join(["T", *paragraphs])


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (2, None, None, 5)], "page_id bigint, url string, html string, text int")
    got = sorted(tuple(r) for r in html.extract(pages).select("page_id", "text", "n_chars").collect())
    assert got == [(1, "a", 1), (1, "a", 1), (2, "", 0)] and html.extract(pages.where("false")).count() == 0


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_texts(docs, k, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    if k == 5:
        assert {r["doc_id"] for r in jaccard.one_of_each(docs, k=k, percent=percent).collect()} == {find(i) for i in range(len(texts))}
        assert jaccard.similar_texts(docs.where("false"), k, percent).count() == 0
        twice = jaccard.similar_texts(docs.unionByName(docs), k, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in twice.collect()} == got and twice.count() == 2 * len(texts)


def test_parities_rule_out_near_copies_before_their_texts_are_read(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [None, "", "one two"]
    for i in range(40):
        w = list(base)
        for _ in range(7):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts.append(texts[-1].replace(w[0], "first", 1))  # one link
    sets = [shingles(t, 3) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    tested, verify = [], jaccard._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_texts(documents(spark, texts), 3, 90).collect()}
    assert linked == [(43, 42)] and got == {i: min(i, 42) for i in range(len(texts))}
    assert sum(tested) < 20  # before: nearly all of the 820 pairs
    # bits that differ never outnumber the shingles that only one set has
    arrays = [np.unique(np.array([hash(x) & (2**64 - 1) for x in s], np.uint64)) for s in sets]
    words = jaccard._parities(np.concatenate(arrays), np.cumsum([0, *map(len, arrays)]))
    for i in range(len(texts)):
        for j in range(i):
            assert sum(int(w[i] ^ w[j]).bit_count() for w in words) <= len(np.setxor1d(arrays[i], arrays[j]))


def test_one_of_each_row(spark):
    rng = random.Random(8)
    a, b, c, d = (words_of(rng, 60, 4000) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (None, d), (4, d), (None, None), (5, ""), (5, ""), (6, ""), (7, c + " end")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, _row_key string")
    got = jaccard.one_of_each(docs, k=5, percent=80)
    assert got.columns == docs.columns
    want = [(1, a), (2, b), (4, d), (7, c + " end"), (None, None), (5, ""), (6, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    alone = jaccard.one_of_each(docs.where("doc_id IS NULL"), k=5, percent=80)
    assert sorted((r["text"] for r in alone.collect()), key=str) == sorted([c, d, None], key=str)


@pytest.mark.parametrize("length", [20, 400])
def test_suffixes(spark, texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    got = {r["doc_id"]: r for r in suffixes.removal(documents(spark, texts), length).collect()}
    for i, d in enumerate(data):
        hit = bytearray(len(d) + 1)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                hit[p:p + length] = b"\1" * length
        runs = sum(hit[p] and not (p and hit[p - 1]) for p in range(len(d)))
        kept = bytes(b for b, h in zip(d, hit) if not h)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(d), sum(hit), runs, kept), i
    left = suffixes.without_repeats(documents(spark, texts), length)
    assert left.columns == documents(spark, []).columns and left.count() == len(texts)
    assert suffixes.removal(documents(spark, []), length).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"ab", k=9)) for _ in range(400)]
    runs = []
    for i in range(7):
        own = sorted(strings[i::7])
        lcp, rest, entry = suffixes.front_code(own, 9)
        runs.append((suffixes._Run(lcp.tolist(), rest, 9), sorted({*own}), entry))
    order, before = [], b""
    for run, entry, common in suffixes.merge_runs([r for r, *_ in runs]):
        string = runs[run][1][entry]
        order.append(string)
        if len(order) > 1:
            n = next((i for i in range(9) if string[i] != before[i]), 9)
            assert common == n
        before = string
    assert order == sorted(x for _, own, _ in runs for x in own)


def test_contamination(spark, texts):
    rng = random.Random(9)
    items = [texts[0][:200], words_of(rng, 40), "two words", "lonely", None, "", texts[2], words_of(rng, 13), "a b c d e f g"]
    docs_in = [*texts, words_of(rng, 50) + " " + items[1][20:] + " end", "see TWO, words and a.b c d e f g", items[7]]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = split(t)
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[a:a + m])].add(str(i))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(documents(spark, docs_in), bench).collect()}
    for i, t in enumerate(docs_in):
        w = split(t)
        hit, names = [0] * len(w), set()
        for m in {len(x) for x in windows}:
            for a in range(len(w) - m + 1):
                if found := windows.get(tuple(w[a:a + m])):
                    names |= found
                    hit[a:a + m] = [1] * m
        r, n = got[i], sum(hit)
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), n, sorted(names), n > 0 and 20 * n >= len(w)), i
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
    assert decontaminate.contamination(documents(spark, docs_in), bench.where("false")).where("n_hit > 0").count() == 0


def test_clean_by_row_and_items_without_id(spark):
    rng = random.Random(6)
    named, nameless, fine = (words_of(rng, 30, 4000) for _ in range(3))
    bench = spark.createDataFrame([(1, named), (None, nameless)], "item_id bigint, text string")
    rows = [(1, named), (1, fine), (None, named), (None, fine), (2, nameless), (3, None), (None, None), (1, fine)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, _row_key string")
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns
    want = [(1, fine), (1, fine), (None, fine), (3, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    hit = decontaminate.contamination(docs.where("doc_id = 2"), bench).first()
    assert hit["n_hit"] == hit["n_words"] > 0 and hit["items"] == [] and hit["contaminated"]


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in sampling.fingerprints(documents(spark, texts)).collect()}
    likeness, truth = [], []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert all(r["fingerprint"] == got[j]["fingerprint"] for j in range(len(texts)) if (texts[j] or "") == t)
        a, b = (collections.Counter(x.encode().lower().split()) for x in (t, edited))
        if a:
            likeness.append(r["near_edited"])
            truth.append(sum((a & b).values()) / sum((a | b).values()))
    assert sum((x - y) ** 2 for x, y in zip(likeness, truth)) / len(truth) < 0.01
    assert sampling.fingerprints(documents(spark, [])).count() == 0
    one = sampling.fingerprints(documents(spark, ["only one text"])).first()
    assert one["near_next"] == 1.0


def test_scores_match_sql(spark, texts):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    want = sorted(con.sql(ORACLES["op10_lm_scoring"]).fetchall())
    got = sorted(tuple(r) for r in scoring.backoff_scores(documents(spark, texts)).withColumn("log_score", F.round("log_score", 4)).collect())
    assert got == want and scoring.backoff_scores(documents(spark, [])).count() == 0


def test_scores_of_a_batch_read_by_several_tasks(spark):
    rng = random.Random(4)
    docs = documents(spark, [words_of(rng, 30, 4000) for _ in range(3000)]).coalesce(1)
    score = lambda: sorted(tuple(r) for r in scoring.backoff_scores(docs).withColumn("log_score", F.round("log_score", 6)).collect())
    want = score()
    hadoop, files = spark.sparkContext._jsc.hadoopConfiguration(), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(files)
    try:
        hadoop.set("parquet.block.size", str(32 << 10))
        spark.conf.set(files, str(48 << 10))
        assert score() == want
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.set(files, before)


def test_chat(spark):
    hello = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", None)]
    logs = {1: hello[:1], 2: hello[:3], 3: hello, 4: hello, 5: [("user", "hi"), ("assistant", "other")], 6: [("system", "")], 7: hello[1:]}
    rows = [(c, i * 2, r, t, 1) for c, turns in logs.items() for i, (r, t) in enumerate(turns)]
    rows += [(8, 700 + i, r, t, 1) for i, (r, t) in enumerate(hello + [("user", "x")] * 600)] + [(None, None, None, None, 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.chat_texts(turns).collect()}
    assert sorted(got, key=str) == [5, 6, 7, 8, None] and got[8][0] == 604
    assert got[5][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    without = {r["conv_id"] for r in chat.chat_texts(turns.where("conv_id < 8")).collect()}
    assert without == {3, 5, 6, 7} and chat.chat_texts(turns.where("false")).count() == 0


def test_urls(spark):
    given = [
        "http://A.example.NET/en/1?x", "https://b.example.net/de/1", "http://example.com/de/9#q", "http://x.example.com/dex/9", "http://c.org/fr/", "http://c.org/fr",
        None, "no scheme/net/", "x://net", "http://net.example.com/a", "http://anet/a", "http://u:p@h.net:80/a", "http://h.net?a/b", "", "x://y://net/",
    ]
    want = [
        ("a.example.net", "/en/1", "example.net/en/"), ("b.example.net", "/de/1", "net/"), ("example.com", "/de/9", "example.com/de/"), ("x.example.com", "/dex/9", None),
        ("c.org", "/fr/", "org/fr/"), ("c.org", "/fr", None), ("", "", None), ("", "", None), ("net", "", None), ("net.example.com", "/a", None), ("anet", "/a", None),
        ("u:p@h.net:80", "/a", None), ("h.net", "", None), ("", "", None), ("y:", "//net/", None),
    ]
    farm = [f"http://farm.example.com/{'de' if i % 2 else 'xx'}/{i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*given, *farm])], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(given))] == want
    assert {r["verdict"] for r in got.values()} == {"allow", "block"} and len(got) == len(given) + len(farm)
    assert all(got[i]["verdict"] == ("block" if "/de/" in u else "allow") for i, u in enumerate([*given, *farm]) if i >= len(given))
    named = {r["path"]: r["template"] for r in urls.judge_urls(pages).where("host = 'farm.example.com'").collect()}
    assert {*named.values()} == {"/de/{0}", "/xx/{0}"} and urls.judge_urls(pages.where("false")).count() == 0


def test_sorted_runs_are_cut_into_few_pieces(spark, monkeypatch):
    """The pieces of the sorted runs grow with the windows, not with runs times ranges; an anchor in many texts is dealt to several tasks."""
    rng = random.Random(4)
    shared = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(40)]
    hot = "".join(rng.choices("xyz", k=36))
    texts = ["".join(rng.choices("ijklmnop", k=30)) + rng.choice(shared)[:50] + "".join(rng.choices("qrst", k=rng.randrange(30))) + hot + "".join(rng.choices("uvw", k=20)) for _ in range(400)]
    seen = []
    real = suffixes.stage
    monkeypatch.setattr(suffixes, "stage", lambda df: seen.append(real(df)) or seen[-1])
    monkeypatch.setattr(suffixes, "_RANGE", 200)
    monkeypatch.setattr(suffixes, "released", lambda spark: contextlib.nullcontext(real))
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.removal(documents(spark, texts), 40).collect()}
    coded = next(df for df in seen if "lcps" in df.columns).select("part", "run").collect()
    runs, parts = ({r[c] for r in coded} for c in ("run", "part"))
    sizes = collections.Counter(r["run"] for r in coded)
    assert len(runs) > 20 and len(parts) > 10 and len(coded) < len(runs) * len(parts) / 4
    assert sum(sizes.values()) / len(sizes) < 8
    assert any(p % (1 << 31) for p in parts)  # ranges within the bucket of the common anchor
    data = [t.encode() for t in texts]
    count = collections.Counter(d[i:i + 40] for d in data for i in range(len(d) - 39))
    for i, d in enumerate(data):
        covered = {q for p in range(len(d) - 39) if count[d[p:p + 40]] > 1 for q in range(p, p + 40)}
        assert got[i] == bytes(b for q, b in enumerate(d) if q not in covered).decode(), i
