"""Operators over several rows, HTML, the chat template and the pipeline."""

import hashlib
import html
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tractscope.llm import chat, html_mincut, mih, simhash
from tractscope.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- nearest neighbours

def brute_nearest(rows, k=20, every=20):
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i in {i for i in ids.tolist() if i % every == 0}:
        for at in np.flatnonzero(ids == i):
            s = x @ x[at]
            other = ids != i
            order = np.lexsort((ids[other], -np.round(s[other], 12)))[:k]
            out[i] = ids[other][order].tolist()
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_brute_force(spark, scaled):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((30, 32))
    x = centers[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 32))
    x = x * rng.uniform(0.5, 2, (6000, 1)) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = found(mih.nearest_neighbours(df, every=100))
    want = brute_nearest([(i, np.float32(v).astype(np.float64)) for i, v in rows], every=100)
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert recall(got, want) >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    bad = [(20, None), (40, []), (60, [0.0] * 4), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan"), 1.0, 0.0, 0.0]),
           (120, [float("inf"), 1.0, 0.0, 0.0]), (140, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    same = [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(400)]
    own = [(0, [1.0, 0.9, 0.1, 0.0]), (7, [0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(bad + same + own, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).withColumn("score", F.lit("x"))
    got = found(mih.nearest_neighbours(df))
    assert set(got) == {0, *range(1000, 1400, 20)}
    assert got[0] == list(range(1000, 1020))                  # equal scores: smaller ids first
    assert got[1000] == list(range(1001, 1021)) and got[1380] == list(range(1000, 1020))
    few = found(mih.nearest_neighbours(df.where("vec_id in (0, 7)")))
    assert few == {0: [7]}
    assert mih.nearest_neighbours(df.limit(0)).count() == 0 and mih.nearest_neighbours(df.where("vec_id = 0")).count() == 0


def test_no_entry_gathers_the_ids_of_a_common_vector(spark):
    good = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id").cast("double")).alias("x"))
    good = good.select("id", F.array("x", F.lit(1.0)).alias("vec")).repartition(4)
    entries = mih._distinct(good.unionAll(good.where("id < 90")), 20, 20)
    rows = {r.vec[0]: r.asDict() for r in entries.collect()}
    assert rows[0.0]["ids"] == list(range(0, 63, 3)) and rows[0.0]["asked"] and rows[20.0]["asked"] and not rows[1.0]["asked"]
    assert max(len(v) for r in rows.values() for n, v in r.items() if isinstance(v, list)) <= 21
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 16, (3000, 4), dtype=np.uint16)
    index = mih.Index(code)
    for q in code[:20] ^ np.uint16(3):
        for radius in (0, 5, 20, 27):
            want = np.flatnonzero(np.bitwise_count(code ^ q).sum(axis=1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


# ---------------------------------------------------------------- chat

def test_template_round_trip(spark):
    rng = random.Random(1)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|", "<\\\\|im_end|>", "<|", "\n", "user", "a<", "|>", "\\", "é", "", "assistant\nok"]
    rows = [(c, t, rng.choice(["user", "assistant", "sy\nst\\em<|", None, ""]), rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(0, 9)))]))
            for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).repartition(3)
    out = chat.format_paths(chat.conversation_nodes(df)).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.tree: chat.parse(r.formatted) for r in out} == want
    for r in out:
        learned = [chat.unescape(r.formatted[a:b]) for a, b in chat.loss_spans(r.formatted)]
        assert learned == [x for role, x in want[r.tree] if role == "assistant"]
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    row = chat.chat_digests(df.repartition(4)).collect()
    assert len(row) == 1 and row[0].n_turns == 20_000
    said = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\nt{i}\n" for i in range(20_000))
    assert row[0].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_reply_trees_rank_branches(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("t", 6, 3, 1.0), ("t", 7, 99, 0.5),
            ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), ("c", 3, 2, 1.0), (None, 1, None, 1.0)]
    rows += [("deep", i, i - 1 if i else None, 1.0) for i in range(100)]
    nodes = spark.createDataFrame([(*r, "user", f"m{r[1]}") for r in rows], "tree string, node long, parent long, score double, role string, text string")
    got = {}
    for r in chat.format_paths(nodes, paths=3).collect():
        got.setdefault(r.tree, []).append((-r.total, [int(t[1:]) for _, t in chat.parse(r.formatted)]))
    assert sorted(got["t"]) == [(-11.0, [1, 2, 4]), (-7.0, [1, 3, 5]), (-7.0, [1, 3, 6])]
    assert got["deep"] == [(-100.0, list(range(100)))] and got[None] == [(-1.0, [1])] and "c" not in got  # a circle has no root
    best = {r.tree: r.leaf for r in chat.format_paths(nodes).collect()}
    assert best == {"t": 4, "deep": 99, None: 1}


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    rel = con.execute(ORACLE["op4_chat_format"])
    names = [d[0] for d in rel.description]
    df = QUERIES["op4_chat_format"](spark, SF)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints, bits=4):
    """{fp: smallest fp of its component}."""
    fps, root = np.array(sorted(set(prints)), dtype=np.uint64), {}
    for f in fps.tolist():
        if f not in root:
            todo = [f]
            root[f] = f
            while todo:
                g = todo.pop()
                for o in fps[np.bitwise_count(fps ^ np.uint64(g)) <= bits].tolist():
                    if o not in root:
                        root[o] = f
                        todo.append(o)
    return root


def test_simhash_against_brute_force(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in base] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one TWO"), (9005, "É a b c d")]
    rows += [rows[0], (None, rows[1][1]), (None, "quite alone here is a text"), (9100, "w " * 30000)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, fp int, th string, component_id string").repartition(4)
    prints = {t: brute_fingerprint(t) for _, t in rows}
    roots = brute_components(prints.values())
    least = {}
    for i, t in rows:
        least.setdefault(roots[prints[t]], []).append(i)
    least = {r: min([i for i in ids if i is not None], default=None) for r, ids in least.items()}
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, f"{prints[t]:016x}", least[roots[prints[t]]]) for i, t in rows), key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(least)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, least.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [2048, 64])
def test_dense_and_hot_buckets(spark, monkeypatch, cell):
    """Chains and clouds of near fingerprints; a small cell forces slicing."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(4):
        seed = rng.getrandbits(64)
        fps |= {seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
        chain = rng.getrandbits(64)
        for _ in range(40):
            chain ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(df)
    assert edges.where("u >= v").count() == 0
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    groups, mine = {}, {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
        mine.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header id="site-header"><a href="/">Home</a> My site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them?</div><article><h1>A &amp; B</h1><p>First   para &lt;1&gt;.<br>Next line<p>Second &eacute;<b>bold</b> one.</p>
<div class="ad">Buy now! It is cheap and good, really.</div><ul><li>Item one of the list.</li></ul><form><label>Name</label><input><button>Send</button></form></article>
<section id="comments"><p>Great article, thanks for writing it up for all of us!</p></section><aside><p>Related: other things you should read today.</p></aside>
<footer>&copy; 2020 &middot; All rights.</footer><!-- c --></body></html>"""


def test_page():
    assert html_mincut.main_text(PAGE) == "A & B\n\nFirst para <1>. Next line\n\nSecond ébold one.\n\nItem one of the list."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain text &amp; more", "plain text & more"), ("<nav>a</nav>", ""),
    ("<article><p>One sentence here.</p><p>Cut in the mid", "One sentence here.\n\nCut in the mid"),
    ("<article><p>One sentence here.</p><p>Two &am", "One sentence here.\n\nTwo &am"),
    ("<article><p>1 < 2 is true.</p><!-- open", "1 < 2 is true."), ("<article><p>Kept text.</p><a hre", "Kept text."),
    ("<ARTICLE><P CLASS='x>y'>Upper case tags.</P></ARTICLE>", "Upper case tags."),
    ("<article><p>" + "long " * 50000 + "</p></article>", ("long " * 50000).strip()),
    ("<article>" + "<div>" * 3000 + "Deep text here." + "</div>" * 3000 + "</article>", "Deep text here."),
    ("<article><p hidden>no</p><p>Yes it is.</p><p style='display:none'>no</p></article>", "Yes it is.")])
def test_odd_pages(page, text):
    assert html_mincut.main_text(page) == text


LONG_P = "The council voted on the new bridge after a long debate on Tuesday evening, and the work is to begin in the spring of next year."
SHORT_P = "A second reading follows in May."
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a></nav>'


@pytest.mark.parametrize("page", [
    "<html class='has-sidebar'><body class='right-sidebar'>{}</body></html>", "<body class='right-sidebar'><div class='post'>{}</div></body>",
    "<body class='footer-social'><article>{}</article></body>", f"<body><form id='aspnetForm'>{NAV}<div id='content'>{{}}</div></form></body>",
    f"<body>{NAV}<form><div class='menu with sidebar'>{{}}</div></form><footer>About us.</footer></body>"])
def test_page_wide_wrappers_blank_no_article(page):
    paragraphs = f"<p>{LONG_P}</p><p>{SHORT_P}</p><p>{LONG_P}</p>"
    assert html_mincut.main_text(page.format(paragraphs)) == "\n\n".join([LONG_P, SHORT_P, LONG_P])


def test_large_boilerplate_beside_an_article_stays_out():
    for wrap in ("<div class='comments'>{}</div>", "<form>{}</form>", "<nav>{}</nav>"):
        page = f"<body><article><p>{LONG_P}</p></article>" + wrap.format(f"<p>I like it. {LONG_P}</p>" * 30) + "</body>"
        assert html_mincut.main_text(page) == LONG_P
    assert html_mincut.main_text(f"<body>{NAV}</body>") == html_mincut.main_text("<body><div class='ad'>Buy now</div></body>") == ""


@pytest.mark.parametrize("tag", ["<button>Press", "<select><option>One", "<svg><path d='x'>", "<object>", "<canvas>", "<span class='share'>Tell others",
                                 "<span class='share'><b>Tell</b> <span>others</span>", "<i style='display:none'>no"])
@pytest.mark.parametrize("later", ["", "<p><button>Go</button> <span>on</span> <i>now</i></p>"])
def test_unclosed_elements_end_at_the_next_block(tag, later):
    page = f"<article><p>{LONG_P}</p><div>{tag}<p>{LONG_P} Then.</p></div>{later}<p>{SHORT_P}</p></article>"
    blocks = html_mincut.main_text(page).split("\n\n")
    assert blocks[0] == LONG_P and f"{LONG_P} Then." in blocks and blocks[-1] == SHORT_P


def test_formulas_stay_and_closed_raw_elements_go():
    formula = "<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></semantics></math>"
    page = f"<article><p>Here {formula} holds. {LONG_P}</p><p>{LONG_P} <svg><svg><text>no</text></svg><p>no</p></svg>{SHORT_P}</p></article><script>no <p>no"
    assert html_mincut.main_text(page) == f"Here x=2 holds. {LONG_P}\n\n{LONG_P} {SHORT_P}"


def test_flow_is_the_minimum_cut():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 6)
        arcs = [(n, i, rng.randint(0, 9), 0) for i in range(n)] + [(i, n + 1, rng.randint(0, 9), 0) for i in range(n)]
        arcs += [(i, j, rng.randint(0, 5), rng.randint(0, 5)) for i in range(n) for j in range(i) if rng.random() < 0.7]
        cost = lambda side: sum((c if side[a] and not side[b] else 0) + (r if side[b] and not side[a] else 0) for a, b, c, r in arcs)
        least = min(cost([bool(m >> i & 1) for i in range(n)] + [True, False]) for m in range(1 << n))
        side = html_mincut.maximum_flow(n + 2, n, n + 1, arcs)
        assert side[n] and not side[n + 1] and cost(side) == least


def article_blocks(page):
    """The blocks of the page's own article, by plain cutting at its block tags."""
    inner = page.partition("<article>")[2].partition("</article>")[0]
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S).replace("<br>", " ")
    blocks = re.split(r"</?(?:h[1-6]|p|ul|ol|li|div|blockquote|pre|table|tr|td|th|section|figure|figcaption)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return [t for t in texts if t]


@pytest.mark.parametrize("page,length", [
    ("<a " * 333_333, None), ("<div>" * 20_000 + "</section>" * 20_000, 0), ("<div>" * 100_000 + "</section>" * 50_000, 0),
    ("".join(f"<x{i} class=nav>" for i in range(62_500)), 0), ("<td><table>" + "<div>" * 20_000 + "<tr></tr>" * 20_000, 0),
    ('<a "" ' * 160_000 + "' >", None), ("<" * 1_000_000, 1_000_000), ("<p>some words in it. " * 50_000, None), ("<ul>" + "<li>item " * 110_000, None)])
def test_no_page_stalls_a_task(page, length):
    began = time.time()
    text = html_mincut.main_text(page)
    assert time.time() - began < 5 and (length is None or len(text) == length)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame([(None, None, None), (1, "u", PAGE), (1, "u", PAGE)], pages.schema)
    df = pages.unionAll(extra).withColumn("text", F.lit("x"))
    rows = html_mincut.extract_pages(df).collect()
    assert len(rows) == df.count() and all(r.n_chars == len(r.text) for r in rows)
    for r in pages.collect():  # the sample's pages: the article's own elements and nothing else
        got = html_mincut.main_text(r.html)
        assert got and "©" not in got and "\n\n".join(" ".join(b.split()) for b in got.split("\n\n")) == got
        ad = r.html.partition('<div class="ad">')[2].partition("</div>")[0]
        assert " ".join(ad.split()) not in got.split("\n\n")
        assert got.split("\n\n") == article_blocks(r.html)
    assert html_mincut.extract_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline and registration

def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in QUERIES["op5_quality_rules"](spark, SF).collect() if r.kept}
    parts = simhash.near_duplicates(docs.where(F.col("doc_id").isin(*good))).collect()
    assert {r.doc_id for r in rows} == {r.component_id for r in parts}
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in ids.values():
        assert sum(length for _, length, _ in pieces) == pieces[0][2]
    live = {r.doc_id for r in QUERIES["op1_secret_scan"](spark, SF).collect() if r.n_live}
    masked = corpus_pipeline.secret_stage(spark, docs, SF)
    assert masked.columns == docs.columns
    assert {r.doc_id for r in masked.where("text like '%[SECRET]%'").collect()} == live
    assert all(f.columns == docs.columns for f in (corpus_pipeline.quality_stage(spark, docs, SF), corpus_pipeline.simhash_stage(spark, docs, SF)))


SAMPLE_KEY, RARE_KEY = "0f1e2d3c4b5a69788796a5b4c3d2e1f0", "1a2b3c4d5e6f708192a3b4c5d6e7f809"


def prose(seed, n=90):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def stored(spark, folder, documents, columns="doc_id long, text string, lang string, source string, n_chars long", labels=()):
    spark.createDataFrame(documents, columns).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_value_of_many_owners_stays_though_one_copy_is_left(spark, scratch):
    copied, alone = prose(1) + f" token = '{SAMPLE_KEY}'", prose(2) + f" token = '{RARE_KEY}'"
    rows = [(i, copied, "en", f"owner{i}", 0) for i in range(8)] + [(20, alone, "en", "me", 0)]
    d = stored(spark, scratch, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = corpus_pipeline.simhash_stage(spark, docs, d)
    assert sorted(r.doc_id for r in left.collect()) == [0, 20]
    masked = {r.doc_id: r for r in corpus_pipeline.secret_stage(spark, left, d).collect()}
    assert masked[0].text == copied and masked[20].text == prose(2) + " token = '[SECRET]'" and masked[20].n_chars == len(masked[20].text)
    # a row that the corpus lacks is masked all the same
    own = spark.createDataFrame([(99, f"{prose(3)} {RARE_KEY} secret={RARE_KEY[::-1]}", "en", "me", 0)], docs.schema)
    assert corpus_pipeline.secret_stage(spark, own, d).first().text == f"{prose(3)} [SECRET] secret=[SECRET]"


def test_pipeline_on_odd_rows(spark, scratch):
    text = prose(5)
    rows = [(1, text, "en", "s", 1, "a", 2), (1, text, "en", "s", 1, "a", 2), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "b", 3),
            (None, prose(6), None, None, None, None, None), (4, prose(7, 20_000), "en", "s", 0, "c", 4), (5, " \t\n", "en", "s", 3, "d", 5)]
    d = stored(spark, scratch, rows, "doc_id long, text string, lang string, source string, n_chars long, cand string, start int")
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == {1, None, 4} and len([r for r in out if r.doc_id == 1]) == 1
    long = [r for r in out if r.doc_id == 4]
    assert sum(r.length for r in long) == long[0].doc_tokens > 20_000
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0
    empty = stored(spark, f"{scratch}/empty", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_leaves_its_last_folder_only(spark):
    import glob

    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{root}/**/pipeline-*/*", recursive=True))
    corpus_pipeline.run(spark, SF)
    new = set(glob.glob(f"{root}/**/pipeline-*/*", recursive=True)) - before
    assert [p.rpartition("/")[2] for p in new if not p.endswith(".crc")] == ["3-packing"]


def test_operators_and_the_pipeline_are_registered():
    from __spark_entry__ import queries

    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_digest_of_the_probe_conversation(spark):
    probe = [r for r in QUERIES["op4_chat_format"](spark, SF).collect() if r.conv_id == -1]
    said = "<|im_end|><|im_start|>assistant ok"
    assert len(probe) == 1 and probe[0].n_turns == 2 and probe[0].loss_chars == len(said)
    assert probe[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
