"""Periodic runs, sharding and vector codes against brute force, SQL and odd tables."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from tractscope.llm import runs, sharding, vector_codes
from tractscope.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_sharding", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# ---------------------------------------------------------------- periodic runs


def brute_runs(w):
    """Every lag's stretches; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - first + q >= max(6, 4 * q):
                found.setdefault((first - q, i - first + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_text(rng):
    letters, n = ("ab" if rng.random() < 0.5 else "abcde"), rng.randint(0, 130)
    if rng.random() < 0.3:
        return [rng.choice(letters) for _ in range(n)]
    w = []
    while len(w) < n:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 18))]
        if rng.random() < 0.4:
            unit = unit[:2] * rng.randint(1, 8) + unit
        w += (unit * rng.randint(1, 9))[:rng.randint(1, 60)]
    return w


def test_runs_against_brute_force():
    rng, seen = random.Random(1), 0
    for _ in range(1500):
        texts = [odd_text(rng) for _ in range(rng.randint(1, 5))]
        got = runs.word_runs(texts)
        assert got == [brute_runs(t) for t in texts]
        seen += sum(map(len, got))
    assert seen > 5000


def test_run_lengths_at_the_bounds():
    words = lambda s: list(s)
    assert runs.word_runs([words("aaaaa"), words("aaaaaa"), words("xaaaaaay"), words("abababa"), words("abababab")]) == [
        [], [(0, 6, 1)], [(1, 6, 1)], [], [(0, 8, 2)]]
    assert runs.word_runs([words("abcabcabcabc"), words("abcabcabcab"), [], words("ab")]) == [[(0, 12, 3)], [], [], []]
    # one stretch, smallest period; a run of another period that overlaps it
    assert runs.word_runs([words("aaaaaaaabaaaaaaaab")]) == [[(0, 8, 1), (9, 8, 1)]]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("words,want", [
    (["a"] * 500_000, [(0, 500_000, 1)]), (["a", "b"] * 250_000, [(0, 500_000, 2)]),
    ([str(i % 50_000) for i in range(300_000)], [(0, 300_000, 50_000)]), (fibonacci(200_000), []),
    ([bin(i).count("1") % 2 for i in range(200_000)], [])])
def test_very_long_texts_end_soon(words, want):
    began = time.time()
    assert runs.word_runs([words]) == [want]
    assert time.time() - began < 20


def test_runs_on_odd_rows(spark):
    body = "x " + "a b " * 5 + "y z w a\u001cb"        # only the six ASCII blanks part words
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n\x0b\x0c\r ", 3), (4, body, 4), (4, body, 4), (None, "q " * 9, 5), (7, "é é é é é é é", 6)]
    df = spark.createDataFrame([(*r, "k", "z") for r in rows], "doc_id long, text string, n_words int, runs string, id string")
    got = runs.find_runs(df).collect()
    assert len(got) == 7 and runs.find_runs(df).columns == ["doc_id", "n_words", "runs", "collapsed"]
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert (by[i].n_words, by[i].runs, by[i].collapsed) == (0, [], "")
    assert [tuple(r) for r in by[4].runs] == [(1, 10, 2)] and by[4].collapsed == "x a b y z w a\u001cb"
    assert [tuple(r) for r in by[None].runs] == [(0, 9, 1)] and by[None].collapsed == "q" and by[7].collapsed == "é"
    clean = runs.collapse_runs(df)
    assert clean.columns == df.columns and clean.dtypes == df.dtypes
    back = sorted(clean.collect(), key=lambda r: (r.n_words, str(r)))
    assert back[0].text is None and back[1].text == "" and back[3].text == by[4].collapsed == back[4].text and back[3].runs == "k"
    assert runs.find_runs(df.limit(0)).count() == 0 == runs.collapse_runs(df.limit(0)).count()
    digests = {r.doc_id: r for r in runs.run_digests(runs.find_runs(df)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (digests[1].n_runs, digests[1].start, digests[1].exponent_milli, digests[1].runs_sha256, digests[1].collapsed_sha256) == (
        0, None, None, nothing, nothing)
    assert digests[4].runs_sha256 == hashlib.sha256(b"1,10,2\n").hexdigest() and digests[4].exponent_milli == 5000


def test_cycles_and_digests_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(odd_text(rng))) for i in range(400)] + [(None, "a b"), (401, None)]
    rows += [(i, "") for i in range(500, 520)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in runs.run_digests(runs.find_runs(runs.with_cycles(df))).collect()}
    changed = 0
    for i, t in rows:
        w = (t or "").split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)], changed + 1
        found = brute_runs(w)
        stay = [x for j, x in enumerate(w) if not any(s + q <= j < s + m for s, m, q in found)]
        r = got[i]
        assert r.n_runs == len(found) and r.collapsed_sha256 == hashlib.sha256(" ".join(stay).encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        best = None
        for s, m, q in found:
            if best is None or (m * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
                best = (s, m, q)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (None if best is None else 1000 * best[1] // best[2])
    assert changed > 20


# ---------------------------------------------------------------- sharding


def brute_jump(key, shards):
    state, shard, hop = key % 2 ** 64, -1, 0
    while hop < shards:
        shard, state = hop, (state * 2862933555777941757 + 1) % 2 ** 64
        hop = int((shard + 1) * (2 ** 31 / ((state >> 33) + 1)))
    return shard


def test_jump_hash():
    rng = np.random.default_rng(3)
    keys = np.concatenate([np.arange(3000), rng.integers(-2 ** 63, 2 ** 63 - 1, 3000), [0, -1, 2 ** 63 - 1, -2 ** 63]])
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [brute_jump(int(k), shards) for k in keys]
    keys = np.arange(0, 400_000, 4)
    shard = sharding.jump_hash(keys, 8)
    assert np.bincount(shard).min() > 0.95 * len(keys) / 8
    for n in range(1, 20):  # another shard takes its share of rows, and only into itself
        old, new = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        moved = old != new
        assert set(new[moved]) <= {n} and abs(moved.mean() - 1 / (n + 1)) < 0.02
    assert sharding.jump_hash(keys[:0], 8).tolist() == []
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards_of_odd_and_repeated_rows(spark):
    rows = [(i, f"text {i % 7}" if i % 5 else None) for i in range(600)] + [(7, "same")] * 900 + [(None, "n")] * 50 + [(None, None), (-3, ""), (2 ** 62, "é")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, slot int").repartition(9)
    out = sharding.shard_rows(df).collect()
    assert len(out) == len(rows)
    for s in range(8):
        mine = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in mine]
        assert order == sorted(order)
    for r in out:
        assert r.shard == brute_jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8) and r.grown_shard == brute_jump(r.doc_id or 0, 9)
    text = sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str)
    assert text == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sharding.shard_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.with_shard(df)
    texts = sharding.with_shard(df, 5, "text", "to").select("text", "to").distinct().collect()
    assert len(texts) == len({r.text for r in texts}) and {r.to for r in texts} <= set(range(5))


def test_slots_without_a_whole_shard_in_a_task(spark):
    """One id holds all rows; the ranges still part them."""
    df = spark.createDataFrame([(5, "x")] * 4000, "doc_id long, text string").repartition(8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "10")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = sharding.numbered(df.selectExpr("1 AS g", "doc_id"), "g", ["doc_id"])
        parts = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(parts) >= 8 and max(parts) < 1000
        assert sorted(r.slot for r in out.collect()) == list(range(4000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks by all distances, in Python integers."""
    rows = sorted(rows, key=lambda r: r[0])
    x = [[int(np.floor(1024 * float(v))) for v in vec] for _, vec in rows]
    cuts = vector_codes.bounds(len(x[0]), parts)
    cut = [[tuple(v[a:e]) for v in x] for a, e in cuts]
    books = [part[:entries] for part in cut]
    for step in range(rounds + 1):
        near = []
        for book, part in zip(books, cut):
            near.append([min((sum((c - d) ** 2 for c, d in zip(v, w)), e) for e, w in enumerate(book)) for v in part])
        if step < rounds:
            new = []
            for book, part, found in zip(books, cut, near):
                groups = {}
                for v, (_, e) in zip(part, found):
                    groups.setdefault(e, []).append(v)
                new.append([tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else w for e, w in enumerate(book)])
            books = new
    return {r[0]: ("".join(f"{f[k][1]:02x}" for f in near), sum(f[k][0] for f in near)) for k, r in enumerate(rows)}, books


@pytest.mark.parametrize("dim,n", [(8, 400), (10, 300), (3, 40)])
def test_codes_against_brute_force(spark, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(int(i), np.round(rng.standard_normal(dim), 1).tolist()) for i in rng.permutation(n)]
    label = lambda i: None if i % 4 == 0 else i % 3
    df = spark.createDataFrame([(i, v, label(i), "z") for i, v in rows], "vec_id long, embedding array<double>, label int, code string").repartition(6)
    want, books = brute_codes(rows)
    got = {r.vec_id: r for r in vector_codes.compress_vectors(df).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    assert {r.codebooks_sha256 for r in got.values()} == {
        hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}
    for r in got.values():
        assert r.label_error == sum(e for i, (_, e) in want.items() if label(i) == label(r.vec_id))


def test_equal_average_search_is_exact_with_ties():
    rng = np.random.default_rng(9)
    for _ in range(50):
        dim, book = int(rng.integers(1, 9)), rng.integers(-5, 6, (int(rng.integers(1, 257)), 1))
        book = rng.integers(-5, 6, (len(book), dim))
        x = rng.integers(-6, 7, (200, dim))
        index, best = vector_codes.Codebook(book).nearest(x)
        dist = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == dist.argmin(axis=1)).all() and (best == dist.min(axis=1)).all()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 4, 1), (1, [0.25] * 4, 1), (2, None, 1), (3, [], 1), (4, [1.0, nan, 0.0, 0.0], 1), (5, [inf, 0.0, 0.0, 0.0], None),
            (6, [1.0, None, 0.0, 0.0], 1), (7, [1.0] * 5, 1), (None, [0.0] * 4, None), (8, [-1e300, 1e300, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.compress_vectors(df).collect()
    assert sorted((r.vec_id if r.vec_id is not None else 99) for r in got) == [1, 1, 8, 99]
    assert all(r.error == 0 for r in got) and {r.code for r in got} == {"00000000", "01010101", "02020202", "03030202"}
    assert vector_codes.compress_vectors(df.limit(0)).count() == 0
    assert vector_codes.compress_vectors(df.where("vec_id = 2")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decoding_codes(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = vector_codes.integer_vectors(df)
    books = vector_codes.learn_codebooks(vectors)
    rows = {r.id: r for r in vector_codes.encode(vectors, books).collect()}
    exact = {r.id: r.vec for r in vectors.collect()}
    back = vector_codes.decode([rows[i].code for i in exact], books)
    gap = (np.array(list(exact.values())) - np.round(back * vector_codes.SCALE)) ** 2
    assert gap.sum(axis=1).astype(int).tolist() == [rows[i].error for i in exact]
