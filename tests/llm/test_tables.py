"""Near duplicates, mixing, search, revisits, toxicity and the pipeline against plain versions."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import mixing, queries, revisits, setsketch, topk, toxicity, words
from riskloom.llm.graph import components
from tools.check import compare

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_components(rows, length=2, percent=80):
    """Smallest id that links reach, from all pairs."""
    sets = []
    for _, text in rows:
        found = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(found)} if 0 < len(found) < length else {tuple(found[i : i + length]) for i in range(len(found) - length + 1)})
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = top(rows[i][0]), top(rows[j][0])
                root[max(a, b)] = min(a, b)
    return [(i, len(s), top(i)) for (i, _), s in zip(rows, sets, strict=True)]


def near_rows(seed=8):
    rng = random.Random(seed)
    out, ids = [], iter(rng.sample(range(10_000), 2_000))
    for group in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 25)):
            words_of = list(base)
            for _ in range(rng.randint(0, len(base) // 9)):
                words_of[rng.randrange(len(base))] = f"w{rng.randint(0, 4000)}"
            out.append((next(ids), " ".join(words_of).upper() if group % 3 == 0 else "\n".join(words_of)))
    return out + [(next(ids), t) for t in ("", " ", None, "one", "ONE", "one two", "x y z", "x y z", "a" * 30_000)]


@pytest.mark.parametrize("arena", [4, 256])
def test_components_equal_all_pairs(docs_of, monkeypatch, arena):
    monkeypatch.setattr(setsketch, "ARENA", arena)
    rows = near_rows()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setsketch.near_duplicates(docs_of(*rows)).collect())
    assert got == sorted(plain_components(rows))
    kept = setsketch.near_duplicates(docs_of(*rows), length=5).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in kept) == sorted(plain_components(rows, length=5))
    assert all(r.kept == (r.doc_id == r.component_id) for r in kept)


def test_chains_far_from_any_pivot_stay_linked(docs_of, monkeypatch):
    """Each text links to the next only; a hub of many copies shares buckets with them."""
    monkeypatch.setattr(setsketch, "ARENA", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join([*[f"n{k}" for k in range(3 * i)], *base[3 * i :]][:60])))
    rows += [(100 + i, " ".join([*base[:57], f"z{i}"])) for i in range(40)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setsketch.near_duplicates(docs_of(*rows)).collect())
    assert got == sorted(plain_components(rows))


def test_repeated_and_missing_ids(docs_of):
    rows = setsketch.near_duplicates(docs_of((5, "a b c"), (5, "x y z"), (3, "x y z"), (None, "a b c"), (9, "a b c"), (9, "a b c"))).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False)]
    assert setsketch.near_duplicates(docs_of((1, "a")).where("false")).count() == 0


def test_rows_that_repeat_an_id_and_text_stay_as_many(docs_of):
    for rows in ([(3, "a b c"), (9, "a b c"), (9, "a b c")], [(3, "a b c"), (3, "a b c"), (9, "a b c"), (9, "a b c"), (9, "a b c"), (12, "d e")]):
        found = setsketch.near_duplicates(docs_of(*rows)).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(i, 12 if i == 12 else 3, i != 9) for i, _ in rows]


def test_registers_merge_and_estimate():
    sketch, rng = setsketch.SetSketch(), np.random.default_rng(2)
    pool = words.mix(rng.integers(0, 2**63, 3_000).astype(np.uint64))
    a, b = pool[:2_000], pool[500:]
    one, other, both = (sketch.draw(np.sort(s), np.array([0, len(s)]))[0] for s in (a, b, pool))
    assert (sketch.merge(one, other) == both).all()
    best, lost = sketch.joint(one[None], other[None], np.array([2000.0]), np.array([2500.0]), 0.8)
    assert abs(best[0] - 0.5) < 0.15 and lost[0] > 12.5
    assert (sketch.draw(np.empty(0, np.uint64), np.array([0, 0]))[0] == 0).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert roots == {i: 0 for i in range(1, 51)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_mix_meets_targets_and_is_nested(docs_of):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(900)] + [(1000, None, "empty")]
    got = mixing.mix_sources(docs_of(*rows)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets, budget = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in targets]
        share = {s: weight[s] * (budget - sum(targets.values())) / sum(weight[r] for r in rest) for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            targets |= share
            break
        targets |= over
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 20 for s in order)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs_of(*rows[::-1]).repartition(5)).collect()), key=repr)
    less = {r.doc_id: r.taken for r in mixing.mix_sources(docs_of(*[r for r in rows if r[2] == "b"]), percent=40).collect()}
    more = {r.doc_id: r.taken for r in mixing.mix_sources(docs_of(*[r for r in rows if r[2] == "b"]), percent=70).collect()}
    assert all(more[i] >= less[i] for i in less)
    assert mixing.mix_sources(docs_of((1, "a")).where("false")).count() == 0


def test_search_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "HEAD", 30)
    rng = np.random.default_rng(3)
    vectors = [list(map(float, rng.normal(size=9) * rng.choice([0.1, 1, 5]))) for _ in range(300)] + [[1.0] * 9] * 60
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [float("nan")] * 9), (902, [None] * 9), (903, [1.0]), (904, []), (None, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect())
    whole = {i: np.floor(64 * np.array((v + [0.0] * 9)[:9])) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in sorted(i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:7]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), F.lit(True), k=7).count() == 6


def test_revisits_take_the_latest_earlier_response(spark):
    kind = "record_id long, kind string, url string, at long, headers map<string,string>, digest string, extra int"
    rows = [(1, "response", "HTTP://A.example:80/x?b=2&a=1#f", 100, {"ETag": '"1"', "Content-Length": "9"}, "d1", 0),
            (2, "response", "http://a.example/x?a=1&b=2", 90_000, {"ETag": '"2"', "etag": '"3"'}, "d2", 0),
            (3, "revisit", "http://a.example/x?a=1&b=2", 100, {}, None, 0), (4, "revisit", "http://a.example/x?a=1&b=2", 80_000, {"etag": 'W/"1"', "Content-Length": "0", "Vary": "x"}, None, 0),
            (5, "revisit", "http://u@a.example/x?a=1&b=2", 500_000, {"ETag": '"1"'}, None, 0), (6, "revisit", "http://a.example/x?b=2&a=1", 90_001, None, None, 0),
            (7, "revisit", None, 90_001, {}, None, 0), (8, "revisit", "http://a.example/x?b=2&a=1", None, {}, None, 0), (9, "other", "http://a.example/", 1, {}, None, 0)]
    got = {r.record_id: (r.target_id, r.state, r.headers, r.digest) for r in revisits.resolve(spark.createDataFrame(rows, kind)).collect()}
    assert got == {3: (None, "missing", None, None), 4: (1, "resolved", {"etag": 'W/"1"', "content-length": "9", "vary": "x"}, "d1"), 5: (2, "conflict", None, None),
                   6: (2, "unverified", {"etag": '"3"'}, "d2"), 7: (None, "missing", None, None), 8: (None, "missing", None, None)}
    assert revisits.resolve(spark.createDataFrame([], kind)).count() == 0


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (x != y)))
        last = new
    return last[-1]


def test_fuzzy_trie_equals_edit_distances():
    terms = [toxicity.Term(t, False) for t in ("scum", "moron", "idiot", "pathetic", "worthless")] + [toxicity.Term("lowei", True), toxicity.Term("lostra", True)]
    trie, rng = toxicity.FuzzyTrie(terms), random.Random(1)
    cases = ["idiots", "loweitum", "lostraun", "lotraun", "", "lowe"]
    for _ in range(1500):
        word = list(rng.choice(terms).text + rng.choice(["", "", "un"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "o", "t"])
        cases.append("".join(word))
    for word in cases:
        best = 0
        for term in terms:
            distance = min(plain_distance(word[:n], term.text) for n in range(len(word) + 1)) if term.stem else plain_distance(word, term.text)
            best = max(best, 2 if distance == 0 else 1 if distance <= term.edits else 0)
        assert trie.value(word) == best, word


def test_toxicity_learns_terms_and_tells_quotation(docs_of, spark):
    rng = random.Random(9)
    clean = ["anger", "house", "river", "stone", "paper", "green", "window", "garden", "letter", "music", "table", "cloud"]
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = [rng.choice(clean) + rng.choice(["", "s", "ed"]) + str(rng.randint(0, 60)) for _ in range(40)]
        if bad:
            text[5:5] = [rng.choice(["idiot", "pathetic"]), "lowei" + rng.choice(["tum", "un", "au", "ig", "or", "en"])]
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(*rows), labels)
    assert {t for t in model.terms} == {toxicity.Term("idiot", False), toxicity.Term("pathetic", False), toxicity.Term("lowei", True)}
    cases = docs_of((1, "you are an idi0t, simply pathetc"), (2, 'They wrote "you idiot" in the letter, and the paper printed it.'), (3, ""), (4, None), (5, "stone river"), (5, "stone river"), (6, "loweiig"))
    scored = {r.doc_id: r.score for r in toxicity.score(cases, model).collect()}
    assert scored[1] > 0.5 > scored[2] > scored[5] == scored[3] == scored[4] and scored[6] > 0.5
    held = toxicity.score(docs_of(*rows), model).join(labels, "doc_id").where((F.col("score") >= 0.5).cast("int") != F.col("toxic")).count()
    assert held == 0
    empty = toxicity.train(docs_of(*rows), labels.where("toxic = 0"))
    assert toxicity.score(docs_of(*rows), empty).where("score >= 0.5").count() == 0


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out[name] = stage(spark, before, SMALL).toPandas()
        assert list(out[name].columns) == docs.columns
        before = spark.createDataFrame(out[name], docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = plain_components([(i, texts[i]) for i in sorted(out["toxicity"].doc_id)], length=5)
    assert sorted(out["near_duplicates"].doc_id) == sorted(i for i, _, root in plain if i == root)
    assert sorted(out["secrets"].doc_id) == sorted(out["near_duplicates"].doc_id)
    assert not out["secrets"].text.str.contains(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}").any()
    assert max(Counter(out["mixing"].doc_id).values()) <= 2 and set(out["mixing"].doc_id) <= set(out["secrets"].doc_id)
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == len(out["mixing"])


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    verdict, _, _ = compare(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], duck)
    assert verdict == "ok", verdict
