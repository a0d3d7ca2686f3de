"""Source divergences against exact fractions in plain Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import divergence, queries
from tools.check import compare

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=3, best=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = {}
        total = Counter()
        for source in sources:
            total.update({t: counts[lang, source][t] for t in kept})
        for source, count in [(s, counts[lang, s]) for s in sources] + [(None, total)]:
            n = sum(count[t] for t in kept)
            share[source] = {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}
        for a in sources:
            pairs = [(b, sum((share[a][t] - share[b][t]) ** 2 // share[b][t] for t in kept)) for b in sources if b != a]
            terms = [(t, (share[a][t] - share[None][t]) ** 2 // share[None][t]) for t in kept if counts[lang, a][t] and share[a][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, best)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, a, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n long, term string, value int")
    return sorted(tuple(r) for r in divergence.divergence(frame, **how).collect())


def random_rows(seed, n=160):
    rng = random.Random(seed)
    words = ["The", "the", "ÉTÉ", "été", "naïve", "x", "don't", "a1b2", "语言", "语言。", "Ä", "ä", "zz", "\x00q", "_u_", "🙂"] + [f"w{'abcdefghij'[i % 10]}{'klmno'[i % 5]}" for i in range(40)]
    rows = []
    for _ in range(n):
        source = rng.choice(["s1", "s2", "s3", "é", None])
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((text or None, rng.choice(["en", "en", "de", None]), source))
    return rows + [("", "leer", "s1"), (None, "leer", "s2"), ("one two", "rare", "s1"), ("solo", "alone", "s1")]


@pytest.mark.parametrize("size", [(3, 40), (500_000, 400_000)])
def test_equal_to_plain_fractions(spark, monkeypatch, size):
    """Small bounds give many shards and several flushes."""
    monkeypatch.setattr(divergence, "_SHARD", size[0])
    rows = random_rows(size[0])
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least=1, best=2) == plain(rows, least=1, best=2)


def test_counts_do_not_depend_on_chunks_or_flushes(monkeypatch):
    rows = random_rows(5, 300)
    batch = pa.RecordBatch.from_arrays([pa.array([(r[i] or "") for r in rows]) for i in range(3)], ["text", "lang", "source"])

    def counted():
        sums, docs = Counter(), Counter()
        for part in divergence._partial(iter([batch, batch.slice(0, 0)])):
            for r in part.to_pylist():
                sums[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        return sums, docs

    once = counted()
    monkeypatch.setattr(divergence, "_CHUNK", 200)
    monkeypatch.setattr(divergence, "_HELD", 30)
    assert counted() == once
    assert once[0] == sum((Counter({(lang or "", source or "", t): n for t, n in Counter(TERM.findall((text or "").translate(LOWER))).items()}) for text, lang, source in rows), Counter())


def test_shares_are_exact_for_large_totals():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, total - 1)
        assert int(divergence.shares(np.array([count]), total)[0]) == 1 + 10**9 * (count + 1) // total


def test_long_texts_repeated_rows_and_empty_tables(spark):
    rows = [("word " * 40_000 + "Other", "en", "a"), ("word", "en", "b")] * 3 + [("x" * 300_000, "en", "c")] * 3
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert compare(queries.op11_divergence(spark, SMALL), queries.ORACLES["op11_divergence"], con)[0] == "ok"
