"""Very long words, lines and token runs: exact results, and time that grows with the text."""

import random
import time

import numpy as np

from riskloom.llm import repetition, secrets, setsketch, words


def morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_long_words_and_lines_made_to_collide_stay_apart(docs_of):
    a, b = morse(2048), morse(2048, "b", "a")
    rows = setsketch.near_duplicates(docs_of((1, a), (2, b), (3, a.upper())), length=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2), (3, 1)]
    counts = {r.doc_id: r.n_dup_lines for r in repetition.repetition(docs_of((1, f"{a}\n{b}"), (2, f"{a}\n{a}\nx\n{b}"))).collect()}
    assert counts == {1: 0, 2: 1}


def test_byte_hashes_follow_contents_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(words, "_SEGMENT", 300)
    rng = random.Random(4)
    parts = [bytes(rng.choices(b"abAB \xc3\xa9", k=rng.choice([0, 1, 5, 60, 255, 256, 257, 900]))) for _ in range(300)]
    parts += rng.sample(parts, 120) + [p.swapcase() for p in parts[:40]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for lower, same in ((False, parts), (True, [p.lower() for p in parts])):
        hashes = words.byte_hashes(data, edges[:-1], edges[1:], lower).tolist()
        assert len(set(hashes)) == len(set(same)) and len(set(zip(hashes, same, strict=True))) == len(set(same))


def plain_apart(tokens, known):
    return [t for t in tokens if not any(t[0] < k[1] and k[0] < t[1] for k in known)]


def test_tokens_beside_known_spans(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PART", 3)
    rng = random.Random(2)
    rows = []
    for i in range(200):
        at, tokens = 0, []
        for _ in range(rng.randint(1, 12)):
            at += rng.randint(1, 9)
            tokens.append((at, at + rng.randint(1, 9), "t"))
            at = tokens[-1][1]
        known = [(s, s + rng.randint(1, 14), "k") for s in (rng.randint(0, at) for _ in range(rng.randint(0, 6)))]
        rows.append((i, tokens, known))
    kind = "array<struct<start:int,end:int,value:string>>"
    df = spark.createDataFrame(rows, f"i int, tokens {kind}, known {kind}")
    got = {r.i: [tuple(t) for t in r.left] for r in df.select("i", secrets._apart(df["tokens"], df["known"]).alias("left")).collect()}
    assert got == {i: plain_apart(t, k) for i, t, k in rows}


def test_a_text_of_very_many_tokens_takes_seconds(docs_of):
    rng = random.Random(6)
    many = [f"{'token=' if i % 9 == 0 else ''}{rng.getrandbits(80):020x}" for i in range(30_000)]
    text = " ".join(many)
    began = time.time()
    row = secrets.scan(docs_of((1, text), (2, "password: hunter22 and more"))).where("doc_id = 1").selectExpr("size(assign) AS a", "assign[1000] AS s", "size(random) AS r").first()
    assert row.a == sum(i % 9 == 0 for i in range(30_000)) and text[row.s.start : row.s.end].startswith("token=")
    assert time.time() - began < 60


def test_masks_of_many_spans(docs_of):
    text = "é key " + " é ".join(f"password=abc{i:05d}" for i in range(3000)) + " end"
    model = secrets.Model([0.0] * secrets.SIZE**2, 1e9, 1.0, 8)
    out = secrets.redacted(docs_of((1, text), (2, "nothing"), (3, None), (4, "")), model).orderBy("doc_id").collect()
    assert out[0].text == "é key " + " é ".join(["[secret]"] * 3000) + " end"
    assert [r.text for r in out[1:]] == ["nothing", None, ""]
