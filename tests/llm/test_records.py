"""Token records: frames, indexes, shuffled reads and whole round trips against the tokenizers library."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import pieces, queries, records

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_padding()
    found.no_truncation()
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def expected(library, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64))):
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc_id, start, ids.tolist()))
        start += len(ids)
    return out


ODD = ["", None, " ", "\x01", "a\x01b \x01", "it's 'tis don't", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ÀÉ é ́x Σς ΑΣ", "日本語 123 ½", "a b c\x85d", "\x1c\x1d tab\tnew\nline\x0b\x0c\r",
       "😀😀", "İstanbul K", "x" * 5000, "word " * 30_000, "..., ;;; a.b,c!", "A. É, ñ! 1. x's. DON'T; ª. ǆ: \u0301. a\u0301, <|x. <|STARTOFTEXT|>. ?. ß?!"]


def test_pieces_equal_the_library(library):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices([t for t in ODD if t and len(t) < 60], k=5)) for _ in range(40)]
    encoder = pieces.Pieces(open(PATH, encoding="utf-8").read())
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts).fill_null(""), 2)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*library(t), 2] for t in texts]


def test_pieces_survive_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(pieces, "_PIECES", 3)
    encoder = pieces.Pieces(open(PATH, encoding="utf-8").read())
    for text in ("one two three four", "four five", "six seven one two"):
        ids, _ = encoder.encode(pa.array([text]), 2)
        assert ids.tolist() == [*library(text), 2]


def test_frames_and_masks():
    data = records.serialise(-5, np.array([1, 65_536], "<u4").tobytes())
    assert records.deserialise(data) == (-5, np.array([1, 65_536], "<u4").tobytes())
    assert len(records.serialise(1, np.array([1, 65_535], "<u4").tobytes())) == len(data) - 4
    stored = records.frame(data)
    assert struct.unpack("<Q", stored[:8])[0] == len(data) and records.unframe(stored) == data
    crc = zlib.crc32(data)
    assert struct.unpack("<I", stored[-4:])[0] == ((crc >> 15 | crc << 17) + 0xA282EAD8) % 2**32
    for i in range(len(stored)):
        with pytest.raises(records.DamagedRecord):
            records.unframe(stored[:i] + bytes([stored[i] ^ 1]) + stored[i + 1 :])
    for cut in (stored[:5], stored[:-1], stored + b"x"):
        with pytest.raises(records.DamagedRecord):
            records.unframe(cut)


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1025):
        for seed in (0, 9):
            assert sorted(records.permuted(np.arange(n), n, seed).tolist()) == list(range(n))
    assert records.permuted(np.arange(100), 100, 1).tolist() != records.permuted(np.arange(100), 100, 2).tolist()


def write(spark, docs_of, rows, folder, parts=5):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records.write_records(pieces.sequences(records.in_order(docs_of(*rows)), PATH, 2), folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_round_trip_in_order_and_shuffled(spark, docs_of, tmp_path, library, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(ODD)) for i in rng.sample(range(-300, 300), 200)] + [(None, "no id"), (7, "twice"), (7, "twice"), (7, None)]
    folder = f"file://{tmp_path}/out"
    write(spark, docs_of, rows, folder)
    assert len(records.manifest(folder)) > 1
    want = expected(library, rows)
    got = sorted(records.read_records(spark, folder).collect())
    assert [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.position for r in got] == list(range(len(rows)))
    shuffled = records.read_records(spark, folder, seed=4).collect()
    assert sorted(r.position for r in shuffled) == list(range(len(rows)))
    assert sorted((r.start, bytes(r.ids)) for r in shuffled) == [(r.start, bytes(r.ids)) for r in got]
    assert [r.start for r in sorted(shuffled)] != [r.start for r in got]
    assert sorted(shuffled) == sorted(records.read_records(spark, str(tmp_path / "out"), seed=4).collect())


def test_small_ranges_split_a_shard(spark, docs_of, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(300)]
    folder = str(tmp_path / "out")
    write(spark, docs_of, rows, folder, parts=2)
    reader = records.TokenRecords({"path": folder})
    whole = [r for p in reader.reader(None).partitions() for b in reader.reader(None).read(p) for r in b.to_pylist()]
    for seed in (None, 3):
        monkeypatch.setattr(records, "_RANGE", 700)
        monkeypatch.setattr(records, "_BUFFER", 100)
        small = records._Reader(folder, seed)
        assert len(small.partitions()) > 5
        rows = [r for p in small.partitions() for b in small.read(p) for r in b.to_pylist()]
        assert [r["position"] for r in rows] == list(range(300))
        assert sorted(((r["start"], r["ids"]) for r in rows)) == [(r["start"], r["ids"]) for r in whole]
        monkeypatch.undo()


def test_damage_is_found(spark, docs_of, tmp_path):
    write(spark, docs_of, [(1, "some text"), (2, "more text")], str(tmp_path / "out"), parts=1)
    shard = next((tmp_path / "out").glob("*.rec"))
    data = bytearray(shard.read_bytes())
    data[len(data) // 2] ^= 1
    shard.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, str(tmp_path / "out")).collect()


def test_no_documents(spark, docs_of, tmp_path):
    records.write_records(
        pieces.sequences(records.in_order(docs_of((1, "a")).where("false")), PATH, 2), str(tmp_path / "out"))
    assert records.read_records(spark, str(tmp_path / "out")).count() == 0
    assert records.read_records(spark, str(tmp_path / "out"), seed=1).count() == 0


def test_texts_are_encoded_where_they_are_written(spark, docs_of, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = records.in_order(docs_of(*rows))
    records.write_texts(docs, str(tmp_path / "texts"), PATH, 2)
    records.write_records(pieces.sequences(docs, PATH, 2), str(tmp_path / "ids"))
    got, plain = ([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in sorted(records.read_records(spark, str(tmp_path / kind)).collect())] for kind in ("texts", "ids"))
    assert got == plain == expected(library, rows)


def test_query_hands_no_ids_between_processes(spark, monkeypatch):
    monkeypatch.setattr(pieces, "sequences", None)
    assert queries.op13_records(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_query_equals_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, start, ids in expected(library, rows)]
    assert sorted(tuple(r) for r in queries.op13_records(spark, SMALL).orderBy(F.col("doc_id")).collect()) == want
