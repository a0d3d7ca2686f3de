"""The conversation trie against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from riskloom.llm import queries, trie
from tools.check import compare

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)


def plain_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(donor, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        todo, leaves, saved = [node], 0, 0
        while todo:
            x = todo.pop()
            todo += children[x]
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        return leaves, saved

    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        leaves, saved = below(node)
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in trie.prefix_trie(frame(spark, rows)).collect()), key=repr)


def random_rows(seed):
    rng, rows = random.Random(seed), []
    for conv in rng.sample(range(-60, 400), 140):
        first = rng.randint(0, 2)
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, first + turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "c  d\te"])))
    return rows


@pytest.mark.parametrize("block", [2, 4096])
def test_nodes_equal_a_plain_trie(spark, monkeypatch, block):
    """Random conversations, negative ids, missing donors; small blocks cut every conversation into several sums."""
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = random_rows(block)
    assert found(spark, rows) == plain_nodes(rows)


def test_copies_long_conversations_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1040) for t in range(3)]
    rows += [(7, t, "user", "x" if t < 200 else f"y {t}") for t in range(300)] + [(27, t, "user", "x") for t in range(200)]
    rows += [(41, None, "user", "first"), (41, 0, "user", "second"), (41, 0, "user", "second"), (41, None, None, None), (None, 1, "user", "lost")]
    rows += [(62, 5, "user", "word " * 3000), (50, 1, "a", "bc"), (51, 1, "ab", "c")]
    assert found(spark, rows) == plain_nodes(rows)


def test_conversation_left_without_turns_ends_at_the_root(spark):
    alone = next(c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 0, "user", "one"), (alone, 1, "user", "two")]
    assert found(spark, rows) == plain_nodes(rows)
    assert found(spark, rows)[0][:4] == (alone, 0, None, 1)
    assert found(spark, []) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    assert compare(queries.op12_prefix_trie(spark, SMALL), queries.ORACLES["op12_prefix_trie"], con)[0] == "ok"
