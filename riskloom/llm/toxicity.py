"""Toxicity by a learned lexicon: its trie intersected with Levenshtein automata, and windows that tell quotation from abuse.

Terms are words, and stems that many toxic words begin with, whose share among toxic documents is far above that among
others. Their trie and the edit automata are run together as one automaton over characters, made deterministic on demand:
a state is the set of (trie node, edits so far) that a spelling can be in. A hit inside quotation marks within a window of
words counts less than one outside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm import words
from riskloom.llm.setsketch import shingle_sets
from riskloom.llm.storage import checkpoint

_WORD = re.compile(r"[^\W_]+")
#: Quotation marks: straight, typographic double and single, low, angular.
QUOTES = '"' + "".join(map(chr, (0x201C, 0x201D, 0x201E, 0x201F, 0xAB, 0xBB)))
_QUOTE = re.compile(f"[{QUOTES}]")
WINDOW, QUOTED_SHARE = 12, 0.25
CACHE = 300_000


class Term(NamedTuple):
    text: str
    stem: bool

    @property
    def edits(self) -> int:
        """Misspelt letters allowed: none in short terms, where ordinary words are near."""
        size = len(self.text) - self.stem
        return 0 if size < 5 else 1 if size < 8 else 2


class FuzzyTrie:
    """Lexicon trie and edit automata in one lazily determinised automaton. value: 0 none, 1 misspelt, 2 exact."""

    def __init__(self, terms: list[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, Term] = {}
        self.room: list[int] = [0]
        for term in terms:
            node = 0
            for char in term.text:
                if char not in self.children[node]:
                    self.children.append({})
                    self.room.append(0)
                    self.children[node][char] = len(self.children) - 1
                self.room[node] = max(self.room[node], term.edits)
                node = self.children[node][char]
            self.term[node] = term
            self.room[node] = max(self.room[node], term.edits)
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.values: list[tuple[int, bool]] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With letters left out; of two ways to a node the one with fewer edits."""
        best: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, edits = todo.pop()
            if edits >= best.get(node, 99):
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values() if edits < self.room[child]]
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
            hits = [(edits, self.term[node].stem) for node, edits in state if node in self.term and edits <= self.term[node].edits]
            value = max((2 if not edits else 1 for edits, _ in hits), default=0)
            self.values.append((value, any(stem for edits, stem in hits if value == 1 or not edits)))
        return self.numbers[state]

    def _step(self, number: int, char: str) -> int:
        nxt: set[tuple[int, int]] = set()
        for node, edits in self.sets[number]:
            child = self.children[node].get(char)
            if child is not None:
                nxt.add((child, edits))
            if edits < self.room[node]:
                nxt.add((node, edits + 1))
            nxt |= {(c, edits + 1) for other, c in self.children[node].items() if other != char and edits < self.room[c]}
        to = self.steps[number][char] = self._number(self._closed(nxt))
        return to

    def value(self, word: str) -> int:
        """2 if the word is a term or begins with a stem, 1 if it does so with allowed edits, else 0."""
        at, met = self.start, 0
        for char in word:
            at = self.steps[at].get(char, -1) if char in self.steps[at] else self._step(at, char)
            value, stem = self.values[at]
            if stem:
                if value == 2:
                    return 2
                met = 1
            if not self.sets[at]:
                return met
        return max(met, self.values[at][0])


class Model(NamedTuple):
    """Terms, ordinary words that are near a term, and the logistic weights of (constant, exact, misspelt, density)."""

    terms: list[Term]
    ordinary: frozenset[str]
    weights: tuple[float, float, float, float]


class _Known(dict):
    def __init__(self, trie: FuzzyTrie, ordinary: frozenset[str]):
        self.trie, self.ordinary = trie, ordinary

    def __missing__(self, word: str) -> int:
        value = self.trie.value(word)
        if value == 1 and word in self.ordinary:
            value = 0
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def _hits(text: str, known: _Known) -> tuple[float, float, int]:
    """Weighted exact hits, weighted misspelt hits and words of a text."""
    found = _WORD.findall(text.lower())
    values = list(map(known.__getitem__, found))
    if not any(values):
        return 0.0, 0.0, len(found)
    text = text.lower()
    marks = [m.start() for m in _QUOTE.finditer(text)]
    spans = [m.span() for m in _WORD.finditer(text)]
    sums = [0.0, 0.0]
    quoted_until = _quoted(marks, spans)
    for i, value in enumerate(values):
        if value:
            sums[2 - value] += QUOTED_SHARE if quoted_until[i] else 1.0
    return sums[0], sums[1], len(found)


def _quoted(marks: list[int], spans: list[tuple[int, int]]) -> np.ndarray:
    """Words between an opening and the next closing mark, where at most WINDOW words lie on either side up to the mark."""
    starts = np.array([s for s, _ in spans])
    out = np.zeros(len(spans), bool)
    for opening, closing in zip(marks[::2], marks[1::2], strict=False):
        first, last = np.searchsorted(starts, [opening, closing])
        if last - first <= 2 * WINDOW:
            out[first:last] = True
    return out


def _features(docs: DataFrame, terms: list[Term], ordinary: frozenset[str]) -> DataFrame:
    """doc_id, other columns but text, exact, misspelt, n_words."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(FuzzyTrie(terms), ordinary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_hits(t or "", known) for t in part.column("text").to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.float64()), (1, pa.float64()), (2, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, "exact", "misspelt", "n_words"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{kinds}, exact double, misspelt double, n_words long")


def _inputs(exact: Column, misspelt: Column, n_words: Column) -> list[Column]:
    return [F.log1p(exact), F.log1p(misspelt), F.log1p(100 * (exact + misspelt) / F.greatest(n_words, F.lit(50)))]


def _without_copies(labelled: DataFrame) -> DataFrame:
    """One labelled document (toxic, text) of those whose two smallest shingle hashes agree: near copies would vouch for
    every rare word they share."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch.column("text")):
                sets, offsets = shingle_sets(chunk, 2)
                keys = [sets[a : min(b, a + 2)].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                part = batch.slice(chunk.row, chunk.rows).select(["doc_id", "toxic", "text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], ["doc_id", "toxic", "text", "key"])

    rows = labelled.select("doc_id", "toxic", "text").mapInArrow(keyed, "doc_id long, toxic int, text string, key binary")
    return rows.groupBy("key", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("toxic", "text")


def learn_terms(labelled: DataFrame, most: int = 2_000) -> tuple[list[Term], frozenset[str]]:
    """Terms from labelled(text, toxic), at most `most`, and ordinary words that the fuzzy trie would take for one.

    Documents with a word are counted by class, then summed for each beginning of three letters or more. A beginning is
    precise if its smoothed odds are 50 times those of the classes. The shortest precise one that branches is a stem if it has
    five words or more; else its words stand for themselves.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(set(_WORD.findall((text or "").lower())))
            found = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), *(pa.array([counts[k][w] for w in found], pa.int64()) for k in (1, 0))], ["word", "bad", "good"])

    sizes = dict(labelled.groupBy("toxic").count().collect())
    bad_docs, good_docs = sizes.get(1, 0), sizes.get(0, 0)
    if not bad_docs or not good_docs:
        return [], frozenset()
    table = labelled.select("text", "toxic").mapInArrow(count, "word string, bad long, good long")
    table = checkpoint(table.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    precise = (F.col("bad") + 0.5) / bad_docs >= 50 * (F.col("good") + 0.5) / good_docs
    at_least = max(4, bad_docs // 100)
    starts = table.withColumn("start", F.explode(F.transform(
        F.sequence(F.lit(3), F.least(F.length("word"), F.lit(24))), lambda n: F.substring("word", F.lit(1), n)))).where("length(word) >= 3")
    starts = starts.groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"),
                                         F.count_if(F.col("bad") > 0).alias("words"), F.count_if(F.col("word") == F.col("start")).alias("whole"))
    rows = starts.where(precise & (F.col("bad") >= at_least)).orderBy(F.desc("bad"), "start").limit(most * 8).collect()
    nodes = {r["start"]: r for r in rows}
    terms: list[Term] = []
    for start in sorted(nodes, key=lambda s: (len(s), s)):
        if any(start[:n] in nodes for n in range(3, len(start))) and any(t.stem and start.startswith(t.text) for t in terms):
            continue
        node = nodes[start]
        longer = any(nodes[c]["bad"] == node["bad"] for c in nodes if len(c) == len(start) + 1 and c.startswith(start))
        if not longer and node["words"] >= 5:
            terms.append(Term(start, True))
        elif node["whole"] and not longer:
            terms.append(Term(start, False))
    terms = terms[:most]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(terms)
        for batch in batches:
            found = [w for w in batch.column("word").to_pylist() if trie.value(w) == 1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    close = table.where("good > 0").mapInArrow(near, "word string").limit(200_000)
    return terms, frozenset(r[0] for r in close.collect())


def _fit(inputs: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge, classes weighing the same; weights of hits stay non-negative."""
    x = np.column_stack([np.ones(len(inputs)), inputs])
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    ridge = np.diag([1e-3, 1e-2, 1e-2, 1e-2]) * len(labels)
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, x.T @ (weight * (labels - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    beta[1:] = np.maximum(beta[1:], 0)
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 10_000) -> Model:
    """Model from labels(doc_id, toxic) and docs(doc_id, text). About `rows_per_class` labelled rows of each class are used,
    drawn by hash of the id; null labels and ids do not count, and a document with both labels is toxic.

    With one class only, or none, the model has no terms and every score is below a half.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = dict(marked.groupBy("toxic").count().collect())
    step = F.when(F.col("toxic") == 1, max(1, sizes.get(1, 0) // rows_per_class)).otherwise(max(1, sizes.get(0, 0) // rows_per_class))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), step) == 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    labelled = texts.join(F.broadcast(drawn), "doc_id")  # at most about twice rows_per_class rows
    labelled = checkpoint(_without_copies(labelled))
    terms, ordinary = learn_terms(labelled)
    default = (-2.0, 2.0, 1.0, 1.0)
    if not terms:
        return Model([], frozenset(), default)
    rows = _features(labelled.select("toxic", "text"), terms, ordinary).select(
        "toxic", *_inputs(F.col("exact"), F.col("misspelt"), F.col("n_words"))).toPandas().to_numpy(dtype=float)
    weights = _fit(rows[:, 1:], rows[:, 0])
    if weights[2] == 0:  # no misspelling among the labelled rows: half the weight of an exact hit
        weights = (*weights[:2], weights[1] / 2, weights[3])
    return Model(terms, ordinary, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but text, with exact, misspelt, n_words and score (0 to 1, above a half: toxic) for every row.

    Null and empty texts have no hits and the score that goes with none. Each row is scored by its text alone; repeated rows
    repeat it; no rows give none. Columns of docs named like a result are replaced.
    """
    clash = [c for c in docs.columns if c in ("exact", "misspelt", "n_words", "score")]
    rows = _features(docs.drop(*clash).withColumn("text", F.col("text").cast("string")), model.terms, model.ordinary)
    total = F.lit(model.weights[0])
    for weight, value in zip(model.weights[1:], _inputs(F.col("exact"), F.col("misspelt"), F.col("n_words")), strict=True):
        total = total + weight * value
    return rows.withColumn("score", 1 / (1 + F.exp(-total)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows kept out of learning: CRC-32 of the id as text is divisible by `folds`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))
