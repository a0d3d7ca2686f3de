"""BPE by automaton: merges compiled one by one into a deterministic automaton over tokens, words encoded by its arcs.

The automaton accepts a token sequence if and only if it is the result of the merges. It starts as one state with a loop
for each symbol. A merge (u, v) -> w gives the state behind u a copy that lacks v, sends u there, and adds an arc w wherever
u could be taken, to the state behind v. All arcs of a token lead to one state, so the automaton is kept as a target for each
token and, for each state, the tokens taken away and when; a token made later starts with a taken one and is gone too.

Every prefix of a word has exactly one accepted path, so a word is encoded from left to right: at each place exactly one of
the tokens that end there has an arc from the state where it begins.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: White space between pre-split words; Python's own split also cuts at the controls 28 to 31.
_SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WHITE, _CONTROLS = regex.compile(f"[{_SPACES}]+"), regex.compile(f"[{chr(28)}-{chr(31)}]")
#: Capital and small sigma; the small one stays the same at a word's end.
_SIGMA = chr(0x3A3), chr(0x3C3)
CACHE = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return out


class Automaton:
    """Compiled merges. targets: state behind each token; taken: for each state, token -> merge that took it away."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix, self.longest = vocabulary, suffix, max(map(len, vocabulary), default=1)
        self.left: dict[str, str] = {}
        self.made: dict[str, int] = {}
        self.taken: list[dict[str, int]] = [{}]
        self.targets: dict[str, int] = {}
        users = {0: 0}
        made_of = {a + b for a, b in merges}
        for token in vocabulary:
            if token not in made_of:
                self.targets[token] = 0
                users[0] += 1
        for rank, (u, v) in enumerate(merges):
            w = u + v
            if w in self.targets or u not in self.targets or v not in self.targets or not self.arc(self.targets[u], v):
                continue
            behind = self.targets[v]
            old = self.targets[u]
            if users[old] > 1 or old == 0 or behind == old:
                self.taken.append(dict(self.taken[old]))
                users[old] -= 1
                self.targets[u] = len(self.taken) - 1
                users[self.targets[u]] = 1
            self.taken[self.targets[u]][v] = rank
            self.left[w], self.made[w] = u, rank
            self.targets[w] = behind
            users[behind] += 1

    def arc(self, state: int, token: str) -> bool:
        """Whether the state has an arc for the token."""
        taken, born = self.taken[state], None
        while token is not None:
            when = taken.get(token)
            if when is not None and (born is None or born >= when):
                return False
            born, token = self.made.get(token), self.left.get(token)
        return True


class Encoder:
    """Words to ids and labels by the automaton's arcs; arcs and words once looked up are kept in bounded tables."""

    def __init__(self, automaton: Automaton, pattern: str, specials: dict[str, int]):
        self.automaton, self.split = automaton, regex.compile(pattern)
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.symbols = byte_symbols()
        self.decimal = {label: str(number) for label, number in (automaton.ids | specials).items()}
        self.arcs: dict[int, dict[str, bool]] = {}
        self.known: dict[str, tuple[str, str]] = {}

    def word(self, found: str) -> tuple[str, str]:
        """Decimal ids and labels of one pre-split word, both joined by one space."""
        both = self.known.get(found)
        if both is None:
            if len(self.known) >= CACHE:
                self.known.clear()
                self.arcs.clear()
            labels = self.tokens("".join([self.symbols[b] for b in found.encode()]))
            both = self.known[found] = " ".join([self.decimal[label] for label in labels]), " ".join(labels)
        return both

    def tokens(self, word: str) -> list[str]:
        """The accepted path that spells the word, its last symbol marked as such: longest arcs first, back from dead ends.

        A place has one state at most, whatever way leads there, so a place that failed once has failed for good.
        """
        machine, n = self.automaton, len(word)
        targets, suffix, longest = machine.targets, machine.suffix, machine.longest
        path: list[tuple[int, int, int, str]] = []
        dead: set[int] = set()
        at, state, end = 0, 0, min(n, longest)
        while at < n:
            arcs = self.arcs.setdefault(state, {})
            while end > at:
                token = word[at:end] if end < n else word[at:] + suffix
                if token in targets and end not in dead:
                    has = arcs.get(token)
                    if has is None:
                        has = arcs[token] = machine.arc(state, token)
                    if has:
                        break
                end -= 1
            if end > at:
                path.append((at, state, end, token))
                at, state = end, targets[token]
                end = min(n, at + longest)
            else:
                dead.add(at)
                at, state, end, _ = path.pop()
                end -= 1
        return [step[3] for step in path]

    def piece(self, text: str) -> tuple[str, str]:
        """Decimal ids and labels of a text without white space."""
        if text.isascii() and text.isalpha():
            return self.word(text.lower())
        found: list[tuple[str, str]] = []
        for part in self.special.split(text) if self.special and "<|" in text else (text,):
            if part in self.specials:
                found.append((self.decimal[part], part))
            elif part:
                part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace(*_SIGMA).lower()
                found += map(self.word, (part,) if part.isalpha() else self.split.findall(part))
        return found[0] if len(found) == 1 else (" ".join([a for a, _ in found]), " ".join([b for _, b in found]))


class _Known(dict):
    """Text piece -> (decimal ids, labels), both joined by one space, computed when first met."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[str, str]:
        found = self.encoder.piece(piece)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = found
        return found


def load(path: str) -> Encoder:
    """Encoder for a tokenizer file with a BPE model, word-end suffix and one splitting pattern."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    machine = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
    return Encoder(machine, pattern, {t["content"]: t["id"] for t in spec["added_tokens"]})


def encode_text(known: _Known, text: str) -> tuple[str, str]:
    """(ids, labels) of a text; a text that decodes to nothing gives empty strings."""
    pieces = _WHITE.split(text) if _CONTROLS.search(text) else text.split()
    found = [known[p] for p in pieces if p]
    return " ".join([a for a, _ in found if a]), " ".join([b for _, b in found if b])


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of docs(doc_id, text); ids as array, or SHA-256 of both with `digests`.

    The decoded text is the arc labels joined by one space. Null and blank texts have no tokens. Rows are encoded each for
    itself; other columns are ignored; no rows give none. The compiled automaton is broadcast: its size is that of the
    vocabulary, not of the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                rows = [encode_text(known, t or "") for t in texts.slice(at, 256).to_pylist()]
                counts = pa.array([a.count(" ") + 1 if a else 0 for a, _ in rows], pa.int64())
                if digests:
                    columns = [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows]) for k in (0, 1)]
                else:
                    columns = [pa.array([[int(x) for x in a.split()] for a, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), counts, *columns], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
