"""Token ids of whole Arrow batches by the tokenizers library, each distinct piece between white space encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from riskloom.llm.words import byte_hashes

#: Bytes of text at a time; pieces that a worker remembers, some 50 bytes each.
_CHUNK, _PIECES = 6 << 20, 1_500_000
#: Pieces encoded in one call, and the mark between them: a control that is a token of its own.
_TOGETHER, _MARK = 256, "\x01"
_BETWEEN = f" {_MARK} "
#: A piece that is one word to the library; as no piece is less than one, the count of word ends shows if all of a text were.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: A common letter before the points that end a piece.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"
#: Such texts encoded in one call.
_CALLS = 64
_LOADED: dict[int, Pieces] = {}


class Pieces:
    """Distinct pieces and their ids: those of a piece lie in the pool between its start and its end."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.suffix = json.loads(spec)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if self.suffix and t.endswith(self.suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces. keys: first hashes, ascending; checks, numbers: second hash and number of each."""
        self.keys, self.checks, self.numbers = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pool, self.used, self.count = np.empty(1 << 16, np.uint32), 0, 0
        self.starts, self.ends = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _keep(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Numbers the next pieces, whose ids are ids[start:end]; ids become part of the pool."""
        first, self.count = self.count, self.count + len(starts)
        while self.count > len(self.starts):
            self.starts, self.ends = np.concatenate([self.starts] * 2), np.concatenate([self.ends] * 2)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[first : self.count], self.ends[first : self.count] = starts + self.used, ends + self.used
        self.used += len(ids)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces, many encoded in one text: words part where a token ends a word, others at marks they lack."""
        words: list[int] = []
        others: list[int] = []
        apart: list[int] = []
        for i, piece in enumerate(pieces):
            kind = words if self.suffix and _WORD.fullmatch(piece) else others if len(self.mark) == 1 and _MARK not in piece else apart
            kind.append(i)
        out = np.zeros(len(pieces), np.int64)
        others += self._learn_joined(pieces, words, out, " ", lambda ids: (at := np.flatnonzero(self.closes[ids]) + 1, np.concatenate([[0], at[:-1]]), at)[1:])
        apart += self._learn_joined(pieces, others, out, _BETWEEN, lambda ids: (at := np.flatnonzero(ids == self.mark[0]), np.concatenate([[0], at + 1]), np.append(at, len(ids)))[1:])
        for i, ids in zip(apart, self._encode([pieces[i] for i in apart]), strict=True):
            out[i] = self.count
            self._keep(ids, np.array([0]), np.array([len(ids)]))
        return out

    def _learn_joined(self, pieces: list[str], chosen: list[int], out: np.ndarray, between: str, parts: Callable) -> list[int]:
        """Learns chosen pieces by hundreds; those of texts that do not fall into as many parts come back."""
        groups = [chosen[i : i + _TOGETHER] for i in range(0, len(chosen), _TOGETHER)]
        left: list[int] = []
        for at in range(0, len(groups), _CALLS):
            part = groups[at : at + _CALLS]
            for group, ids in zip(part, self._encode([between.join([pieces[i] for i in g]) for g in part]), strict=True):
                starts, ends = parts(ids)
                if len(starts) == len(group) == len(ends):
                    out[group] = np.arange(self.count, self.count + len(group))
                    self._keep(ids, starts, ends)
                else:
                    left += group
        return left

    def find(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the two parts of each piece, its closing points apart: both have the ids that the whole piece has.

        Known pieces are found by two 64-bit hashes of their bytes, so only new ones become Python strings.
        """
        both = pa.concat_arrays(_parted(distinct)).dictionary_encode()
        names = both.dictionary
        if self.count + len(names) > _PIECES:
            self.clear()
        bounds = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, names.offset * 4).astype(np.int64)
        data = np.frombuffer(names.buffers()[2] or b"", np.uint8)
        key, check = (byte_hashes(data, bounds[:-1], bounds[1:], lower) for lower in (False, True))
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = (self.keys[at] == key) & (self.checks[at] == check) if len(self.keys) else np.zeros(len(names), bool)
        places = np.zeros(len(names), np.int64)
        places[hit] = self.numbers[at[hit]]
        new = np.flatnonzero(~hit)
        places[new] = self.learn(names.take(pa.array(new)).to_pylist())
        order = new[np.argsort(key[new], kind="stable")]
        into = np.searchsorted(self.keys, key[order])
        self.keys, self.checks, self.numbers = (np.insert(old, into, more[order]) for old, more in ((self.keys, key), (self.checks, check), (self.numbers, places)))
        found = places[np.asarray(both.indices)]
        return found[: len(distinct)], found[len(distinct) :]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the end id after each; offset of each text in them)."""
        lists = pc.split_pattern_regex(texts, pattern=r"[\x20\x09-\x0D]+")
        found = lists.flatten().dictionary_encode()
        parts = self.find(found.dictionary)
        last = np.cumsum(np.asarray(pc.list_value_length(lists)))
        at = np.asarray(found.indices)
        runs = np.insert(np.stack([p[at] for p in parts], axis=1), last, -1, axis=0).ravel()
        starts, sizes = self.starts[runs], (self.ends - self.starts)[runs]
        sizes[runs < 0] = 0
        ends = 2 * (last + np.arange(1, len(last) + 1)) - 1  # the second half of each row of -1 is the end id
        sizes[ends] = 1
        edges = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])
        offsets = np.concatenate([[0], edges[ends + 1]])
        take[offsets[1:] - 1] = 0
        ids = self.pool[take]
        ids[offsets[1:] - 1] = end
        return ids, offsets


def _parted(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Pieces without and with only the points at their end, where a common letter stands before them; ASCII ones in lower case.

    The library lowers letters, cuts between a letter and a point, and a point that ends a piece joins nothing behind it.
    """
    trimmed = pc.ascii_rtrim(pieces, ".,;:!?")
    sizes = np.asarray(pc.subtract(pc.binary_length(pieces), pc.binary_length(trimmed)))
    longer = np.flatnonzero(sizes)
    longer = longer[pc.match_substring_regex(trimmed.take(pa.array(longer)), _LETTER).to_numpy(zero_copy_only=False).astype(bool)]
    cut = np.zeros(len(pieces), bool)
    cut[longer] = True
    heads = pc.if_else(pa.array(cut), trimmed, pieces)
    tails = np.full(len(pieces), "", object)
    tails[longer] = [p[-n:] for p, n in zip(pieces.take(pa.array(longer)).to_pylist(), sizes[longer].tolist(), strict=True)]
    plain = pc.and_(pc.string_is_ascii(heads), pc.invert(pc.match_substring(heads, "<|")))
    return pc.if_else(plain, pc.ascii_lower(heads), heads), pa.array(tails, pa.string())


def encoded(batches: Iterator[pa.RecordBatch], spec: str, end: int) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids) of batches (doc_id, text), some megabytes of text at a time; a worker keeps its pieces."""
    if hash(spec) not in _LOADED:
        _LOADED[hash(spec)] = Pieces(spec)
    pieces = _LOADED[hash(spec)]
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK, "right")) - 1)
            ids, offsets = pieces.encode(texts.slice(row, last - row).cast(pa.string()), end)
            data = pa.Array.from_buffers(pa.binary(), last - row, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, last - row), data], ["doc_id", "ids"])
            row = last


def sequences(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids) of every row of docs(doc_id, text), partitions and order kept; ids are 4-byte little-endian numbers.

    The ids are those of the tokenizers library for the whole text, without special tokens added, and the id `end` after
    them; null counts as empty. The library cuts at white space in any case, so a text's ids are those of its pieces.
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    return docs.select("doc_id", "text").mapInArrow(lambda batches: encoded(batches, shared.value, end), "doc_id long, ids binary")
