"""Quality rules on repetition: characters inside repeated word windows of several lengths, and inside repeated lines.

Windows are compared by rolling 64-bit hashes over whole batches in numpy. Both rules count the first occurrence too: a text
made of one passage twice is covered wholly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm import words

SYMBOLS = "#*$%&|<>"
#: Most characters, per cent of those in words, inside repeated windows of so many words.
WINDOWS = {5: 40, 8: 30, 12: 25}
#: Most characters, per cent of those in lines with a word, inside repeated lines; and most repeated lines, per cent.
LINE_CHARS, LINES = 40, 50
BASE_WINDOW, BASE_PERCENT, BASE_WORDS = 8, 30, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts even where contents agree."""
    return words.mix(hashes ^ words.mix(owner.astype(np.uint64) + np.uint64(1)))


def measure(chunk: words.Words, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk; covered_words_n and covered_chars_n for each window length n."""
    chars = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=chars[1:])
    word_chars = chars[chunk.ends] - chars[chunk.starts]
    out = {"n_words": np.diff(chunk.offsets), "word_chars": _sums(word_chars, chunk.offsets),
           "n_symbols": _sums(_SYMBOL[chunk.data], chunk.texts)}

    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.texts[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, chunk.texts[1:]]))
    filled = np.searchsorted(chunk.starts, starts) < np.searchsorted(chunk.starts, ends)
    lines = np.searchsorted(breaks, chunk.texts)
    owner = np.repeat(np.arange(chunk.rows), np.diff(lines) + 1)[filled]
    starts, ends = starts[filled], ends[filled]
    keys = _within(words.byte_hashes(chunk.data, starts, ends), owner)
    twice, lengths_of = _repeated(keys), chars[ends] - chars[starts]
    by_text = np.searchsorted(owner, np.arange(chunk.rows + 1))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    out |= {"n_lines": np.diff(by_text), "n_dup_lines": _sums(again, by_text),
            "line_chars": _sums(lengths_of, by_text), "dup_line_chars": _sums(lengths_of * twice, by_text)}

    hashes, owner = chunk.hashes(lower=False), chunk.owners()
    for n in lengths:
        windows, at = words.window_hashes(hashes, chunk.offsets, n)
        at = at[_repeated(_within(windows, owner[at]))]
        steps = np.bincount(at, minlength=len(hashes) + 1) - np.bincount(at + n, minlength=len(hashes) + 1)
        inside = np.cumsum(steps)[: len(hashes)] > 0
        out[f"covered_words_{n}"] = _sums(inside, chunk.offsets)
        out[f"covered_chars_{n}"] = _sums(inside * word_chars, chunk.offsets)
    return out


def repetition(docs: DataFrame, lengths: tuple[int, ...] = tuple(WINDOWS)) -> DataFrame:
    """doc_id and the counts of `measure` for each row of docs(doc_id, text); other columns are ignored.

    Null texts count as empty, all counts are then 0. Rows are measured each for itself: repeated rows repeat their
    result, no rows give none. Line equality is of whole lines, white space included.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars",
             *[f"covered_{kind}_{n}" for n in lengths for kind in ("words", "chars")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch.column("text")):
                counts = measure(chunk, lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.row, chunk.rows), *[pa.array(counts[k].astype(np.int64)) for k in names]],
                    ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in names))


def judged(docs: DataFrame, windows: dict[int, int] | None = None) -> DataFrame:
    """`repetition` with base_failed (too short or base windows cover too much) and kept (no rule fails)."""
    windows = WINDOWS if windows is None else windows
    counts = repetition(docs, tuple(sorted({BASE_WINDOW, *windows})))
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col(f"covered_words_{BASE_WINDOW}") > BASE_PERCENT * F.col("n_words"))
    fails = (100 * F.col("dup_line_chars") > LINE_CHARS * F.col("line_chars")) | (100 * F.col("n_dup_lines") > LINES * F.col("n_lines"))
    for n, percent in windows.items():
        fails = fails | (100 * F.col(f"covered_chars_{n}") > percent * F.col("word_chars"))
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & ~fails)
