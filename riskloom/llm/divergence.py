"""How far the sources of a language differ in the terms they use, by Arrow kernels on partial counts and merged shards.

Counting: ascii_lower, split_pattern_regex, dictionary_encode and group_by of Arrow turn batches into counts by (lang, source,
term), merged within a task before they leave it. Spark adds them up, keeps the terms of enough documents and stores them as
columnar shards by term. Comparing: each shard meets the totals of its language and gives sums for every pair of sources and
its own best terms; a pair costs the terms that either source has, all others share one value. All arithmetic is on whole
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.storage import stored

#: What parts terms; RE2 syntax.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
ONE = 1_000_000_000
#: Bytes of text at a time; merged counts that a task holds; kept counts of one shard.
_CHUNK, _HELD, _SHARD = 4 << 20, 400_000, 500_000
_GROUP = ["lang", "source", "term"]


def chunk_counts(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some documents: occurrences, and documents that hold the term."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=APART)
    rows, terms = pc.list_parent_indices(lists), lists.flatten()
    real = pc.not_equal(terms, "")
    rows, terms = rows.filter(real), terms.filter(real).dictionary_encode()
    by_text = pa.table({"row": rows, "term": terms.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    at = by_text["row"]
    grouped = pa.table({"lang": langs.indices.take(at), "source": sources.indices.take(at), "term": by_text["term"], "n": by_text["count_all"]})
    grouped = grouped.group_by(_GROUP, use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    columns = [found.dictionary.take(grouped[name].combine_chunks()) for name, found in zip(_GROUP, (langs, sources, terms), strict=True)]
    return pa.table([*columns, grouped["n_sum"].cast(pa.int64()), grouped["count_all"].cast(pa.int64())], names=[*_GROUP, "n", "docs"])


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(_GROUP, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, merged whenever twice as much is held as after the last merging; what stays too much goes out."""
    parts: list[pa.Table] = []
    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK, "right")) - 1)
            part = slice(row, last - row)
            parts.append(chunk_counts(*[batch.column(c).slice(part.start, part.stop) for c in ("text", "lang", "source")]))
            held += parts[-1].num_rows
            if held > 2 * _HELD:
                parts = [_merged(parts)]
                held = parts[0].num_rows
                if held > _HELD:
                    yield from parts[0].combine_chunks().to_batches(max_chunksize=50_000)
                    parts, held = [], 0
            row = last
    if held:
        yield from _merged(parts).combine_chunks().to_batches(max_chunksize=50_000)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / total), digit by digit to base 1000: exact for totals below 9 * 10**15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shard_results(terms: np.ndarray, n_terms: int, owner: np.ndarray, counts: np.ndarray, in_lang: np.ndarray, totals: np.ndarray, lang_total: int, kept: int):
    """(sums for all pairs of sources; p > q with value of each count that is above the language's share).

    terms, owner, counts, in_lang: a count's term (below n_terms), source, occurrences there and in the language, in order of
    owner; totals: the sum over kept terms of each source, kept: the number of kept terms.
    """
    m = len(totals)
    base = shares(np.zeros(m, np.int64), totals + kept) if kept else np.ones(m, np.int64)
    p = shares(counts, (totals + kept)[owner]) if len(counts) else np.empty(0, np.int64)
    bounds = np.searchsorted(owner, np.arange(m + 1))
    sums = np.zeros((m, m), np.int64)

    def by_owner(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(values)])
        return running[bounds[1:]] - running[bounds[:-1]]

    for b in range(m):
        own = slice(bounds[b], bounds[b + 1])
        q, has = np.full(n_terms, base[b]), np.zeros(n_terms, bool)
        q[terms[own]], has[terms[own]] = p[own], True
        both = has[terms]
        sums[:, b] = by_owner(distance(p, q[terms]))
        # terms that only b has: all of b's against the other's base, less those that the other has as well
        mine, times = np.unique(p[own], return_counts=True)
        sums[:, b] += np.array([int((distance(base[a], mine) * times).sum()) for a in range(m)], np.int64)
        sums[:, b] -= by_owner(np.where(both, distance(base[owner], q[terms]), 0))
        neither = n_terms - (bounds[1:] - bounds[:-1]) - (bounds[b + 1] - bounds[b]) + by_owner(both.astype(np.int64))
        sums[:, b] += neither * distance(base, np.full(m, base[b]))
    q = shares(in_lang, lang_total + kept) if len(counts) else p
    return sums, p > q, distance(p, q)


def _compare(best: int):
    def run(key: tuple, counts: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.combine_chunks()
        sources = totals["source"].to_pylist()
        counts = counts.append_column("owner", pc.index_in(counts["source"], value_set=totals["source"].combine_chunks())).sort_by("owner").combine_chunks()
        words = counts["term"].combine_chunks() if counts.num_rows else pa.array([], pa.string())
        terms = words.dictionary_encode()
        owner = counts["owner"].to_numpy().astype(np.int64)
        kept, n_lang = int(totals["kept"][0].as_py()), int(totals["in_lang"][0].as_py())
        sums, above, value = shard_results(
            np.asarray(terms.indices).astype(np.int64), len(terms.dictionary), owner, counts["n"].to_numpy().astype(np.int64), counts["in_lang"].to_numpy().astype(np.int64),
            totals["n"].to_numpy().astype(np.int64), n_lang, kept)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = totals["source"].combine_chunks()
        pairs = pa.table([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(sums[a, b])], names=["source", "item", "value"]).append_column("part", pa.array(["pair"] * len(a), pa.string()))
        at = np.flatnonzero(above)
        found = pa.table({"source": names.take(pa.array(owner[at])), "item": words.take(pa.array(at)), "value": value[at], "owner": owner[at]})
        found = found.sort_by([("owner", "ascending"), ("value", "descending"), ("item", "ascending")])
        place = found["owner"].to_numpy()
        place = np.arange(len(place)) - np.searchsorted(place, place)
        found = found.filter(pa.array(place < best)).select(["source", "item", "value"])
        found = found.append_column("part", pa.array(["term"] * found.num_rows, pa.string()))
        out = pa.concat_tables([pairs, found])
        return out.append_column("lang", pa.array([key[0].as_py()] * out.num_rows, pa.string())).select(["lang", "source", "part", "item", "value"])

    return run


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, in_lang, one) of the terms in at least `least` documents of a language; one is 1 once a term."""
    partial = docs.mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    counts = partial.groupBy(*_GROUP).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.select(*_GROUP, "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("in_lang"), F.min("source").over(term).alias("first"))
    return counts.where(F.col("docs") >= least).select(*_GROUP, "n", "in_lang", (F.col("source") == F.col("first")).cast("long").alias("one"))


def divergence(docs: DataFrame, least: int = 3, best: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language of docs(text, lang, source).

    Terms are runs of A-Z, a-z and characters above U+007F; null text, lang and source are ''. A term's share of a group is
    1 + floor(10**9 * (count + 1) / (all counts + number of kept terms)), and a value floor((p - q)**2 / q). Part `pair` has
    every other source of the language with the sum of values over kept terms, nought where there are none; part `term` the
    `best` terms whose share is above the language's. Rank: by value descending, then by item in code point order. Every row
    counts as a document; other columns are ignored; no rows give none.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stored(kept_terms(docs, least), "terms")
    shards = max(1, -(-kept.count() // _SHARD))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("one").alias("kept"), F.sum("n").alias("in_lang"))
    totals = docs.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"), "left")
    totals = totals.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "kept", "in_lang")])
    totals = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    found = kept.groupBy("lang", "shard").cogroup(totals.groupBy("lang", "shard")).applyInArrow(
        _compare(best), "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best))
