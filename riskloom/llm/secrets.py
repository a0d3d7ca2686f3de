"""Secret scans with DataFrame functions only: fixed patterns, and a likelihood ratio of two character Markov models.

One model is trained on values that the fixed patterns find (labelled random strings), mixed with the uniform one; the
other on ordinary identifiers and words outside such values. A long token whose characters follow the first model much
better than the second is a secret although no fixed pattern names it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.storage import checkpoint

#: The kinds in order, their patterns, the group that is measured and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A cheaper pattern that every text with a counted match of the kind contains.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Long runs of hex digits alone matter for the kind hex; shorter runs fail and end where longer ones would.
FASTER = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
ADDED = "random"
TOKEN, ORDINARY = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+/_=-]{4,}"
SIZE, SYMBOLS = 128, 65
#: Items folded together.
PART = 48


class Model(NamedTuple):
    """Log-likelihood ratio of each character pair, row-major over ASCII; the least ratio of a secret, in all and per
    character; the least number of different characters."""

    ratios: list[float]
    least: float
    each: float
    different: int


_SPANS = "array<struct<start:int,end:int,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda variable stands for it, also where lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, start: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of what `step(state, item)` gives beside the next state, for items in order; `out` is its type.

    Items are folded by dozens, and dozens are put together once: appending to one growing array would copy it every time.
    """
    empty = F.from_json(F.lit("[]"), out)

    def inside(done: Column, item: Column) -> Column:
        state, found = step(done["state"], item)
        return F.struct(state.alias("state"), F.array_append(done["out"], found).alias("out"))

    def across(done: Column, part: Column) -> Column:
        return F.array_append(done, F.aggregate(part, F.struct(F.element_at(done, -1)["state"].alias("state"), empty.alias("out")), inside))

    def whole(given: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / PART).cast("int")), lambda k: F.slice(given, k * PART + 1, PART))
        folded = F.aggregate(parts, F.array(F.struct(start.alias("state"), empty.alias("out"))), across)
        return F.when(F.size(given) > 0, F.flatten(F.transform(folded, lambda d: d["out"]))).otherwise(empty)

    return _once(items, whole)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(start, end, value) of all matches in order, in code points; value is the group's text."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + m["gap"]
        end = start + F.coalesce(F.length(m["whole"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))

    return F.filter(_scan(found, F.lit(0), _SPANS, step), lambda s: s["value"].isNotNull())  # after the last match there is only a gap


def _apart(tokens: Column, known: Column) -> Column:
    """Tokens (in order, disjoint) that overlap no known span: none before ends behind a token's start, none after starts before its end."""
    event = lambda is_token: lambda s: F.struct(s["start"].alias("start"), F.lit(is_token).alias("token"), s["end"].alias("end"), s["value"].alias("value"))
    events = F.sort_array(F.concat(F.transform(known, event(0)), F.transform(tokens, event(1))))
    kind = "array<struct<start:int,token:int,end:int,value:string>>"

    def forward(reach: Column, e: Column) -> tuple[Column, Column]:
        hit = (e["token"] == 1) & (reach > e["start"])
        return F.when(e["token"] == 0, F.greatest(reach, e["end"])).otherwise(reach), _event(e, F.when(hit, 2).otherwise(e["token"]))

    def backward(follows: Column, e: Column) -> tuple[Column, Column]:
        hit = (e["token"] == 1) & (follows < e["end"])
        return F.when(e["token"] == 0, F.least(follows, e["start"])).otherwise(follows), _event(e, F.when(hit, 2).otherwise(e["token"]))

    left = F.reverse(_scan(F.reverse(_scan(events, F.lit(0), kind, forward)), F.lit(2**31 - 1), kind, backward))
    return F.transform(F.filter(left, lambda e: e["token"] == 1), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value")))


def _event(e: Column, token: Column) -> Column:
    return F.struct(e["start"].alias("start"), token.cast("int").alias("token"), e["end"].alias("end"), e["value"].alias("value"))


def _guarded(text: Column, hint: str, pattern: str, group: int) -> Column:
    return F.when(text.rlike(hint), _matches(text, pattern, group)).otherwise(F.from_json(F.lit("[]"), _SPANS))


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["value"]) >= least)


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds one array of (start, end, value) for each kind, and `tokens`: the other long tokens; null texts have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    for kind, (pattern, group, least) in KINDS.items():
        found = _guarded(F.col("text"), HINTS[kind], FASTER.get(kind, pattern), group)
        rows = rows.withColumn(kind, _long_enough(found, least))
    rows = rows.withColumn("tokens", _guarded(F.col("text"), TOKEN, TOKEN, 0))
    known = F.concat(*KINDS)
    return rows.withColumn("tokens", F.when((F.size(known) > 0) & (F.size("tokens") > 0), _apart(F.col("tokens"), known)).otherwise(F.col("tokens")))


def _pairs(values: DataFrame) -> DataFrame:
    """How often each pair of neighbouring characters stands in values(value), each character an ASCII code."""
    chars = values.select(F.transform(F.split("value", ""), F.ascii).alias("c"))
    codes = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * SIZE + F.get("c", i))
    return chars.where("size(c) > 1").select(F.explode(codes).alias("pair")).groupBy("pair").count()


def train(found: DataFrame, docs: DataFrame, sample_rows: int = 20_000, least: float = 12.0, each: float = 1.0, different: int = 8) -> Model:
    """Both models. found has the arrays of `base_spans`; ordinary words come from about `sample_rows` documents.

    Random strings are counted over all documents. The sample of ordinary words is drawn by text hash; the bound only
    limits how many labelled words the model is fitted on. Without any labelled value the random model is uniform.
    Counts of at most 128 x 128 pairs reach the driver.
    """
    labelled = found.select(F.explode(F.concat(*KINDS)).alias("span")).select("span.value")
    rows = max(1, docs.count() // sample_rows)
    sample = docs.where(F.col("text").isNotNull()).where(F.pmod(F.xxhash64("text"), F.lit(rows)) == 0)
    plain = F.col("text")
    for kind, (pattern, _, _) in KINDS.items():
        plain = F.regexp_replace(plain, FASTER.get(kind, pattern), " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))).alias("value"))
    counts = [dict(_pairs(values).collect()) for values in (labelled, ordinary)]

    def logs(table: dict[int, int], uniform: float) -> list[float]:
        """Log-probabilities of the second character of each pair; rare first characters fall back on all characters."""
        totals, singles = [0] * SIZE, [0.05] * SIZE
        for pair, n in table.items():
            totals[pair // SIZE] += n
            singles[pair % SIZE] += n
        every = sum(totals) + 0.05 * SYMBOLS
        fitted = [(table.get(pair, 0) + singles[pair % SIZE] / every) / (totals[pair // SIZE] + 1) for pair in range(SIZE * SIZE)]
        return [math.log(uniform / SYMBOLS + (1 - uniform) * p) for p in fitted]

    random, plain_words = logs(counts[0], 0.5), logs(counts[1], 0.02)
    return Model([round(a - b, 4) for a, b in zip(random, plain_words, strict=True)], least, each, different)


def score(value: Column, model: Model) -> Column:
    """Log-likelihood ratio of a string of ASCII characters."""
    table = F.split(F.lit(",".join(map(str, model.ratios))), ",").cast("array<double>")  # a constant to the optimizer
    chars = F.transform(F.split(value, ""), F.ascii)
    pair = lambda c, i: F.get(c, i - 1) * SIZE + F.get(c, i)
    scored = F.transform(F.array(chars), lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda total, i: total + F.get(table, pair(c, i))))
    return F.element_at(scored, 1)


def is_secret(value: Column, model: Model) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= model.different
    return varied & (score(value, model) >= F.greatest(F.lit(model.least), model.each * F.length(value)))


def scan(docs: DataFrame, keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """docs' columns named in `keep` (all by default), and assign, access, hex, random: arrays of (start, end, value).

    Offsets are code points, ends exclusive. Each kind's spans are leftmost and do not overlap; spans of different kinds
    may, but random ones never overlap others. Null and empty texts have none. Repeated rows repeat their result; no rows
    give none; `text` itself stays unchanged. Without a model one is trained on docs.
    """
    keep = docs.columns if keep is None else keep
    clash = {k: f"_kept_{i}" for i, k in enumerate(keep)}
    rows = docs.select(*[F.col(k).alias(v) for k, v in clash.items()], "text")
    found = checkpoint(base_spans(rows, list(clash.values())).drop("text"))
    model = train(found, docs.select(F.col("text").cast("string"))) if model is None else model
    added = F.filter("tokens", lambda t: is_secret(t["value"], model))
    return found.select(*[F.col(v).alias(k) for k, v in clash.items()], *KINDS, added.alias(ADDED))


def redacted(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """docs with every span of any kind in text replaced by `mark`; overlapping spans share one mark, null texts stay null."""
    kept = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    rows = base_spans(docs.select(*[F.col(c).alias(k) for c, k in kept.items()], "text"), list(kept.values()))
    added = F.filter("tokens", lambda t: is_secret(t["value"], model))
    spans = F.array_sort(F.transform(F.concat(*KINDS, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def marked(chars: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            # A span that starts inside the one before adds nothing; else the text between both and a mark.
            between = F.concat(F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), ""), F.lit(mark))
            return F.greatest(at, s["end"]), F.when(s["start"] < at, F.lit("")).otherwise(between)

        reach = F.array_max(F.transform("_spans", lambda s: s["end"]))
        rest = F.array_join(F.slice(chars, reach + 1, F.greatest(F.size(chars) - reach, F.lit(0))), "")
        return F.concat(F.array_join(_scan(F.col("_spans"), F.lit(0), "array<string>", step), ""), rest)

    clean = _once(F.split("text", ""), marked)
    rows = rows.withColumn("_spans", spans)
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col(kept["text"]))
    return rows.select(*[(text if c == "text" else F.col(k)).alias(c) for c, k in kept.items()])


def _sortable(kind: str, order: int) -> Column:
    return F.transform(kind, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(kinds: list[str]) -> Column:
    """kind:start:end of the spans of all kinds by start, then by kind as listed, comma-joined."""
    listed = F.concat(*[_sortable(kind, order) for order, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
