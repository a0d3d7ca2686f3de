"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass their own validation are permuted within their format by a keyed Feistel network: a card number
becomes another valid card number with the same separators, a date another date. The same value always becomes the same
pseudonym, however it is written, so records stay linked across documents; without the key the permutation cannot be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: Fixed formats, tried in this order at each place.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"
ADDRESS = r"(?:\d{1,3}\.){3}\d{1,3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
SOCIAL = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
KINDS = {"email": EMAIL, "address": ADDRESS, "date": DATE, "social": SOCIAL, "card": CARD, "phone": PHONE}
_EDGES = r"(?<![A-Za-z0-9.+@-])(?:{})(?![A-Za-z0-9@-]|\.\d)"
#: Digit groups in a row that may hold a card beside other numbers; a group that belongs to something else ends it. Possessive: long runs need no stack.
_GROUP = r"\d++(?![A-Za-z@]|[./]\d|[._%+-][A-Za-z0-9._%+-]{0,63}@)"
RUN = rf"(?<![A-Za-z0-9.+@-])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -]{_GROUP})*+"
#: Groupings of cards, by their number of groups in the order tried: a security code after a card is not joined on.
GROUPINGS = {1: r"\d{13,19}", 4: r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{3}[ -]\d{3}[ -]\d{3}", 3: r"\d{4}[ -]\d{6}[ -]\d{4,5}",
             2: r"\d{8}[ -]\d{8}|\d{6}[ -]\d{13}", 5: r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,3}"}
FOUND = "|".join([*(_EDGES.format(KINDS[k]) for k in ("email", "address", "date", "social")), RUN, _EDGES.format(PHONE)])
INSIDE = _EDGES.format("|".join(f"(?:{KINDS[k]})" for k in ("date", "social", "phone")))
HINT = r"\d[ ./-]?\d[ ./()-]{0,2}\d|@"
#: Days of 1900 to 2099 as a product, so that both halves of the network have whole ranges.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)


def _feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, label: Column) -> Column:
    """(left, right) after ROUNDS rounds: a permutation of pairs below the two sizes."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(state: Column, i: Column) -> Column:
        fixed = F.when(i % 2 == 0, state["r"]).otherwise(state["l"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), label, i.cast("string"), fixed.cast("string")), 256)
        moved = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 0, F.pmod(state["l"] + F.pmod(moved, sizes[0]), sizes[0])).otherwise(state["l"]).alias("l"),
                        F.when(i % 2 == 0, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(moved, sizes[1]), sizes[1])).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _once(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value computed once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permuted(symbols: Column, radix: int, key: str, label: str) -> Column:
    """A string of at most 22 symbols 0-9, a-z below the radix, permuted among those of its length."""
    def of(s: Column) -> Column:
        n = F.length(s)
        cut = F.floor(n / 2)
        size = [F.pow(F.lit(float(radix)), k).cast("long") for k in (cut, n - cut)]
        number = lambda part: F.coalesce(F.conv(part, radix, 10).cast("long"), F.lit(0).cast("long"))
        out = _feistel(number(F.substring(s, F.lit(1), cut.cast("int"))), number(F.substring(s, cut.cast("int") + 1, n)), (size[0], size[1]), key, F.concat(F.lit(label), n.cast("string")))
        text = lambda x, k: F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), k.cast("int"), "0")
        return _once(out, lambda o: F.concat(F.when(cut > 0, text(o["l"], cut)).otherwise(""), text(o["r"], n - cut)))

    return _once(symbols, of)


def _refilled(shape: Column, symbols: Column, pattern: str) -> Column:
    """`shape` with its characters of `pattern` replaced, in order, by those of `symbols`."""
    places = F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
                         lambda s, c: F.when(c.rlike(pattern), F.struct((s["n"] + 1).alias("n"), F.concat(s["out"], F.substring(symbols, s["n"] + 1, F.lit(1))).alias("out")))
                         .otherwise(F.struct(s["n"].alias("n"), F.concat(s["out"], c).alias("out"))))
    return places["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _check_digit(body: Column) -> Column:
    """Luhn check digit of a string of digits."""
    total = F.aggregate(F.transform(F.reverse(F.split(body, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int"))),
                        F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _luhn(digits: Column) -> Column:
    return _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))


def _card(value: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        return F.when(_luhn(digits), _once(
            _permuted(body, 10, key, "card"), lambda p: _refilled(value, F.concat(p, _check_digit(p)), r"\d")))

    return _once(_digits(value), of)


def _date(value: Column, key: str) -> Column:
    day = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd/MM/yyyy"), F.try_to_date(value, "dd.MM.yyyy"))
    form = F.when(value.contains("-"), "yyyy-MM-dd").when(value.contains("."), "dd.MM.yyyy").when(F.try_to_date(value, "MM/dd/yyyy").isNotNull(), "MM/dd/yyyy").otherwise("dd/MM/yyyy")

    def of(n: Column) -> Column:
        a, b = F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long")
        moved = _feistel(F.floor(n / DAYS[1]), F.pmod(n, F.lit(DAYS[1])), (a, b), key, F.lit("date"))
        new = _once(moved, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), (m["l"] * DAYS[1] + m["r"]).cast("int")))
        return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), F.when(form == "yyyy-MM-dd", F.date_format(new, "yyyy-MM-dd")).when(
            form == "dd.MM.yyyy", F.date_format(new, "dd.MM.yyyy")).when(form == "MM/dd/yyyy", F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy")))

    return _once(F.datediff(day, F.lit(FIRST_DAY).cast("date")), of)


def _address(value: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        byte = lambda i: F.element_at(p, i).cast("long")
        size = F.lit(65_536).cast("long")
        moved = _feistel(byte(1) * 256 + byte(2), byte(3) * 256 + byte(4), (size, size), key, F.lit("address"))
        half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
        return F.when(F.forall(p, lambda b: b.cast("int") < 256), _once(moved, lambda m: F.concat_ws(".", half(m["l"]), half(m["r"]))))

    return _once(F.split(value, r"\."), of)


def _email(value: Column, key: str) -> Column:
    """The name's letters and digits, at most 22 at a time, as digits of base 36; the domain stays."""
    def of(name: Column) -> Column:
        symbols = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
        runs = F.regexp_extract_all(symbols, F.lit(r"[a-z0-9]{1,20}"), F.lit(0))
        moved = F.array_join(F.transform(runs, lambda s: _permuted(s, 36, key, "email")), "")
        return F.concat(_refilled(name, moved, "[A-Za-z0-9]"), F.lit("@"), F.substring_index(value, "@", -1))

    return _once(F.substring_index(value, "@", 1), of)


def pseudonym(value: Column, key: str) -> Column:
    """(kind, text) of a found value; kind is null and the text unchanged where the value fails its validation."""
    numbers = lambda label: _once(_digits(value), lambda d: _refilled(value, _permuted(d, 10, key, label), r"\d"))
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    phone = F.concat(country, _once(F.substring(value, F.length(country) + 1, F.length(value)), lambda rest: _refilled(rest, _permuted(_digits(rest), 10, key, "phone"), r"\d")))
    ways = {"email": _email(value, key), "address": _address(value, key), "date": _date(value, key),
            "social": F.when(~value.rlike("^(000|666|9)|-00-|-0000$"), numbers("social")), "card": _card(value, key), "phone": phone}
    chosen = F.lit(None).cast("struct<kind:string,text:string>")
    for kind, pattern in reversed(KINDS.items()):
        made = F.struct(F.lit(kind).alias("kind"), ways[kind].alias("text"))
        chosen = F.when(value.rlike(f"^(?:{pattern})$"), made).otherwise(chosen)
    return _once(chosen, lambda c: F.when(c["text"].isNotNull(), c).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))))


def _with_gaps(text: Column, pattern: str, key: str) -> Column:
    """Array of (kind, text): what `pattern` finds, and unchanged what lies between."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: pseudonym(m, key))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.lit(None).cast("string").alias("kind"), g.alias("text")))
    return F.filter(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("new")), lambda z: F.array(z["gap"], z["new"]))), lambda x: x.isNotNull())


def _around_cards(run: Column) -> Column:
    """The run cut in pieces: what stands before a valid card in one of the GROUPINGS, the card, and so on from the left; the last is no card."""
    def joined(groups: Column, at: Column, many: Column) -> Column:
        return F.array_join(F.slice(groups, at, many), "")

    def of(groups: Column) -> Column:
        size, card = F.size(groups), lambda at, many: F.struct(at.alias("at"), many.alias("many"))

        def valid(i: Column, k: Column) -> Column:
            return _once(F.regexp_replace(joined(groups, i, k), "^[ -]", ""), lambda t: F.when(
                F.coalesce(*(F.when(k == n, t.rlike(f"^(?:{g})$")) for n, g in GROUPINGS.items())), _luhn(_digits(t))).otherwise(False))

        def step(state: Column, i: Column) -> Column:
            many = F.when((i >= state["next"]) & (F.length(F.element_at(groups, i)) >= 4), F.get(F.filter(
                F.array(*map(F.lit, GROUPINGS)), lambda k: (i + k - 1 <= size) & valid(i, k)), F.lit(0)))
            return _once(many, lambda n: F.when(n.isNotNull(), F.struct((i + n).alias("next"), F.concat(state["cards"], F.array(card(i, n))).alias("cards"))).otherwise(state))

        none = F.struct(F.lit(1).alias("next"), F.from_json(F.lit("[]"), "array<struct<at:int,many:int>>").alias("cards"))
        found = F.concat(F.aggregate(F.sequence(F.lit(1), size), none, step)["cards"], F.array(card(size + 1, F.lit(0))))

        def pieces(cards: Column) -> Column:
            def two(c: Column, j: Column) -> Column:
                start = F.when(j == 0, 1).otherwise(_once(F.get(cards, j - 1), lambda before: before["at"] + before["many"]))
                between = F.concat(_once(start, lambda at: joined(groups, at, c["at"] - at)), F.regexp_extract(joined(groups, c["at"], F.lit(1)), "^[ -]?", 0))
                return F.array(between, F.regexp_replace(joined(groups, c["at"], c["many"]), "^[ -]", ""))

            return F.slice(F.flatten(F.transform(cards, two)), F.lit(1), 2 * F.size(cards) - 1)

        return _once(found, pieces)

    return _once(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0)), of)


def pseudonyms(value: Column, key: str) -> Column:
    """Array of (kind, text) that stands for a found value. A run of digit groups is searched for cards by grouping, then
    between them for the other kinds; a run with neither is taken for one number."""
    def of(parts: Column) -> Column:
        inner = F.flatten(F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.array(pseudonym(part, key))).otherwise(_with_gaps(part, INSIDE, key))))
        return _once(inner, lambda x: F.when(F.exists(x, lambda y: y["kind"].isNotNull()), x).otherwise(F.array(pseudonym(value, key))))

    return F.when(value.rlike("^[0-9 -]+$"), _once(_around_cards(value), of)).otherwise(F.array(pseudonym(value, key)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised, and found: an array of (kind, text) of the pseudonyms in order.

    A card is found beside other numbers if it is unbroken or in one of the GROUPINGS; other groupings only by themselves.
    Validated are: addresses of four bytes, dates of 1900 to 2099, social security numbers, card numbers (Luhn), phone numbers
    by format, and the names of e-mail addresses. Null texts stay null, texts without such values unchanged, both with an
    empty array. Repeated rows repeat their result; no rows give none; other columns stay, but `found` is replaced.
    """
    text = F.col("text").cast("string")
    parts = F.split(text, FOUND, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda m: pseudonyms(m, key))
    none = F.from_json(F.lit("[]"), "array<array<struct<kind:string,text:string>>>")
    rows = docs.drop("found").withColumn("_new", F.when(text.rlike(HINT), new).otherwise(none))
    joined = F.array_join(F.transform(F.arrays_zip(parts.alias("gap"), F.transform("_new", lambda n: F.array_join(F.transform(n, lambda x: x["text"]), "")).alias("new")),
                                      lambda z: F.concat(z["gap"], F.coalesce(z["new"], F.lit("")))), "")
    return rows.withColumn("text", F.when(F.size("_new") > 0, joined).otherwise(text)).withColumn(
        "found", F.filter(F.flatten(F.coalesce("_new", none)), lambda n: n["kind"].isNotNull())).drop("_new")
