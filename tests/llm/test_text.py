"""Repetition, encoding, extraction and secrets against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, html, pseudonyms, repetition, secrets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n", "\n\n a\n", "a", "a b a b a b a b a b a b a b a b a b a b", "\x0b\x1c", "é ü\tß", "x" * 50_000]


def texts(n, seed=5):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "日"]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def plain_counts(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    times = Counter(lines)
    out = {"n_words": len(found), "word_chars": sum(map(len, found)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
           "n_dup_lines": len(lines) - len(times), "line_chars": sum(map(len, lines)), "dup_line_chars": sum(len(x) for x in lines if times[x] > 1)}
    for n in (5, 8, 12):
        grams = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]
        times = Counter(grams)
        inside = {i + k for i, gram in enumerate(grams) if times[gram] > 1 for k in range(n)}
        out |= {f"covered_words_{n}": len(inside), f"covered_chars_{n}": sum(len(found[i]) for i in inside)}
    return out


def test_repetition_equals_plain_counts():
    cases = texts(400)
    got = [{k: int(v[i]) for k, v in counts.items()} for chunk in words.chunks(pa.array(cases), most=3_000)
           for counts in [repetition.measure(chunk, (5, 8, 12))] for i in range(chunk.rows)]
    assert got == [plain_counts(t) for t in cases]


def test_repetition_judges_rows_each_for_itself(docs_of):
    clean = " ".join(f"word{i}" for i in range(60))
    twice = " ".join(["one two three four five six seven eight nine ten"] * 6)
    rows = repetition.judged(docs_of((1, clean), (1, clean), (2, twice), (3, None), (4, "a b"), (None, clean))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_failed, r.kept) for r in rows) == [
        (False, 1, False, True), (False, 1, False, True), (False, 2, True, False), (False, 3, True, False), (False, 4, True, False), (True, 0, False, True)]
    assert repetition.judged(docs_of((1, "a")).where("false")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    return path, library.Tokenizer.from_file(path)


def test_automaton_equals_the_library(tokenizer):
    path, library = tokenizer
    encoder = bpe.load(path)
    known = bpe._Known(encoder)
    rng = random.Random(3)
    cases = ["", " \n", "<|endoftext|> a<|startoftext|>b <|endoftext|", "don't WE'LL 'S", "ΣΑΣ İ ﬁ ² 日本 \U0001f642", "a" * 300,
             "hahaha !!!!! ...... 123", "\x1c\x1d x\x00y", "  ą́"]
    cases += ["".join(rng.choice(["a", "e", "t", "th", "ing", " ", "!", "é", "1", "日", "́", "'s", "A", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(known, text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), repr(text)


def test_merge_gadgets_on_a_small_alphabet():
    """Every word over two letters up to length 9, against merging by rank."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "b"), ("aa", "ab"), ("aba", "b")]
    rank = {m: i for i, m in enumerate(merges)}
    vocabulary = {t: i for i, t in enumerate(["a", "b", *["".join(m) for m in merges]])}
    encoder = bpe.Encoder(bpe.Automaton(vocabulary, merges, ""), ".+", {})
    for n in range(1, 10):
        for bits in range(2**n):
            parts = ["ab"[bits >> k & 1] for k in range(n)]
            word = "".join(parts)
            while pairs := [p for p in zip(parts, parts[1:], strict=False) if p in rank]:
                best, out, i = min(pairs, key=rank.get), [], 0
                while i < len(parts):
                    step = 2 if tuple(parts[i : i + 2]) == best else 1
                    out.append("".join(parts[i : i + step]))
                    i += step
                parts = out
            assert encoder.tokens(word) == parts


def test_encoding_of_odd_rows(docs_of, tokenizer):
    rows = bpe.encode(docs_of((1, "the cat"), (1, "the cat"), (2, None), (3, "")), tokenizer[0]).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in rows) == [(1, 2, "the</w> cat</w>")] * 2 + [(2, 0, ""), (3, 0, "")]
    assert bpe.encode(docs_of((1, "a")).where("false"), tokenizer[0], digests=True).count() == 0


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
<div class="cookie-notice">We use cookies on this site, please accept them all.</div><div id=content><div class=post><h2>Title</h2>
<p>First long paragraph with &eacute; some <a href=2>links</a> and <b>bold</b> text that goes on.<p>Second<br>line   of text here, and more.
<ul><li>item one<li>item two</ul></div><aside>Related stories for you to read</aside><div class="comments"><p>Great post, thanks a lot, I
loved it so very much indeed!</p></div></div><form><label>Name</label><input></form><footer>&copy; 2020</footer><script>var a="<p>x</p>";</script>"""


def test_main_text_leaves_the_rest_out(spark):
    expected = "Title\nFirst long paragraph with é some links and bold text that goes on.\nSecond line of text here, and more.\nitem one\nitem two"
    assert html.main_text(PAGE) == expected
    odd = [None, "", "plain", "<p>", "<<<>>>&amp;", "<div><p>a</div>", "<!-- x", "<script>x", "<p>" * 3000]
    assert [html.main_text(p) for p in odd] == ["", "", "plain", "", "<<<>>>&", "a", "", "", ""]
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.n_chars) for r in html.extract(pages).collect()) == [(1, len(expected))] * 2 + [(2, 0)]


def test_main_text_without_semantic_elements():
    menu = "<div>" + "".join(f"<a href={i}>Link {i}</a> " for i in range(12)) + "</div>"
    parts = "".join(f"<div>Paragraph number {i} of the main article, long enough to be read as text.</div>" for i in range(5))
    assert html.main_text(f"<body>{menu}<div>{parts}</div>{menu}</body>").count("Paragraph") == 5
    assert "Link" not in html.main_text(f"<body>{menu}<div>{parts}</div>{menu}</body>")


def prose(word, times, n):
    return f"<p>{f'{word} ' * times}</p>" * n


def test_main_text_keeps_unequal_sections_lists_and_headings():
    menu = "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(12)) + "</ul>"
    article = f"<h1>A heading beside the sections</h1><section>{prose('word', 60, 10)}</section><section><h2>End</h2>{prose('tail', 40, 1)}</section>"
    items = "<ul>" + "<li>item</li>" * 40 + "</ul>"
    for page in (f"<body>{menu}<article>{article}{items}</article></body>", f"<body>{menu}<div>{article}{items}</div>{menu}</body>",
                 f"<body><div>{menu}</div><article>{article}</article><article>{items}</article>{menu}</body>"):
        text = html.main_text(page)
        assert text.startswith("A heading beside the sections\n") and "\nEnd\n" in text and "Link" not in text
        assert (text.count("word"), text.count("tail"), text.count("item")) == (600, 40, 40)


@pytest.mark.parametrize("name", ["overflow-hidden", "content no-sidebar", "elementor-widget elementor-widget-theme-post-content", "has-comments", "share-enabled", "widget", "hidden-xs"])
def test_marks_never_set_the_article_apart(name):
    beside = '<div class="related">Elsewhere</div><div class="main-nav">Elsewhere</div><div id="comments"><article class="comment">Elsewhere</article></div>'
    for body in (prose("word", 60, 4), f"<article>{prose('word', 60, 4)}</article>", f"<main>{prose('word', 60, 4)}</main>"):
        for page in (f'<body><div class="{name}">{body}</div>{beside}</body>', f'<body><form><section id="{name}">{body}{beside}</section></form></body>'):
            text = html.main_text(page)
            assert text.count("word") == 240 and "Elsewhere" not in text
    half = f'<body><div class="{name}">{prose("word", 60, 2)}</div><div>{prose("other", 60, 3)}</div>{beside}</body>'
    assert name == "widget" or html.main_text(half).count("word") == 120


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def secret_cases():
    rng = random.Random(11)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ": ", " ", '"', "'", "abc", "zzzzzz", "AKIA", "ABCD1234", "0123456789abcdef", "f" * 9, "é", "日", "\n", "secret=", "-"]
    return ["password=token: abcdef", "secret: abc token: abcdefgh", "x" * 30, *ODD,
            *["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]]


def test_base_spans_equal_the_plain_scan(docs_of):
    cases = secret_cases()
    found = secrets.scan(docs_of(*enumerate(cases)), keep=["doc_id"])
    got = {r.doc_id: r.spans for r in found.select("doc_id", secrets.joined(list(secrets.KINDS)).alias("spans")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(cases)}


def test_random_strings_are_secrets_and_identifiers_are_not(docs_of, spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["ordinary", "identifierName", "some_snake_case_name", "configuration", "internationalization", "transactionIdentifier"]) for _ in range(40)) for _ in range(60)]
    keys = ["token = " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32)) for _ in range(60)]
    docs = docs_of(*enumerate(prose + keys))
    model = secrets.train(secrets.base_spans(docs, []), docs.select("text"))
    text = "see xKq9vB2nLp7Rt4Wz8YcD1fGh and some_snake_case_name or transactionIdentifierName, ------------------------"
    rows = secrets.scan(docs_of((1, text), (2, None)), ["doc_id"], model).select("doc_id", F.transform("random", lambda s: s["value"]).alias("v")).collect()
    assert sorted((r.doc_id, r.v) for r in rows) == [(1, ["xKq9vB2nLp7Rt4Wz8YcD1fGh"]), (2, [])]
    masked = secrets.redacted(docs_of((1, text + " password=abcdef0123456789abcdef0123"), (2, None), (3, "")), model)
    assert [r.text for r in masked.orderBy("doc_id").collect()] == [
        "see [secret] and some_snake_case_name or transactionIdentifierName, ------------------------ [secret]", None, ""]
    assert masked.columns == docs.columns


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(docs_of):
    text = "card 4111 1111 1111 1111 or 4111111111111111 not 4111111111111112, ip 10.1.2.3 v 1.2.3.4.5, on 2024-02-29 29.02.2024 not 2024-02-30"
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(docs_of((1, text), (2, "again 4111-1111-1111-1111"), (3, None), (4, "plain 12 text"), (5, "")), "k").collect()}
    cards = [f.text for f in rows[1].found if f.kind == "card"]
    assert re.sub(r"\D", "", cards[0]) == cards[1] != "4111111111111111" and luhn(cards[1])
    assert rows[2].text == "again " + "-".join(cards[1][i : i + 4] for i in range(0, 16, 4))
    assert [f.kind for f in rows[1].found] == ["card", "card", "address", "date", "date"]
    day = rows[1].found[3].text
    assert rows[1].found[4].text == ".".join(reversed(day.split("-"))) and re.fullmatch(r"\d{4}-\d\d-\d\d", day)
    assert "4111111111111112" in rows[1].text and "1.2.3.4.5" in rows[1].text and "2024-02-30" in rows[1].text
    assert (rows[3].text, rows[4].text, rows[5].text, rows[3].found) == (None, "plain 12 text", "", [])


def test_numbers_beside_a_card_or_phone_are_not_joined_on(docs_of):
    card, spaced, phone = "4111111111111111", "4111 1111 1111 1111", "555-123-4567"
    alone = [f.text for f in pseudonyms.pseudonymise(docs_of((1, f"{card}, {phone}, 2024-02-29, 3782 822463 10005, 12/27/2024, a@example.com")), "k").first().found]
    rows = [f"card {spaced} 12/27", f"{card} 123", f"2 {card}", f"1234 {spaced}", f"{spaced} 12/27/2024", f"{spaced} {phone}", f"123 {phone}", f"{phone} 4321",
            "5 2024-02-29 12345", f"{spaced} 3782 822463 10005 7", f"{spaced} 12.a@example.com", f"{card} {card}", f"{spaced} 555-12x", "1 2 3 " * 20_000 + spaced]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs_of(*enumerate(rows)), "k").collect()}
    kinds = [[f.kind for f in got[i].found] for i in range(len(rows))]
    assert kinds == [["card"]] * 4 + [["card", "date"], ["card", "phone"], ["phone"], ["phone"], ["date"], ["card", "card"], ["card", "email"], ["card"] * 2, ["card"], ["card"]]
    bare = {re.sub(r"\D", "", x) for x in alone}
    for i, row in enumerate(rows):
        assert all(re.sub(r"\D", "", f.text) in bare for f in got[i].found if f.kind != "email")
        assert card not in re.sub(r"\D", "", got[i].text) and phone not in got[i].text and "a@" not in got[i].text
        assert re.sub("[a-z0-9]", "0", got[i].text) == re.sub("[a-z0-9]", "0", row)
    assert got[0].text.endswith(" 12/27") and got[1].text == f"{alone[0]} 123" and got[2].text == f"2 {alone[0]}"


def test_the_network_is_a_permutation(spark):
    pairs = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert pairs.select(pseudonyms._permuted(F.col("v"), 10, "k", "x").alias("p")).distinct().count() == 1000
    days = spark.range(73_049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(pseudonyms._date(F.col("v"), "k").alias("p")).distinct().count() >= 73_049


def test_digest_of_no_spans():
    assert hashlib.sha256(plain_spans(None).encode()).hexdigest().startswith("e3b0c442")
