import pytest
from pyspark.sql import functions as F

from quillsift.functions import email, pan
from quillsift.functions.registry import detect, register, supported, unregister
from quillsift.functions.text import SPACES, make_chunks, normalize, sizeof_fmt, strip, suffix


def luhn(body):
    """A number of these digits and the checksum."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(body)))
    return body + str(-total % 10)


def grouped(number, gap, cuts=(4, 8, 12)):
    return gap.join(number[a:b] for a, b in zip((0, *cuts), (*cuts, len(number))))


# All numbers are made up here, with a right checksum.
VISA, MC, DISCOVER, JCB, AMEX = luhn("470012345678901"), luhn("530098765432101"), luhn("601113579246801"), luhn("352824681357902"), luhn("37123456789012")
WRONG = VISA[:-1] + str((int(VISA[-1]) + 1) % 10)
PANS = [
    (VISA, {"visa": {f"470012******{VISA[-4:]}"}}),
    (grouped(VISA, " "), {"visa": {f"4700 12** **** {VISA[-4:]}"}}),
    (grouped(VISA, "-"), {"visa": {f"4700-12**-****-{VISA[-4:]}"}}),
    (f"{VISA[:8]}-{VISA[8:]}", {"visa": {f"470012**-****{VISA[-4:]}"}}),
    (WRONG, {}),
    ("no number", {}),
    (f"{VISA}77", {}),
    (grouped(AMEX, "-", (4, 10)), {"amex": {f"3712-34****-*{AMEX[-4:]}"}}),
    (AMEX, {"amex": {f"371234*****{AMEX[-4:]}"}}),
    (grouped(AMEX, " ", (4, 10)), {"amex": {f"3712 34**** *{AMEX[-4:]}"}}),
    (JCB, {"jcb": {f"352824******{JCB[-4:]}"}}),
    (grouped(JCB, " "), {}),
    (grouped(MC, "-"), {"mc": {f"5300-98**-****-{MC[-4:]}"}}),
    (DISCOVER, {"discover": {f"601113******{DISCOVER[-4:]}"}}),
    (f"paid by {VISA}, thanks", {"visa": {f"470012******{VISA[-4:]},"}}),
    (f"stuck{grouped(VISA, ' ')}between", {"visa": {f"k4700 12** **** {VISA[-4:]}b"}}),
    (f"part 1-{VISA} x", {}),
    (f"٣{VISA}", {}),
    (f"{VISA} or {MC}", {"visa": {f"470012******{VISA[-4:]}"}, "mc": {f"530098******{MC[-4:]}"}}),
    ("", {}),
    (None, {}),
]
EMAILS = [
    ("ann@host.net", {"a**@host.net"}),
    ("abcdefghijklmno@mail-server.org", {"abc***********o@mail-server.org"}),
    ("lines@five.io", {"l****@five.io"}),
    ("x@y.zz", {"*@y.zz"}),
    ("one.two.three@a.b.c.museum", {"one*********e@a.b.c.museum"}),
    ("plus+tag_under@host.net", {"plu**********r@host.net"}),
    ("Write to office@host.net before noon.", {"o****e@host.net"}),
    ("first (kim@host.net), then lee@host.net; nobody else", {"k**@host.net", "l**@host.net"}),
    ('say "abc"@host.net', {'"****@host.net'}),
    ("nothing here", set()),
    ("half@, @half.net, bare words", set()),
    ("top level in figures: who@1.23", set()),
    ("dots..twice@c.net .front@y.net", {"t****@c.net", "f****@y.net"}),
    ("u@[1.2.3.4] v@ok.net", {"*@ok.net"}),
    ("", set()),
    (None, set()),
]


def _rows(spark, cases, column):
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, text string")
    return [r["out"] for r in frame.select("k", column(F.col("text")).alias("out")).orderBy("k").collect()]


def test_pan_vectors(spark):
    for (text, want), got in zip(PANS, _rows(spark, [p[0] for p in PANS], lambda c: pan.find(c))):
        found = {}
        for m in got or []:
            found.setdefault(m["key"], set()).add(m["value"])
        assert found == want, text


def test_email_vectors(spark):
    for (text, want), got in zip(EMAILS, _rows(spark, [e[0] for e in EMAILS], lambda c: email.find(c))):
        assert {m["value"] for m in got or []} == want, text
        assert all(m["key"] == "email" for m in got or [])


def test_email_validity(spark):
    cases = {
        "a@b.net": True, "many.parts+tag99@sub-domain.host.net": True, "no at sign": False, "@b.net": False, "a@": False, "a@@b.net": False, "a@b.net@c.net": False, "": False, "words before a@1.23": False,
        f"a@{'d' * 63}.net": True, f"a@{'d' * 64}.net": False, "a@b.0net": False, f"a@{'abc.' * 63}net": False, f"a@{'abc.' * 62}net": True, f"{'l' * 65}@b.net": False, f"{'l' * 64}@b.net": True,
    }
    assert _rows(spark, list(cases), lambda c: email.is_valid(c)) == list(cases.values())


def test_email_redaction_rules(spark):
    """By the length of the local part: 1, 2 to 5, 6 to 9, more."""
    def shown(n):
        return "*" if n == 1 else "a" + "*" * (n - 1) if n <= 5 else "a" + "*" * (n - 2) + "z" if n < 10 else "abc" + "*" * (n - 4) + "z"

    cases = {("abc" + "m" * 30)[: n - 1] + "z" + "@host.net": shown(n) + "@host.net" for n in range(2, 25)} | {"a@host.net": "*@host.net", "plain": "plain"}
    assert _rows(spark, list(cases), lambda c: email.redact(c)) == list(cases.values())


def test_last_per_brand_and_lookaround(spark):
    other = luhn("499911122233344")
    text = f"{VISA} and {other} then {AMEX}"
    assert [m["value"] for m in _rows(spark, [text], lambda c: pan.find(c, mode="last_per_brand"))[0]] == [f"499911******{other[-4:]}", f"371234*****{AMEX[-4:]}"]
    close = f"{VISA} {other}"
    assert len(_rows(spark, [close], lambda c: pan.find(c))[0]) == 1
    assert len(_rows(spark, [close], lambda c: pan.find(c, lookaround=True))[0]) == 2


@pytest.mark.parametrize("text", ['"' + "a" * 30000, "a" * 60000 + "@", ("a." * 20000) + "@x", "x@" + "a." * 20000 + "com", "@" * 5000, "[" * 3000 + "@", "x@[1.1.1." + "a:" * 4000])
def test_hostile_texts_end(spark, text):
    assert len(_rows(spark, [text], lambda c: email.candidates(c))) == 1


def test_normalize(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
    assert len(spaces) == 29 and len(spaces.split()) == 0
    cases = [f"{s}a{s}{s}b{s}" for s in spaces] + ["", "​x"]
    assert _rows(spark, cases, normalize) == [" ".join(c.split()) for c in cases]


def _chunks(s, size):
    words = s.split()
    words = [w for w in words if len(w) <= size] + [w[i : i + size] for w in words if len(w) > size for i in range(0, len(w), size)]
    out, now = [], ""
    for w in words:
        now += w + " "
        if len(now) >= size:
            out.append(now.strip())
            now = ""
    return out + ([now.strip()] if now else [])


def test_make_chunks(spark):
    import random

    random.seed(5)
    cases = ["only a few words", "x" * 700, "", "word " * 400] + [" ".join("w" * random.randint(1, 40) for _ in range(200)) for _ in range(5)]
    for size in (650, 20, 5, 2):
        assert _rows(spark, cases, lambda c: make_chunks(c, size)) == [_chunks(c, size) for c in cases]


def test_small_functions(spark):
    assert _rows(spark, ["0", "1023", "1024", "1536", "1073741824", "-2048"], lambda c: sizeof_fmt(c.cast("long"))) == ["0.0B", "1023.0B", "1.0KB", "1.5KB", "1.0GB", "-2.0KB"]
    assert _rows(spark, ["/a/b.txt", "/a/.bashrc", "/a.d/b", "/a/b.tar.gz", "/a/b."], suffix) == [".txt", "", "", ".gz", ""]


def test_registry(spark):
    register("shout", "Shouting", lambda text, mode, lookaround: F.transform(F.regexp_extract_all(text, F.lit("[A-Z]{5,}"), F.lit(0)), lambda m: F.struct(F.lit("word").alias("key"), m.alias("value"))))
    got = _rows(spark, ["HELLO to a@b.co"], lambda c: detect(c, ["email", "shout"]))[0]
    assert "shout" in supported()
    unregister("shout")
    assert "shout" not in supported()
    assert [(m["datatype"], m["key"], m["value"]) for m in got] == [("Email Address", "email", "*@b.co"), ("Shouting", "word", "HELLO")]


def test_numbers_are_sought_near_digits_only(spark):
    """Text far from digits goes before the brands' patterns run; what they find, and which neighbours they consume, stays."""
    near = pan.near_digits(F.col("c"))
    rows = spark.createDataFrame([("far from it 12, x - 34 and so on",), ("x4700123456789010y4700123456789010z",), ("none",), ("",), (None,)], "c string").select(near).collect()
    assert [r[0] for r in rows] == ["f 12, 34 n", "x4700123456789010y4700123456789010z", "ne", "", None]
    assert "regexp_replace" in str(pan.candidates(F.col("c"), "amex")) and "aggregate(" not in str(pan.redact(F.col("c")))


@pytest.mark.parametrize("brand,number", [("visa", VISA), ("jcb", JCB)])
def test_redaction_by_place(spark, brand, number):
    """Only the digits between the first six and the last four are masked, whatever stands between and around them, by any mask."""
    rows = spark.createDataFrame([(f"x{number[:4]} {number[4:]}y",), ("1234567890",), ("no digits",), (None,)], "c string").select(pan.redact(F.col("c"), "$1"), pan.redact(F.col("c"))).collect()
    hidden = len(number) - 10
    assert [r[0] for r in rows] == [f"x{number[:4]} {number[4:6]}{'$1' * hidden}{number[-4:]}y", "1234567890", "no digits", None]
    assert rows[0][1] == f"x{number[:4]} {number[4:6]}{'*' * hidden}{number[-4:]}y" and "aggregate(" not in str(pan.redact(F.col("c")))


def _redacted(text):
    """Redaction character by character."""
    n, seen, out = sum(c in "0123456789" for c in text), 0, []
    for c in text:
        seen += c in "0123456789"
        out.append("*" if c in "0123456789" and 6 < seen <= n - 4 else c)
    return "".join(out)


def test_redaction_takes_one_pattern(spark):
    """Each pattern is a pass over every number of a table."""
    assert str(pan.redact(F.col("c"))).count("regexp") == 1
    texts = ["", "x", "123456789", "1234567890", "12345678901", "x1234-5678-9012-3456\n", "1 2 3 4 5 6\n7 8 9 0 1 2", "4" * 40, "--".join("9876543210123"), "\u0664" * 12, "1234567\u06648901 2", "\U0001f4b3371234 567890 12345\U0001f4b3"]
    assert _rows(spark, texts, lambda c: pan.redact(c)) == [_redacted(t) for t in texts]


@pytest.mark.parametrize("brand", list(pan.BRANDS))
def test_texts_without_numbers_are_not_normalized(spark, brand):
    from quillsift.plans import queries

    plan = queries.QUERIES[f"pan_{brand}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
    number = {"visa": VISA, "jcb": JCB, "amex": AMEX, "mc": MC, "discover": DISCOVER}[brand]
    cuts = {"amex": (4, 10), "jcb": ()}.get(brand, (4, 8, 12))
    texts = [grouped(number, gap, cuts) for gap in ("", "-", " ", "\n", " \t\r\n ", "\u00a0\u2003", "\x1c\x85", " - ", "--", "- ", "x")]
    texts += [f"{a}{t}{b}" for t in texts for a, b in (("\n\n", "\n\n"), ("y", "z"), ("y" * 2000, " " * 2000), (f"{'ab ' * 700}", f"  {number}  "))] + ["", "nothing here", "1234 567", None]
    rows = spark.createDataFrame([(t, 0, t) for t in texts], "filename string, block int, content string")
    values = lambda c: pan.candidates(c, brand)
    of = lambda *more: sorted(map(tuple, queries._spread(spark, "", values, "candidate", lambda *_: rows, *more).collect()))
    assert of(pan.may_hold) == of() and of()


def test_candidates_are_stripped_without_a_pattern(spark):
    """A table has as many candidates as rows or more; all 29 characters go at both ends, and none inside."""
    assert len(set(SPACES)) == 29 and not SPACES.split()
    cases = [f"{a}x{a}{b}y{b}" for a, b in zip(SPACES, reversed(SPACES))] + [SPACES + "x" + SPACES, SPACES, "", "\u200bx\u200b", None]
    assert _rows(spark, cases, strip) == [c and c.strip() for c in cases]
    for brand in pan.BRANDS:
        assert str(pan.candidates(F.col("c"), brand)).count("regexp_replace") == 1
    assert "regexp" not in str(strip(F.col("c")))


def test_jcb_looks_for_a_digit_first(spark):
    """Its format has three beginnings, which would be tried at every character; what it finds is what the plain pattern finds."""
    assert "(?=[0-9])" in str(pan.candidates(F.col("c"), "jcb")) and "{4}" not in pan.ANY_RAW
    numbers = [JCB, luhn("21312468135790"), luhn("18002468135790"), luhn("352824681357902")]
    marks = ["", " ", "-", ".", "x", "7", "\u0664", "\n", "\u00a0", "\U0001f4b3", "; "]
    texts = [f"{a}{n}{b}{m}{c}" for n, m in zip(numbers, numbers[1:] + numbers[:1]) for a in marks for b in marks for c in ("", "z")]
    plain = F.transform(F.regexp_extract_all(F.col("text"), F.lit(pan.BEFORE + pan.BRANDS["jcb"] + pan.AFTER), F.lit(0)), strip)
    want = _rows(spark, texts, lambda c: plain)
    assert _rows(spark, texts, lambda c: pan.candidates(c, "jcb")) == want and sum(map(len, want)) > len(texts) // 2
