import random
import re

from pyspark.sql import functions as F

from quillsift.functions import email, pan
from quillsift.functions.text import normalize
from quillsift.operators import results


def luhn_number(rng, prefix, n):
    body = prefix + "".join(rng.choice("0123456789") for _ in range(n - len(prefix) - 1))
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(body)))
    return body + str(-total % 10)


def numbers(rng, count):
    kinds = [("visa", "4", 16, (4, 8, 12)), ("mc", "5", 16, (4, 8, 12)), ("discover", "6011", 16, (4, 8, 12)), ("amex", "37", 15, (4, 10)), ("jcb", "35", 16, ())]
    for _ in range(count):
        brand, prefix, n, cuts = rng.choice(kinds)
        number = luhn_number(rng, prefix + str(rng.randint(1, 5)) if brand == "mc" else prefix, n)
        for at in reversed(cuts):
            number = number[:at] + rng.choice(["", " ", "-"]) + number[at:]
        yield brand, number


def test_every_valid_number_is_found_and_hidden(spark):
    rng = random.Random(11)
    cases = list(numbers(rng, 300))
    rows = spark.createDataFrame([(k, f"x {n} y", b) for k, (b, n) in enumerate(cases)], "k int, text string, brand string")
    for r in rows.select("k", "brand", pan.find(F.col("text")).alias("m")).collect():
        number = cases[r["k"]][1]
        (hit,) = r["m"]
        assert hit["key"] == r["brand"] and len(hit["value"]) == len(number)
        digits = re.sub("[^0-9*]", "", hit["value"])
        plain = re.sub("[^0-9]", "", number)
        assert digits == plain[:6] + "*" * (len(plain) - 10) + plain[-4:]
        assert [c for c in hit["value"] if c in " -"] == [c for c in number if c in " -"]


def test_a_wrong_digit_is_no_number(spark):
    rng = random.Random(12)
    broken = []
    for _, n in numbers(rng, 200):
        at = max(k for k, c in enumerate(n) if c.isdigit())
        broken.append(n[:at] + str((int(n[at]) + rng.randint(1, 9)) % 10))
    rows = spark.createDataFrame([(b,) for b in broken], "text string")
    assert rows.where(F.size(pan.find(F.col("text"))) > 0).count() == 0


def test_addresses_keep_length_and_domain(spark):
    rng = random.Random(13)
    made = ["".join(rng.choice("abcXYZ019+_%") for _ in range(rng.randint(1, 20))) + "@" + rng.choice(["a.co", "mail.example.org", "x-y.z9.net"]) for _ in range(200)]
    rows = spark.createDataFrame([(k, f"<{m}>, ({m})") for k, m in enumerate(made)], "k int, text string")
    for r in rows.select("k", email.find(F.col("text")).alias("m")).collect():
        (hit,) = r["m"]
        local, _, domain = made[r["k"]].partition("@")
        assert hit["value"].endswith("@" + domain) and len(hit["value"]) == len(made[r["k"]]) and hit["value"].partition("@")[0] != local


def test_normalising_twice_changes_nothing(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice("ab \t\n\x1c\x85  é😀") for _ in range(60)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(normalize(normalize(F.col("text"))) != normalize(F.col("text"))).count() == 0
    assert [r[0] for r in rows.select(normalize(F.col("text"))).collect()] == [" ".join(t.split()) for t in texts]


def test_blocks_of_a_file_give_what_the_file_gives(spark):
    rng = random.Random(15)
    words = [n for _, n in numbers(rng, 40)] + [f"user{k}@mail.org" for k in range(30)] + ["word"] * 60
    rng.shuffle(words)
    whole = spark.createDataFrame([("f", 0, " and ".join(words))], "filename string, block int, content string")
    split = spark.createDataFrame([("f", k, w) for k, w in enumerate(words)], "filename string, block int, content string")
    rows = lambda frame: sorted(map(tuple, results.flat(results.findings(frame)).collect()))
    assert rows(whole) == rows(split) and len(rows(whole)) > 40
