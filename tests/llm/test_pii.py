import datetime
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from monthloom.llm.pii import _CENTURY, PATTERNS, luhn_valid, permuted_digits, pseudonymise


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def one(spark, text, key="k"):
    return pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first()


def test_digit_strings_are_permuted(spark):
    for n in (2, 3, 4):
        df = spark.range(10 ** n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = [r[0] for r in df.select(permuted_digits(F.col("d"), "k", "t")).collect()]
        assert sorted(got) == [str(i).zfill(n) for i in range(10 ** n)]


def test_luhn(spark):
    rng = random.Random(1)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(13, 20))) for _ in range(500)]
    got = spark.createDataFrame([(n,) for n in numbers], "d string").select("d", luhn_valid(F.col("d")).alias("v")).collect()
    assert all(r.v == luhn(r.d) for r in got)


def test_cards_stay_valid_and_linked(spark):
    r = one(spark, "4111 1111 1111 1111, 4111-1111-1111-1111; 4111111111111112 x4111111111111111")
    spaced, dashed = r.text[:19], r.text[21:40]
    assert luhn(spaced.replace(" ", "")) and spaced.replace(" ", "") == dashed.replace("-", "") != "4111111111111111"
    assert r.text.endswith("; 4111111111111112 x4111111111111111") and r.n_card == 2


def test_neighbouring_numbers_are_told_apart(spark):
    r = one(spark, "4952935900253052 4111111111111111 3782 822463 10005")
    first, second, *third = r.text.split(" ")
    assert r.n_card == 3 and luhn(first) and luhn(second) and luhn("".join(third))


def test_dates_are_permuted_within_their_century(spark):
    for century, (first, a, b) in _CENTURY.items():
        days = spark.range(a * b).select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"),
                                         F.col("id").alias("doc_id"))
        got = [r.text for r in pseudonymise(days, "k").select("text").collect()]
        assert len(set(got)) == a * b and all(int(t[:2]) == century and datetime.date.fromisoformat(t) for t in got)


def test_kinds(spark):
    r = one(spark, "a.b@mail1.example.com; +1 (017) 555-7713 10.0.0.255, 1.2.3 256.1.1.1 2000-02-30 123-45-6789 000-45-6789.")
    assert (r.n_email, r.n_phone, r.n_ip, r.n_date, r.n_ssn, r.n_card) == (1, 1, 1, 0, 1, 0)
    for gone in ("a.b@", "mail1", "555-7713", "10.0.0.255", "123-45-6789"):
        assert gone not in r.text
    for stays in ("+1 (", "1.2.3", "256.1.1.1", "2000-02-30", "000-45-6789."):
        assert stays in r.text


def test_keys_differ(spark):
    assert one(spark, "+1 (017) 555-7713", "a").text != one(spark, "+1 (017) 555-7713", "b").text


@pytest.mark.parametrize("which", ["odd", "clashing", "small", "none"])
def test_frames(which, request):
    df = request.getfixturevalue(which)
    got = pseudonymise(df, "k")
    before = sorted((r.doc_id or 0, r.text is None, len((r.text or "").split("\n"))) for r in df.select("doc_id", "text").collect())
    assert sorted((r.doc_id or 0, r.text is None, len((r.text or "").split("\n"))) for r in got.select("doc_id", "text").collect()) == before
    changed = got.where("n_email + n_phone + n_ip + n_date + n_ssn + n_card = 0").join(df.select("doc_id", "text"), ["doc_id", "text"], "left_anti")
    assert changed.where("doc_id IS NOT NULL AND text IS NOT NULL").count() == 0


def test_failed_candidates_hide_nothing(spark):
    card, phone = "4111 1111 1111 1111", "+1 555 123 4567"
    texts = [(f"ref 2023 {card}", card, "n_card"), (f"2023-{card.replace(' ', '-')}", card.replace(" ", "-"), "n_card"), (f"{card} 2023", card, "n_card"),
             (f"({card})", card, "n_card"), (f"{phone} 1234 5678", phone, "n_phone"), (f"12 {phone}", phone, "n_phone"),
             (f"12 34 a1b {card} x", card, "n_card"), ("1 2.3 10.0.0.1 7", "10.0.0.1", "n_ip"), ("2023 a.1@b.org 7", "a.1@b.org", "n_email")]
    rows = {r.doc_id: r for r in pseudonymise(spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string"), "k").collect()}
    for i, (text, value, count) in enumerate(texts):
        before, after = text.split(value)
        assert rows[i][count] == 1 and value not in rows[i].text, text
        assert rows[i].text.startswith(before) and rows[i].text.endswith(after), text


def test_long_runs_of_numbers(spark):
    text = "12 " * 20_000 + "4111 1111 1111 1111"
    r = one(spark, text)
    assert r.n_card == 1 and r.text.startswith("12 " * 20_000) and len(r.text) == len(text)


def test_common_forms(spark):
    phones = ["+15551234567", "+442079460958", "555.123.4567", "555 123 4567", "+44 2079460958", "+33 1 23 45 67 89"]
    dates = ["03/12/1985", "12.03.1985", "3-12-1985", "12/31/1985"]
    df = spark.createDataFrame(list(enumerate([f"on {v}, x" for v in phones + dates + ["31/31/1985"]])), "doc_id long, text string")
    rows = sorted(pseudonymise(df, "k").collect())
    for r, v in zip(rows, phones + dates):
        assert (r.n_phone, r.n_date) == ((1, 0) if v in phones else (0, 1)) and v not in r.text, v
    month, day, _ = map(int, rows[len(phones) + 3].text[3:-3].split("/"))
    assert month <= 12 < day and rows[-1].n_date == 0 and "31/31/1985" in rows[-1].text


def test_a_phone_is_linked_over_all_its_forms(spark):
    forms = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "555-123-4567", "(555) 123-4567", "555.123.4567"]
    british = ["+442079460958", "+44 20 7946 0958", "+44 2079460958"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(forms + british)], "doc_id long, text string")
    got = ["".join(c for c in r.text if c.isdigit()) for r in sorted(pseudonymise(df, "k").collect())]
    assert len({d[-10:] for d in got[:6]}) == 1 and got[0][-10:] != "5551234567" and got[0][0] == "1"
    assert len(set(got[6:])) == 1 and got[6][:2] == "44"


def test_ssns_stay_valid_and_different(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.format_string(
        "%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.floor(F.col("id") / 3) + 1).alias("text")).where("text NOT LIKE '666%'")
    got = [r.text for r in pseudonymise(df, "k").select("text").collect()]
    assert len(set(got)) == df.select("text").distinct().count()
    assert all(regex.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", t) for t in got)


def test_cards_of_nineteen_digits(spark):
    body = "411111111111111111"
    digits = next(body + c for c in "0123456789" if luhn(body + c))
    card = " ".join(digits[i:i + 4] for i in range(0, 19, 4))
    r = one(spark, f"pay {card}, ok")
    new = r.text[4:-4].replace(" ", "")
    assert r.n_card == 1 and len(new) == 19 and luhn(new) and new[-3:] != digits[-3:]


# ---- brute force: one position after the other, in plain Python ------------------------------------------


def feistel(x, y, a, b, kind):
    for i in range(1, 9):
        added = int(hashlib.sha256(f"k:{kind}:{i}:{y}".encode()).hexdigest()[:15], 16)
        x, y, a, b = y, (x + added % a) % a, b, a
    return x, y


def permuted(digits, kind):
    half = len(digits) // 2
    x, y = feistel(int(digits[:half]), int(digits[half:]), 10 ** half, 10 ** (len(digits) - half), kind)
    return str(x).zfill(half) + str(y).zfill(len(digits) - half)


def refill(match, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in match)


def moved(date):
    first, a, b = _CENTURY[date.year // 100]
    start = datetime.date.fromisoformat(first)
    x, y = feistel(*divmod((date - start).days, b), a, b, "date" + first)
    return start + datetime.timedelta(x * b + y)


def day(year, month, day):
    try:
        return datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None


def ssn_ok(d):
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def replaced(kind, m):
    """The pseudonym of a candidate, or None if it isn't valid."""
    digits = "".join(c for c in m if c.isdigit())
    if kind == "phone":
        country = regex.match("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}", digits)[0] if m[0] == "+" else ""
        return refill(m, country + permuted(digits[len(country):], "phone")) if 7 <= len(digits) <= 15 else None
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        if not ssn_ok(digits):
            return None
        digits = permuted(digits, "ssn")
        while not ssn_ok(digits):
            digits = permuted(digits, "ssn")
        return refill(m, digits)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or not luhn(digits):
            return None
        body = permuted(digits[:-1], "card")
        return refill(m, next(body + c for c in "0123456789" if luhn(body + c)))
    one, two, three = regex.split("[/.-]", m)
    sep, padded = regex.search("[/.-]", m)[0], regex.match("[0-9]{2}.[0-9]{2}.", m)
    if len(one) == 4:
        return moved(day(one, two, three)).isoformat() if day(one, two, three) else None
    date, month_first = day(three, two, one), False
    if not date:
        date, month_first = day(three, one, two), True
    if not date:
        return None
    date = moved(date)
    while month_first and date.day <= 12:
        date = moved(date)
    parts = [date.month, date.day] if month_first else [date.day, date.month]
    return sep.join([str(p).zfill(2) if padded else str(p) for p in parts] + [str(date.year)])


def plain(text):
    compiled = [(kind, regex.compile(p)) for kind, ps in PATTERNS.items() for p in ps]
    out, at, counts = [], 0, dict.fromkeys(PATTERNS, 0)
    while at < len(text):
        new = None
        for kind, pattern in compiled:
            if m := pattern.match(text, at):
                if kind == "email":
                    name, host = m[0].lower().split("@")
                    new = (f"u{hashlib.sha256(f'k:name:{name}:{host}'.encode()).hexdigest()[:24]}"
                           f"@h{hashlib.sha256(f'k:host:{host}'.encode()).hexdigest()[:20]}.example")
                else:
                    new = replaced(kind, m[0])
                if new is not None:
                    break
        if new is None:
            out.append(text[at])
            at += 1
        else:
            out.append(new)
            counts[kind] += 1
            at = m.end()
    return "".join(out), list(counts.values())


def test_against_brute_force(spark, small):
    extra = ["call +1 (017) 555-7713 or 10.0.0.255, born 31.12.1985 or 12/31/1985, a.b@c.example.org 123-45-6789 4111 1111 1111 1111",
             "2023 4111 1111 1111 1111 2023-01-02 +44 20 7946 0958 000-45-6789 +15551234567 1234 5678", "", "no numbers"]
    df = small.select("doc_id", "text").where("text IS NOT NULL").union(
        spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = pseudonymise(df, "k").collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_phone + r.n_card for r in got) > 10
    for r in got:
        text, counts = plain(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in PATTERNS] == counts and r.text == text, r.doc_id
