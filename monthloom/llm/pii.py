"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass validation are permuted within their own format by a keyed Feistel network over
two digit groups, so equal values have equal pseudonyms in all documents and different values different ones:
card numbers stay Luhn-valid, addresses stay addresses, dates stay dates of their century, separators stay.
Mail addresses become keyed digests in the shape of an address. What fails validation is left alone.

Accepted forms. Phones of 7 to 15 digits: ``+`` and 7 to 15 digits, or ``+``, a country code and groups divided by
space, dot or hyphen; ``(ddd) ddd-dddd`` with or without a country code; ``ddd ddd dddd`` with spaces, dots or
hyphens. Dates of 1900 to 2099: ``yyyy-mm-dd``; day, month, year or month, day, year (day first if both can be) with
``/``, ``.`` or ``-``, with or without leading zeros. Two-digit years and names of months are not recognised.
A phone keeps its country code, and the digits after it are permuted together, so one number has one pseudonym
however it is divided, with or without its country code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import text_or_empty

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
_INTERNATIONAL = r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}"
#: What may be personal data, by kind. Of what begins at one place the first that is valid counts, so longer forms come first.
PATTERNS = {
    "email": [_MAIL],
    "phone": [r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
              r"(?<![\p{L}\p{N}+])\+1[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
              *[rf"{_INTERNATIONAL}(?:[ .-][0-9])?(?:[ .-][0-9]{{2,12}}){{{n}}}(?![0-9])" for n in (5, 4, 3, 2, 1)],
              r"(?<![\p{L}\p{N}+])\+[0-9]{7,15}(?![0-9])",
              r"(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
              *[rf"(?<![\p{{L}}\p{{N}}.-])[0-9]{{3}}{s}[0-9]{{3}}{s}[0-9]{{4}}(?![0-9-]|\.[0-9])" for s in (r"\.", " ")]],
    "ip": [rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9\p{{L}}]|\.[0-9])"],
    "date": [r"(?<![\p{L}\p{N}-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![\p{L}\p{N}-])",
             *[rf"(?<![\p{{L}}\p{{N}}-]|[0-9][/.])[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}(?:19|20)[0-9]{{2}}(?![\p{{L}}\p{{N}}-]|[/.][0-9])" for s in ("/", r"\.", "-")]],
    "ssn": [r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"],
    "card": [r"(?<![\p{L}\p{N}]|(?<![0-9])-)[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}(?![\p{L}\p{N}])",
             r"(?<![\p{L}\p{N}]|(?<![0-9])-)(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])"],
}
_NUMBERS = [p for kind, patterns in PATTERNS.items() if kind != "email" for p in patterns]
#: A mail address, or a run of digit groups with the characters next to it: no number reaches beyond its run.
#: Possessive, as long runs would else overflow the stack of the matcher.
ANY = (rf"{_MAIL}|[\p{{L}}._-[\p{{N}}&&[^0-9]]]?+[+(]*+(?!{_MAIL})[0-9]++"
       rf"(?:(?:[ ./()+-]{{1,3}}+|[\p{{L}}\p{{N}}])(?!{_MAIL})[0-9]++)*+[\p{{L}}\p{{N}}-]?+")
#: A number may begin at a digit group or at a sign before one, and reaches over so many of these at most.
_BEGIN, _REACH = r"(?=[+(])|(?<![0-9])(?=[0-9])", 10
#: Country codes of telephone numbers, of which none begins another.
_COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Numbers that are permuted again while they are not valid, at most so often; one in ten is not.
WALKS = 24
#: Days of a century as two factors: 1900-1999 has 36524, 2000-2099 has 36525.
_CENTURY = {19: ("1900-01-01", 92, 397), 20: ("2000-01-01", 75, 487)}


def _digest(*parts: Column) -> Column:
    """A keyed number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, highs: Column, lows: Column, key: str, kind: str) -> Column:
    """Permute (high, low) within ``highs`` x ``lows`` values; a struct of the new ``x`` and ``y``.

    Each round adds a keyed digest of one part to the other, modulo the other's range; any two ranges do.
    """
    start = F.struct(high.cast("long").alias("x"), low.cast("long").alias("y"), highs.cast("long").alias("a"), lows.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        added = F.pmod(s["x"] + _digest(F.lit(key), F.lit(kind), i.cast("string"), s["y"].cast("string")) % s["a"], s["a"])
        return F.struct(s["y"].alias("x"), added.alias("y"), s["b"].alias("a"), s["a"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of two or more digits, permuted among all strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = F.lit("1")
    out = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n),
                  F.rpad(ten, half + 1, "0"), F.rpad(ten, n - half + 1, "0"), key, kind)
    return F.concat(F.lpad(out["x"].cast("string"), half, "0"), F.lpad(out["y"].cast("string"), n - half, "0"))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_from_last: int) -> Column:
    """Sum of digits where every second one is doubled, beginning ``doubled_from_last`` places before the end."""
    def step(acc: Column, c: Column) -> Column:
        v = c.cast("int") * (F.pmod(acc["i"], F.lit(2)) + 1)
        return F.struct((acc["s"] + v - F.when(v > 9, 9).otherwise(0)).alias("s"), (acc["i"] + 1).alias("i"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(1 - doubled_from_last + 1).alias("i")), step)["s"]


def luhn_valid(digits: Column) -> Column:
    return luhn_sum(digits, 2) % 10 == 0


def _refilled(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced in order."""
    return F.array_join(F.zip_with(F.split(match, "[0-9]", -1), F.split(digits, ""),
                                   lambda gap, d: F.concat(gap, F.coalesce(d, F.lit("")))), "")


def _phone(match: Column, key: str) -> Column:
    digits = digits_of(match)
    country = F.when(F.startswith(match, F.lit("+")), F.regexp_extract(digits, _COUNTRY, 0)).otherwise("")
    return _refilled(match, F.concat(country, permuted_digits(F.substring(digits, F.length(country) + 1, F.length(digits)), key, "phone")))


def ssn_valid(digits: Column) -> Column:
    return ~F.rlike(digits, F.lit("^(?:000|666|9)|^...00|0000$"))


def _ssn(match: Column, key: str) -> Column:
    once = permuted_digits(digits_of(match), key, "ssn")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once,
                         lambda d, _: F.when(ssn_valid(d), d).otherwise(permuted_digits(d, key, "ssn")))
    return _refilled(match, walked)


def _card(match: Column, key: str) -> Column:
    digits = digits_of(match)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(body, 1) % 10, F.lit(10))
    return _refilled(match, F.concat(body, check.cast("string")))


def _ip(match: Column, key: str) -> Column:
    o = F.transform(F.split(match, r"\."), lambda x: x.cast("int"))
    out = feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), F.lit(65536), F.lit(65536), key, "ip")
    return F.concat_ws(".", *[(F.floor(out[h] / 256) if top else out[h] % 256).cast("string") for h in "xy" for top in (1, 0)])


def _dated(match: Column, year: int, month: int, day: int) -> Column:
    """The date whose parts stand at these places of ``match``, null if there is none."""
    part = F.split(match, "[/.-]")
    return F.try_to_date(F.concat_ws("-", F.get(part, year), F.lpad(F.get(part, month), 2, "0"), F.lpad(F.get(part, day), 2, "0")), "yyyy-MM-dd")


def _moved(date: Column, key: str) -> Column:
    """Another day of the same century."""
    def within(first: str, a: int, b: int) -> Column:
        days = F.datediff(date, F.lit(first).cast("date"))
        out = feistel(F.floor(days / b), days % b, F.lit(a), F.lit(b), key, "date" + first)
        return F.date_add(F.lit(first).cast("date"), (out["x"] * b + out["y"]).cast("int"))
    return F.when(F.year(date) < 2000, within(*_CENTURY[19])).otherwise(within(*_CENTURY[20]))


def _date(match: Column, key: str) -> Column:
    """Year first, else day first, else month first; what is month first stays so, with a day above 12."""
    sep, iso, day_first = F.regexp_extract(match, "[/.-]", 0), F.rlike(match, F.lit("^[0-9]{4}")), _dated(match, 2, 1, 0)
    padded = F.rlike(match, F.lit("^[0-9]{2}.[0-9]{2}."))

    def written(date: Column, *order: str) -> Column:
        return F.when(padded, F.concat_ws("/", *[F.date_format(date, p) for p in order])).otherwise(
            F.concat_ws("/", *[F.date_format(date, p[:1] if p != "yyyy" else p) for p in order]))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), _moved(_dated(match, 2, 0, 1), key),
                         lambda d, _: F.when(F.day(d) > 12, d).otherwise(_moved(d, key)))
    slashed = F.when(day_first.isNotNull(), written(_moved(day_first, key), "dd", "MM", "yyyy")).otherwise(written(walked, "MM", "dd", "yyyy"))
    return F.when(iso, F.date_format(_moved(F.to_date(match), key), "yyyy-MM-dd")).otherwise(F.replace(slashed, F.lit("/"), sep))


def _email(match: Column, key: str) -> Column:
    name, host = F.substring_index(F.lower(match), "@", 1), F.substring_index(F.lower(match), "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("name"), name, host), 256), 1, 24), F.lit("@h"),
                    F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("host"), host), 256), 1, 20), F.lit(".example"))


def kind_of(match: Column) -> Column:
    """The kind of a candidate that passes validation, else null."""
    digits = F.length(digits_of(match))
    return (F.when(F.contains(match, F.lit("@")), "email")
            .when(F.rlike(match, F.lit(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")), "ip")
            .when(F.rlike(match, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.when(F.try_to_date(match, "yyyy-MM-dd").isNotNull(), "date"))
            .when(F.rlike(match, F.lit(r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}$")),
                  F.when(F.coalesce(_dated(match, 2, 1, 0), _dated(match, 2, 0, 1)).isNotNull(), "date"))
            .when(F.rlike(match, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
                  F.when(ssn_valid(digits_of(match)), "ssn"))
            .when(F.rlike(match, F.lit(r"^[+(]|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")), F.when(digits.between(7, 15), "phone"))
            .when(digits.between(13, 19) & luhn_valid(digits_of(match)), "card"))


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    return (F.when(kind == "email", _email(match, key)).when(kind == "ip", _ip(match, key)).when(kind == "date", _date(match, key))
            .when(kind == "ssn", _ssn(match, key)).when(kind == "phone", _phone(match, key))
            .when(kind == "card", _card(match, key)).otherwise(match))


def _numbers_in(run: Column) -> Column:
    """A run of digit groups as pieces (``text``, ``kind``): valid numbers, leftmost first, and what is between them.

    Every group start is tried, so a candidate that fails hides no valid one within or after it.
    """
    def valid(around: Column) -> Column:
        """The first valid number after the two characters of context, with its kind."""
        tried = F.array(*[F.regexp_extract(around, f"(?s)^..({p})", 1) for p in _NUMBERS])
        judged = F.transform(F.filter(tried, lambda m: m != ""), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
        return F.get(F.filter(judged, lambda c: c["kind"].isNotNull()), 0)

    def candidates(atoms: Column) -> Column:
        def at(atom: Column, i: Column) -> Column:
            before = F.lpad(F.substring(F.concat(F.lit("  "), F.coalesce(F.get(atoms, i - 1), F.lit(""))), -2, 2), 2, " ")
            around = F.concat(before, F.array_join(F.slice(atoms, i + 1, _REACH), ""))
            found = F.when(F.length(digits_of(around)) >= 4, F.get(F.transform(F.array(around), valid), 0))
            return F.struct(atom.alias("atom"), found.alias("found"))
        return F.transform(atoms, at)

    def step(acc: Column, c: Column) -> Column:
        # at: where the group begins in the run; free: where the last number taken ends
        taken = (acc["at"] >= acc["free"]) & c["found"].isNotNull()
        end = acc["at"] + F.length(c["found"]["m"])
        new = F.struct(acc["at"].alias("at"), end.alias("end"), acc["free"].alias("free"), c["found"]["kind"].alias("kind"))
        return F.struct((acc["at"] + F.length(c["atom"])).alias("at"), F.when(taken, end).otherwise(acc["free"]).alias("free"),
                        F.when(taken, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    def chosen(tried: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast("array<struct<at:int,end:int,free:int,kind:string>>").alias("out"))
        return F.when(F.exists(tried, lambda c: c["found"].isNotNull()), F.aggregate(tried, start, step))

    def piece(begin: Column, length: Column, kind: Column) -> Column:
        return F.struct(F.substring(run, begin + 1, length).alias("text"), kind.alias("kind"))

    def cut(done: Column) -> Column:
        none = F.lit(None).cast("string")
        numbers = F.flatten(F.transform(done["out"], lambda n: F.array(piece(n["free"], n["at"] - n["free"], none), piece(n["at"], n["end"] - n["at"], n["kind"]))))
        whole = F.array(F.struct(run.alias("text"), none.alias("kind")))
        return F.when(done.isNull(), whole).otherwise(F.concat(numbers, F.array(piece(done["free"], F.length(run), none))))
    tried = F.transform(F.array(F.split(run, _BEGIN, -1)), candidates)
    return F.get(F.transform(F.transform(tried, chosen), cut), 0)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_email, n_phone, n_ip, n_date, n_ssn, n_card``.

    Works on whole texts; a null text stays null with counts of 0, an empty one stays empty. Columns of the
    input named like a count are replaced, others pass through.
    """
    def pieces(m: Column) -> Column:
        mail = F.array(F.struct(m.alias("text"), F.lit("email").alias("kind")))
        few = F.array(F.struct(m.alias("text"), F.lit(None).cast("string").alias("kind")))  # too few digits for any kind
        return F.when(F.contains(m, F.lit("@")), mail).when(F.length(digits_of(m)) < 4, few).otherwise(_numbers_in(m))
    found = (docs.withColumn("_found", F.when(F.rlike(text_or_empty(), F.lit("[0-9]|@")), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
             .withColumn("_pieces", F.when(F.size("_found") > 0, F.transform("_found", pieces)))
             .withColumn("_kinds", F.transform(F.flatten("_pieces"), lambda p: p["kind"])))
    rebuilt = F.array_join(F.zip_with(
        F.split("text", ANY, -1),
        F.transform("_pieces", lambda ps: F.array_join(F.transform(ps, lambda p: pseudonym(p["text"], p["kind"], key)), "")),
        lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

    def count(kind: str) -> Column:
        return F.when(F.col("_kinds").isNull(), 0).otherwise(F.size(F.filter("_kinds", lambda k: k == kind))).cast("long")
    counts = {f"n_{kind}": count(kind) for kind in PATTERNS}
    rest = [c for c in docs.columns if c != "text" and c not in counts]
    return found.select(*rest, F.when(F.size("_kinds") > 0, rebuilt).otherwise(F.col("text")).alias("text"),
                        *[c.alias(n) for n, c in counts.items()])
