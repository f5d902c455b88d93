r"""Format-preserving pseudonyms for personal data, JVM-side.

One expression finds e-mail addresses, IBANs, dates, social security numbers, phone numbers, IPv4 addresses and card numbers,
leftmost first. A number is permuted within its format by a keyed Feistel network over its digits (balanced halves, ROUNDS
rounds of SHA-256): separators, length and validity stay, and as the permutation depends on the key and the kind alone, equal
values get equal pseudonyms in every text and different ones different. Valid numbers go to valid ones: social security and phone
numbers are numbered within their class, and the network permutes these numbers (a product of two moduli) exactly. Card numbers
keep a right check digit (Luhn), IBANs theirs (mod 97), dates stay dates from 1900 to 2099. E-mail addresses have no digits
to permute; they get a keyed digest of 128 bits in the same form.

Card numbers stand among groups of digits joined by single blanks or hyphens; every row of whole groups of 13 to 19 digits is
tested, so a number beside a security code or an expiry date is found. IBANs may be printed in groups of four.

What fails validation (a wrong check digit, a 13th month) is no personal datum and stays.

The key is a parameter and must not be empty; it stands in the plan, so plans are as secret as the key.

Defined results: a null text stays null, an empty one empty; repeated rows give equal rows; an empty table gives no rows; ids
and other columns are kept as they are, and if the name of the new column is taken, it gets a "_" behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import free

ROUNDS = 8
#: Steps of a walk back into the class; only dates walk, 121 of 73,170 numbers being none, so sixteen fail with 1e-44.
WALK = 16
#: For the query over the synthetic table, where chronolith.pii.key is not set.
DEMO_KEY = "a key for synthetic data"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Countries by the length of their IBAN, which says where one printed in groups of four ends.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD|FK", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK|MN", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|TL|SO",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
PRINTED = "|".join(f"(?:{c})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in LENGTHS.items())
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{PRINTED})(?![A-Za-z0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
}
# A run of whole groups of digits, up to where another kind begins; the card numbers are among its groups.
GROUP = "[0-9]++(?![A-Za-z])"
OTHER = "|".join(KINDS.values())
KINDS["card"] = rf"(?<![0-9A-Za-z])(?=(?:[0-9][ -]?){{13}}){GROUP}(?:[ -](?!{OTHER}){GROUP})*+"
ANY = "|".join(KINDS.values())
#: Card numbers as they are printed; these go before other joined groups.
CUSTOMARY = "^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
DAY0, DAYS = "1900-01-01", 73049


def let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def power10(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(19))), n + 1)


def draw(key: str, kind: str, *parts: Column) -> Column:
    """56 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *parts).cast("binary"), 256), 1, 14), 16, 10).cast("long")


def permute(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 36)."""

    def run(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        start = F.struct(F.substring(d, F.lit(1), u).cast("long").alias("a"), F.substring(d, u + 1, n).cast("long").alias("b"))
        turn = lambda s, i: F.struct(s["b"].alias("a"), F.pmod(s["a"] + draw(key, kind, n.cast("string"), i.cast("string"), s["b"].cast("string")), power10(F.when(i % 2 == 1, u).otherwise(n - u))).alias("b"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
        return let(end, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), n - u, "0")))

    return let(digits, run)


def shift(n: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers from 0 to a * b - 1: the parts modulo a and b take turns in moving each other."""

    def turn(s: Column, i: Column) -> Column:
        by = lambda part: draw(key, kind, i.cast("string"), part.cast("string"))
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.pmod(s["a"] + by(s["b"]), F.lit(a))).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + by(s["a"]), F.lit(b))).alias("b"))

    start = F.struct(F.floor(n / b).cast("long").alias("a"), (n % b).cast("long").alias("b"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda s: s["a"] * b + s["b"])


def digits(n: Column, size: int) -> Column:
    return F.lpad(n.cast("long").cast("string"), size, "0")


def refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""
    at = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))), "")


def luhn(digits: Column) -> Column:
    """The sum of Luhn's scheme mod 10, the last digit standing singly: 0 of a valid number."""

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return a + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def mod97(iban: Column) -> Column:
    """Of an IBAN with its head moved to the end and letters as two digits: 1 if valid."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def add(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = permute(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn(d) == 0, refill(m, whole)).otherwise(m)

    return let(F.regexp_replace(m, "[^0-9]", ""), run)


def cards(groups: Column) -> Column:
    """[(start, stop)] of the valid numbers of 13 to 19 digits among the groups (each with the blank or hyphen before it),
    apart from each other: customary forms first, longer ones first, then from the left."""
    form = lambda i, j: F.regexp_replace(F.array_join(F.slice(groups, i, j - i + 1), ""), "^[ -]", "")

    def rate(i: Column, j: Column) -> Column:
        t = form(i, j)
        return F.struct(F.when(t.rlike(CUSTOMARY), 0).otherwise(1).alias("other"), (-F.length(F.regexp_replace(t, "[^0-9]", ""))).alias("less"), i.alias("start"), j.alias("stop"))

    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.transform(F.sequence(i, F.least(i + 18, F.size(groups))), lambda j: rate(i, j))))
    good = F.filter(pairs, lambda x: x["less"].between(-19, -13))
    good = F.filter(good, lambda x: luhn(F.regexp_replace(form(x["start"], x["stop"]), "[^0-9]", "")) == 0)
    none = F.expr("cast(array() as array<struct<other:int,less:int,start:int,stop:int>>)")
    add = lambda a, x: F.when(F.exists(a, lambda y: (y["start"] <= x["stop"]) & (x["start"] <= y["stop"])), a).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.array_sort(good), none, add)


def piece(kind: Column, value: Column, was: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), was.alias("was"))


def _run(m: Column, key: str) -> Column:
    """The pieces of a run of digits: card numbers with their pseudonyms, and what stands between."""

    def cut(groups: Column, found: Column) -> Column:
        def at(k: Column) -> Column:
            g = F.element_at(groups, k)
            sep = F.regexp_extract(g, "^[ -]?", 0)
            card = lambda x: let(F.regexp_replace(F.array_join(F.slice(groups, x["start"], x["stop"] - x["start"] + 1), ""), "^[ -]", ""), lambda t: F.array(piece(F.lit("card"), sep, sep), piece(F.lit("card"), _card(t, key), t)))
            mine = F.filter(found, lambda x: x["start"] == k)
            held = F.exists(found, lambda x: (x["start"] < k) & (k <= x["stop"]))
            return F.when(F.size(mine) > 0, F.flatten(F.transform(mine, card))).when(~held, F.array(piece(F.lit("card"), g, g))).otherwise(F.array(piece(F.lit("card"), F.lit(""), F.lit(""))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), at))

    return let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), lambda g: let(cards(g), lambda c: cut(g, c)))


def _iban(m: Column, key: str) -> Column:
    """Blanks between groups stay; the number is the same without them."""
    plain = lambda x: F.regexp_replace(x, " ", "")

    def run(tail: Column) -> Column:
        d = F.regexp_replace(tail, "[^0-9]", "")
        new = F.when(F.length(d) >= 2, refill(tail, permute(d, key, "iban"))).otherwise(tail)
        return let(new, lambda t: F.concat(F.substring(m, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), plain(t)))).cast("string"), 2, "0"), t))

    return F.when(mod97(plain(m)) == 1, let(F.substring(m, 5, 60), run)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.contains("-")
    day = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))).cast("date")
    n = F.datediff(day, F.lit(DAY0).cast("date")).cast("long")
    step = lambda s, i: F.when((i > 1) & (s < DAYS), s).otherwise(shift(s, 271, 270, key, "date"))
    out = F.date_add(F.lit(DAY0).cast("date"), F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), n, step).cast("int"))
    return F.when(n.isNull(), m).when(iso, F.date_format(out, "yyyy-MM-dd")).otherwise(F.date_format(out, "dd/MM/yyyy"))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999 are 898 * 99 * 9999 numbers."""

    def run(d: Column) -> Column:
        part = lambda at, n: F.substring(d, at, n).cast("long")
        area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
        n = (area * 99 + part(4, 2) - 1) * 9999 + part(6, 4) - 1
        back = lambda v: F.concat(digits(F.floor(v / (99 * 9999)) + F.when(F.floor(v / (99 * 9999)) >= 665, 2).otherwise(1), 3), digits(F.floor(v / 9999) % 99 + 1, 2), digits(v % 9999 + 1, 4))
        return F.when(~d.rlike("^(000|666|9)|^.{3}00|0000$"), refill(m, let(shift(n, 898 * 99, 9999, key, "ssn"), back))).otherwise(m)

    return let(F.regexp_replace(m, "-", ""), run)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted, so a number with and without its country is one. Numbers whose area and exchange begin
    with 2 to 9 (6400 heads of four digits) and the others (3600) stay among themselves."""

    def run(d: Column) -> Column:
        tail = F.substring(d, F.length(d) - 9, F.lit(10))
        at = lambda i, n: F.substring(tail, i, n).cast("long")
        good = (at(1, 1) >= 2) & (at(4, 1) >= 2)
        head = F.when(good, (at(1, 1) - 2) * 800 + at(2, 2) * 8 + at(4, 1) - 2).when(at(1, 1) < 2, at(1, 4)).otherwise(2000 + (at(1, 1) - 2) * 200 + at(2, 2) * 2 + at(4, 1))
        n = head * 1_000_000 + at(5, 6)
        new = F.when(good, shift(n, 6400, 1_000_000, key, "phone")).otherwise(shift(n, 3600, 1_000_000, key, "other phone"))

        def back(v: Column) -> Column:
            h = F.floor(v / 1_000_000).cast("long")
            rest = h - 2000
            four = F.when(good, (F.floor(h / 800) + 2) * 1000 + F.floor(h / 8) % 100 * 10 + h % 8 + 2).when(h < 2000, h).otherwise((F.floor(rest / 200) + 2) * 1000 + F.floor(rest / 2) % 100 * 10 + rest % 2)
            return F.concat(digits(four, 4), digits(v % 1_000_000, 6))

        return refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), let(new, back)))

    return let(F.regexp_replace(m, "[^0-9]", ""), run)


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    start = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))
    turn = lambda s, i: F.struct(s["b"].alias("a"), F.pmod(s["a"] + draw(key, "ip", i.cast("string"), s["b"].cast("string")), F.lit(65536)).alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return let(end, lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(s["a"], 8), s["a"].bitwiseAND(255), F.shiftright(s["b"], 8), s["b"].bitwiseAND(255)))))


def _email(m: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 32), F.lit("@mail.invalid"))


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip}


def kind_of(m: Column) -> Column:
    """The kind of a match, in the order in which the alternatives stand."""
    out = F.lit(None).cast("string")
    for k, r in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{r})$"), k).otherwise(out)
    return out


def pseudonyms(m: Column, key: str) -> Column:
    """The pieces of a match; all but a run of digits is one."""

    def run(k: Column) -> Column:
        out = m
        for name, make in MAKERS.items():
            out = F.when(k == name, make(m, key)).otherwise(out)
        return F.when(k == "card", _run(m, key)).otherwise(F.array(piece(k, out, m)))

    return let(kind_of(m), run)


def mask(docs: DataFrame, text_col: str, key: str, found: str = "pii") -> DataFrame:
    """The rows with pseudonyms in their text, and a column `pii`: [(kind, pseudonym)] of what was replaced."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col)
    hits, new, found = (free(docs.columns, c) for c in ("__m", "__n", found))
    rows = docs.withColumn(hits, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    some = F.coalesce(F.size(hits), F.lit(0)) > 0
    rows = rows.withColumn(new, F.when(some, F.transform(hits, lambda m: pseudonyms(m, key))))
    whole = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(new, lambda n: F.array_join(F.transform(n, lambda x: x["value"]), "")), F.array(F.lit(""))), lambda g, v: F.array(g, v))), "")
    said = F.when(some, F.transform(F.filter(F.flatten(new), lambda x: x["value"] != x["was"]), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string>>)"))
    return rows.withColumns({text_col: F.when(some, whole).otherwise(text), found: said}).drop(hits, new)


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document with its masked text, and how many values of each kind were replaced. The key is a setting of the
    session (chronolith.pii.key)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = mask(docs, "text", spark.conf.get("chronolith.pii.key", DEMO_KEY))
    n = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(n, KINDS), F.array_join(F.transform("pii", lambda x: x["value"]), " ; ").alias("pseudonyms"), "text")


QUERIES = {"op2_pii": op2}
SQL: dict[str, str] = {}
