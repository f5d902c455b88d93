"""Pseudonyms against the same network in plain Python."""

import datetime
import hashlib
import re

import pytest

from chronolith.llm import pii

KEY = "k"
JAVA = re.compile(pii.ANY)


def draw(kind, *parts):
    return int(hashlib.sha256("|".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()[:14], 16)


def permute(d, kind):
    n = len(d)
    u = n // 2
    a, b = int(d[:u]), int(d[u:])
    for i in range(1, pii.ROUNDS + 1):
        a, b = b, (a + draw(kind, n, i, b)) % 10 ** (u if i % 2 else n - u)
    return f"{a:0{u}d}{b:0{n - u}d}"


def shift(n, a, b, kind):
    x, y = divmod(n, b)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            x = (x + draw(kind, i, y)) % a
        else:
            y = (y + draw(kind, i, x)) % b
    return x * b + y


def among(members, v, size, b, kind):
    """The pseudonym of v, of a sorted list of heads times b tails."""
    head, tail = divmod(v, b)
    n = shift(members.index(head) * b + tail, size, b, kind)
    return members[n // b] * b + n % b


def refill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if (len(d) - i) % 2 == 1 else int(c) for i, c in enumerate(d, 1)) % 10


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def make(m):
    kind = next(k for k, r in pii.KINDS.items() if re.fullmatch(r, m))
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:32] + "@mail.invalid"
    if kind == "card":
        if luhn(d):
            return m
        body = permute(d[:-1], "card")
        return refill(m, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        if mod97(m) != 1:
            return m
        t = m[4:]
        t = refill(t, permute(re.sub("[^0-9]", "", t), "iban"))
        return f"{m[:2]}{98 - mod97(m[:2] + '00' + t):02d}{t}"
    if kind == "date":
        form = "%Y-%m-%d" if "-" in m else "%d/%m/%Y"
        try:
            n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m
        n = shift(n, 271, 270, "date")
        while n >= pii.DAYS:
            n = shift(n, 271, 270, "date")
        return (datetime.date(1900, 1, 1) + datetime.timedelta(n)).strftime(form)
    if kind == "ssn":
        ok = lambda s: not re.search("^(000|666|9)|^.{3}00|0000$", s)
        areas = [x for x in range(1, 900) if x != 666]
        n = shift((areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898 * 99, 9999, "ssn") if ok(d) else 0
        return refill(m, f"{areas[n // 9999 // 99]:03d}{n // 9999 % 99 + 1:02d}{n % 9999 + 1:04d}") if ok(d) else m
    if kind == "phone":
        ok = lambda s: bool(re.match("[2-9][0-9]{2}[2-9]", s))
        good = ok(d[-10:])
        heads = [x for x in range(10000) if ok(f"{x:04d}") == good]
        if not good:
            heads.sort(key=lambda x: (x >= 2000, x))
        return refill(m, d[:-10] + f"{among(heads, int(d[-10:]), len(heads), 10**6, 'phone' if good else 'other phone'):010d}")
    o = [int(x) for x in m.split(".")]
    a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
    for i in range(1, pii.ROUNDS + 1):
        a, b = b, (a + draw("ip", i, b)) % 65536
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


TEXTS = [
    "call +1 (988) 555-2485 or 988-555-2485, mail bosbt.42@mail8.example.com.", "card 4111 1111 1111 1111 and 4111111111111112 (wrong), ip 10.0.0.255 not 10.0.0.256 nor 1.2.3.4.5", "DE89370400440532013000 and DE00370400440532013000 é",
    "born 1987-02-28, 29/02/2001 (no), 28/02/2001, 2024-13-01", "ssn 123-45-6789 and 000-12-3456; 4111-1111-1111-1111", None, "", "nothing", "7 @ 8 日本 a@b.c x@y", "BOSBT.42@mail8.example.com 70.123.182.155 " * 30, "+1 (156) 055-2485",
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "r"), (None, TEXTS[1], None)], "doc_id long, text string, kind string")
    out = pii.mask(df, "text", KEY)
    assert out.columns == [*df.columns, "pii"]
    assert pii.mask(df.limit(0), "text", KEY).count() == 0
    return out.collect()


def test_masked_texts(got):
    assert len(got) == len(TEXTS) + 2
    for r in got:
        src = TEXTS[1 if r.doc_id is None else r.doc_id]
        assert r.text == (src and JAVA.sub(lambda m: make(m.group(0)), src))


def test_formats_links_and_validity(got):
    rows = {r.doc_id: r for r in got if r.kind == "c"}
    a, b, mail = (x.value for x in rows[0].pii)
    assert a.startswith("+1 (") and a[4:7] + a[9:12] + a[13:] == b.replace("-", "")
    assert luhn(re.sub("[^0-9]", "", rows[1].pii[0].value)) == 0 and "4111111111111112" in rows[1].text and "10.0.0.256" in rows[1].text
    assert mod97(rows[2].pii[0].value) == 1 and "DE00370400440532013000" in rows[2].text
    assert [x.kind for x in rows[3].pii] == ["date", "date"] and rows[4].pii[1].value.replace("-", "") == rows[1].pii[0].value.replace(" ", "")
    assert rows[9].pii[0].value == mail


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    d = F.lpad(F.col("id").cast("string"), 3, "0")
    assert spark.range(1000).select(pii.permute(d, KEY, "x").alias("p")).agg(F.count_distinct("p"), F.max(F.length("p"))).first() == (1000, 3)


def test_cards_beside_other_numbers_and_printed_ibans(spark):
    card, iban = "4111111111111111", "DE89370400440532013000"
    four = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    one, mail, ip, ssn = make(card), make("42@mail.example.com"), make("10.0.0.255"), make("123-45-6789")
    old = [
        (f"pay {card} 123", f"pay {one} 123"), (f"{card} 12/27", f"{one} 12/27"), (f"2 {four(card)}", f"2 {four(one)}"), (f"12345 67890 {four(card)} 99 {card}-1", f"12345 67890 {four(one)} 99 {one}-1"),
        (f"{card} {ssn and '123-45-6789'}", f"{one} {ssn}"), (f"{card} 10.0.0.255", f"{one} {ip}"), (f"{card} 42@mail.example.com", f"{one} {mail}"), (f"{card} 28/02/2001 x", f"{one} {make('28/02/2001')} x"), (f"{card} 7a", f"{one} 7a"),
        (f"to {four(iban)} 4111 x", f"to {four(make(iban))} 4111 x"), (f"BE68 5390 0754 7034 BIC {card}", f"{four(make('BE68539007547034'))} BIC {one}"), (four("DE00370400440532013000"), four("DE00370400440532013000")),
    ]
    rows = pii.mask(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(old)], "doc_id long, text string"), "text", KEY).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [t for _, t in old]
    assert [x.kind for x in rows[3].pii] == ["card", "card"] and [x.value for x in rows[0].pii] == [one] and not rows[11].pii


def test_numbers_of_a_class_are_permuted_within_it(spark):
    from pyspark.sql import functions as F

    n = F.col("id")
    assert spark.range(42).select(pii.shift(n, 6, 7, KEY, "x").alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (42, 0, 41)
    heads = F.lpad(n.cast("string"), 4, "0")
    out = spark.range(10000).select(heads.alias("was"), pii._phone(F.concat(heads, F.lit("123456")), KEY).alias("new"))
    valid = lambda c: F.col(c).rlike("^[2-9][0-9]{2}[2-9]")
    assert out.where(valid("was") != valid("new")).count() == 0 and out.agg(F.count_distinct("new"), F.min(F.length("new")), F.max(F.length("new"))).first() == (10000, 10, 10)


def test_a_key_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "ssn 123-45-6789", "kept", 7, 8)], "doc_id long, text string, pii string, __m long, __n long")
    with pytest.raises(ValueError):
        pii.mask(df, "text", "")
    out = pii.mask(df, "text", KEY)
    assert out.columns == [*df.columns, "pii_"]
    assert out.first()[2:5] == ("kept", 7, 8) and out.first().pii_[0].kind == "ssn"


def test_long_texts(spark):
    text = "word 123-45-6789 " * 40_000
    out = pii.mask(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", KEY).first()
    assert len(out.text) == len(text) and len(out.pii) == 40_000 and len(set(x.value for x in out.pii)) == 1
