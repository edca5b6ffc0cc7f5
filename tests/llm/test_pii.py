import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from modelgate.llm import pii
from tests.conftest import SF0001

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    values = [int(d) for d in digits][::-1]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base(text):
    """The base patterns as they are written, by the standard library."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high, check in (("card", CARD, 14, 19, luhn), ("phone", PHONE, 10, 15, lambda d: True)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and check(digits):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def spans(text, kinds=None):
    return [s for s in pii.find(text) if kinds is None or s[0] in kinds]


pieces = st.sampled_from(
    ["a", "b.c", "@", "@@", ".", "..", "-", " ", "  ", "+", "+1", "(980) ", "555-2833", "255", "256", "0", "1", "7",
     "4111 1111 1111 1111", "4111111111111111", "000", "é", "\n", "%", "_", "x@y.z", "1.2.3.4", "300.1.1.1", "𝄞"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(pieces, max_size=30).map("".join))
def test_base_kinds_equal_their_patterns(text):
    assert spans(text, pii.BASE_KINDS) == base(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a9@.+- 1(é\n", max_size=60))
def test_base_kinds_equal_their_patterns_on_dense_texts(text):
    assert spans(text, pii.BASE_KINDS) == base(text)


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("Schreib an jörg@bücher.example heute", "mailbox", "jörg@bücher.example"),
        ('to "john smith"@example.org now', "mailbox", '"john smith"@example.org'),
        ("see mailto:ann@example.org, or", "contact", "ann@example.org"),
        ("call tel:+49-30-1234567.", "contact", "+49-30-1234567"),
        ("ftp://joe:pw@host.example:21/x", "login", "ftp://joe:pw@host.example:21"),
        ("IBAN: DE89 3704 0044 0532 0130 00 please", "iban", "DE89 3704 0044 0532 0130 00"),
        ("iban GB82WEST12345698765432", "iban", "GB82WEST12345698765432"),
        ("SSN is 123-45-6789.", "ssn", "123-45-6789"),
        ("account number: 0012 345-678", "account", "0012 345-678"),
        ("Konto Nr. 1234567", "account", "1234567"),
        ('token = "9233A8ECF7C5B09FE594"', "secret", "9233A8ECF7C5B09FE594"),
        ("PASSWORD: hunter22hunter", "secret", "hunter22hunter"),
    ],
)
def test_added_kinds(text, kind, value):
    assert value in [text[s:e] for k, s, e in pii.find(text) if k == kind]


@pytest.mark.parametrize(
    "text",
    ["", " ", "iban DE89 3704 0044 0532 0130 01", "ssn 000-12-3456", "accounting 1234567", "discount 123456789",
     "the account of 12 people", "token = word", "mailto: nobody", "http://example.org/a@b", "a @ b", "+12 34",
     "1.2.3", "4111 1111 1111 1112", "no secrets here: none"],
)
def test_texts_without_personal_data(text):
    assert pii.find(text) == []


def test_very_long_texts_take_time_in_proportion():
    for unit in ("@", "a@", "1 ", "1.", "+1", "mailto:", "://", "iban ", "token=", "a@b.c ", "0-", '"'):
        short = unit * (1_200 // len(unit))  # the plain patterns take squared time on some of these
        assert spans(short, pii.BASE_KINDS) == base(short)
        began = time.process_time()
        pii.find(unit * (400_000 // len(unit)))
        assert time.process_time() - began < 20


def test_query_equals_patterns(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op12_pii"](spark, SF0001).collect()}
    texts = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for row in texts:
        r = got[row["doc_id"]]
        want = base(row["text"] or "")
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
        listed = ",".join("%s:%d:%d" % s for s in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if s.split(":")[0] in pii.BASE_KINDS] == (listed.split(",") if listed else [])
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) > 0


def test_nulls_repeats_clashing_names_and_empty_table(spark):
    rows = [(None, "mail a@b.c", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "é a@b.c", 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans int")
    out = pii.find_spans(df)
    assert out.columns == ["doc_id", "text", "spans", "spans_"]
    assert sorted((r[2], [(s["kind"], s["start"], s["end"], s["value"]) for s in r[3]]) for r in out.collect()) == [
        (1, [("email", 5, 10, "a@b.c")]), (2, []), (2, []), (3, []), (4, [("email", 2, 7, "a@b.c")])
    ]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_masked(spark):
    rows = [(1, "é: a@b.c, 1.2.3.4"), (2, None), (3, "none"), (4, "mailto:a@b.c")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert [r["text"] for r in pii.masked(df).orderBy("id").collect()] == ["é: [email], [ip]", None, "none", "mailto:[email]"]
