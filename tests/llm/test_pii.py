import hashlib
import re

from loomfactor.llm import pii
from loomfactor.llm.common import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(said):
    digits = [int(c) for c in said if c.isdigit()]
    for i in range(len(digits) - 2, -1, -2):
        digits[i] = sum(map(int, str(2 * digits[i])))
    return 16 <= len(digits) <= 19 and sum(digits) % 10 == 0


def base(text):
    """The base kinds by regular expressions."""
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if luhn(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def check(df):
    got = sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digests(pii.find(df)).collect())
    want = []
    for r in df.select("doc_id", "text").collect():
        found = base(r.text)
        said = ",".join(f"{k}:{a}:{z}" for k, a, z in found)
        want.append((repr(r.doc_id), *(sum(k == x for x, _, _ in found) for k in pii.BASE), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)


def test_documents_against_regular_expressions(spark):
    check(table(spark, "/root/testdata/sf0.1", "documents"))


TEXTS = [
    None, "", "@", "a@b", "a@b.c", "a@b@c.d", "a@b.c@d.e", "..@x.y", "A.B+c@D-e.F.g. h", "é@b.c", "a@b..c", "a@-.-@x.y", "@a@b.c@@d.e", "x" * 5000 + "@y.z", "@" * 500 + "a.b",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1", "1.2.3.256 1.2.3.255", "01.002.0003.255", "0000000255.1.1.1", "1.2.3", "1..2.3.4", ".1.2.3.4.", "9999999999999999999999.1.1.1",
    "4425414259157784", "4425 4142 5915 7784", "4425-4142-5915-7784", "4425--414259157784", "4425  414259157784", "x4425414259157784x", "44254142591577841", "0000000000000000000", "00000000000000000000",
    "1 4425414259157784", "4425414259157784 1.2.3.4", "1.2.3.4425414259157784", "+1 (988) 555-2485", "+1234567", "+12345678", "+1", "+12", "+1 2", "+1 ((((", "+1 ...2345678 ", "++12345678", "+1+12345678", "+123456789012345", "+1234567890123456",
    "+1 988 555 2485 5555 1.2.3.4 a@b.c", "\u0661\u0662@b.c +\u0661 1.2.3.\u0664", "日本 a@b.c 🎉 1.2.3.4", "5 " * 40, "1.1." * 3000, "+1" + " 2" * 3000, "\n1\n2\n", "4" * 100_000,
]


def test_edges_of_base_kinds(spark):
    rows = [(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "a@b.c", "q"), (3, "a@b.c", "q"), (3, "a@b.c", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    check(df)
    assert pii.find(df.limit(0)).count() == 0


def test_pieces_put_together_at_random(spark):
    import random

    rng = random.Random(3)
    parts = ["@", "+", ".", "1", "22", "255", "256", "4425", "414259157784", " ", "-", "(", ")", "a", "b.c", "é", "\n", "://", "token=", "account "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(4000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def found(text):
    return [(k, text[a:z]) for k, a, z in pii.spans_of(text, pii.automaton()) if k not in pii.BASE]


def test_added_kinds():
    assert found("Account number: AB 123456") == [] and found("account number: AB123 456-7.") == [("account", "AB123 456-7")]
    assert found("my acct #12345") == [] and found("SSN 123-45-6789, passport no. X1234567") == [("account", "123-45-6789"), ("account", "X1234567")]
    assert found("subaccount 1234567 account1234567") == [("account", "1234567")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 is mine") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("iban DE88370400440532013000") == [] and found("iban GB82WEST12345698765432x") == [("iban", "GB82WEST12345698765432")]
    assert found("iban de89 3704") == [] and found("iban zz89370400440532013000") == []
    assert found("see https://me:pw@host.org/x and ftp://host.org") == [("login", "https://me:pw@host.org")]
    assert found("://a@b 9+x://u@h") == [("login", "x://u@h")]
    assert found('password=abc123 token = "1beb58b8" my_token=zzzzzz access_token: abcdef') == [("secret", "abc123"), ("secret", "1beb58b8"), ("secret", "abcdef")]
    assert found("token=abc password is long") == [] and found("token=password=abcdef") == [("secret", "password=abcdef")]


def test_redaction(spark):
    rows = [(1, "mail a@b.co now, 日本 +1 (988) 555-2485!"), (2, "none"), (3, None), (4, "https://me@host.org token=a@b.cde"), (5, "a@b.c")]
    got = {r.doc_id: r.text for r in pii.redact(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "mail [EMAIL] now, 日本 [PHONE]!", 2: "none", 3: "", 4: "[LOGIN] token=[EMAIL]", 5: "[EMAIL]"}
