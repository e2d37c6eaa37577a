"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, digits and the cues of identifiers in
one pass over a text; at each, a local parser reads outwards as far as the kind allows and checks what it has read.

Kinds and their boundaries (all letters and digits are ASCII):

email    around an at-sign: local part to the left, two or more labels to the right
ip       four runs of digits joined by dots, each at most 255; longer chains are read four runs at a time
card     a chain of digits with at most one space or hyphen between two: 16 to 19 digits that pass Luhn's check
phone    a plus sign, a digit, and digits, spaces, brackets, dots, hyphens up to the last digit: 8 to 15 digits
account  after a cue (account, passport, ssn and so on): up to four letters and a chain of digits, 6 to 30 of them
iban     after the cue: country, check digits and as many characters as the country's accounts have; remainder 1 modulo 97
login    a scheme, user information and the host that follows it in a URL
secret   after a cue (password, token and so on) and = or : the value, six characters or more

Spans of one kind do not overlap and are read from the left; a span that fails its check is dropped and reading goes on after
it (account, iban and secret: after the cue). Each parser reads a character a bounded number of times, whatever the text.

Defined results: a null or empty text has no spans; a null id keeps its row; repeated rows each return a row; an empty table
returns no rows; texts are read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "login", "secret")
#: Cues of identifiers and of secrets.
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "customer id", "member id", "tax id")
SECRET_CUES = "password passwd pwd secret token api_key api-key apikey access_key access_token auth_token client_secret secret_key".split()
#: Length of an IBAN by country.
IBAN_LENGTH = {
    "at": 20, "be": 16, "bg": 22, "ch": 21, "cy": 28, "cz": 24, "de": 22, "dk": 18, "ee": 20, "es": 24, "fi": 18, "fr": 27,
    "gb": 22, "gr": 27, "hr": 21, "hu": 28, "ie": 22, "is": 26, "it": 27, "li": 21, "lt": 20, "lu": 20, "lv": 21, "mc": 27,
    "mt": 31, "nl": 18, "no": 15, "pl": 28, "pt": 25, "ro": 24, "se": 24, "si": 19, "sk": 24, "sm": 27,
}

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_ALNUM = _WORD - {"_"}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]*")
_NUMBERED = re.compile(r"(?: number| no)?\.? ?[:=#]? ?([a-z]{0,4}[0-9](?:[ -]?[0-9])*)")
_IBAN = re.compile(r"[:=]? ?([a-z]{2}[0-9]{2})")
_USER = re.compile(r"[^\x00-\x20/?#@\"<>]+@[a-z0-9.-]+")
_VALUE = re.compile(r" ?[=:] ?[\"']?([a-z0-9_./+=~-]{6,})")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    """Anchors -> (kind of parser, length of the anchor)."""
    found = ahocorasick.Automaton()
    anchors = {"@": "email", "+": "phone", "://": "login", "iban": "iban"} | dict.fromkeys("0123456789", "digit")
    anchors |= dict.fromkeys(ACCOUNT_CUES, "account") | dict.fromkeys(SECRET_CUES, "secret")
    for text, kind in anchors.items():
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


class Reader:
    """The local parsers over one text (ASCII letters in lower case), and the spans they have accepted."""

    def __init__(self, text: str):
        self.text = text
        self.spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        #: Where the next span of a kind may begin.
        self.free = dict.fromkeys(KINDS, 0)

    def _keep(self, kind: str, start: int, end: int) -> None:
        self.spans[kind].append((start, end))
        self.free[kind] = end

    def email(self, start: int, end: int) -> None:
        left, free, text = start, self.free["email"], self.text
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, end)
        if left < start and domain:
            self._keep("email", left, domain.end())

    def digit(self, start: int, end: int) -> None:
        """The first digit of a chain; the others are inside what has been read."""
        text, free = self.text, self.free
        if start >= free["ip"]:
            runs = _DOTTED.match(text, start)
            free["ip"] = runs.end()
            if runs[0].count(".") > 2:
                at, parts = start, runs[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        self.spans["ip"].append((at, at + size))
                    at += size + 1
        if start >= free["card"]:
            chain = _CHAIN.match(text, start)
            free["card"] = chain.end()
            if chain.end() - start >= 16:
                digits = "".join(_DIGIT.findall(chain[0]))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.spans["card"].append((start, chain.end()))

    def phone(self, start: int, end: int) -> None:
        said = _DIALLED.match(self.text, start)
        if said:
            number = said[0].rstrip(" ().-")
            if len(number) >= 4:
                self.free["phone"] = start + len(number)
                if 8 <= len(_DIGIT.findall(number)) <= 15:
                    self._keep("phone", start, start + len(number))

    def login(self, start: int, end: int) -> None:
        left, free, text = start, self.free["login"], self.text
        while left > free and text[left - 1] in _SCHEME:
            left -= 1
        while left < start and not text[left].isalpha():
            left += 1
        user = _USER.match(text, end)
        if left < start and user:
            self._keep("login", left, user.end())

    def _cue(self, kind: str, start: int) -> bool:
        """Whether a cue stands free of what has been read and of the word before it."""
        return start >= self.free[kind] and (start == 0 or self.text[start - 1] not in _WORD)

    def account(self, start: int, end: int) -> None:
        said = self._cue("account", start) and _NUMBERED.match(self.text, end)
        if said and 6 <= len(_DIGIT.findall(said[1])) <= 30:
            self._keep("account", said.start(1), said.end(1))

    def iban(self, start: int, end: int) -> None:
        said = self._cue("iban", start) and _IBAN.match(self.text, end)
        if not said:
            return
        at, need, held = said.end(1), IBAN_LENGTH.get(said[1][:2], 0) - 4, []
        while len(held) < need and at < len(self.text):
            at += self.text[at] == " "
            if self.text[at : at + 1] not in _ALNUM:
                return
            held.append(self.text[at])
            at += 1
        if held and len(held) == need and int("".join(str(int(c, 36)) for c in "".join(held) + said[1])) % 97 == 1:
            self._keep("iban", said.start(1), at)

    def secret(self, start: int, end: int) -> None:
        said = self._cue("secret", start) and _VALUE.match(self.text, end)
        if said:
            self._keep("secret", said.start(1), said.end(1))


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then by start; code points, end exclusive."""
    reader = Reader(text.encode().lower().decode())  # bytes.lower() acts on ASCII only: places stay
    parsers = {kind: getattr(reader, kind) for kind in ("email", "digit", "phone", "login", "account", "iban", "secret")}
    for last, (kind, size) in anchors.iter(reader.text):
        parsers[kind](last + 1 - size, last + 1)
    return [(kind, start, end) for kind, found in reader.spans.items() for start, end in found]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every row of docs; spans: array of (kind, start, end)."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in small_batches(batches, "text"):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t, anchors)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(kind))], ["doc_id", "text", "spans"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>"
    )


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text) of find(), each span replaced by its kind in brackets; of spans that overlap, the one that begins first
    (the longer one, if two begin together) counts and the others are covered with it."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("z"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def write(acc: Column, s: Column) -> Column:
        shown = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["a"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["a"] >= acc["at"]
        return F.struct(F.when(fresh, shown).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], -s["z"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.when(F.size("spans") > 0, F.aggregate(ordered, start, write, end)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """find() as counts of the base kinds, a digest of their spans, and all spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
