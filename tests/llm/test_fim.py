import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomfactor.llm import fim
from loomfactor.llm.common import table

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, rate=50, spm=80):
    tokens = TOKEN.findall(text or "")
    assert "".join(tokens) == (text or "")
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def check(df, **options):
    done = fim.transform(df, **options).withColumn("again", fim.restored())
    got = sorted((repr(r.doc_id), r.n, r.form, repr(r.prefix_chars), repr(r.middle_chars), r.output, r.again) for r in done.collect())
    rows = [(r.doc_id, r.text, *brute(r.doc_id, r.text, **options)) for r in df.select("doc_id", "text").collect()]
    assert got == sorted((repr(i), n, form, repr(p), repr(m), out, text or "") for i, text, n, form, p, m, out in rows)
    return got


def test_documents_against_plain_python(spark):
    got = check(table(spark, "/root/testdata/sf0.01", "documents"))
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


TEXTS = [
    None, "", " ", "\n\t ", "a", " a", "a ", " a b  c\t\n", "é\u00a0è x\u2003y", "日本 語\r\n🎉 z", "a <P> b", "<S>", "x<M>y z", "<P", "P> <S <M", "< <<S<M< <", "\x0b\x0c", "\x00 \x1f a",
]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 80), (100, 0), (100, 100), (0, 80)])
def test_edges(spark, rate, spm):
    rows = [(i, t, "q", 1) for i, t in enumerate(TEXTS * 6)] + [(None, "a b c d", "q", 1)] * 2 + [(7, " one two " * 50_000, "q", 1), (8, "é" * 300_000, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    check(df, rate=rate, spm=spm)
    assert fim.transform(df.limit(0)).count() == 0


def test_characters_as_units():
    for text in ["", "abc", "aé日🎉b", "日本語 text é"]:
        raw, runs = text.encode(), fim.Runs(text.encode(), "char")
        assert runs.units == len(text)
        assert [raw[: runs.offset(c)].decode() for c in range(len(text) + 1)] == [text[:c] for c in range(len(text) + 1)]


def test_digests(spark):
    r = fim.digests(fim.transform(spark.createDataFrame([(5, "one two")], "doc_id long, text string"))).first()
    assert r.restored_sha256 == hashlib.sha256(b"one two").hexdigest() and len(r.output_sha256) == 64
    assert fim.transform(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))).filter("form <> 'plain'").count() > 850
