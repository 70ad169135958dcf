"""Encoded and nested messages against the standard library's parser."""

import base64
import email
import email.header
import email.message
import quopri
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import mime_tree
from quarry.sources.mime import extract_text

TEXT = "Gr\u00fc\u00dfe \u2603 = x\nsecond  line\n\n--b1 no boundary\n--\nlast"


def b64(text, charset="utf-8"):
    return base64.encodebytes(text.encode(charset)).decode()


def qp(text, charset="utf-8"):
    return quopri.encodestring(text.encode(charset)).decode()


def part(body, kind="text/plain", charset="utf-8", cte=None):
    return f"Content-Type: {kind}; charset={charset}\n" + (f"Content-Transfer-Encoding: {cte}\n" if cte else "") + f"\n{body}"


def multi(boundary, parts, kind="mixed"):
    return f'Content-Type: multipart/{kind};\n\tboundary="{boundary}"\n\npreamble\n' + \
        "".join(f"--{boundary}\n{p}\n" for p in parts) + f"--{boundary}--\nepilogue\n"


def cases():
    a, b = part(b64(TEXT), cte="base64"), part(qp(TEXT), cte="Quoted-Printable")
    out = {"base64": a, "qp": b, "two": multi("x", [a, b]), "rfc822": multi("x", ["Content-Type: message/rfc822\n\nSubject: s\n" + a]),
           "rfc822 of a multipart": multi("x", ["Content-Type: message/rfc822\n\nSubject: s\n" + multi("y", [b, "\nplain"])]),
           "a forward of a forward": multi("x", ["Content-Type: message/rfc822\n\nContent-Type: message/rfc822\n\n" + a]),
           "three levels": multi("x", [multi("x1", [multi("x2", [a, "\nno header", b]), b]), a]),
           "outer line inside": multi("x", [multi("y", [a]).replace("--y--\nepilogue\n", ""), b]),
           "never closed": multi("x", [a, b]).replace("--x--\nepilogue\n", ""),
           "no white space left": part("a=20=20\nb  \nc=\nd=3D=zz=4", cte="quoted-printable"),
           "odd base64": part("aGV sbG8\n!", cte="base64"), "bad utf-8": part(base64.b64encode(b"a\xff\xc3b").decode(), cte="base64"),
           "unknown charset": part(b64("\u00e9"), charset="x-none", cte="base64"), "no part": multi("x", []),
           "unknown type": multi("x", [part("AAAA", kind="image/png", cte="base64"), a])}
    for charset in ("iso-8859-1", "windows-1252", "iso-8859-15", "koi8-r", "shift_jis", "gb2312", "utf-16"):
        text = {"koi8-r": "\u041f\u0440\u0438\u0432\u0435\u0442", "shift_jis": "\u65e5\u672c", "gb2312": "\u4e2d\u6587"}.get(charset, "caf\u00e9 \u00fc")
        out[charset] = multi("x", [part(b64(text, charset), charset=charset, cte="base64"), part(b64(TEXT), cte="base64")])
    rng = random.Random(1)

    def tree(depth):
        if depth and rng.random() < 0.6:
            name = f"b{rng.randrange(10**6)}"
            return multi(name, [tree(depth - 1) for _ in range(rng.randrange(1, 4))])
        return rng.choice([a, b, part("plain\n--b1\nx"), "\nbare"])
    for i in range(60):
        out[f"tree {i}"] = multi("top", [tree(4) for _ in range(3)])
    return out


CASES = cases()


def library(message):
    def walk(m):
        if m.is_multipart():
            return [t for p in m.get_payload() for t in walk(p)]
        if m.get_content_type() != "text/plain":
            return [""]
        if m.get("content-transfer-encoding"):
            try:
                return [m.get_payload(decode=True).decode(m.get_content_charset() or "utf-8", "ignore")]
            except LookupError:
                return [m.get_payload(decode=True).decode("utf-8", "ignore")]
        return [m.get_payload()]
    return "\n\n".join(t for t in walk(email.message_from_string(message)) if t.strip()).strip()


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(k, "From: a@b\n" + v) for k, v in CASES.items()], "k string, raw string")
    return {r.k: r.extracted for r in extract_text(df).collect()}


@pytest.mark.parametrize("case", [k for k in CASES if k != "no part"])
def test_like_the_library(extracted, case):
    assert extracted[case] == library("From: a@b\n" + CASES[case])


def test_odd_rows(spark):
    df = spark.createDataFrame([(None,), ("",), ("Content-Transfer-Encoding: base64\n\n",), ("Content-Transfer-Encoding: base64\n\n=",),
                                ("From: a\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Transfer-Encoding: base64\n\n",)], "raw string")
    assert [r.extracted for r in extract_text(df).collect()] == ["", "", "", "=", "--b Content-Transfer-Encoding: base64"]
    big = "x\u00e9 " * 400_000
    df = spark.createDataFrame([(part(qp(big), cte="quoted-printable"),), (part(b64(big), cte="base64"),)], "raw string")
    assert [r.extracted for r in extract_text(df).collect()] == [big.strip()] * 2


SUBJECTS = ["plain", "=?utf-8?b?R3LDvMOfZQ==?=", "=?iso-8859-1?Q?caf=E9_x?= and =?utf-8?q?=E2=98=83?=", "=?utf-8?q?a?= =?utf-8?q?b?=",
            "a =?utf-8?q?b", "=?windows-1252?q?=80_=93q=94?=", "x=y?="]


def test_subjects(spark):
    df = spark.createDataFrame([(i, f"From: a\nSubject: {s}\nTo: b\n\nSubject: no") for i, s in enumerate(SUBJECTS)], "i int, raw string")
    got = {r.i: r.s for r in df.select("i", mime_tree.header(F.col("raw"), "subject").alias("s")).collect()}
    for i, s in enumerate(SUBJECTS):
        assert got[i] == str(email.header.make_header(email.header.decode_header(s)))
