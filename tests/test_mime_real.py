"""T1 on the shapes of real mail."""

import pytest

from quarry.sources.mime import extract_text

PLAIN = "Subject: x\nContent-Type: text/plain\n\nhello\nworld"
MULTI = ("Received: by host;\n\tMon\nFrom: a@b\nMIME-Version: 1.0\nContent-Type: multipart/mixed;\n boundary=\"b1\"\n\npreamble\n"
         "--b1\nContent-Type: text/plain\n\nfirst with --b1 inside\n--b10\nmore\n--b1\nContent-Type: text/html\n\n<p>second</p>\n"
         "--b1--\nepilogue")
CASES = {
    "plain": (PLAIN, "hello\nworld"),
    "crlf": (PLAIN.replace("\n", "\r\n"), "hello\nworld"),
    "received first": ("Received: from x\n by y\nSubject: s\n\nbody", "body"),
    "unknown names only": ("Note: this is text\n\nrest", "Note: this is text\n\nrest"),
    "a line that is no header": ("Subject: x\nplain words\n\nrest", "Subject: x\nplain words\n\nrest"),
    "boundary inside a line": (MULTI, "first with --b1 inside\n--b10\nmore\n\nsecond"),
    "multipart crlf": (MULTI.replace("\n", "\r\n"), "first with --b1 inside\n--b10\nmore\n\nsecond"),
    "base64 crlf": ("From: a\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\naGVsbG8=\r\n", "hello"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "k string, raw string")
    return {r.k: r.extracted for r in extract_text(df).collect()}


@pytest.mark.parametrize("case", CASES)
def test_real_mail(extracted, case):
    assert extracted[case] == CASES[case][1]
