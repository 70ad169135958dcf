"""Hand-written edge rows for the text jobs."""

import base64

from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.operators import infer as inf
from quarry.operators import quality as ql
from quarry.sources.mime import extract_text


def one(spark, value, fn, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("x")).alias("y")).first()[0]


def test_collapse_whitespace_unicode(spark):
    s = "a\tb\r\nc d　e  \x0bf"
    assert one(spark, s, tx.collapse_ws) == " ".join(s.split())
    assert one(spark, "   \t\n ", tx.collapse_ws) == ""


def test_collapse_is_idempotent(spark):
    s = "x  y\n\nz"
    once = one(spark, s, tx.collapse_ws)
    assert one(spark, once, tx.collapse_ws) == once


def test_py_strip_matches_python(spark):
    s = " \t x y \n "
    assert one(spark, s, tx.py_strip) == s.strip()


def test_content_key(spark):
    df = spark.createDataFrame([("", "a  b"), (None, " a b "), ("given", "zzz")], "id string, t string")
    ids = [r[0] for r in df.select(tx.content_key("id", "t")).collect()]
    import hashlib
    h = hashlib.md5(b"a b").hexdigest()
    assert ids == [h, h, "given"]


def test_truncate_boundaries(spark):
    p4500, p4501 = "a" * 4500, "b" * 4501
    assert one(spark, p4500, tx.truncate_middle) == p4500
    out = one(spark, p4501, tx.truncate_middle)
    assert out == "b" * 1000 + K.TRUNCATE_MARKER + "b" * 2000


def test_html_clean(spark):
    html = ("<html><head><style>p{x}</style><script>var t='</p>';</script></head><body>"
            "<!-- c --><p>Hello <b>big</b> <i>world</i> &amp; more</p><ul><li>one</li></ul>"
            "<a href=\"http://x\"> </a><a href=\"/y\">Why</a><img src=z></body></html>")
    out = one(spark, html, tx.html_to_clean_text)
    assert "Hello **big** _world_ & more" in out
    assert "* one" in out
    assert "[Link](http://x)" in out and "[Why](/y)" in out
    assert "var t" not in out and "<" not in out and "\n\n\n" not in out
    assert one(spark, "   ", tx.html_to_clean_text) == "   "


def test_significant_html(spark):
    assert one(spark, "<p>" + "x" * 49 + "</p>", tx.is_significant_html) is False
    assert one(spark, "<p>" + "x" * 50 + "</p>", tx.is_significant_html) is True


def test_distinct_lines(spark):
    assert one(spark, "a\nb\na\nc\nb", tx.distinct_lines) == "a\nb\nc"


def _extract(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r[0] for r in extract_text(df, "raw", "t").orderBy("i").select("t").collect()]


def test_mime_shapes(spark):
    plain = "Subject: s\nContent-Type: text/plain\n\n  body text  \n"
    html = "Content-Type: text/html\n\n<p>Hi <b>there</b></p><script>x()</script>"
    multi = ("Subject: s\nContent-Type: multipart/alternative; boundary=\"b1\"\n\npre\n--b1\n"
             "Content-Type: text/plain\n\nplain part\n--b1\nContent-Type: text/html\n\n<p>html part</p>\n--b1--\n")
    b64 = base64.b64encode("café über".encode()).decode()
    encoded = ("Subject: s\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n"
               f"Content-Transfer-Encoding: base64\n\n{b64}\n")
    qp = ("Subject: s\nContent-Type: text/plain; charset=utf-8\n"
          "Content-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 soft=\nbreak\n")
    no_header = "Note: not a header\n\njust text"
    empty_html = "Content-Type: text/html\n\n<script>x</script>"
    out = _extract(spark, [plain, html, multi, encoded, qp, no_header, "", empty_html])
    assert out[0] == "body text"
    assert out[1] == "Hi\nthere"
    assert out[2] == "plain part\n\nhtml part"
    assert out[3] == "café über"
    assert out[4] == "café softbreak"
    assert out[5] == no_header
    assert out[6] == ""
    # nothing visible: fallback body (tags stripped, blanks collapsed)
    assert out[7] == ""


def test_reply_parsing_strictness(spark):
    cases = {
        "```json\n{\"summary\": \"s1\"}\n```": "s1",
        "```\n{\"summary\": \"s2\"}\n```": "s2",
        "Sure: {\"summary\": \"s3\"} thanks": "s3",
        "{\"summary\": \"a\"} x}": None,
        "{\"summary\": \"a\"}{\"summary\": \"b\"}": None,
        "{\"summary\": \"a\"},{\"summary\": \"b\"}": None,
        "{'summary': 'a'}": None,
        "{}": None,
        "": None,
        "no json here": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    got = {r[0]: r[1] for r in df.select("reply", inf.parse_reply("reply")["summary"]).collect()}
    assert got == cases


def test_fallback_routing(spark):
    rows = [(1, None, "body"), (2, "", "body"), (3, "good summary", "  "), (4, "good", "body")]
    df = spark.createDataFrame(rows, "id int, s string, body string")
    parsed = F.struct(F.lit("Work").alias("category"), F.lit(None).cast("string").alias("subject"),
                      F.col("s").alias("summary"), F.col("s").alias("detailedSummary"),
                      F.lit("Low").alias("priority"))
    out = df.select("id", inf.route_result(parsed, F.col("body"), F.col("id").cast("string")).alias("r")) \
        .orderBy("id").collect()
    assert [r.r.type for r in out] == ["UNKNOWN", "UNKNOWN", "NOTIF", None]
    assert out[0].r.flag_fallback_disabled and out[0].r.flag_email_id == "1"
    assert out[2].r.flag_empty_body and out[2].r.summary is None
    assert out[3].r.summary == "good" and out[3].r.category == "Work"


def test_real_summary_predicate(spark):
    vals = ["x" * 20, "x" * 21, "A Fallback summary text here", "contains EXCERPT of the mail..", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in df.select(ql.is_real_summary("s")).collect()] == [False, True, False, False, False]


def test_key_details(spark):
    df = spark.createDataFrame([(1, "Ref AB-12 and AB-12 due 2024-05-01 pay $1,200.50 to ops@example.com; éXY-9")],
                               "id int, text string")
    got = {(r.kind, r.value) for r in ql.key_details_long(df).collect()}
    assert got == {("reference", "AB-12"), ("date", "2024-05-01"), ("amount", "$1,200.50"),
                   ("email", "ops@example.com")}


def test_entities_outside_the_fixed_list(spark):
    s = ("&#8220;a&#x201D; &#x2019;&#X2019; &#233;&#00233; &aacute;&szlig;&NotEqualTilde; &#128512;&#x1F600; &#x80;&#133; &#xfeff;"
         " &amp;#233; &amp;amp; &&lt;x &nope; &#; &#x; &# 1; &copy &#0;&#xD800;&#x110000;&#99999999999999999999; R&D; a&b")
    want = ("“a” ’’ éé áß≂̸ \U0001f600\U0001f600 €… ﻿"
            " &#233; &amp; &<x &nope; &#; &#x; &# 1; &copy ���� R&D; a&b")
    assert one(spark, s, tx.decode_entities) == want
    assert one(spark, None, tx.decode_entities) is None and one(spark, "", tx.decode_entities) == ""


def test_every_named_entity(spark):
    from html.entities import html5
    fixed = dict(K.ENTITIES)
    names = sorted(n for n in html5 if n.endswith(";"))
    got = one(spark, "\x00".join("&" + n for n in names), tx.decode_entities).split("\x00")
    assert got == [fixed.get("&" + n, html5[n]) for n in names] and len(names) > 2000


def test_entities_in_links_and_text(spark):
    page = '<p>caf&#233; &#8220;x&#8221;</p><a href="/s?q=&#xe9;&amp;b=1">&szlig; <b>&#x2713;</b></a>'
    assert one(spark, page, tx.html_to_clean_text) == "café “x”\n\n[ß **✓**](/s?q=é&b=1)"
    got = spark.createDataFrame([(page,)], "x string").select(*tx.link_edges("x")).first()
    assert (got[0], got[1]) == (["/s?q=é&b=1"], ["ß ✓"])
