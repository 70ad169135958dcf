"""Quoted-printable is decoded a run of bytes at a time."""

import re

from pyspark.sql import functions as F

from quarry.sources import mime_tree as mt

BODIES = ["", "=41", "a=41b", "==41", "=4=41", "=4", "=", "=\n", "a=  \nb=C3=A4=\n=c3=b6 = =zz=4G", "\u00e4=41\u00f6", "=3D41", "=41=\n42 =4",
          "=AB=CD" * 500, "x=\n" * 30, "=0A=0D\n\n=00", None]


def by_hand(body):
    plain = re.sub(r"=[ \t]*(?:\n|\Z)", "", body)
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), plain.encode())


def test_quoted_printable(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)], "i int, body string")
    got = {r["i"]: r["d"] for r in df.select("i", mt.from_quoted_printable(F.col("body")).alias("d")).collect()}
    assert {i: None if d is None else bytes(d) for i, d in got.items()} == {i: None if b is None else by_hand(b) for i, b in enumerate(BODIES)}


def test_a_run_is_one_piece(spark):
    df = spark.createDataFrame([("ab" + "=C3=A4" * 1000 + "cd",)], "body string")
    assert df.select(F.size(mt.quoted_printable_runs(F.col("body")))).collect()[0][0] == 3
