"""The masks, one value at a time, as columns."""

from __future__ import annotations

import pytest

from inkveil.functions.masks import MASKS

CASES = [
    ("email", "lena.k@werk.example", "XXXXXX@werk.example"),
    ("email", "z@t.example", "XXX@t.example"),
    ("email", "@t.example", "XXX@t.example"),
    ("email", "no address", "XXXXXXXXXX@"),
    ("email", "one@two@three", "XXX@two"),
    ("email", "zoë@t.example", "XXX@t.example"),
    ("email", "", "XXX@"),
    ("phone", "+44 20 7946-0958", "+XX XX XXXX-XXXX"),
    ("phone", "(212) 5550187", "(XXX) XXXXXXX"),
    ("phone", "212.555.0187 ext", "XXX.XXX.XXXX ext"),
    ("phone", "none", "none"),
    ("phone", "٣1", "٣X"),
    ("account_like", "0042", "XXXX"),
    ("account_like", "5500-0000 0000-0004", "XXXX-XXXX XXXX-XXXX"),
    ("account_like", "no 7, no 8", "no X, no X"),
    ("address", "17 Copper Beech Lane 2b", "XX XXXX XXXX XXXX XXXX"),
    ("address", "", "XXXX"),
    ("address", " \n", "XXXX"),
    ("address", "90210", "XXXXX"),
    ("address", "Hafen", "XXXX"),
    ("address", " 12 Oak\n\tHill ", "XX XXXX XXXX"),
    ("address", "٣ Oak", "XXXX XXXX"),
    ("url_keep_host", "http://intra.example/report?sig=9f8e7d&lang=en", "http://intra.example/report?redacted=XXXX"),
    ("url_keep_host", "ftp://files.example/a/b", "https://redacted.local/?redacted=XXXX"),
    ("url_keep_host", "//w.example?#top", "//w.example?redacted=XXXX"),
    ("url_keep_host", "http://a/?x?y", "http://a/?redacted=XXXX"),
    ("name", "Noor", "XXXX"),
    ("name", "Otto Brandt", "XXXXXXXXXXX"),
    ("name", "", ""),
    ("name", "Zoë", "XXX"),
    ("name", "a\nb", "XXX"),
    ("name", "\U0001f600b", "XX"),
    ("labeled_field", "Pin: 4711", "Pin: XXXX"),
    ("labeled_field", "dob:4/9/71", "dob:XXXX"),
    ("labeled_field", "secret=s", "XXXX"),
    ("labeled_field", "License: \t  K-1", "License: \t  XXXX"),
    ("labeled_field", "token=a:b", "token=a:XXXX"),
    ("labeled_field", "pin:\n x", "pin:\n XXXX"),
    ("labeled_field", "pin:: x", "pin:XXXX"),
    ("alphanumeric", "FR14 2004/3M02", "XXXX XXXX/XXXX"),
    ("alphanumeric", "x_4-b", "X_X-X"),
    ("alphanumeric", "", ""),
    ("alphanumeric", "é٣½ß_#", "XXXX_#"),
]


def test_masks(spark):
    rows = [(i, m, v) for i, (m, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, m string, v string")
    for mask, function in MASKS.items():
        masked = df.filter(df.m == mask).select("i", function("v").alias("out")).collect()
        assert masked
        for row in masked:
            assert row["out"] == CASES[row["i"]][2], CASES[row["i"]]


@pytest.mark.parametrize("mask", MASKS)
def test_null_stays_null(spark, mask):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(MASKS[mask]("v").alias("out")).first()["out"] is None


def test_masks_take_expressions(spark):
    df = spark.createDataFrame([("Otto", "Kim")], "a string, b string")
    assert df.select(MASKS["name"]("concat(a, b)").alias("out")).first()["out"] == "X" * 7
