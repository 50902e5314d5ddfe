from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import documents, text, times, urls


def values(spark, inputs, expression, kind="string"):
    """Results of an expression over column x, in input order."""
    rows = [(place, value) for place, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"n int, x {kind}")
    return [row["y"] for row in df.select("n", expression(F.col("x")).alias("y")).orderBy("n").collect()]


def test_longer(spark):
    """Every pair of a few texts of the given table and blanks, against the lengths of what strip leaves."""
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    values_ = [None, "\t\n", some[0], f"\n{some[1]} \t", some[2][:9], some[3][:9] + "\u2003"]
    pairs = [(one, other) for one in values_ for other in values_]
    df = spark.createDataFrame([(n, *pair) for n, pair in enumerate(pairs)], "n int, a string, b string")
    got = [r["y"] for r in df.select("n", text.longer(F.col("a"), F.col("b")).alias("y")).orderBy("n").collect()]
    stripped = [[(x or "").strip() for x in pair] for pair in pairs]
    assert got == [max(pair, key=len) or None for pair in stripped]


def test_clean_text_decodes_last_and_folds_space(spark):
    cases = {
        "<td class='x'>left</td><td>right</td>": "left right",
        "one&lt;two &quot;q&quot; &amp;gt;": 'one<two "q" &gt;',
        "\u2003\n": "",
        None: "",
        "1<hr>\r\n2\t<i>3</i>": "1 2 3",
        "&eacute;t&eacute; &#252; &#x3b1; AT&T &reg 9": "été ü α AT&T ® 9",
    }
    assert values(spark, list(cases), text.clean_text) == list(cases.values())
    assert values(spark, ["<i>z</i>  y "], lambda c: text.clean_text(c, collapse=False)) == [" z   y "]


def test_words_and_capitalised(spark):
    assert values(spark, ["Äiti ja isä-poika x1 ab"], text.words) == [["Äiti", "isä-poika"]]
    assert values(spark, ["hELSINKI", ""], text.capitalised) == ["Helsinki", ""]


def test_dates(spark):
    cases = {
        "Tue, 01 Jul 2026 17:00:00 +0000": datetime(2026, 7, 1, 17),
        "1 Jul 2026 17:00 +0300": datetime(2026, 7, 1, 14),
        "Wednesday, 01-jul-26 17:00:00 GMT": datetime(2026, 7, 1, 17),
        "Tue, 01 Jul 1999 17:00:00 EST": datetime(1999, 7, 1, 22),
        "01 Jul 70 17:00:00": datetime(1970, 7, 1, 17),
        "31 Feb 2026 17:00:00 GMT": None,
        "2026-07-01T17:00:00Z": None,
        "ei-paivays": None,
        "": None,
        None: None,
    }
    naive = lambda column: times.parse_rfc2822(column).cast("timestamp_ntz")
    assert values(spark, list(cases), naive) == list(cases.values())
    either = lambda column: times.parse_any(column).cast("timestamp_ntz")
    assert values(spark, ["2026-07-01T17:00:00Z", "2026-07-01T17:00:00+02:00", "ei-paivays"], either) == [
        datetime(2026, 7, 1, 17), datetime(2026, 7, 1, 15), None,
    ]


def test_rfc3339_prints_micros_only_when_there_are_any(spark):
    printed = lambda column: times.rfc3339(column.cast("timestamp"))
    assert values(spark, ["2026-07-01 17:00:00", "2026-07-01 17:00:00.5"], printed) == [
        "2026-07-01T17:00:00Z", "2026-07-01T17:00:00.500000Z",
    ]


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("/rss/a.xml", "https://x.fi:8080/rss/a.xml"),
        ("//cdn.fi/rss", "https://cdn.fi/rss"),
        ("https://y.fi/rss", "https://y.fi/rss"),
        ("rss", "rss"),
    ],
)
def test_absolute_url(spark, href, expected):
    assert values(spark, [href], lambda c: urls.absolute_url(c, F.lit("https://x.fi:8080/a/b?q#f"))) == [expected]


def test_http_urls(spark):
    assert values(spark, ["http://a", "HTTPS://a/b", "ftp://a", "http:///x", "", None], urls.is_http_url) == [
        True, True, False, False, False, False,
    ]


def test_with_fields_keeps_other_keys_and_values(spark):
    df = spark.createDataFrame(
        [(1, '{"a":{"b":[1,"x"]},"n":null,"name":"old"}', "new"), (2, '{"name":"old"}', None), (3, "{bad", "x"), (4, "[1]", "x")],
        "id int, doc string, name string",
    )
    got = {r["id"]: r["doc"] for r in documents.with_fields(df, "doc", {"name": F.col("name"), "z": F.lit(1)}).collect()}
    assert got[1] == '{"a":{"b":[1,"x"]},"n":null,"name":"new","z":1}'
    assert got[2] == '{"name":"old","z":1}'
    assert got[3] is None and got[4] is None
