from datetime import datetime
from html import escape

import pytest
from pyspark.sql import functions as F

from newsloom.sources import feeds, pages, tables

RSS = (
    '<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:atom="http://www.w3.org/2005/Atom"><channel>{}</channel></rss>'
)
DAY = "Fri, 05 Jan 2024 0{}:30:00 +0100"


def feed(spark, *documents):
    return spark.createDataFrame([("hs", text) for text in documents], "source string, xml string")


@pytest.fixture(scope="module")
def openings(spark):
    """The opening of a few given documents, as feeds would carry them."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(6).collect()
    return [" ".join(r.text.split())[:70].strip() for r in rows]


def item(number, title, *more, dated=True):
    date = f"<pubDate>{DAY.format(number)}</pubDate>" if dated else ""
    return f"<item><title>{escape(title)}</title><link>\n https://news.example/{number}\t</link>{date}{''.join(more)}</item>"


def test_many_items_in_one_feed(spark, openings):
    """Dated items come out whole; the others are kept apart with a reason."""
    entries = [item(n, title, f"<description><![CDATA[<p>{title} & more</p>]]></description>", dated=n != 3) for n, title in enumerate(openings)]
    entries.append(f"<item><title>{escape(openings[0])}</title><pubDate>{DAY.format(9)}</pubDate></item>")
    feeds_ = feed(spark, RSS.format("<title>x</title>" + "".join(entries)))
    rows = feeds.parse_feeds(feeds_).withColumn("published", F.col("published").cast("timestamp_ntz")).collect()
    assert {(r.title, r.link, r.summary, r.published) for r in rows} == {
        (t, f"https://news.example/{n}", f"{t} & more", datetime(2024, 1, 5, n - 1 if n else 23, 30) if n else datetime(2024, 1, 4, 23, 30))
        for n, t in enumerate(openings) if n != 3
    }
    assert [r.link for r in feeds.undated_items(feeds_).collect()] == ["https://news.example/3"]
    assert {(r.title, r.reason) for r in feeds.rejected_items(feeds_).collect()} == {
        (openings[3], "no readable date"), (openings[0], "no link")}


def test_the_first_of_repeated_elements_counts(spark, openings):
    one, two = openings[:2]
    body = item(1, one, f"<title>{escape(two)}</title>", "<link>https://news.example/other</link>", f"<description>{escape(one)}</description>",
                f"<description>{escape(two)}</description>", '<media:thumbnail url="https://img.example/1"/><media:thumbnail url="https://img.example/2"/>')
    row = feeds.parse_feeds(feed(spark, RSS.format(body))).first()
    assert (row.title, row.link, row.summary, row.image_url) == (one, "https://news.example/1", one, "https://img.example/1")


def test_feeds_that_are_not_well_formed(spark, openings):
    stray = RSS.format(item(1, "x").replace("<title>x", "<title>R&D &nbsp;&eacute; A &amp; B"))
    cut = RSS.format(item(2, openings[0]))[:-20]
    assert [r.title for r in feeds.parse_feeds(feed(spark, stray, cut)).collect()] == ["R&D \u00a0é A & B"]
    rejected = feeds.rejected_feeds(feed(spark, stray, cut, " ", None)).collect()
    assert sorted((r.xml or "", r.reason) for r in rejected) == sorted([(cut, "not readable as a feed"), (" ", "empty document"), ("", "empty document")])


def test_atom_dates_option(spark, openings):
    xml = RSS.format(item(4, openings[4], "<atom:updated>2024-01-07T08:15:00Z</atom:updated>", dated=False))
    assert feeds.parse_feeds(feed(spark, xml)).count() == 0
    row = feeds.parse_feeds(feed(spark, xml), atom_dates=True).select(F.col("published").cast("timestamp_ntz")).first()
    assert row[0] == datetime(2024, 1, 7, 8, 15)


def test_image_of_an_item(spark, openings):
    """Any thumbnail, however deep, then an image among the enclosures, then the channel's image."""
    def thumb(name):
        return f'<media:thumbnail url="https://img.example/{name}"/>'

    def enclosure(name, kind):
        return f'<enclosure url="https://img.example/{name}" type="{kind}"/>'

    bodies = [
        [enclosure("sound", "audio/ogg"), enclosure("picture", "image/webp")],
        [enclosure("picture", "image/webp"), thumb("small")],
        [f"<media:content>{thumb('inside')}</media:content>"],
        [f"<media:group><media:content>{thumb('deep')}</media:content></media:group>"],
        [f"<media:group>{thumb('group')}</media:group>", enclosure("picture", "image/webp")],
        [],
    ]
    xml = RSS.format("<image><url>\nhttps://img.example/site </url></image>" + "".join(item(n, openings[n], *b) for n, b in enumerate(bodies)))
    got = {int(r.link[-1]): r.image_url.rsplit("/", 1)[1] for r in feeds.parse_feeds(feed(spark, xml)).collect()}
    assert got == {0: "picture", 1: "small", 2: "inside", 3: "deep", 4: "group", 5: "site"}


@pytest.mark.parametrize("xml", ["<channel></channel></rss>", "</rss>", '<rss version="2.0"></rss>', "not xml", None])
def test_empty_feeds(spark, xml):
    df = spark.createDataFrame([("hs", xml)], "source string, xml string")
    assert feeds.parse_feeds(df).count() == 0


def test_items_outside_the_channel(spark, openings):
    xml = f"<rdf><channel><title>t</title></channel>{item(5, openings[5])}{item(6, openings[1])}</rdf>"
    assert {r.title for r in feeds.parse_feeds(feed(spark, xml)).collect()} == {openings[5], openings[1]}


def test_feed_lists_and_files(spark, tmp_path, openings):
    text = '[{"name":"north","url":"https://n.example"},{"name":"","url":"https://e.example"},{"url":"https://s.example"},{"name":"west","url":"https://w.example","autodiscover":true}]'
    rows = feeds.load_feeds(spark.createDataFrame([(text,)], "feeds string")).collect()
    assert [(r.name, r.autodiscover) for r in rows] == [("north", False), ("west", True)]
    (tmp_path / "a.xml").write_text(RSS.format(item(7, openings[0])))
    files = feeds.read_feed_files(spark, str(tmp_path)).withColumn("source", F.lit("hs"))
    article = feeds.feed_articles(feeds.parse_feeds(files)).first()
    assert article.id.startswith("https://example.org/ap/objects/articles/hs/") and '"Helsingin Sanomat"' in article.object_json
    assert "image" not in article.object_json


def metadata(spark, html):
    return pages.extract_page_metadata(spark.createDataFrame([("https://e.com/req", html)], "url string, html string")).first()


def test_page_metadata_of_given_texts(spark, openings):
    one, two = (escape(t, quote=True) for t in openings[:2])
    html = (
        f'<head><meta content="{one}" property="og:title"><meta property="og:description" content="{two}">'
        '<meta property="og:site_name" content="Site"><meta property="og:url" content="https://e.example/c?a=1&amp;b=2">'
        '<meta property="og:image" content="https://img.example/p.webp"><meta property="article:modified_time" content="2024-01-08">'
        f'<meta property="article:published_time" content="2024-01-07"><title>{two}</title></head>'
    )
    assert metadata(spark, html).asDict() == {
        "page_url": "https://e.com/req", "title": openings[0], "description": openings[1], "image": "https://img.example/p.webp",
        "url": "https://e.example/c?a=1&b=2", "site_name": "Site", "published_time": "2024-01-07", "modified_time": "2024-01-08",
    }


def test_page_metadata_fallbacks_and_precedence(spark):
    row = metadata(spark, '<title>Plain title</title><meta name="description" content="Plain words" />')
    assert (row.title, row.description, row.image, row.url) == ("Plain title", "Plain words", None, "https://e.com/req")
    row = metadata(spark, """<meta content='It&#39;s > 1' property=og:title><META PROPERTY="OG:TITLE" CONTENT="Last">
      <meta property="og:title" content=""><meta name=description content="first"><meta name=description content="second">
      <!-- <meta property="og:image" content="no"> --><script>'<meta property="og:image" content="no">'</script>""")
    assert (row.title, row.description, row.image) == ("Last", "first", None)
    row = metadata(spark, '<meta data-property="og:title" content="no"><meta property="og:title" content="a &quot;b&quot; > c property=x">')
    assert row.title == 'a "b" > c property=x'


def test_an_unpaired_quote_is_a_character(spark):
    row = metadata(spark, """<meta property=og:title content=Don't><meta property="og:description" content='a "b" > c'>""")
    assert (row.title, row.description) == ("Don't", 'a "b" > c')


def test_feeds_of_a_page_of_their_own(spark):
    from newsloom.operators import state

    feeds_ = spark.createDataFrame([("valtioneuvosto", "https://valtioneuvosto.fi/a", True), ("x", "https://x.example", True)], "name string, url string, autodiscover boolean")
    config = spark.createDataFrame([], "key string, value string, updated_at timestamp, updated_by string")
    found = spark.createDataFrame([("https://valtioneuvosto.fi/rss-syotteet", "https://valtioneuvosto.fi/r.xml")], "page_url string, feed_url string")
    assert [tuple(r) for r in state.resolved_feeds(feeds_, config, found).collect()] == [("valtioneuvosto", "https://valtioneuvosto.fi/r.xml")]
    assert [r.name for r in state.unresolved_feeds(feeds_, config, found).collect()] == ["x"]
    assert [tuple(r) for r in state.discovered_config(feeds_, config, found).collect()] == [("valtioneuvosto.rss_url", "https://valtioneuvosto.fi/r.xml")]


def test_feed_links(spark):
    cases = {
        '<link rel="stylesheet" href="/a.css"><link type="application/rss+xml" rel="alternate" href="/rss.xml">': "https://e.com/rss.xml",
        '<link rel="alternate" type="application/rss+xml"><a href="/x">x</a><a href="https://f/rss">y</a>': "https://f/rss",
        '<a href="/news/rss/all">y</a>': "https://e.com/news/rss/all",
        '<a href="/news">y</a>': None,
    }
    df = spark.createDataFrame([("https://e.com/p", html) for html in cases], "url string, html string")
    got = {r.html: r.feed_url for r in pages.discover_feed_links(df.withColumn("h", F.col("html")), html="h").collect()}
    assert got == cases
    special = spark.createDataFrame([("https://valtioneuvosto.fi/a",), ("https://valtioneuvosto.fi/rss-syotteet",)], "url string")
    assert {r[0] for r in special.select(pages.feed_page(F.col("url"))).collect()} == {"https://valtioneuvosto.fi/rss-syotteet"}


def test_table_layout_pruning_and_contract(spark, tmp_path):
    from newsloom.plans import views

    root = str(tmp_path)
    objects = views.objects(spark, "/root/testdata/sf0.001")
    tables.write_table(objects, root, "objects")
    stored = tables.read_table(spark, root, "objects")
    assert stored.count() == objects.count()
    assert tables.check_contract(stored) == []
    assert tables.check_contract(objects.drop("tags")) == ["missing column tags", "not partitioned by publication date"]
    from newsloom.operators.objects import in_window

    recent = in_window(stored, F.lit("2024-01-10").cast("date"), days=2)
    plan = recent.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_date" in plan and "ReadSchema: struct<id:string>" in plan
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(objects, root, "objects")
    log = tables.conform(views.activities(spark, "/root/testdata/sf0.001"), "activities")
    tables.append_activities(log, root)
    tables.append_activities(log, root)
    assert tables.read_table(spark, root, "activities", ["id"]).count() == 2 * log.count()
    with pytest.raises(ValueError, match="required columns"):
        tables.conform(log.drop("actor"), "activities")


# ---- damaged feeds ---------------------------------------------------------------------------------


def _many(n, broken=()):
    """A feed of n items; the broken ones are not well-formed."""
    items = [f"<item><title>t{i}</title><link>https://n/{i}</link><pubDate>Wed, 31 Jan 2024 12:00:00 GMT</pubDate>"
             + ("<b><i></b></i>" if i in broken else "") + "</item>" for i in range(n)]
    return "<rss><channel><title>c</title><image><url>https://n/c.png</url></image>" + "".join(items) + "</channel></rss>"


def _read_back(spark, *documents):
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(documents)], "source string, xml string")
    items = sorted((r["source"], int(r["title"][1:]), r["image_url"]) for r in feeds.parse_feeds(df).collect())
    lost = sorted((r["source"], r["reason"]) for r in feeds.damaged_items(df).collect())
    return items, lost, sorted(r["source"] for r in feeds.rejected_feeds(df).collect())


def test_a_feed_cut_in_its_last_item_keeps_the_others(spark):
    whole = _many(50)
    cut = whole[:whole.rindex("</pubDate>")]
    items, lost, rejected = _read_back(spark, cut, whole)
    assert items == [(s, i, "https://n/c.png") for s, n in (("s0", 49), ("s1", 50)) for i in range(n)]
    assert lost == [("s0", "not readable as an item")] and rejected == []


def test_damaged_items_in_the_middle(spark):
    items, lost, rejected = _read_back(spark, _many(5, {1, 3}), _many(2, {0, 1}), "", "no feed <item", None, _many(1)[:-20])
    assert [(s, i) for s, i, _ in items] == [("s0", 0), ("s0", 2), ("s0", 4)]
    assert lost == [("s0", "not readable as an item")] * 2
    assert rejected == ["s1", "s2", "s3", "s4", "s5"]


def test_an_item_without_its_end_does_not_swallow_the_next(spark):
    text = _many(3).replace("</item><item><title>t2", "<item><title>t2")
    items, lost, _ = _read_back(spark, text)
    assert [i for _, i, _ in items] == [0, 2] and len(lost) == 1


def test_items_of_damaged_feeds_with_stray_ampersands_and_namespaces(spark):
    text = ("<rdf:RDF xmlns:rdf='r'><channel rdf:about='x'/><item rdf:about='1'><title>t1 &nbsp; R&D</title><link>https://n/1</link>"
            "<pubDate>Wed, 31 Jan 2024 12:00:00 GMT</pubDate><media:thumbnail url='https://n/i.png'/></item><items/><item><title>t2</ti")
    df = spark.createDataFrame([("s", text)], "source string, xml string")
    got = feeds.parse_feeds(df).collect()
    assert [(r["link"], r["image_url"]) for r in got] == [("https://n/1", "https://n/i.png")] and "R&D" in got[0]["title"]


def test_a_very_long_damaged_feed(spark):
    text = _many(2).replace("t0", "t0" + "x" * 2_000_000)[:-30]
    df = spark.createDataFrame([("s", text)], "source string, xml string")
    assert [len(r["title"]) for r in feeds.parse_feeds(df).collect()] == [2_000_002]
