"""Pages read through the tokenizer of markup."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from parcelforge.sources import pages
from parcelforge.sources.markup import Page


def of_pages(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "page_id int, html string")


def facts(spark, *sources):
    return [(r.image_url, r.area, r.room_text) for r in pages.extract_page_facts(of_pages(spark, *sources)).orderBy("page_id").collect()]


def test_facts_in_words_and_escaped(spark):
    """Net areas with their label, JSON written with entities, entities in meta tags, and the end of a unit."""
    got = facts(
        spark, "Brüt 120 m² Net Alanı: 95 m²", '<script type="application/ld+json">{&quot;floorSize&quot;: 88, &quot;numberOfRooms&quot;: 4}</script>', '<meta content="https://i.example/a?x=1&amp;y=2" property="og:image">',
        "5 + 1 oda 1.250,6 m2, Kullanım alanı 110 m²'dir", "<p>net <b>99</b> m²</p>", "alan 12 m2x ve 9 m²", "<!-- net 50 m² --><style>net 60 m²</style>STÜDYO 70 METREKARE", "net 5 m² brüt 200.000 m² 44 m²",
    )
    assert got == [(None, 95.0, None), (None, 88.0, "4"), ("https://i.example/a?x=1&y=2", None, None), (None, 1251.0, "5+1"), (None, 99.0, None), (None, None, None), (None, 70.0, "STÜDYO"), (None, None, None)]


def test_facts_of_columns_come_first(spark):
    rows = spark.createDataFrame([(1, "<p>net 90 m²</p>", "Net 80 m²", None), (2, '<meta name="description" content="2+1, net 70 m²"><p>net 90 m² 5+1</p>', "", None)], "page_id int, html string, title string, snippet string")
    assert [(r.area, r.room_text) for r in pages.extract_page_facts(rows).orderBy("page_id").collect()] == [(80.0, None), (70.0, "2+1")]
    many = '<meta property="og:image" content="a.jpg"><meta property="og:image:secure_url" content="s.jpg">'
    (row,) = pages.extract_page_facts(of_pages(spark, many)).collect()
    assert (row.image_url, row.image_source) == ("s.jpg", "og:image")


CARD = "<ul><li class='listing-item'>{link}\n<span class='list-view-price'>1.500.000 TL</span>\n<ul><li>Oda Sayısı</li>\n<li>3 +\n1</li>\n<li>BRÜT M²</li>\n<li>120</li></ul>\n{image}</li></ul>"
LINK, IMAGE = "<a href='/ilan/7' title='Ev' class='listingView__card-link'>", "<img src='https://hecdn.example/a.jpg'>"


def cards(spark, *sources, **options):
    return pages.extract_listing_cards(of_pages(spark, *sources), F.lit(datetime.datetime(2024, 1, 1)), **options).orderBy("page_id", "pos").collect()


def test_cards_of_any_shape(spark):
    got = cards(
        spark, CARD.format(link=LINK, image=IMAGE), CARD.format(link="<a href=/ilan/8>x</a>\nKonak'ta deniz manzaralı daire", image="<img data-src='/logo/hecdn.png' src='data:image/hecdn' srcset='//x.hemlak.example/b.jpg 2x, c.jpg'>"),
        CARD.format(link="", image=IMAGE), CARD.format(link=LINK.replace("7", "9"), image="<img src='https://img.example/a.jpg'>"), CARD.format(link=LINK.replace("7", "10"), image=IMAGE).replace("120", "-"), None, "",
    )
    assert [(r.source_url, r.price, r.gross_area, r.room_text, r.title, r.image_url) for r in got] == [
        ("https://www.hepsiemlak.com/ilan/7", 1_500_000.0, 120.0, "3+1", "Ev", "https://hecdn.example/a.jpg"), ("https://www.hepsiemlak.com/ilan/8", 1_500_000.0, 120.0, "3+1", "Konak'ta deniz manzaralı daire", "https://x.hemlak.example/b.jpg"),
    ]
    assert [(r.source_listing_id, r.external_id, r.record_count) for r in got] == [("ilan/7", "hepsiemlak:ilan/7", 1.0), ("ilan/8", "hepsiemlak:ilan/8", 1.0)]


def test_cards_of_a_page_are_bounded_unless_asked(spark):
    page = "".join(CARD.format(link=LINK.replace("7", str(k)), image=IMAGE if k % 2 else "") for k in range(100))
    assert [r.source_url for r in cards(spark, page)] == [f"https://www.hepsiemlak.com/ilan/{k}" for k in range(1, 60, 2)]
    assert len(cards(spark, page, most=None)) == 50


def test_population_pages_of_any_shape(spark):
    html = """<ul class="breadcrumb"><li><a>T</a><li><a>İzmir Nüfusu</a></ul><h1 id="ust_baslik">Konak NÜFUSU, 2024</h1>\n<ul class="a boxDetaylar"><li><b class=dtColOne>Belde toplam nüfus</b><b class=dtColTwo>1</b>
    <li><b class=dtColOne>Toplam Nüfus</b><b class=dtColTwo>1.234</b><li><b class=dtColOne>Toplam Kadın Nüfusu</b><b class=dtColTwo>600</b></ul>
    <table><tr><td data-label='TOPLAM NÜFUS'>10</td><td data-label="MAHALLE ADI"><a href='/77-x'>Alsancak</a></td><td>5<td data-label='ERKEK NÜFUS'>6<tr><td>kein</td></tr></table>"""
    got = pages.parse_population_pages(spark.createDataFrame([(None, "", html)], "city string, district string, html string")).orderBy("location_level").collect()
    assert [(r.city, r.district, r.neighborhood, r.year, r.population_total, r.population_male, r.population_female, r.source_key, r.source_url) for r in got] == [
        ("İzmir", "Konak", None, 2024, 1234.0, None, 600.0, "nufusune:izmir:konak", None), ("İzmir", "Konak", "Alsancak", 2024, 10.0, 6.0, 6.0, "nufusune:77", "https://www.nufusune.com/77-x"),
    ]


@pytest.mark.parametrize("piece", ['<a href="', "<li>", "<div>", "</x>", "<!--", "<a b='c' ", "<script>", "<p><b>", "< ", "&amp;<td>", "<li class=listing-item>"])
def test_time_grows_with_the_length(piece):
    start = time.time()
    page = Page(piece * (1_000_000 // len(piece)))
    page.visible()
    assert time.time() - start < 20


def test_elements():
    page = Page("<ul><li CLASS='a b' x=1 x=2>one<ul><li>in</ul>tail<li>two<br/>&lt;</ul><td>c<td>d</td></table><p>x<div>y</div><textarea><b></textarea>")
    assert [page.names[k] for k in page.within()] == ["ul", "li", "ul", "li", "li", "br", "td", "td", "p", "div", "textarea"]
    assert [page.text(k) for k in page.having("li")] == ["oneintail", "in", "two<"] and [page.text(k) for k in page.having("td")] == ["c", "dxy<b>"[:1]]
    assert page.attrs[1] == {"class": "a b", "x": "1"} and [*page.having("li", "b")] == [1] and page.text(8) == "x"


def test_plain_pages_are_read_by_pieces_as_by_the_state_machine(monkeypatch):
    """The same elements and texts, of random pages; cards as they are found are plain."""
    bits = ["<a href='x>y'>", '<a href="<b>">', "</a>", "<li>", "</li>", "<ul class=\"x y\">", "</ul>", "<p>", "<br/ >", "<img src=a>", "<SCRIPT type='t'>", "</script >", "</scriptx>", "<title>", "</title>", "<!-- ", "-->", "<!x>", "</", ">", " ", "&amp;", "<td>", "<tr>", "<é>", "<", "<a b", "<a B='2' b='3'>"]
    rng, state = random.Random(3), lambda p: (p.names, p.attrs, p.begin, p.end, p.last, p.texts, p.kinds)
    sources = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)]
    got = [state(Page(x)) for x in sources]
    monkeypatch.setattr(Page, "read", None)
    assert Page("<li data-x='>' class=\"box\">a<!-- <li> --><b>c</b></li>").texts == ["a", "c"]
    monkeypatch.undo()
    monkeypatch.setattr(Page, "read_plain", lambda self, s: False)
    assert got == [state(Page(x)) for x in sources]
