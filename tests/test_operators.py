"""Errors that formats demand, files on disk, and functions without a registered query."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec, mime, paths, redirects
from palimpsest.operators import comments, crawl, html, maps, pages, styles, tapes
from palimpsest.sources import control, files


def text_file(spark, text):
    return spark.createDataFrame([("m.txt", text)], "path string, text string")


@pytest.mark.parametrize("text", ["k\nv\n***\n", "k\nv\n----\nrest\n", "k\n"])
def test_triplets_refuse(spark, text):
    with pytest.raises(Exception, match="no record"):
        control.triplets(text_file(spark, text)).collect()


def test_blank_triplets_are_refused_in_strict_files(spark):
    text = "k\nv\n----\n\n\n\n"
    assert [r["key"] for r in control.triplets(text_file(spark, text)).collect()] == ["k"]
    with pytest.raises(Exception, match="no record"):
        control.triplets(text_file(spark, text), blanks=False).collect()


def test_page_map_conflict(spark):
    with pytest.raises(Exception, match="two files"):
        control.page_map(text_file(spark, "u\na.html\nh\n----\nu\nb.html\nh\n----\n")).collect()


def test_map_is_composed_and_read_again(spark):
    rows = [("http://a", "x"), ("http://b", "y z")]
    entries = spark.createDataFrame(rows, "key string, value string")
    composed = control.compose(entries).withColumn("path", F.lit("m"))
    assert sorted((r["key"], r["value"]) for r in control.triplets(composed).collect()) == rows
    with pytest.raises(Exception, match="key exists"):
        control.appended(entries, entries.limit(1)).collect()


def test_files_on_disk(spark, tmp_path):
    for name, content in (("a/1.HTML", b"<p>x"), ("a/b/2.shtm", b"y"), ("a/b/c.txt", b"z"), ("list.txt", "﻿# c\r\nx\r\n".encode())):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    root = str(tmp_path)
    assert sorted(r["relpath"] for r in files.scan_pages(spark, root).collect()) == ["a/1.HTML", "a/b/2.shtm"]
    assert [r["relpath"] for r in files.scan_pages(spark, root, only_html=True).collect()] == ["a/1.HTML"]
    assert sorted(r["relpath"] for r in files.directories(files.scan(spark, root)).collect()) == ["a", "a/b"]
    assert [r["line"] for r in control.line_list(control.whole(spark, f"{root}/list.txt")).collect()] == ["x"]


def test_store_files(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "relpath string, content binary")
    folder = str(tmp_path / "out")
    states = lambda rows: {r["relpath"]: r["state"] for r in files.store_files(frame(rows), folder).collect()}
    rows = [("a/x.jpg", bytearray(b"1")), ("y", bytearray(b"2"))]
    assert states(rows) == {"a/x.jpg": "new", "y": "new"}
    assert states(rows) == {"a/x.jpg": "reused", "y": "reused"}
    assert states([("a/x.jpg", bytearray(b"other"))]) == {"a/x.jpg": "renamed"}
    assert states([("a/x.jpg", bytearray(b"other"))]) == {"a/x.jpg": "reused"}
    assert sorted(p.name.split("_")[0] for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["x", "x.jpg", "y"]


def test_spellings_that_collide_are_an_error(spark):
    stored = spark.createDataFrame([("a/X", False), ("a/x", False)], "relpath string, is_dir boolean")
    with pytest.raises(Exception, match="collide"):
        maps.spelled(stored).collect()


def test_months_out_of_range(spark):
    good = spark.createDataFrame([("j/2001/12/5.html",), ("j/2001/02/7.html",)], "relpath string")
    assert [(r["year"], r["month"]) for r in files.month_files(good).collect()] == [(2001, 2), (2001, 12)]
    with pytest.raises(Exception, match="no month"):
        files.month_files(spark.createDataFrame([("j/2001/13/5.html",)], "relpath string")).collect()


def test_comment_json_kinds(spark):
    bad = spark.createDataFrame([(1, '{"comments": [{"thread": true}]}')], "page_id long, json string")
    with pytest.raises(Exception, match="wrong kind"):
        comments.from_json(bad).collect()
    flag = spark.createDataFrame([(1, '{"comments": [{"thread": 1, "loaded": 2}]}')], "page_id long, json string")
    with pytest.raises(Exception, match="no flag"):
        comments.from_json(flag).collect()


def test_embedded_json(spark):
    frame = spark.createDataFrame([('x Site.page = {"a": 1}; y',), ("none",)], "s string")
    assert [r[0] for r in frame.select(comments.embedded_json(F.col("s"))).collect()] == ['{"a": 1}', None]


def test_ragged_snapshots(spark):
    with pytest.raises(Exception, match="ragged"):
        crawl.snapshots(spark.createDataFrame([("u", '[["timestamp","original","statuscode"],["1","2"]]')], "url string, json string")).collect()


def test_triples_out_of_order(spark):
    rows = spark.createDataFrame([("s", 1, "a", "x")], "source string, pos int, kind string, text string")
    with pytest.raises(Exception, match="out of order"):
        tapes.triples(rows).collect()


def test_consensus(spark):
    rows = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "k int, v string")
    assert {r["k"]: r["v"] for r in tapes.consensus(rows, ["k"], "v").collect()} == {1: "x", 2: "y"}
    with pytest.raises(Exception, match="differ"):
        tapes.consensus(rows.unionByName(spark.createDataFrame([(1, "z")], "k int, v string")), ["k"], "v").collect()


@pytest.mark.parametrize("source", ["", "plain", "<", "<a", "<!-- open", "</b>stray", "<p>a<p>b<table><tr><td>x<td>y</table>", "<script>if (a < b) { '</p>' }</script>", "<b><i>x</b>y</i>", "<A HREF='x' HREF=y>z", "<td>cell<li>item"])
def test_parsing_is_stable(source):
    once = html.render(html.nodes(source))
    assert html.render(html.nodes(once)) == once
    tree = html.nodes(source)
    assert [n["pos"] for n in tree] == list(range(len(tree)))
    assert all(tree[n["parent"]]["depth"] == n["depth"] - 1 and n["parent"] < n["pos"] for n in tree[1:])


def test_data_urls():
    assert codec.data_url("data:image/png;base64,aGk=") == {"media_type": "image/png", "extension": "png", "content": b"hi"}
    assert codec.data_url("data:,a%20b")["content"] == b"a b"
    assert codec.data_url("http://x") is None


def test_paths_are_found_again():
    for url in ("https://a.org/x/y.jpg", "https://a.org:8080/x?q=1", "https://a.org", "https://a.org/a%20b/c"):
        assert paths.original_url(paths.file_path(url)) == url
    long = "https://a.org/" + "/".join(["part" * 10] * 9) + "/z.png"
    assert paths.file_path(long).startswith("a.org/@@@/x-") and paths.file_path(long).endswith(".png") and paths.file_path(long) == paths.file_path(long)
    assert paths.numbered("A.txt", ["a.TXT", "a_2.txt"]) == "A_3.txt"


def test_unwrapping_ends():
    for url in ("https://www.google.com/url?q=https%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dx", "http://infonarod.ru/away.php?url=http://infonarod.ru/away.php", "http://p.dreamwidth.org/x", "https://l.facebook.com/l.php?u=x"):
        assert redirects.unwrap(redirects.unwrap(url)) == redirects.unwrap(url)


def test_style_texts():
    assert styles.localised('a{b:url("http://h/x.png")}', {"http://h/x.png": "l/x.png"}) == 'a{b:url("l/x.png")}'
    assert styles.external("@import url(//h.org/a.css); b{c:url(d.png)}") == ["https://h.org/a.css"]
    assert styles.shifted("a{b:url(../../x)}", -1) == "a{b:url(../x)}"


def test_sniffed_types():
    assert mime.sniff(b"<?xml version='1.0'?><svg xmlns='x'>") == "image/svg+xml"
    assert mime.sniff(b"  <html><body>") == "text/html"
    assert mime.sniff(b"RIFF0000WEBPVP8 ") == "image/webp"


def _tree(spark, source):
    return html.parse(spark.createDataFrame([(1, 1, source)], "album long, page int, html string"))


@pytest.mark.parametrize("source, column, message", [
    ('<p class="b-pics-pager">1/3</p><p class="b-pics-pager">1/4</p>', "pages", "pagers differ"),
    ('<p class="b-pics-pager">2/3</p>', "pages", "pagers differ"),
    ('<a class="b-pics-pager-next" href="/x">n</a>', "next", "next pages differ"),
])
def test_pagers_refuse(spark, source, column, message):
    made = {"pages": pages.album_pages, "next": pages.album_next}[column](F.col("nodes"))
    with pytest.raises(Exception, match=message):
        _tree(spark, source).select(made).collect()


def test_albums_need_all_pages(spark):
    with pytest.raises(Exception, match="pages of an album are missing"):
        pages.album_frames(_tree(spark, '<div class="b-pics-inner"><p class="b-pics-pager">1/2</p></div>')).collect()


def test_styles_need_one_mark(spark):
    with pytest.raises(Exception, match="primary blocks: 0"):
        pages.primary_only(_tree(spark, "<div>x</div>")).collect()
    with pytest.raises(Exception, match="article anchors: 2"):
        pages.around_anchor(_tree(spark, "<img width=1 height=3><img width=1 height=3>")).collect()


def test_deletes_need_a_file(spark):
    gone = spark.createDataFrame([("x",)], "relpath string")
    with pytest.raises(Exception, match="no such file: x"):
        maps.scheduled_deletes(gone, spark.createDataFrame([("y", False)], "relpath string, is_dir boolean")).collect()
