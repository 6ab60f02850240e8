"""Cases of archived pages: markup, links and maps, comment threads, tapes, styles, crawls, control files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import filters, mime
from palimpsest.operators import comments, crawl, html, maps, pages, styles, tapes
from palimpsest.plans.fixtures import Case, mapped, registered
from palimpsest.sources import control, files
from palimpsest.streaming import activity

_MARKUP = [
    (1, "<a data-href=\"x\" href=\"y\">1</a><a href='q'>2</a><a href=bare>3</a><a href = \"s&amp;t\">4</a><!-- <a href=\"no\"> --><a href=\"#top\">5</a><a href=\"\">6</a><A HREF=Up>7</A>"),
    (2, "<p class='one, two'>first<p class=\"two\tthree\">second <b>bold</b><script>var a = '<a href=\"z\">';</script><ul><li>x<li>y<img src=i.png></ul>"),
    (3, "<table><tr><td height=10 class=x>1<td>2<tr><td><article id=post7><p>body</article></table><iframe src='https://youtu.be/abcdef1'></iframe>"),
    (4, None),
]
_PAGES = {"t": ("page_id long, html string", _MARKUP)}


def _parsed(t: DataFrame) -> DataFrame:
    return html.parse(t)


def _tags(t: DataFrame) -> DataFrame:
    n = F.col("nodes")
    say = lambda c: F.coalesce(F.size(c), F.lit(-1))
    return _parsed(t).where("html is not null").select(
        "page_id", say(html.elements(n, "P")).alias("p"), say(html.elements(n, "li")).alias("li"), say(html.by_attributes(n, "td", height="10", class_="x")).alias("td"),
        say(html.with_class(n, "one")).alias("one"), say(html.with_all_classes(n, ["two", "three"])).alias("two_classes"), say(html.comments(n)).alias("comments"), say(html.elements(n)).alias("n_elements"),
    )


def _texts(t: DataFrame) -> DataFrame:
    n = F.col("nodes")
    first = lambda tag: F.element_at(html.elements(n, tag), 1)["pos"]
    rows = _parsed(t).where("page_id in (2, 3)").withColumn("tag", F.when(F.col("page_id") == 2, "ul").otherwise("article"))
    at = F.when(F.col("page_id") == 2, first("ul")).otherwise(first("article"))
    above = F.transform(html.ancestors(n, at), lambda a: a["tag"])
    return rows.select("page_id", html.text_of(n, at).alias("text"), F.array_join(above, ">").alias("above"), html.inside(n, at, "table").alias("in_table"))


def _changed(t: DataFrame) -> DataFrame:
    n = F.col("nodes")
    rows = _parsed(t).where("page_id in (2, 3)")
    bare = html.without(pages.without_heights(n), html.elements(n, None, lambda x: x["tag"].isin("script", "iframe")))
    return html.serialize(rows.withColumn("nodes", html.without_blank_text(bare))).select("page_id", "html")


_THREAD = "page_id long, pos int, thread string, parent string, level int, type string, loaded boolean, uname string, ctime string, subject string, article string, leafclass string"
_ROWS = [
    (1, 0, "10", None, 1, None, True, "ann", "t", None, "hello", None),
    (1, 1, "11", "10", 2, None, True, "bob", "t", "re", "hi", None),
    (1, 2, "12", None, 1, None, True, None, "t", None, "anon", None),
    (1, 3, "13", "10", 2, None, False, None, None, None, None, None),
    (1, 4, "14", "11", 3, None, None, None, None, None, None, "deleted"),
    (1, 5, None, "12", 2, "more", None, None, None, None, None, None),
    (2, 0, "20", None, 1, None, True, "eve", "t", None, "x", None),
    (2, 1, "21", "99", 2, None, True, "eve", "t", None, "y", None),
    (2, 2, "22", "20", 3, None, True, "eve", "t", None, "z", None),
]
_JSON = '{"comments": [{"thread": 10, "level": 1, "loaded": 1, "uname": "ann", "parent": "0"}, {"thread_url": "https://a.org/1.html?thread=11#t11", "parent": 10, "level": "2", "loaded": 0}]}'

_LINKS = ("page string, pos int, href string", [("pages/2001/1.html", 0, "../../links/A.org/x.JPG#top"), ("pages/2001/1.html", 1, "../../links/a.org/dir"), ("pages/2001/1.html", 2, "../../links/a.org/none.gif"), ("pages/2001/1.html", 3, "http://a.org/"), ("pages/2001/1.html", 4, "../../links/a.org/two"), ("pages/2001/1.html", 5, "../../links/a.org/b%20c.png")])
_FILES = ("relpath string, is_dir boolean", [("links/a.org/x.jpg", False), ("links/a.org/dir", True), ("links/a.org/dir/only.css", False), ("links/a.org/two", True), ("links/a.org/two/1", False), ("links/a.org/two/2", False), ("links/a.org/b c.png", False)])
_MAP = ("url string, relpath string", [("http://a.org/x.jpg", "links/a.org/x.jpg"), ("https://a.org/y", "links/a.org/Y"), ("http://b.org/z", "links/b.org/z"), ("https://imgprx.livejournal.net/p/q", "links/a.org/x.jpg")])
_TAPE = ("journal string, year int, month int, rid long, head string, body string", [
    ("j", 2001, 2, 12, "<title>b</title><link rel=stylesheet href=s.css>", "B"), ("j", 2001, 2, 7, "<title>a</title>\n<link rel=stylesheet href=s.css>", "A"), ("j", 2001, 2, 9, "<link rel=stylesheet href=t.css>", "C"), ("j", 2002, 5, 30, "", "D"), ("j", 2004, 1, 31, "", "E"),
])


def _files(text: str):
    return {"t": ("path string, text string", [("m.txt", text)])}


_STYLED = {"t": ("page_id long, html string", [
    (1, '<html><body><div id=header>h</div><div id=wrap><div id=primary>main<div class="footer x">f</div><div class="bottompages comment-pages">2</div><div>in</div></div><div id=side>s</div></div><script>x</script></body></html>'),
    (2, '<html><body><table><tr><td>menu<td><img width=1 height=3><table><tr><td>in</table>text</table><table><tr><td>foot</table></body></html>'),
    (3, '<body><p class="b-bubble-alert">This journal has  been placed in\nmemorial status.</p><p class="b-bubble-alert">other</p>x</body>'),
])}
_ALBUMS = {"t": ("album long, page int, html string", [
    (1, 1, '<div class="b-pics-inner">one<p class="b-pics-pager"> 1/3 </p></div><p class="b-pics-pager">1/3</p><a class="b-pics-pager-next" href="http://a.org/2">n</a>'),
    (1, 2, '<div class="b-pics-inner">two<div class="b-pics-bar">bar</div><p class="b-pics-pager">2/3</p></div>'),
    (1, 3, '<div class="b-pics-inner">three</div>'),
    (2, 1, '<div class="b-pics-inner">alone<div class="b-pics-bar">bar</div></div>'),
])}
_ANSWERS = ("request string, " + _THREAD, [
    ("13", 1, 0, "13", "10", 2, None, True, "cat", "t", None, "late", None), ("13", 1, 1, "15", "13", 3, None, False, None, None, None, None, None), ("13", 1, 2, None, "13", 3, "more", None, None, None, None, None, None),
    ("15", 1, 0, "15", "13", 3, None, True, "dan", "t", None, "deep", None), ("15", 1, 1, "17", "15", 4, None, True, "eve", "t", None, "deeper", None),
    ("12", 1, 0, "12", None, 1, None, True, None, "t", None, "anon", None), ("12", 1, 1, "16", "12", 2, None, True, "fay", "t", None, "below", None),
])
_WAITING = (3, 0, "30", None, 1, None, True, "ann", "t", None, "x", None), (3, 1, "31", "30", 2, None, False, None, None, None, None, None)


CASES = [
    Case("markup_links", lambda t: html.link_facts(t, ["page_id"]).select("page_id", "pos", "tag", "href"), _PAGES, ("page_id long, pos int, tag string, href string", [(1, 0, "a", "y"), (1, 1, "a", "q"), (1, 2, "a", "bare"), (1, 3, "a", "s&t"), (1, 6, "a", "Up"), (2, 0, "img", "i.png")])),
    Case("markup_selectors", _tags, _PAGES, ("page_id long, p int, li int, td int, one int, two_classes int, comments int, n_elements int", [(1, 0, 0, 0, 0, 0, 1, 7), (2, 2, 2, 0, 1, 1, 0, 8), (3, 1, 0, 1, 0, 0, 0, 9)])),
    Case("markup_texts", _texts, _PAGES, ("page_id long, text string, above string, in_table boolean", [(2, "xy", "#root", False), (3, "body", "td>tr>table>#root", True)])),
    Case("markup_changes", _changed, _PAGES, ("page_id long, html string", [(2, '<p class="one, two">first</p><p class="two\tthree">second <b>bold</b></p><ul><li>x</li><li>y<img src="i.png"></li></ul>'), (3, '<table><tr><td class="x">1</td><td>2</td></tr><tr><td><article id="post7"><p>body</p></article></td></tr></table>')])),
    Case("article_paths", lambda t: html.serialize(pages.article_only(_parsed(t).where("page_id = 3"))), _PAGES, ("page_id long, html string", [(3, '<table><tr><td><article id="post7"><p>body</p></article></td></tr></table><iframe src="https://youtu.be/abcdef1"></iframe>')])),
    Case("embedded_frames", lambda t: pages.frames(_parsed(t), ["page_id"]).select("page_id", F.col("target.source").alias("source"), F.col("target.id").alias("id")), _PAGES, ("page_id long, source string, id string", [(3, "youtube", "abcdef1")])),
    mapped("comment_counts", pages.comment_presence, ["0 comments", "1 comment", "17 comments", "Leave a comment", "Comments disabled", "??"], [False, True, True, False, False, None], "boolean"),
    mapped("backgrounds", pages.background, ["color: red; background: #fff url( 'a b.png' ) no-repeat", "color: red"], ["a b.png", None]),
    mapped("archive_banners", pages.without_archive_banner, ["<head><title>x</title></head><!-- BEGIN WAYBACK TOOLBAR INSERT -->y<!-- END WAYBACK TOOLBAR INSERT --><a href=\"/web/20010101000000/http://a.org/\">"], ['<head><meta charset="utf-8"><title>x</title></head><a href="http://a.org/">']),
    mapped("pager_texts", pages.pager, ["1/12", " 3 / 4 ", "x"], [12, 4, None], "int"),
    Case("json_comments", lambda t: comments.from_json(t).select("page_id", "pos", "thread", "parent", "level", "loaded", "uname"), {"t": ("page_id long, json string", [(1, _JSON), (2, '{"comments": []}')])}, ("page_id long, pos int, thread string, parent string, level int, loaded boolean, uname string", [(1, 0, "10", None, 1, True, "ann"), (1, 1, "11", "10", 2, False, None)])),
    Case("comment_tree", lambda t: comments.tree(t).select("page_id", "thread", "expand", "violation"), {"t": (_THREAD, _ROWS)}, ("page_id long, thread string, expand boolean, violation string", [(1, "10", False, None), (1, "11", False, None), (1, "12", True, None), (1, "13", False, None), (1, "14", False, None), (2, "20", False, None), (2, "21", False, "missing parent"), (2, "22", False, "level off")])),
    Case("comment_order", lambda t: comments.in_order(t.where("page_id = 1")), {"t": (_THREAD, _ROWS)}, ("page_id long, thread string, level int, place long, indent string", [(1, "10", 1, 1, "0px"), (1, "11", 2, 2, "30px"), (1, "14", 3, 3, "60px"), (1, "13", 2, 4, "30px"), (1, "12", 1, 5, "0px")])),
    Case("comment_requests", lambda t: comments.first_to_load(t.where("page_id = 1")), {"t": (_THREAD, _ROWS)}, ("page_id long, thread string", [(1, "13")])),
    Case("comment_problems", lambda t: t.select("pos", comments.problem().alias("problem")), {"t": (_THREAD, [(1, 0, None, None, 1, "less", True, None, None, None, None, None), (1, 1, None, None, 2, "more", None, None, None, None, None, None), (1, 2, None, None, 1, None, True, None, None, None, None, None), (1, 3, "5", None, 0, None, True, None, None, None, None, None), (1, 4, "6", "5", 1, None, True, None, None, None, None, None), (1, 5, "7", None, 1, None, False, None, None, None, None, None), (1, 6, "8", None, 1, None, False, None, None, None, None, "screened")])}, ("pos int, problem string", [(0, "unknown type"), (1, "more without parent"), (2, "no thread"), (3, "no level"), (4, "top level with parent"), (5, "top level not loaded"), (6, None)])),
    Case("comment_merge", lambda t, u: comments.merge(t.where("page_id = 1"), u), {"t": (_THREAD, _ROWS), "u": (_THREAD, [(1, 0, "13", "10", 2, None, True, "cat", "t2", None, "late", None), (1, 1, "15", "13", 3, None, True, "dan", "t3", None, "new", None), (1, 2, "11", "10", 2, None, True, "bob", "t", "re", "changed", None), (1, 3, "16", "77", 3, None, True, "x", "t", None, "lost", None)])}, ("thread string, loaded boolean, uname string, article string, conflict string, added boolean, violation string", [("10", True, "ann", "hello", None, False, None), ("11", True, "bob", "hi", "article", False, None), ("12", True, None, "anon", None, False, None), ("13", True, "cat", "late", None, False, None), ("14", False, None, None, None, False, None), ("15", True, "dan", "new", None, True, None), ("16", True, "x", "lost", None, True, "missing parent")])),
    Case("rendered_comments", lambda t: comments.rendered(t.where("page_id = 1 and pos < 5")).select("thread", "html"), {"t": (_THREAD, _ROWS)}, ("thread string, html string", [("10", '<div style="margin-left: 0px"><b>ann</b>: hello</div>'), ("11", '<div style="margin-left: 30px"><b>bob</b> <i>re</i>: hi</div>'), ("12", '<div style="margin-left: 0px"><b>Anonymous</b>: anon</div>'), ("13", '<div style="margin-left: 30px">(not loaded)</div>'), ("14", '<div style="margin-left: 60px">(deleted)</div>')])),
    Case("missing_targets", lambda t, f: maps.missing(t, f), {"t": _LINKS, "f": _FILES}, ("page string, pos int, href string", [("pages/2001/1.html", 2, "../../links/a.org/none.gif")])),
    Case("case_changes", lambda t, f: maps.case_changes(t, f), {"t": _LINKS, "f": _FILES}, ("pos int, old string, new string", [(0, "../../links/A.org/x.JPG#top", "../../links/a.org/x.jpg#top")])),
    Case("directory_targets", lambda t, f: maps.directory_targets(t, f), {"t": _LINKS, "f": _FILES}, ("pos int, child string, problem string", [(1, "links/a.org/dir/only.css", None), (4, None, "several files")])),
    Case("existing_spellings", lambda t, f: maps.first_spelling_that_exists(t.withColumn("href", F.regexp_replace("href", "^[./]+", "")), f).select("pos", "rank", "actual"), {"t": _LINKS, "f": _FILES}, ("pos int, rank int, actual string", [(0, 0, "links/a.org/x.jpg"), (1, 0, "links/a.org/dir"), (4, 0, "links/a.org/two"), (5, 1, "links/a.org/b c.png")])),
    Case("map_checks", lambda m, f: maps.checked_map(m, f.unionByName(f.limit(1).selectExpr("'links/a.org/y' as relpath", "false as is_dir"))), {"m": _MAP, "f": _FILES}, ("url string, relpath string, state string", [("http://a.org/x.jpg", "links/a.org/x.jpg", "ok"), ("https://a.org/y", "links/a.org/y", "case"), ("http://b.org/z", "links/b.org/z", "missing"), ("https://imgprx.livejournal.net/p/q", "links/a.org/x.jpg", "ok")])),
    Case("map_lookups", lambda u, m: maps.lookup(u, m), {"u": ("url string", [("https://a.org/x.jpg",), ("https://a.org/y",), ("http://none.org",)]), "m": (_MAP[0], [*_MAP[1], ("http://a.org/y", "other")])}, ("url string, relpath string, exact boolean", [("https://a.org/x.jpg", "links/a.org/x.jpg", False), ("https://a.org/y", "links/a.org/Y", True), ("http://none.org", None, False)])),
    Case("map_best_urls", lambda m: maps.best_urls(m), {"m": _MAP}, ("key string, url string, rank int", [("links/a.org/x.jpg", "http://a.org/x.jpg", 0), ("links/a.org/y", "https://a.org/y", 0), ("links/b.org/z", "http://b.org/z", 0)])),
    Case("map_renames", lambda m, r: maps.renamed_map(m, r), {"m": _MAP, "r": ("old string, new string", [("links/A.org/x.jpg", "links/a.org/x.png"), ("c.org/q", "c.org/q.html")])}, ("url string, relpath string", [("http://a.org/x.jpg", "links/a.org/x.png"), ("https://imgprx.livejournal.net/p/q", "links/a.org/x.png"), ("https://a.org/y", "links/a.org/Y"), ("http://b.org/z", "links/b.org/z"), ("https://c.org/q", "c.org/q.html")])),
    Case("link_renames", lambda t, r: maps.renamed_links(t, r), {"t": ("page string, pos int, href string", [("p", 0, "a/b%20c.jpg#x"), ("p", 1, "a/d")]), "r": ("old string, new string", [("a/b c.jpg", "a/b c.png"), ("a/e", "a/f")])}, ("page string, pos int, old string, new string", [("p", 0, "a/b%20c.jpg#x", "a/b c.png#x")])),
    Case("unused_renames", lambda t, r: maps.unused_renames(r, t), {"t": ("page string, pos int, href string", [("p", 0, "a/b%20c.jpg#x")]), "r": ("old string, new string", [("a/b c.jpg", "1"), ("a/e", "2")])}, ("old string, new string", [("a/e", "2")])),
    Case("repository_states", lambda a, b: maps.merge_repositories(a.withColumn("content", F.encode("content", "UTF-8")), b.withColumn("content", F.encode("content", "UTF-8"))), {"a": ("relpath string, content string", [("x", "1"), ("y", "1"), ("z", "1")]), "b": ("relpath string, content string", [("x", "1"), ("y", "2"), ("w", "1")])}, ("relpath string, state string", [("x", "equal"), ("y", "conflict"), ("z", "kept"), ("w", "new")])),
    Case("failed_files", lambda t: maps.failed_by_file(t).select("key", F.array_join("urls", " ").alias("urls"), "image", "delete"), {"t": ("relpath string, url string, tag string", [("A/x", "http://2", "img"), ("a/X", "http://1", "a"), ("b", "http://3", "img")])}, ("key string, urls string, image boolean, delete boolean", [("a/x", "http://1 http://2", True, False), ("b", "http://3", True, True)])),
    Case("file_directory_clashes", lambda f: maps.file_directory_clashes(f.unionByName(f.limit(1).selectExpr("'links/a.org/DIR' as relpath", "false as is_dir"))), {"f": _FILES}, ("key string", [("links/a.org/dir",)])),
    Case("known_downloads", lambda t, m, n: maps.downloaded(t, m, n), {"t": ("name string, url string", [("p", "https://vk.com/away.php?to=http://a.org/x"), ("q", "http://c.org"), ("r", "http://d.org")]), "m": ("url string, relpath string", [("http://a.org/x", "1")]), "n": ("name string", [("q",)])}, ("name string, downloaded boolean", [("p", True), ("q", True), ("r", False)])),
    Case("album_names", lambda t: maps.album_collisions(t), {"t": ("album int, name string", [(1, "A.jpg"), (1, "a.JPG"), (1, "b.jpg"), (2, "a.jpg")])}, ("album int, name string, new_name string", [(1, "a.JPG", "a_2.JPG")])),
    Case("picture_twins", lambda t: maps.first_of_pictures(t), {"t": ("pos int, url string", [(0, "http://c.org/p?x=100"), (1, "https://c.org/p?y=2&x=400"), (2, "http://c.org/q?x=1"), (3, "http://c.org/q?x=2")])}, ("key string, url string", [("c.org/p", "https://c.org/p?y=2&x=400"), ("c.org/q", "http://c.org/q?x=1")])),
    Case("external_addresses", lambda t: maps.external_links(t, ["a.org"]), {"t": ("href string", [("http://www.A.org/x",), ("https://B.org/Y",), ("http://b.org/Y",), ("x/y",)])}, ("address string", [("b.org/Y",)])),
    Case("listed_addresses", lambda t, s: filters.in_set(t, "url", s), {"t": ("url string", [("http://Example.com/bad.gif",), ("https://example.com/tracker?1",), ("http://example.com/Bad.gif",)]), "s": ("line string", [("https://example.com/bad.gif",), ("http://example.com/tracker*",)])}, ("url string, listed boolean", [("http://Example.com/bad.gif", True), ("https://example.com/tracker?1", True), ("http://example.com/Bad.gif", False)])),
    Case("style_tapes", lambda t: tapes.tapes(t), {"t": _TAPE}, ("journal string, year int, month int, first_rid long, n_pages long, body string, part int, file string", [("j", 2001, 2, 7, 2, 'A<hr class="divider">B', 1, "2001-02-1.html"), ("j", 2001, 2, 9, 1, "C", 2, "2001-02-2.html"), ("j", 2002, 5, 30, 1, "D", 1, "2002-05.html"), ("j", 2004, 1, 31, 1, "E", 1, "2004-01.html")])),
    Case("tape_navigation", lambda t: tapes.navigation(tapes.tapes(t)), {"t": _TAPE}, ("journal string, file string, prev string, next string", [("j", "2001-02-1.html", None, "2001-02-2.html"), ("j", "2001-02-2.html", "2001-02-1.html", "2002-05.html"), ("j", "2002-05.html", "2001-02-2.html", "2004-01.html"), ("j", "2004-01.html", "2002-05.html", None)])),
    Case("tape_years", lambda t: tapes.year_navigation(t), {"t": _TAPE}, ("journal string, year int, prev int, next int", [("j", 2001, None, 2002), ("j", 2002, 2001, 2004), ("j", 2004, 2002, None)])),
    Case("tape_index", lambda t: tapes.flat_index(t.where("year = 2001")), {"t": _TAPE}, ("journal string, html string", [("j", '<a href="7.html">7</a><br>\n<a href="9.html">9</a><br>\n<a href="12.html">12</a>')])),
    mapped("tape_bars", lambda h: tapes.with_bar(h, F.lit(None).cast("string"), F.lit("i.html"), F.lit("n.html")), ['<html><body class=x><div id="navigation-bar">old</div>text'], ['<html><body class=x><div id="navigation-bar">prev | <a href="i.html">index</a> | <a href="n.html">next</a></div>text']),
    Case("returning_months", lambda t: tapes.month_runs(t.withColumn("date", F.to_date("date"))), {"t": ("source string, pos int, date string", [("s", 1, "2001-01-05"), ("s", 2, None), ("s", 3, "2001-02-01"), ("s", 4, "2001-01-31")])}, ("source string, run long, month string, n long, first_pos int", [("s", 1, "2001-01", 2, 1), ("s", 2, "2001-02", 1, 3), ("s", 3, "2001-01", 1, 4)])),
    Case("answer_triples", lambda t: tapes.triples(t), {"t": ("source string, pos int, kind string, text string", [("s", 1, "q", "?"), ("s", 2, "a", "!"), ("s", 5, "date", "d"), ("s", 6, "q", "??"), ("s", 7, "a", "!!"), ("s", 8, "date", "e")])}, ("source string, n long, question string, answer string, date string", [("s", 0, "?", "!", "d"), ("s", 1, "??", "!!", "e")])),
    Case("site_closure", lambda e, s: crawl.reachable(e, s, "http://a.org/", ["http://a.org/no"]), {"e": ("src string, dst string", [("http://a.org/", "http://a.org/1"), ("http://a.org/1", "http://a.org/2"), ("http://a.org/2", "http://a.org/"), ("http://a.org/1", "http://a.org/1"), ("http://a.org/1", "http://b.org/"), ("http://a.org/2", "http://a.org/no/x"), ("http://a.org/9", "http://a.org/8")]), "s": ("url string", [("http://a.org/",)])}, ("url string, depth int", [("http://a.org/", 0), ("http://a.org/1", 1), ("http://a.org/2", 2)])),
    Case("snapshot_lists", lambda t: crawl.snapshots(t), {"t": ("url string, json string", [("u", '[["original","statuscode","timestamp"],["http://u/2","200","20020101000000"],["http://u/1","200","20010101000000"],["http://u/3","404","20000101000000"]]'), ("v", "[]")])}, ("url string, timestamp string, original string", [("u", "20010101000000", "http://u/1"), ("u", "20020101000000", "http://u/2")])),
    Case("copy_sources", lambda t: crawl.sources(t), {"t": ("url string", [("https://vk.com/away.php?to=http://a.org/x",)])}, ("place int, source string, address string", [(0, "online", "http://a.org/x"), (1, "online", "https://vk.com/away.php?to=http://a.org/x"), (2, "archive", "http://a.org/x"), (3, "archive", "https://vk.com/away.php?to=http://a.org/x")])),
    Case("paced_requests", lambda t: crawl.paced(t, 10, 3, 100), {"t": ("site string, pos int, ms long", [("s", 1, 0), ("s", 2, 1), ("s", 3, 50), ("s", 4, 51), ("s", 5, 500)])}, ("site string, pos int, start_ms long", [("s", 1, 0), ("s", 2, 10), ("s", 3, 50), ("s", 4, 160), ("s", 5, 500)])),
    mapped("failure_kinds", crawl.exception_kind, ["java.net.UnknownHostException: x", "Connection refused", "Read timed out", "SSLHandshakeException", "?"], ["gone", "refused", "timeout", "tls", "other"]),
    mapped("budgets", crawl.failure_budget, [100, 3000, 90000], [20, 30, 50], "long", "long"),
    mapped("style_references", lambda c: F.array_join(styles.columns.references(c), " "), ["@import \"a.css\"; /* url(x) */ b{background:url( '//h.org/p.png' )} c{d:url(data:xx)}", "p{}"], ["a.css https://h.org/p.png", ""]),
    mapped("style_depths", lambda c: styles.columns.shifted(c, F.lit(1)), ["a{b:url(x/y.png)} @import '/z.css'; c{d:url(http://q/r)}"], ["a{b:url(../x/y.png)} @import '/z.css'; c{d:url(http://q/r)}"]),
    mapped("plain_styles", styles.plain_style, ["color: red", "background: url(data:x)", "background: url(y.png)"], [True, True, False], "boolean"),
    mapped("style_decisions", lambda u: styles.decision(u, u.contains("bad"), u.contains("old")), [" ", "data:x", "a.png", "//bad.org/x", "http://old.org/x", "http://new.org/x"], ["none", "keep", "keep", "skip", "reuse", "fetch"]),
    Case("style_cycles", lambda t: styles.cycles(t), {"t": ("src string, dst string", [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")])}, ("src string, dst string", [("b", "c"), ("c", "b")])),
    Case("map_files", lambda t: control.triplets(t), _files("http://a\n x \n----\n\n\n\nhttp://b\ny\n ---- \n\n"), ("path string, pos int, key string, value string", [("m.txt", 0, "http://a", "x"), ("m.txt", 2, "http://b", "y")])),
    Case("page_maps", lambda t: control.page_map(t), _files("http://a\nx.html\nhtml\n----\nhttp://a\nx.html\nhtml\n----\nhttp://b\nindex.html\nhtml\n----\nhttp://b\nd/index.html\nhtml\n----\n"), ("url string, file string, kind string", [("http://a", "x.html", "html"), ("http://b", "d/index.html", "html")])),
    Case("line_lists", lambda t: control.line_list(t), _files("# c\n a \n\nb #x\n"), ("pos int, line string", [(1, "a"), (3, "b #x")])),
    Case("property_files", lambda t: control.properties(t), _files("a = 1\n#b=2\nc=x=y\na=3\n"), ("key string, value string", [("a", "3"), ("c", "x=y")])),
    Case("good_styles", lambda t: control.bad_to_good(t), {"t": ("path string, text string", [("d/1.bad", "a \nb\n"), ("d/1.good", "ok"), ("d/2.bad", "c"), ("d/2.good", "fine"), ("d/x.txt", "-")])}, ("name string, bad string, good string", [("1", "a\nb", "ok"), ("2", "c", "fine")])),
    Case("composed_maps", lambda t: control.compose(t), {"t": ("key string, value string", [("b", "2"), ("a", "1")])}, ("text string", [("a\n1\n----\nb\n2\n----\n",)])),
    Case("value_index", lambda t: control.keys_by_value(t).select("value", F.array_join("keys", " ").alias("keys")), {"t": ("key string, value string", [("b", "X"), ("a", "x"), ("c", "y")])}, ("value string, keys string", [("x", "a b"), ("y", "c")])),
    Case("override_chain", lambda a, b: control.first_that_has([a, b], "name"), {"a": ("name string, src string", [("x", "a")]), "b": ("name string, src string", [("x", "b"), ("y", "b")])}, ("name string, src string", [("x", "a"), ("y", "b")])),
    Case("comment_paths", lambda t: files.comment_files(t), {"t": ("relpath string", [("u/2001/02/10_7.html",), ("@all/2001/02/10_7.html",), ("u/2001/02/9_8.html",)])}, ("user string, yyyy int, mm int, rid long, tid long", [("u", 2001, 2, 9, 8), ("u", 2001, 2, 10, 7)])),
    Case("listed_directories", lambda t: files.files_and_directories(t), {"t": ("relpath string", [("a/b/c.html",), ("a/d.html",), ("e",)])}, ("relpath string, is_dir boolean", [("a/b/c.html", False), ("a/d.html", False), ("e", False), ("a", True), ("a/b", True)])),
    Case("numbered_pages", lambda t: files.numeric_order(t), {"t": ("relpath string", [("p/10.html",), ("p/9.html",), ("p/x.html",)])}, ("relpath string, rid long", [("p/9.html", 9), ("p/10.html", 10)])),
    Case("manual_overrides", lambda t: files.manual_pages(t), {"t": ("relpath string", [("m/10.html",), ("m/10-page-2.html",), ("m/x.html",)])}, ("rid long, page int", [(10, 1), (10, 2)])),
    Case("journal_names", lambda t: files.journals(t), {"t": ("relpath string", [("ann/pages/1.html",), ("@old/x",), ("a.b/x",), ("logs/x",), ("bob/y",), ("ann/z",)])}, ("journal string", [("ann",), ("bob",)])),
    Case("empty_directories", lambda d, t: files.empty_directories(d, t), {"d": ("relpath string", [("a",), ("a/b",), ("a/b/c",), ("e",)]), "t": ("relpath string", [("a/x.html",)])}, ("relpath string", [("a/b/c",), ("a/b",), ("e",)])),
    Case("content_policy", lambda t: t.select("id", mime.decision(*[F.col(c) for c in ("name_ext", "header_ext", "content_ext", "mime", "host", "path", "pre")]).alias("accepted")), {"t": ("id int, name_ext string, header_ext string, content_ext string, mime string, host string, path string, pre boolean", [(1, "css", "txt", None, None, "a.org", "/", False), (2, "txt", "html", "eml", "message/rfc822", "a.org", "/", False), (3, "TXT", None, "html", "text/html", "lib.ru", "/x", True), (4, "txt", None, "html", "text/html", "kulichki.com", "/other", True), (5, "jpg", "css", "css", None, "a.org", "/", False)])}, ("id int, accepted string", [(1, "css"), (2, "txt"), (3, "html"), (4, None), (5, None)])),
    Case("response_verdicts", lambda t: t.select("id", mime.verdict(F.col("code"), F.col("name_ext"), F.col("content_ext"), F.lit(None).cast("string")).alias("verdict"), mime.failure(F.col("code"), F.col("mime"), F.col("name_ext"), F.col("size")).alias("failure"), mime.repaired_name(F.lit("a/x.y"), F.col("name_ext"), F.col("content_ext")).alias("name")), {"t": ("id int, code int, name_ext string, content_ext string, mime string, size long", [(1, 200, "jpg", "jpeg", "image/jpeg", 9), (2, 200, "jpg", "html", "text/html; x", 9), (3, 404, "jpg", "html", "text/html", 9), (4, 429, "gif", "gif", "image/gif", 9), (5, 200, "php", "html", "text/html", 9), (6, 200, "gif", "gif", "image/gif", 0)])}, ("id int, verdict string, failure string, name string", [(1, "good", None, "a/x.y"), (2, "mismatch", "error page", "a/x.y.html"), (3, "reject", "status", "a/x.y.html"), (4, "reject", "later", "a/x.y"), (5, "good", None, "a/x.y.html"), (6, "good", "empty", "a/x.y")])),
    Case("primary_blocks", lambda t: html.serialize(pages.primary_only(_parsed(t).where("page_id = 1"))), _STYLED, ("page_id long, html string", [(1, '<html><body><div id="wrap"><div id="primary">main<div>in</div></div></div></body></html>')])),
    Case("anchored_articles", lambda t: html.serialize(pages.around_anchor(_parsed(t).where("page_id = 2"))), _STYLED, ("page_id long, html string", [(2, '<html><body><table><tr><td><img width="1" height="3"><table><tr><td>in</td></tr></table>text</td></tr></table></body></html>')])),
    Case("memorial_notices", lambda t: html.serialize(pages.without_memorial_notice(_parsed(t).where("page_id = 3"))), _STYLED, ("page_id long, html string", [(3, '<body><p class="b-bubble-alert">other</p>x</body>')])),
    Case("album_pagers", lambda t: _parsed(t).where("page = 1").select("album", pages.album_pages(F.col("nodes")).alias("n"), pages.album_next(F.col("nodes")).alias("next")), _ALBUMS, ("album long, n int, next string", [(1, 3, "http://a.org/2"), (2, 1, None)])),
    Case("album_merges", lambda t: pages.album_frames(_parsed(t)), _ALBUMS, ("album long, place int, page int, text string", [(1, 1, 1, "one"), (1, 2, 3, "three"), (1, 3, 2, "two"), (2, 1, 1, "alonebar")])),
    Case("comment_expansions", lambda t, r: comments.expanded(t, r), {"t": (_THREAD, [r for r in _ROWS if r[0] == 1] + list(_WAITING)), "r": _ANSWERS}, ("page_id long, thread string, parent string, level int, loaded boolean, uname string, article string, state string", [
        (1, "10", None, 1, True, "ann", "hello", "complete"), (1, "11", "10", 2, True, "bob", "hi", "complete"), (1, "12", None, 1, True, None, "anon", "complete"), (1, "13", "10", 2, True, "cat", "late", "complete"), (1, "14", "11", 3, False, None, None, "complete"),
        (1, "15", "13", 3, True, "dan", "deep", "complete"), (1, "16", "12", 2, True, "fay", "below", "complete"), (1, "17", "15", 4, True, "eve", "deeper", "complete"), (3, "30", None, 1, True, "ann", "x", "incomplete"), (3, "31", "30", 2, False, None, None, "incomplete"),
    ])),
    Case("profile_page_links", lambda t, p, r: maps.page_links(t, "a_b", "a-b", "site.com", p, r), {"t": ("page string, pos int, href string", [("x", 0, "http://A-B.site.com/12.html"), ("x", 1, "https://users.site.com/a_b/13.html"), ("x", 2, "a_b.site.com/14.html"), ("x", 3, "http://a-b.site.com/12.html?x"), ("x", 4, "http://c.site.com/12.html"), ("x", 5, "http://a-b.site.com/99.html")]), "p": ("relpath string", [("2001/02/12.html",), ("2001/03/14.html",)]), "r": ("relpath string", [("2001/02/12.html",), ("2001/02/13.html",)])}, ("page string, pos int, old string, new string", [("x", 0, "http://A-B.site.com/12.html", "../../pages/2001/02/12.html"), ("x", 1, "https://users.site.com/a_b/13.html", "../../reposts/2001/02/13.html"), ("x", 2, "a_b.site.com/14.html", "../../pages/2001/03/14.html")])),
    Case("told_content_types", lambda d, t: maps.content_types(d, t), {"d": ("relpath string, ext string", [("A/x", "txt"), ("b", "png"), ("c", None), ("d", "gif")]), "t": ("relpath string, mime string", [("a/X", "image/jpeg"), ("b", "no/such"), ("c", "text/html")])}, ("key string, ext string", [("a/x", "jpg"), ("b", "png"), ("c", "html"), ("d", "gif")])),
    Case("kept_map_rows", lambda m, g: maps.without_files(m, g), {"m": _MAP, "g": ("relpath string", [("LINKS/a.org/x.jpg",)])}, ("url string, relpath string", [("https://a.org/y", "links/a.org/Y"), ("http://b.org/z", "links/b.org/z")])),
    Case("deleted_files", lambda g, f: maps.scheduled_deletes(g, f), {"g": ("relpath string", [("links/A.org/x.JPG",), ("links/a.org/x.jpg",)]), "f": _FILES}, ("key string, actual string", [("links/a.org/x.jpg", "links/a.org/x.jpg")])),
    Case("request_rates", lambda e: activity.rates(e, 400_000, 90), {"e": ("ms long, kind string", [(90_000, "web-request"), (100_000, "web-request"), (160_000, "lj-page-request"), *[(220_000, "loaded-page")] * 50, (340_000, "web-request")])}, ("requests double, page_requests double, loaded_pages double, eta_min int", [(0.4, 0.2, 10.0, 9)])),
    Case("rates_at_once", lambda e: activity.rates(e, 5, 90), {"e": ("ms long, kind string", [(5, "web-request"), (5, "lj-page-request")])}, ("requests double, page_requests double, loaded_pages double, eta_min int", [(0.0, 60000.0, 0.0, None)])),
]

QUERIES, SQL = registered(CASES)
