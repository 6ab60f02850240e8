"""Cases of addresses: codes, redirects, resolution, paths, content types, dates, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import dates, filters, mime, text, urls
from palimpsest.functions.codec import columns as codec
from palimpsest.functions.paths import columns as paths
from palimpsest.functions.redirects import columns as redirects
from palimpsest.plans.fixtures import Case, mapped, registered


def _joined(array: Column) -> Column:
    return F.array_join(array, " ", "null")


def _consolidated(t: DataFrame) -> DataFrame:
    from palimpsest.functions import redirects as plain
    from palimpsest.functions.vectors import column_function

    groups = t.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "url"))).alias("u"))
    listed = F.transform("u", lambda x: x["url"])
    exact, any_case = (column_function(lambda u, c=c: plain.consolidate(u, c))(listed) for c in (False, True))
    return groups.select("g", exact.alias("exact"), any_case.alias("any_case"))


_WIKI = "http://ru.wikipedia.org/wiki/"
_MEMORIAL = "%D0%9F%D0%B0%D0%BC%D1%8F%D1%82%D0%BD%D0%B8%D0%BA"

CASES = [
    mapped("host_matrix", urls.host, ["http://Example.org/x", "example.org:8080/y", "//cdn.example.org?q", "https://example.org.#a", "localhost/x", "http://10.0.0.1/x", "user", "HTTPS://A-b.C.example.ORG:443"],
           ["Example.org", "example.org", "cdn.example.org", "example.org", None, "10.0.0.1", None, "A-b.C.example.ORG"]),
    mapped("decoded_urls", codec.decode, [" /a%20b+c ", "/plain+x", "/%D1%D", "%u041F%u0430%u043C", "%u041F x", "/100%"], ["/a b+c", "/plain+x", "/%D1%D", "Пам", "%u041F x", "/100%"]),
    mapped("decoded_forms", codec.decode_form, ["a+b%26c", "%E0%A4%", "x"], ["a b&c", None, "x"]),
    mapped("encoded_segments", codec.encode_segments, ["/a b/c~d/", "é*", "a/b"], ["/a%20b/c%7Ed", "%C3%A9*", "a/b"]),
    mapped("attribute_links", codec.encode_attribute, ["http://h.org/a b/é/?q=x y&z#f g", "no scheme", "https://h.org", "http://h.org/a%20b"], ["http://h.org/a%20b/%C3%A9?q=x%20y&z#f%20g", None, "https://h.org", "http://h.org/a%2520b"]),
    mapped("attribute_links_safe", codec.encode_attribute_safe, ["http://h.org/a%20b é", "https://h.org/x?u=http%3A%2F%2Fa&fl=a,b"], ["http://h.org/a%20b%20%c3%a9", "https://h.org/x?u=http%3A%2F%2Fa&fl=a%2cb"]),
    mapped("minimal_links", codec.encode_minimal, ["http://h/a b|c%20d", "é[1]"], ["http://h/a%20b%7Cc%20d", "%C3%A9%5B1%5D"]),
    mapped("wire_links", codec.wire_form, ["HTTPS://Example.COM:443/a b?q=1,2#x", "http://H.org:8080/"], ["https://example.com/a%20b?q=1%2c2", "http://h.org:8080"]),
    mapped("normal_authorities", codec.normalize_authority, ["HTTPS://Example.COM:443/Путь?q=V#A", "http://H.org:80", "http://H.org:81/X", "ftp://H.org/"], ["https://example.com/Путь?q=V#A", "http://h.org", "http://h.org:81/X", "ftp://H.org/"]),
    mapped("cp1251_links", codec.repair_cp1251, [_WIKI + "%CF%E0%EC%FF%F2%ED%E8%EA", _WIKI + _MEMORIAL, "%2F%7A%E9", "plain"], [_WIKI + _MEMORIAL, _WIKI + _MEMORIAL, "%2F%7A%D0%B9", "plain"]),
    mapped("strict_codes", codec.encode_rfc3986, ["a b/~é", "x_y-z.0"], ["a%20b%2F~%C3%A9", "x_y-z.0"]),
    mapped("mixed_codes", codec.decode_mixed, ["%41%2", "100% of %C3%A9", "%2541"], ["A%2", "100% of é", "%41"]),
    mapped("full_codes", codec.decode_fully, ["%252541", "a%2Fb"], ["A", "a/b"]),
    mapped("file_names", codec.encode_filename, ['a:b|c?"d', "plain.txt", "tab\there"], ["a%3Ab%7Cc%3F%22d", "plain.txt", "tab%09here"]),
    mapped("reserved_names", codec.has_reserved, ["a/b", "../x", "a/b:c", "a?b"], [False, False, True, True], "boolean"),
    mapped("unwrapped_links", redirects.unwrap, [
        "https://www.google.com/url?q=https://pbs.example.com/media/a.jpg&sa=U&usg=x",
        "https://imgprx.livejournal.net/st/a5qxcIzYm6/img1.labirint.ru/books/168777/big.jpg",
        "https://p.dreamwidth.org/85b2c158373e/3144591-399915/l-stat.livejournal.net/img/community.gif?v=556",
        "http://www.facebook.com/l.php?u=http%3A%2F%2Fru.wikipedia.org%2Fwiki%2F%25CF%25E0%25EC%25FF%25F2%25ED%25E8%25EA&h=pAQ",
        "http://infonarod.ru/away.php?url=http%253A%252F%252Fsocialist.memo.ru%252Fbooks%252Fdocuments.htm",
        "https://vk.com/away.php?to=https%3A%2F%2Fwww.livejournal.com%2Faway%3Fto%3Dhttp%3A%2F%2Fa.org%2Fx",
        "https://external-arn2-1.xx.fbcdn.net/safe_image.php?d=aq&w=540&url=https://w.su/og/2.png&cfs=1",
        "https://docs.google.com/viewer?url=http://v.net/a.pdf&docid=0", "https://c.mail.live.com/handlers/imageproxy.mvc?b=&url=http://l.org/5/2", "http://a.org/plain#x", "https://www.google.com/search?q=http://a.org",
    ], [
        "https://pbs.example.com/media/a.jpg", "https://img1.labirint.ru/books/168777/big.jpg", "https://l-stat.livejournal.net/img/community.gif?v=556", _WIKI + _MEMORIAL,
        "http://socialist.memo.ru/books/documents.htm", "http://a.org/x", "https://w.su/og/2.png", "http://v.net/a.pdf", "http://l.org/5/2", "http://a.org/plain#x", "https://www.google.com/search?q=http://a.org",
    ]),
    mapped("unwrap_again", lambda u: redirects.unwrap(redirects.unwrap(u)) == redirects.unwrap(u), ["https://vk.com/away.php?to=https%3A%2F%2Fa.org%2Fx", "http://a.org", "https://vk.com/away.php?to=x"], [True, True, True], "boolean"),
    mapped("unwrap_layers", lambda u: _joined(redirects.layers(u)), ["https://vk.com/away.php?to=https://www.livejournal.com/away?to=http://a.org/x"], ["https://vk.com/away.php?to=https://www.livejournal.com/away?to=http://a.org/x https://www.livejournal.com/away?to=http://a.org/x http://a.org/x"]),
    mapped("unwrap_encoded", redirects.unwrap_encoded, [" https://vk.com/away.php?to=http%3A%2F%2Fa.org%2Fx%20y ", "https://vk.com/away.php?to=%D1%D", "mailto:x"], ["http://a.org/x%20y", "https://vk.com/away.php?to=%D1%D", "mailto:x"]),
    Case("consolidated_urls", _consolidated, {"t": ("g int, k int, url string", [
        (1, 1, "https://www.otzywy.com"), (1, 2, "https://www.otzywy.com/"), (2, 1, "https://expert.ru:443/data/a.jpg"), (2, 2, "http://expert.ru/data/a.jpg"), (3, 1, "http://i.imgur.com/TWq.jpg"), (3, 2, "https://i.imgur.com/TWq.jpg"),
        (4, 1, "http://a.cc/p-Комиксы-польша.jpeg"), (4, 2, "http://a.cc/p-Комиксы-Польша.jpeg"), (5, 1, "http://a.org/x"), (5, 2, "http://a.org/y"), (6, 1, "https://y.ru/s?u=https://l.com/m/?i=6&t=a b"), (6, 2, "https://y.ru/s?u=https%3A%2F%2Fl.com%2Fm%2F%3Fi%3D6&t=a+b"), (7, 1, "http://A.org/One"),
    ])}, ("g int, exact string, any_case string", [
        (1, "https://www.otzywy.com", "https://www.otzywy.com"), (2, "https://expert.ru/data/a.jpg", "https://expert.ru/data/a.jpg"), (3, "https://i.imgur.com/TWq.jpg", "https://i.imgur.com/TWq.jpg"),
        (4, None, "http://a.cc/p-%D0%9A%D0%BE%D0%BC%D0%B8%D0%BA%D1%81%D1%8B-%D0%BF%D0%BE%D0%BB%D1%8C%D1%88%D0%B0.jpeg"), (5, None, None), (6, "https://y.ru/s?u=https://l.com/m/?i=6&t=a%20b", "https://y.ru/s?u=https://l.com/m/?i=6&t=a%20b"), (7, "http://a.org/One", "http://a.org/One"),
    ])),
    mapped("resolved_links", redirects.resolve, [("http://a.org/x/y.html", "../z.html"), ("http://a.org/x/", "b\\c.html#f g"), ("https://a.org/x", "//cdn.org/s.js"), ("http://a.org", "data:x"), ("", "q"), ("https://web.archive.org/web/20010101000000/http://b.org/p/q", "/r"), ("http://a.org/x?y", "?z")],
           ["http://a.org/z.html", "http://a.org/x/b/c.html#f%20g", "https://cdn.org/s.js", "data:x", "q", "https://web.archive.org/web/20010101000000/http://b.org/r", "http://a.org/x?z"]),
    mapped("same_urls", redirects.same_url, [("HTTP://A.org/x", "http://a.org/x"), ("http://a.org/X", "http://a.org/x"), ("http://a.org:80/", "http://a.org/")], [True, False, False], "boolean"),
    mapped("version_parameters", redirects.differ_in_version, [("/a?v=1&b=2", "/a?v=3&b=2"), ("/a?v=1", "/a"), ("/a?b=1", "/a?b=2"), ("/a", "/a")], [True, True, False, False], "boolean"),
    mapped("query_parameters", lambda u: redirects.parameter(u, F.lit("q r")), ["/x?a=1&q%20r=b%26c&q%20r=d", "/x?q+r=1", "/x#?q%20r=2"], ["b&c", None, None]),
    mapped("css_bundles", lambda u: _joined(redirects.css_bundle(u)), ["https://s.net/??a.css,b/c.css?v=17", "x.css?v=1", "a??b??c", "../s/i.css%3Fv=1"], ["https://s.net/a.css?v=17 https://s.net/b/c.css?v=17", "x.css?v=1", None, "../s/i.css%3Fv=1"]),
    mapped("relative_links", redirects.relative_link, [("a/b/c.html", "a/d/e.jpg"), ("x.html", "links/y"), ("a/b.html", "a/b.html")], ["../d/e.jpg", "links/y", "b.html"]),
    mapped("dotted_paths", redirects.resolve_dots, ["a/./b/../c", "../x", "a//b", "a/.."], ["a/c", None, "a/b", ""]),
    mapped("archived_paths", redirects.archived_relative, [("https://web.archive.org/web/20010101000000/http://www.a.org/x", "https://web.archive.org/web/20020101000000im_/http://a.org/x/b.gif"), ("http://a.org", "http://b.org/c")], ["b.gif", None]),
    mapped("garbled_links", redirects.garbled, ["file/http_\\a.org\\b\\c.gif", "cache/http/a.org/b", "http://a.org/x", "plain/x"], ["http://a.org/b/c.gif", "http://a.org/b", "http://a.org/x", "plain/x"]),
    mapped("repository_paths", paths.file_path, ["https://H.org:8080/a%20b/c.JPG?x=1/2#f", "https://s.ru/?key=6", "https://s.ru", "http://a.org/x/", "mailto:x", "http://a.org/a%253Ab"], ["h.org__8080/a b/c.JPG%3Fx=1%2F2.jpg", "s.ru/%3Fkey=6", "s.ru/[unnamed-root]", "a.org/x", None, "a.org/a%3Ab"]),
    mapped("repository_urls", paths.original_url, ["h.org__8080/a b/c.jpg%3Fx=1.jpg", "s.ru/%3Fkey=6", "s.ru/[unnamed-root]", "a.org/@@@/x-01/x-0123456789abcdef0123456789abcdef.jpg"], ["https://h.org:8080/a%20b/c.jpg?x=1", "https://s.ru?key=6", "https://s.ru", None]),
    mapped("sane_components", paths.sane_component, [" a. ", "a%252Fb", "x:y", "ok.html"], ["%20a%2E%20", "a%2Fb", "x%3Ay", "ok.html"]),
    mapped("media_extensions", paths.media_extension, ["a/b.JPEG", "a.b/c", "x.shtml", "x.torrent", "x.", "y.7z"], ["jpeg", None, "shtml", None, None, "7z"]),
    mapped("made_up_names", paths.is_made_up, ["a/@@@/b", "a/x-0123456789abcdef0123456789abcdef.jpg", "a/x-1"], [True, True, False], "boolean"),
    mapped("safe_titles", paths.safe_title, ['What? "Yes": a/b. ', "  x \n y"], ["What Yes a b", "x y"]),
    mapped("edge_dots", paths.without_edge_dots, ["a./b ", "../c", "a/ ./b"], ["a/b", "../c", None]),
    mapped("path_depths", paths.depth, ["C:\\a\\b", "//srv/share/x", "/a/b/c", "a"], [2, 1, 3, 1], "int"),
    mapped("map_values", paths.below, [("C:\\links", "C:\\links\\a\\b.jpg"), ("/x", "/y/z")], ["a/b.jpg", None]),
    mapped("incomplete_urls", paths.complete, ["//a.org/x", "http:/a.org", "www.a.org", "https://b.org", "x/y"], ["https://a.org/x", "http://a.org", "https://www.a.org", "https://b.org", "x/y"]),
    mapped("link_spellings", lambda u: _joined(paths.spellings(u)), ["a%20b/c", "plain"], ["a%20b/c a b/c a%2520b/c", "plain"]),
    mapped("mime_extensions", mime.columns.extension_of, ["image/JPEG; q=1", "jpg", ".pdf", "text/x-new", "application/x-none", "message/news", "image/tiff"], ["jpg", "jpg", "pdf", "txt", None, "txt", "tif"]),
    mapped("mime_charsets", mime.columns.charset_of, ["text/html; charset=win-1251", 'text/html;charset="UTF8"', "text/html", "text/html; charset=klingon"], ["windows-1251", "utf-8", None, None]),
    mapped("mime_types", lambda s: mime.columns.sniff(F.unhex(s), F.lit("txt")), ["FFD8FFE0", "41542654464F524D00", "526172211A0700", "3C21444F43545950452068746D6C3E", "706C61696E", "0001020304", ""], ["image/jpeg", "image/vnd.djvu", "application/vnd.rar", "text/html", "text/plain", "application/octet-stream", "application/octet-stream"]),
    mapped("byte_profiles", lambda s: mime.columns.profile(F.unhex(s)), ["", "000000", "41", "41" * 200], ["empty", "zeros", "small", "data"]),
    mapped("byte_texts", lambda s: mime.columns.text_of(F.unhex(s), F.lit("")), ["EFBBBF41", "CFE0EC", "D09F"], ["A", "Пам", "П"]),
    mapped("equivalent_extensions", mime.equivalent, [("JPG", "jpeg"), ("htm", "shtml"), ("png", "gif"), ("txt", "TXT"), ("tgz", "gz")], [True, True, False, True, True], "boolean"),
    mapped("post_dates", lambda c: dates.post_date(c).cast("string"), ["2012-03-04 05:06:07", "March 4 2012, 05:06", "4 March 2012", "Smarch 1 2012, 00:00"], ["2012-03-04 05:06:07", "2012-03-04 05:06:00", None, None]),
    mapped("wall_dates", lambda c: dates.wall_date(c).cast("string"), ["4 March 2012, 23:59 UTC+3", "31 April 2012, 10:00 UTC", "4 March 2012, 24:00 UTC", "4 March 2012, 10:00"], ["2012-03-04", None, None, None]),
    mapped("dotted_dates", lambda c: dates.dotted_date(c).cast("string"), [" 05.11.2010\xa0г.", "5.11.2010", "31.02.2010", "05.11.2010x"], ["2010-11-05", None, None, None]),
    mapped("stamp_times", lambda c: dates.from_stamp(c).cast("string"), ["20010203040506", "2001", "20011303040506"], ["2001-02-03 04:05:06", None, None]),
    mapped("garbled_texts", text.recover_garbled, ["РџР°РјСЏС‚СЊ", "Память", "plain"], ["Память", "Память", "plain"]),
    mapped("part_labels", text.part_of_name, ["2001-02-3.html", "index.html", "2001-05.html"], [3, 1, 5], "int"),
    mapped("prefix_strips", lambda s: text.strip_prefix(s, ["re:", "fwd: "], True, True), ["Re:RE:fwd: x", "xRe:", "re: y"], ["x", "xRe:", " y"]),
    mapped("journal_paths", lambda u: filters.journal_rest(u, "a_user"), ["https://a-user.livejournal.com/123.html", "http://www.livejournal.com/users/a_user/45.html?x", "http://users.livejournal.com/a_user/", "https://other.livejournal.com/1.html"], ["123.html", "45.html?x", "", None]),
    mapped("video_frames", filters.is_video, ["https://www.youtube.com/embed/x", "https://player.vimeo.com/video/1", "https://archive.org/embed/x", "https://archive.org/details/x", "https://a.org"], [True, True, True, False, False], "boolean"),
    mapped("wiki_files", filters.wiki_file_page, ["https://en.wikipedia.org/wiki/File:FD2.png", "https://en.wikipedia.org/wiki/FD2.png", "https://a.org/wiki/File:x.png"], [True, False, False], "boolean"),
    mapped("sites", filters.site_of, ["https://a.b.example.org/x", "http://example.org"], ["example.org", "example.org"]),
    mapped("wanted_pictures", lambda u: filters.wanted(u, True, True, ["*.bad.org*"], ["slow.org*"]), ["http://a.org/x.jpg", "http://a.org/", "http://x.bad.org/y", "http://slow.org/z", "mailto:x", "https://vk.com/away.php?to=http://slow.org/z"], [True, False, False, False, False, False], "boolean"),
    mapped("wanted_documents", lambda u: filters.wanted(u, False, False, [], ["slow.org*"]), ["http://a.org", "http://slow.org/z", "https://en.wikipedia.org/wiki/File:FD2.png"], [True, True, False], "boolean"),
    mapped("same_archive_roots", lambda a, b: filters.same_root(a, b, True), [("https://web.archive.org/web/20010101000000/http://www.a.org/x", "https://web.archive.org/web/20020202000000/http://A.org/"), ("https://web.archive.org/web/20010101000000/http://a.org/x", "https://web.archive.org/web/20010101000000/http://b.org/")], [True, False], "boolean"),
    mapped("page_states", filters.page_state, ["<b>Loading ...</b>", "<p>Access to this page  has been blocked</p>", "<p>hello</p>"], ["loading", "blocked", None]),
    mapped("gateway_pages", filters.gateway_error, ["<html><title>502 Bad Gateway</title>", "<title>fine</title>"], [True, False], "boolean"),
    mapped("profile_links", lambda u: filters.profile_link(u, ["https://a.livejournal.com", "https://www.livejournal.com/users/a"]), ["https://a.livejournal.com/photo/album/7/", "https://a.livejournal.com/photo/album/7/8", "https://www.livejournal.com/users/a/9.html", "https://b.org/9.html"], ["album", "picture", "post", None]),
]

QUERIES, SQL = registered(CASES)
