"""HTML rendering and WARC derivatives."""
import html as entities
import re

import pytest

from cohortlab.llm import html_text, warc

CASES = {
    "blocks": ("<p>one<p>two <b>bold</b>word<div>three</div>four", "one\n\ntwo boldword\n\nthree\nfour"),
    "blanks": ("  a\n\t b<span> c </span> d&nbsp;e", "a b c d\xa0e"),
    "blank at the end of an element": ("<b>a </b>b<i>c</i>d", "a bcd"),
    "breaks": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "lists": ("<ul><li>a<li>b<ol start=3><li>c<li value=7>d<li>e</ol><li>f</ul>", "- a\n- b\n  3. c\n  7. d\n  8. e\n- f"),
    "list wraps": ("<ul><li>a<br>b<p>c</ul>", "- a\n  b\n\n  c"),
    "table": ("<table><caption>Cap</caption><tr><th>Name<th>N<tr><td>alpha<td>10</table>", "Cap\nName   N\nalpha  10"),
    "spans": ("<table><tr><td rowspan=2>r<td>a<td>b<tr><td colspan=2>wide one<tr><td>x<td>y<td>z</table>", "r  a  b\n   wide one\nx  y  z"),
    "cells": ("<table><tr><td>a<br>b<td>c</table>after", "a  c\nb\n\nafter"),
    "loose": ("<table>stray<td>cell</table>", "stray\n\ncell"),
    "hidden": ("<style>.ad, #x {display:none} p{margin:0}</style>a<i hidden>b</i><i class='y ad'>c</i><i id=x>d</i><i style='visibility: hidden'>e</i><script>f</script><!--g-->h", "ah"),
    "details": ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    "pre": ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"),
    "quote": ("<blockquote>q<p>r</blockquote><dl><dt>t<dd>d</dl>", "  q\n\n  r\n\nt\n  d"),
    "crossed": ("<b>a<p>b</b>c</i></p></div>d", "a\n\nbc\n\nd"),
    "attributes": ("<p title=\"a>b\" class='x>y' data-q=it's>one<br/><a href=x&amp;y>two</a><img alt='three &lt; four'>", "one\ntwothree < four"),
    "markup": ("a<!-->b<!-- <p>c -->d<!doctype html>e<?pi?>f<![CDATA[g]]>h < i <3 j", "abdefh < i <3 j"),
    "raw": ("<script>if (a</b) '</p>'</script>x<textarea><b>y &amp; z</textarea><xmp><i>w</i></xmp>", "x<b>y & z<i>w</i>"),
    "cut off": ("a<b", "a"),
    "empty": ("", ""),
}

VISIBILITY = {
    "other properties": ("<style>body{-webkit-backface-visibility:hidden} .a{backface-visibility: hidden}</style>a<b class=a>b</b><i style='-webkit-backface-visibility:hidden'>c</i>", "abc"),
    "print": ("<style>@media print { .nav{display:none} }</style><style media=print>.x{display:none}</style><b class=nav>a</b><b class=x>b</b>", "ab"),
    "small screen": ("<style>@media screen and (max-width: 600px){.x{display:none}} .y{color:red}</style><b class=x>a</b>", "a"),
    "wide screen": ("<style>.x{display:none}@media only screen and (min-width:40em){.x{display:block}}</style><b class=x>a</b>", "a"),
    "on screen": ("<style>@media screen, print{.x{display:none}} .y{display:none}</style>a<b class=x>b</b><b class=y>c</b>", "a"),
    "at-rules": ("<style>@import 'q;}'; .x{display:none} @supports (display:grid){.y{display:none}} @font-face{src:url(a;b)} .z{content:'}';display:none}</style><b class=x>a</b><b class=y>b</b><b class=z>c</b>", "b"),
    "later wins": ("<style>.x{display:none}</style><style>.x{display:block}.y{display:block}.y{display:none}</style><b class=x>a</b><b class=y>b</b>", "a"),
    "ranks": ("<style>#i{display:inline} .x{display:none} b{display:inline} .y{display:none!important}</style><b class=x id=i>a</b><b class=x>b</b><b class=y style='display:block'>c</b><b class=x style='display:block'>d</b>", "ad"),
    "invalid": ("<style>.x{display:none;display:-ms-bogus}</style><b class=x>a</b>b", "b"),
    "hidden shown": ("<style>.x{display:inline}</style><b hidden class=x>a</b><b hidden>b</b>", "a"),
    "noscript sheet": ("<noscript><style>.x{display:none}</style></noscript><b class=x>a</b>", "a"),
    "math": ("a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>tex</annotation></semantics></math> b", "a x=2 b"),
    "svg": ("a<svg><title>t</title><defs/><path d=x/></path><text>one <tspan>two</tspan></text><g style='display:none'><text>no</text></g><text>three</text>loose</svg>b", "a one two three b"),
    "foreign": ("<svg><foreignObject><p>in<br/>side</foreignObject></svg>after<svg><path><p>out", "in\nside\n\nafter\n\nout"),
}
TABLES = {
    "form in a row": ("<table><tr><form action=x><td>a</td><td>b</td></form></tr><tr><td>c<td>d</table>e", "a  b\nc  d\n\ne"),
    "form in a table": ("<table><form><td>a<td>b<tr><td>c</form><td>d</table>", "a  b\nc  d"),
    "form in a body": ("<table><tbody><form><tr><td>a</td></tr></form></tbody></table><form>b</form>", "a\n\nb"),
    "wrapped cells": ("<table><tr><div>x<td>a<td>b<tr><td>c</div><td>d</table>", "x\n\na  b\nc  d"),
    "column group": ("<table><colgroup>x<col><tr><td>a</table>", "x\n\na"),
    "table in a row": ("<table><tr><td>a<tr><table><tr><td>b</table>c", "a\n\nb\n\nc"),
}
CASES |= VISIBILITY | TABLES


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    source, want = CASES[name]
    assert html_text.render(source)[1] == want


def test_cells_and_text_below_wrappers():
    table, row, wrapper = (html_text.Node(tag, {}) for tag in ("table", "tr", "form"))
    for tag in "th", "td":
        wrapper.kids.append(html_text.Node(tag, {}))
        wrapper.kids[-1].kids.append(tag)
    row.kids += ["loose", wrapper]
    table.kids.append(row)
    assert html_text.table_lines(table, {}, 1) == ["loose", "th  td"]


def test_deep_nesting_and_title():
    assert html_text.render("<div>" * 20000 + "x" + "</div>" * 10000)[1] == "x"
    assert html_text.render("<table><tr><td>" * 60 + "x")[1] == "x"
    assert html_text.render("<title> A &amp; B\n</title>t") == ("A & B", "t")


def test_all_visible_words_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        plain = re.sub(r"<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", "", source[r["page_id"]], flags=re.S)
        plain = re.sub(r"</?(?:p|div|li|ul|h1|br|article|nav|footer|body|html)\b[^>]*>", " ", plain)
        want = entities.unescape(re.sub(r"<[^>]+>", "", plain)).split()
        assert [w for w in r["text"].split() if w != "-"] == [w for w in want if w != "-"]


ODD = [(1, None, None, "x"), (2, "http://a/b", "", "x"), (3, "http://a/b\r\nX: y", "<p>é\r\n\r\nz<a href='/c'>", "x"), (3, "http://a/b\r\nX: y", "<p>é\r\n\r\nz<a href='/c'>", "x")]


def odd_pages(spark):
    return spark.createDataFrame(ODD, "page_id long, url string, html string, record string")


def test_extract_odd_rows(spark):
    assert sorted(map(tuple, html_text.extract(odd_pages(spark)).collect())) == [(1, "", ""), (2, "", ""), (3, "", "é z"), (3, "", "é z")]
    assert html_text.extract(odd_pages(spark).limit(0)).count() == 0


def test_derivatives_link_and_digest(spark, sf):
    for pages in (spark.read.parquet(f"{sf}/pages.parquet"), odd_pages(spark)):
        source = {warc.field(warc.split_head(bytes(r["record"]))[1], "WARC-Record-ID"): bytes(r["record"]) for r in warc.responses(pages).collect()}
        rows = warc.derive(warc.responses(pages), "page_id").collect()
        assert len(rows) == 2 * pages.count()
        assert sorted(map(tuple, warc.derive_pages(pages).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
        for r in rows:
            _, headers, _ = warc.split_head((r["header"] + "\r\n").encode())
            _, own, block = warc.split_head(source[r["refers_to"]])
            assert warc.field(headers, "WARC-Refers-To") == r["refers_to"] and warc.field(headers, "WARC-Record-ID") == r["record_id"]
            assert warc.field(headers, "WARC-Block-Digest") == warc.digest(r["block"].encode()) and int(warc.field(headers, "Content-Length")) == len(r["block"].encode())
            assert r["payload_digest"] == warc.field(own, "WARC-Payload-Digest") == warc.digest(warc.split_head(block)[2])
            if r["type"] == "metadata":
                assert all(f"source-header: {k}: {v}\r\n" in r["block"] for k, v in own)
            else:
                assert r["block"] == html_text.render(warc.split_head(block)[2].decode())[1]


@pytest.mark.parametrize("packing", ["none", "gzip"])
def test_files_round_trip(spark, tmp_path, packing):
    pages = odd_pages(spark)
    derived = warc.derive(warc.responses(pages), "page_id")
    warc.write_records(derived, str(tmp_path / "w"), compression=packing)
    back = [bytes(r["record"]) for r in warc.read_records(spark, str(tmp_path / "w")).collect()]
    assert sorted(back) == sorted((r["header"] + "\r\n" + r["block"]).encode() for r in derived.collect())
    responses = [bytes(r["record"]) for r in warc.responses(pages).collect()]
    assert warc.split_records(b"".join(r + b"\r\n\r\n" for r in responses)) == responses


def test_encoded_and_foreign_responses():
    import gzip

    def record(http, kind="response"):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http

    packed = gzip.compress("<p>zipped é".encode("latin-1"))
    body = b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"
    both = warc.derivatives(record(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + body))
    assert [d["type"] for d in both] == ["metadata", "conversion"] and both[1]["block"] == "zipped é"
    assert [d["type"] for d in warc.derivatives(record(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"))] == ["metadata"]
    assert warc.derivatives(record(b"x", "request")) == []
    assert warc.derivatives(record(b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nplain"))[1]["block"] == "plain"


def test_outlinks_are_absolute():
    from urllib.parse import urljoin

    targets = ["/a", "/a/../b", "//other/x", "c?d", "#e", "http://f/g", "mailto:h", "/", "."]
    for uri in ("http://host:80/p/q?r", "https://host", ""):
        page = html_text.parsed("".join(f"<a href='{t}'>x</a>" for t in targets))
        assert [x for x, _ in warc._outlinks(page.root, uri)] == [urljoin(uri, t) for t in targets]
    assert warc._outlinks(html_text.parsed("<base href='http://b/c/'><img src=d><a href='/e'>").root, "http://x/y") == [("http://b/c/d", "img/@src"), ("http://b/e", "a/@href")]
