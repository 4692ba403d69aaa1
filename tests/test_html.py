import time

import pytest

from inkveil.sources.extract import html_to_markdown
from inkveil.sources.html import page_markdown

CASES = [
    ('<p title="a>b@c.com">hi</p>', "hi"),
    ("<p title='a>b' data-x = \"<i>\">hi <b>you</b></p>", "hi you"),
    ('<a title="never closed>text</a> more', "text more"),
    ("1 < 2 and a<b", "1 < 2 and a<b"),
    ("x <!-- a > b --> y <!-- open <p>z", "x y"),
    ("<script>if (a < b) '</p>'</script>ok<style>p{}</STYLE >!", "ok!"),
    ("<script>never closed <p>x</p>", ""),
    ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
    ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
    ('<ol start="7"><li>a<ul><li>in<ol><li>deep</ol></ul><li>b</ol><p>c', "7. a\n  - in\n    1. deep\n8. b\n\nc"),
    ("<ul><li>a</li><li>b</li></ul><li>stray", "- a\n- b\n\n- stray"),
    ("a<pre>\n x  y\n\n\n  z<br>w</pre>b", "a\n\n x  y\n\n\n  z\nw\n\nb"),
    ("<table><tr><th>n<th>m</tr><tr><td>1</td><td>a<p>b<br>c</td></tr></table>t", "| n | m |\n| --- | --- |\n| 1 | a b c |\n\nt"),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table></td><td>y</table>", "| x in ner | y |\n| --- | --- |"),
    ("<head><title>T</title><meta content='>'></head><body>b", "b"),
    ("<head><title>T</title><body>b", "b"),
    ("<h2>T</h2>t<br><br><br>u &lt;x&gt; &#64;", "## T\n\nt\n\nu <x> @"),
    ("<?php a > b ?>c</ d>e<!DOCTYPE html>f", "b ?>cef"),
    ("<td>a</td><td>b</td><tr>c", "a b\nc"),
    ("", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_pages(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(html_to_markdown("h").alias("t")).first().t.strip(" ") == want


def test_null_stays(spark):
    assert spark.createDataFrame([(None,)], "h string").select(html_to_markdown("h").alias("t")).first().t is None


@pytest.mark.parametrize(
    "piece", ["<a ", "<a =", '<a b="', "<a b='x", "<!-- ", "<script>", "<", "</", "<!", "<table><tr><td>", "<ol><li>", "<pre>", 'x="<">', "&#", "<a b=' >"]
)
def test_a_megabyte_of_malformed_input(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    page_markdown(page)
    assert time.process_time() - start < 2
