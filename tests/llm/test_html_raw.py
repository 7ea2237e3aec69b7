"""Raw elements and heads of pages as they are found."""

import pytest

from ionflow.llm import html_crf

ARTICLE = "<article><h1>A title here</h1><p>First sentence of the text. And a second one, longer than it.</p></article>"


@pytest.mark.parametrize("page", [
    "<html><head></head><body><script>for(var i=0;i<n;i++){f(i)}</script>" + ARTICLE + "</body></html>",
    "<html><body><script>if(a<b){s='it is'}</SCRIPT >" + ARTICLE + "<script>x</script></body></html>",
    "<html><body><script><!-- x<y </script>" + ARTICLE + "</body></html>",
    "<html><head><title>T</title><meta charset=x><style>p<a{}</style><body>" + ARTICLE + "</body></html>",
    "<html><head><title>T</title><script>var s='<body><p>';</script>" + ARTICLE,
    "<head><title>T</title>" + ARTICLE,
    "<html><body><svg><style>a<b{}</style><title>no</title></svg>" + ARTICLE + "</body></html>",
])
def test_article_is_found(page):
    assert [b[0] for b in html_crf.blocks(page)] == ["A title here", "First sentence of the text. And a second one, longer than it."]


def test_head_and_raw_text_are_no_blocks():
    assert html_crf.blocks("<head><title>T</title>\n<link href=x><template><p>no</p></template></head><script>no") == []


@pytest.mark.parametrize("page, text", [
    ("<p title=don't>one</p><p>it's two</p>", ["one", "it's two"]),
    ("<p title='a > b' class=\"x>y\" id = z>one</p>", ["one"]),
    ("<p>a &<b>lt; b</b> &amp;lt;</p>", ["a &lt; b &lt;"]),
    ("<p>if <math><mi>x</mi></math> and <object>y</object> are</p>", ["if x and y are"]),
    ("<p title=\"never closed>one</p>", ["one"]),
])
def test_tags_and_references(page, text):
    assert [b[0] for b in html_crf.blocks(page)] == text
