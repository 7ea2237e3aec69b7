"""Deep and long pages, links and fallbacks within articles, and what readers wrote under names that no list has."""

import time

import pytest

from ionflow.llm import html_crf

P = "<p>Some words of a sentence that goes on for a while, as they do.</p>"
TEXT = "Some words of a sentence that goes on for a while, as they do."


@pytest.fixture(scope="module")
def chain():
    return html_crf.default_model()


@pytest.mark.parametrize("piece", ["<div>x ", '<div class="a{k} b{k}">x ', "<b>x ", "<b><p>x", "</i><p>x</p>"])
def test_deep_pages_take_time_in_proportion(chain, piece):
    def took(n):
        page = "<article>" + "".join(piece.replace("{k}", "".join(chr(97 + k // 26**j % 26) for j in range(3))) for k in range(n))
        start = time.process_time()
        found = html_crf.blocks(page)
        chain.label(found)
        assert sum(b[0].count("x") for b in found) == n
        return time.process_time() - start

    took(500)
    assert took(40_000) < 12 * took(8_000) + 0.5  # in proportion: five times; with the square of it: 25 times


def test_a_very_long_page(chain):
    page = f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A title of it</h1>{P * 30_000}</article><footer>&copy; x</footer>"
    assert html_crf.main_text(page, chain) == " ".join(["A title of it", *[TEXT] * 30_000])


def test_names_of_elements_are_each_counted_once(chain):
    page = '<div class="a b"><div class="b c"><p>x</p></div>y</div>'
    (_, inner, _), (_, outer, _) = html_crf.blocks(page)
    assert sorted(inner.names()) == ["@a", "@b", "@c", "div", "p"] and sorted(outer.names()) == ["@a", "@b", "div"]
    assert inner.near == ["@b", "@c"] and outer.near == ["@a", "@b"]
    found = html_crf.blocks(page)
    assert chain.label(found) == chain.viterbi(html_crf.features(found))


def test_links_and_fallbacks_within_articles_stay(chain):
    links = "<ul><li><a href=a>First link</a></li><li><a href=b>Second link</a></li><li><a href=c>Third link</a></li></ul>"
    page = f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav><article><h1>A title of it</h1>{P}{links}{P}<noscript>Kept words</noscript>{P}<svg><text>in svg</text></svg>{P}</article><footer>&copy; x</footer>"
    assert html_crf.main_text(page, chain) == f"A title of it {TEXT} First link Second link Third link {TEXT} Kept words {TEXT} in svg {TEXT}"


@pytest.mark.parametrize("outer,item", [('<ol class="commentlist">', "li"), ('<div class="user-notes">', "div"), ('<div class="reviews">', "div"), ("<ul>", "li")])
@pytest.mark.parametrize("within", [True, False])
def test_what_readers_wrote_goes_whatever_its_name(chain, outer, item, within):
    one = f"<{item}><p><b>Ann</b> 3 May 2021</p><p>I think that this was a nice thing to read, thanks a lot.</p></{item}>"
    thread = f"<h3>3 replies</h3>{outer}{one * 3}</{outer[1:3] if item == 'li' else 'div'}>"
    page = f"<body><article><h1>A title of it</h1>{P * 4}{thread if within else ''}</article>{'' if within else thread}<footer>&copy; x</footer>"
    assert html_crf.main_text(page, chain) == " ".join(["A title of it", *[TEXT] * 4])


def test_an_articles_own_date_stays(chain):
    page = f"<body><article><h1>A title of it</h1><p>By Ann, 3 May 2021</p>{P * 4}</article><footer>&copy; x</footer>"
    assert html_crf.main_text(page, chain) == " ".join(["A title of it", "By Ann, 3 May 2021", *[TEXT] * 4])
