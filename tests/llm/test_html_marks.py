"""The article mark weighs by text and is bounded; ratios and the threshold decide in marked and unmarked containers."""

from __future__ import annotations

import time

import duckdb
import pytest

from panelwright.llm.html_extract import extract

LONG = "Some words of the story, told at length. " * 7
BODY = [f"{k}. {LONG}".strip() for k in range(20)]


def page(cards: int, size: int, mark: str = "<article>") -> str:
    end = f"</{mark[1:].split()[0].rstrip('>')}>"
    return "<body><div>" + "".join(f"<p>{p}</p>" for p in BODY) + "</div><div>" + "".join(f"{mark}<p>Card {k}, {'x' * size}.</p>{end}" for k in range(cards)) + "</div></body>"


@pytest.mark.parametrize("mark", ["<article>", "<div class='story'>"])
@pytest.mark.parametrize(("cards", "size"), [(1, 300), (3, 200), (6, 300), (12, 300), (40, 300)])
def test_unmarked_body_beside_marked_cards(cards, size, mark):
    assert set(extract(page(cards, size, mark)).split("\n")) >= set(BODY)


def test_marked_article_beside_short_boxes():
    html = "<body><div><p>Buy now</p></div><article><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in BODY) + "<p>Short.</p></article><div><p>More</p></div></body>"
    assert extract(html) == "\n".join(["Title", *BODY, "Short."])


def test_threshold_decides_in_a_marked_article():
    text = "".join(f"<p>{p}</p>" for p in BODY)
    odd = "<div><div><a href=x>12 links</a></div><div><a href=y>more</a></div><div>7</div><div><a href=z>next</a></div></div>"
    marked, plain = extract(f"<body><article>{text}{odd}</article></body>"), extract(f"<body><div>{text}{odd}</div></body>")
    assert marked == plain == "\n".join(BODY)


def test_linked_items_among_text_stay():
    items = "<li>One plain item, in words.</li><li><a href=x>A linked item</a></li><li>Another plain item, in words.</li>"
    html = f"<body><article>{''.join(f'<p>{p}</p>' for p in BODY)}<ul>{items}</ul></article></body>"
    assert extract(html) == "\n".join([*BODY, "One plain item, in words.", "A linked item", "Another plain item, in words."])


@pytest.mark.parametrize("piece", ["<div>x", "<div class='a b'>x", "<li>x", "<x-y><li>x", "<p><table>x", "</div>x", "<article>x", "<b>x", "<section>x</p>"])
def test_time_is_linear_in_nesting(piece):
    began = time.process_time()
    extract(piece * 100_000 + "<p>deep text, here.")
    assert time.process_time() - began < 12


def test_renamed_articles_give_the_same_text():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (html,) in pages:
        assert extract(html.replace("<article", "<div").replace("</article", "</div")) == extract(html)
