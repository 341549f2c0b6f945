"""Classifiers by held-out accuracy and exact parts; extraction by fixtures; queries and pipeline end to end."""

from __future__ import annotations

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from panelwright.llm import lang_id, quality_rules, toxicity
from panelwright.llm.html_extract import extract, main_text
from panelwright.llm.queries import QUERIES
from panelwright.llm.words import WORD

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths, moves = np.array([3, 1, 5]), rng.normal(size=(3, 3))
    e, at = rng.normal(size=(9, 3)), 0
    got = lang_id.marginals(e, lengths, moves)
    for n in lengths:
        w = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(e[at + i, path[i]] for i in range(n)) + sum(moves[path[i], path[i + 1]] for i in range(n - 1)))
            for i in range(n):
                w[i, path[i]] += p
        assert np.allclose(w / w.sum(1, keepdims=True), got[at : at + n])
        at += n


@needs_tables
def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "the of and", None), (-1, None, "en"), (-2, "12 34 ½", "en"), (-3, "", None)], "doc_id long, text string, lang string")
    got = lang_id.languages(docs.select("doc_id", "text", "lang").union(extra)).toPandas()
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got.held_out & (got.doc_id >= 0)]
    assert (held.lang_pred.to_numpy() == truth.loc[held.doc_id].to_numpy()).mean() > 0.97
    assert set(got[got.doc_id < 0].lang_pred) == {"und"} and got.score.between(0, 1).all() and len(got) == docs.count() + 4
    empty = docs.limit(0)
    assert not lang_id.languages(empty).collect() and not lang_id.with_language(empty).collect()


@needs_tables
def test_classifiers(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(None, "idiot moron " * 30), (-1, None), (-2, "")], "doc_id long, text string")
    known = labels.toPandas().set_index("doc_id")
    t = toxicity.toxicity(docs.select("doc_id", "text").union(extra), labels).toPandas()
    assert len(t) == docs.count() + 3 and (t.kept != t.is_toxic).all()
    flagged = t.set_index("doc_id").is_toxic.reindex(known.index)
    assert flagged[known.toxic == 1].mean() > 0.75 and flagged[known.toxic == 0].mean() < 0.02
    q = quality_rules.quality(docs.select("doc_id", "text").union(extra), labels).toPandas().set_index("doc_id")
    kept = q.kept.reindex(known.index)
    passed = ~q.base_failed.reindex(known.index)
    assert kept[(known.quality == 1) & passed].mean() > 0.97 and kept[(known.quality == 0)].mean() < 0.1
    for r in docs.select("doc_id", "text").limit(150).collect():
        w = WORD.findall(r.text)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(covered))
        row = q.loc[r.doc_id]
        assert want == (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
    none = labels.limit(0)
    assert toxicity.toxicity(docs.limit(20), none).where("is_toxic").count() == 0
    assert quality_rules.quality(docs.limit(20), none).where("not base_failed and not kept").count() == 0
    assert not toxicity.toxicity(docs.limit(0), labels).collect() and not quality_rules.quality(docs.limit(0), labels).collect()


PAGES = [
    ("<html><body><div class='menu'><a href=x>Home</a></div><div id='content'><h2>Title here</h2><p>First, para &eacute;\n\n more.</p><p>Short.</p><div class='ad-box'>Buy!</div></div><div class='sidebar'><p>Other stories, many of them.</p></div><div class='cookie-notice'><p>We use cookies, accept.</p></div><div id='comments'><p>Nice post, thanks, really.</p></div></body></html>", "Title here\nFirst, para é more.\nShort."),
    ("<header><h1>Site</h1></header><main><article><header><h1>Real title</h1></header><p>Body text one.</p><p>Body two <a href=q>link</a> more.</p><form>Subscribe <input></form><section class='comments'><p>c1</p></section></article></main><aside>side</aside>", "Real title\nBody text one.\nBody two link more."),
    ('<article><p><b>Bold start<br><p>next <script>var a="</p>";</script>part</p><!-- <p>no</p> --></article><footer>&copy; x', "Bold start\nnext part"),
    ("<p>unfinished <b", "unfinished"), ("", ""), (None, ""), ("plain text only", "plain text only"), ("<nav>menu</nav>", ""),
]


def test_extract(spark):
    df = spark.createDataFrame([(i, None, h, "clash") for i, (h, _) in enumerate(PAGES)] + [(None, "u", "<p>x", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: ("x", 1)}
    assert extract("<div>" * 2000 + "deep text, here.") == "deep text, here."


@needs_tables
def test_pages_are_their_articles(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]
        parts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


@needs_tables
def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == first.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    toxic = set(labels.index[labels.toxic == 1])
    assert len(kept[0] & toxic) < 0.3 * len(toxic)
    sets = {}
    for r in first.where(first.doc_id.isin(sorted(kept[1]))).select("doc_id", "text").collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    dropped = kept[1] - kept[2]
    for i in dropped:  # each has a nearer copy with a smaller chain to one that stays
        assert any(near(i, j) for g in random.Random(i).sample(sorted(sets[i]), min(60, len(sets[i]))) for j in by[g] if j != i)
    for i in sorted(kept[2])[:150]:
        assert not any(near(i, j) for g in list(sets[i])[:60] for j in by[g] if j != i and j in kept[2])


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
