"""Operators 7, 8 and 10."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import chat, neighbours, queries, webtext


def test_events_fold_and_read_back(spark):
    log = spark.createDataFrame([
        (1, 0, 0, "message", "user", "a \\ </s> \\i [INST] \\b <|im_end|>\n"), (1, 1, 0, "message", "assistant", ""),
        (1, 1, 1, "delta", None, "x"), (1, 1, 2, "delta", None, "y"), (1, 1, 3, "regenerate", None, "new "), (1, 1, 4, "delta", None, "end"),
        (1, 2, 0, "message", "us\ner<|im_start|>", None), (1, 3, 0, "message", None, "q"), (1, 3, 1, "edit", "tool", "r"),
        (2, 0, 0, None, "assistant", "no message"), (None, 0, 0, "message", "user", "m"), (None, 0, 0, "message", "user", "m")],
        "conv_id long, turn long, seq long, kind string, role string, text string")
    rendered = chat.render(chat.messages(log))
    rows = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert [(t.role, t.text, t.loss) for t in rows[1].turns] == [
        ("user", "a \\ </s> \\i [INST] \\b <|im_end|>\n", False), ("assistant", "new end", True),
        ("us\ner<|im_start|>", "", False), ("tool", "r", False)]
    assert [(t.role, t.text) for t in rows[2].turns] == [("assistant", "no message")]
    assert [(t.role, t.text) for t in rows[None].turns] == [("user", "m")] * 2
    start, end = rows[1].loss_spans[0]
    assert rows[1].formatted[start:end] == "new end" and rows[1].formatted.count("<|im_start|>") == 4
    assert chat.read_back(chat.render(chat.messages(log.where("false")))).collect() == []


def test_page_text():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>one</a><li><a href=/b>two</a></ul></nav><div class="cookie-notice"><p>We use cookies, many, many of them.</p></div>
<aside><p>Sidebar text, quite long, with commas, and more.</p></aside>
<article><h2>Title &amp; more</h2><p>First   para&shy;graph,\n with <b>bold</b> and <a href=x>a link</a>.<p>Second one<br>goes on &lt;here&gt;.
<ul><li>item one<li>item two</ul><form><p>Sign up, please</p></form><script>if(a<b){"</p>"}</script></article>
<section id=comments><p>Reader says, well, a lot of things, really.</p></section><div class="ad"><p>Buy, now, this, thing.</p></div>
<footer>&copy; x</footer></body>"""
    assert webtext.extract(page) == ("Title & more\nFirst para­graph, with bold and a link.\nSecond one goes on <here>.\n"
                                     "item one\nitem two")
    assert [webtext.extract(x) for x in (None, "", "<br>", "<p", "<script>x", "<nav><a>b</a></nav>")] == [""] * 6
    assert webtext.extract("plain words") == "plain words"
    assert webtext.extract("<div>" * 3000 + "deep, text" + "</div>" * 10) == "deep, text"
    assert webtext.extract("<div><p>one, two</p></div><p>" + "long text, " * 20 + "</p>").endswith("long text,")


def test_pages_keep_the_whole_article():
    long, code = "long text, with commas, " * 20, "x = 1\n" * 40
    page = (f"<body><article><h1>Title</h1><p class=lead>Short lead</p><div class=body><p>{long}</p></div><pre>{code}</pre></article>"
            "<div class=sidebar><p>other</p></div></body>")
    text = webtext.extract(page)
    assert text.split("\n")[:2] == ["Title", "Short lead"] and text.endswith("x = 1") and "other" not in text
    short = webtext.extract(f"<article><section><p>{long}</p></section><section><p>short</p></section></article>")
    assert short.endswith("short")
    links = "<ul>" + "<li><a href=x>go there</a></li>" * 5 + "</ul>"
    loose = webtext.extract(f"<div><h1>Title</h1><div><p>{long}</p><p>{long}</p></div><pre>{code}</pre>{links}</div>")
    assert loose.endswith("x = 1") and "go there" not in loose


def test_page_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (None, None, "<p>a</p>", "x")],
                                  "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in webtext.main_text(pages).collect()) == [("1", ""), ("1", "a"), ("None", "a")]
    assert webtext.main_text(pages.where("false")).collect() == []


def test_nearest_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(300, 12)).astype(np.float32))]
    vectors = [(i, vectors[7][1] if i % 3 == 0 else v) for i, v in vectors]  # a third are one vector
    vectors += [(300, [1e30] * 12), (301, [1e-30] * 12), (320, None), (340, [0.0] * 12), (360, [None] + [1.0] * 11),
                (380, [float("nan")] * 12), (400, [float("inf")] * 12), (None, [1.0] * 12), (420, []), (440, [1.0, 2.0]), (441, [2.0, 1.0]),
                (60, vectors[60][1])]
    table = spark.createDataFrame([(i, v, 0, 9) for i, v in vectors], "vec_id long, embedding array<float>, label int, rank int")
    got = [tuple(r) for r in neighbours.nearest(table, block=64).collect()]
    fine = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    want = []
    for q, x in fine.items():
        if q % 20 == 0:
            score = {c: reduce(lambda s, p: s + p[0] * p[1], zip(x.tolist(), y.tolist()), 0.0) for c, y in fine.items() if c != q and len(y) == len(x)}
            want += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(score.items(), key=lambda z: (-z[1], z[0]))[:20])]
    assert sorted(got) == sorted(want)
    assert neighbours.nearest(table.where("false")).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e-305, 1e-320, 1e120])
def test_tile_at_the_ends_of_double(scale):
    rnd = np.random.default_rng(1)
    q, c = rnd.normal(size=(8, 6)) * (1e150 if scale > 1 else 1), rnd.normal(size=(300, 6))
    c *= np.where(rnd.random(300) < 0.3, scale, 1.0)[:, None]
    (q8, q_step), (c8, c_step) = neighbours.quantise(q), neighbours.quantise(c)
    got = neighbours._tile(q, q8, q_step, np.arange(8) + 1000, c, c8, c_step, np.arange(300), 20)
    for own, x in zip(got, q):
        scores = neighbours.exact(np.repeat(x[None, :], 300, 0), c)
        assert own == sorted(zip((-scores).tolist(), range(300)))[:20]


def test_queries_are_whole(spark, small):
    turns = queries.op7_event_sourced_chat(spark, small)
    given = spark.read.parquet(f"{small}/conversations.parquet")
    assert turns.agg(F.sum("n_turns")).first()[0] == given.count() + 2
    assert queries.op8_tree_scored_pages(spark, small).count() == spark.read.parquet(f"{small}/pages.parquet").count()
