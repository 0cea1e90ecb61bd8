"""Operators 11 to 13."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import alignment, fim, mtree, queries

FILES = (f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model")


def _best(vectors, k, every):
    """Brute force over whole numbers; of rows with one id the least vector counts."""
    fine = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = min(fine.get(i, v), v)
    whole = {i: [math.floor(1024 * float(x)) for x in v] for i, v in fine.items()}
    rows = []
    for q, x in whole.items():
        if q % every == 0:
            score = {c: max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(x, y))))
                     for c, y in whole.items() if c != q and len(y) == len(x)}
            rows += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(score.items(), key=lambda z: (-z[1], z[0]))[:k])]
    return sorted(rows)


@pytest.mark.parametrize("region", [4096, 40])
def test_tree_search_equals_brute_force(spark, region):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(6, 8))
    vectors = [(i, (centers[i % 6] * (i % 3) + rnd.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    vectors = [(i, vectors[7][1] if i % 3 == 0 else v) for i, v in vectors]  # a third are one vector
    vectors += [(400, [3e38] * 8), (401, [3e38] * 8), (402, [-3e38] * 8), (410, [1e-3] * 8), (420, [0.0] * 8), (430, None),
                (440, [None] + [1.0] * 7), (450, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [1.0] * 8), (470, []), (471, []),
                (480, [1.0, 2.0]), (481, [2.0, -1.0]), (20, vectors[20][1]), (30, [9.0] * 8)]
    table = spark.createDataFrame([(i, v, 0, 9, "n") for i, v in vectors], "vec_id long, embedding array<float>, label int, rank int, node string")
    got = sorted(tuple(r) for r in mtree.nearest(table, k=5, every=10, region=region, page=8, fanout=4).collect())
    as_float = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert got == _best(as_float, 5, 10)
    assert mtree.nearest(table.where("false"), region=region).collect() == []


def test_pages_cover_their_vectors_and_products_are_passed_over():
    rnd = np.random.default_rng(5)
    x = np.floor(1024 * (rnd.normal(size=(20, 6))[rnd.integers(0, 20, 2000)] + 0.05 * rnd.normal(size=(2000, 6))))
    x = np.unique(x, axis=0)
    pages = mtree.grow(x, page=16, fanout=8)
    below = defaultdict(list)
    for i, p in enumerate(pages):
        below[p["parent"]].append(i)

    def rows(i):
        return pages[i]["rows"].tolist() if pages[i]["rows"] is not None else [r for j in below[i] for r in rows(j)]

    assert sorted(rows(0)) == list(range(len(x)))
    for i, p in enumerate(pages):
        own = x[rows(i)]
        assert np.linalg.norm(own - p["center"], axis=1).max() <= p["radius"] * (1 + 1e-12)
        if i:
            assert p["away"] == pytest.approx(np.linalg.norm(p["center"] - pages[p["parent"]]["center"]))
        assert p["rows"] is None or len(p["rows"]) <= 16
    # Bounds hold for every vector of a page and pass over most vectors of clustered data.
    query, exact = mtree.Query(x[0]), x @ x[0]
    bar, met = np.sort(exact)[-10], 0
    for i, p in enumerate(pages):
        size = float(np.linalg.norm(p["center"]))
        product, away = query.to(p["center"][None, :], np.array([size]))
        bound = query.bound(product, away, p["radius"], p["norm"], size)[0]
        assert bound >= exact[rows(i)].max()
        met += len(p["rows"]) if p["rows"] is not None and bound >= bar else 0
    assert met < len(x) / 4


def test_leaves_are_read_together(monkeypatch):
    """Vectors without clusters: nearly all leaves are read, in few steps, and the best are exact."""
    import pyarrow as pa

    rnd = np.random.default_rng(7)
    x = np.floor(1024 * rnd.normal(size=(600, 24)))
    x[5] = 2.0 ** 60
    rows = pa.table({"node": ["r"] * 600, "item": range(600), "size": [24] * 600, "v": list(x), "ids": [[i, 1000 + i] for i in range(600)]})
    region, steps, inner = mtree.Region(mtree._plant(8, 4)(rows)), [], mtree.products
    monkeypatch.setattr(mtree, "products", lambda q, v: steps.append(len(v)) or inner(q, v))
    for q in (x[3], -x[3], x[5], np.zeros(24)):
        steps.clear()
        best = mtree.Best(6, float("-inf"))
        region.search(mtree.Query(q), best)
        exact = [max(-2 ** 63, min(2 ** 63 - 1, sum(int(a) * int(b) for a, b in zip(q, v)))) for v in x]
        want = sorted(((-s, i) for n, s in enumerate(exact) for i in (n, 1000 + n)))[:6]
        assert sorted((-s, -i) for s, i in best.heap) == want
        assert len(steps) <= 9 < int(region.leaf.sum()) / 5


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("sentence", r"[^\n.!?…。！？]*[\n.!?…。！？]|[^\n.!?…。！？]+"),
                                           ("word", r"^\s*\S+\s*|\S+\s*")])
def test_cuts_equal_brute_force(unit, pattern):
    rnd = np.random.default_rng(1)
    texts = ["", "a", "\n", "a\n", "\n\n", "a\nb", "x. y\nz! w", "word " * 30000, "\n" * 3000, "no end " + "é" * 70000]
    texts += ["".join(rnd.choice(list("ab \n.é𝄞"), rnd.integers(0, 200))) for _ in range(200)]
    draws = rnd.integers(0, 1 << 32, (len(texts), 2))
    for text, draw, n, first, second in zip(texts, draws, *fim.cut(texts, draws, unit)):
        units = re.findall(pattern, text)
        assert n == len(units)
        if units:
            low, high = sorted(draw % (n + 1))
            assert "".join(units[:low]) == text[:first] and "".join(units[:high]) == text[:second]


def test_rank_and_select():
    rnd = np.random.default_rng(2)
    codes = rnd.integers(0, 8, 1000).astype(np.uint8)
    matrix, at = fim.WaveletMatrix(codes), np.arange(1001)
    for code in range(8):
        assert matrix.rank(code, at).tolist() == [0, *np.cumsum(codes == code)]
        where = np.flatnonzero(codes == code)
        nth = np.arange(1, len(where) + 1)
        assert matrix.select((code,), nth, np.zeros_like(nth), np.full_like(nth, 1000)).tolist() == (where + 1).tolist()


def test_fim_table(spark):
    rows = [(1, "one\ntwo\nthree\n"), (1, "one\ntwo\nthree\n"), (2, None), (3, ""), (4, "has <P> in it"), (5, "a<\nS>b\n<S\n>"), (None, "x\ny"),
            (6, "line\n" * 50000), *((i, f"l{i}\n" * i + "end") for i in range(10, 60))]
    docs = spark.createDataFrame([(d, t, "own", 1, "own") for d, t in rows], "doc_id long, text string, fim string, n int, output string")
    got = fim.transform(docs).collect()
    assert len(got) == len(rows) and {(r.n, r.output) for r in got} == {(1, "own")} and "doc_id text n output fim" == " ".join(got[0].__fields__)
    forms = Counter()
    for r in got:
        text, f = r.text or "", r.fim
        assert f.restored == text == fim.restore(f.output, f.form)
        forms[f.form] += 1
        if f.form == "plain":
            assert f.output == text and f.prefix_chars is None and f.middle_chars is None and (not text or "<P>" in text)
            continue
        digest = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        assert (f.n, f.prefix_chars, f.middle_chars) == (len(units), len(prefix), len(middle))
        assert f.form == ("spm" if h[3] % 100 < 50 else "psm")
        assert f.output == (f"<S>{suffix}<P>{prefix}<M>{middle}" if f.form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}")
    assert forms["plain"] == 3 and forms["psm"] > 9 and forms["spm"] > 9
    assert fim.transform(docs.where("false")).collect() == []
    assert {r.fim.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}


def test_fast_and_plain_byte_bpe_agree():
    bpe = alignment.ByteBpe(alignment._read(FILES[0]))
    assert bpe.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b  {chr(c)} 1{chr(c)}2 .{chr(c)}." for c in points[i:i + 500]) for i in range(0, len(points), 500)]
    texts += [" " * 6000 + "x" + " " * 6000, "it's <|endoftext|> they'LL 've\r\n \t x", "ab" * 20000]
    plain = bpe.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(bpe.encode(texts), plain))


def _groups(aligner, text):
    """Groups between the places where both tokenizers end a token."""
    a, b = (x.tolist() for x in aligner.tokens([text])[0])
    ends = [np.cumsum([len(x.bytes[i]) for i in ids]).astype(int).tolist() for x, ids in ((aligner.a, a), (aligner.b, b))]
    out, i, j = [], 0, 0
    for place in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(place) + 1, ends[1].index(place) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, out


def test_alignment_equals_brute_force(spark, monkeypatch):
    texts = [(1, "Plain words, and some more."), (1, "Plain words, and some more."), (2, None), (3, ""), (4, "hello <|endoftext|> <s> wörld"),
             (5, "▁not the same bytes"), (6, "日本語 text\n\n  x\t"), (7, "a" * 3000), (8, "\x00\x01 <0x41>"), (None, "words and words"),
             (9, "xq" * 2000 + " words " * 500), (10, "the end of the words")]
    docs = spark.createDataFrame([(d, t, "own", 5) for d, t in texts], "doc_id long, text string, aligned string, pairs int")
    aligner = alignment.Aligner(*map(alignment._read, FILES))
    whole = [_groups(aligner, t or "") for _, t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, _, g in whole]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for (doc, _), (a, b, g), own in zip(texts, whole, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        want.append((str(doc), len(a), len(b), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]),
                     sum(n * count[p] for p, n in own.items()), hashlib.sha256(shown.encode()).hexdigest() if g else "", shown))
    for heavy in (alignment.HEAVY, 20):
        monkeypatch.setattr(alignment, "HEAVY", heavy)
        got = alignment.align(docs, *FILES, printed=True)
        assert got.columns == ["doc_id", "text", "pairs", "aligned"]
        assert sorted((str(r.doc_id), *r.aligned) for r in got.collect()) == sorted(want)
    assert [w[1] for w in want if w[0] in "235"] == [0, 0, 0] and min(w[1] for w in want if w[0] in "4678") > 0
    assert alignment.align(docs.where("false"), *FILES).collect() == []


def test_pairs_are_expanded_in_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    ids_a, ids_b = rnd.integers(0, 40, 600), rnd.integers(0, 30, 500)
    group_a, group_b = np.sort(rnd.integers(0, 7, 600)), np.sort(rnd.integers(0, 7, 500))
    group_doc = np.array([0, 0, 1, 1, 1, 2, 2])
    want = Counter()
    for a, g in zip(ids_a.tolist(), group_a.tolist()):
        want.update((int(group_doc[g]), a << alignment.B_BITS | b) for b in ids_b[group_b == g].tolist())
    in_a, in_b = (np.bincount(g, minlength=7) for g in (group_a, group_b))
    for size, listed in ((alignment.EXPAND, 64), (100, 64), (100, 7000), (alignment.EXPAND, 7000)):
        monkeypatch.setattr(alignment, "EXPAND", size)
        monkeypatch.setattr(alignment, "LISTED", listed)
        doc, pair, n = alignment.linked_pairs(ids_a, in_a, ids_b, in_b, group_doc)
        assert dict(zip(zip(doc.tolist(), pair.tolist()), n.tolist())) == dict(want)
        assert sorted(doc.tolist()) == doc.tolist()


def test_new_queries_are_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert queries.op12_wavelet_fim(spark, small).count() == docs.count()
    aligned = queries.op13_interval_alignment(spark, small)
    assert aligned.count() == docs.count() and aligned.where("n_a > 0 and n_links < n_groups").count() == 0
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = vectors.where("vec_id % 100 = 0").count()
    assert queries.op11_mtree_search(spark, small).count() == asked * min(10, vectors.count() - 1)
    assert aligned.agg(F.max("count_sum")).first()[0] > 0
