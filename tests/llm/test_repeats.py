"""Operators 3, 4 and 9 against brute force."""

import random
import re
from collections import Counter

import pytest

from flowloom.llm import minhash, substring, suffixes
from tests.llm.conftest import words


def corpus():
    rnd = random.Random(3)
    base = [words(rnd.randint(60, 260), i) for i in range(14)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    shared = words(70, 99)
    rows += [(20 + i, " ".join(base[i][:40] + shared + base[i + 1][:30])) for i in range(4)]
    rows += [(30, rows[2][1]), (31, rows[2][1]), (31, rows[2][1]), (32, None), (33, ""), (34, " \n\t"), (35, "tail"),
             (None, rows[3][1]), (36, "x " * 400), (37, "x " * 300 + "é" * 200), (38, "a b " + "é" * 120),
             (39, "\n".join(shared[:50])), (40, "\n".join(shared[:49]))]
    edited = base[5][:]
    edited[100 % len(edited)] = "changed"
    rows.append((41, " ".join(edited)))
    return rows


def brute(rows, cut, width):
    """First doc_id of every window, then what is left of each row."""
    first = {}
    for d, t in rows:
        if d is not None:
            seq = cut(t)
            for i in range(len(seq) - width + 1):
                key = tuple(seq[i:i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        seq = cut(t)
        gone = [False] * len(seq)
        for i in range(len(seq) - width + 1):
            if d is not None and first[tuple(seq[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((seq, gone))
    return out


def test_word_windows(make_docs):
    rows = corpus()
    got = substring.remove_repeats(make_docs(*rows)).collect()
    want = Counter()
    for (d, t), (seq, gone) in zip(rows, brute(rows, lambda t: (t or "").encode().split(), 50)):
        want[(d, t, len(seq), sum(gone), b" ".join(w for w, g in zip(seq, gone) if not g).decode())] += 1
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert {r.spans for r in got} == {r.tk for r in got} == {"own"}
    assert sum(r.n_removed for r in got) > 400


def test_byte_windows(make_docs):
    rows = corpus()
    got = suffixes.remove_repeats(make_docs(*rows)).collect()
    want = Counter()
    for (d, t), (seq, gone) in zip(rows, brute(rows, lambda t: (t or "").encode(), 50)):
        starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(d, t, len(seq), sum(gone), starts, bytes(b for b, g in zip(seq, gone) if not g))] += 1
    assert Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == want


def test_suffix_sort_agrees_with_sorted():
    import numpy as np

    rnd = random.Random(5)
    data = np.array([[rnd.randint(97, 98) for _ in range(20)] for _ in range(90)], np.uint8)
    group = np.repeat(np.arange(6), 15)
    start, end = np.full(90, 2), np.array([rnd.randint(10, 20) for _ in range(90)])
    order = suffixes.Suffixes(data, start, end, 1).sort(group)
    text = [bytes(data[i, 2:end[i]]) for i in range(90)]
    assert [text[i] for i in order] == [t for g in range(6) for t in sorted(text[15 * g:15 * g + 15])]


def test_a_long_text_is_read_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 64)
    rows = [(1, "".join(words(60, 1))), (2, "".join(words(60, 1))[30:250] + "".join(words(60, 2)))]
    got = sorted(suffixes.remove_repeats(make_docs(*rows)).collect(), key=lambda r: r.doc_id)
    assert [r.n_removed for r in got] == [sum(g) for _, g in brute(rows, lambda t: t.encode(), 50)]


def bag(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates(make_docs):
    rnd = random.Random(1)
    rows = [(i, " ".join(words(rnd.randint(80, 200), i))) for i in range(10)]
    for i in range(10):
        for j in range(3):
            w = rows[i][1].split()
            for _ in range(j * 2):
                w[rnd.randrange(len(w))] = f"new{rnd.random()}"
            rows.append((100 + 10 * i + j, " ".join(w).upper() if j else " ".join(w)))
    rows += [(500, "a b c"), (501, "A, b. c!"), (502, "a b"), (503, None), (504, None), (505, ""), (506, "!!!"),
             (None, rows[4][1]), (507, "z z z z z z z z z z"), (508, "z z z z z z z z z"), (509, "z z z z z z"), (500, "a b c")]
    got = minhash.near_duplicates(make_docs(*rows)).collect()
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                least, most = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
                if least >= 0.8 * most:
                    root[find(i)] = find(j)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        want[(d, min((x for x in ids if x is not None), default=None), len(ids))] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = minhash.keep_one(make_docs(*rows))
    assert kept.columns == make_docs(*rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        {c for d, c, _ in want if c is not None})


def test_candidates_leave_no_link_out(spark):
    rnd = random.Random(5)
    sets, base = [], list(range(1, 90))
    for i in range(120):
        x = set(sets[-1] if i % 3 else base)
        for v in rnd.sample(sorted(x), rnd.randint(0, 14)):
            x.remove(v)
            x.add(rnd.randint(100, 100_000))
        sets.append(x)
    sets += [{1}, {1}, {1, 2}, {7, 8, 9, 10}, {7, 8, 9, 10, 11}, set()]
    rows = [(i, i // 2, bytearray(b"".join(v.to_bytes(8, "little") for v in sorted(x)))) for i, x in enumerate(sets)]
    found = minhash.candidates(spark.createDataFrame(rows, "node long, label long, bag binary"), 0.8)
    got = {tuple(r) for r in found.collect()}
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if i // 2 != j // 2 and len(x & y) >= 0.8 * len(x | y) > 0}
    assert want <= got and len(want) > 10
    assert len(got) < len(sets) ** 2 / 4


def test_classes_of_a_large_group_are_whole(make_docs):
    """A group of near copies whose members mostly lie apart: only chains hold it together."""
    rnd = random.Random(8)
    base = words(120, 4)
    rows = []
    for i in range(150):
        w = list(base)
        for k in rnd.sample(range(120), 3 + i % 3):
            w[k] = f"v{rnd.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(*rows)).collect()}
    bags, least = [bag(t) for _, t in rows], list(range(len(rows)))
    moved = True
    linked = [(i, j) for j in range(len(rows)) for i in range(j)
              if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]
    while moved:
        moved = False
        for i, j in linked:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                moved = True
    assert got == dict(enumerate(least))


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    a, b = Counter({i: 1 + i % 5 for i in range(60)}), Counter({i: 1 + i % 3 for i in range(20, 80)})
    own = [(k, x) for k, c in enumerate((a, b)) for x in sorted(c.items())]
    owner = np.array([k for k, _ in own])
    hashes = minhash.H.mix(np.array([x for _, (x, _) in own], np.uint64) + np.uint64(1))
    table = minhash.signatures(owner, hashes, np.array([n for _, (_, n) in own]), 2, 4096)
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((table[0] == table[1]).mean() - true) < 0.03


def test_points_drawn_at_once_change_no_signature(monkeypatch):
    import numpy as np

    bags = minhash._bags(*minhash.shingles(["one two three", "", " ".join(words(400, 1)), "x y " * 300, "é " * 9]))
    whole = minhash.signatures(*bags, 5, 240)
    monkeypatch.setattr(minhash, "_POINTS", 1)
    assert np.array_equal(whole, minhash.signatures(*bags, 5, 240)) and np.isinf(whole[1]).all() and np.isfinite(whole[[0, 2, 3, 4]]).all()


@pytest.mark.parametrize("step", [lambda: minhash._sign(40, 6, 5), lambda: minhash._sets(5)], ids=["sign", "sets"])
def test_a_large_batch_needs_little_memory(step):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts = [" ".join(words(200 + i % 7, i)) for i in range(3000)] + [None] * 2
    batch = pa.record_batch([pa.array(range(3002), pa.int64()), pa.array(range(3002), pa.int32()),
                             pa.array(range(3002), pa.int64()), pa.array([x or "" for x in texts])], names=["doc_id", "tk", "node", "text"])
    list(step()(iter([batch.slice(3000)])))  # fixed tables
    tracemalloc.start()
    rows = sum(out.num_rows for out in step()(iter([batch])))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    small = [out for i in range(0, 60, 20) for out in step()(iter([batch.slice(i, 20)]))]
    first = pa.Table.from_batches(list(step()(iter([batch]))))
    assert rows == 3002 and most < 40e6 and first.slice(0, 60).equals(pa.Table.from_batches(small)), most
    assert np.array_equal(first["node" if "sketch" in first.column_names else "doc_id"], np.arange(3002))


@pytest.mark.parametrize("operator", [substring.remove_repeats, suffixes.remove_repeats, minhash.near_duplicates, minhash.keep_one])
def test_empty_table(make_docs, operator):
    assert operator(make_docs((1, "x")).where("false")).collect() == []


def test_sketches_rule_out_no_link():
    import pyarrow as pa

    rnd = random.Random(11)
    texts, base = [], words(300, 6)
    for i in range(60):
        w = list(base)
        for k in rnd.sample(range(300), i % 30):
            w[k] = f"v{rnd.randint(0, 5000)}"
        texts.append(" ".join(w[:300 - i % 7] + ["z"] * (1200 if i % 3 else 1250)))
    made, = minhash._sets(5)([pa.record_batch([pa.array(range(60)), pa.array(texts)], names=["node", "text"])])
    rows, pairs = made.to_pylist(), [(a, b) for b in range(60) for a in range(b)]
    asked = {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}
    asked |= {f"{c}_{x}": [rows[i][c] for i in asked[x]] for c in ("n", "sketch") for x in "ab"}
    left, = minhash._possible(0.9)([pa.record_batch([pa.array(v) for v in asked.values()], names=list(asked))])
    got = set(zip(left["a"].to_pylist(), left["b"].to_pylist()))
    bags = [bag(t) for t in texts]
    want = {(a, b) for a, b in pairs if sum((bags[a] & bags[b]).values()) >= 0.9 * sum((bags[a] | bags[b]).values())}
    assert want <= got and 20 < len(want) and len(got) < len(pairs)


def test_near_copies_are_joined_once_each(make_docs, monkeypatch):
    """Rows read by joins and saved on the way grow with a group, not with its pairs or the steps over its links."""
    rnd, saved = random.Random(9), Counter()
    base = words(120, 4)

    def group(n):
        rows = []
        for i in range(n):
            w = list(base)
            w[rnd.randrange(120)] = f"own{i}"
            rows.append((i, " ".join(w)))
        return make_docs(*rows)

    save = minhash.Workspace.save

    def counted(self, name, frame):
        out = save(self, name, frame)
        if "-edges" in name or "links" in name:
            saved[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Workspace, "save", counted)
    assert {r.class_id for r in minhash.near_duplicates(group(60)).collect()} == {0}
    small = dict(saved)
    saved.clear()
    assert {r.class_id for r in minhash.near_duplicates(group(240)).collect()} == {0}
    assert 0 < sum(saved.values()) < 6 * sum(small.values())
    edges = [saved[n] for n in sorted(saved) if n.startswith("labels0-edges")]
    assert edges[-1] == 0 and all(b < a for a, b in zip(edges, edges[1:])) and sum(edges) < 3 * edges[0]


def test_a_periodic_stretch_is_one_edge_row(make_docs, monkeypatch):
    """Rows of a gram grow with the texts that hold it, not with how long they go on repeating it."""
    rows = [(1, " ".join(["a"] * 70)), (2, " ".join(["a"] * 900 + words(60, 1))), (3, " ".join(["b", "c"] * 60 + ["a"] * 55)),
            (4, " ".join(words(60, 2) + ["c", "b"] * 400 + words(60, 1))), (5, "b c " * 26), (5, "a " * 49), (6, "c " + "a " * 300 + "d " * 80),
            (7, "c " + "a " * 40 + "d " * 80), (8, " ".join((["x"] + ["y"] * 48) * 9)), (9, " ".join((["x"] + ["y"] * 48) * 4))]
    saved = {}
    save = substring.Workspace.save

    def counted(self, name, frame):
        saved[name] = out = save(self, name, frame)
        return out

    monkeypatch.setattr(substring.Workspace, "save", counted)
    got = substring.remove_repeats(make_docs(*rows)).collect()
    want = Counter()
    for (d, t), (seq, gone) in zip(rows, brute(rows, lambda t: t.encode().split(), 50)):
        want[(d, t, len(seq), sum(gone), b" ".join(w for w, g in zip(seq, gone) if not g).decode())] += 1
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert saved["shared1"].where("doc_id = 2").count() < 100
    assert saved["paths1"].where("doc_id = 2").agg({"times": "max"}).head()[0] == 851
