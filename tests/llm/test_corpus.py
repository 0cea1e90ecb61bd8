"""Operators 1, 2, 5 and 6 and the pipeline."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm import decontamination, language, mixing, quality, queries
from tests.llm.conftest import words


def test_quality_on_held_out_labels(spark, small):
    got = queries.op1_nb_svm_quality(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet").withColumn("held_out", quality.held_out())
    rows = got.join(labels.drop("held_out"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 5 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_quality_edges(make_docs, spark):
    docs = make_docs((1, None), (1, None), (2, ""), (3, "İ ſ   x"), (None, "one two"), (4, "word " * 30000))
    model = quality.train(docs, spark.createDataFrame([(1, 1), (3, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int"))
    rows = quality.classify(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and rows[0].tk == "own"
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.where("false"), model).collect() == []


def test_a_large_batch_is_scored_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts = [None, ""] + [" ".join(words(200 + i % 7, i)) for i in range(3000)] * 4
    draw = np.random.default_rng(1)
    model = quality.Model(draw.random(quality.BUCKETS, np.float32), draw.random(quality.BUCKETS, np.float32) - 0.5, 0.1)
    run = quality._scorer(model)
    batch = pa.record_batch([pa.array(range(12002), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    list(run(iter([batch.slice(0, 2)])))
    tracemalloc.start()
    rows = pa.Table.from_batches(list(run(iter([batch]))))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    alone = quality.score(quality.features([x or "" for x in texts]), model)
    assert rows.num_rows == 12002 and rows["doc_id"].to_pylist() == list(range(12002)) and most < 40e6, most
    assert np.array_equal(rows["score"], alone)


def test_dual_coordinate_descent_separates():
    import numpy as np

    rows = [np.array([i, 50 + i % 2], np.int32) for i in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    model = quality.fit(rows, labels, 64)
    assert ((quality.score(rows, model) > 0.5) == labels).all()
    assert model.ratio[51] > 1 > -1 > model.ratio[50] and model.ratio[60] == 0


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        above = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in free}
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= above


def test_mixing(make_docs):
    rnd = random.Random(2)
    names = ["b", "a", None, "é", "Z", "big"]
    rows = [(i if i % 50 else None, " ".join(["w"] * rnd.choice([0, 1, 2, 5, 9, 40, 200]))) for i in range(600)] + [(5, None), (5, " ")]
    docs = make_docs(*rows, source=lambda i: names[0] if i % 3 else names[i % 6])
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.taken, str(r.source))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 602
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(2, 0.01 * want[s])
    assert mixing.mix(docs.where("false")).collect() == []


def test_language(spark, small, make_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.op5_cross_parsing_language(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    profile = language.learn(docs)
    odd = make_docs((1, None), (2, ""), (3, "12 !!"), (4, "日本"), (4, "日本"), (None, "der die und " * 5000))
    rows = sorted(language.predict(odd, profile).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[3].lang_pred == rows[4].lang_pred == "de"
    assert rows[5].lang_pred == "de" and all(0 <= r.score <= 1 for r in rows) and rows[0].tk == "own"
    empty = language.learn(docs.where("false"))
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}


def test_automaton_finds_longest_phrases():
    rnd = random.Random(4)
    train = [rnd.randint(0, 2) for _ in range(300)]
    table = language.automaton(train, 5)
    for _ in range(20):
        text = [rnd.randint(0, 3) for _ in range(100)]
        state, count = (len(table) - 5) * 2, 0
        for c in text:
            state = int(table[(state >> 1) + c])
            count += state & 1
        joined, phrases, at = ",".join(map(str, train)) + ",", 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and ",".join(map(str, text[at:end + 1])) + "," in joined and text[at] != 3:
                end += 1
            phrases, at = phrases + 1, end
        assert count == phrases


def test_templates(spark, make_docs):
    item = "in the morning Maria ran 12 km and then Maria swam 3 miles before the others had even woken up today"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (None, item), (3, None), (3, "")], "item_id long, text string")
    filler = " ".join(words(60, 5))
    docs = make_docs(
        (1, filler + " " + item + " " + filler), (2, filler + " " + item.replace("Maria", "Peter").replace("12", "7,5") + " x"),
        (3, item.replace("Maria swam", "Anna swam").replace("Maria", "Peter")), (4, filler), (5, None), (6, ""),
        (None, item), (1, filler + " " + item + " " + filler), (7, item.replace("km", "hours").upper()), (8, filler * 50))
    got = {(r.doc_id, r.item_id): r.n_slots for r in decontamination.contaminated(docs, bench).collect()}
    assert got[(1, 1)] == 5 and got[(2, 1)] == 5 and {d for d, _ in got} == {1, 2, 7}
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 8]
    assert decontamination.matches(docs.where("false"), bench).count() == 0
    assert decontamination.clean(docs, bench.where("false")).count() == docs.count()


def test_every_item_is_joined(spark, make_docs):
    texts = ["What is the capital of Australia?", "12 + 7 = 19, 30 - 4 = 26, 5 * 5 = 25", "The Great Fire Of London Began In Pudding Lane On Sunday",
             "请问澳大利亚的首都是哪一个城市", "Maria had a basket of red apples for the school fair"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    filler = " ".join(words(30, 5))
    said = ["what is the capital of Australia", *texts[1:4], "Peter had a basket of red apples for the school fair"]
    docs = make_docs(*[(i, f"{filler}\n({t}) {filler}") for i, t in enumerate(said)], (5, filler), (6, f"你好{texts[3][2:]}吗"),
                     (7, "What is the capital of Austria"), (8, "12 + 7 = 18, 30 - 4 = 26, 5 * 5 = 24"), (9, texts[0]))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(i, i) for i in range(5)} | {(6, 3), (9, 0)}


def test_slots_are_judged_by_run(spark, make_docs):
    some = lambda tag, n: " ".join(f"{tag}{chr(97 + i)}" for i in range(n))
    item = f"{some('p', 20)} then Maria left and {some('q', 20)} then Maria came {some('r', 9)}"
    sums = f"he took 3 red and 5 green ones {some('s', 4)}"
    bench = spark.createDataFrame([(1, item), (2, sums)], "item_id long, text string")
    docs = make_docs((1, item.replace("Maria came", "Anna came")), (2, sums.replace("3", "4").replace("5", "4")),
                     (3, item.replace(some("q", 20), some("t", 20)).replace("Maria came", "Anna came")), (4, some("u", 26)), (5, item))
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (5, 1)} and got[(5, 1)] == 56 - 7
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [4]


def test_leaks_equal_brute_force(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))

    def template(text):
        named = re.sub(r"(?:(?<=[^\W\d_] )|(?<=[0-9,] ))[^\W\d_]+", lambda m: "@" + m[0][1:] if m[0][0].isupper() and m[0][1:2].islower() else m[0], text)
        return ["@" if w.startswith("@") else w for w in re.split(r"[\x00-\x2f\x3a-\x3f\x5b-\x60\x7b-\x7f]+", named.lower()) if w]

    asked = {tuple(w[i:i + 8]): r.item_id for r in bench.collect() for w in [template(r.text)]
             for i in range(len(w) - 7) if sum(x != "@" for x in w[i:i + 8]) >= 5}
    want = {(r.doc_id, asked[tuple(w[i:i + 8])]) for r in docs.collect() for w in [template(r.text or "")]
            for i in range(len(w) - 7) if tuple(w[i:i + 8]) in asked}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == want and got


def test_pipeline(spark, small):
    import corpus_pipeline as P

    given = spark.read.parquet(f"{small}/documents.parquet")
    docs, counts = given, []
    for _, stage in P.STAGES:
        out = stage(spark, docs, small)
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
        if len(counts) < len(P.STAGES):
            assert docs.columns == given.columns
    assert given.count() > counts[0] > counts[1] == counts[2] > counts[3] >= counts[4] > 0
    last = P.run(spark, small)
    cols = ["doc_id", "copies", "taken"]
    assert sorted(map(tuple, last.select(cols).collect())) == sorted(map(tuple, docs.select(cols).collect()))
    assert last.where(F.col("taken") != F.col("copies") * F.col("size")).count() == 0
