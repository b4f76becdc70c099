"""Nearest labelled examples against brute force, held-out accuracy, and small odd tables."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from rulelens.llm import toxicity

rng = random.Random(11)
SF = "/root/testdata/sf0.01"


def test_block_max_search_is_exact():
    gen = np.random.default_rng(2)
    rows = []
    for k in range(500):
        terms = sorted(rng.sample(range(60), rng.randint(1, 9)))
        w = gen.random(len(terms)) + 0.01
        rows.append((k, terms, w / math.sqrt(w @ w)))
    rows += [(500 + k, rows[3][1], rows[3][2]) for k in range(20)]  # ties
    dense = np.zeros((len(rows), 60))
    for k, t, w in rows:
        dense[k, t] = w
    index = toxicity.BlockMaxIndex(rows, block=16)
    for q in [*(rows[rng.randrange(500)] for _ in range(60)), rows[3]]:
        for without in (-1, q[0]):
            cosines = dense @ dense[q[0]]
            want = sorted(((-c, k) for k, c in enumerate(cosines) if c > 0 and k != without))[:7]
            got = index.nearest(q[1], q[2], 7, without)
            assert np.allclose([c for c, _ in got], [-c for c, _ in want])
            clear = [k for c, k in want if -c > -want[-1][0] + 1e-9]
            assert [k for _, k in got][: len(clear)] == clear or {k for _, k in got} >= set(clear)
    assert index.nearest([99], np.array([1.0]), 5) == [] and toxicity.BlockMaxIndex([]).nearest([1], np.array([1.0]), 5) == []


def test_equal_cosines_go_to_smaller_numbers():
    rows = [(k, [1], np.array([1.0])) for k in range(50)]
    assert [n for _, n in toxicity.BlockMaxIndex(rows, block=8).nearest([1], np.array([1.0]), 5)] == [0, 1, 2, 3, 4]


def prose(toxic):
    w = [rng.choice(["alba", "bero", "cindo", "dara", "elsu", "fomo"]) + rng.choice(["", "n", "st"]) for _ in range(rng.randint(20, 60))]
    for _ in range(3 if toxic else 0):
        w.insert(rng.randrange(len(w)), "vile" + rng.choice(["ran", "tun", "mo", ""]))
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, prose(k % 4 == 0), "x") for k in range(400)]
    odd = [(1000, None, "x"), (1001, "", "x"), (None, prose(True), "x"), (None, None, None), (8, rows[8][1], "again"), (8, rows[8][1], "again"), (1002, "vileran " * 4000, None), (1003, "ß漢" * 3000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, terms string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(8, 1, 0), (5000, 1, 1), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_scores(spark, tables):
    docs, labels = tables
    got = toxicity.score(docs, labels, k=5)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert len(r.evidence) <= 5 and all(0 < e.cosine < 1 + 1e-9 for e in r.evidence)
    told = [r for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in told if r.held_out) >= 0.97 * sum(r.held_out for r in told)
    by = {r.doc_id: r for r in rows}
    assert by[1002].predicted == 1 and by[1000].score == by[1001].score < 0.5 and by[1003].predicted == 0
    assert len({r.score for r in rows if r.doc_id == 8}) == 1
    again = toxicity.score(docs.repartition(7), labels, k=5).collect()
    key = lambda x: sorted((str(r.doc_id), round(r.score, 9)) for r in x)
    assert key(again) == key(rows)
    # Shards of the index give the same neighbours as the whole.
    assert key(toxicity.score(docs, labels, k=5, shard=150).collect()) == key(rows)


def test_labels_held_out_teach_nothing(spark, tables):
    docs, labels = tables
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    turned = labels.selectExpr("doc_id", "quality", f"CASE WHEN doc_id IN ({','.join(map(str, out))}) THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda x: sorted((str(r.doc_id), round(r.score, 9)) for r in x)
    assert key(toxicity.score(docs, labels).collect()) == key(toxicity.score(docs, turned).collect())


def test_without_labels_or_rows(spark, tables):
    docs, labels = tables
    assert toxicity.score(docs.where("false"), labels).collect() == []
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs.limit(20), none).collect()} == {0.0}


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    rows = toxicity.query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.predicted == 1 for r in rows if r.toxic == 1) >= 0.75 * sum(r.toxic for r in rows)
    assert sum(r.predicted == 1 for r in rows if r.toxic == 0) <= 0.02 * len(rows)
