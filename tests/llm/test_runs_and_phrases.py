"""Periodic runs and collocations against brute force, and on small odd tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from rulelens.llm import collocations, periodic

W = re.compile(r"[^\x20\x09-\x0d]+")
rng = random.Random(5)


def brute_runs(x, least=24, repeats=3):
    n, out = len(x), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, repeats * q):
                part = x[s : s + length]
                if not any(all(part[j] == part[j + r] for j in range(length - r)) for r in range(1, q)):
                    out.append((s, length, q))
            i = max(i, s) + (i == s)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence():
    x = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33]))]
        x += (unit * rng.randint(1, 12))[: rng.randint(1, 160)] + [rng.randint(0, 50) for _ in range(rng.randint(0, 10))]
    return x


def test_runs_match_brute_force():
    for _ in range(400):
        x, window = sequence(), rng.choice([1, 16, 64, 1 << 16])
        assert periodic.periodic_runs(np.array(x, np.int64), window=window) == brute_runs(x), x
    for least, repeats in ((3, 3), (10, 4), (60, 3)):
        for _ in range(60):
            x = sequence()
            assert periodic.periodic_runs(np.array(x, np.int64), least, repeats) == brute_runs(x, least, repeats), x


def test_one_word_throughout_is_one_run():
    assert periodic.periodic_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(np.zeros(30, np.int64), 24, 2)


def rewritten(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = W.findall(text or "")
    w = w if doc_id is None else rewritten(doc_id, w)
    runs = brute_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


def test_runs_query(spark, tmp_path):
    texts = [" ".join(map(str, sequence())) for _ in range(150)] + [None, "", " \n", "a", "b " * 23, "b " * 24, "ü\x0bé " * 40, " ".join(map(str, range(900)))]
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(3, texts[3], 1), (None, "c " * 30, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))) > 8
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(brute_row(k, t)) for k, t, _ in rows)


def test_runs_of_an_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []


# -- collocations ---------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top=2000):
    singles, several = collections.Counter(), collections.Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    (singles if n == 1 else several)[lang or "und", tuple(w[i : i + n])] += 1
    found = {k: a for k, a in several.items() if a >= least}
    count, total, out = singles + several, collections.Counter(), collections.defaultdict(list)
    for (lang, _), f in singles.items():
        total[lang] += f
    longer = collections.Counter()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, x, y, total[lang], -s) for lang, v in out.items() for k, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def some_texts(n=220):
    vocab = [f"{a}{b}" for a in ("al", "Be", "cö", "x") for b in ("", "r", "la", "7")]
    phrases = ["the lazy dog of", "a b", "b a b", "one one one one one"]
    out = []
    for _ in range(n):
        w = [rng.choice(vocab) if rng.random() < 0.6 else rng.choice(phrases) for _ in range(rng.randint(0, 25))]
        out.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(x + rng.choice([" ", " ", " ", "\t", ". ", "\n", ","]) for x in w)))
    return out


@pytest.mark.parametrize("limit", [collocations.LISTED, 0])
def test_phrases_match_brute_force(spark, monkeypatch, limit):
    rows = [*some_texts(), ("en", None), (None, ""), ("en", "dog " * 400), ("en", "dog " * 400), ("de", "? ! .")]
    docs = spark.createDataFrame([Row(lang=x, text=t, key=1, w1="clash") for x, t in rows])
    for least in (5, 30):
        got = collocations.collocations(docs, least=least, listed_limit=limit).collect()
        assert sorted(map(tuple, got)) == brute_phrases(rows, least) and len(got) > 3
    assert len({r.lang for r in got}) >= 2
    few = collocations.collocations(docs.repartition(5), least=5, top=3, listed_limit=limit).collect()
    assert sorted(map(tuple, few)) == brute_phrases(rows, 5, top=3)
    assert collocations.collocations(docs.where("false"), listed_limit=limit).collect() == []


@pytest.mark.parametrize("rows, most", [(1, 1), (3, 7), (2, 10**6)])
def test_pivots_cut_anywhere(spark, monkeypatch, rows, most):
    monkeypatch.setattr(collocations, "MINED_ROWS", rows)
    monkeypatch.setattr(collocations, "HELD_ROWS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    rows = some_texts(120)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == brute_phrases(rows, 4) and len(got) > 3


def test_partial_pivots_add_up():
    codes = np.array([1, 2, 1, 2, 3, 1, 0, 2, 1] * 50, np.int64)
    one = collocations._fragments(codes, np.array([], np.int64), np.array([], np.int64))
    salted = collocations._fragments(codes, np.array([1, 2]), np.array([3, 4]))
    count = lambda t, partial, least: collections.Counter({tuple(r[c] for c in ("w1", "w2", "w3", "w4")): r["a"] for b in collocations._mined([t], partial, least) for r in b.to_pylist()})
    assert count(one, [], 1) == count(salted, [], 10**9) + count(salted.filter(np.asarray(salted.column("salt")) < 0), [], 1)
    assert count(one, [1, 2, 3], 10**9) == count(one, [], 1) and not count(one, [], 10**9)


def test_phrases_match_sql(spark):
    rows = some_texts(400)
    docs = spark.createDataFrame(rows, "lang string, text string")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = c.sql(collocations.SQL).project("lang, rank, phrase, a, l, r, n, score").fetchall()
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == sorted(want) and len(want) > 5
