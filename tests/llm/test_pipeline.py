"""The pipeline's stages, one after the other, against plain Python."""

import collections
import hashlib
import random

import corpus_pipeline
from rulelens.llm import mixing, wordbpe
from tests.llm.test_operators import base_spans, brute_links, brute_quality

rng = random.Random(11)


def text(n):
    return " ".join(f"{rng.choice(['al', 'be', 'co', 'du'])}{rng.randrange(5000)}" for _ in range(n))


def masked(t):
    out, at = "", 0
    for start, _, end in base_spans(t):
        if start >= at:
            out += t[at:start] + "[SECRET]"
        at = max(at, end)
    return out + t[at:]


def table():
    rows = [text(90) for _ in range(24)] + [text(10), "", None, "De " * 200]
    for k in range(3):
        words = rows[k].split()
        rows += [rows[k], " ".join(words[:40] + ["edited"] + words[41:]), " ".join(words[:-2])]
    rows += [f"{text(60)} password = hunter22x {text(5)} token:abcdef99", f"{text(70)} {'ab12' * 8}"]
    return [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(rows)]


def test_stages(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stage(spark, made[-1], str(tmp_path)).cache())
        assert name == "bpe" or made[-1].columns == docs.columns
    source = {r[0]: r[3] for r in rows}
    good = {i for i, *_, kept in brute_quality([(r[0], r[1], r[3]) for r in rows], 20) if kept}
    assert {r.doc_id for r in made[1].collect()} == good
    texts = {r[0]: r[1] for r in rows if r[0] in good}
    one = {c for _, c in brute_links(list(texts.items()), 5, 80).values()}
    assert sorted(r.doc_id for r in made[2].collect()) == sorted(one) and len(one) < len(good)
    safe = {i: masked(texts[i]) for i in one}
    assert {r.doc_id: r.text for r in made[3].collect()} == safe and any("[SECRET]" in t for t in safe.values())
    mix = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame([(i, t, source[i]) for i, t in safe.items()], "doc_id long, text string, source string")).collect()}
    want = collections.Counter({i: n for i, n in mix.items() if n})
    assert collections.Counter(r.doc_id for r in made[4].collect()) == want
    t = wordbpe.tokenizer(wordbpe.default_path())
    for r in made[5].collect():
        ids = t.encode(safe[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert collections.Counter(r.doc_id for r in made[5].collect()) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark, tmp_path):
    """Every stage takes further columns whatever they are called, and all but the last hand them on."""
    odd = ["a.b", "_doc", "row", "key", "doc", "x`y", "_n", "text.text", "spans"]
    rows = [(*r, *(f"{c}{r[0]}" for c in odd)) for r in table()]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *odd])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, before = stage(spark, docs, str(tmp_path)), docs
        got = docs.collect()
        assert got
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns
            assert all(r[5 + j] == f"{c}{r[0]}" for r in got for j, c in enumerate(odd))
