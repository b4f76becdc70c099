"""Joins beyond the bound for broadcasts: no side goes whole through the driver, whatever Spark guesses of its size."""

import collections

import pytest
from pyspark.sql import functions as F

from rulelens.plans.joins import checked_join, large_join
from rulelens.plans.scratch import save


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_no_side_beyond_the_bound_is_sent_to_all_tasks(spark, how):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # the written side looks small enough
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = save(spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("w"), "id").alias("word")), "test-small")
    joined = checked_join(big, small, ["k"], how, limit=10)
    assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    want = collections.Counter((7 if i % 3 == 0 else i % 50, i) for i in range(1000))
    want = collections.Counter((k, i, f"w{k}" if k < 40 else None) for k, i in want if k < 40 or how == "left")
    assert collections.Counter(map(tuple, joined.select("k", "id", "word").collect())) == want
    assert "BroadcastHashJoin" in plan(checked_join(big, small, ["k"], how, limit=40))


def test_large_join_is_merged(spark):
    a = save(spark.range(100).select(F.col("id").alias("sent"), F.lit(1).alias("v")), "test-large")
    joined = large_join(spark.range(200).withColumnRenamed("id", "sent"), a, ["sent"], "left")
    assert "BroadcastHashJoin" not in plan(joined)
    assert joined.where("v = 1").count() == 100 and joined.count() == 200


def test_joins_of_tokens_send_no_side_to_all_tasks(spark):
    """Graph, gate, clause and text graph joins over written tables; only tables of rules may be sent."""
    from rulelens.operators.clauses import condition_edges
    from rulelens.operators.gates import replace_edges
    from rulelens.operators.graph import events
    from rulelens.operators.textgraph import assembled

    toks = save(spark.createDataFrame([(1, 0, "قَالَ", "قال", "VERB", None, None, "M", "SG", "past"), (1, 1, "رَجُلٌ", "رجل", "NOUN", "NOM", False, "M", "SG", None)], "sent long, pos int, surface string, lemma string, class string, gcase string, definite boolean, gender string, number string, tense string"), "test-toks")
    found = save(spark.createDataFrame([(1, "agent_of", 1, 0, "رَجُلٌ", "Certificate")], "sent long, name string, source int, target int, surface string, proof string"), "test-edges")
    ev = events(toks, spark, found)
    assert "BroadcastHashJoin" not in plan(ev) and [r.agent_of for r in ev.collect()] == ["رَجُلٌ"]
    spans = save(spark.createDataFrame([(1, 0, 0, 1, "A2", None, "x", "if", "t"), (1, 1, 2, 3, "A3a", 0, "fa", "fa", "t")], "sent long, clause int, start int, end int, rule string, parent int, introduced_by string, head_token string, type string"), "test-spans")
    nodes, edges = assembled(toks, spans, ["sent"])
    assert "BroadcastHashJoin" not in plan(nodes) + plan(edges)
    pairs = condition_edges(toks, spans, spark.createDataFrame([("رَجُلٌ",)], "word string"), ["sent"])
    assert plan(pairs).count("BroadcastHashJoin") <= 1 and pairs.count() == 2  # the list of verbs may be sent
    kept = replace_edges(found.drop("surface"), found.drop("surface"), ["sent", "source"])
    assert plan(kept).count("SortMergeJoin") >= 2 and kept.count() == 1


def test_tokens_meet_their_forms_without_a_shuffle_by_token(spark, tmp_path):
    """Sorting tokens beside a salted vocabulary took most of the time of all queries on analysed tokens."""
    from rulelens.sources import analysed, readings, sequences

    rows = [(1, "en", "a", "Alpha, beta gamma. of... O'Neil (x) 7-8"), (None, "en", "a", "beta, beta"), (3, "en", "a", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    toks = analysed.sentences(spark, str(tmp_path))
    shuffles = [x for x in plan(toks).split("\n") if "Exchange" in x and "Broadcast" not in x and "hashpartitioning" in x]
    assert len(shuffles) == 1 and "hashpartitioning(sent" in shuffles[0]
    word = {r.id[1:]: r.word for r in readings.readings(spark.createDataFrame([(t,) for t in ("alpha", "beta", "gamma", "of", "o'neil", "x", "7-8")], "token string")).collect()}
    first = [r.surface for r in toks.where("sent >> 24 = 1").orderBy("sent", "pos").collect()]
    assert first == [word[t] for t in ("alpha", "beta", "gamma", "of", "o'neil", "x", "7-8")] and toks.count() == 9
    assert {r.id[1:] for r in readings.read_words(spark, str(tmp_path)).collect()} == set(word)
    pieces = [r.surface for r in sequences.read_sentences(spark, str(tmp_path)).where("doc_id is null").orderBy("pos").collect()]
    assert pieces == [word["beta"], sequences.PAUSE, word["beta"]]


def test_forms_are_the_readings_of_their_digests(spark):
    import hashlib

    from rulelens.sources import readings

    tokens = [f"w{k}" for k in range(500)] + ["", "ß", "été", "ΑΣ"]
    told = {r.id[1:]: (r.kind, r.word) for r in readings.readings(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    codes = {r.code: (r.kind, r.word) for r in readings.forms(spark).collect()}
    for t in tokens:
        d = hashlib.md5(t.encode()).hexdigest()
        nr = int(d[:7], 16) % len(readings.STEMS.rows)
        kind = readings.STEMS.rows[nr][1]
        slot = int(d[8:12], 16) % readings._N_BEFORE[kind]
        place = int(d[12:16], 16) % readings._N_ENDINGS[readings._BEFORE[kind][slot][1]]
        assert told[t] == codes[nr * 10_000 + slot * 100 + place] and told[t][0] == kind


def test_one_order_serves_all_windows_of_roles(spark):
    from rulelens.operators.graph import _edges

    toks = save(spark.createDataFrame([(1, 0, "x", "x", "VERB", None, None, "M", "SG", "past")], "sent long, pos int, surface string, lemma string, class string, gcase string, definite boolean, gender string, number string, tense string"), "test-order")
    assert plan(_edges(toks, spark)).count("Sort [") == 1


@pytest.mark.parametrize("name", ["d05_modals", "d01_clause_acts"])
def test_texts_are_cut_and_hits_sought_once(spark, tmp_path, name):
    """A column that is unfolded after it was made is worked out again in the filter that Spark derives from it."""
    from rulelens import catalog

    spark.createDataFrame([(1, "en", "a", "It is to be. That is, if it is not to be and may be")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    assert plan(df).count("regexp_extract_all(") == 1 and "size(" not in "".join(x for x in plan(df).split("\n") if "Filter" in x)
    assert df.count() > 0


def test_vocabulary_is_that_of_the_tokens(spark, tmp_path):
    from rulelens.operators.tokens import document_tokens
    from rulelens.sources.readings import vocabulary

    texts = ["a.b A.B !? ...", "(Ωd) ΑΣ. ΑΣ.Β ΑΣ,Β -- x-y- 'z'  q  İI", "tab\tvt\x0bff\x0ccr\rnl\nend", "", None, "ß.ẞ é́. 1,5 3.14 --a--b--"]
    spark.createDataFrame([(k, "en", "a", t) for k, t in enumerate(texts)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {t for r in document_tokens(spark, str(tmp_path)).collect() for s in r.sents for t in s}
    told = [r.token for r in vocabulary(spark, str(tmp_path)).collect()]
    assert set(told) == want and len(told) == len(want)
