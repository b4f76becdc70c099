"""Readers, writers, streams and edge cases of the rule-table engine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators import graph, lookup, segmenter, tokens
from rulelens.sources import files
from rulelens.sources.analysed import sentences
from rulelens.streaming import trackers
from tests.sentences import SENTENCES

SF = "/root/testdata/sf0.001"


def test_sources(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("key,value,ord\n a ,x,1\na,y,2\nkey,value,3\n,z,4\nb,w,5\n", encoding="utf-8")
    path, schema = str(tmp_path / "rules.csv"), "key string, value string, ord int"
    assert sorted(r.key for r in files.rule_set(spark, path, schema, "key").collect()) == ["a", "b"]
    assert {r.key: r.value for r in files.rule_map(spark, path, schema, "key", "value", "ord").where("key = 'a'").collect()} == {"a": "y"}
    (tmp_path / "v.txt").write_text("1|1|one\n1|2|two|bar\nnot a verse\n2|1|three\n", encoding="utf-8")
    v = files.verses(spark, str(tmp_path / "v.txt"))
    assert [r.text for r in files.verse_range(v, (1, 2), (2, 1)).orderBy("chapter").collect()] == ["two|bar", "three"]
    with pytest.raises(ValueError):
        files.verse_range(v, (2, 1), (1, 1))
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in files.records(spark, str(tmp_path / "r.jsonl"), "a int").collect()) == [1, 2]
    book = tmp_path / "book"
    book.mkdir()
    (book / "1.txt").write_text("/// page 5 ///\nfive\n/// page 6 ///\nsix", encoding="utf-8")
    (book / "2.txt").write_text("no mark", encoding="utf-8")
    assert sorted(map(tuple, files.book_pages(spark, str(book)).collect())) == [(1, 5, "five"), (1, 6, "six"), (2, 1, "no mark")]


def test_sinks(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    files.append_new(df.where("id < 20"), str(tmp_path / "out"), ["id"])
    files.append_new(df, str(tmp_path / "out"), ["id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 50
    files.write_sorted_csv(df, str(tmp_path / "csv"), ["x", "id"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 50
    files.write_records(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 50


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(minutes=7 * k), k % 3, "ab"[k % 2], float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    for k in range(3):
        df.where(f"event_id % 3 = {k} or event_id > 1000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = trackers.tracked(stream).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: (r.n_events, r.n_types, r.last_type, r.total) for r in spark.table("tracked").groupBy("user_id").agg(F.max(F.struct("n_events", "n_types", "last_type", "total")).alias("x")).select("user_id", "x.*").collect()}
    want = {u: (20, 2, max((r[1], r[3]) for r in rows if r[2] == u)[1], sum(r[4] for r in rows if r[2] == u)) for u in range(3)}
    assert got == want
    w = trackers.windowed(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sorted(map(str, spark.table("windowed").collect())) == sorted(map(str, trackers.windowed(df).collect()))


def test_fold_equals_windows_in_any_row_order(spark):
    t = SENTENCES.frame(spark)
    a = sorted(graph.roles(t).select("sent", "pos", "role").collect())
    assert a == sorted(graph.roles(t.orderBy(F.rand(3)).repartition(5)).select("sent", "pos", "role").collect())
    assert a == sorted(graph.folded_roles(t).collect())
    assert {r.role for r in a} >= {"verb", "agent", "patient", "topic", "comment", "attribute", "possessor", "prep_object"}


def test_fold_equals_windows_on_documents(spark):
    t = sentences(spark, SF)
    a, b = graph.roles(t).select("sent", "pos", "role"), graph.folded_roles(t)
    assert a.count() == t.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_resolutions_of_a_sentence_and_the_one_before(spark):
    noun, pron = ("NOUN", "M", "SG"), ("PRON", "M", "SG")
    rows = [(1, 0, "a", *noun), (1, 1, "b", *noun), (2, 0, "x", *pron), (2, 1, "c", *noun), (2, 2, "y", *pron), (4, 0, "z", *pron), (5, 0, "d", "NOUN", "F", "SG"), (6, 3, "w", "PRON", "F", "SG")]
    t = spark.createDataFrame(rows, "sent long, pos int, surface string, class string, gender string, number string")
    got = {r.surface: (r.target, r.nsent, r.npos, r.score, r.candidates, r.kind) for r in graph.resolutions(t).collect()}
    assert got == {
        "x": ("b", 1, 1, 0.6, 2, "Hypothesis"), "y": ("c", 2, 1, 0.909091, 3, "Certificate"),
        "z": (None, None, None, None, None, "Zero"), "w": ("d", 5, 0, 0.461538, 1, "Certificate"),
    }


def test_segments_rebuild_words(spark):
    assert segmenter.g10_segments(spark, SF).where("not rebuilds").count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "w string")
    told = lambda c: [r[0] for r in df.select(lookup.holds(F.col("w"), c)).collect()]
    assert told("startswith_any:a|b") == [True, False, False] and told("not_startswith_any:x") == [True, False, False]
    assert told("is_empty:") == [False, True, True] and told("") == [False] * 3 and told("unknown:x") == [False] * 3
    assert told("contains_at:1:b AND endswith:c") == [True, False, False] and told("not_equals:abc") == [False] * 3


def test_texts_of_every_kind(spark):
    docs = spark.createDataFrame([(1, "en", "Is it? Not now. The end"), (2, "en", None), (3, "xx", ""), (4, None, "a b"), (1, "en", "Is it? Not now. The end")], "doc_id long, lang string, text string")
    t = tokens.tokens(tokens.sentences(docs))
    assert t.where("doc_id in (2, 3)").count() == 0 and t.where("doc_id = 1").count() == 12
    assert tokens.tokens(tokens.sentences(docs.where("false"))).count() == 0


def test_normalize_names_its_steps(spark):
    df = spark.createDataFrame([("آمَن",), (None,), ("",), ("رَحْمَـــة",)], "w string")
    got = ar.normalize(df, "w").collect()
    assert got[0].applied == ["madda"] and got[1].normalized is None and got[2].applied == [] and got[3].applied == ["tatweel"]


def test_a_graph_is_dealt_once_by_sentence_and_once_by_document(spark):
    """Edges, events and nodes were written and joined by their names; the joins' shuffles filled the disk."""
    from rulelens import catalog

    for name in ("d30_graph_edges", "a29_graph_stats"):
        shown = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in shown.split("\n") if "Exchange hashpartitioning" in x and "type#" not in x]
        assert len(dealt) == 2 and "SortMergeJoin" not in shown
        assert shown.count("Sort [") == 2  # tokens are sorted as three numbers


def test_resolutions_count_nouns_of_the_sentence_before_only(spark):
    noun, pron = ("NOUN", "M", "SG"), ("PRON", "M", "SG")
    doc = 1 << 24
    rows = [(doc + 1, 0, "b", *noun), (doc + 1, 5, "c", *noun), (doc + 2, 1, "d", *noun), (doc + 3, 0, "y", *pron), (doc + 3, 1, "e", *noun), (doc + 3, 2, "z", *pron)]
    t = spark.createDataFrame(rows, "sent long, pos int, surface string, class string, gender string, number string")
    got = {r.surface: (r.target, r.candidates) for r in graph.resolutions(t.repartition(3)).collect()}
    assert got == {"y": ("d", 1), "z": ("e", 2)}
