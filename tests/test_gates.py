"""Gates, replaced edges, implicit agents and certified claims on stated rows."""

import pytest
from pyspark.sql import Observation

from rulelens.functions.arabic import ordered
from rulelens.operators import gates, segmenter

D = "struct<class:string, proof:string, segmentation:string, needs_context:boolean, ambiguous:boolean>"
SURE, CONTEXT = ("VERB", "Certificate", "Certificate", False, False), ("VERB", "Hypothesis", "Certificate", True, False)
FRAGMENT, AMBIGUOUS = ("NOUN", "Zero", "Zero", False, False), ("NOUN", "Hypothesis", "Hypothesis", False, True)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, SURE, SURE), (2, SURE, CONTEXT), (3, FRAGMENT, SURE), (4, AMBIGUOUS, FRAGMENT), (5, None, SURE)]
    return spark.createDataFrame(rows, f"id int, s {D}, t {D}").repartition(3)


def test_observing_keeps_all_and_counts(pairs):
    seen = Observation("seen")
    got = {r.id: (r.would_block, r.reasons) for r in gates.gate(pairs, {"source": "s", "target": "t"}, observation=seen).collect()}
    assert got == {
        1: (False, []), 2: (True, ["target_hypothesis_needs_context"]), 3: (True, ["source_is_fragment"]), 4: (True, ["source_ambiguous_uncertified", "target_is_fragment"]), 5: (False, []),
    }
    assert seen.get == {"rows": 5, "blocked": 3, "fragment": 2, "hypothesis": 1, "ambiguous": 1, "not_certified": 0, "segmentation_status": 0, "decision_missing": 0}


def test_enforcing_drops_what_observing_counts(pairs):
    seen = Observation("dropped")
    assert {r.id for r in gates.gate(pairs, {"source": "s", "target": "t"}, mode="enforce", observation=seen).collect()} == {1, 5}
    assert seen.get["rows"] == 5 and seen.get["blocked"] == 3
    with pytest.raises(ValueError, match="no such mode"):
        gates.gate(pairs, {"source": "s"}, mode="warn")


def test_events_need_certified_verbs(pairs):
    got = {r.id: r.reasons for r in gates.gate(pairs, {"verb": "s"}, event=True).collect()}
    assert got == {1: [], 2: [], 3: ["not_certified_verb:NOUN/Zero", "verb_is_fragment", "segmentation_status:Zero"], 4: ["not_certified_verb:NOUN/Hypothesis", "verb_ambiguous_uncertified", "segmentation_status:Hypothesis"], 5: ["verb_decision_missing"]}


def test_edges_are_replaced_in_order(spark):
    schema = "sent int, name string, source int, target int, proof string"
    edges = spark.createDataFrame([(1, "attribute_of", 4, 3, "a"), (1, "attribute_of", 5, 3, "b"), (1, "agent_of", 2, 1, "c"), (2, "attribute_of", 4, 3, "d"), (1, "kana_topic_of", 9, 8, "e")], schema)
    added = spark.createDataFrame([(1, "patient2_of", 4, 1, "x"), (1, "kana_topic_of", 2, 1, "y"), (1, "kana_topic_of", 9, 8, "again"), (1, "substitute_of", 5, 4, "z")], schema)
    got = sorted((r.sent, r["name"], r.source, r.proof) for r in gates.replace_edges(edges, added, ["sent", "source"]).collect())
    assert got == [(1, "attribute_of", 5, "b"), (1, "kana_topic_of", 2, "y"), (1, "kana_topic_of", 9, "e"), (1, "patient2_of", 4, "x"), (1, "substitute_of", 5, "z"), (2, "attribute_of", 4, "d")]
    assert gates.replace_edges(edges, added.where("false"), ["sent", "source"]).count() == 5


def words(spark, *xs):
    return spark.createDataFrame([(ordered(x),) for x in xs], "word string")


def test_who_acts(spark):
    stated = {"نَكْتُبُ": "نَحْنُ", "يَكْتُبُ": "هُوَ", "يَكْتُبُونَ": "هُمْ", "تَكْتُبُونَ": "أَنْتُمْ", "كَتَبْتُمْ": "أَنْتُمْ", "كَتَبُوا": "هُمْ", "كَتَبْنَا": "نَحْنُ", "كَتَبْنَاهُمْ": "نَحْنُ", "كَتَبَهُمْ": None, "كَتَبَ": None, "اكْتُبُوا": "أَنْتُمْ", "اكْتُبْ": "أَنْتَ", "وَلْيَكْتُبُوا": "هُمْ", "فَسَيَكْتُبُ": "هُوَ", "كِتَابٌ": None}
    got = {r.word: r.pronoun for r in gates.implicit_agents(words(spark, *stated)).collect()}
    assert got == {ordered(w): ordered(p) for w, p in stated.items() if p}


def test_claims_are_certified_by_segments(spark):
    w = words(spark, "بِالْقَلَمِ", "بَحْرٌ", "وَكَتَبَ", "وَجَدَ", "فَكَتَبَ", "فَتَحَ", "كِتَابُهُ", "وَجْهٌ", "إِنْ", "لَا", "مَن", "اللَّهِ", "كَتَبَ")
    claims = gates.word_claims(w)
    got = {(r.word, r.meaning): (r.certified, r.reason) for r in gates.certified_claims(claims, segmenter.segments(w)).collect()}
    ok = lambda word, meaning: got[ordered(word), meaning]
    assert ok("بِالْقَلَمِ", "BA_ILSAQ") == (True, "") and ok("بَحْرٌ", "BA_ILSAQ") == (False, "topic_PREP_BA_needs_prefix_PREP")
    assert ok("بِالْقَلَمِ", "BA_QASAM")[1] == "topic_QASAM_PARTICLES_needs_oath_context"
    assert ok("وَكَتَبَ", "WAW_ATF")[0] and not ok("وَجَدَ", "WAW_ATF")[0] and ok("وَكَتَبَ", "WAW_QASAM")[1] == "meaning_WAW_QASAM_has_no_evidence"
    assert ok("فَكَتَبَ", "FA_JAWAB")[0] and not ok("فَتَحَ", "FA_JAWAB")[0]
    assert ok("كِتَابُهُ", "HA_GHAIB")[0] and ok("إِنْ", "IN_SHART")[0] and ok("لَا", "LA_NAHIYA")[0]
    assert not ok("كَتَبَ", "KAF_TASHBIH")[0]
    # A whole word without its exact form is looked up without marks.
    assert {m for x, m in got if x == "مَن"} == {"MIN_IBTIDA", "MAN_SHART"} and {m for x, m in got if x == ordered("إِنْ")} == {"IN_SHART"}


def test_edges_of_a_pass_are_replaced_as_tables_are(spark):
    """Edges were written twice and dealt three times to be compared."""
    from rulelens.operators.graph import relations
    from rulelens.operators.references import passes
    from rulelens.sources.analysed import sentences

    toks = sentences(spark, "/root/testdata/sf0.001")
    columns = ["sent", "name", "source", "target", "distance", "proof"]
    want = gates.replace_edges(relations(toks, spark).select(*columns), passes(toks).select(*columns).distinct(), ["sent", "source"]).select(*columns)
    got = gates.replaced_edges(toks, spark)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in shown and shown.count("Exchange hashpartitioning") == 1
