"""Ambiguous words between stated neighbours."""

import pytest

from rulelens.functions.arabic import ordered
from rulelens.operators import context
from rulelens.sources.rules import Rules

CASES = [
    # word, before, behind, class, function, proof
    ("مَن", "ٱللَّهُ", "يَعْلَمُ ٱلْغَيْبَ", "ISM_MAWSOOL", "relative_pronoun", "Hypothesis"),
    ("مَن", "", "يَعْمَلْ خَيرًا فَلَهُ ٱلْأَجرُ", "ISM_MABNI", "conditional_tool", "Certificate"),
    ("مَن", "", "يَعْمَلْ خَيرًا", "ISM_MABNI", "conditional_tool", "Hypothesis"),
    ("مَن", "قَالَ", "أَنتَ", "ISM_MABNI", "interrogative_tool", "Certificate"),
    ("مَن", "", "", "ISM_MABNI", "unresolved_ambiguous", "Hypothesis"),
    ("مِنْ", "قَالَ", "يَعْمَلْ فَ", "HARF", "prepositional_phrase_component", "Certificate"),
    ("ما", "ٱللَّهُ", "يَعْلَمُ ٱلسِّرَّ", "ISM_MAWSOOL", "relative_pronoun", "Hypothesis"),
    ("ما", "", "كَتَبَ زَيدٌ", "HARF", "negative_particle", "Hypothesis"),
    ("مَا", "", "تَفْعَلْ مِن خَيرٍ فَلَك أَجرُهُ", "ISM_MABNI", "conditional_tool", "Certificate"),
    ("ما", "قَالَ", "تُريدُ", "ISM_MABNI", "interrogative_tool", "Certificate"),
    ("ما", "بِ", "زَيدٌ", "HARF", "extra_particle", "Hypothesis"),
    ("ما", "", "", "ISM_MABNI", "unresolved_ambiguous", "Hypothesis"),
    ("أَيُّ", "قَالَ", "كِتَابٍ", "ISM_MUARAB", "interrogative_tool", "Certificate"),
    ("أَيُّ", "", "كِتَابٍ", "ISM_MUARAB", "interrogative_tool", "Hypothesis"),
    ("أَيُّ", "", "", "ISM_MUARAB", "unresolved_ambiguous", "Hypothesis"),
    ("مَتَى", "قَالَ", "تَعودُ", "ISM_MABNI", "interrogative_tool", "Certificate"),
    ("مَتَى", "", "تَعودُ", "ISM_MABNI", "temporal_adverb", "Hypothesis"),
    ("أَيْنَ", "", "ٱلْبَيْتُ", "ISM_MABNI", "locative_adverb", "Hypothesis"),
    ("أَيْنَ", "", "تَجْلِسْ هُنَا فَأَجْلِسُ", "ISM_MABNI", "conditional_tool", "Certificate"),
    ("حَيْثُ", "قَالَ", "كَانَ", "ISM_MABNI", "locative_adverb", "Hypothesis"),
    ("حَيْثُ", "", "تَجْلِسْ فَ", "ISM_MABNI", "conditional_tool", "Hypothesis"),
    ("بِمَا", "", "كَتَبَ", "HARF", "prepositional_phrase_component", "Certificate"),
]


def test_decisions(spark):
    rows = []
    for k, (word, before, behind, *_) in enumerate(CASES):
        rows += [(k, pos, ordered(w)) for pos, w in enumerate([*before.split(), word, *behind.split()])]
    df = spark.createDataFrame(rows, "sent int, pos int, surface string").repartition(5)
    got = {(r.sent, r.pos): r for r in context.decide(df, ["sent"]).collect()}
    told = [got[k, len(c[1].split())] for k, c in enumerate(CASES)]
    assert [(r["class"], r.function, r.proof) for r in told] == [c[3:] for c in CASES]
    assert told[4].reason == "insufficient_context" and told[-1].embedded == "negative_particle" and told[0].embedded is None


def test_one_word_and_an_unknown_one(spark):
    assert context.resolve(spark, "مَتَى", before=("قَالَ",))["function"] == "interrogative_tool"
    with pytest.raises(ValueError, match="no decision table"):
        context.resolve(spark, "كِتَابٌ")


def test_pauses_are_no_neighbours_and_reach_is_bounded(spark):
    assert context.resolve(spark, "مَن", before=("قَالَ", "ۚ"))["function"] == "interrogative_tool"
    assert context.resolve(spark, "مَن", before=("قَالَ", "رَجُلٌ", "كَرِيمٌ"))["function"] == "interrogative_tool"
    assert context.resolve(spark, "مَن", before=("قَالَ", "رَجُلٌ", "كَرِيمٌ", "جِدًّا"))["function"] == "unresolved_ambiguous"


def test_only_certainty_replaces_a_class(spark):
    tokens = spark.createDataFrame([(0, 0, "قَالَ", "VERB", "Certificate"), (0, 1, "مَن", "REL", "Certificate"), (1, 0, "مَن", "REL", "Certificate"), (1, 1, "يَعْلَمُ", "VERB", "Hypothesis")], "sent int, pos int, surface string, class string, proof string")
    got = {(r.sent, r.pos): (r.resolved_class, r.resolved_proof, r.function, r.context_proof) for r in context.enriched(tokens, context.decide(tokens, ["sent"]), ["sent"]).collect()}
    assert got[0, 1] == ("ISM_MABNI", "Certificate", "interrogative_tool", "Certificate") and got[1, 0] == ("REL", "Certificate", "relative_pronoun", "Hypothesis")
    assert got[0, 0] == ("VERB", "Certificate", None, None)


def test_prohibition(spark):
    tokens = spark.createDataFrame([(0, 0, "لَا"), (0, 1, "يَكْتُبْ"), (1, 0, "لَا"), (1, 1, "رَجُلٌ")], "sent int, pos int, surface string")
    assert {(r.sent, r.pos) for r in context.features(tokens, ["sent"]).where("prohibits").collect()} == {(0, 0)}


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("word,nr,condition,class,function,proof,reason\nX,1,first,A,f,Certificate,r\nX,2,,B,g,Hypothesis,s\n", encoding="utf-8")
    (tmp_path / "t.csv").write_text("form,word\nlo,X\n", encoding="utf-8")
    rules = Rules(context_decisions=str(tmp_path / "d.csv"), context_targets=str(tmp_path / "t.csv"))
    assert [context.resolve(spark, "lo", b, rules=rules)["class"] for b in ((), ("a",))] == ["A", "B"]
    (tmp_path / "bad.csv").write_text("word,nr,condition,class,function,proof,reason\nX,1,raining,A,f,c,r\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no such features: raining"):
        context.resolve(spark, "lo", rules=Rules(context_decisions=str(tmp_path / "bad.csv")))
