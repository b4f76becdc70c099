"""Constructions by word, best claims and cards on stated rows."""

from rulelens.functions.arabic import ordered
from rulelens.operators import knowledge


def test_constructions(spark):
    stated = {"إِذَا": {"CONDITION_IDHA"}, "إِنَّهُ": {"EMPHASIS_INNA"}, "إِنَّ": {"EMPHASIS_INNA"}, "لَعَلَّهُمْ": {"HOPE_LAALLA"}, "سَيَكْتُبُ": {"FUTURE_SA"}, "وَلْيَكْتُبْ": {"COMMAND_LI"}, "مِنْهُمْ": {"PARTITION_MIN"}, "مِنْبَرٌ": set(), "اسْتَغْفَرَ": {"SEEKING_IST"}, "كِتَابٌ": set(), "لَيْتَ": set(), "": set()}
    df = spark.createDataFrame([(ordered(w),) for w in [*stated, "إِذَا"]] + [(None,)], "word string")
    got = {}
    for r in knowledge.constructions(df).collect():
        got.setdefault(r.word, []).append(r.construction)
    assert {w: got.get(ordered(w), []) for w in stated} == {w: sorted(c) for w, c in stated.items()}


def claims(spark, rows):
    return spark.createDataFrame(rows, "word string, operator string, topic string, meaning string, way string, certified boolean")


def test_best_claims(spark):
    c = claims(spark, [("w", "a", "T", "M1", "exact", False), ("w", "a", "T", "M2", "stripped", True), ("w", "b", "U", "M3", "prefix", True), ("v", "a", "T", "M9", "exact", True), ("v", "a", "T", "M8", "exact", True), ("u", "a", "T", "M1", "exact", False)])
    got = {r.word: (r.meaning, r.certified, r.confidence, r.claims) for r in knowledge.best_claims(c).collect()}
    assert got == {"w": ("M3", True, 0.9, 3), "v": ("M8", True, 0.95, 2), "u": ("M1", False, 0.4, 1)}


def test_cards(spark):
    words = spark.createDataFrame([(f"w{k:02d}",) for k in range(12) for _ in range(12 - k)], "word string")
    c = claims(spark, [(f"w{k:02d}", "ab"[k % 2], "T", "M", "exact", k < 3) for k in range(12)] + [("w00", "a", "T", "other meaning", "exact", True), ("w01", "z", "U", "M", "exact", True), ("unused", "z", "U", "M", "exact", True)])
    got = {r.topic: r for r in knowledge.cards(words, c).collect()}
    t, u = got["T"], got["U"]
    assert (t.triggers, t.words, t.uses, t.certified) == ("a|b", 12, 78, 12 + 11 + 10) and t.examples.split() == [f"w{k:02d}" for k in range(8)]
    assert (u.triggers, u.words, u.uses, u.examples) == ("z", 1, 11, "w01")
    assert knowledge.cards(words, c.where("false")).count() == 0
