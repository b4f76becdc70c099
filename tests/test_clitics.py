"""Joined pronouns and joined "and" in stated sentences."""

from rulelens.functions.arabic import ordered
from rulelens.operators import clitics


def parsed(spark, *texts):
    return clitics.parsed(spark.createDataFrame([(k, pos, ordered(w)) for k, t in enumerate(texts) for pos, w in enumerate(t.split())], "sent int, pos int, surface string").repartition(3))


def test_pronouns(spark):
    t = parsed(spark, "كِتَابٌ نَصَرَهُ", "كِتَابٌ كَتَبَ قَلَمٌ خَرَجَ ۚ فَتَحَهَا", "نَصَرَهُ كِتَابٌ", "رَجُلٌ كَتَبْنَا", "قَلَمُهُمْ كِتَابُهُمْ")
    got = {(r.sent, r.pos): (r.pronoun, r.person, r.noun, r.noun_pos, r.proof) for r in clitics.joined_pronouns(t, ["sent"]).collect()}
    assert got == {
        (0, 1): ("ه", "3", "كِتَابٌ", 0, "Certificate"), (1, 5): ("ها", "3", "قَلَمٌ", 2, "Hypothesis"), (2, 0): ("ه", "3", None, None, "Zero"), (3, 1): ("نا", "1", None, None, "Zero"),
        (4, 0): ("هم", "3", None, None, "Zero"), (4, 1): ("هم", "3", "قَلَمُهُمْ", 0, "Certificate"),
    }


def test_waws(spark):
    t = parsed(spark, "وَكَتَبَ", "وَالْقَلَمِ كَتَبَ", "كَتَبَ وَخَرَجَ", "كَتَبَ وَالْقَلَمَ", "كَتَبَ وَالْقَلَمُ", "وَجَدَ", "كِتَابٌ وَقَلَمُهُمْ")
    got = {(r.sent, r.pos): (r.reading, r.proof) for r in clitics.waws(t, ["sent"]).collect()}
    assert got == {
        (0, 0): ("resumption", "Hypothesis"), (1, 0): ("oath", "Hypothesis"), (2, 1): ("conjunction", "Certificate"), (3, 1): ("accompaniment", "Hypothesis"), (4, 1): ("conjunction", "Hypothesis"), (6, 1): ("conjunction", "Certificate"),
    }


def test_empty(spark):
    t = parsed(spark, "كَتَبَ")
    assert clitics.waws(t.where("false"), ["sent"]).count() == 0 and clitics.joined_pronouns(t.where("false"), ["sent"]).count() == 0
