"""References, later passes and conditions on sentences made for them."""

import pytest

from rulelens.operators import references

SCHEMA = "sent long, pos int, surface string, lemma string, class string, gcase string, definite boolean, gender string, number string"
DOC = 1 << 24


def table(spark, *sents):
    """Sentences given as (number, words); a word is (lemma, class, case, definite, gender, number), missing ones null."""
    rows = [(s, k, f"{w[0]}{k}", *w, *[None] * (6 - len(w))) for s, words in sents for k, w in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def noun(case="NOM", definite=True, gender="M", lemma="اسم"):
    return (lemma, "NOUN", case, definite, gender, "SG")


THIS, THAT, WHO, HE, YOU, ME = ("هذا", "DEM"), ("ذلك", "DEM"), ("الذي", "REL"), ("هو", "PRON", None, None, "M", "SG"), ("أنت", "PRON", None, None, "M", "SG"), ("أنا", "PRON", None, None, "M", "SG")
IF, SO, CALL, VERB = ("إذا", "PARTICLE"), ("ف", "CONJ"), ("يا", "PARTICLE"), ("كتب", "VERB")


def test_agreeing(spark):
    t = table(
        spark,
        (1, [noun(), THIS, noun()]), (2, [noun(), VERB, THAT]), (3, [noun(gender="F"), THIS]), (4, [noun(), noun(definite=False), WHO, noun()]),
        (5, [noun(), noun(), HE]), (6, [noun(definite=False), WHO]), (None, [noun(), THIS]),
    )
    got = {r.sent: (r.type, r.npos, r.target, r.score, r.candidates, r.kind) for r in references.agreeing(t, spark).collect()}
    assert got == {
        1: ("deixis", 0, "اسم0", 0.869565, 2, "Hypothesis"), 2: ("deixis", 0, "اسم0", 0.692308, 1, "Certificate"), 3: ("deixis", None, None, None, 0, "Zero"),
        4: ("relative", 0, "اسم0", 0.625, 1, "Certificate"), 5: ("detached", 1, "اسم1", 0.833333, 2, "Hypothesis"), 6: ("relative", None, None, None, 0, "Zero"),
    }


def test_addressed_and_bridged(spark):
    t = table(spark, (DOC, [YOU]), (DOC + 1, [CALL, noun()]), (DOC + 2, [VERB, YOU, ME]), (2 * DOC, [YOU]), (3 * DOC, [HE, VERB, noun(), noun()]), (3 * DOC + 1, [HE]))
    got = {(r.sent, r.pos): (r.type, r.target, r.nsent, r.npos, r.kind) for r in references.addressed(t).collect()}
    nobody = (None, None, None, "Zero")
    assert got == {
        (DOC, 0): ("addressee", *nobody), (DOC + 2, 1): ("addressee", "اسم1", DOC + 1, 1, "Certificate"), (DOC + 2, 2): ("speaker", *nobody), (2 * DOC, 0): ("addressee", *nobody),
    }
    assert [(r.sent, r.npos, r.kind) for r in references.bridged(t).collect()] == [(3 * DOC, 2, "Hypothesis")]


@pytest.mark.parametrize(
    ("words", "edges"),
    [
        ([("إن", "PARTICLE"), noun("ACC"), ("ص", "ADJ", "NOM", False)], {("inna_topic_of", 1, 0, "Certificate"), ("inna_comment_of", 2, 0, "Hypothesis")}),
        ([("كان", "VERB"), noun("NOM"), ("ص", "ADJ", "ACC", False)], {("kana_topic_of", 1, 0, "Certificate"), ("kana_comment_of", 2, 0, "Hypothesis")}),
        ([CALL, VERB, VERB, noun("GEN")], {("vocative_of", 3, 0, "Hypothesis")}),
        ([CALL, VERB, VERB, VERB, noun("GEN")], set()),
        ([VERB, noun("ACC", False), noun("ACC", False)], {("patient2_of", 2, 0, "Hypothesis")}),
        ([("ص", "ADJ", "NOM", True), ("ص", "ADJ", "NOM", True), ("ص", "ADJ", "ACC", True)], {("attribute_of", 1, 0, "Certificate")}),
        ([noun("NOM"), SO, noun("NOM", False)], {("coordinate_of", 2, 0, "Hypothesis")}),
        ([noun("NOM"), SO, noun("ACC", False)], set()),
        ([noun("NOM"), noun("NOM"), noun("GEN"), noun("GEN")], {("substitute_of", 1, 0, "Certificate")}),
        ([("لا", "PARTICLE"), VERB], {("negated_by", 0, 1, "Certificate")}),
        ([SO], set()),
    ],
)
def test_passes(spark, words, edges):
    got = references.passes(table(spark, (1, words), (None, words)))
    assert {(r.name, r.source, r.target, r.proof) for r in got.collect()} == edges
    assert all(r.distance == abs(r.source - r.target) for r in got.collect())


def test_conditions(spark):
    t = table(
        spark,
        (1, [IF, VERB, noun(), SO, VERB, VERB]), (2, [VERB, IF, VERB, VERB]), (3, [IF, SO, VERB]), (4, [IF, VERB, IF, VERB, SO, VERB]), (5, [VERB, SO, VERB]), (None, [IF, VERB, VERB]),
    )
    got = sorted((r.sent, r.tool, r.condition, r.answer, r.answer_text, r.kind) for r in references.conditions(t).collect())
    assert got == [
        (1, 0, 1, 4, "كتب1 → كتب4", "Certificate"), (2, 1, 2, 3, None, "Hypothesis"), (3, 0, None, 2, None, "Zero"),
        (4, 0, 1, None, None, "Zero"), (4, 2, 3, 5, "كتب3 → كتب5", "Certificate"),
    ]


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert references.agreeing(t, spark).unionByName(references.addressed(t)).unionByName(references.bridged(t)).count() == 0
    assert references.passes(t).count() == 0 and references.conditions(t).count() == 0
