"""Clauses of stated sentences with acts, negations, modals and relations."""

from pyspark.sql import functions as F

from rulelens.operators import discourse


def told(spark, *rows):
    df = spark.createDataFrame([(k, lang, text.split()) for k, (lang, text) in enumerate(rows)], "k int, lang string, toks array<string>")
    out = df.select("k", F.inline(discourse.described(F.col("toks"), F.col("lang")))).orderBy("k", "clause").collect()
    return [(r.k, r.type, r.act, r.negated, r.modal, r.relation, r.end - r.start + 1) for r in out]


def test_clauses_and_relations(spark):
    got = told(spark, ("en", "he must go and she may not stay if it rains"), ("en", "who came or not"), ("fr", "il dit que non et il part"), ("en", ""), (None, "and not"), ("de", "nicht"))
    assert got == [
        (0, "main", "wish", False, "necessity", None, 3), (0, "coordinate", "wish", True, "possibility", "contrasts", 5), (0, "condition", "statement", False, None, "condition_of", 3),
        (1, "main", "question", False, None, None, 2), (1, "coordinate", "statement", True, None, "contrasts", 2),
        (2, "main", "statement", False, None, None, 2), (2, "complement", "statement", True, None, "content_of", 2), (2, "coordinate", "statement", False, None, "contrasts", 3),
        (4, "main", "statement", False, None, None, 2), (5, "main", "statement", True, None, None, 1),
    ]
