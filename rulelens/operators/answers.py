"""Answers read from a sentence's text: quantities and stated causes (D44, D49). Nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.operators.tokens import _SQL_TOKENS, documents, sentences, words_of
from rulelens.sources.rules import Table

NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "hundred", "thousand", "million", "dozen")
#: Words before a stated cause, and how much of the text from there on is the answer.
CAUSES = Table("causes", "marker", "string", (("because",), ("due to",), ("so that",), ("thanks to",), ("porque",), ("parce que",), ("weil",), ("denn",)))
EXCERPT = 50
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quantities(sents: DataFrame) -> DataFrame:
    """``sents`` (…, sentence) that name numbers: digits and number words in order, Certificate for a single one.

    Null and blank sentences name none; a number that comes twice is named twice.
    """
    named = F.filter(words_of(F.col("sentence")), lambda w: w.rlike("^[0-9]+$") | w.isin(*NUMBER_WORDS))
    rows = sents.withColumn("_named", named).where(F.size("_named") > 0)
    kind = F.when(F.size("_named") == 1, "Certificate").otherwise("Hypothesis")
    return rows.select(*[c for c in sents.columns if c != "sentence"], F.array_join("_named", " ").alias("answer"), F.size("_named").alias("n"), kind.alias("kind"))


def d44_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities(sentences(documents(spark, sf_dir).select("doc_id", "text")))


D44 = f"""WITH {_SQL_TOKENS}, q AS (SELECT doc_id, sent_idx, string_agg(token, ' ' ORDER BY pos) AS answer, count(*)::INT AS n FROM tokens
  WHERE regexp_matches(token, '^[0-9]+$') OR token IN ({", ".join(f"'{w}'" for w in NUMBER_WORDS)}) GROUP BY doc_id, sent_idx)
SELECT *, CASE n WHEN 1 THEN 'Certificate' ELSE 'Hypothesis' END AS kind FROM q"""


def causes(sents: DataFrame) -> DataFrame:
    """One row a sentence and marker of a cause: its first place and the text from there on.

    A-Z count as a-z, whole words are not asked for. A sentence without a marker gives no row.
    """
    folded = F.translate("sentence", _UPPER, _UPPER.lower())
    rows = sents.where(folded.rlike("|".join(m for (m,) in CAUSES.rows))).withColumn("_folded", folded)
    hits = F.filter(F.array(*[F.struct(F.lit(m).alias("marker"), F.instr("_folded", m).alias("place")) for (m,) in CAUSES.rows]), lambda h: h["place"] > 0)
    rows = rows.select(*sents.columns, F.inline(hits))
    excerpt = F.substring(F.col("sentence"), F.col("place"), F.length("marker") + EXCERPT)
    return rows.select(*[c for c in sents.columns if c != "sentence"], "marker", "place", excerpt.alias("answer"), F.lit("Certificate").alias("kind"))


def d49_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causes(sentences(documents(spark, sf_dir).select("doc_id", "text")))


D49 = f"""WITH {_SQL_TOKENS}, {CAUSES.sql()}, h AS (SELECT doc_id, sent_idx, sentence, marker, strpos(translate(sentence, '{_UPPER}', '{_UPPER.lower()}'), marker)::INT AS place FROM sents, causes)
SELECT doc_id, sent_idx, marker, place, substr(sentence, place, length(marker) + {EXCERPT}) AS answer, 'Certificate' AS kind FROM h WHERE place > 0"""

QUERIES = {"d44_quantities": d44_quantities, "d49_causes": d49_causes}
ORACLE = {"d44_quantities": D44, "d49_causes": D49}
