"""What joined letters refer to and join.

A joined pronoun refers to the nearest noun before it; a joined "and" is read by what stands on its two sides. Words are cut
and classed once a distinct word; the rest are windows over one dealing of the tokens by sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.morphology import M13_SQL, classes
from rulelens.operators.segmenter import G11, segments
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL
from rulelens.sources.rules import Rules, Table
from rulelens.sources.sequences import PAUSE, SEQUENCES_SQL, read_sentences

#: Person, gender and number of joined pronouns by their letters. Fixed values.
PRONOUNS = Table("joined_pronouns", "letters person gender number", "string string string string", (
    ("ه", "3", "M", "SG"), ("ها", "3", "F", "SG"), ("هم", "3", "M", "PL"), ("هن", "3", "F", "PL"), ("هما", "3", "C", "DU"), ("ك", "2", "M", "SG"), ("كم", "2", "M", "PL"), ("كما", "2", "C", "DU"), ("ي", "1", "C", "SG"), ("ني", "1", "C", "SG"), ("نا", "1", "C", "PL"),
))


def parsed(tokens: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``tokens`` (with surface) with class, conj, pronoun, stem and tags of their words; pauses are gone."""
    words = tokens.select(F.col("surface").alias("word")).where(F.col("word") != PAUSE)
    parts = segments(words, rules).select(F.col("word").alias("surface"), "conj", "pronoun", "stem", "tags")
    told = classes(words, rules).select(F.col("word").alias("surface"), "class")
    return checked_join(tokens, save(parts.join(told, "surface"), "clitic-words"), ["surface"], "inner")


def joined_pronouns(t: DataFrame, keys: list[str], rules: Rules | None = None) -> DataFrame:
    """``keys``, pos, surface, pronoun, person, gender, number, noun, noun_pos, proof of each joined pronoun.

    The noun is the nearest one before; the word that carries the pronoun isn't its own noun. Only third persons refer to
    nouns: others are Zero, as is one without a noun before it; a noun next to it is certain, any other a hypothesis.
    """
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    noun = F.last(F.when(F.col("class").isin("NOUN", "ADJ"), F.struct("pos", "surface")), True).over(before)
    t = t.withColumn("_noun", noun).where("pronoun <> ''").withColumn("letters", ar.strip_all(F.col("pronoun")))
    t = t.join(F.broadcast((rules or Rules()).frame(t.sparkSession, PRONOUNS)), "letters", "left")
    refers = F.when(F.col("person") == "3", F.col("_noun"))
    proof = F.when(refers.isNull(), "Zero").when(F.col("pos") - refers["pos"] == 1, "Certificate").otherwise("Hypothesis")
    return t.select(*keys, "pos", "surface", F.col("letters").alias("pronoun"), "person", "gender", "number", refers["surface"].alias("noun"), refers["pos"].alias("noun_pos"), proof.alias("proof"))


def waws(t: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, pos, surface, reading, proof of each joined "and" (W16).

    At a sentence's start it resumes; before a genitive noun there it swears. Elsewhere it joins: surely where both sides
    are of one class, as far as is known otherwise; between a verb and an accusative noun it may accompany.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    t = t.withColumn("_prev", F.lag("class").over(order)).where("conj = 'وَ'")
    noun = F.col("class").isin("NOUN", "ADJ")
    first = F.col("_prev").isNull()
    reading = (
        F.when(first & noun & F.col("stem").rlike("ِ$"), "oath").when(first, "resumption").when(F.col("class") == F.col("_prev"), "conjunction")
        .when((F.col("_prev") == "VERB") & noun & F.col("stem").rlike("َ$"), "accompaniment").otherwise("conjunction")
    )
    return t.select(*keys, "pos", "surface", reading.alias("reading"), F.when(~first & (F.col("class") == F.col("_prev")), "Certificate").otherwise("Hypothesis").alias("proof"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return save(parsed(read_sentences(spark, sf_dir)), "clitic-tokens")


def j16_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_pronouns(_parsed(spark, sf_dir), ["row", "doc_id", "sent"]).drop("row")


def w16_waws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waws(_parsed(spark, sf_dir), ["row", "doc_id", "sent"]).drop("row")


_TOKENS = f"""{SEQUENCES_SQL}, {PRONOUNS.sql()}, cut_words AS (SELECT DISTINCT r.word, g.conj, g.pronoun, g.stem, c.class FROM (WITH {READINGS_SQL} SELECT id, word FROM read_words) r JOIN ({G11}) g USING (id) JOIN ({M13_SQL}) c USING (id)),
cut_tokens AS (SELECT s.*, w.conj, w.pronoun, w.stem, w.class FROM seqs s JOIN cut_words w ON w.word = s.surface WHERE s.surface <> '{PAUSE}')"""
J16 = f"""WITH {_TOKENS}, seen AS (SELECT *, last_value(CASE WHEN class IN ('NOUN', 'ADJ') THEN pos END IGNORE NULLS) OVER (PARTITION BY row, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS npos FROM cut_tokens),
held AS (SELECT s.*, p.*, CASE WHEN p.person = '3' THEN npos END AS noun_pos FROM seen s LEFT JOIN joined_pronouns p ON p.letters = regexp_replace(s.pronoun, '[{ar.ALL_MARKS}]', '', 'g') WHERE s.pronoun <> '')
SELECT h.doc_id, h.sent, h.pos, h.surface, regexp_replace(h.pronoun, '[{ar.ALL_MARKS}]', '', 'g') AS pronoun, person, gender, number, n.surface AS noun, h.noun_pos, CASE WHEN h.noun_pos IS NULL THEN 'Zero' WHEN h.pos - h.noun_pos = 1 THEN 'Certificate' ELSE 'Hypothesis' END AS proof
FROM held h LEFT JOIN cut_tokens n ON n.row = h.row AND n.sent = h.sent AND n.pos = h.noun_pos"""
W16 = f"""WITH {_TOKENS}, seen AS (SELECT *, lag(class) OVER (PARTITION BY row, sent ORDER BY pos) AS prev FROM cut_tokens)
SELECT doc_id, sent, pos, surface, CASE WHEN prev IS NULL AND class IN ('NOUN', 'ADJ') AND regexp_matches(stem, 'ِ$') THEN 'oath' WHEN prev IS NULL THEN 'resumption' WHEN class = prev THEN 'conjunction' WHEN prev = 'VERB' AND class IN ('NOUN', 'ADJ') AND regexp_matches(stem, 'َ$') THEN 'accompaniment' ELSE 'conjunction' END AS reading,
  CASE WHEN class = prev THEN 'Certificate' ELSE 'Hypothesis' END AS proof FROM seen WHERE conj = 'وَ'"""

QUERIES = {"j16_pronouns": j16_pronouns, "w16_waws": w16_waws}
ORACLE = {"j16_pronouns": J16, "w16_waws": W16}
