"""Lookups in the knowledge base by word, and cards of what is known of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.functions.scalars import MATCH_CONFIDENCE, match_confidence
from rulelens.operators.gates import _CLAIMED, certified_claims, word_claims
from rulelens.operators.segmenter import segments
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL, read_words
from rulelens.sources.rules import Rules, Table

#: Constructions by what they begin with: the whole word, a beginning, or a beginning with a joined pronoun. Fixed values.
CONSTRUCTIONS = Table("constructions_by_word", "construction lead way", "string string string", (
    ("EXCEPTION_ILLA", "إلا", "exact"), ("CONDITION_IDHA", "إذا", "exact"), ("EMPHASIS_INNA", "إن", "exact"), ("EMPHASIS_INNA", "إن", "pronoun"), ("WISH_LAYTA", "ليت", "pronoun"), ("HOPE_LAALLA", "لعل", "pronoun"), ("FUTURE_SA", "سي", "prefix"), ("COMMAND_LI", "ولي", "prefix"), ("COMMAND_LI", "فلي", "prefix"), ("PARTITION_MIN", "من", "exact"), ("PARTITION_MIN", "من", "pronoun"), ("PLACE_FI", "في", "exact"), ("RELATION_ALA", "على", "exact"), ("SEEKING_IST", "است", "prefix"), ("SEEKING_IST", "يست", "prefix"),
))
#: Joined pronouns that may follow a beginning. Fixed values.
PRONOUN_LETTERS = ("ه", "ها", "هم", "هن", "هما", "ك", "كم", "كن", "كما", "ي", "ني", "نا")
EXAMPLES_OF_A_CARD = 8


def constructions(words: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(word, construction, way) of each distinct ``word``: by its letters as a whole, by how they begin, or by a beginning and a pronoun.

    Beginnings are looked up by equality: each word asks with its first two to five letters, so no word meets every rule.
    """
    r = (rules or Rules()).frame(words.sparkSession, CONSTRUCTIONS)
    w = words.select("word").where("word <> ''").distinct().withColumn("plain", ar.strip_all(F.col("word")))
    exact = w.join(F.broadcast(r.where("way = 'exact'")), F.col("plain") == F.col("lead")).select("word", "construction", "way")
    asked = w.withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(5)))).where(F.length("plain") > F.col("n")).select("word", F.expr("left(plain, n)").alias("lead"), F.expr("substr(plain, n + 1)").alias("rest"))
    begun = asked.join(F.broadcast(r.where("way <> 'exact'")), "lead").where((F.col("way") == "prefix") | F.col("rest").isin(*PRONOUN_LETTERS))
    return exact.unionByName(begun.select("word", "construction", "way")).distinct()


def best_claims(claims: DataFrame) -> DataFrame:
    """(word, meaning, topic, certified, confidence, claims): each word's best claim, a certified one first, then the surest, then by meaning."""
    sure = F.round(match_confidence(F.col("way"), F.when(F.col("certified"), 0.95).otherwise(0.4)), 6)
    order = F.struct((~F.col("certified")).alias("a"), (-sure).alias("b"), "meaning", "topic")
    return claims.groupBy("word").agg(F.min_by(F.struct("meaning", "topic", "certified", sure.alias("confidence")), order).alias("best"), F.count("*").alias("claims")).select("word", "best.*", "claims")


def cards(words: DataFrame, claims: DataFrame) -> DataFrame:
    """One card a topic: its operators, its eight commonest words, how many words and claims, how many certified.

    ``words`` has a row for each use of a word. Examples are ranked before they are gathered, so a card gathers eight.
    """
    used = words.groupBy("word").agg(F.count("*").alias("times"))
    each = checked_join(claims.select("word", "topic", "operator", "certified").distinct(), save(used, "card-words"), ["word"], "inner")
    stats = each.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("operator")), "|").alias("triggers"), F.count_distinct("word").alias("words"), F.sum("times").alias("uses"), F.sum(F.when(F.col("certified"), F.col("times")).otherwise(0)).alias("certified"))
    per = each.groupBy("topic", "word").agg(F.max("times").alias("times"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("times"), "word"))).where(F.col("rank") <= EXAMPLES_OF_A_CARD)
    examples = ranked.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("examples"))
    return stats.join(examples, "topic")


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = save(read_words(spark, sf_dir).select("id", "word"), "knowledge-words")
    return w, save(certified_claims(word_claims(w), segments(w)), "knowledge-claims")


def j08_constructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read_words(spark, sf_dir).select("id", "word")
    return w.join(save(constructions(w), "knowledge-constructions"), "word").select("id", "construction", "way")


def l05_best_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c = _claims(spark, sf_dir)
    return checked_join(w, save(best_claims(c), "knowledge-best"), ["word"], "inner").drop("word")


def a06_topic_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c = _claims(spark, sf_dir)
    return cards(w, c)


_R = f"(WITH {READINGS_SQL} SELECT id, word FROM read_words)"
_P = f"regexp_replace(word, '[{ar.ALL_MARKS}]', '', 'g')"
J08 = f"""WITH {CONSTRUCTIONS.sql()}, w AS (SELECT DISTINCT word, {_P} AS plain FROM {_R} WHERE word <> ''),
m AS (SELECT DISTINCT word, construction, way FROM w JOIN constructions_by_word c ON way = 'exact' AND plain = lead OR way = 'prefix' AND starts_with(plain, lead) AND length(plain) > length(lead) OR way = 'pronoun' AND starts_with(plain, lead) AND substr(plain, length(lead) + 1) IN {PRONOUN_LETTERS})
SELECT id, construction, way FROM {_R} r JOIN m USING (word)"""
_WAYS = "CASE WHEN place IN ('start', 'end') THEN 'prefix' WHEN form = word THEN 'exact' ELSE 'stripped' END"
_TOLD = _CLAIMED.replace("SELECT s.word, operator, s.topic, meaning, CASE WHEN s.topic IN", f"SELECT s.word, operator, s.topic, meaning, {_WAYS.replace('word', 's.word')} AS way, CASE WHEN s.topic IN")
_SURE = "CASE way " + " ".join(f"WHEN '{k}' THEN least({v}::DOUBLE, CASE WHEN reason IS NULL THEN 0.95::DOUBLE ELSE 0.4::DOUBLE END)" for k, v in MATCH_CONFIDENCE.items()) + " END"
L05 = f"""WITH {_TOLD}, b AS (SELECT word, meaning, topic, reason IS NULL AS certified, round({_SURE}, 6) AS confidence, count(*) OVER (PARTITION BY word) AS claims FROM told QUALIFY row_number() OVER (PARTITION BY word ORDER BY reason IS NOT NULL, -({_SURE}), meaning, topic) = 1) SELECT r.id, b.* EXCLUDE (word) FROM {_R} r JOIN b USING (word)"""
A06 = f"""WITH {_TOLD}, used AS (SELECT word, count(*) AS times FROM {_R} GROUP BY word), e AS (SELECT DISTINCT t.word, topic, operator, reason IS NULL AS certified, times FROM told t JOIN used u USING (word)),
x AS (SELECT topic, string_agg(word, ' ' ORDER BY times DESC, word) AS examples FROM (SELECT DISTINCT topic, word, times FROM e QUALIFY dense_rank() OVER (PARTITION BY topic ORDER BY times DESC, word) <= {EXAMPLES_OF_A_CARD}) GROUP BY topic)
SELECT topic, string_agg(DISTINCT operator, '|' ORDER BY operator) AS triggers, count(DISTINCT word) AS words, sum(times)::BIGINT AS uses, coalesce(sum(times) FILTER (certified), 0)::BIGINT AS certified, any_value(examples) AS examples FROM e JOIN x USING (topic) GROUP BY topic"""

QUERIES = {"j08_constructions": j08_constructions, "l05_best_claims": l05_best_claims, "a06_topic_cards": a06_topic_cards}
ORACLE = {"j08_constructions": J08, "l05_best_claims": L05, "a06_topic_cards": A06}
