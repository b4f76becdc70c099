"""Mining of long documents into topics, claims and cards, with coverage and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions.arrays import let
from rulelens.plans.reading import spread, table
from rulelens.sources.rules import Table

#: Claim patterns by type: a sentence gives one claim a type, by the first pattern in order. Plain enough for any engine.
CLAIMS = Table("claim_rules", "rule type pattern confidence focus", "int string string double string", (
    (1, "definition", "(^| )is (a|the) ", 0.8, "is"), (2, "definition", "(^| )est (un|la|le) ", 0.8, "est"), (3, "negation", "(^| )(not|nicht|pas|no) ", 0.75, "not"), (4, "condition", "(^| )(if|se|si) ", 0.7, "if"),
    (5, "purpose", "(^| )(for|pour|para|für) ", 0.7, "for"), (6, "relation", "(^| )of the ", 0.6, "of"), (7, "relation", "(^| )(de la|von der) ", 0.6, "of"),
))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parts of pages: each line of a document is a page of its source."""
    docs = spread(table(spark, sf_dir, "documents")).select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("page", "raw"))


_PAGES = "pages_ AS (SELECT source, doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS page FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def is_heading(raw: Column) -> Column:
    line = F.trim(raw)
    return (F.length(line) > 0) & (F.length(line) <= 60) & ~line.rlike("[.,;:!?]$")


def topics(pages: DataFrame) -> DataFrame:
    """Headings: short lines without end punctuation; a topic ends on the page before the next one."""
    line = F.trim("raw")
    heads = pages.where(is_heading(F.col("raw"))).select("source", "doc_id", F.col("page").alias("start_page"), line.alias("title"))
    after = F.lead("start_page").over(Window.partitionBy("source", "doc_id").orderBy("start_page"))
    return heads.withColumn("end_page", F.coalesce(after - 1, F.col("start_page")))


def b03_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(chunks(spark, sf_dir))


_TOPICS = "topics AS (SELECT source, doc_id, page AS start_page, trim(raw) AS title, coalesce(lead(page) OVER (PARTITION BY source, doc_id ORDER BY page) - 1, page) AS end_page FROM pages_ WHERE length(trim(raw)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(raw), '[.,;:!?]$'))"
B03 = f"WITH {_PAGES}, {_TOPICS} SELECT * FROM topics"


def page_claims(raw: Column) -> Column:
    """Claims (sent, type, rule, focus, text, confidence) of a page, one a sentence and type, by the first pattern in order.

    The patterns are literals of one expression, compiled once; no join compares sentences with rules.
    """

    def in_sentence(s: Column, i: Column) -> Column:
        sure = lambda c: F.least(F.lit(0.95), F.lit(c) + F.when(F.length(s) > 120, 0.05).otherwise(0.0)) - F.when(F.length(s) < 30, 0.15).otherwise(0.0)
        made = []
        for kind in dict.fromkeys(r[1] for r in CLAIMS.rows):
            best = F.lit(None).cast("struct<sent:int,type:string,rule:int,focus:string,text:string,confidence:double>")
            for rule, _, pattern, confidence, focus in sorted((r for r in CLAIMS.rows if r[1] == kind), reverse=True):
                claim = F.struct(i.alias("sent"), F.lit(kind).alias("type"), F.lit(rule).alias("rule"), F.lit(focus).alias("focus"), s.alias("text"), F.round(F.greatest(F.lit(0.05), sure(confidence)), 4).alias("confidence"))
                best = F.when(s.rlike(pattern), claim).otherwise(best)
            made.append(best)
        return F.when(F.length(s) >= 10, F.array_compact(F.array(*made))).otherwise(F.array().cast("array<struct<sent:int,type:string,rule:int,focus:string,text:string,confidence:double>>"))

    return F.flatten(F.transform(F.split(F.lower(raw), r"[.!?]+ ?"), in_sentence))


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per sentence and type, with confidence by length and focus (B7, G42, arithmetic of confidences)."""
    return chunks(spark, sf_dir).select("source", "doc_id", "page", F.inline(page_claims(F.col("raw"))))


_CLAIMS = rf"""{CLAIMS.sql()}, s AS (SELECT source, doc_id, page, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent FROM (SELECT source, doc_id, page, regexp_split_to_array(lower(raw), '[.!?]+ ?') AS l FROM pages_)),
x AS (SELECT source, doc_id, page, sent, type, s, rule, focus, c.confidence AS c FROM s JOIN claim_rules c ON regexp_matches(s, pattern) WHERE length(s) >= 10 QUALIFY row_number() OVER (PARTITION BY source, doc_id, page, sent, type ORDER BY rule) = 1),
claims AS (SELECT source, doc_id, page, sent, type, rule, focus, s AS text, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, c + CASE WHEN length(s) > 120 THEN 0.05::DOUBLE ELSE 0 END) - CASE WHEN length(s) < 30 THEN 0.15::DOUBLE ELSE 0 END), 4) AS confidence FROM x)"""


def b07_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_rows(spark, sf_dir).withColumn("text", F.md5("text"))


B07 = f"WITH {_PAGES}, {_CLAIMS} SELECT * REPLACE (md5(text) AS text) FROM claims"


def b08_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims clustered to cards by source, type and focus: counts, confidences, page range, the three longest texts.

    Texts are ranked per card before they are gathered, so a card of any size gathers three.
    """
    c = claim_rows(spark, sf_dir)
    key = ["source", "type", "focus"]
    stats = c.groupBy(*key).agg(F.count("*").alias("n"), F.max("confidence").alias("best"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count_distinct("doc_id").alias("docs"))
    texts = c.select(*key, "text").distinct()
    longest = Window.partitionBy(*key).orderBy(F.desc(F.length("text")), "text")
    top = texts.withColumn("rank", F.row_number().over(longest)).where("rank <= 3").groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " — ").alias("summary"))
    return stats.join(top, key).withColumn("summary", F.md5("summary"))


B08 = f"WITH {_PAGES}, {_CLAIMS}, st AS (SELECT source, type, focus, count(*) AS n, max(confidence) AS best, round(avg(confidence), 6) AS mean, min(page) AS first_page, max(page) AS last_page, count(DISTINCT doc_id) AS docs FROM claims GROUP BY ALL), t AS (SELECT DISTINCT source, type, focus, text FROM claims), r AS (SELECT *, row_number() OVER (PARTITION BY source, type, focus ORDER BY length(text) DESC, text) AS rank FROM t), sm AS (SELECT source, type, focus, md5(string_agg(text, ' — ' ORDER BY rank)) AS summary FROM r WHERE rank <= 3 GROUP BY ALL) SELECT * FROM st JOIN sm USING (source, type, focus)"


def b11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each page: claims, in a topic's range, blank or bare; the review queue's reasons follow.

    A document's pages are read once and stay in its row. Ranges of its topics don't overlap, so the last heading at or
    before a page is the only one whose range can hold it.
    """
    docs = spread(table(spark, sf_dir, "documents")).select("source", F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"))

    def described(pages: Column) -> Column:
        heads = F.filter(F.transform(pages, lambda raw, i: F.when(is_heading(raw), i)), lambda i: i.isNotNull())

        def of(hs: Column) -> Column:
            def page(raw: Column, i: Column) -> Column:
                began = F.array_max(F.filter(hs, lambda h: h <= i))
                after = F.array_min(F.filter(hs, lambda h: h > i))
                inside = F.coalesce(i <= F.coalesce(after - 1, began), F.lit(False)) & began.isNotNull()
                claims = page_claims(raw)
                told = let(claims, lambda c: F.struct(F.size(c).cast("long").alias("claims"), F.array_min(F.transform(c, lambda x: x["confidence"])).alias("least")))
                return F.struct((F.trim(raw) == "").alias("blank"), inside.alias("inside"), told.alias("told"))

            return F.transform(pages, page)

        return let(heads, of)

    p = docs.select("source", F.inline(let(F.col("pages"), described))).select("source", "blank", "inside", "told.*")
    status = F.when(F.col("blank"), "blank").when(F.col("claims") > 0, "claims").when(F.col("inside"), "topic_only").otherwise("bare")
    reason = F.when((status == "topic_only"), "topic without claims").when(F.col("least") < 0.6, "low confidence")
    return p.select("source", status.alias("status"), F.coalesce(reason, F.lit("-")).alias("reason"), "claims").groupBy("source", "status", "reason").agg(F.count("*").alias("pages"), F.sum("claims").alias("claims"))


B11 = f"WITH {_PAGES}, {_TOPICS}, {_CLAIMS}, c AS (SELECT doc_id, page, count(*) AS claims, min(confidence) AS least FROM claims GROUP BY ALL), p AS (SELECT g.source, trim(raw) AS raw, coalesce(c.claims, 0) AS claims, least, EXISTS (SELECT 1 FROM topics t WHERE t.doc_id = g.doc_id AND g.page BETWEEN t.start_page AND t.end_page) AS inside FROM pages_ g LEFT JOIN c USING (doc_id, page)), sp AS (SELECT *, CASE WHEN raw = '' THEN 'blank' WHEN claims > 0 THEN 'claims' WHEN inside THEN 'topic_only' ELSE 'bare' END AS status FROM p) SELECT source, status, CASE WHEN status = 'topic_only' THEN 'topic without claims' WHEN least < 0.6 THEN 'low confidence' ELSE '-' END AS reason, count(*) AS pages, sum(claims)::BIGINT AS claims FROM sp GROUP BY ALL"


def b14_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that hold a search word in type, focus or topic titles."""
    t = topics(chunks(spark, sf_dir)).where(F.lower("title").contains("the")).groupBy("source").agg(F.count("*").alias("titles"))
    c = claim_rows(spark, sf_dir).where(F.col("text").contains("the")).groupBy("source", "type").agg(F.count("*").alias("claims"))
    return c.join(t, "source", "left").withColumn("titles", F.coalesce("titles", F.lit(0)))


B14 = f"WITH {_PAGES}, {_TOPICS}, {_CLAIMS}, t AS (SELECT source, count(*) AS titles FROM topics WHERE contains(lower(title), 'the') GROUP BY source), c AS (SELECT source, type, count(*) AS claims FROM claims WHERE contains(text, 'the') GROUP BY ALL) SELECT c.*, coalesce(titles, 0) AS titles FROM c LEFT JOIN t USING (source)"

QUERIES = {"b03_topics": b03_topics, "b07_claims": b07_claims, "b08_cards": b08_cards, "b11_page_coverage": b11_coverage, "b14_card_search": b14_search}
ORACLE = {"b03_topics": B03, "b07_claims": B07, "b08_cards": B08, "b11_page_coverage": B11, "b14_card_search": B14}
