"""Pages under topics and rules whose ranges overlap: coverage and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.operators.mining import is_heading, page_claims
from rulelens.plans.intervals import first_range, interval_join
from rulelens.plans.reading import spread, table
from rulelens.plans.scratch import save
from rulelens.sources.rules import Table

#: Lengths up to which a heading is of the first, and of the second level; any other is of the third.
LEVELS = (20, 40)
#: Examples by type: a pattern with the example as its group. Fixed values.
EXAMPLES = Table("example_rules", "type pattern", "string string", (("exclaimed", r"([^.!?|]+)!"), ("numbered", r"([0-9]+ [^.!?|]+)"), ("listed", r"\| ([^|]+) \|"), ("bracketed", r"\(([^()]{3,})\)"), ("quoted", r"«([^»]+)»")))
#: The same matches for an engine with lookbehind: a run that may be exclaimed is tried at its start only, not again at each of its letters.
AT_STARTS = {r"([^.!?|]+)!": r"(?<![^.!?|])([^.!?|]++)!"}
#: Pages behind a rule's page on which its examples may stand.
REACH = 2


def _matches(pattern: str) -> Column:
    """All matches of an example pattern on a page."""
    return F.regexp_extract_all("raw", F.lit(AT_STARTS.get(pattern, pattern)), F.lit(1))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, doc_id, page, raw): each line of a document is a page. Rows that share an id, or have none, stay apart by ``row``."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    return save(docs.select("row", "doc_id", F.posexplode("l").alias("page", "raw")), "coverage-pages")


def nested_topics(p: DataFrame) -> DataFrame:
    """Headings with levels; a topic ends on the page before the next heading of its level or a higher one, so topics overlap.

    Later headings are found by windows that run from the end, so no frame is read twice.
    """
    size = F.length(F.trim("raw"))
    level = F.when(size <= LEVELS[0], 1).when(size <= LEVELS[1], 2).otherwise(3)
    marked = p.select("row", "page", F.trim("raw").alias("title"), F.when(is_heading(F.col("raw")), level).alias("level"), F.max("page").over(Window.partitionBy("row")).alias("last"))
    back = Window.partitionBy("row").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.last(F.when(F.col("level") <= k, F.col("page")), ignorenulls=True).over(back) for k in (1, 2, 3)]
    marked = marked.select("*", *[n.alias(f"n{k}") for k, n in enumerate(nexts, 1)]).where("level is not null")
    after = F.when(F.col("level") == 1, F.col("n1")).when(F.col("level") == 2, F.col("n2")).otherwise(F.col("n3"))
    return marked.select("row", "title", "level", F.col("page").alias("start_page"), F.coalesce(after - 1, F.col("last")).alias("end_page"))


def j21_page_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the first topic that holds it, how many do, its claims and its status.

    Of the topics that hold a page the one that begins first counts. Status: blank, claims, topic_only, bare.
    """
    p = pages(spark, sf_dir)
    t = save(nested_topics(p), "coverage-topics")
    held = first_range(interval_join(p.select("row", "page"), t, ["row"], "page", "start_page", "end_page"), ["row", "page"], ["start_page"], ["title", "level", "start_page"])
    claimed = p.select("row", "doc_id", "page", F.trim("raw").alias("raw"), F.size(page_claims(F.col("raw"))).cast("long").alias("claims"))
    j = claimed.join(held, ["row", "page"], "left").withColumn("n_topics", F.coalesce("n_ranges", F.lit(0)))
    status = F.when(F.col("raw") == "", "blank").when(F.col("claims") > 0, "claims").when(F.col("n_topics") > 0, "topic_only").otherwise("bare")
    return j.select("doc_id", "page", F.md5("title").alias("title_md5"), F.col("level").cast("int").alias("level"), F.col("start_page").cast("int").alias("start_page"), "n_topics", "claims", status.alias("status"))


def j20_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of each rule: a page with a claim is a rule's first page, examples stand on it or on the next pages.

    Every match of every pattern on a page is an example of all rules whose range holds the page, with its place there.
    """
    p = pages(spark, sf_dir)
    types = F.array_distinct(F.transform(page_claims(F.col("raw")), lambda c: c["type"]))
    rules = save(p.select("row", "doc_id", F.col("page").alias("first_page"), (F.col("page") + REACH).alias("last_page"), F.explode(types).alias("rule")), "coverage-rules")
    as_row = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("type"), i.cast("int").alias("nth"), F.trim(x).alias("text"))
    found = [F.transform(_matches(pattern), as_row(kind)) for kind, pattern in EXAMPLES.rows]
    examples = p.select("row", "page", F.inline(F.concat(*found))).where("text <> ''")
    j = interval_join(examples, rules, ["row"], "page", "first_page", "last_page")
    return j.select("doc_id", "rule", "first_page", "page", "type", "nth", F.md5("text").alias("text_md5"))


def a11_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each table of the mined book has."""
    p = pages(spark, sf_dir)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    claims = p.select(F.explode(page_claims(F.col("raw"))).alias("c"))
    found = p.select(F.explode(F.concat(*[_matches(x) for _, x in EXAMPLES.rows])).alias("x")).where("trim(x) <> ''")
    return one("pages", p).unionByName(one("topics", nested_topics(p))).unionByName(one("claims", claims)).unionByName(one("examples", found))


_LINES = """numbered AS (SELECT row_number() OVER () AS row, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
pages_ AS (SELECT row, doc_id, source, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS page FROM numbered),
heads AS (SELECT row, page, trim(raw) AS title, CASE WHEN length(trim(raw)) <= 20 THEN 1 WHEN length(trim(raw)) <= 40 THEN 2 ELSE 3 END AS level FROM pages_ WHERE length(trim(raw)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(raw), '[.,;:!?]$')),
lasts AS (SELECT row, max(page) AS last FROM pages_ GROUP BY row),
nested AS (SELECT h.*, h.page AS start_page, coalesce((SELECT min(x.page) - 1 FROM heads x WHERE x.row = h.row AND x.page > h.page AND x.level <= h.level), last) AS end_page FROM heads h JOIN lasts USING (row))"""


def _claims_sql() -> str:
    from rulelens.operators.mining import CLAIMS

    return f"""{CLAIMS.sql()}, claimed AS (SELECT row, doc_id, page, type, generate_subscripts AS sent FROM (SELECT row, doc_id, page, unnest(l) AS s, generate_subscripts(l, 1) AS generate_subscripts FROM (SELECT row, doc_id, page, regexp_split_to_array(lower(raw), '[.!?]+ ?') AS l FROM pages_)) JOIN claim_rules ON regexp_matches(s, pattern) WHERE length(s) >= 10 GROUP BY ALL)"""


J21 = f"""WITH {_LINES}, {_claims_sql()}, c AS (SELECT row, page, count(*) AS claims FROM claimed GROUP BY ALL),
held AS (SELECT p.row, p.page, count(*) AS n_topics, arg_min(struct_pack(t := title, l := t.level, s := start_page), start_page) AS f FROM pages_ p JOIN nested t ON t.row = p.row AND p.page BETWEEN t.start_page AND t.end_page GROUP BY ALL)
SELECT p.doc_id, p.page::INT AS page, md5(f.t) AS title_md5, f.l::INT AS level, f.s::INT AS start_page, coalesce(n_topics, 0) AS n_topics, coalesce(claims, 0) AS claims,
  CASE WHEN trim(raw) = '' THEN 'blank' WHEN claims > 0 THEN 'claims' WHEN n_topics > 0 THEN 'topic_only' ELSE 'bare' END AS status FROM pages_ p LEFT JOIN held USING (row, page) LEFT JOIN c USING (row, page)"""
_FOUND = " UNION ALL ".join(f"SELECT row, page, '{kind}' AS type, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS nth FROM (SELECT row, page, regexp_extract_all(raw, '{pattern}', 1) AS l FROM pages_)" for kind, pattern in EXAMPLES.rows)
J20 = f"""WITH {_LINES}, {_claims_sql()}, rules AS (SELECT DISTINCT row, doc_id, page AS first_page, type AS rule FROM claimed), found AS ({_FOUND})
SELECT doc_id, rule, first_page::INT AS first_page, page::INT AS page, type, nth::INT AS nth, md5(trim(text)) AS text_md5 FROM found JOIN rules USING (row) WHERE page BETWEEN first_page AND first_page + {REACH} AND trim(text) <> ''"""
A11 = f"""WITH {_LINES}, {_claims_sql()}, found AS ({_FOUND}) SELECT 'pages' AS name, count(*) AS n FROM pages_ UNION ALL SELECT 'topics', count(*) FROM heads UNION ALL SELECT 'claims', count(*) FROM claimed UNION ALL SELECT 'examples', count(*) FROM found WHERE trim(text) <> ''"""

QUERIES = {"j21_page_topics": j21_page_topics, "j20_examples": j20_examples, "a11_table_counts": a11_table_counts}
ORACLE = {"j21_page_topics": J21, "j20_examples": J20, "a11_table_counts": A11}
