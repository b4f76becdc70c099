"""References beyond third-person agreement, passes after the relation walk, and conditions.

All windows are within a sentence, but for addressees, which are carried along a document by rows of vocatives and
pronouns only. Sentences without a number (documents without an id) have no references and no relations here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from rulelens.sources.analysed import TOKS_SQL, sentences
from rulelens.sources.rules import Table

#: Words that refer to nouns: what the noun agrees with, how fast a score falls with distance, and its scale.
REFERENTS = Table(
    "referents", "r_lemma r_type r_gender r_number step scale", "string string string string double double",
    (
        ("هذا", "deixis", "M", "SG", 0.15, 1.0), ("هذه", "deixis", "F", "SG", 0.15, 1.0), ("ذلك", "deixis", "M", "SG", 0.15, 0.9), ("تلك", "deixis", "F", "SG", 0.15, 0.9),
        ("الذي", "relative", "M", "SG", 0.3, 1.0), ("التي", "relative", "F", "SG", 0.3, 1.0),
        ("هو", "detached", "M", "SG", 0.2, 1.0), ("هي", "detached", "F", "SG", 0.2, 1.0), ("هم", "detached", "M", "PL", 0.2, 1.0),
    ),
)
#: Pronouns of the one who speaks and the one spoken to.
FIRST, SECOND = ("أنا", "نحن"), ("أنت", "أنتم")
#: A clear margin over the next candidate.
MARGIN = 0.3
#: Passes look so many tokens ahead.
AHEAD, NEAR = 5, 3


def _nearest(t: DataFrame, holds: Column, order: WindowSpec, name: str) -> DataFrame:
    """Adds the last row in ``order`` before each row that ``holds``, the place of the one before that, and their number."""
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_second", F.last(F.when(holds, F.col("pos")), True).over(past))
    found = F.when(holds, F.struct(F.col("pos").alias("npos"), F.col("surface").alias("target"), F.col("_second").alias("second")))
    return t.withColumns({name: F.last(found, True).over(past), f"{name}_n": F.count(F.when(holds, 1)).over(past)})


def agreeing(toks: DataFrame, spark: SparkSession) -> DataFrame:
    """Demonstratives (nouns on both sides), relatives (earlier definite nouns) and third persons (earlier nouns).

    The nearest noun that agrees is the target, of two as near the earlier one; Certificate only for a single
    candidate or a clear margin, Zero without one.
    """
    told = F.broadcast(REFERENTS.frame(spark))
    t = toks.where("sent is not null and class in ('NOUN', 'DEM', 'REL', 'PRON')")
    t = t.join(told, (F.col("lemma") == F.col("r_lemma")) & (F.col("class") != "NOUN"), "left").where("class = 'NOUN' or r_type is not null")
    t = t.select("sent", "pos", "surface", "class", "definite", "r_type", "step", "scale", F.coalesce("r_gender", "gender").alias("g"), F.coalesce("r_number", "number").alias("n"))
    place, noun = Window.partitionBy("sent", "g", "n"), F.col("class") == "NOUN"
    t = _nearest(t, noun, place.orderBy("pos"), "b")
    t = _nearest(t, noun & F.col("definite"), place.orderBy("pos"), "d")
    t = _nearest(t, noun, place.orderBy(F.desc("pos")), "a").where("r_type is not null")
    both = lambda x: [F.col(f"{x}.npos"), F.col(f"{x}.second")]
    kind = F.col("r_type")
    places = F.when(kind == "relative", F.array(*both("d"))).when(kind == "deixis", F.array(*both("b"), *both("a"))).otherwise(F.array(*both("b")))
    near = F.sort_array(F.transform(F.filter(places, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.col("pos") - x).alias("far"), x.alias("npos"))))
    t = t.withColumn("near", near)
    best, score = F.get("near", F.lit(0)), lambda k: F.round(F.col("scale") / (1 + F.col("step") * F.get("near", F.lit(k))["far"]), 6)
    target = F.coalesce(*[F.when(F.col(f"{x}.npos") == best["npos"], F.col(f"{x}.target")) for x in ("b", "d", "a")])
    count = F.when(kind == "relative", F.col("d_n")).when(kind == "deixis", F.col("b_n") + F.col("a_n")).otherwise(F.col("b_n"))
    proof = F.when(count == 0, "Zero").when((count == 1) | (score(0) - score(1) > MARGIN), "Certificate").otherwise("Hypothesis")
    return t.select("sent", "pos", "surface", kind.alias("type"), target.alias("target"), F.when(best.isNotNull(), F.col("sent")).alias("nsent"), best["npos"].alias("npos"), score(0).alias("score"), count.alias("candidates"), proof.alias("kind"))


def addressed(toks: DataFrame) -> DataFrame:
    """First and second persons (D23): the latest noun called by a vocative is the one spoken to; no speaker is known."""
    order = Window.partitionBy("sent").orderBy("pos")
    called = (F.col("class") == "NOUN") & (F.lag("lemma").over(order) == "يا")
    t = toks.where("sent is not null").withColumn("called", F.coalesce(called, F.lit(False)))
    person = (F.col("class") == "PRON") & F.col("lemma").isin(*FIRST, *SECOND)
    t = t.where(F.col("called") | person).select("sent", "pos", "surface", "lemma", "called")
    past = Window.partitionBy(F.shiftright("sent", 24)).orderBy("sent", "pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("to", F.last(F.when(F.col("called"), F.struct("surface", "sent", "pos")), True).over(past)).where(~F.col("called"))
    known = F.col("lemma").isin(*SECOND) & F.col("to").isNotNull()
    of = lambda field: F.when(known, F.col(f"to.{field}"))
    return t.select(
        "sent", "pos", "surface", F.when(F.col("lemma").isin(*FIRST), "speaker").otherwise("addressee").alias("type"), of("surface").alias("target"), of("sent").alias("nsent"), of("pos").alias("npos"),
        F.when(known, F.lit(1.0)).alias("score"), F.when(known, 1).otherwise(0).cast("long").alias("candidates"), F.when(known, "Certificate").otherwise("Zero").alias("kind"),
    )


def bridged(toks: DataFrame) -> DataFrame:
    """A sentence's opening third-person singular is explained by its first noun, as a Hypothesis."""
    opening = F.max(F.when((F.col("pos") == 0) & (F.col("class") == "PRON") & F.col("lemma").isin("هو", "هي"), F.col("surface")))
    noun = F.min(F.when((F.col("pos") > 0) & (F.col("class") == "NOUN"), F.struct("pos", "surface")))
    t = toks.where("sent is not null").groupBy("sent").agg(opening.alias("surface"), noun.alias("n")).where("surface is not null and n is not null")
    return t.select("sent", F.lit(0).alias("pos"), "surface", F.lit("bridging").alias("type"), F.col("n.surface").alias("target"), F.col("sent").alias("nsent"), F.col("n.pos").alias("npos"), F.lit(0.9).alias("score"), F.lit(1).cast("long").alias("candidates"), F.lit("Hypothesis").alias("kind"))


def d21_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sentences(spark, sf_dir)
    return agreeing(t, spark).unionByName(addressed(t)).unionByName(bridged(t))


_LISTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
# The oracle makes the pairs.
D21 = f"""WITH {TOKS_SQL}, {REFERENTS.sql()}, r AS (SELECT * FROM toks JOIN referents ON lemma = r_lemma WHERE class IN ('DEM', 'REL', 'PRON') AND sent IS NOT NULL),
pairs AS (SELECT r.sent, r.pos, n.surface AS target, n.pos AS npos, abs(r.pos - n.pos) AS far, round(scale / (1 + step * abs(r.pos - n.pos)), 6) AS score FROM r JOIN toks n ON n.sent = r.sent AND n.class = 'NOUN' AND n.gender = r_gender AND n.number = r_number
  WHERE CASE r_type WHEN 'deixis' THEN n.pos <> r.pos WHEN 'relative' THEN n.pos < r.pos AND n.definite ELSE n.pos < r.pos END),
ranked AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS second, count(*) OVER (PARTITION BY sent, pos) AS candidates FROM pairs WINDOW o AS (PARTITION BY sent, pos ORDER BY far, npos)),
called AS (SELECT n.sent, n.pos, n.surface FROM toks n JOIN toks y ON y.sent = n.sent AND y.pos = n.pos - 1 WHERE n.class = 'NOUN' AND y.lemma = 'يا'),
persons AS (SELECT p.sent, p.pos, p.surface, p.lemma IN ({_LISTED(FIRST)}) AS speaks, max(struct_pack(s := c.sent, p := c.pos, t := c.surface)) AS c
  FROM toks p LEFT JOIN called c ON c.sent >> 24 = p.sent >> 24 AND (c.sent, c.pos) < (p.sent, p.pos) AND p.lemma IN ({_LISTED(SECOND)}) WHERE p.class = 'PRON' AND p.lemma IN ({_LISTED(FIRST + SECOND)}) AND p.sent IS NOT NULL GROUP BY ALL)
SELECT r.sent, r.pos, r.surface, r_type AS type, target, CASE WHEN npos IS NOT NULL THEN r.sent END AS nsent, npos, score, coalesce(candidates, 0) AS candidates, CASE WHEN npos IS NULL THEN 'Zero' WHEN candidates = 1 OR score - second > {MARGIN} THEN 'Certificate' ELSE 'Hypothesis' END AS kind
  FROM r LEFT JOIN ranked k ON k.sent = r.sent AND k.pos = r.pos AND rank = 1
UNION ALL SELECT sent, pos, surface, CASE WHEN speaks THEN 'speaker' ELSE 'addressee' END, c.t, c.s, c.p, CASE WHEN c.s IS NOT NULL THEN 1.0 END, CASE WHEN c.s IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN c.s IS NOT NULL THEN 'Certificate' ELSE 'Zero' END FROM persons
UNION ALL SELECT p.sent, p.pos, p.surface, 'bridging', n.surface, p.sent, n.pos, 0.9, 1, 'Hypothesis' FROM toks p JOIN toks n ON n.sent = p.sent AND n.class = 'NOUN' AND n.pos > 0
  WHERE p.pos = 0 AND p.class = 'PRON' AND p.lemma IN ('هو', 'هي') QUALIFY row_number() OVER (PARTITION BY p.sent ORDER BY n.pos) = 1"""


def passed(toks: DataFrame) -> DataFrame:
    """``toks`` with ``passed``, an array (name, source, target, distance, proof): the edges that the walk by roles misses.

    Each token looks a few tokens ahead for the first that fits: subjects and predicates of inna (accusative, then
    nominative) and kana (nominative, then accusative), the one called, a verb's second object, attributes that
    follow attributes, conjoined words of one case, appositions, negated verbs. Neighbours are Certificate.
    """
    order = Window.partitionBy("sent").orderBy("pos")
    token = F.struct("pos", "class", "lemma", "gcase", "definite")
    t = toks.withColumns({"pclass": F.lag("class").over(order), "ppos": F.lag("pos").over(order), "pcase": F.lag("gcase").over(order), "next": F.array(*[F.lead(token, k).over(order) for k in range(1, AHEAD + 1)])})
    noun, nominal = (lambda x: x["class"] == "NOUN"), lambda x: x["class"].isin("NOUN", "ADJ")
    here, first = F.col("pos"), F.get("next", F.lit(0))

    def ahead(fits, within: int) -> Column:
        """The place of the first token ahead that fits."""
        return F.get(F.filter(F.slice("next", 1, within), fits), F.lit(0))["pos"]

    particle = lambda *lemmas: (F.col("class") == "PARTICLE") & F.col("lemma").isin(*lemmas)
    kana, verb = (F.col("class") == "VERB") & (F.col("lemma") == "كان"), (F.col("class") == "VERB") & (F.col("lemma") != "كان")
    edge = lambda when, name, source, target: F.when(when & source.isNotNull() & target.isNotNull(), F.struct(F.lit(name).alias("name"), source.alias("source"), target.alias("target")))
    accusatives = F.filter(F.slice("next", 1, NEAR), lambda x: noun(x) & (x["gcase"] == "ACC"))
    found = F.array(
        edge(particle("إن"), "inna_topic_of", ahead(lambda x: noun(x) & (x["gcase"] == "ACC"), AHEAD), here),
        edge(particle("إن"), "inna_comment_of", ahead(lambda x: nominal(x) & (x["gcase"] == "NOM"), AHEAD), here),
        edge(kana, "kana_topic_of", ahead(lambda x: noun(x) & (x["gcase"] == "NOM"), AHEAD), here),
        edge(kana, "kana_comment_of", ahead(lambda x: nominal(x) & (x["gcase"] == "ACC"), AHEAD), here),
        edge(particle("يا"), "vocative_of", ahead(noun, NEAR), here),
        edge(verb, "patient2_of", F.get(accusatives, F.lit(1))["pos"], here),
        edge((F.col("class") == "ADJ") & nominal(first) & (first["class"] == "ADJ") & (first["gcase"] == F.col("gcase")) & (first["definite"] == F.col("definite")), "attribute_of", first["pos"], here),
        edge((F.col("class") == "CONJ") & F.col("pclass").isin("NOUN", "ADJ") & nominal(first) & (first["gcase"] == F.col("pcase")), "coordinate_of", first["pos"], F.col("ppos")),
        edge(noun(F.struct("class")) & noun(first) & (F.col("gcase") != "GEN") & (first["gcase"] == F.col("gcase")) & F.col("definite") & first["definite"], "substitute_of", first["pos"], here),
        edge(particle("لا", "ما") & (first["class"] == "VERB"), "negated_by", here, first["pos"]),
    )
    far = lambda x: F.abs(x["source"] - x["target"])
    told = F.transform(F.array_compact(found), lambda x: F.struct(x["name"].alias("name"), x["source"].alias("source"), x["target"].alias("target"), far(x).alias("distance"), F.when(far(x) == 1, "Certificate").otherwise("Hypothesis").alias("proof")))
    return t.select(*toks.columns, F.when(F.col("sent").isNotNull(), told).alias("passed"))


def passes(toks: DataFrame) -> DataFrame:
    """Edges (sent, name, source, target, distance, proof) that the walk by roles misses."""
    return passed(toks.where("sent is not null").select("sent", "pos", "class", "lemma", "gcase", "definite")).select("sent", F.inline("passed"))


def d08_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes(sentences(spark, sf_dir))


def _first_ahead(name: str, head: str, fits: str, within: int, k: int = 1) -> str:
    """SQL for a pass: the ``k``-th token ahead that fits, by a self-join."""
    return f"SELECT a.sent, '{name}' AS name, b.pos AS source, a.pos AS target FROM toks a JOIN toks b ON b.sent = a.sent AND b.pos > a.pos AND b.pos <= a.pos + {within} WHERE {head} AND {fits} QUALIFY row_number() OVER (PARTITION BY a.sent, a.pos ORDER BY b.pos) = {k}"


_NOUN, _NOMINAL = "b.class = 'NOUN'", "b.class IN ('NOUN', 'ADJ')"
_INNA, _KANA = "a.class = 'PARTICLE' AND a.lemma = 'إن'", "a.class = 'VERB' AND a.lemma = 'كان'"
D08 = f"""WITH {TOKS_SQL}, x AS (
{_first_ahead("inna_topic_of", _INNA, f"{_NOUN} AND b.gcase = 'ACC'", AHEAD)} UNION ALL {_first_ahead("inna_comment_of", _INNA, f"{_NOMINAL} AND b.gcase = 'NOM'", AHEAD)}
UNION ALL {_first_ahead("kana_topic_of", _KANA, f"{_NOUN} AND b.gcase = 'NOM'", AHEAD)} UNION ALL {_first_ahead("kana_comment_of", _KANA, f"{_NOMINAL} AND b.gcase = 'ACC'", AHEAD)}
UNION ALL {_first_ahead("vocative_of", "a.class = 'PARTICLE' AND a.lemma = 'يا'", _NOUN, NEAR)} UNION ALL {_first_ahead("patient2_of", "a.class = 'VERB' AND a.lemma <> 'كان'", f"{_NOUN} AND b.gcase = 'ACC'", NEAR, 2)}
UNION ALL {_first_ahead("attribute_of", "a.class = 'ADJ'", "b.class = 'ADJ' AND a.gcase = b.gcase AND a.definite = b.definite", 1)}
UNION ALL {_first_ahead("substitute_of", "a.class = 'NOUN' AND a.gcase <> 'GEN' AND a.definite", f"{_NOUN} AND a.gcase = b.gcase AND b.definite", 1)}
UNION ALL SELECT a.sent, 'coordinate_of', b.pos, a.pos FROM toks a JOIN toks c ON c.sent = a.sent AND c.pos = a.pos + 1 JOIN toks b ON b.sent = a.sent AND b.pos = a.pos + 2 WHERE c.class = 'CONJ' AND a.class IN ('NOUN', 'ADJ') AND {_NOMINAL} AND a.gcase = b.gcase
UNION ALL SELECT a.sent, 'negated_by', a.pos, b.pos FROM toks a JOIN toks b ON b.sent = a.sent AND b.pos = a.pos + 1 WHERE a.class = 'PARTICLE' AND a.lemma IN ('لا', 'ما') AND b.class = 'VERB')
SELECT *, abs(source - target) AS distance, CASE WHEN abs(source - target) = 1 THEN 'Certificate' ELSE 'Hypothesis' END AS proof FROM x"""


def conditions(toks: DataFrame) -> DataFrame:
    """One row a condition (sent, tool, condition, answer, marker, answer_text, kind).

    A condition reaches from its particle to the next one. Its verb is the first before the answer's particle, the
    answer's verb the first after it: Certificate. Without that particle the second verb answers: Hypothesis. Without
    both verbs it is Zero. Only a Certificate gives a text, as the question for a condition's answer asks.
    """
    order = Window.partitionBy("sent").orderBy("pos")
    tool, verb = (F.col("class") == "PARTICLE") & (F.col("lemma") == "إذا"), F.col("class") == "VERB"
    t = toks.where("sent is not null").withColumn("g", F.count(F.when(tool, 1)).over(order)).where("g > 0")
    marker = F.min(F.when((F.col("class") == "CONJ") & (F.col("lemma") == "ف"), F.col("pos"))).over(Window.partitionBy("sent", "g"))
    verbs = F.sort_array(F.collect_list(F.when(verb, F.struct("pos", "surface"))))
    c = t.withColumn("marker", marker).groupBy("sent", "g").agg(F.min("pos").alias("tool"), F.max("marker").alias("marker"), verbs.alias("vs"))
    before = F.filter("vs", lambda v: F.coalesce(v["pos"] < F.col("marker"), F.lit(True)))
    after = F.filter("vs", lambda v: v["pos"] > F.col("marker"))
    c = c.select("sent", "tool", "marker", F.get(before, F.lit(0)).alias("v"), F.when(F.col("marker").isNull(), F.get("vs", F.lit(1))).otherwise(F.get(after, F.lit(0))).alias("w"))
    whole = F.col("v").isNotNull() & F.col("w").isNotNull()
    kind = F.when(~whole, "Zero").when(F.col("marker").isNotNull(), "Certificate").otherwise("Hypothesis")
    return c.select("sent", "tool", F.col("v.pos").alias("condition"), F.col("w.pos").alias("answer"), "marker", F.when(kind == "Certificate", F.concat("v.surface", F.lit(" → "), "w.surface")).alias("answer_text"), kind.alias("kind"))


def d09_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions(sentences(spark, sf_dir))


# The oracle joins each particle with the tokens up to the next one.
D09 = f"""WITH {TOKS_SQL}, tools AS (SELECT sent, pos AS tool, lead(pos) OVER (PARTITION BY sent ORDER BY pos) AS upto FROM toks WHERE class = 'PARTICLE' AND lemma = 'إذا' AND sent IS NOT NULL),
m AS (SELECT c.sent, tool, any_value(upto) AS upto, min(t.pos) AS marker FROM tools c LEFT JOIN toks t ON t.sent = c.sent AND t.pos > tool AND (upto IS NULL OR t.pos < upto) AND t.class = 'CONJ' AND t.lemma = 'ف' GROUP BY ALL),
v AS (SELECT m.sent, tool, min(t.pos) AS condition FROM m JOIN toks t ON t.sent = m.sent AND t.class = 'VERB' AND t.pos > tool AND (upto IS NULL OR t.pos < upto) AND (marker IS NULL OR t.pos < marker) GROUP BY ALL),
w AS (SELECT m.sent, m.tool, min(t.pos) AS answer FROM m LEFT JOIN v ON v.sent = m.sent AND v.tool = m.tool JOIN toks t ON t.sent = m.sent AND t.class = 'VERB' AND (upto IS NULL OR t.pos < upto) AND t.pos > coalesce(marker, condition) GROUP BY ALL)
SELECT m.sent, m.tool, condition, answer, marker, CASE WHEN marker IS NOT NULL THEN a.surface || ' → ' || b.surface END AS answer_text, CASE WHEN condition IS NULL OR answer IS NULL THEN 'Zero' WHEN marker IS NOT NULL THEN 'Certificate' ELSE 'Hypothesis' END AS kind
FROM m LEFT JOIN v ON v.sent = m.sent AND v.tool = m.tool LEFT JOIN w ON w.sent = m.sent AND w.tool = m.tool LEFT JOIN toks a ON a.sent = m.sent AND a.pos = condition LEFT JOIN toks b ON b.sent = m.sent AND b.pos = answer"""

QUERIES = {"d21_references": d21_references, "d08_passes": d08_passes, "d09_conditions": d09_conditions}
ORACLE = {"d21_references": D21, "d08_passes": D08, "d09_conditions": D09}
