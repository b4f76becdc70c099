"""Case marks, clitics, agreement, constructions, modals and opinions (W1 to W3 in part, F14, F15, F24, F28, J10, J28, L7 to L9, L11, M23 to M25, D5, A31, B6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.functions.arrays import at, indexed, labelled, let
from rulelens.operators.graph import _EVENTS, events
from rulelens.operators.tokens import _SQL_TOKENS, counted_once, document_tokens, found
from rulelens.sources.analysed import TOKS_SQL, sentences
from rulelens.sources.rules import Table
from rulelens.sources.spelled import WORDS_SQL, words

_A = ar.ALL_MARKS


def w01_case_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case by the previous token's class, then by ending; the mark that shows it (W1 to W3 in part)."""
    order = Window.partitionBy("sent").orderBy("pos")
    t = sentences(spark, sf_dir).withColumns({"prev": F.lag("class").over(order), "plain": F.col("surface")})
    last = F.regexp_extract("surface", f"([{ar.MARKS}])[^{ar.MARKS}]*$", 1)
    named = F.col("class").isin("NOUN", "ADJ")
    case = F.when(~named, None).when(F.coalesce(F.col("prev") == "PREP", F.lit(False)), "GEN").when(F.col("surface").rlike("ُونَ?$"), "NOM").when(F.col("surface").rlike("ِينَ?$"), "OBL").when(last.isin("ُ", "ٌ"), "NOM").when(last.isin("َ", "ً"), "ACC").when(last.isin("ِ", "ٍ"), "GEN").otherwise("UNKNOWN")
    mark = F.when(F.col("surface").rlike("[وي]نَ?$"), "letter").when(last != "", "vowel").otherwise("none")
    return t.select("sent", "pos", case.alias("gcase"), mark.alias("mark"), F.coalesce(case == F.col("gcase"), ~named & F.col("gcase").isNull()).alias("agrees"))


W01 = f"""WITH {TOKS_SQL}, t AS (SELECT *, lag(class) OVER (PARTITION BY sent ORDER BY pos) AS prev, regexp_extract(surface, '([{ar.MARKS}])[^{ar.MARKS}]*$', 1) AS last, class IN ('NOUN', 'ADJ') AS named FROM toks),
c AS (SELECT *, CASE WHEN NOT named THEN NULL WHEN coalesce(prev = 'PREP', false) THEN 'GEN' WHEN regexp_matches(surface, 'ُونَ?$') THEN 'NOM' WHEN regexp_matches(surface, 'ِينَ?$') THEN 'OBL' WHEN last IN ('ُ', 'ٌ') THEN 'NOM' WHEN last IN ('َ', 'ً') THEN 'ACC' WHEN last IN ('ِ', 'ٍ') THEN 'GEN' ELSE 'UNKNOWN' END AS c FROM t)
SELECT sent, pos, c AS gcase, CASE WHEN regexp_matches(surface, '[وي]نَ?$') THEN 'letter' WHEN last <> '' THEN 'vowel' ELSE 'none' END AS mark, coalesce(c = gcase, NOT named AND gcase IS NULL) AS agrees FROM c"""

#: Pronoun endings, longest first: person, gender and number.
CLITICS = Table("clitics", "ending person gender number", "string int string string", (("هُمْ", 3, "M", "PL"), ("كُمْ", 2, "M", "PL"), ("هَا", 3, "F", "SG"), ("نَا", 1, "C", "PL"), ("هُ", 3, "M", "SG"), ("ي", 1, "C", "SG")))


def f15_clitics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest pronoun ending that leaves two letters; object if the stem looks verbal, else possessive."""
    ending = lambda e, person, gender, number: F.struct(F.lit(len(e)).alias("n"), F.lit(e).alias("ending"), F.left("word", F.length("word") - len(e)).alias("stem"), F.lit(person).alias("person"), F.lit(gender).alias("gender"), F.lit(number).alias("number"))
    fits = F.filter(F.array(*[ending(*row) for row in CLITICS.rows]), lambda x: F.endswith(F.col("word"), x["ending"]) & (F.length(ar.strip_all(x["stem"])) >= 2))
    best = words(spark, sf_dir).withColumn("x", F.array_max(fits))
    verbal = F.col("x.stem").rlike(f"^[^{_A}]َ[^{_A}][َُِ]?[^{_A}]َ$")
    return best.select("id", F.col("x.ending").alias("ending"), F.col("x.person").alias("person"), F.col("x.number").alias("number"), F.when(F.col("x").isNull(), "none").when(verbal, "object").otherwise("possessive").alias("kind"))


F15 = f"WITH {WORDS_SQL}, {CLITICS.sql()}, f AS (SELECT id, ending, person, number, left(word, length(word) - length(ending)) AS stem FROM words JOIN clitics ON ends_with(word, ending)), b AS (SELECT * FROM f WHERE length(regexp_replace(stem, '[{_A}]', '', 'g')) >= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(ending) DESC, ending DESC) = 1) SELECT w.id, ending, person, number, CASE WHEN b.id IS NULL THEN 'none' WHEN regexp_matches(stem, '^[^{_A}]َ[^{_A}][َُِ]?[^{_A}]َ$') THEN 'object' ELSE 'possessive' END AS kind FROM words w LEFT JOIN b ON b.id = w.id"


def m23_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring noun and adjective, verb and subject, pronoun and noun before it: what agrees, and the blockers."""
    order = Window.partitionBy("sent").orderBy("pos")
    prev = F.lag(F.struct("pos", "class", "gcase", "definite", "gender", "number")).over(order)
    t = sentences(spark, sf_dir).withColumn("p", prev).where("p is not null")
    pair = F.when((F.col("p.class") == "NOUN") & (F.col("class") == "ADJ"), "attribute").when((F.col("p.class") == "VERB") & (F.col("class") == "NOUN"), "subject").when((F.col("p.class") == "NOUN") & (F.col("class") == "PRON"), "referent")
    off = lambda c, name: F.when(F.col(c).isNotNull() & F.col(f"p.{c}").isNotNull() & (F.col(c) != F.col(f"p.{c}")), name)
    blockers = F.array_compact(F.array(off("gender", "gender"), off("number", "number"), F.when(pair == "attribute", off("definite", "definite")), F.when(pair == "attribute", off("gcase", "case"))))
    kind = F.when(F.size(blockers) == 0, "Certificate").when(F.size(blockers) == 1, "Hypothesis").otherwise("Zero")
    return t.select("sent", "pos", pair.alias("pair"), F.array_join(blockers, ",").alias("blockers"), kind.alias("proof")).where("pair is not null")


M23 = f"""WITH {TOKS_SQL}, t AS (SELECT *, lag(class) OVER o AS pc, lag(gcase) OVER o AS pg, lag(definite) OVER o AS pd, lag(gender) OVER o AS px, lag(number) OVER o AS pn FROM toks WINDOW o AS (PARTITION BY sent ORDER BY pos)),
p AS (SELECT *, CASE WHEN pc = 'NOUN' AND class = 'ADJ' THEN 'attribute' WHEN pc = 'VERB' AND class = 'NOUN' THEN 'subject' WHEN pc = 'NOUN' AND class = 'PRON' THEN 'referent' END AS pair FROM t),
b AS (SELECT sent, pos, pair, concat_ws(',', CASE WHEN gender <> px THEN 'gender' END, CASE WHEN number <> pn THEN 'number' END, CASE WHEN pair = 'attribute' AND definite <> pd THEN 'definite' END, CASE WHEN pair = 'attribute' AND gcase <> pg THEN 'case' END) AS blockers FROM p WHERE pair IS NOT NULL)
SELECT *, CASE WHEN blockers = '' THEN 'Certificate' WHEN NOT contains(blockers, ',') THEN 'Hypothesis' ELSE 'Zero' END AS proof FROM b"""

#: Constructions: a trigger word, what must follow, and their meaning; the first in order wins.
CONSTRUCTIONS = Table("constructions", "id trigger_word follows lang meaning", "int string string string string", ((1, "of", "the", "en", "belonging"), (2, "to", "be", "en", "purpose"), (3, "and", "the", "en", "joining"), (4, "de", "la", "fr", "belonging"), (5, "de", "la", "es", "belonging"), (6, "von", "der", "de", "belonging"), (7, "and", None, "en", "joining_any")))


def j28_constructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger and next token against the construction table; the first in order counts, once a document."""

    def in_sentence(toks: Column, s: Column) -> Column:
        def first(t: Column, i: Column) -> Column:
            out = F.lit(None).cast("int")
            for number, trigger, follows, lang, _ in sorted(CONSTRUCTIONS.rows, reverse=True):
                fits = (t == trigger) & (F.col("lang") == lang)
                out = F.when(fits if follows is None else fits & F.coalesce(at(toks, i + 1) == follows, F.lit(False)), number).otherwise(out)
            return F.struct(out.alias("id"), s.alias("sent"))

        return indexed(toks, first, lambda x: x["id"].isNotNull())

    def of_document(hits: Column) -> Column:
        of = lambda x: F.filter(hits, lambda h: h["id"] == x)
        each = lambda x: F.struct(x.alias("id"), F.size(of(x)).cast("long").alias("hits"), F.array_min(F.transform(of(x), lambda h: h["sent"])).alias("earliest"))
        return F.transform(F.array_distinct(F.transform(hits, lambda h: h["id"])), each)

    hits = let(F.flatten(F.transform("sents", in_sentence)), of_document)
    summed = found(document_tokens(spark, sf_dir), hits, "lang").groupBy("lang", "id").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"), F.min("earliest").alias("earliest"))
    return summed.join(F.broadcast(CONSTRUCTIONS.frame(spark).select("id", "meaning")), "id")


J28 = f"WITH {CONSTRUCTIONS.sql()}, {_SQL_TOKENS}, n AS (SELECT *, lead(token) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos) AS next FROM tokens), h AS (SELECT doc_id, n.lang, sent_idx, pos, id, meaning FROM n JOIN constructions c ON token = trigger_word AND c.lang = n.lang AND (follows IS NULL OR follows = next) QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, pos ORDER BY id) = 1), e AS (SELECT doc_id, lang, id, meaning, min(sent_idx) AS first_at, count(*) AS hits FROM h GROUP BY ALL) SELECT lang, id, meaning, count(*) AS docs, sum(hits)::BIGINT AS hits, min(first_at) AS earliest FROM e GROUP BY ALL"

#: Modals of one and two words.
MODALS = Table("modals", "phrase lang force", "string string string", (("to be", "en", "possibility"), ("is to", "en", "obligation"), ("that is", "en", "assertion"), ("is", "en", "assertion"), ("est", "fr", "assertion"), ("es", "es", "assertion"), ("ist", "de", "assertion")))


def d05_modals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modal markers by windows of one and two tokens; a longer phrase at a place beats a shorter one."""

    def phrases(toks: Column) -> Column:
        modal = lambda p: labelled(p, F.col("lang"), [(phrase, lang, phrase) for phrase, lang, _ in MODALS.rows])
        # Few words open a modal; only those are looked up with the next one.
        opens = sorted({phrase.split(" ")[0] for phrase, _, _ in MODALS.rows})
        return indexed(toks, lambda t, i: F.when(t.isin(opens), F.coalesce(modal(F.concat_ws(" ", t, at(toks, i + 1))), modal(t))), lambda p: p.isNotNull())

    each = counted_once(F.flatten(F.transform("sents", phrases)), lambda p, n: F.struct(p.alias("phrase"), n.cast("long").alias("n")))
    summed = found(document_tokens(spark, sf_dir), each, "lang").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return summed.join(F.broadcast(MODALS.frame(spark)), ["lang", "phrase"])


D05 = f"WITH {MODALS.sql()}, {_SQL_TOKENS}, w AS (SELECT *, concat_ws(' ', token, lead(token) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos)) AS two FROM tokens), g AS (SELECT DISTINCT doc_id, lang, sent_idx, pos, unnest([token, two]) AS phrase FROM w), h AS (SELECT doc_id, g.lang, sent_idx, pos, g.phrase, force FROM g JOIN modals m ON m.phrase = g.phrase AND m.lang = g.lang QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, pos ORDER BY length(g.phrase) DESC, g.phrase DESC) = 1) SELECT lang, phrase, force, count(*) AS n, count(DISTINCT doc_id) AS docs FROM h GROUP BY ALL"


def a31_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest roles of each verb from unpivoted counts over all events, with shares."""
    count = lambda c, name: F.count(c).alias(name)
    frames = events(sentences(spark, sf_dir), spark).groupBy(F.col("event").alias("lemma")).agg(count("agent_of", "role_agent"), count("patient_of", "role_patient"), count("in_location", "role_place"))
    long = frames.unpivot("lemma", ["role_agent", "role_patient", "role_place"], "role", "n").where("n > 0")
    best = Window.partitionBy("lemma").orderBy(F.desc("n"), "role")
    return long.withColumns({"rank": F.row_number().over(best), "share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lemma")), 6)}).where("rank <= 2")


A31 = f"WITH {_EVENTS}, frames AS (SELECT event AS lemma, count(agent_of) AS role_agent, count(patient_of) AS role_patient, count(in_location) AS role_place FROM events GROUP BY event), u AS (UNPIVOT frames ON role_agent, role_patient, role_place INTO NAME role VALUE n) SELECT lemma, role, n, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, role)::INT AS rank, round(n / sum(n) OVER (PARTITION BY lemma), 6) AS share FROM u WHERE n > 0 QUALIFY rank <= 2"

#: Opinion cues: preferred before rejected before reported.
OPINIONS = Table("opinions", "cue stance priority", "string string int", (("ought", "preferred", 1), ("are the", "preferred", 1), ("not", "rejected", 2), ("with", "reported", 3)))


def b06_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance of each turn by the first cue in priority, with at most twenty turns of a stance per speaker in order (B6, L11: a capped report)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    hit = c.join(F.broadcast(OPINIONS.frame(spark)), F.expr("contains(t, cue)")).groupBy("conv_id", "turn", "role").agg(F.min(F.struct("priority", "cue", "stance")).alias("x"))
    order = Window.partitionBy("role", "x.stance").orderBy("conv_id", "turn")
    return hit.withColumn("place", F.row_number().over(order)).where("place <= 20").select("conv_id", "turn", "role", "x.stance", "x.cue", "place")


B06 = f"WITH {OPINIONS.sql()}, h AS (SELECT conv_id, turn, role, stance, cue FROM conversations JOIN opinions ON contains(lower(coalesce(text, '')), cue) QUALIFY row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY priority, cue) = 1) SELECT *, row_number() OVER (PARTITION BY role, stance ORDER BY conv_id, turn)::INT AS place FROM h QUALIFY place <= 20"

QUERIES = {"w01_case_marks": w01_case_marks, "f15_clitics": f15_clitics, "m23_agreement": m23_agreement, "j28_constructions": j28_constructions, "d05_modals": d05_modals, "a31_frames": a31_frames, "b06_opinions": b06_opinions}
ORACLE = {"w01_case_marks": W01, "f15_clitics": F15, "m23_agreement": M23, "j28_constructions": J28, "d05_modals": D05, "a31_frames": A31, "b06_opinions": B06}
