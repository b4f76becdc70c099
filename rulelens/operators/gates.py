"""Gates that observe or enforce, edges that replace others, and agents that no word names.

A gate says of each row why it would be blocked. Observing keeps every row and counts what would go, in the same pass, by
``DataFrame.observe``; enforcing drops it. What a word's decision is worth is worked out once a distinct word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.alignment import ALIGNED_SQL, best_alignment
from rulelens.operators.graph import _EDGES, relations, walked
from rulelens.operators.morphology import M13_SQL, classes
from rulelens.operators.references import D08, passed
from rulelens.operators.segmenter import G11, segments
from rulelens.plans.joins import checked_join, large_join
from rulelens.plans.scratch import save
from rulelens.sources.analysed import sentences
from rulelens.sources.readings import READINGS_SQL, read_words
from rulelens.sources.rules import Rules, Table

# -- decisions --------------------------------------------------------------------------------------------------------------


def decisions(words: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(word, class, proof, segmentation, needs_context, ambiguous) of each distinct ``word``.

    A word is ambiguous if its best pattern serves verbs and nouns alike, and needs its context if its class rests on
    the pattern or on nothing.
    """
    told = classes(words, rules).select("word", "class", "source", "proof").join(segments(words, rules).select("word", F.col("proof").alias("segmentation")), "word")
    told = checked_join(told, best_alignment(words, rules).select("word", "kind"), ["word"])
    return save(told.select("word", "class", "proof", "segmentation", F.col("source").isin("pattern", "surface_verb", "default").alias("needs_context"), ((F.col("kind") == "PV|N") & (F.col("source") == "pattern")).alias("ambiguous")), "decisions")


#: A reason and the condition on a side's decision (``d``); reasons of a side are prefixed with its name.
def _reasons(d: Column, side: str, event: bool) -> list[Column]:
    when = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    uncertain = F.coalesce(d["proof"], F.lit("Zero"))
    out = [
        when(d["segmentation"] == "Zero", f"{side}_is_fragment"), when((d["proof"] == "Hypothesis") & d["needs_context"], f"{side}_hypothesis_needs_context"), when(d["ambiguous"] & (uncertain != "Certificate"), f"{side}_ambiguous_uncertified"),
    ]
    if event:
        out = [when(d["proof"].isNull(), f"{side}_decision_missing"), when((d["class"] != "VERB") | (uncertain != "Certificate"), F.concat(F.lit("not_certified_verb:"), d["class"], F.lit("/"), uncertain)), *out, when(d["segmentation"] != "Certificate", F.concat(F.lit("segmentation_status:"), d["segmentation"]))]
    return out


def gate(rows: DataFrame, sides: dict[str, str], event: bool = False, mode: str = "observe", observation: Observation | None = None) -> DataFrame:
    """``rows`` with would_block and reasons; in mode ``enforce`` those that would be blocked are gone.

    ``sides`` names the struct columns that hold a side's decision. An ``observation`` takes the counts of the pass:
    rows, blocked, and one for each kind of reason.
    """
    if mode not in ("observe", "enforce"):
        raise ValueError(f"no such mode: {mode}")
    reasons = F.array_compact(F.array(*[r for side, column in sides.items() for r in _reasons(F.col(column), side, event)]))
    told = rows.withColumn("reasons", reasons).withColumn("would_block", F.size("reasons") > 0)
    if observation is not None:
        kinds = ("fragment", "hypothesis", "ambiguous", "not_certified", "segmentation_status", "decision_missing")
        held = [F.sum(F.contains(F.array_join("reasons", ","), F.lit(k)).cast("long")).alias(k) for k in kinds]
        told = told.observe(observation, F.count("*").alias("rows"), F.sum(F.col("would_block").cast("long")).alias("blocked"), *held)
    return told.where(~F.col("would_block")) if mode == "enforce" else told


def _with_decisions(rows: DataFrame, toks: DataFrame, told: DataFrame, places: dict[str, str]) -> DataFrame:
    """``rows`` (sent and the named places) with each place's decision as a struct."""
    known = checked_join(toks.select("sent", "pos", F.col("surface").alias("word")), told, ["word"], "inner")
    known = save(known.select("sent", "pos", F.struct("class", "proof", "segmentation", "needs_context", "ambiguous").alias("d")), "gate-decisions")
    for place, name in places.items():
        rows = large_join(rows, known.select("sent", F.col("pos").alias(place), F.col("d").alias(name)), ["sent", place], "left")
    return rows


def _gated_relations(spark: SparkSession, sf_dir: str, mode: str = "observe", observation: Observation | None = None) -> DataFrame:
    toks = sentences(spark, sf_dir)
    told = decisions(toks.select(F.col("surface").alias("word")))
    edges = _with_decisions(relations(toks, spark), toks, told, {"source": "s", "target": "t"})
    return gate(edges, {"source": "s", "target": "t"}, mode=mode, observation=observation)


def f30_relation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relation with what the gate says of it."""
    return _gated_relations(spark, sf_dir).select("sent", "name", "source", "target", F.array_join("reasons", ",").alias("reasons"), "would_block")


def a23_relation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate would block, by relation and reason."""
    g = _gated_relations(spark, sf_dir).select("name", "would_block", F.explode(F.when(F.col("would_block"), F.col("reasons")).otherwise(F.array(F.lit("passed")))).alias("reason"))
    return g.groupBy("name", "reason").agg(F.count("*").alias("n"))


def f31_event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verb as an event with what the gate says of it, and what is left when it is enforced."""
    toks = sentences(spark, sf_dir)
    told = decisions(toks.select(F.col("surface").alias("word")))
    verbs = toks.where("class = 'VERB'").select("sent", "pos", F.col("surface").alias("word"))
    known = checked_join(verbs, told, ["word"]).select("sent", "pos", "word", F.struct("class", "proof", "segmentation", "needs_context", "ambiguous").alias("d"))
    g = gate(known, {"verb": "d"}, event=True)
    return g.groupBy("word", F.array_join("reasons", ",").alias("reasons"), "would_block").agg(F.count("*").alias("events"))


# -- claims on words, certified by their segments ------------------------------------------------------------------------------

#: What an operator's letter or word may mean: its topic and meaning, where it stands. Fixed values.
MEANINGS = Table("operator_meanings", "operator form topic meaning place", "string string string string string", (
    ("ب", "بِ", "PREP_BA", "BA_ILSAQ", "start"), ("ب", "بِ", "QASAM_PARTICLES", "BA_QASAM", "start"), ("ل", "لِ", "PREP_LAM", "LAM_MILK", "start"), ("ل", "لْ", "JAZM_LAM_AMR", "LAM_AMR", "start"), ("ل", "لَ", "SHART_LAM_JAWAB", "LAM_JAWAB", "start"), ("ك", "كَ", "PREP_KAF", "KAF_TASHBIH", "start"),
    ("و", "وَ", "PREP_WAW", "WAW_ATF", "start"), ("و", "وَ", "PREP_WAW", "WAW_QASAM", "start"), ("و", "وَ", "PREP_WAW", "WAW_RUBBA", "start"), ("ف", "فَ", "SHART_FA_IDH", "FA_JAWAB", "start"), ("س", "سَ", "FUTURE", "SIN_TANFEES_QAREEB", "start"),
    ("ه", "هُ", "PRONOUN", "HA_GHAIB", "end"), ("ك", "كَ", "PRONOUN", "KAF_KHITAB", "end"), ("ي", "ي", "PRONOUN", "YA_MUTAKALLIM", "end"), ("إن", "إِنْ", "SHART_IN", "IN_SHART", "word"), ("إن", "إِنَّ", "INNA", "INNA_TAWKID", "word"), ("لا", "لَا", "JAZM_LA_NAHIYA", "LA_NAHIYA", "word"), ("لا", "لَا", "NAFY", "LA_NAFIYA", "word"),
    ("من", "مِنْ", "PREP_MIN", "MIN_IBTIDA", "word"), ("من", "مَنْ", "SHART_MAN", "MAN_SHART", "word"), ("ما", "مَا", "NAFY", "MA_NAFIYA", "word"), ("إذا", "إِذَا", "SHART_IDHA", "IDHA_SHART", "word"), ("في", "فِي", "PREP_FI", "FI_ZARFIYA", "word"), ("على", "عَلَى", "PREP_ALA", "ALA_ISTILA", "word"),
))
#: Topics and meanings that no segment can prove; topics that need a prefix with a tag; topics that need the very form. Fixed values.
NEVER_TOPICS, NEVER_MEANINGS = ("QASAM_PARTICLES", "QASAM_JAWAB"), ("WAW_QASAM", "WAW_RUBBA", "SIN_TANFEES_QAREEB")
NEEDS_PREFIX = {"PREP_BA": "PREP", "PREP_LAM": "PREP", "PREP_KAF": "PREP", "PREP_WAW": "CONJ", "SHART_FA_IDH": "CONJ", "JAZM_LAM_AMR": "LAM_AMR", "SHART_LAM_JAWAB": "PREP"}
STRICT_FORMS = ("SHART_IN", "JAZM_LA_NAHIYA")


def word_claims(words: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(word, operator, topic, meaning, form, way) of each distinct ``word``: what it may mean by its first or last letter, or as a whole.

    A whole word is looked up as it is first and without marks only where no form is it exactly.
    """
    spark = words.sparkSession
    m = (rules or Rules()).frame(spark, MEANINGS)
    w = words.select("word").where("word <> ''").distinct().withColumn("plain", ar.strip_all(F.col("word")))
    letters = [w.where(F.length("plain") > 1).select("word", at.alias("operator"), F.lit(place).alias("place")) for place, at in (("start", F.substring("plain", 1, 1)), ("end", F.expr("right(plain, 1)")))]
    by_letter = reduce(DataFrame.unionByName, letters).join(F.broadcast(m), ["operator", "place"])
    whole = m.where("place = 'word'")
    exact = w.join(F.broadcast(whole), w["word"] == whole["form"])
    stripped = w.join(F.broadcast(whole.select("form").distinct()), w["word"] == F.col("form"), "left_anti").join(F.broadcast(whole), w["plain"] == whole["operator"])
    keep = ["word", "operator", "topic", "meaning", "form"]
    told = lambda df, way: df.select(*keep, F.lit(way).alias("way"))
    return told(by_letter, "prefix").unionByName(told(exact, "exact")).unionByName(told(stripped, "stripped"))


def certified_claims(claims: DataFrame, parts: DataFrame) -> DataFrame:
    """``claims`` with certified and reason, by the segments of their words (F32)."""
    j = checked_join(claims, parts.select("word", "prefixes", "stem", "suffixes", "tags"), ["word"])
    pieces = F.concat(F.split("prefixes", "[+]"), F.split("suffixes", "[+]"))
    tagged = F.arrays_zip(F.filter(pieces, lambda x: x != "").alias("piece"), F.filter(F.split("tags", "[+]"), lambda x: x != "").alias("tag"))
    topic, meaning, letter = F.col("topic"), F.col("meaning"), F.col("operator")
    needed = reduce(lambda out, kv: F.when(topic == kv[0], F.lit(kv[1])).otherwise(out), NEEDS_PREFIX.items(), F.lit(None).cast("string"))
    j = j.withColumns({"_tagged": tagged, "_needed": needed})
    has_prefix = F.exists("_tagged", lambda x: (x["tag"] == F.col("_needed")) & F.startswith(ar.strip_all(x["piece"]), letter))
    has_suffix = F.exists("_tagged", lambda x: (x["tag"] == "PRON") & (ar.strip_all(x["piece"]) == letter))
    strict = (F.col("form") == F.col("word")) | ((F.col("form") == F.col("stem")) & ~((topic == "JAZM_LA_NAHIYA") & (F.col("word") != F.col("form"))))
    reason = (
        F.when(topic.isin(*NEVER_TOPICS), F.concat(F.lit("topic_"), topic, F.lit("_needs_oath_context"))).when(meaning.isin(*NEVER_MEANINGS), F.concat(F.lit("meaning_"), meaning, F.lit("_has_no_evidence")))
        .when(F.col("_needed").isNotNull(), F.when(~has_prefix, F.concat(F.lit("topic_"), topic, F.lit("_needs_prefix_"), F.col("_needed")))).when((topic == "PRONOUN") & (F.length("operator") == 1), F.when(~has_suffix, F.concat(F.lit("pronoun_"), letter, F.lit("_is_no_suffix"))))
        .when(topic.isin(*STRICT_FORMS), F.when(~strict, F.concat(F.lit("strict_form_"), topic)))
    )
    return j.withColumn("reason", reason).select("word", "operator", "topic", "meaning", "way", F.col("reason").isNull().alias("certified"), F.coalesce("reason", F.lit("")).alias("reason"))


def f32_certified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim on each word of the vocabulary, certified by its segments or not."""
    w = save(read_words(spark, sf_dir).select("id", "word"), "gate-words")
    told = save(certified_claims(word_claims(w), segments(w)), "gate-claims")
    # A word may make many claims, so the claims are the many side.
    return w.join(told, "word").select("id", "operator", "topic", "meaning", "certified", "reason")


def f33_claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims checked, kept and rejected by topic, and the commonest reason."""
    c = f32_certified_claims(spark, sf_dir)
    return c.groupBy("topic").agg(F.count("*").alias("checked"), F.sum(F.col("certified").cast("long")).alias("kept"), F.sum((~F.col("certified")).cast("long")).alias("rejected"), F.max("reason").alias("last_reason"))


# -- edges that replace others, and implicit agents ---------------------------------------------------------------------------

#: Which edge takes the place of which, where both leave one token; rows in order. Fixed values.
PRECEDENCE = (("patient2_of", "attribute_of"), ("patient2_of", "possessor_of"), ("kana_topic_of", "agent_of"), ("kana_comment_of", "patient_of"), ("vocative_of", "agent_of"), ("vocative_of", "topic_of"))


def replace_edges(edges: DataFrame, added: DataFrame, keys: list[str], precedence: tuple[tuple[str, str], ...] = PRECEDENCE) -> DataFrame:
    """``edges`` without those that an added one takes the place of, then the added ones (U4).

    An edge goes if the same source has an added edge whose name precedes its own; added edges that an edge there
    already says (same name, source and target) are not added twice.
    """
    spark = edges.sparkSession
    order = spark.createDataFrame(list(precedence), "winner string, name string")
    losers = added.select(*keys, F.col("name").alias("winner")).join(F.broadcast(order), "winner").select(*keys, "name").distinct()
    kept = large_join(edges, losers, [*keys, "name"], "left_anti")
    new = large_join(added, kept.select(*keys, "name", "target").distinct(), [*keys, "name", "target"], "left_anti")
    return kept.unionByName(new.select(*edges.columns))


def replaced_edges(toks: DataFrame, spark: SparkSession, precedence: tuple[tuple[str, str], ...] = PRECEDENCE) -> DataFrame:
    """(sent, name, source, target, distance, proof): what ``replace_edges`` makes of the walk's edges and those of the later passes.

    All edges of a sentence are found and compared where its tokens are, so tokens dealt by sentence are not shuffled again.
    """
    columns = ["name", "source", "target", "distance", "proof"]
    one = F.struct("name", F.col("pos").alias("source"), "target", "distance", "proof", F.lit(False).alias("added"))
    later = F.transform(F.coalesce("passed", F.array()), lambda x: F.struct(*[x[c].alias(c) for c in columns], F.lit(True).alias("added")))
    every = F.concat(F.when(F.col("name").isNotNull(), F.array(one)).otherwise(F.array()), later)
    edges = walked(passed(toks), spark).select("sent", F.inline(every))
    # Both windows go by one order: what the walk found stands before what a pass added.
    of_source = Window.partitionBy("sent", "source").orderBy("name", "target", "added").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy("sent", "source", "name", "target").orderBy("added").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_added", F.collect_set(F.when(F.col("added"), F.col("name"))).over(of_source))
    loses = reduce(lambda a, b: a | b, [(F.col("name") == name) & F.array_contains("_added", winner) for winner, name in precedence], F.lit(False))
    edges = edges.withColumn("_stays", F.col("added") | ~loses)
    told = F.count(F.when(F.col("_stays"), 1)).over(same)
    return edges.withColumn("_told", told).where("_stays and (not added or _told = 0)").select("sent", *columns)


def u04_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of the walk with those of the later passes, which replace what they know better."""
    return replaced_edges(sentences(spark, sf_dir), spark).select("sent", "name", "source", "target", "proof")


#: Who acts where no word says so, by the letter before a present verb or the ending of a past one; longer endings first (L8). Fixed values.
IMPLICIT_AGENTS = Table("implicit_agents", "letter ending person number gender pronoun", "string string string string string string", (
    ("ن", "", "1", "PL", "C", "نَحْنُ"), ("أ", "", "1", "SG", "C", "أَنَا"), ("ي", "ون", "3", "PL", "M", "هُمْ"), ("ي", "وا", "3", "PL", "M", "هُمْ"), ("ي", "ان", "3", "DU", "M", "هُمَا"), ("ي", "", "3", "SG", "M", "هُوَ"), ("ت", "ون", "2", "PL", "M", "أَنْتُمْ"), ("ت", "ين", "2", "SG", "F", "أَنْتِ"),
    ("", "تموا", "2", "PL", "M", "أَنْتُمْ"), ("", "تما", "2", "DU", "C", "أَنْتُمَا"), ("", "تم", "2", "PL", "M", "أَنْتُمْ"), ("", "وا", "3", "PL", "M", "هُمْ"), ("", "نا", "1", "PL", "C", "نَحْنُ"), ("ا", "وا", "2", "PL", "M", "أَنْتُمْ"), ("ا", "", "2", "SG", "M", "أَنْتَ"),
))


def implicit_agents(words: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(word, pronoun, person, number, gender) of each distinct verb whose affixes tell who acts.

    The letter is that of the present or the command, the ending the subject's; an ending without its own row takes the
    letter's row without ending. A past verb without a telling ending has none.
    """
    parts = segments(words, rules)
    verbs = classes(words, rules).where("class = 'VERB'").select("word")
    lam = F.when(F.col("lam_amr") != "", F.substring("stem", 1, 1)).otherwise("")
    letter = F.coalesce(F.nullif(ar.strip_all(F.col("imperfect")), F.lit("")), F.nullif(F.col("imperative"), F.lit("")), lam)
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.nullif(F.col("subject2"), F.lit("")), F.nullif(F.col("number"), F.lit("")), F.when(letter == "", F.when(F.col("pronoun2") != "", F.col("pronoun2")).when(F.col("pronoun") == "نَا", F.col("pronoun"))), F.lit(""))
    v = parts.join(verbs, "word").select("word", letter.alias("letter"), ar.strip_all(subject).alias("ending"))
    r = F.broadcast((rules or Rules()).frame(words.sparkSession, IMPLICIT_AGENTS).withColumns({"letter": F.coalesce("letter", F.lit("")), "ending": F.coalesce("ending", F.lit(""))}))
    told = ("person", "number", "gender", "pronoun")
    exact = v.join(r, ["letter", "ending"], "left").select("word", "letter", F.when(F.col("pronoun").isNotNull(), F.struct(*told)).alias("a"))
    by_letter = r.where("ending = '' and letter <> ''").select("letter", F.struct(*told).alias("b"))
    return exact.join(by_letter, "letter", "left").select("word", F.coalesce("a", "b").alias("who")).where("who is not null").select("word", "who.*")


def w27_implicit_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs that no token is the agent of, with the pronoun that their affixes tell.

    The edge is a hypothesis, never a certificate; it is none at all (Zero) where the word's own person is unknown.
    """
    toks = sentences(spark, sf_dir)
    named = relations(toks, spark).where("name = 'agent_of' and proof <> 'Zero'").select("sent", F.col("target").alias("pos")).distinct()
    verbs = large_join(toks.where("class = 'VERB'").select("sent", "pos", F.col("surface").alias("word")), named, ["sent", "pos"], "left_anti")
    told = save(implicit_agents(toks.select(F.col("surface").alias("word"))), "implicit-agents")
    j = checked_join(verbs, told, ["word"])
    return j.select("sent", "pos", "pronoun", "person", "number", "gender", F.when(F.col("pronoun").isNull(), "Zero").otherwise("Hypothesis").alias("proof"))


# -- the oracle -------------------------------------------------------------------------------------------------------------------

_R = f"(WITH {READINGS_SQL} SELECT id, word FROM read_words)"
_DECIDED = f"""decided AS MATERIALIZED (SELECT DISTINCT r.word, c.class, c.proof, g.proof AS segmentation, c.source IN ('pattern', 'surface_verb', 'default') AS needs_context, coalesce(k.kind = 'PV|N', false) AND c.source = 'pattern' AS ambiguous
  FROM {_R} r JOIN ({M13_SQL}) c USING (id) JOIN ({G11}) g USING (id) LEFT JOIN (WITH {ALIGNED_SQL} SELECT word, kind FROM best) k ON k.word = r.word)"""


def _said(side: str, d: str) -> str:
    return f"CASE WHEN {d}.segmentation = 'Zero' THEN '{side}_is_fragment' END, CASE WHEN {d}.proof = 'Hypothesis' AND {d}.needs_context THEN '{side}_hypothesis_needs_context' END, CASE WHEN {d}.ambiguous AND {d}.proof <> 'Certificate' THEN '{side}_ambiguous_uncertified' END"


_GATED = f"""{_EDGES}, {_DECIDED}, gated AS (SELECT e.sent, e.name, e.source, e.target, concat_ws(',', {_said("source", "s")}, {_said("target", "t")}) AS reasons
  FROM edges e LEFT JOIN toks a ON a.sent = e.sent AND a.pos = e.source LEFT JOIN decided s ON s.word = a.surface LEFT JOIN toks b ON b.sent = e.sent AND b.pos = e.target LEFT JOIN decided t ON t.word = b.surface)"""
F30 = f"WITH {_GATED} SELECT *, reasons <> '' AS would_block FROM gated"
A23 = f"WITH {_GATED} SELECT name, reason, count(*) AS n FROM (SELECT name, unnest(string_split(CASE WHEN reasons = '' THEN 'passed' ELSE reasons END, ',')) AS reason FROM gated) GROUP BY ALL"
F31 = f"""WITH {_EDGES}, {_DECIDED}, v AS (SELECT t.surface AS word, concat_ws(',', CASE WHEN d.proof IS NULL THEN 'verb_decision_missing' END, CASE WHEN d.class <> 'VERB' OR d.proof <> 'Certificate' THEN 'not_certified_verb:' || d.class || '/' || d.proof END, {_said("verb", "d")}, CASE WHEN d.segmentation <> 'Certificate' THEN 'segmentation_status:' || d.segmentation END) AS reasons
  FROM toks t LEFT JOIN decided d ON d.word = t.surface WHERE t.class = 'VERB') SELECT word, reasons, reasons <> '' AS would_block, count(*) AS events FROM v GROUP BY ALL"""
_P = f"regexp_replace({{0}}, '[{ar.ALL_MARKS}]', '', 'g')"
_CLAIMED = f"""{MEANINGS.sql()}, w AS (SELECT DISTINCT word, {_P.format("word")} AS plain FROM {_R} WHERE word <> ''),
said AS (SELECT w.word, m.* FROM w JOIN operator_meanings m ON m.place = 'start' AND length(plain) > 1 AND left(plain, 1) = operator OR m.place = 'end' AND length(plain) > 1 AND right(plain, 1) = operator OR m.place = 'word' AND word = form
  OR m.place = 'word' AND plain = operator AND word NOT IN (SELECT form FROM operator_meanings WHERE place = 'word')),
parts AS (SELECT DISTINCT r.word, g.prefixes, g.stem, g.suffixes, list_filter(list_concat(string_split(g.prefixes, '+'), string_split(g.suffixes, '+')), lambda x: x <> '') AS pieces, list_filter(string_split(g.tags, '+'), lambda x: x <> '') AS tags FROM {_R} r JOIN ({G11}) g USING (id)),
needs AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in NEEDS_PREFIX.items())}) AS n(topic, needed)),
told AS (
  SELECT s.word, operator, s.topic, meaning, CASE WHEN s.topic IN {NEVER_TOPICS} THEN 'topic_' || s.topic || '_needs_oath_context' WHEN meaning IN {NEVER_MEANINGS} THEN 'meaning_' || meaning || '_has_no_evidence'
    WHEN needed IS NOT NULL THEN CASE WHEN NOT list_bool_or(list_concat([false], list_transform(range(1, len(pieces) + 1), lambda i: tags[i] = needed AND starts_with({_P.format("pieces[i]")}, operator)))) THEN 'topic_' || s.topic || '_needs_prefix_' || needed END
    WHEN s.topic = 'PRONOUN' AND length(operator) = 1 THEN CASE WHEN NOT list_bool_or(list_concat([false], list_transform(range(1, len(pieces) + 1), lambda i: tags[i] = 'PRON' AND {_P.format("pieces[i]")} = operator))) THEN 'pronoun_' || operator || '_is_no_suffix' END
    WHEN s.topic IN {STRICT_FORMS} THEN CASE WHEN NOT (form = s.word OR form = stem AND NOT (s.topic = 'JAZM_LA_NAHIYA' AND s.word <> form)) THEN 'strict_form_' || s.topic END END AS reason
  FROM said s JOIN parts p ON p.word = s.word LEFT JOIN needs n ON n.topic = s.topic
)"""
F32 = f"WITH {_CLAIMED} SELECT r.id, operator, topic, meaning, reason IS NULL AS certified, coalesce(reason, '') AS reason FROM told JOIN {_R} r USING (word)"
F33 = f"SELECT topic, count(*) AS checked, count(*) FILTER (certified) AS kept, count(*) FILTER (NOT certified) AS rejected, max(reason) AS last_reason FROM ({F32}) GROUP BY topic"
U04 = f"""WITH {_EDGES}, later AS (SELECT DISTINCT * FROM ({D08})), beats AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PRECEDENCE)}) AS p(winner, loser)),
kept AS (SELECT sent, name, source, target, proof FROM edges e WHERE NOT EXISTS (SELECT 1 FROM later l JOIN beats b ON b.winner = l.name WHERE l.sent = e.sent AND l.source = e.source AND b.loser = e.name))
SELECT * FROM kept UNION ALL SELECT sent, name, source, target, proof FROM later l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.sent = l.sent AND k.name = l.name AND k.source = l.source AND k.target = l.target)"""
W27 = f"""WITH {_EDGES}, {IMPLICIT_AGENTS.sql()},
affixes AS (
  SELECT DISTINCT r.word, coalesce(nullif({_P.format("imperfect")}, ''), nullif(imperative, ''), CASE WHEN lam_amr <> '' THEN left(stem, 1) ELSE '' END) AS letter, subject, subject2, number AS plural, pronoun, pronoun2 FROM {_R} r JOIN ({G11}) g USING (id) JOIN ({M13_SQL}) c USING (id) WHERE c.class = 'VERB'
),
ended AS (SELECT word, letter, {_P.format("coalesce(nullif(subject, ''), nullif(subject2, ''), nullif(plural, ''), CASE WHEN letter = '' THEN CASE WHEN pronoun2 <> '' THEN pronoun2 WHEN pronoun = 'نَا' THEN pronoun END END, '')")} AS ending FROM affixes),
who AS (SELECT e.word, coalesce(a.pronoun, b.pronoun) AS pronoun, CASE WHEN a.pronoun IS NULL THEN b.person ELSE a.person END AS person, CASE WHEN a.pronoun IS NULL THEN b.number ELSE a.number END AS number, CASE WHEN a.pronoun IS NULL THEN b.gender ELSE a.gender END AS gender
  FROM ended e LEFT JOIN implicit_agents a ON a.letter = e.letter AND a.ending = e.ending LEFT JOIN implicit_agents b ON b.letter = e.letter AND b.ending = '' AND b.letter <> '')
SELECT t.sent, t.pos, w.pronoun, w.person, w.number, w.gender, CASE WHEN w.pronoun IS NULL THEN 'Zero' ELSE 'Hypothesis' END AS proof FROM toks t LEFT JOIN who w ON w.word = t.surface
WHERE t.class = 'VERB' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.name = 'agent_of' AND e.proof <> 'Zero' AND e.sent = t.sent AND e.target = t.pos)"""

QUERIES = {"f30_relation_gate": f30_relation_gate, "a23_relation_audit": a23_relation_audit, "f31_event_gate": f31_event_gate, "f32_certified_claims": f32_certified_claims, "f33_claim_counts": f33_claim_counts, "u04_edges": u04_edges, "w27_implicit_agents": w27_implicit_agents}
ORACLE = {"f30_relation_gate": F30, "a23_relation_audit": A23, "f31_event_gate": F31, "f32_certified_claims": F32, "f33_claim_counts": F33, "u04_edges": U04, "w27_implicit_agents": W27}
