"""Ambiguous words decided by their neighbours.

Decision tables state, word by word and in order, which conditions on the neighbours decide what. Conditions are names of
features; each feature is a column over the three tokens before and the four behind, and a table compiles to one ordered
CASE. A word that no table knows is an error, not a guess. A decision replaces a word's class only where it is certain; any
other one is kept beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.morphology import M13_SQL, classes
from rulelens.plans.joins import checked_join, large_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL
from rulelens.sources.rules import Rules, Table
from rulelens.sources.sequences import PAUSE, SEQUENCES_SQL, read_sentences

#: Which table decides a form, with and without marks. Fixed values.
TARGETS = Table("context_targets", "form word", "string string", tuple(
    (form, word) for word, forms in (
        ("MIN", "مِنْ مِن مِنَ"), ("MAN", "مَن مَنْ من"), ("MA", "مَا ما"), ("AYY", "أَيُّ أَيَّ أَيِّ أي"), ("MATA", "مَتَى متى"), ("AYNA", "أَيْنَ أين"), ("ANNA", "أَنَّى أنى"), ("HAYTHU", "حَيْثُ حيث"), ("BIMA", "بِمَا بما"),
    ) for form in map(ar.ordered, forms.split())
))
#: Decisions: word, order, condition (features joined by AND, ``not`` before one), class, function, proof, reason. Fixed values.
_QUESTION, _ANSWERED, _JUSSIVE = "question_before", "next_jussive AND answer_behind", "next_jussive"
DECISIONS = Table("context_decisions", "word nr condition class function proof reason", "string int string string string string string", tuple(
    (word, nr, *row) for word, rows in {
        "MIN": (("", "HARF", "prepositional_phrase_component", "Certificate", "kasra"),),
        "MAN": (
            (_QUESTION, "ISM_MABNI", "interrogative_tool", "Certificate", "question_context"), (_ANSWERED, "ISM_MABNI", "conditional_tool", "Certificate", "jussive_and_answer"), (_JUSSIVE, "ISM_MABNI", "conditional_tool", "Hypothesis", "jussive_only"),
            ("next_present", "ISM_MAWSOOL", "relative_pronoun", "Hypothesis", "before_verb"), ("next_past", "ISM_MAWSOOL", "relative_pronoun", "Hypothesis", "before_verb"), ("", "ISM_MABNI", "unresolved_ambiguous", "Hypothesis", "insufficient_context"),
        ),
        "MA": (
            (_QUESTION, "ISM_MABNI", "interrogative_tool", "Certificate", "question_context"), (_ANSWERED, "ISM_MABNI", "conditional_tool", "Certificate", "jussive_and_answer"), (_JUSSIVE, "ISM_MABNI", "conditional_tool", "Hypothesis", "jussive_only"),
            ("next_past AND not preposition_before", "HARF", "negative_particle", "Hypothesis", "before_past_verb"), ("next_present", "ISM_MAWSOOL", "relative_pronoun", "Hypothesis", "before_verb"), ("preposition_before", "HARF", "extra_particle", "Hypothesis", "after_preposition"),
            ("", "ISM_MABNI", "unresolved_ambiguous", "Hypothesis", "insufficient_context"),
        ),
        "AYY": (
            (_QUESTION, "ISM_MUARAB", "interrogative_tool", "Certificate", "question_context"), (_ANSWERED, "ISM_MUARAB", "conditional_tool", "Certificate", "jussive_and_answer"), ("next_genitive", "ISM_MUARAB", "interrogative_tool", "Hypothesis", "before_genitive"),
            ("next_article", "ISM_MUARAB", "interrogative_tool", "Hypothesis", "before_genitive"), ("", "ISM_MUARAB", "unresolved_ambiguous", "Hypothesis", "insufficient_context"),
        ),
        **{word: (
            (_QUESTION, "ISM_MABNI", "interrogative_tool", "Certificate", "question_context"), (_ANSWERED, "ISM_MABNI", "conditional_tool", "Certificate", "jussive_and_answer"), (_JUSSIVE, "ISM_MABNI", "conditional_tool", "Hypothesis", "jussive_only"), ("", "ISM_MABNI", function, "Hypothesis", "default"),
        ) for word, function in (("MATA", "temporal_adverb"), ("AYNA", "locative_adverb"), ("ANNA", "locative_adverb"))},
        "HAYTHU": ((_JUSSIVE, "ISM_MABNI", "conditional_tool", "Hypothesis", "jussive_only"), ("", "ISM_MABNI", "locative_adverb", "Hypothesis", "default")),
        "BIMA": (("", "HARF", "prepositional_phrase_component", "Certificate", "preposition_and_ma"),),
    }.items() for nr, row in enumerate(rows)
))

#: Shapes of neighbours. Fixed values.
QUESTION_WORDS = ("قال", "قل", "قالوا", "يقول", "سال", "يسال", "يسالون", "اسال", "هل", "ا")
PREPOSITIONS = ("من", "الى", "عن", "على", "في", "ب", "ل", "ك", "مع")
_PRESENT, _NO_PRESENT = "^[يتنأ][َُْ]", ("يوم", "يا", "يومئذ")
_PAST_END, _VOWEL_END = "(َ|ْ|ا|وا|ت)$", "[ًٌٍَُِا]$"
#: How far back a question tells, and how far behind a condition its answer may stand.
QUESTION_REACH, ANSWER_REACH = 3, 4


def _key(x: Column) -> Column:
    return F.translate(ar.strip_all(x), "ٱآأإ", "اااا")


def features(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` with the features of their neighbours: 16 columns that conditions may name.

    Pauses are no neighbours. A feature of a neighbour that isn't there is false.
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    t = tokens.where(F.col("surface") != PAUSE)
    near = {"n1": F.lead("surface", 1).over(by), "n2": F.lead("surface", 2).over(by), "n3": F.lead("surface", 3).over(by), "n4": F.lead("surface", 4).over(by), "n5": F.lead("surface", 5).over(by), "p1": F.lag("surface", 1).over(by), "p2": F.lag("surface", 2).over(by), "p3": F.lag("surface", 3).over(by)}
    t = t.withColumns(near)
    sure = lambda c: F.coalesce(c, F.lit(False))
    bare = _key(F.col("n1"))
    present = sure(F.col("n1").rlike(_PRESENT) & (F.length("n1") >= 3) & ~bare.isin(*_NO_PRESENT))
    past = sure(~present & F.length(bare).between(3, 7) & ~bare.startswith("ا") & F.col("n1").rlike(_PAST_END))
    any_of = lambda columns, test: reduce(lambda a, b: a | b, [sure(test(F.col(c))) for c in columns])
    question = lambda x: _key(x).isin(*QUESTION_WORDS)
    out = {
        "next_present": present, "next_past": past, "next_jussive": present & sure(~F.col("n1").rlike(_VOWEL_END)), "next_genitive": ~present & ~past & sure(F.col("n1").rlike("[ٍِ]$")), "next_article": sure(F.col("n1").rlike("^[اٱ]ل")),
        "question_before": any_of(("p1", "p2", "p3"), question), "preposition_before": any_of(("p1",), lambda x: _key(x).isin(*PREPOSITIONS)), "answer_behind": any_of(("n2", "n3", "n4", "n5"), lambda x: x.startswith("ف")),
        "first": F.col("p1").isNull(), "last": F.col("n1").isNull(), "negation_before": any_of(("p1",), lambda x: _key(x).isin("لا", "ما", "لم", "لن")), "and_before": any_of(("p1",), lambda x: x.rlike("^[وف]َ")),
    }
    out["prohibits"] = sure((_key(F.col("surface")) == "لا") & out["next_present"])
    return t.withColumns(out).drop("n2", "n3", "n4", "n5", "p2", "p3")


def _holds(condition: str) -> Column:
    parts = [p.strip() for p in condition.split(" AND ") if p.strip()]
    return reduce(lambda a, b: a & b, [~F.col(p[4:]) if p.startswith("not ") else F.col(p) for p in parts], F.lit(True))


def compiled(field: str, rows: list[tuple]) -> Column:
    """The field of the first decision that holds, word by word, as one CASE. ``rows`` are those of ``DECISIONS``."""
    at = DECISIONS.columns.split().index(field)
    out = None
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        condition = (F.col("_word") == row[0]) & _holds(row[2] or "")
        out = F.when(condition, F.lit(row[at])) if out is None else out.when(condition, F.lit(row[at]))
    return out if out is not None else F.lit(None).cast("string")


def decide(tokens: DataFrame, keys: list[str], rules: Rules | None = None) -> DataFrame:
    """``keys``, pos, surface, word, class, function, proof, reason, embedded of each token that a table decides.

    A form is looked up with its marks first, then without. ``embedded`` is what the table of ``ma`` says inside "bima".
    """
    spark, rules = tokens.sparkSession, rules or Rules()
    rows = [tuple(r) for r in rules.frame(spark, DECISIONS).limit(10_000).collect()]
    unknown = {p.removeprefix("not ") for r in rows for p in (r[2] or "").split(" AND ") if p} - set(FEATURES)
    if unknown:
        raise ValueError(f"no such features: {', '.join(sorted(unknown))}")
    targets = rules.frame(spark, TARGETS)
    f = features(tokens, keys)
    f = f.join(F.broadcast(targets.select(F.col("form").alias("surface"), F.col("word").alias("_w0"))), "surface", "left")
    plain = targets.where(~F.col("form").rlike("[ً-ْ]")).select(_key(F.col("form")).alias("_k"), F.col("word").alias("_w1")).distinct()
    f = f.withColumn("_k", F.when(F.col("_w0").isNull() & ~F.col("surface").rlike("[ً-ْ]"), _key(F.col("surface")))).join(F.broadcast(plain), "_k", "left")
    f = f.withColumn("_word", F.coalesce("_w0", "_w1")).where("_word is not null")
    told = {c: compiled(c, rows) for c in ("class", "function", "proof", "reason")}
    inner = compiled("function", [("BIMA", *r[1:]) for r in rows if r[0] == "MA"])
    return f.select(*keys, "pos", "surface", F.col("_word").alias("word"), *[c.alias(n) for n, c in told.items()], F.when(F.col("_word") == "BIMA", inner).alias("embedded"))


FEATURES = ("next_present", "next_past", "next_jussive", "next_genitive", "next_article", "question_before", "preposition_before", "answer_behind", "first", "last", "negation_before", "and_before", "prohibits")


def resolve(spark: SparkSession, surface: str, before: tuple[str, ...] = (), behind: tuple[str, ...] = (), rules: Rules | None = None) -> dict:
    """The decision on one word between its neighbours; a word without a table is an error."""
    line = [*before, surface, *behind]
    tokens = spark.createDataFrame([(0, k, ar.ordered(w)) for k, w in enumerate(line)], "sent int, pos int, surface string")
    found = decide(tokens, ["sent"], rules).where(F.col("pos") == len(before)).collect()
    if not found:
        raise ValueError(f"no decision table for {surface}")
    return found[0].asDict()


def enriched(tokens: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` (with class and proof) with the decisions: a certain one replaces the class, any other stands beside it."""
    d = decisions.select(*keys, "pos", F.col("class").alias("_c"), "function", F.col("proof").alias("_p"))
    j = large_join(tokens, d, [*keys, "pos"], "left")
    sure = F.coalesce(F.col("_p") == "Certificate", F.lit(False))
    return j.withColumns({"resolved_class": F.when(sure, F.col("_c")).otherwise(F.col("class")), "resolved_proof": F.when(sure, "Certificate").otherwise(F.col("proof")), "context_proof": F.col("_p")}).drop("_c", "_p")


def m27_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tables say of every ambiguous word of every sentence."""
    return decide(read_sentences(spark, sf_dir), ["row", "doc_id", "sent"]).drop("row")


def m26_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by class before and after their contexts decided, with the prohibitions among them."""
    keys = ["row", "doc_id", "sent"]
    tokens = save(read_sentences(spark, sf_dir).where(F.col("surface") != PAUSE), "context-tokens")
    told = classes(tokens.select(F.col("surface").alias("word"))).select(F.col("word").alias("surface"), "class", "proof")
    known = checked_join(tokens, save(told, "context-classes"), ["surface"], "inner")
    e = large_join(enriched(known, decide(tokens, keys), keys), features(tokens, keys).where("prohibits").select(*keys, "pos", F.lit("prohibition").alias("mood")), [*keys, "pos"], "left")
    return e.groupBy("class", "resolved_class", "resolved_proof", "function", "context_proof", "mood").agg(F.count("*").alias("n"))


def _k(x: str) -> str:
    return f"translate(regexp_replace({x}, '[{ar.ALL_MARKS}]', '', 'g'), 'ٱآأإ', 'اااا')"


def _case(field: str, rows: list[tuple]) -> str:
    at = DECISIONS.columns.split().index(field)
    when = lambda r: " AND ".join([f"word = '{r[0]}'", *[("NOT " + p[4:]) if p.startswith("not ") else p for p in r[2].split(" AND ") if p]])
    return "CASE " + " ".join(f"WHEN {when(r)} THEN '{r[at]}'" for r in rows) + " END"


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_FEATURES_SQL = f"""{SEQUENCES_SQL}, {TARGETS.sql()},
wordy AS (SELECT * FROM seqs WHERE surface <> '{PAUSE}'),
near AS (SELECT *, lead(surface) OVER w AS n1, list(surface) OVER (PARTITION BY row, sent ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND {ANSWER_REACH + 1} FOLLOWING) AS far, list(surface) OVER (PARTITION BY row, sent ORDER BY pos ROWS BETWEEN {QUESTION_REACH} PRECEDING AND 1 PRECEDING) AS past_ones, lag(surface) OVER w AS p1 FROM wordy WINDOW w AS (PARTITION BY row, sent ORDER BY pos)),
shaped AS (SELECT *, coalesce(regexp_matches(n1, '{_PRESENT}') AND length(n1) >= 3 AND {_k("n1")} NOT IN {_IN(_NO_PRESENT)}, false) AS next_present FROM near),
timed AS (SELECT *, coalesce(NOT next_present AND length({_k("n1")}) BETWEEN 3 AND 7 AND NOT starts_with({_k("n1")}, 'ا') AND regexp_matches(n1, '{_PAST_END}'), false) AS next_past FROM shaped),
featured AS (
  SELECT *, next_present AND coalesce(NOT regexp_matches(n1, '{_VOWEL_END}'), false) AS next_jussive, NOT next_present AND NOT next_past AND coalesce(regexp_matches(n1, '[ٍِ]$'), false) AS next_genitive, coalesce(regexp_matches(n1, '^[اٱ]ل'), false) AS next_article,
    coalesce(list_bool_or(list_transform(past_ones, lambda x: {_k("x")} IN {_IN(QUESTION_WORDS)})), false) AS question_before, coalesce({_k("p1")} IN {_IN(PREPOSITIONS)}, false) AS preposition_before, coalesce(list_bool_or(list_transform(far, lambda x: starts_with(x, 'ف'))), false) AS answer_behind,
    coalesce({_k("surface")} = 'لا' AND next_present, false) AS prohibits FROM timed
),
targeted AS (SELECT f.*, t.word FROM featured f JOIN context_targets t ON t.form = f.surface),
decided AS (SELECT doc_id, row, sent, pos, surface, word, {_case("class", list(DECISIONS.rows))} AS class, {_case("function", list(DECISIONS.rows))} AS function, {_case("proof", list(DECISIONS.rows))} AS proof, {_case("reason", list(DECISIONS.rows))} AS reason,
  CASE WHEN word = 'BIMA' THEN {_case("function", [("BIMA", *r[1:]) for r in DECISIONS.rows if r[0] == "MA"])} END AS embedded FROM targeted)"""
M27 = f"WITH {_FEATURES_SQL} SELECT * EXCLUDE (row) FROM decided"
M26 = f"""WITH {_FEATURES_SQL}, said AS (SELECT DISTINCT r.word AS surface, c.class, c.proof FROM (WITH {READINGS_SQL} SELECT id, word FROM read_words) r JOIN ({M13_SQL}) c USING (id))
SELECT s.class, CASE WHEN d.proof = 'Certificate' THEN d.class ELSE s.class END AS resolved_class, CASE WHEN d.proof = 'Certificate' THEN 'Certificate' ELSE s.proof END AS resolved_proof, d.function, d.proof AS context_proof, CASE WHEN f.prohibits THEN 'prohibition' END AS mood, count(*) AS n
FROM featured f JOIN said s ON s.surface = f.surface LEFT JOIN decided d ON d.row = f.row AND d.sent = f.sent AND d.pos = f.pos GROUP BY ALL"""

QUERIES = {"m27_context": m27_context, "m26_tokens": m26_tokens}
ORACLE = {"m27_context": M27, "m26_tokens": M26}
