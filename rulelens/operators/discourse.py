"""Clauses with their acts, negations and modals, and what neighbouring clauses are to each other.

A sentence's tokens stay in its row; clauses are spans of it and everything said of them is an expression on the span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions.arrays import at, labelled, let
from rulelens.operators.tokens import _CLAUSES, _SQL_TOKENS, CONNECTIVES, clauses, found, sentence_tokens
from rulelens.sources.rules import MARKERS, Table

#: Words that open a question, by language. Fixed values.
QUESTIONS = Table("question_words", "form lang", "string string", tuple((w, lang) for lang, ws in (("en", "what who why how where when"), ("fr", "qui que où quand"), ("de", "wer was wie wo"), ("es", "qué quién cómo que")) for w in ws.split()))
_NEGATIONS = [(r[0], r[1], "negation") for r in MARKERS.rows if r[2] == "negation"]
_MODALS = [(r[0], r[1], r[3]) for r in MARKERS.rows if r[2] == "modal"]
_ASKS = [(r[0], r[1], "question") for r in QUESTIONS.rows]
#: What a clause is to the one before it, by its type; a negation on one side only makes a joined clause a contrast.
RELATIONS = Table("clause_relations", "type relation", "string string", (("condition", "condition_of"), ("complement", "content_of"), ("relative", "describes"), ("coordinate", "joins"), ("main", "follows")))


def described(toks: Column, lang: Column) -> Column:
    """The clauses of a sentence's tokens with act, negated, modal, and relation to the clause before.

    The act is a question if a main clause opens with a question word, a wish if it has a modal, else a statement; the modal is
    the first in the clause.
    """

    def told(spans: Column) -> Column:
        def one(s: Column) -> Column:
            words = F.slice(toks, s["start"] + 1, s["end"] - s["start"] + 1)
            modals = F.filter(F.transform(words, lambda w: labelled(w, lang, _MODALS)), lambda m: m.isNotNull())
            asks = (s["type"] == "main") & F.coalesce(labelled(at(words, F.lit(0)), lang, _ASKS) == "question", F.lit(False))
            modal = F.get(modals, F.lit(0))
            negated = F.exists(words, lambda w: F.coalesce(labelled(w, lang, _NEGATIONS) == "negation", F.lit(False)))
            return F.struct(s["clause"].alias("clause"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), F.when(asks, "question").when(modal.isNotNull(), "wish").otherwise("statement").alias("act"), negated.alias("negated"), modal.alias("modal"))

        return F.transform(spans, one)

    def related(cs: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            before = F.get(cs, k - 1)
            plain = F.lit(None).cast("string")
            for kind, name in RELATIONS.rows:
                plain = F.when(c["type"] == kind, name).otherwise(plain)
            contrast = c["type"].isin("coordinate", "main") & (c["negated"] != before["negated"])
            return F.struct(*[c[x].alias(x) for x in ("clause", "start", "end", "type", "act", "negated", "modal")], F.when(k > 0, F.when(contrast, "contrasts").otherwise(plain)).alias("relation"))

        return F.transform(cs, one)

    return let(let(clauses(toks, lang), told), related)


def d01_clause_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses by language, type, act, negation, modal and relation, with their words."""
    c = found(sentence_tokens(spark, sf_dir), described(F.col("toks"), F.col("lang")), "lang")
    return c.groupBy("lang", "type", "act", "negated", "modal", "relation").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("words"))


_PLAIN = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.rows) + " END"
D01 = f"""WITH {CONNECTIVES.sql()}, {MARKERS.sql()}, {QUESTIONS.sql()}, {_SQL_TOKENS}, {_CLAUSES},
marked AS (SELECT n.doc_id, n.sent_idx, n.lang, n.clause, n.pos, g.form IS NOT NULL AS negates, m.meaning AS modal, q.form IS NOT NULL AS asks FROM n LEFT JOIN markers g ON g.form = n.token AND g.lang = n.lang AND g.kind = 'negation' LEFT JOIN markers m ON m.form = n.token AND m.lang = n.lang AND m.kind = 'modal' LEFT JOIN question_words q ON q.form = n.token AND q.lang = n.lang),
told AS (SELECT doc_id, sent_idx, lang, clause, count(*) AS words, bool_or(negates) AS negated, arg_min(modal, pos) FILTER (modal IS NOT NULL) AS modal, arg_min(asks, pos) AS asks FROM marked GROUP BY ALL),
typed AS (SELECT t.*, c.type, CASE WHEN asks AND c.type = 'main' THEN 'question' WHEN modal IS NOT NULL THEN 'wish' ELSE 'statement' END AS act FROM told t JOIN clauses c USING (doc_id, sent_idx, clause)),
after AS (SELECT *, lag(negated) OVER (PARTITION BY doc_id, sent_idx ORDER BY clause) AS before FROM typed)
SELECT lang, type, act, negated, modal, CASE WHEN before IS NOT NULL THEN CASE WHEN type IN ('coordinate', 'main') AND negated <> before THEN 'contrasts' ELSE {_PLAIN} END END AS relation, count(*) AS n, sum(words)::BIGINT AS words FROM after GROUP BY ALL"""

QUERIES = {"d01_clause_acts": d01_clause_acts}
ORACLE = {"d01_clause_acts": D01}
