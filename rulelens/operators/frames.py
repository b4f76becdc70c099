"""Frames of speech along a sentence, one inside another, and two tokenisations laid side by side.

A verb of speaking opens a frame; so does a call where none is open. What stands before a frame stays open around it: the
number of openers up to a token is its depth, the frame before is the parent. Speaker and addressee are the first fitting
tokens of a frame, so one running sum and one grouping find them all. Commanded speech holds a frame of its own: who is
told to speak there speaks to an audience.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.functions.arrays import let
from rulelens.plans.joins import large_join
from rulelens.sources.rules import Rules, Table
from rulelens.sources.sequences import PAUSE, SEQUENCES_SQL, read_pieces, read_sentences, sentence_rows

#: Verbs of speaking by stripped form, with person, number and the type of speech they open. Fixed values.
SPEECH_VERBS = Table("speech_verbs", "plain person number type", "string string string string", (
    ("قال", "3", "SG", "direct"), ("قالت", "3", "SG", "direct"), ("قالوا", "3", "PL", "direct"), ("قلت", "1", "SG", "direct"), ("قلنا", "1", "PL", "direct"), ("يقول", "3", "SG", "direct"), ("تقول", "2", "SG", "direct"), ("يقولون", "3", "PL", "direct"), ("نقول", "1", "PL", "direct"),
    ("قل", "2", "SG", "commanded_speech"), ("قولوا", "2", "PL", "commanded_speech"), ("نادى", "3", "SG", "vocative"), ("ينادي", "3", "SG", "vocative"), ("ينادون", "3", "PL", "vocative"), ("سأل", "3", "SG", "direct"), ("أجاب", "3", "SG", "direct"),
))
#: Particles of calling. Fixed values.
VOCATIVES = Table("vocative_particles", "plain", "string", (("يا",), ("أيا",), ("هيا",), ("ياأيها",), ("أيها",)))

_LEAD = "^(وس|فس|و|ف|س|ل)"
#: A noun after "to": with the article, or a word of three letters or more that is no negation.
_TO = "^(لل..|ل[^امنيتكعو].)"
IMPLICIT = "(implicit)"
AUDIENCE = "(audience)"


def _plain(x: Column) -> Column:
    return F.translate(ar.strip_all(x), "ٱ", "ا")


def speech_frames(tokens: DataFrame, keys: list[str], rules: Rules | None = None) -> DataFrame:
    """``keys`` with frame, type, introduced_by, start, speaker, speaker_kind, addressee, addressee_kind, parent, depth, confidence, utterance.

    ``tokens`` has a sentence's keys, pos and surface. Frames are numbered from 0; ``parent`` is the frame around, null
    for the outermost; the frame inside commanded speech has half a number more than its outer one. Sentences without a
    verb of speaking or a call have no frame; pauses and null surfaces are no one.
    """
    spark, by = tokens.sparkSession, Window.partitionBy(*keys).orderBy("pos", "surface")
    verbs, few = (rules or Rules()).lookup(spark, SPEECH_VERBS, "plain")
    calls, _ = (rules or Rules()).lookup(spark, VOCATIVES, "plain")
    side = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    t = tokens.where(F.col("surface").isNotNull() & (F.col("surface") != PAUSE)).select(*keys, "pos", "surface", _plain(F.col("surface")).alias("plain"))
    t = t.withColumn("bare", F.regexp_replace("plain", _LEAD, "")).withColumn("led", F.regexp_replace("plain", "^[وف]", ""))
    named = verbs.select(F.col("plain").alias("_p"), F.struct("person", "number", "type").alias("v"))
    t = t.join(side(named.select("_p", F.col("v").alias("v0"))), F.col("plain") == F.col("_p"), "left").drop("_p").join(side(named.select("_p", F.col("v").alias("v1"))), F.col("bare") == F.col("_p"), "left").drop("_p")
    told = calls.select(F.col("plain").alias("_p"), F.lit(True).alias("c"))
    t = t.join(side(told.select("_p", F.col("c").alias("c0"))), F.col("plain") == F.col("_p"), "left").drop("_p").join(side(told.select("_p", F.col("c").alias("c1"))), F.col("led") == F.col("_p"), "left").drop("_p")
    t = t.withColumns({"verb": F.coalesce("v0", "v1"), "call": F.coalesce("c0", "c1", F.lit(False))})
    t = t.withColumns({"call": F.col("call") & F.col("verb").isNull(), "to": F.col("verb").isNull() & F.col("plain").rlike(_TO)})
    speaks = F.col("verb").isNotNull()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # A call opens a frame only where nothing has opened one yet.
    opened = F.coalesce(F.max((speaks | F.col("call")).cast("int")).over(before), F.lit(0)) > 0
    t = t.withColumns({"opens": speaks | (F.col("call") & ~opened), "called": F.coalesce(F.lag("call").over(by), F.lit(False))})
    t = t.withColumn("frame", F.sum(F.col("opens").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("frame >= 0")
    inside = ~F.col("opens")
    at = F.struct("pos", "surface")
    free = inside & ~F.col("to") & ~F.col("call") & ~F.col("called") & ~speaks  # one who is called does not speak
    f = t.groupBy(*keys, "frame").agg(
        F.min(F.when(F.col("opens"), F.struct("pos", "surface", "verb"))).alias("o"),
        F.min(F.when(free, at)).alias("subject"), F.min(F.when(inside & (F.col("to") | F.col("called")), F.struct("pos", "surface", "to"))).alias("to"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(inside, at))), lambda x: x["surface"]), " ").alias("utterance"),
    )
    verb = F.col("o.verb")
    plural = (verb["number"] == "PL") | _plain(F.col("o.surface")).rlike("(وا|نا|تم)$")
    expects = F.coalesce((verb["person"] == "3") & ~plural, F.lit(False))
    subject = F.when(expects, F.col("subject"))
    f = f.select(*keys, "frame", F.coalesce(verb["type"], F.lit("vocative")).alias("type"), F.col("o.surface").alias("introduced_by"), F.col("o.pos").alias("start"), subject["surface"].alias("_subject"), verb["person"].alias("person"), F.col("to").alias("_to"), "utterance")
    commanded = F.col("type") == "commanded_speech"
    speaker = F.coalesce("_subject", F.when(F.col("person").isin("1", "3") | commanded, IMPLICIT))
    speaker_kind = F.when(F.col("_subject").isNotNull(), "explicit").when(commanded, "implicit_supersentential").when(F.col("person").isin("1", "3"), "implicit")
    f = f.select(
        *keys, F.col("frame").cast("double").alias("frame"), "type", "introduced_by", "start", speaker.alias("speaker"), speaker_kind.alias("speaker_kind"), F.coalesce(F.col("_to.surface"), F.when(commanded, IMPLICIT)).alias("addressee"),
        F.when(F.col("_to.to"), "addressee_match").when(F.col("_to").isNotNull(), "vocative_match").when(commanded, "implicit").alias("addressee_kind"), F.when(F.col("frame") > 0, F.col("frame").cast("double") - 1).alias("parent"), (F.col("frame") + 1).cast("int").alias("depth"),
        F.when(F.col("_to.to") | F.col("person").isNull(), "high").otherwise("medium").alias("confidence"), "utterance",
    )
    inner = f.where("type = 'commanded_speech'").select(
        *keys, (F.col("frame") + 0.5).alias("frame"), F.lit("commanded_speech_inner").alias("type"), "introduced_by", "start", F.col("addressee").alias("speaker"), F.lit("outer_addressee").alias("speaker_kind"), F.lit(AUDIENCE).alias("addressee"), F.lit("implicit").alias("addressee_kind"),
        F.col("frame").alias("parent"), (F.col("depth") + 1).alias("depth"), F.lit("medium").alias("confidence"), "utterance",
    )
    return f.unionByName(inner)


def d28_frames(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """Every frame of every sentence."""
    return speech_frames(read_sentences(spark, sf_dir), ["row", "doc_id", "sent"], rules).drop("row")


_PLAIN_SQL = f"translate(regexp_replace({{0}}, '[{ar.ALL_MARKS}]', '', 'g'), 'ٱ', 'ا')"
D28 = f"""WITH {SEQUENCES_SQL}, {SPEECH_VERBS.sql()}, {VOCATIVES.sql()},
t AS (SELECT row, doc_id, sent, pos, surface, {_PLAIN_SQL.format("surface")} AS plain FROM seqs WHERE surface <> '{PAUSE}'),
v AS (
  SELECT t.*, coalesce(a.person, b.person) AS person, coalesce(a.number, b.number) AS number, coalesce(a.type, b.type) AS type, (c.plain IS NOT NULL OR d.plain IS NOT NULL) AND a.plain IS NULL AND b.plain IS NULL AS call,
    coalesce(a.plain, b.plain) IS NULL AND regexp_matches(t.plain, '{_TO}') AS to_
  FROM t LEFT JOIN speech_verbs a ON a.plain = t.plain LEFT JOIN speech_verbs b ON b.plain = regexp_replace(t.plain, '{_LEAD}', '') LEFT JOIN vocative_particles c ON c.plain = t.plain LEFT JOIN vocative_particles d ON d.plain = regexp_replace(t.plain, '^[وف]', '')
),
ranked AS (SELECT *, row_number() OVER w AS n, lag(call) OVER w AS called, min(CASE WHEN type IS NOT NULL OR call THEN pos END) OVER (PARTITION BY row, sent) AS first_open FROM v WINDOW w AS (PARTITION BY row, sent ORDER BY pos)),
opened AS (SELECT *, type IS NOT NULL OR call AND pos = first_open AS opens FROM ranked),
framed AS (SELECT *, sum(opens::INT) OVER (PARTITION BY row, sent ORDER BY pos) - 1 AS frame FROM opened),
heads AS (SELECT * FROM framed WHERE opens),
bodies AS (SELECT * FROM framed WHERE frame >= 0 AND NOT opens),
subjects AS (
  SELECT h.row, h.sent, h.frame, min(b.pos) AS pos FROM heads h JOIN bodies b ON b.row = h.row AND b.sent = h.sent AND b.frame = h.frame
  WHERE h.person = '3' AND h.number <> 'PL' AND NOT regexp_matches(h.plain, '(وا|نا|تم)$') AND NOT b.to_ AND NOT b.call AND NOT b.called GROUP BY ALL
),
spoken AS (SELECT b.row, b.sent, b.frame, min(b.pos) AS pos FROM bodies b WHERE b.to_ OR b.called GROUP BY ALL),
said AS (SELECT row, sent, frame, string_agg(surface, ' ' ORDER BY pos) AS utterance FROM bodies GROUP BY ALL),
f AS (
  SELECT h.doc_id, h.sent, h.row, h.frame::DOUBLE AS frame, coalesce(h.type, 'vocative') AS type, h.surface AS introduced_by, h.pos AS start, sb.surface AS subject, h.person, ad.surface AS spoken, ad.to_ AS by_to, coalesce(utterance, '') AS utterance
  FROM heads h LEFT JOIN subjects s USING (row, sent, frame) LEFT JOIN spoken a USING (row, sent, frame) LEFT JOIN framed sb ON sb.row = h.row AND sb.sent = h.sent AND sb.pos = s.pos LEFT JOIN framed ad ON ad.row = h.row AND ad.sent = h.sent AND ad.pos = a.pos LEFT JOIN said USING (row, sent, frame)
),
outer_ AS (
  SELECT doc_id, sent, frame, type, introduced_by, start, coalesce(subject, CASE WHEN person IN ('1', '3') OR type = 'commanded_speech' THEN '{IMPLICIT}' END) AS speaker, CASE WHEN subject IS NOT NULL THEN 'explicit' WHEN type = 'commanded_speech' THEN 'implicit_supersentential' WHEN person IN ('1', '3') THEN 'implicit' END AS speaker_kind,
    coalesce(spoken, CASE WHEN type = 'commanded_speech' THEN '{IMPLICIT}' END) AS addressee, CASE WHEN by_to THEN 'addressee_match' WHEN spoken IS NOT NULL THEN 'vocative_match' WHEN type = 'commanded_speech' THEN 'implicit' END AS addressee_kind,
    CASE WHEN frame > 0 THEN frame - 1 END AS parent, (frame + 1)::INT AS depth, CASE WHEN by_to OR person IS NULL THEN 'high' ELSE 'medium' END AS confidence, utterance FROM f
)
SELECT * FROM outer_ UNION ALL SELECT doc_id, sent, frame + 0.5, 'commanded_speech_inner', introduced_by, start, addressee, 'outer_addressee', '{AUDIENCE}', 'implicit', frame, depth + 1, 'medium', utterance FROM outer_ WHERE type = 'commanded_speech'"""

# -- realignment ------------------------------------------------------------------------------------------------------------


def realigned(pieces: Column, tokens: Column) -> Column:
    """(nth, surface) of the tokens that a pause stands before, as an array; ``pieces`` and ``tokens`` are arrays of surfaces.

    Pieces that are pauses are no words. The k-th word lies beside the k-th token. Where they are the same, a pause since the
    last place at which they were the same marks the token; where a tokeniser joined or cut words they differ, and the pause
    is kept for the next place where they agree again. Null pieces are passed over.
    """
    known = F.filter(pieces, lambda x: x.isNotNull())
    placed = F.transform(known, lambda x, at: F.struct(x.alias("surface"), at.alias("at")))
    words = F.filter(placed, lambda x: ~x["surface"].rlike("^[ۖۗۘۙۚۛۜ۝۞،؛.؟!]+$"))
    # Before the k-th word stand k words; what else stands before it is pauses.
    beside = lambda toks: F.transform(words, lambda w, k: F.struct(k.alias("nth"), (w["at"] - k).alias("pauses"), (w["surface"] == F.get(toks, k)).alias("same"), w["surface"].alias("surface")))
    same = let(tokens, lambda toks: F.filter(beside(toks), lambda x: x["same"]))
    marked = lambda xs: F.filter(F.transform(xs, lambda x, j: F.struct(x["nth"].alias("nth"), x["surface"].alias("surface"), (x["pauses"] > F.coalesce(F.get(xs, j - 1)["pauses"], F.lit(0))).alias("paused"))), lambda x: x["paused"])
    return F.transform(let(same, marked), lambda x: F.struct(x["nth"].alias("nth"), x["surface"].alias("surface")))


def pauses_before(pieces: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and pos of the tokens that a pause stands before, found by laying the text's pieces beside its tokens.

    ``pieces`` and ``tokens`` have the keys, pos and surface. Both are gathered by their keys once and laid side by side there.
    """
    gathered = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "surface"))).alias(name))
    both = large_join(gathered(pieces, "_pieces"), gathered(tokens, "_tokens"), keys)
    found = both.select(*keys, "_tokens", F.inline(realigned(F.col("_pieces.surface"), F.col("_tokens.surface"))))
    return found.select(*keys, F.get("_tokens", F.col("nth"))["pos"].alias("pos"), "surface")


def cut_words(pieces: Column) -> Column:
    """A tokeniser that drops pauses and cuts "and" from words with the article, on an array of surfaces."""
    parts = lambda x: F.when(x.startswith("وَال"), F.array(F.lit("وَ"), F.substr(x, F.lit(3)))).otherwise(F.array(x))
    return F.flatten(F.transform(F.filter(pieces, lambda x: x != PAUSE), parts))


def w13_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a pause stands before, in every sentence, with tokens cut otherwise than the text's pieces.

    A sentence's pieces stay in its row, so no token is written or shuffled.
    """
    hits = let(read_pieces(spark, F.col("s")), lambda x: realigned(x, cut_words(x)))
    return sentence_rows(spark, sf_dir).select("doc_id", "sent", F.inline(hits)).withColumnRenamed("nth", "pos")


W13 = f"""WITH {SEQUENCES_SQL}, words_ AS (SELECT * FROM seqs WHERE surface <> '{PAUSE}'),
cut AS (SELECT row, doc_id, sent, pos, unnest(l) AS surface, generate_subscripts(l, 1) AS k FROM (SELECT *, CASE WHEN starts_with(surface, 'وَال') THEN ['وَ', substr(surface, 3)] ELSE [surface] END AS l FROM words_)),
toks AS (SELECT row, doc_id, sent, surface, row_number() OVER (PARTITION BY row, sent ORDER BY pos, k) - 1 AS nth FROM cut),
beside AS (SELECT p.row, p.doc_id, p.sent, p.pos, t.surface, t.nth FROM (SELECT *, row_number() OVER (PARTITION BY row, sent ORDER BY pos) - 1 AS nth FROM words_) p JOIN toks t ON t.row = p.row AND t.sent = p.sent AND t.nth = p.nth AND t.surface = p.surface),
gaps AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY row, sent ORDER BY pos), -1) AS since FROM beside)
SELECT doc_id, sent, nth::INT AS pos, surface FROM gaps g WHERE EXISTS (SELECT 1 FROM seqs q WHERE q.row = g.row AND q.sent = g.sent AND q.surface = '{PAUSE}' AND q.pos > g.since AND q.pos < g.pos)"""

QUERIES = {"d28_frames": d28_frames, "w13_pauses": w13_pauses}
ORACLE = {"d28_frames": D28, "w13_pauses": W13}
