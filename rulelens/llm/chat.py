"""Chat formatting in budgeted windows.

Prefix sums of turn tokens (summed in blocks of turns, then over blocks, so that one long conversation is dealt
over many tasks) cut each conversation into turn-aligned spans. A span becomes a window: the system turn, the last
turns of the span before within a history budget, then its own turns; the room for own turns is what the system turn
and the history leave of the budget. A turn that crosses the border of two rooms opens the second one's span if that
fits, else it is a span of its own, so a window stays within its budget unless a single turn does not. Turns that a
window repeats are marked ``again`` and lie outside its loss mask, so every assistant text is a target exactly once.

Control strings in texts cannot be mistaken for the template's: ``&``, ``<`` and ``[`` are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.llm.text import n_words
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.rules import Table

END = "<|end|>\n"
BLOCK = 64
#: Windows of a conversation that meet one copy of its system turn in a task.
SHARE = 1000
#: Tokens that a turn's markers count for.
MARKERS = 4


def escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    for raw, safe in (("[", "&#91;"), ("|", "&#124;"), ("<", "&lt;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(safe), F.lit(raw))
    return x


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Adds idx (a turn's place), system, own_end (tokens up to its end without the system turn), and the
    conversation's room for own turns and for history."""
    inside = Window.partitionBy("_conv", "_block").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    within = save(turns.withColumns({"_idx": F.row_number().over(inside) - 1, "_end": F.sum("tokens").over(upto)}), "chat-turns")
    first = F.max(F.when((F.col("_idx") == 0) & (F.col("role") == "system"), F.col("tokens")))
    blocks = within.groupBy("_conv", "_block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), first.alias("s"))
    order = Window.partitionBy("_conv").orderBy("_block")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0)
    blocks = blocks.select("_conv", "_block", F.coalesce(F.sum("n").over(before), none).alias("n0"), F.coalesce(F.sum("t").over(before), none).alias("t0"), F.coalesce(F.first("s").over(every), none).alias("s"))
    left = F.greatest(none, budget - F.col("s"))
    placed = checked_join(within, save(blocks, "chat-blocks"), ["_conv", "_block"], "inner")
    placed = placed.withColumns({"idx": F.col("_idx") + F.col("n0"), "own_end": F.col("_end") + F.col("t0") - F.col("s"), "history": F.floor(left * history / budget)})
    placed = placed.withColumns({"system": (F.col("idx") == 0) & (F.col("role") == "system"), "room": F.greatest(F.lit(1), left - F.col("history"))})
    return placed.select("_conv", "conv_id", "role", "text", "tokens", "idx", "system", "own_end", "history", "room")


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (spans of ``formatted`` in code points), tokens.

    A turn counts its words and ``MARKERS`` tokens. A window holds at most ``budget`` of them, the repeated system
    turn and history included, unless one turn is larger than the room it has: such a turn is whole and alone in its
    span. History shrinks with what the system turn leaves; where that turn fills the budget by itself, windows hold
    it, one turn each, and no history. Turns are ordered by turn, role and text, nulls first; null roles and texts
    are empty; repeated rows are turns of their own; a null conv_id is a conversation of its own. An empty table
    gives no rows; other columns are ignored.
    """
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("_conv"), "conv_id",
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("_block"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", n_words(F.col("text")) + MARKERS)
    start = F.col("own_end") - F.col("tokens")
    placed = _placed(turns, budget, history).withColumn("_bucket", F.when(F.col("system"), 0).otherwise(F.floor((F.col("own_end") - 1) / F.col("room"))))
    placed = placed.withColumn("_across", ~F.col("system") & (F.floor(start / F.col("room")) < F.col("_bucket")))
    sums = placed.groupBy("_conv", "_bucket").agg(
        F.max(F.when(F.col("_across"), F.col("tokens"))).alias("across"), F.max(F.when(F.col("_across"), F.col("own_end"))).alias("across_end"),
        F.sum(F.when(~F.col("_across") & ~F.col("system"), F.col("tokens"))).alias("inside"), F.max("own_end").alias("last_end"), F.max("room").alias("most"),
    )
    in_order = Window.partitionBy("_conv").orderBy("_bucket")
    split = F.coalesce(F.col("across") + F.col("inside") > F.col("most"), F.lit(False))  # null where one of them is missing
    sums = sums.withColumn("split", split).withColumn("spans", 1 + F.col("split").cast("int"))
    number = F.coalesce(F.sum("spans").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = save(sums.select("_conv", "_bucket", "split", "spans", "across_end", "last_end", number.alias("_number"), F.lead("_bucket").over(in_order).isNotNull().alias("_more")), "chat-spans")
    alone = F.col("split") & F.col("_across")
    dealt = checked_join(placed, spans.drop("spans"), ["_conv", "_bucket"], "inner")
    dealt = dealt.withColumn("window", F.col("_number") + (F.col("split") & ~F.col("_across")).cast("int"))
    again = (alone | F.col("_more")) & (F.when(alone, F.col("across_end")).otherwise(F.col("last_end")) - start <= F.col("history")) & ~F.col("system")
    own = F.array(F.struct(F.col("window"), F.lit(False).alias("again")))
    carried = F.array(F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again")))
    columns = ["_conv", "conv_id", "window", "again", "idx", "role", "text", "tokens"]
    shown = dealt.withColumn("w", F.explode(F.when(again, F.concat(own, carried)).otherwise(own))).select("_conv", "conv_id", "w.window", "w.again", "idx", "role", "text", "tokens")
    # The system turn of every later window; a conversation of many windows has several copies of it to meet.
    later = spans.select("_conv", F.explode(F.sequence(F.col("_number"), F.col("_number") + F.col("spans") - 1)).alias("window")).where("window > 0").withColumn("_share", F.floor(F.col("window") / SHARE))
    shares = save(later.groupBy("_conv").agg(F.max("_share").alias("shares")), "chat-shares")
    system = checked_join(placed.where("system"), shares, ["_conv"], "inner").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("shares"))))
    kept = later.join(system, ["_conv", "_share"]).withColumn("again", F.lit(True)).select(*columns)
    grouped = shown.unionByName(kept).groupBy("_conv", "conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("idx", "again", "role", "text"))).alias("turns"), F.sum("tokens").alias("tokens"))

    def head(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("|"), F.lit("&#124;"))
        return F.concat(F.when(t["again"], F.lit("<|again:")).otherwise(F.lit("<|turn:")), role, F.lit("|>\n"))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (~t["again"] & (t["role"] == "assistant")).alias("target")))

    def mask(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(p["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return grouped.withColumn("parts", parts).select(
        "_conv", "conv_id", "window", "tokens",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", empty, mask)["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations as the windows' texts and masks tell them: conv_id, turns, loss (texts), chars."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>\n"), 1, F.size(F.split("formatted", r"<\|end\|>\n")) - 1)
    pattern = r"(?s)^<\|turn:(.*?)\|>\n(.*)$"
    fresh = F.filter(pieces, lambda p: F.startswith(p, F.lit("<|turn:")))
    turns = F.transform(fresh, lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = formatted.select("_conv", "conv_id", F.struct("window", turns.alias("turns"), loss.alias("loss")).alias("w"), F.length("formatted").alias("chars"))
    whole = each.groupBy("_conv", "conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("chars").alias("chars"))
    return whole.select("conv_id", F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("ws", lambda w: w["loss"])).alias("loss"), "chars")


PROBE = "</s>[INST] ok [/INST]"
_PROBE = Table("probe", "conv_id turn role text", "bigint bigint string string", ((-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = read_back(windows(table.unionByName(_PROBE.frame(spark))))
    loss = F.array_join("loss", "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )


# The windows' spans and escaped lengths follow from sums alone, so SQL can state the digests without formatting.
SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + {MARKERS} AS tokens,
         length(coalesce(text, '')) + 4 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '&', '')))
         + 3 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '<', '')))
         + 4 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '[', ''))) AS chars
  FROM rows),
placed AS (
  SELECT *, row_number() OVER w - 1 AS idx, sum(tokens) OVER w AS stop FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
firsts AS (SELECT conv_id, max(CASE WHEN idx = 0 AND role = 'system' THEN tokens ELSE 0 END) AS s FROM placed GROUP BY conv_id),
roomy AS (
  SELECT p.*, idx = 0 AND role = 'system' AS is_system, stop - s AS own_end, greatest(0, 1024 - s) * 256 // 1024 AS history,
         greatest(1, greatest(0, 1024 - s) - greatest(0, 1024 - s) * 256 // 1024) AS room
  FROM placed p JOIN firsts f ON p.conv_id IS NOT DISTINCT FROM f.conv_id),
bucketed AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE (own_end - 1) // room END AS bucket,
         NOT is_system AND (own_end - tokens) // room < (own_end - 1) // room AS across
  FROM roomy),
sums AS (
  SELECT conv_id, bucket, max(own_end) AS last_end, max(CASE WHEN across THEN own_end END) AS across_end,
         coalesce(max(CASE WHEN across THEN tokens END) + sum(CASE WHEN NOT across AND NOT is_system THEN tokens END) > max(room), false) AS split,
         lead(bucket) OVER (PARTITION BY conv_id ORDER BY bucket) IS NOT NULL AS more
  FROM bucketed GROUP BY conv_id, bucket),
sized AS (
  SELECT b.*, CASE WHEN (more OR split AND across) AND NOT is_system
                    AND (CASE WHEN split AND across THEN across_end ELSE last_end END) - (own_end - tokens) <= history THEN 1 ELSE 0 END AS carried,
         (SELECT sum(1 + x.split::INT) FROM sums x WHERE x.conv_id IS NOT DISTINCT FROM b.conv_id) - 1 AS later
  FROM bucketed b JOIN sums s ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.bucket = s.bucket)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum((chars + length(role) + {len("<|turn:") + len("|>x") + len(END)})
           + (carried + CASE WHEN is_system THEN later ELSE 0 END) * (chars + length(role) + {len("<|again:") + len("|>x") + len(END)}))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
