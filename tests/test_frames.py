"""Frames of speech in stated sentences, and pauses found over two tokenisations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rulelens.functions.arabic import ordered
from rulelens.operators import frames

rng = random.Random(9)


def tokens(spark, *texts):
    return spark.createDataFrame([(k, pos, ordered(w)) for k, t in enumerate(texts) for pos, w in enumerate(t.split())], "sent int, pos int, surface string").repartition(4)


def told(spark, *texts):
    rows = frames.speech_frames(tokens(spark, *texts), ["sent"]).collect()
    return {(r.sent, r.frame): r for r in rows}


def test_speaker_addressee_and_utterance(spark):
    got = told(spark, "قَالَ مُوسَى لِقَوْمِهِ يَا قَوْمِ اذْكُرُوا نِعْمَةَ", "قَالَ رَبُّكَ لِلْمَلَائِكَةِ إِنِّي جَاعِلٌ", "قَالُوا أَتَجْعَلُ فِيهَا", "فَقَالَ لِلنَّاسِ رَسُولٌ")
    a, b, c, d = (got[k, 0.0] for k in range(4))
    assert (a.speaker, a.speaker_kind, a.addressee_kind, a.confidence, a.introduced_by, a.parent, a.depth) == ("مُوسَى", "explicit", "addressee_match", "high", "قَالَ", None, 1)
    assert a.addressee == "لِقَوْمِهِ" and a.utterance.split()[0] == "مُوسَى" and len(a.utterance.split()) == 6
    assert (b.speaker[0], b.addressee_kind) == ("ر", "addressee_match")
    assert (c.speaker, c.speaker_kind, c.addressee, c.confidence) == (frames.IMPLICIT, "implicit", None, "medium")
    assert (d.speaker, d.addressee_kind, d.introduced_by) == ("رَسُولٌ", "addressee_match", "فَقَالَ")


def test_frames_nest(spark):
    got = told(spark, "قَالَ رَجُلٌ قُلْ يَا قَوْمِ قَالُوا نَعَمْ")
    assert sorted(got) == [(0, 0.0), (0, 1.0), (0, 1.5), (0, 2.0)]
    outer, inner, last = got[0, 1.0], got[0, 1.5], got[0, 2.0]
    assert (outer.type, outer.parent, outer.depth, outer.addressee, outer.addressee_kind, outer.speaker_kind) == ("commanded_speech", 0.0, 2, "قَوْمِ", "vocative_match", "implicit_supersentential")
    # Who is told to speak speaks inside, to an audience.
    assert (inner.type, inner.parent, inner.depth, inner.speaker, inner.addressee, inner.utterance) == ("commanded_speech_inner", 1.0, 3, outer.addressee, frames.AUDIENCE, outer.utterance)
    assert (last.parent, last.depth, last.speaker_kind, last.utterance) == (1.0, 3, "implicit", "نَعَمْ")
    assert got[0, 0.0].utterance == "رَجُلٌ"


def test_calls_open_only_where_nothing_is_open(spark):
    got = told(spark, "يَا رَجُلُ يَا قَوْمِ", "كِتَابٌ", "قَالَ يَا رَجُلُ", "ۚ ۚ", "قُلْ")
    assert {k: (r.type, r.addressee, r.confidence) for k, r in got.items() if k[0] in (0, 2)} == {(0, 0.0): ("vocative", "رَجُلُ", "high"), (2, 0.0): ("direct", "رَجُلُ", "medium")}
    assert got[2, 0.0].speaker == frames.IMPLICIT  # one who is called does not speak
    assert {k[0] for k in got} == {0, 2, 4} and got[4, 0.0].utterance == ""
    assert frames.speech_frames(tokens(spark, "كِتَابٌ").where("false"), ["sent"]).collect() == []


def brute_pauses(pieces, toks):
    """A cursor over the tokens moves by one with each word; a pause marks the next token that the word is."""
    out, at, seen = set(), 0, False
    for x in pieces:
        if x in "ۚۖ،":
            seen = True
            continue
        if at < len(toks) and x == toks[at]:
            if seen:
                out.add(at)
                seen = False
        at += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pauses_match_a_cursor(spark, seed):
    rng.seed(seed)
    texts, cut = [], []
    for _ in range(40):
        p = [rng.choice(["a", "b", "c", "ۚ", "ۖ"]) for _ in range(rng.randint(1, 14))]
        words = [x for x in p if x not in "ۚۖ"]
        texts.append(p)
        cut.append([y for w in words for y in ([w] if rng.random() < 0.8 else rng.choice([[], ["x", w], ["d"]]))])
    rows = lambda xs: spark.createDataFrame([(k, pos, w) for k, x in enumerate(xs) for pos, w in enumerate(x)], "sent int, pos int, surface string").repartition(3)
    got = {(r.sent, r.pos) for r in frames.pauses_before(rows(texts), rows(cut), ["sent"]).collect()}
    assert got == {(k, i) for k, (p, t) in enumerate(zip(texts, cut, strict=True)) for i in brute_pauses(p, t)} and got


def test_pauses_of_documents_are_found_within_their_rows(spark, tmp_path):
    """Five shuffles of all tokens filled the disk."""
    spark.createDataFrame([(1, "a b, c: d; e, , f. g, h"), (None, ", x y"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = frames.w13_pauses(spark, str(tmp_path))
    df.collect()
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert not {"Window", "SortMergeJoin", "hashpartitioning"} & set(re.findall(r"\w+", shown))


def test_a_cut_word_keeps_the_pause_for_the_next_agreement(spark):
    df = spark.createDataFrame([(["a", "وَالب", "ۚ", "c", "d", None, "ۖ", "d"],), ([],), (["ۚ", "x"],)], "p array<string>")
    got = [[tuple(x) for x in r.x] for r in df.select(frames.realigned(F.col("p"), frames.cut_words(F.col("p"))).alias("x")).collect()]
    # The words a, wa-al-b, c, d, d lie beside the tokens a, wa, al-b, c, d, d.
    assert got == [[(4, "d")], [], [(0, "x")]]
