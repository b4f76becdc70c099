"""Interval joins against brute force; pages under overlapping topics; typed JSON entries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rulelens.operators import coverage
from rulelens.plans import intervals
from rulelens.sources import typed_json

rng = random.Random(4)


@pytest.mark.parametrize("broadcast", [True, False])
def test_interval_join_matches_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    points = [(rng.choice("ab"), rng.choice([rng.randint(-50, 5000), 0, None])) for _ in range(300)]
    ranges = [(k, rng.choice("abc"), s, s + rng.choice([0, 0, 1, 3, 40, 1000, 100_000, -1])) for k, s in enumerate(rng.randint(-100, 5000) for _ in range(120))] + [(998, "a", None, 3), (999, "b", -(2**40), 2**40), (1000, None, 0, 9)]
    p = spark.createDataFrame([(k, *r) for k, r in enumerate(points)], "i int, g string, x long").repartition(4)
    r = spark.createDataFrame(ranges, "j int, g string, lo long, hi long")
    got = {(x.i, x.j) for x in intervals.interval_join(p, r, ["g"], "x", "lo", "hi").collect()}
    want = {(i, j) for i, (g, x) in enumerate(points) for j, h, lo, hi in ranges if g == h and x is not None and lo is not None and lo <= x <= hi}
    assert got == want and len(want) > 100
    assert intervals.interval_join(p, r, ["g"], "x", "lo", "hi").count() == len(want)
    assert intervals.interval_join(p, r.where("false"), ["g"], "x", "lo", "hi").count() == 0
    first = intervals.first_range(intervals.interval_join(p, r, ["g"], "x", "lo", "hi"), ["i"], ["lo", "j"], ["j"])
    assert {x.i: (x.j, x.n_ranges) for x in first.collect()} == {i: (min((lo, j) for k, j in want for _, lo in [next((0, q[2]) for q in ranges if q[0] == j)] if k == i)[1], sum(k == i for k, _ in want)) for i in {i for i, _ in want}}


def test_topics_nest(spark):
    lines = ["Part", "x" * 45, "text one.", "A heading of middling size", "text two.", "", "Other", "text three."]
    p = spark.createDataFrame([(1, 7, k, x) for k, x in enumerate(lines)] + [(2, None, 0, "alone")], "row long, doc_id long, page int, raw string")
    got = {(r.row, r.start_page): (r.level, r.end_page) for r in coverage.nested_topics(p).collect()}
    assert got == {(1, 0): (1, 5), (1, 1): (3, 2), (1, 3): (2, 5), (1, 6): (1, 7), (2, 0): (1, 0)}


def lines(spark, rows):
    return spark.createDataFrame([(c, x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)) for c, x in rows], "category string, line string")


ROWS = [
    ("preposition", {"id": 1, "preposition": " مِنْ ", "meaning": "origin"}), ("preposition", {"id": 2, "preposition": "مِنْ", "meaning": "part"}), ("preposition", {"id": 3, "preposition": "فِي"}),
    ("pronoun", {"id": 1, "pronoun": "هُوَ"}), ("pronoun", {"id": 2, "pronoun_form": "هِيَ", "pronoun": "x"}), ("interrogative", {"id": 1, "tool": "مَنْ", "type": "اسم استفهام"}), ("interrogative", {"id": 2, "tool": "أَيْنَ", "type": "اسم"}),
    ("interrogative_letter", {"id": 3, "tool": "هَلْ", "type": "حرف"}), ("conditional", {"id": 1, "particle": "إِنْ", "grammatical_function": "حرف شرط"}), ("conditional", {"id": 2, "particle": "مَا", "grammatical_function": "اسم"}), ("naseb", {"id": 1, "tool": "أَنْ"}),
    ("kinaya", {"id": 1, "name": "كَمْ"}), ("verb_name", {"id": 1, "name": "آمِين"}), ("functional_substitute", {"id": 9, "noun": "", "tool": "قَبْلُ"}), ("relative", {"id": 1, "name": "مَا"}), ("demonstrative", {"name": "هَذَا"}),
    ("jazm", '{"id": 1, "tool": '), ("jazm", "[1, 2]"), ("jazm", None), ("vocative", {"id": 1, "particle": "  "}), ("unheard_of", {"id": 1, "name": "x"}), (None, {"id": 1}), ("conjunction", {"id": 1, "letter": "وَ", "more": {"a.b": [1]}}),
]


def test_entries(spark):
    got = typed_json.entries(lines(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {(r.category, r.entry): r for r in got if len(r.entry or "") < 9}
    said = lambda c, i: (by[c, i].status, by[c, i].surface, by[c, i].classes, by[c, i].priority, by[c, i].needs_context)
    assert said("preposition", "1") == ("ok", "مِنْ", ["HARF"], 9, False) and said("preposition", "2")[0] == "repeated" and said("preposition", "3")[0] == "ok"
    assert said("pronoun", "2")[:2] == ("ok", "هِيَ") and said("interrogative", "1")[2:] == (["ISM_MABNI", "HARF", "ISM_MAWSOOL"], 6, True)
    assert said("interrogative", "2")[2] == ["ISM_MABNI"] and said("interrogative_letter", "3")[2] == ["HARF"]
    assert said("conditional", "1")[2:] == (["HARF"], 8, False) and said("conditional", "2")[2:] == (["ISM_MABNI", "HARF"], 6, True)
    assert said("naseb", "1")[3:] == (7, True) and said("kinaya", "1")[2:] == (["ISM_MABNI"], 7, True) and said("functional_substitute", "9")[1] == "قَبْلُ"
    status = sorted(r.status for r in got if r.status != "ok")
    assert status == ["malformed"] * 3 + ["no_surface", "repeated"] + ["unknown_kind"] * 2
    assert all(r.surface is None and r.classes is None for r in got if r.status != "ok")
    assert len(next(r for r in got if r.category == "demonstrative").entry) == 64


def test_registry_and_inventory(spark):
    found = typed_json.entries(lines(spark, ROWS))
    got = {(r.category, r.entry): (r.classes, r.proof, r.blocker) for r in typed_json.registry(found).collect()}
    assert got["preposition", "3"] == ("HARF", "Certificate", "") and got["verb_name", "1"] == ("ISM_MABNI|FIIL", "Hypothesis", "cross_source_conflict:2_classes")
    assert got["relative", "1"][1] == "Hypothesis" and got["conditional", "2"][0] == got["relative", "1"][0] == "ISM_MAWSOOL|ISM_MABNI|HARF"
    assert got["preposition", "1"][2] == got["interrogative", "1"][2] == "cross_source_conflict:3_classes"
    assert got["functional_substitute", "9"] == ("ISM_MABNI", "Hypothesis", "priority_below_threshold:7")
    stock = {r.category: (r.lines, r.malformed, r["keys"]) for r in typed_json.inventory(lines(spark, ROWS)).collect()}
    assert stock["jazm"] == (3, 3, "") and stock["pronoun"] == (2, 0, "id,pronoun,pronoun_form") and stock["conjunction"][2] == "id,letter,more"
    none = lines(spark, ROWS).where("false")
    assert typed_json.entries(none).count() == 0 and typed_json.inventory(none).count() == 0


def test_lines_from_files(spark, tmp_path):
    (tmp_path / "category=pronoun").mkdir()
    (tmp_path / "category=pronoun" / "a.json").write_text('{"id": 1, "pronoun": "هُوَ"}\n\n{"id": 2,\n', encoding="utf-8")
    got = typed_json.entries(typed_json.read_lines(spark, str(tmp_path))).groupBy("status").agg(F.count("*").alias("n")).collect()
    assert {r.status: r.n for r in got} == {"ok": 1, "malformed": 1}
