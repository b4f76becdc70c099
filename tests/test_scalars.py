"""Scalar functions on stated values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rulelens.functions import scalars as fn


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_references(spark):
    text = "as in [البقرة: 255] and [ آل عمران : ٣-٥ ] or [Name: 1, 7-8] but not [x] nor [: 3] [Long: 9 - 2]"
    got = [(r.name, list(r.verses)) for r in one(spark, text, fn.references)]
    assert got == [("البقرة", [255]), ("آل عمران", [3, 4, 5]), ("Name", [1, 7, 8]), ("Long", [9, 2])]
    assert one(spark, "", fn.references) == [] and one(spark, None, fn.references) is None


def test_points_and_ranges(spark):
    shown = {x: one(spark, x, fn.point_or_range) for x in ("2:255", " 2 : 255 - 257", "2:255-3:2", "٢:٥", "kitab", "2:", None)}
    plain = {k: None if v is None else (v["from"], v["verse"], v["to"], v["last"]) for k, v in shown.items()}
    assert plain == {"2:255": (2, 255, 2, 255), " 2 : 255 - 257": (2, 255, 2, 257), "2:255-3:2": (2, 255, 3, 2), "٢:٥": (2, 5, 2, 5), "kitab": None, "2:": None, None: None}


def test_examples_and_quotations(spark):
    text = "say (zayd came) or (12: 3) and «a book» then ﴿a verse﴾ (ab)"
    assert [(e.type, e.text) for e in one(spark, text, fn.examples)] == [("bracketed", "zayd came"), ("quoted", "a book"), ("quoted", "a verse")]
    text = "﴿first﴾ he said [One: 4] «second» " + "x" * 90 + " [Two: 5] «third» [Three: 1-2]"
    assert [(q.text, q.name, list(q.verses)) for q in one(spark, text, fn.quoted_verses)] == [("first", "One", [4]), ("third", "Three", [1, 2])]


def test_confidence(spark):
    df = spark.createDataFrame([("exact", 0.8), ("stripped", 0.9), ("guess", 0.9), ("normalized", None), (None, 0.5)], "way string, row double")
    assert [r.c for r in df.select(fn.match_confidence(F.col("way"), F.col("row")).alias("c")).collect()] == [0.8, 0.7, 0.0, 0.0, 0.0]


def test_entropy_and_numbers(spark):
    for counts, bits in (([1.0, 1.0], 1.0), ([4.0], 0.0), ([], 0.0), ([2.0, 1.0, 1.0, 0.0], 1.5)):
        assert one(spark, counts, fn.entropy, "array<double>") == pytest.approx(bits)
    assert one(spark, ["100", "40", None], fn.number_value, "array<string>") == 140 and one(spark, [], fn.number_value, "array<string>") == 0
    bands = {None: "none", -1: "none", 0: "zero", 1: "singular", 2: "dual", 3: "plural_genitive", 10: "plural_genitive", 11: "singular_accusative", 99: "singular_accusative", 100: "singular_genitive", 103: "plural_genitive", 111: "singular_accusative", 101: "singular_genitive", 2000: "singular_genitive"}
    assert {n: one(spark, n, fn.agreement_band, "long") for n in bands} == bands


def test_json_and_digests(spark):
    m = {"b": "ü\n", "a.b": 'q"', "a": "", "z": "1"}
    got = one(spark, m, fn.canonical_json, "map<string,string>")
    assert got == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and one(spark, {}, fn.canonical_json, "map<string,string>") == "{}"
    digest = hashlib.sha256(got.encode()).hexdigest()
    assert one(spark, got, fn.seal) == f"sha256:{digest}" and one(spark, got, fn.level_digest) == digest[:6]
    assert one(spark, m, lambda x: fn.attribute(x, "a.b", "-"), "map<string,string>") == 'q"' and one(spark, m, lambda x: fn.attribute(x, "no", "-"), "map<string,string>") == "-"


def test_a_digest_is_no_source(spark):
    good = spark.createDataFrame([("volume 1",), (None,)], "source string")
    assert fn.cites_no_digest(good, "source").count() == 2 and len(fn.cites_no_digest(good, "source").collect()) == 2
    with pytest.raises(Exception, match="a digest is no source"):
        fn.cites_no_digest(spark.createDataFrame([("sha256:0123abcd",)], "source string"), "source").collect()


def test_role_names(spark):
    stated = {" The Agent-Of ": "agent_of", "PATIENT  of_certificate": "patient_of", "topic?": "topic", "الفاعل": "فاعل"}
    assert {x: one(spark, x, fn.role_normal_form) for x in stated} == stated
