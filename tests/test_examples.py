"""Patterns of examples that are tried at the start of a run only: the same matches, in time that grows with the page."""

import random
import time

from pyspark.sql import functions as F

from rulelens.operators.coverage import EXAMPLES, _matches


def test_matches_at_starts_are_all_matches(spark):
    pattern = EXAMPLES.rows[0][1]
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab !!.?|\né1") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", "!", "a!b!", "!!a!"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert df.where(~_matches(pattern).eqNullSafe(F.regexp_extract_all("raw", F.lit(pattern), F.lit(1)))).count() == 0
    began = time.time()
    assert spark.range(1).select(F.repeat(F.lit("word "), 100_000).alias("raw")).select(F.size(_matches(pattern))).first()[0] == 0
    assert time.time() - began < 15
