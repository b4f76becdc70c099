"""Graphs of texts and walks in them against brute force."""

import random

from rulelens.operators import clauses, textgraph

rng = random.Random(8)


def test_walks_match_brute_force(spark):
    nodes = [f"n{k}" for k in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice("ab")) for _ in range(70)] + [("hub", n, "a") for n in nodes[:25]]
    g = textgraph.TextGraph(spark.createDataFrame([(n, "x", n[:2]) for n in nodes], "id string, type string, label string"), spark.createDataFrame(edges, "source string, target string, type string").repartition(4))
    seeds = ["n1", "n2", "hub", "nowhere"]
    for steps, types in ((0, ()), (1, ()), (3, ()), (9, ("b",))):
        want = set()
        for s in seeds:
            seen, front = {s: 0}, {s}
            for step in range(1, steps + 1):
                front = {y for a, b, t in edges if not types or t in types for x, y in ((a, b), (b, a)) if x in front} - seen.keys()
                seen |= {n: step for n in front}
            want |= {(s, n, k) for n, k in seen.items()}
        got = g.walk(spark.createDataFrame([(s,) for s in [*seeds, "n1"]], "id string"), steps, types).collect()
        assert {(r.seed, r.node, r.step) for r in got} == want and len(got) == len(want)


def test_lookups(spark):
    g = textgraph.TextGraph(spark.createDataFrame([("b", "t", "x"), ("a", "t", "x"), ("c", "u", "y")], "id string, type string, label string"), spark.createDataFrame([("a", "b", "e"), ("b", "c", "f"), ("a", "c", "e")], "source string, target string, type string"))
    assert [(r.id, r.label) for r in g.node(["c"]).collect()] == [("c", "y")]
    assert {(r.label, r.id) for r in g.by_label(spark.createDataFrame([("x",), ("z",)], "label string")).collect()} == {("x", "a")}
    assert {(r.other, r.type) for r in g.edges_from(["a"]).collect()} == {("b", "e"), ("c", "e")} and {r.other for r in g.edges_to(["c"]).collect()} == {"a", "b"}
    assert g.walk(spark.createDataFrame([], "id string"), 3).count() == 0


def test_assembly(spark):
    words = "كَتَبَ إِذَا جَلَسَ ۚ فَلْيَكْتُبْ كِتَابًا".split()
    tokens = spark.createDataFrame([(5, 0, k, w) for k, w in enumerate(words)], "doc_id long, sent int, pos int, surface string")
    nodes, edges = textgraph.assembled(tokens, clauses.clauses(tokens, ["doc_id", "sent"]), ["doc_id", "sent"])
    assert {(r.id, r.type) for r in nodes.collect()} == {("5:0/cm_t0", "token"), ("5:0/c0_t1", "token"), ("5:0/c0_t2", "token"), ("5:0/cm_t3", "token"), ("5:0/c1_t4", "token"), ("5:0/c1_t5", "token"), ("5:0/c0", "condition"), ("5:0/c1", "condition_answer_command")}
    assert {(r.source, r.target, r.type) for r in edges.collect() if r.type != "part_of"} == {("5:0/c0", "5:0/c1", "next_clause"), ("5:0/c1", "5:0/c0", "answers")}
