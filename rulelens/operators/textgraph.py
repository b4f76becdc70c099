"""The graph of a text: tokens under clauses, clauses linked to one another, and lookups in it.

Ids are global: ``c<clause>_t<pos>`` behind the sentence they stand in. Edges are kept as an adjacency table, dealt and
sorted by node, both ways; a lookup joins a few nodes with it, and a walk takes one such join a step, each step written, so
that neither a long walk nor a lost executor starts anything anew.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.operators.clauses import G40, clauses
from rulelens.operators.graph import _GRAPH, graph
from rulelens.plans.joins import large_join
from rulelens.plans.scratch import save
from rulelens.sources.analysed import Analysed
from rulelens.sources.sequences import SEQUENCES_SQL, read_sentences


class TextGraph:
    """Nodes (id, type, label) and edges (source, target, type) with lookups."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def _both(self, edges: DataFrame) -> DataFrame:
        """Each edge as seen from both of its ends."""
        ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("way")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("way")))
        return edges.select("type", F.inline(ends)).select("node", "other", "type", "way")

    @cached_property
    def adjacency(self) -> DataFrame:
        return save(self._both(self.edges).repartition("node").sortWithinPartitions("node"), "graph-adjacency")

    def node(self, ids: list[str]) -> DataFrame:
        return self.nodes.where(F.col("id").isin(ids))

    def by_label(self, labels: DataFrame) -> DataFrame:
        """(label, id, type): for each label the first node of that label by id."""
        found = self.nodes.join(labels.select("label").distinct(), "label")
        return found.groupBy("label").agg(F.min(F.struct("id", "type")).alias("n")).select("label", "n.id", "n.type")

    def edges_from(self, ids: list[str]) -> DataFrame:
        return self.adjacency.where(F.col("node").isin(ids) & (F.col("way") == "out"))

    def edges_to(self, ids: list[str]) -> DataFrame:
        return self.adjacency.where(F.col("node").isin(ids) & (F.col("way") == "in"))

    def walk(self, seeds: DataFrame, steps: int, types: tuple[str, ...] = ()) -> DataFrame:
        """(seed, node, step): every node that is reached from each of the ``seeds`` (id) in so many steps at most, by its least step.

        Edges are walked both ways; ``types`` restricts them. A step joins only the nodes that the step before reached
        first. Edges to nodes that aren't there are walked too: the graph says what it says. Edges should be a written table.
        """
        links = self._both(self.edges.where(F.col("type").isin(*types)) if types else self.edges).select("node", "other")
        reached = save(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("step")).distinct(), "graph-reached")
        front = reached
        for step in range(1, steps + 1):
            found = large_join(front.select("seed", "node"), links, ["node"]).select("seed", F.col("other").alias("node")).distinct()
            front = save(large_join(found, reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("step", F.lit(step)), "graph-front")
            if front.isEmpty():
                break
            reached = reached.unionByName(front)
        return reached


def assembled(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a text from its tokens and clauses.

    A token's id holds its clause, ``m`` for the main stretch before the first opener; edges lead from tokens to their
    clause, from a clause to the next one of its sentence, and from an answer to its condition.
    """
    at = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    clause = F.concat(at, F.lit("/c"), F.col("clause").cast("string"))
    held = large_join(tokens.select(*keys, "pos", "surface"), spans.select(*keys, "clause", "start", "end"), keys, "left")
    inside = held.where("pos BETWEEN start AND end").select(*keys, "pos", "surface", "clause")
    free = large_join(tokens.select(*keys, "pos", "surface"), inside.select(*keys, "pos"), [*keys, "pos"], "left_anti").withColumn("clause", F.lit(None).cast("int"))
    t = inside.unionByName(free)
    token = F.concat(at, F.lit("/c"), F.coalesce(F.col("clause").cast("string"), F.lit("m")), F.lit("_t"), F.col("pos").cast("string"))
    nodes = t.select(token.alias("id"), F.lit("token").alias("type"), F.col("surface").alias("label")).unionByName(spans.select(clause.alias("id"), F.col("type"), F.col("head_token").alias("label")))
    part = t.where("clause IS NOT NULL").select(token.alias("source"), clause.alias("target"), F.lit("part_of").alias("type"))
    later = spans.where("clause > 0").select(F.concat(at, F.lit("/c"), (F.col("clause") - 1).cast("string")).alias("source"), clause.alias("target"), F.lit("next_clause").alias("type"))
    answers = spans.where("parent IS NOT NULL").select(clause.alias("source"), F.concat(at, F.lit("/c"), F.col("parent").cast("string")).alias("target"), F.lit("answers").alias("type"))
    return nodes, part.unionByName(later).unionByName(answers)


def d14_text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the documents' text graphs by type, with their first id."""
    tokens, keys = read_sentences(spark, sf_dir), ["doc_id", "sent"]
    spans = save(clauses(tokens, ["row", "doc_id", "sent"]), "graph-clauses")
    nodes, edges = assembled(tokens, spans, keys)
    one = lambda df, what, id: df.groupBy("type").agg(F.count("*").alias("n"), F.min(id).alias("first")).withColumn("what", F.lit(what))
    return one(nodes, "node", F.col("id")).unionByName(one(edges, "edge", F.col("source")))


def d13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two steps reach from every event of saying, over the meaning graph's edges."""
    nodes, edges = graph(Analysed(spark, sf_dir), spark)
    g = TextGraph(nodes, save(edges.select("source", "target", "type"), "graph-edges"))
    return g.walk(save(nodes.where("type = 'event' and label = 'قال'").select("id"), "graph-seeds"), 2)


D14 = f"""WITH {SEQUENCES_SQL}, spans AS ({G40}),
tok AS (SELECT s.doc_id, s.sent, s.pos, s.surface, p.clause FROM seqs s LEFT JOIN spans p ON p.doc_id = s.doc_id AND p.sent = s.sent AND s.pos BETWEEN p.start AND p."end"),
nodes AS (SELECT doc_id || ':' || sent || '/c' || coalesce(clause::VARCHAR, 'm') || '_t' || pos AS id, 'token' AS type FROM tok UNION ALL SELECT doc_id || ':' || sent || '/c' || clause, type FROM spans),
edges AS (SELECT doc_id || ':' || sent || '/c' || clause || '_t' || pos AS source, 'part_of' AS type FROM tok WHERE clause IS NOT NULL UNION ALL SELECT doc_id || ':' || sent || '/c' || (clause - 1), 'next_clause' FROM spans WHERE clause > 0 UNION ALL SELECT doc_id || ':' || sent || '/c' || clause, 'answers' FROM spans WHERE parent IS NOT NULL)
SELECT type, count(*) AS n, min(id) AS first, 'node' AS what FROM nodes GROUP BY type UNION ALL SELECT type, count(*), min(source), 'edge' FROM edges GROUP BY type"""
D13 = f"""WITH {_GRAPH}, links AS (SELECT DISTINCT source AS node, target AS other FROM gedges UNION SELECT DISTINCT target, source FROM gedges),
seeds AS (SELECT DISTINCT id FROM nodes WHERE type = 'event' AND label = 'قال'), one AS (SELECT DISTINCT id AS seed, other AS node FROM seeds JOIN links ON node = id WHERE other <> id),
two AS (SELECT DISTINCT seed, l.other AS node FROM one JOIN links l ON l.node = one.node WHERE l.other <> seed)
SELECT id AS seed, id AS node, 0 AS step FROM seeds UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two WHERE (seed, node) NOT IN (SELECT seed, node FROM one)"""

QUERIES = {"d14_text_graph": d14_text_graph, "d13_neighbours": d13_neighbours}
ORACLE = {"d14_text_graph": D14, "d13_neighbours": D13}
