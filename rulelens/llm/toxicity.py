"""Toxicity by the nearest labelled examples.

Documents and labelled examples are TF-IDF vectors over the terms that tell toxic examples apart; a document's nearest
examples by exact cosine vote on it, weighted by nearness, and a logistic curve fitted on the examples' own votes, each
without itself, turns votes into calibrated scores. Examples lie in an inverted index of blocks: each term keeps the
largest weight it has in each block, so a query bounds every block, takes blocks from the highest bound down, and stops
where no block can hold a nearer example. Nothing that could be among the nearest is skipped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.plans.reading import spread
from rulelens.plans.scratch import save

#: Labelled documents that serve as examples, at most: those with the least hashes. Bounds what is sent to tasks.
FIT_ROWS = 16_384
#: A term tells if so many toxic examples hold it, so many standard deviations above chance.
LEAST_TOXIC, LEAST_Z = 3, 4.0
#: Neighbours that vote, and how many votes' weight the corpus's share of toxic examples has.
NEIGHBOURS, PRIOR_WEIGHT = 15, 0.5
#: Examples of a block, and weights that one shard of the index holds at most (some 100 MB).
BLOCK, SHARD = 64, 4_000_000
#: Postings up to which all blocks are scored at once.
FEW_POSTINGS = 4_096
#: Lengths of the word beginnings that are terms beside the words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Words with one beginning in a text that make that beginning a frequent one.
OFTEN = 3
#: Words whose terms a task remembers.
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W_]+")


def _terms_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:k]}^" for k in BEGINNINGS if len(word) > k)]


def _with_repeats(counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Terms with their counts; a beginning that ``OFTEN`` words of a text have is a further term (marked ``^^``)."""
    for t, n in counts.items():
        yield t, n
        if n >= OFTEN and t[-1] == "^":
            yield f"{t}^", n


def terms(text: str) -> set[str]:
    """A text's lower-cased words, their beginnings (marked ``^``) and the beginnings that come often (``^^``)."""
    counts: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for t in _terms_of_word(word):
            counts[t] += n
    return {t for t, _ in _with_repeats(counts)}


def _held_out(doc_id: str) -> Column:
    """Whether no label may be learned from a row; a row without an id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def examples(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``fit_rows`` labelled rows that are not held out; of repeated labels the highest counts."""
    known = labels.where(~_held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))  # fit_rows bounds it
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(fit_rows)


def telling_terms(sample: DataFrame, least_toxic: int = LEAST_TOXIC, least_z: float = LEAST_Z) -> list[str]:
    """Terms that toxic examples hold more often than chance would have it, all of them, in order."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                told = [sorted(terms(t.as_py())) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(told, pa.list_(pa.string()))], ["toxic", "terms"])

    size = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    if not size["n1"]:
        return []
    share = size["n1"] / size["n"]
    counts = sample.select("toxic", "text").mapInArrow(split, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term"))
    counts = counts.groupBy("term").agg(F.count("*").alias("c"), F.sum("toxic").alias("c1")).where(F.col("c1") >= least_toxic)
    expected = F.col("c") * share
    z = (F.col("c1") - expected) / F.sqrt(expected * (1 - share) + 1e-9)
    return sorted(r.term for r in counts.where(z > least_z).select("term").collect())  # no more than the examples' terms


def vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``rows`` with the numbers of the vocabulary's terms in ``text`` and how often each comes, in place of the text."""
    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}
        wanted = number.keys() | {t[:-1] for t in number if t[-2:] == "^^"}
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                told = []
                for text in part.column("text"):
                    found: Counter = Counter()
                    for word, n in Counter(_WORD.findall(text.as_py().lower())).items():
                        at = known.get(word)
                        if at is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            at = known[word] = tuple(t for t in _terms_of_word(word) if t in wanted)
                        for t in at:
                            found[t] += n
                    told.append(sorted((number[t], n) for t, n in _with_repeats(found) if t in number))
                columns = [part.column(c) for c in others]
                columns += [pa.array([[t for t, _ in x] for x in told], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in told], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*others, "terms", "counts"])

    return rows.mapInArrow(count, f"{kinds}, terms array<int>, counts array<int>")


def weigh(terms: list[int], counts: list[int], idf: np.ndarray) -> np.ndarray:
    """Unit vector of (1 + ln count) * idf."""
    w = (1 + np.log(np.asarray(counts, float))) * idf[np.asarray(terms, np.int64)]
    return w / math.sqrt(float(w @ w)) if len(w) else w


class BlockMaxIndex:
    """Inverted index of unit vectors with the largest weight of each term in each block of examples.

    An entry is a term's postings in one block: the block, the largest weight, and where its postings lie.
    """

    def __init__(self, rows: list[tuple[int, list[int], np.ndarray]], block: int = BLOCK):
        """``rows``: (number, terms, weights); alike ones should lie together."""
        self.numbers, self.block, self.blocks = np.array([r[0] for r in rows], np.int64), block, -(-len(rows) // block)
        sizes = [len(r[1]) for r in rows]
        of = np.fromiter((t for r in rows for t in r[1]), np.int64, sum(sizes))
        at = np.repeat(np.arange(len(rows)), sizes)
        weights = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0)
        order = np.lexsort((at, of))
        of, self.at, self.weights = of[order], at[order], weights[order]
        key = of * max(1, self.blocks) + self.at // block
        self.starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.lengths = np.diff(self.starts, append=len(key))
        self.of_block = self.at[self.starts] // block
        self.most = np.maximum.reduceat(self.weights, self.starts) if len(key) else np.zeros(0)
        firsts = np.flatnonzero(np.diff(of[self.starts], prepend=-1))
        ends = np.append(firsts, len(self.starts))[1:]
        self.entries = {int(t): (int(a), int(b)) for t, a, b in zip(of[self.starts][firsts], firsts, ends, strict=True)}

    def nearest(self, its_terms: list[int], weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` nearest (cosine, number) above 0, nearest first, ties to smaller numbers; never ``without``.

        Blocks are taken from the highest bound down, in growing batches, until the rest can't hold a nearer one.
        """
        query = [(*self.entries[t], w) for t, w in zip(its_terms, weights.tolist(), strict=True) if t in self.entries]
        if not query:
            return []
        entries = np.concatenate([np.arange(a, b) for a, b, _ in query])
        weight = np.repeat([w for _, _, w in query], [b - a for a, b, _ in query])
        blocks = self.of_block[entries]
        bounds = np.bincount(blocks, weight * self.most[entries], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rank = np.empty(self.blocks, np.int64)
        rank[order] = np.arange(len(order))
        few = int(self.lengths[entries].sum()) <= FEW_POSTINGS
        cosines, numbers, done, batch, least = np.zeros(0), np.zeros(0, np.int64), 0, len(order) if few else 4, 0.0
        while done < len(order) and bounds[order[done]] >= least - 1e-9:
            chosen = (rank[blocks] >= done) & (rank[blocks] < done + batch)
            lengths, starts = self.lengths[entries[chosen]], self.starts[entries[chosen]]
            postings = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
            found = np.bincount(self.at[postings], np.repeat(weight[chosen], lengths) * self.weights[postings])
            at = np.flatnonzero(found)
            if len(at) > 4 * k + 4:  # only the best of many are put in order
                at = at[found[at] >= np.partition(found[at], -k - 1)[-k - 1]]
            numbers, cosines = np.concatenate([numbers, self.numbers[at]]), np.concatenate([cosines, found[at]])
            kept = np.lexsort((numbers, -cosines))
            kept = kept[numbers[kept] != without][:k]
            numbers, cosines = numbers[kept], cosines[kept]
            least = cosines[-1] if len(cosines) == k else 0.0
            done, batch = done + batch, batch * 4
        return [(float(c), int(n)) for c, n in zip(cosines, numbers, strict=True) if c > 0]


def _shards(rows: list[tuple[int, list[int], np.ndarray]], most: int) -> list[list[tuple[int, list[int], np.ndarray]]]:
    """Rows in order, cut where a shard would hold more than ``most`` weights."""
    out, size = [[]], 0
    for r in rows:
        if out[-1] and size + len(r[1]) > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += len(r[1])
    return out


_NEAR = "array<struct<cosine: double, number: long, toxic: int>>"


def neighbours(
    table: DataFrame, rows: list[tuple[int, list[int], np.ndarray]], toxic: list[int], idf: np.ndarray, k: int = NEIGHBOURS, without: str | None = None, shard: int = SHARD
) -> DataFrame:
    """``table`` (with terms and counts) with ``near``: its nearest examples. One pass for each shard of the index."""
    table = table.withColumn("near", F.array().cast(_NEAR))
    spark, names = table.sparkSession, table.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    shape = pa.list_(pa.struct([("cosine", pa.float64()), ("number", pa.int64()), ("toxic", pa.int32())]))
    parts = _shards(rows, shard)
    for part_of in parts:
        sent = spark.sparkContext.broadcast((part_of, toxic, idf))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part, labels, weights_of = sent.value
            index, seen = BlockMaxIndex(part), {}
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some, told = batch.slice(at, 512), []
                    own = some.column(without).to_pylist() if without else [-1] * some.num_rows
                    for its, counts, near, mine in zip(some.column("terms").to_pylist(), some.column("counts").to_pylist(), some.column("near").to_pylist(), own, strict=True):
                        key = (tuple(its), tuple(counts), mine)
                        if key not in seen:
                            if len(seen) >= REMEMBERED // 10:
                                seen.clear()
                            seen[key] = index.nearest(its, weigh(its, counts, weights_of), k, mine) if its else []
                        both = seen[key] if not near else sorted([*((x["cosine"], x["number"]) for x in near), *seen[key]], key=lambda x: (-x[0], x[1]))[:k]
                        told.append([{"cosine": c, "number": n, "toxic": labels[n]} for c, n in both])
                    columns = [some.column(c) for c in names if c != "near"]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(told, shape)], names)

        table = table.mapInArrow(search, kinds)
        if len(parts) > 1:
            table = save(table, "toxicity-near")
    return table


def _vote(near: str, prior: float) -> Column:
    """The share of toxic examples among the nearest, weighted by cosine, with the prior as one more vote."""
    add = lambda a, x: F.struct((a["s"] + x["cosine"] * x["toxic"]).alias("s"), (a["w"] + x["cosine"]).alias("w"))
    both = F.aggregate(near, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), add)
    return (both["s"] + PRIOR_WEIGHT * prior) / (both["w"] + PRIOR_WEIGHT)


def calibrate(votes: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from log odds of votes to labels, labels softened as Platt does."""
    x = np.log(votes / (1 - votes))
    n1 = toxic.sum()
    y = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (len(toxic) - n1 + 2))
    w = np.array([1.0, 0.0])
    both = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -30, 30)))
        g = both.T @ (p - y) + 1e-3 * np.array([w[0] - 1, 0])
        h = (both * (p * (1 - p))[:, None]).T @ both + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / (float(np.abs(step).max()) + 1e-12))
    return max(float(w[0]), 1e-3), float(w[1])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, k: int = NEIGHBOURS, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_terms, evidence (cosine, number
    and label of the nearest examples).

    Labels are learned only from rows whose crc32 of doc_id is no multiple of 5. Only texts make scores. A null or empty
    text has no terms, so it gets what examples without terms show; without any labelled example every score is 0.
    Rows without an id are scored and count as held out; repeated rows stay repeated and score alike; an empty table
    gives no rows; columns other than doc_id, text and toxic are ignored. Examples with equal cosines count by number,
    which follows their terms, then their order by hash.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = save(examples(docs, labels.select("doc_id", "toxic"), fit_rows), "toxicity-examples")
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    vocabulary = telling_terms(sample.repartition(tasks))
    table = save(vectors(docs, vocabulary), "toxicity-vectors")
    n = table.count()
    held = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each telling term
    idf = np.log((n + 1) / (np.array([held.get(t, 0) for t in range(len(vocabulary))]) + 1)) + 1
    few = vectors(sample.repartition(tasks).withColumn("h", F.xxhash64("doc_id")), vocabulary).orderBy("h", "doc_id", "terms", "counts", "toxic").collect()  # fit_rows bounds it
    # Examples that share their weightiest terms lie together, so that blocks hold like ones.
    weighed = [(r, weigh(r.terms, r.counts, idf)) for r in few]
    weighed.sort(key=lambda x: [x[0].terms[i] for i in np.argsort(-x[1], kind="stable")[:4]])
    toxic = [int(r.toxic != 0) for r, _ in weighed]
    rows = [(k, r.terms, w) for k, (r, w) in enumerate(weighed) if r.terms]
    prior = (sum(toxic) + 0.5) / (len(toxic) + 1)
    vote = lambda df: df.withColumn("vote", _vote("near", prior))
    slope, intercept = 1.0, -30.0
    if sum(toxic):
        own = docs.sparkSession.createDataFrame([(k, r.terms, r.counts, toxic[k]) for k, (r, _) in enumerate(weighed)], "own long, terms array<int>, counts array<int>, toxic int")
        told = vote(neighbours(own.repartition(tasks), rows, toxic, idf, k, "own", shard)).select("vote", "toxic").collect()
        slope, intercept = calibrate(np.array([r.vote for r in told]), np.array([r.toxic for r in told]))
    # Vectors are small and a search is not: a task searches for some ten thousand.
    scored = vote(neighbours(table.repartition(max(tasks, n // 10_000)), rows, toxic, idf, k, shard=shard))
    log_odds = slope * F.log(F.col("vote") / (1 - F.col("vote"))) + intercept
    value = 1 / (1 + F.exp(-log_odds)) if sum(toxic) else F.lit(0.0)
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), F.size("terms").alias("n_terms"), F.col("near").alias("evidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None
