"""Periodic runs: stretches of words that repeat with a fixed period.

Block matching: at each scale the document's aligned blocks of 2^k words go into an automaton whose keys are sequences
of integers, and the whole document is searched for them. The integers number words at the smallest scale and longer
pieces at the others, so that keys stay short and one search takes the document in as many phases as a piece has words.
A block found again at a distance that suits its scale is
a seed; the seed is extended to both sides as far as words that distance apart stay equal. A run that spans at least
``repeats`` periods holds an aligned block and its next occurrence whole, so no run is missed: distances under 2^(k+1)
belong to the smallest block, any other distance to the largest power of two within it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.text import WORD, words
from rulelens.plans.reading import spread

#: A run has so many words at least, and so many periods.
LEAST, REPEATS = 24, 3
#: Words whose blocks one automaton holds, unless a single block is longer: bounds its memory.
WINDOW = 1 << 16
_WORD = re.compile(WORD)


def smallest_block(least: int, repeats: int) -> int:
    """The largest power of two ``b`` such that every run with a period under 2b holds an aligned block and its next occurrence."""
    holds = lambda b: all(max(least - q, (repeats - 1) * q) >= 2 * b - 1 for q in range(1, 2 * b))
    b = 1
    while holds(2 * b):
        b *= 2
    return b


def _equal(ids: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1 or -1) equal the one ``d`` further right."""
    n, most, chunk = 0, (len(ids) - d - at if step > 0 else at + 1), 16
    while n < most:
        m = min(chunk, most - n)
        lo = at + n if step > 0 else at - n - m + 1
        differs = np.flatnonzero(ids[lo : lo + m] != ids[lo + d : lo + d + m])
        if len(differs):
            return n + int(differs[0] if step > 0 else m - 1 - differs[-1])
        n, chunk = n + m, chunk * 4
    return n


def _primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether the ``q`` words from ``start`` are no repetition of fewer words."""
    unit, rest, f = ids[start : start + q], q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            if np.array_equal(unit[q // f :], unit[: q - q // f]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def periodic_runs(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch with smallest period q and length >= max(least, repeats * q), by start and period.

    Linear in the words at each of the logarithmically many scales: a seed inside a run already known, at a multiple of
    that run's period, tells nothing new and is passed over.
    """
    if repeats < 3:
        raise ValueError("blocks find every run only from three periods on")
    n, found = len(ids), []
    if n < least:
        return found
    block = smallest_block(least, repeats)
    names, gram, low = ids.astype(np.int64), 1, 1
    while low * repeats <= n:
        high = 2 * block
        starts = np.arange(0, n - block + 1, block)
        recurs = np.bincount(names)[names] > 1  # a block with a piece that comes once recurs nowhere, nor does a larger one
        starts = starts[np.logical_and.reduce([recurs[starts + k] for k in range(0, block, gram)])].tolist()
        if not starts:
            break
        listed = names.tolist()
        inside: dict[int, list[tuple[int, int]]] = {}
        for s, length, q in found:
            for p in range(-(-s // block) * block, s + length - 2 * block + 1, block):
                inside.setdefault(p, []).append((q, s + length))
        last: dict[int, int] = {}
        k, size = 0, max(window, 4 * block)
        while k < len(starts):
            first = starts[k]
            keys: dict[tuple[int, ...], list[int]] = {}
            while k < len(starts) and starts[k] < first + size:
                keys.setdefault(tuple(listed[starts[k] : starts[k] + block : gram]), []).append(starts[k])
                k += 1
            blocks = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, places in keys.items():
                blocks.add_word(key, places)
            blocks.make_automaton()
            for phase in range(first, first + gram):
                for end, places in blocks.iter(tuple(listed[phase : first + size + high + block : gram])):
                    here = phase + (end + 1) * gram - block
                    for p in places[bisect_right(places, here - high) : bisect_right(places, here - low)]:
                        d = here - p
                        if p < last.get(d, 0) or any(d % q == 0 and here + block <= e for q, e in inside.get(p, ())):
                            continue
                        stop = p + block + _equal(ids, p + block, d, 1)
                        start = p - _equal(ids, p - 1, d, -1)
                        last[d] = stop
                        length = stop - start + d
                        if length >= max(least, repeats * d) and _primitive(ids, start, d):
                            found.append((start, length, d))
        block = low = 2 * block
        names = np.unique(names[:-gram] * (int(names.max()) + 1) + names[gram:], return_inverse=True)[1]
        gram *= 2  # pieces double with the blocks, so that keys stay as long
    return sorted(found, key=lambda r: (r[0], r[2]))


def _describe(text: str | None, least: int, repeats: int) -> tuple[int, list[dict[str, int]], str]:
    told = _WORD.findall(text or "")
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in told), np.int64, len(told))
    runs = periodic_runs(ids, least, repeats)
    step = np.zeros(len(told) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    kept = np.cumsum(step)[:-1] == 0
    return len(told), [{"start": s, "length": m, "period": q} for s, m, q in runs], " ".join(w for w, k in zip(told, kept, strict=True) if k)


RUNS = "array<struct<start: long, length: long, period: long>>"


def find_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs by start and period, and its words without repetitions.

    ``collapsed`` keeps of every run the first period's words, joined by one space. A null or empty text has no words
    and no runs; repeated rows, also with one id, are told each for itself; a null id stays null; an empty table gives no
    rows; columns other than doc_id and text are ignored. A text is one task's work, in memory of its own size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                told = [_describe(x.as_py(), least, repeats) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], shape), pa.array([t[2] for t in told], pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(describe, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def repeated(text: Column, doc_id: Column) -> Column:
    """The text as the query reads it: in one of ten documents, by checksum of the id, words repeat from some place on.

    With h the checksum, g = h / 10 and h % 10 = 0, each word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + (n - a) / (3 + g % 8). A null id has no checksum, so its text stays.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise("")

    return F.when(h % 10 == 0, F.transform(F.array(words(text)), rewritten)[0]).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    r = find_runs(docs.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text")))
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(longer(x, best), x).otherwise(best))  # of equals the first in order stays
    line = lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"), "collapsed")
    return r.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SQL = None
