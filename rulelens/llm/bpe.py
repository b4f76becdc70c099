"""BPE encoding and decoding, long texts by tree concatenation.

A text beyond ``limit`` characters is cut into pieces that are encoded in parallel wherever they stand, in the
middle of words too. Then neighbours are joined in a tree: a window around each join is encoded and grown until,
left and right of the join, it holds tokens that the side holds at the same place; there the three encodings are
spliced. A BPE encoding is right as soon as each two neighbouring tokens are, so a splice at a common token is
exact. Tokens near a cut or the window's own ends, where special strings or composed characters may have been cut,
never count as agreement; a window that covers both sides needs none.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.wordbpe import default_path, simple, simple_words, tokenizer
from rulelens.plans.scratch import save

#: Characters beyond which a text is cut; a join's first window; how far from a cut tokens may be wrong.
LIMIT, WINDOW, GUARD = 32_768, 128, 24
#: Words of up to so many characters whose ids a worker keeps.
KEPT_WORDS, LONGEST_KEPT = 400_000, 64


class _Words(dict):
    """The bytes of each word's ids, encoded when first met."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = tokenizer(path).encode

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def _words(path: str) -> _Words:
    return _Words(path)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text; words of simple texts are encoded once a worker."""
    known = _words(path)
    if len(known) > KEPT_WORDS:
        known.clear()
    easy = [simple(x) for x in texts]
    whole = iter(tokenizer(path).encode_batch_fast([x for x, e in zip(texts, easy, strict=True) if not e], add_special_tokens=False))
    return [np.frombuffer(b"".join(map(known.__getitem__, simple_words(x))), np.int32) if e else np.array(next(whole).ids, np.int32) for x, e in zip(texts, easy, strict=True)]


@lru_cache(maxsize=4)
def _tokens(path: str) -> np.ndarray:
    t = tokenizer(path)
    return np.array([t.id_to_token(k) for k in range(t.get_vocab_size())], object)


def decode_ids(path: str, lists: list[np.ndarray]) -> list[str]:
    """Texts of ids; a file without a decoder joins its tokens by spaces."""
    if tokenizer(path).decoder is None:
        return [" ".join(_tokens(path)[x].tolist()) for x in lists]
    return tokenizer(path).decode_batch([x.tolist() for x in lists], skip_special_tokens=False)


class Piece:
    """A stretch of a text, its ids and where each token starts and ends in the text."""

    def __init__(self, path: str, text: str, start: int, end: int):
        e = tokenizer(path).encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, np.array(e.ids, np.int64)
        self.places = np.array(e.offsets, np.int64).reshape(-1, 2) + start

    @classmethod
    def of(cls, start: int, end: int, ids: np.ndarray, places: np.ndarray) -> Piece:
        made = cls.__new__(cls)
        made.start, made.end, made.ids, made.places = start, end, ids, places
        return made

    def rows(self) -> dict[tuple[int, int, int], int]:
        return {(i, a, b): k for k, (i, (a, b)) in enumerate(zip(self.ids.tolist(), self.places.tolist(), strict=True))}


def _settled(text: str, at: int) -> bool:
    """Whether composing characters can't reach across this place."""
    a, b = text[max(0, at - 4) : at], text[at : at + 4]
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return not b or (unicodedata.combining(b[0]) == 0 and nfc(a + b) == nfc(a) + nfc(b))


def _agreed(side: Piece, window: Piece, low: int, high: int, text: str) -> list[tuple[int, int]]:
    """(place in side, place in window) of tokens within low..high that both hold, each followed by a second one."""
    held, found, tokens = side.rows(), [], list(window.rows().items())
    for (this, q), (after, _) in zip(tokens, tokens[1:], strict=False):
        if this[1] >= low and after[2] <= high and this[2] > this[1] and this[2] <= after[1] and (p := held.get(this)) is not None and held.get(after) == p + 1 and _settled(text, this[2]):
            found.append((p, q))
    return found


def _near(side: Piece, low: int, high: int) -> Piece:
    """Tokens of a side around a window, so that a join costs no more than its window."""
    a, b = np.searchsorted(side.places[:, 0], [low, high])
    return Piece.of(side.start + int(a), 0, side.ids[a:b], side.places[a:b])


def join(path: str, text: str, left: Piece, right: Piece, window: int = WINDOW) -> Piece:
    """The encoding of both stretches from those of each."""
    seam = left.end
    while True:
        low, high = max(left.start, seam - window), min(right.end, seam + window)
        between = Piece(path, text, low, high)
        before, after = (0, 0), (len(right.ids), len(between.ids))  # as they stand where the window covers a side
        if low > left.start:
            near = _near(left, low, seam)
            both = _agreed(near, between, low + GUARD, seam - GUARD, text)
            before = (near.start - left.start + both[-1][0] + 1, both[-1][1] + 1) if both else None
        if high < right.end:
            near = _near(right, seam, high)
            both = _agreed(near, between, seam + GUARD, high - GUARD, text)
            after = (near.start - right.start + both[0][0], both[0][1]) if both else None
        if before and after:
            cut = lambda x: np.concatenate([getattr(left, x)[: before[0]], getattr(between, x)[before[1] : after[1]], getattr(right, x)[after[0] :]])  # noqa: E731, B023
            return Piece.of(left.start, right.end, cut("ids"), cut("places"))
        window *= 2


def join_tree(path: str, text: str, pieces: list[Piece]) -> Piece:
    while len(pieces) > 1:
        pairs = [join(path, text, *pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
        pieces = pairs
    return pieces[0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32, copy=False)))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls, as views of its values."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _encode_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = _lists(encode_texts(path, part.column("_text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def _cut(limit: int):
    """Pieces of each text, cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column("_row"), batch.column("_text"), strict=True):
                text = x.as_py()
                for k in range(0, len(text), limit):
                    yield pa.RecordBatch.from_pylist([{"_row": row.as_py(), "k": k // limit, "piece": text[k : k + limit]}], _CUT)

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("piece")[k].as_py()
                p = Piece(path, text, 0, len(text))
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column("_row"), row.column("k"), row.column("piece"), _lists([p.ids]), _lists([p.places.ravel()])], schema=_PIECES)

    return run


_CUT = pa.schema([("_row", pa.int64()), ("k", pa.int32()), ("piece", pa.string())])
_PIECES = pa.schema([("_row", pa.int64()), ("k", pa.int32()), ("piece", pa.string()), ("ids", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
_JOINED = pa.schema([("_row", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _join_pieces(path: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("k").combine_chunks()
        parts = table.column("piece").to_pylist()
        ids, places = (_arrays(table.column(c).combine_chunks()) for c in ("ids", "places"))
        text, at, pieces = "".join(parts), 0, []
        for part, i, p in zip(parts, ids, places, strict=True):
            pieces.append(Piece.of(at, at + len(part), i.astype(np.int64), p.astype(np.int64).reshape(-1, 2) + at))
            at += len(part)
        return pa.Table.from_arrays([table.column("_row").slice(0, 1), _lists([join_tree(path, text, pieces).ids])], schema=_JOINED)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``.

    A null text is empty and has no ids; repeated rows stay repeated; an empty table gives no rows; other
    columns are ignored. Texts within ``limit`` are encoded where they are read; only pieces of longer ones
    are dealt out.
    """
    path = path or default_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.length("_text") <= limit).mapInArrow(_encode_whole(path), f"doc_id {kind}, ids array<int>")
    long = save(rows.where(F.length("_text") > limit).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    cut = long.select("_row", "_text").mapInArrow(_cut(limit), "_row long, k int, piece string")
    pieces = cut.repartition(tasks, "_row", "k").mapInArrow(_encode_pieces(path), "_row long, k int, piece string, ids array<int>, places array<int>")
    joined = pieces.groupBy("_row").applyInArrow(_join_pieces(path), "_row long, ids array<int>")
    return short.unionByName(long.select("doc_id", "_row").join(joined, "_row").select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column ``decoded``; no ids decode to the empty text."""
    path = path or default_path()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = decode_ids(path, _arrays(part.column("ids")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, **options) -> DataFrame:
    """Encode, decode, and digest both."""
    told = decode(encode(docs, **options), options.get("path"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
