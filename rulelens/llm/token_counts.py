"""Token counts by a compiled finite-state transducer.

A word BPE is compiled, as far as texts ask for it, into a deterministic transducer over a word's characters. What
counts of the characters read so far are the places from which some token may still be running: the last characters,
as far as they begin a token, with the token that ends the encoding of what stands before each. Of a token that ends
at the next character the longest one that may follow wins (two tokens may follow one another if merging their joint
text gives just them), so a state and a character give one next state, and the transition carries how many tokens the
encoding grows by; it may shrink where characters merge. A word's end has a count of its own in each state. Words met
before are transitions over all their characters at once.

A chunk of a long text is a map from the state it is entered in. Between words the transducer starts anew, so most
chunks depend on what stands before them only up to their first word border, and what they hold after the last one
waits for what follows. A chunk within one long word is a map from state to state and count: it is run from the state
that the characters before it suggest, and holds for that state; entered in another one, it is run again. These maps
compose associatively, so the chunks of a text are counted in parallel and combined in a tree.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm.wordbpe import SPECIAL, byte_alphabet, byte_words, default_path, lowered, simple, simple_words, tokenizer
from rulelens.plans.scratch import save

CHUNK, MAX_TOKENS = 32_768, 2048
#: Words of up to 64 characters, pairs of tokens and states that a worker keeps; beyond, it starts anew.
KEPT_WORDS, LONGEST_KEPT, KEPT_PAIRS, KEPT_STATES = 600_000, 64, 1_000_000, 300_000
#: Characters before a chunk from which its state is guessed; the longest special string.
LOOKBACK, SPECIAL_LENGTH = 64, 17

#: Places at which a word ends whatever stands around: at spaces and numbers, and between letters and other characters
#: except apostrophes (which may begin a contraction).
_BORDER = r"(?<=[\s\p{N}])|(?=[\s\p{N}])|(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"
_FIRST, _LAST = regex.compile(_BORDER), regex.compile("(?r)" + _BORDER)
_SPACES = regex.compile(r"[ \t\n\r\x0b\x0c]")
_KINDS = {"letters": regex.compile(r"\p{L}+"), "others": regex.compile(r"[^\s\p{L}\p{N}']+")}

#: The last characters, and for each place among them that a token may run from: how many characters ago, the token
#: that ends there (None: the word begins), and its count less the present one.
State = tuple[str, tuple[tuple[int, str | None, int], ...]]
START: State = ("", ((0, None, 0),))


class _Counts(dict):
    """Counts of words, found when first met."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = n
        return n


class Transducer:
    """States, transitions with counts, and counts at a word's end, compiled from a vocabulary and ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        # Tokens as tuples of symbols can be told from their text: only a last symbol may carry the end mark.
        self.inner = {t for t in model["vocab"] if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end) for t in model["vocab"] if t.endswith(self.end)}
        self.begun = {t[:k] for t in self.inner | self.final for k in range(1, len(t) + 1)}
        self.follows: dict[tuple[str, str, bool], bool] = {}
        self.shown = byte_alphabet()
        self.plain_words = _Counts(lambda w: self.count_word(self.bytes_of(w)))
        self.byte_words = _Counts(self.count_word)
        self.forget()

    def forget(self) -> None:
        self.places: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.next: dict[tuple[int, str], tuple[int, int] | None] = {}
        self.ends: dict[int, int | None] = {}

    def bytes_of(self, text: str) -> str:
        return "".join(map(self.shown.__getitem__, text.encode()))

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols merged by rank, leftmost first; used on pairs of tokens only."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 40))
            if best not in self.rank:
                break
            out, k = [], 0
            while k < len(symbols):
                both = k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == best
                out.append(symbols[k] + symbols[k + 1] if both else symbols[k])
                k += 2 if both else 1
            symbols = out
        return symbols

    def may_follow(self, a: str | None, b: str, last: bool) -> bool:
        """Whether token ``b`` (the word's last one, or not) may stand after ``a``, or at a word's start."""
        key = (a or "", b, last)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > KEPT_PAIRS:
                self.follows.clear()
            symbols = list((a or "") + b)
            if last:
                symbols[-1] += self.end
            known = self.follows[key] = self.merged(symbols) == [*([a] if a else []), b + self.end if last else b]
        return known

    def place(self, state: State) -> int:
        at = self.places.get(state)
        if at is None:
            at = self.places[state] = len(self.states)
            self.states.append(state)
        return at

    def compile_step(self, at: int, c: str) -> tuple[int, int] | None:
        """The transition from a state on a character: next state and tokens gained; None if no token ends there."""
        text, live = self.states[at]
        text += c
        for k, before, count in live:  # longest first
            token = text[len(text) - k - 1 :]
            if token in self.inner and self.may_follow(before, token, False):
                break
        else:
            return None
        gained = count + 1
        still = [(k + 1, before, n - gained) for k, before, n in live if text[len(text) - k - 1 :] in self.begun]
        longest = still[0][0] if still else 0
        return self.place((text[len(text) - longest :], (*still, (0, token, 0)))), gained

    def compile_end(self, at: int) -> int | None:
        """Tokens gained if the word ends in this state."""
        text, live = self.states[at]
        for k, before, count in live:
            token = text[len(text) - k :]
            if k and token in self.final and self.may_follow(before, token, True):
                return count + 1
        return None

    def run(self, state: State, text: str) -> tuple[State, int] | None:
        """State and tokens after ``text`` (in the byte alphabet); None where the table has no way on."""
        if len(self.states) > KEPT_STATES:
            self.forget()
        at, total, table = self.place(state), 0, self.next
        for c in text:
            step = table.get((at, c), False)
            if step is False:
                step = table[at, c] = self.compile_step(at, c)
            if step is None:
                return None
            at, gained = step
            total += gained
        return self.states[at], total

    def at_end(self, state: State) -> int | None:
        at = self.place(state)
        if at not in self.ends:
            self.ends[at] = self.compile_end(at)
        return self.ends[at]

    def count_word(self, word: str) -> int:
        """Tokens of a word in the byte alphabet; a word that the table can't spell is left to the library."""
        done = self.run(START, word)
        last = self.at_end(done[0]) if done else None
        if last is None:
            return len(tokenizer(self.path).model.tokenize(word))
        return done[1] + last

    def count(self, text: str) -> int:
        if simple(text):
            if len(self.plain_words) > KEPT_WORDS:
                self.plain_words.clear()
            return sum(map(self.plain_words.__getitem__, simple_words(text)))
        if len(self.byte_words) > KEPT_WORDS:
            self.byte_words.clear()
        parts = SPECIAL.split(text)
        return len(parts) - 1 + sum(sum(map(self.byte_words.__getitem__, byte_words(self.path, p))) for p in parts)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@dataclass(frozen=True)
class Stretch:
    """Part of a word, or of what may be one: its text and kind, and, where known, that from state ``entry`` it leads
    to state ``exit`` and gains ``count`` tokens."""

    text: str
    kind: str | None = None
    entry: State | None = None
    exit: State | None = None
    count: int = 0


#: What stands before a chunk's first border, the tokens between, and what stands after the last border (None: there
#: is no border, and all of the chunk is in the first part).
Map = tuple[tuple[Stretch, ...], int, tuple[Stretch, ...] | None]


def _kind(text: str) -> str | None:
    return next((k for k, p in _KINDS.items() if p.fullmatch(text)), None) if simple(text) else None


def chunk_map(t: Transducer, text: str, before: str = "") -> Map:
    """The map of a chunk that ``before`` (some characters, or all) stands before."""
    if not simple(text):
        borders = [m.start() for m in (_SPACES.search(text),) if m], [m.start() + 1 for m in (regex.search(f"(?r){_SPACES.pattern}", text),) if m]
    else:
        # A special string that began before the chunk has ended by its SPECIAL_LENGTH-th character, or at a space or number.
        first = regex.search(r"[\s\p{N}]", text[:SPECIAL_LENGTH])
        first = first or _FIRST.search(text, SPECIAL_LENGTH)
        last = _LAST.search(text)
        borders = [first.start()] if first else [], [last.start()] if last else []
    if borders[0] and borders[1] and borders[0][0] <= borders[1][0]:
        a, b = borders[0][0], borders[1][0]
        return _part(text[:a]), t.count(text[a:b]), _part(text[b:])
    kind = _kind(text)
    if kind is None:
        return _part(text), 0, None
    run = regex.search(f"(?:{_KINDS[kind].pattern})$", before) if simple(before) else None
    entered = t.run(START, t.bytes_of(lowered(run[0]))) if run else (START, 0)
    left = entered and t.run(entered[0], t.bytes_of(lowered(text)))
    if not left:
        return _part(text), 0, None
    return (Stretch(text, kind, entered[0], *left),), 0, None


def _part(text: str) -> tuple[Stretch, ...]:
    return (Stretch(text, _kind(text)),) if text else ()


def _meet(a: tuple[Stretch, ...], b: tuple[Stretch, ...]) -> tuple[Stretch, ...]:
    """Neighbouring stretches; two of which the first leads to where the second was entered become one."""
    if a and b and a[-1].exit is not None and a[-1].kind == b[0].kind and a[-1].exit == b[0].entry:
        both = Stretch(a[-1].text + b[0].text, b[0].kind, a[-1].entry, b[0].exit, a[-1].count + b[0].count)
        return (*a[:-1], both, *b[1:])
    return a + b


def _close(t: Transducer, parts: tuple[Stretch, ...]) -> int:
    """Tokens of stretches that borders enclose: one word, if all are of one kind."""
    if not parts:
        return 0
    if len({p.kind for p in parts}) == 1 and parts[0].kind:
        at: tuple[State, int] | None = (START, 0)
        for p in parts:
            step = (p.exit, p.count) if p.entry == at[0] else t.run(at[0], t.bytes_of(lowered(p.text)))
            if step is None:
                break
            at = step[0], at[1] + step[1]
        else:
            last = t.at_end(at[0])
            if last is not None:
                return at[1] + last
    return t.count("".join(p.text for p in parts))


def compose(t: Transducer, a: Map, b: Map) -> Map:
    """The map of two neighbouring chunks."""
    if a[2] is None:
        return _meet(a[0], b[0]), b[1], b[2]
    if b[2] is None:
        return a[0], a[1], _meet(a[2], b[0])
    return a[0], a[1] + _close(t, _meet(a[2], b[0])) + b[1], b[2]


def total(t: Transducer, maps: list[Map]) -> int:
    while len(maps) > 1:
        maps = [compose(t, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    head, inner, tail = maps[0]
    return _close(t, head) + inner + _close(t, tail or ())


_MAPS = pa.schema([("_row", pa.int64()), ("k", pa.int32()), ("map", pa.binary())])
_COUNTS = pa.schema([("_row", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``.

    A null text is empty: no bytes, no tokens. Repeated rows stay repeated; an empty table gives no rows; other
    columns are ignored. Chunks of texts beyond ``chunk`` characters are dealt out; other texts are one chunk.
    """
    path = path or default_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            counts = [t.count(x.as_py()) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column("_row"), batch.column("_text"), strict=True):
                whole = x.as_py()
                for k in range(0, len(whole), chunk):
                    yield pa.RecordBatch.from_pylist([{"_row": row.as_py(), "k": k // chunk, "piece": whole[k : k + chunk], "before": whole[max(0, k - LOOKBACK) : k]}], _PIECES)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            made = [{"_row": r["_row"], "k": r["k"], "map": pickle.dumps(chunk_map(t, r["piece"], r["before"]))} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(made, _MAPS)

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        n = total(transducer(path), [pickle.loads(m) for m in table.column("map").to_pylist()])  # written by ``maps`` above
        return pa.Table.from_pylist([{"_row": table.column("_row")[0].as_py(), "n_tokens": n}], _COUNTS)

    short = rows.where(F.length("_text") <= chunk).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")
    long = save(rows.where(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id()), "count-long")
    pieces = long.select("_row", "_text").mapInArrow(cut, "_row long, k int, piece string, before string")
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    told = pieces.repartition(tasks, "_row", "k").mapInArrow(maps, "_row long, k int, map binary").groupBy("_row").applyInArrow(scan, "_row long, n_tokens long")
    return short.unionByName(long.select("doc_id", "n_bytes", "_row").join(told, "_row").select("doc_id", "n_bytes", "n_tokens"))


_PIECES = pa.schema([("_row", pa.int64()), ("k", pa.int32()), ("piece", pa.string()), ("before", pa.string())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


SQL = None
