"""Encoding and counting against the tokenizers library."""

import hashlib
import random

import pytest

from rulelens.llm import bpe, token_counts, wordbpe

PATH = wordbpe.default_path()
ODD = [
    "", " ", "a", "They're we'll I'd it's", "don't<|endoftext|>x <|startoftext|>", "<|endoftext|", "ΟΔΟΣ Σ", "İstanbul ǅ", "été ́x", "x y z\x85w", "日本語のテキスト", "한국어 한",
    "1234 5½²", "a\x00b\x1cc", "''s !'t", "🙂🙃 ok", "क़ऩ", "abc" * 300, "thinghe" * 200, "<|endo ftext|>", "ß ẞ ŉ ﬁ", "A\tB\r\nC\x0b\x0cD",
]


def library(x):
    return wordbpe.tokenizer(PATH).encode(x, add_special_tokens=False).ids


def noise(rng, n):
    parts = ["the ", "erth", "'re", "é", "é", "<|endoftext|>", "日本", " ", "\n", "12", "...", "Σ", "ation", "q" * 9, "<|", "́", "Ŀ", "'"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_every_simple_character():
    """Both ways give the same ids and counts for each character that the short way is trusted with."""
    t, lib = token_counts.transducer(PATH), wordbpe.tokenizer(PATH)
    plain = [chr(k) for k in range(1, 0xFFFE) if not 0xD800 <= k < 0xE000 and wordbpe.simple(chr(k))]
    assert len(plain) > 30_000 and {*"ЖжשقกΣσ中한“”—€½"} <= {*plain}
    every = 1 if len(plain) < 5000 else 3
    texts = [f"a{c}b {c}{c}'s 1{c}" for c in plain]
    for k in range(0, len(texts), 2000):
        some = texts[k : k + 2000]
        for x, e in zip(some, lib.encode_batch_fast(some, add_special_tokens=False)):
            assert t.count(x) == len(e.ids), repr(x)
    for x in texts[::25]:
        assert bpe.encode_texts(PATH, [x])[0].tolist() == library(x), repr(x)


@pytest.mark.parametrize("x", ODD)
def test_odd_texts(x):
    assert bpe.encode_texts(PATH, [x])[0].tolist() == library(x)
    t = token_counts.transducer(PATH)
    assert t.count(x) == token_counts.total(t, [token_counts.chunk_map(t, x)]) == len(library(x))


def test_tree_concatenation_is_exact_at_any_cut():
    rng = random.Random(5)
    for n in range(150):
        x = noise(rng, 160) if n % 3 else "".join(rng.choice(["th", "er", "tion", "ing", "é", "q"]) for _ in range(260))
        cuts = [0, *sorted(rng.sample(range(1, len(x)), rng.choice([1, 3, 6]))), len(x)]
        pieces = [bpe.Piece(PATH, x, a, b) for a, b in zip(cuts, cuts[1:])]
        assert bpe.join_tree(PATH, x, pieces).ids.tolist() == library(x)


def test_small_windows_agree_or_grow():
    rng = random.Random(6)
    for _ in range(150):
        x = noise(rng, 200)
        cut = rng.randrange(1, len(x))
        made = bpe.join(PATH, x, bpe.Piece(PATH, x, 0, cut), bpe.Piece(PATH, x, cut, len(x)), window=2 * bpe.GUARD + 2)
        assert made.ids.tolist() == library(x)


def cut_up(x, cuts, t):
    ends = [0, *cuts, len(x)]
    return [token_counts.chunk_map(t, x[a:b], x[max(0, a - 64) : a]) for a, b in zip(ends, ends[1:])]


def test_chunk_maps_compose():
    rng, t = random.Random(7), token_counts.transducer(PATH)
    words = ["abc", "<|endoftext|>", "<", "|", "don't", "''", "ж", "--", "x'", "12", " ", "“", "Σ", "é"]
    for n in range(400):
        x = noise(rng, 80) if n % 2 else "".join(rng.choice(words) for _ in range(rng.randrange(8, 60)))
        maps = cut_up(x, sorted(rng.sample(range(1, len(x)), 5)), t)
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = token_counts.compose(t, left, m)
        for m in maps[-2::-1]:
            right = token_counts.compose(t, m, right)
        assert token_counts.total(t, maps) == token_counts.total(t, [left]) == token_counts.total(t, [right]) == len(library(x)), x


def test_one_word_over_many_chunks():
    """State maps compose inside text that no space cuts, at any cut, and a wrong guess is run again."""
    rng, t = random.Random(12), token_counts.transducer(PATH)
    parts = ["th", "er", "tion", "ing", "é", "q", "ж", "aaaa", "中"]
    for n in range(60):
        x = ("".join(rng.choice(parts) for _ in range(300)), "a" * 700, "=-" * 300, "thinghe" * 100)[n % 4]
        for cuts in (sorted(rng.sample(range(1, len(x)), 9)), range(100, len(x), 100)):
            maps = cut_up(x, cuts, t)
            assert all(m[2] is None and m[0][0].exit for m in maps)  # maps from state to state, no text left to count
            assert token_counts.total(t, maps) == len(library(x))
            lost = [(tuple(token_counts.Stretch(p.text, p.kind, ("x", ()), p.exit, p.count) for p in m[0]), *m[1:]) for m in maps]
            assert token_counts.total(t, lost) == len(library(x))
    natural = cut_up("".join(rng.choice(parts[:5]) for _ in range(3000)), range(500, 5000, 500), t)
    met = natural[0]
    for m in natural[1:]:
        met = token_counts.compose(t, met, m)
    assert len(met[0]) < len(natural)  # guesses hold


def test_other_scripts_cost_about_the_same():
    import time

    rng = random.Random(3)
    latin = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9)) for _ in range(400)) for _ in range(120)]
    quoted, cyrillic = [f"“{x}” — ok" for x in latin], [x.replace("alpha", "альфа").replace("gamma", "гамма") for x in latin]
    took = []
    for texts in (latin, quoted, cyrillic):
        t = token_counts.Transducer(PATH)
        t.count(texts[0])
        began = time.perf_counter()
        for x in texts:
            t.count(x)
        took.append(time.perf_counter() - began)
    assert max(took[1:]) < 2 * took[0] + 0.02, took


def test_jobs(spark):
    rng = random.Random(8)
    texts = [*ODD, None, noise(rng, 3000), "erth" * 5000, *[noise(rng, 40)] * 2]
    df = spark.createDataFrame([(k, x, "clash", 1) for k, x in enumerate(texts)] + [(None, "a b", None, None)], "doc_id long, text string, ids string, _row int")
    got = {r.doc_id: r for r in bpe.digests(df, limit=700).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(df, chunk=700).collect()}
    assert len(got) == len(counts) == len(texts) + 1
    t = wordbpe.tokenizer(PATH)
    for k, x in enumerate(texts):
        ids = library(x or "")
        assert (counts[k].n_tokens, counts[k].n_bytes) == (len(ids), len((x or "").encode()))
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = df.where("doc_id < -5")
    assert bpe.digests(empty).count() == 0 and token_counts.count_tokens(empty).count() == 0
