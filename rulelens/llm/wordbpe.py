"""Words of a lower-casing word BPE, as its file's normaliser and splitter give them.

Texts of characters that neither compose with a neighbour nor changed their kind since Unicode 3.2 take a short way
through one regular expression; all others go through the file's own normaliser and splitter. Both ways give the same
words (tests hold them against the tokenizers library, for every such character).
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import regex

SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _plain(c: str) -> bool:
    """Whether a character means the same to every table since Unicode 3.2, stands alone, and is no space or control."""
    kind = unicodedata.category(c)
    same = kind[0] in "LNPS" and kind[0] == unicodedata.ucd_3_2_0.category(c)[0] == unicodedata.category(c.lower()[0])[0]
    return same and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c and not "\u1100" <= c <= "\u11ff"


@lru_cache(maxsize=1)
def _other() -> re.Pattern:
    """Anything that the short way can't be trusted with: marks, odd spaces, late additions, special strings."""
    ranges, last = [], None
    for k in range(0x80, 0xFFFE):
        if _plain(chr(k)):
            if last == k - 1:
                ranges[-1][1] = k
            else:
                ranges.append([k, k])
            last = k
    return re.compile("[^\t\n\r\x20-\x7e" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]|<\\|")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def simple(text: str) -> bool:
    return _other().search(text) is None


def lowered(text: str) -> str:
    """Lower case a character at a time: a sigma is one whether its word ends or not."""
    return text.replace("Σ", "σ").lower()


def simple_words(text: str) -> list[str]:
    """Words of a simple text, lower-cased; encoding each alone gives the text's ids."""
    return _WORD.findall(lowered(text))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def byte_words(path: str, text: str) -> list[str]:
    """Words of any text without special strings, in the byte-level alphabet."""
    t = tokenizer(path)
    return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]
