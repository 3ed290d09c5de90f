"""Encoders over the public vocabulary files, for use inside tasks.

The ids are those of the libraries for the whole text. A byte-level tokenizer file whose merges make
one token each, in the order of the ids, is the same thing as a table of ranks, and is read as one:
the encoder of ranks is several times faster. So is a file of word pieces, if a mark behind every word
stands for the word end. Added tokens of a tokenizer file, which the library takes from a text before
anything else, are cut out there too.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from array import array
from functools import cache

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

# White space runs of this length are split off: the pattern recurses over them and would run out of stack.
_LONG_WHITE = regex.compile(r"\p{White_Space}{20000,}")


@cache
def rank_encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, or of a byte-level tokenizer file without its added tokens."""
    if path.endswith(".json"):
        ranks = _ranks_of(path)
    else:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def _byte_letters() -> dict[str, int]:
    """The letters that tokenizer files write for bytes: printable ones stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level tokenizer file, which must be equal to a table of ranks."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, before, letters = whole["model"], whole["pre_tokenizer"], _byte_letters()
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if not plain or whole["normalizer"] or any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError(f"{path} is not equal to a table of ranks")
    return {bytes(letters[c] for c in token): rank for token, rank in model["vocab"].items()}


def rank_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text. A very long run of white space is a pre-token up to its last character
    (at the end of the text: with it), so it is encoded by itself."""
    if len(text) < 20000 or not (runs := list(_LONG_WHITE.finditer(text))):
        return encoding.encode_ordinary(text)
    ids, done = [], 0
    for run in runs:
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[done : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : stop])
        done = stop
    return ids + encoding.encode_ordinary(text[done:])


@cache
def library_tokenizer(path: str) -> Tokenizer:
    """A tokenizer file as it is: the strings of its added tokens in a text give their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@cache
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids; none for a file of ranks.

    They must be plain strings, taken from the text as it stands, with nothing around them.
    """
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(a[flag] for a in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that are no plain strings")
    return {a["content"]: a["id"] for a in added}


# A single space between two characters that are no white space always begins a pre-token of the
# byte-level pattern, so what follows it depends on nothing before it. Python's white space is a
# superset of the pattern's, hence a cut is never made where the pattern would not cut.
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_level_units(text: str) -> list[str]:
    """Cuts a text where the byte-level pattern cuts it whatever stands around; joined, the text."""
    first, *rest = _SINGLE_SPACE.split(text)
    return [first, *[" " + part for part in rest]]


def _with_added(path: str, plain):
    """A function from a text to its ids as little-endian unsigned 32-bit integers, where `plain` gives those
    of a part that holds no added token."""
    added = added_tokens(path)
    if not added:
        return plain
    # The leftmost, and of several there the longest.
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> bytes:
        first, *rest = cuts.split(text)
        if not rest:
            return plain(first)
        ids = [plain(first)]
        for name, part in zip(rest[::2], rest[1::2]):
            ids += (array("I", [added[name]]).tobytes(), plain(part))
        return b"".join(ids)

    return encode


@cache
def byte_level_encoder(path: str):
    """Ids of texts by a file of ranks or a byte-level tokenizer file."""
    encoding = rank_encoding(path)
    return _with_added(path, lambda text: array("I", rank_ids(encoding, text)).tobytes())


# What a file of word pieces must say of its texts to be read as ranks (fixed values of the file format).
_WORD_FORM = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
# Stands behind every word in place of the word end: no lower-cased text holds it.
_MARK = "A"

_WORDS = regex.compile(_WORD_PATTERN)
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# Characters whose class, case and composition all Unicode versions in use agree on.
_SETTLED = re.compile("[\0-\u0557\u2010-\u206f\u3040-\u3096\u4e00-\u9fa5\uac00-\ud7a3]*")
# Merging a word takes time by its square; the library's does not.
_LONGEST_WORD = 1000
# Pieces of texts that a worker keeps with their ids, at most about 200 MB.
_KEPT_PIECES, _KEPT_BYTES = 1_000_000, 64


@cache
def word_rank_encoding(path: str) -> tiktoken.Encoding:
    """A tokenizer file of lower-cased words with word ends as a table of ranks over words with `_MARK` behind them.

    The last byte of a word with its mark is a token of a lower rank than all merges, so it is joined first.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, letters, mark = whole["model"], _byte_letters(), _MARK.encode()
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    split, level = whole["pre_tokenizer"]["pretokenizers"]
    ends = [vocabulary[letter + _WORD_END] for letter in letters]
    ranks = {}
    for token, rank in vocabulary.items():
        word = token.removesuffix(_WORD_END)
        data = bytes(letters[c] for c in word)
        if mark not in data:
            ranks[data + mark if word != token else data] = rank
        elif len(data) > 1:
            raise ValueError(f"{path} has tokens with capitals")
    if (
        whole["normalizer"]["normalizers"] != _WORD_FORM
        or (split["pattern"], split["behavior"], split["invert"]) != ({"Regex": _WORD_PATTERN}, "Removed", True)
        or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]
        or model["end_of_word_suffix"] != _WORD_END
        or max(ends) >= made[0] or any(a >= b for a, b in zip(made, made[1:]))
    ):
        raise ValueError(f"{path} is not equal to a table of ranks")
    # A mark is never left alone; tables need a rank for every byte of a piece.
    ranks[mark] = max(vocabulary.values()) + 1
    return tiktoken.Encoding(os.path.basename(path), pat_str="[^A]+A", mergeable_ranks=ranks, special_tokens={})


class _LongWord(Exception):
    """A word of more than `_LONGEST_WORD` characters."""


class _Pieces(dict):
    """The ids, as bytes, of what stands between ASCII white space in a composed and lower-cased text.

    A word never goes over white space, so a piece has the same ids wherever it stands. Pieces are kept up
    to a number and a length; any other is encoded again.
    """

    def __init__(self, encoding: tiktoken.Encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        words = [text] if piece.isalpha() else _ASCII_WORDS.findall(text) if piece.isascii() else _WORDS.findall(text)
        if not words:
            return b""
        if len(piece) > _LONGEST_WORD and max(map(len, words)) > _LONGEST_WORD:
            raise _LongWord
        ids = array("I", self.encoding.encode_ordinary(_MARK.join(words) + _MARK)).tobytes()
        if len(piece) <= _KEPT_BYTES and len(self) < _KEPT_PIECES:
            self[piece] = ids
        return ids


@cache
def word_encoder(path: str):
    """Ids of texts by a file of word pieces, as little-endian unsigned 32-bit integers.

    A text with characters whose class newer Unicode versions may have changed, or with a very long word,
    goes to the library as a whole.
    """
    library, ids_of = library_tokenizer(path), _Pieces(word_rank_encoding(path)).__getitem__

    def plain(text: str) -> bytes:
        if text.isascii():
            lower = text.lower()
        elif _SETTLED.fullmatch(text):
            # The library lower-cases characters one by one, a sigma at the end of a word as any other.
            lower = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        else:
            lower = None
        if lower is not None:
            try:
                # Bytes are split at ASCII white space only.
                return b"".join(map(ids_of, lower.encode().split()))
            except _LongWord:
                pass
        return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()

    return _with_added(path, plain)
