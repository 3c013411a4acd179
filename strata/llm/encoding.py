"""Whole texts to token ids with the tokenizers library, over a cache of its pre-tokens."""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Pre-tokens whose ids a worker process keeps; later ones are encoded each time, so memory is bounded.
CACHE = 350_000
#: Characters on which Python's letters, digits, blanks and lower case are surely the library's, and which
#: no normal form joins or changes: ASCII, Latin, Cyrillic, general punctuation, kana, Han and Hangul.
#: A text with any other character is encoded by the library as it is.
_OTHER = re.compile("[^\\t\\n\\r -~¡-¬®-±´-¸º»¿-įı-ǃǍ-ǰЀ-ҁҊ-ԯ‐-‧‰-⁞ぁ-ゖァ-ヺ一-鿿가-힣]")
_PLAIN = b"\t\n\r" + bytes(range(32, 127))
#: The patterns of the two pre-tokenizers that are known here, over those characters.
_BYTE_LEVEL = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
#: What its normalizer does beyond lower case: runs of blanks become one.
_LOWER_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_LOWER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOWER_STEPS = [
    {"type": "Split", "pattern": {"Regex": _LOWER_SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes with: themselves if printable, else from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


class _Ids(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.tokenize = library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        if len(self) < CACHE:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as the library gives them with add_special_tokens=False.

    A model merges only within pre-tokens, so a text's ids are those of its pre-tokens in order.  For the
    two known pre-tokenizers these are cut here and their ids kept; any other tokenizer, a text with
    characters outside the safe ones, or one that holds a special token's string goes to the library whole.
    With ``encode_special`` such strings are ordinary text.
    """

    def __init__(self, path: str, end_id: int | None, encode_special: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = encode_special
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.width = 2 if max(self.library.get_vocab_size(), end_id or 0) <= 65535 else 4
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before, form = made.get("pre_tokenizer") or {}, made.get("normalizer") or {}
        self.pattern, self.lower = None, False
        if made["model"]["type"] == "BPE" and not made["model"].get("ignore_merges"):
            if not form and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
                self.pattern = _BYTE_LEVEL
            elif form.get("normalizers") == _LOWER_FORM and before.get("pretokenizers") == _LOWER_STEPS:
                self.pattern, self.lower = _LOWER_WORDS, True
        self.special = [x["content"] for x in made.get("added_tokens", ())]
        self.ids = _Ids(self.library)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, with the end id; null is empty."""
        text = text or ""
        rest = text.encode().translate(None, _PLAIN)  # what isn't ASCII stays, in whole characters
        if self.pattern is None or (rest and _OTHER.search(rest.decode())) or any(x in text for x in self.special):
            return self.whole(text) + self.end
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        return b"".join(map(self.ids.__getitem__, pieces)) + self.end


@functools.lru_cache(maxsize=4)
def encoder(path: str, end_id: int | None, encode_special: bool = False) -> Encoder:
    """The encoder of this process; its tables load once."""
    return Encoder(path, end_id, encode_special)
