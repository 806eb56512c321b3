"""Tokenizers over Arrow text columns, with results memoised for the pieces that texts are made of.

A text is cut only where its tokens cannot cross: the tokens of the whole text are those of its pieces in a row. A piece
that the memo hasn't is encoded by the library. Of the two kinds of tokenizer that ``_KINDS`` describes, pieces of plain
Latin characters are split here by the tokenizer's own rule and go straight to the library's BPE model, which saves its
bookkeeping of offsets; all other pieces and tokenizers take the library's whole way.

The tokenizer file's path is a parameter. A worker process loads a file once and keeps its memo for later tasks; a memo is
emptied when it is full, so memory is bounded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array

#: Pieces that a memo holds, and the longest piece that it takes.
MEMO_PIECES = 600_000
MEMO_CHARS = 64
_RISKY = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")

# The pre-tokenizer settings of the two kinds, as their files have them.
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: By kind: plain pieces (NFC leaves them as they are, no character is part of an added token), split, lower case.
_KINDS = {
    "words": (re.compile(rf"[!-;=-~{_LATIN}]*\Z"), re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+"), True),
    "bytes": (re.compile(rf"[\n -;=-~{_LATIN}]*\Z"), re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"), False),
}


def _byte_characters() -> dict[int, int]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTES = _byte_characters()


def _kind(tokenizer) -> str | None:
    config = json.loads(tokenizer.to_str())
    normal, before = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    level = {"type": "ByteLevel", "add_prefix_space": False}
    if any("<" not in x["content"] for x in config["added_tokens"]) or config["model"]["type"] != "BPE" or config["model"].get("dropout"):
        return None
    if not normal and before.items() >= {**level, "use_regex": True}.items():
        return "bytes"
    steps = before.get("pretokenizers", [])
    if normal.get("normalizers") == _WORD_NORMAL and len(steps) == 2 and steps[1].items() >= {**level, "use_regex": False}.items():
        if steps[0].items() >= {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}.items():
            return "words"
    return None


def words(text: str) -> list[bytes]:
    """The runs between ASCII white space: pieces of a text for tokenizers that drop white space."""
    return text.encode().split()


def spaced(text: str) -> list[str]:
    """Pieces of a text for byte-level tokenizers: cut before each space that follows something other than white space."""
    if _RISKY.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


class Memo(dict):
    """Maps a piece (text or UTF-8) to ``value(ids)``; looking up a piece that isn't there encodes it."""

    def __init__(self, path: str, value):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.value = Tokenizer.from_file(path), value
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, kind = self.tokenizer.model, _kind(self.tokenizer)
        self.plain, self.split, self.lower = _KINDS[kind] if kind else (None, None, False)

    def encode(self, piece: str) -> list[int]:
        if self.plain is None or not self.plain.match(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids: list[int] = []
        for part in self.split.findall(piece.lower() if self.lower else piece):
            written = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(_BYTES)
            ids += [t.id for t in self.model.tokenize(written)]
        return ids

    def __missing__(self, piece):
        value = self.value(self.encode(piece.decode() if isinstance(piece, bytes) else piece))
        if len(piece) <= MEMO_CHARS:
            self[piece] = value
        return value

    def trim(self) -> Memo:
        """Empty the memo if it is full; to be called between texts."""
        if len(self) > MEMO_PIECES:
            self.clear()
        return self


def id_bytes(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def memo(path: str, value) -> Memo:
    """This process's memo of a tokenizer file and a value, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store = sys.modules.setdefault("_worker_memos", types.ModuleType("_worker_memos")).__dict__
    key = f"{path}\x00{value.__name__}"
    if key not in store:
        store[key] = Memo(path, value)
    return store[key]
