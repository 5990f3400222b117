"""Token ids of whole texts by a vocabulary of the tokenizers library, remembered by word.

Where the vocabulary drops white space and ignores case, a text may be cut at spaces and line ends and
each part encoded by the library on its own; parts repeat, and a bounded table keeps the ids of short
ones. Parts keep any other white space, which the library then treats as it would in the whole text.
Whether a vocabulary is of this kind is read off its definition and tried on sentences; any other one
encodes whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Parts of up to so many characters are remembered; so many parts, and so many words, at most
#: (about 200 bytes each).
REMEMBERED_CHARS, REMEMBERED_PARTS, REMEMBERED_WORDS = 48, 300_000, 400_000


def _byte_letters() -> dict[int, str]:
    """What a byte-level vocabulary writes for each Latin-1 letter above ASCII: a character for each of
    its UTF-8 bytes, printable bytes as themselves and the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class _Words(dict):
    """Ids by lower-case word or by any other part.

    A word of plain Latin letters needs no normalising or splitting: the vocabulary's merges are
    applied to it directly, which is more than twice as fast; other parts go through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merged, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        if not part:
            return b""
        if part.isalpha() and max(part) < "\u0100" and part.islower():
            ids = [t.id for t in self.merged(part if part.isascii() else part.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        if len(part) <= REMEMBERED_CHARS and len(self) < REMEMBERED_WORDS:
            self[part] = raw
        return raw


class _Parts(dict):
    """Ids by part. The vocabulary ignores case and a comma or full stop after a letter is a token
    of its own, so parts of plain Latin letters share the entry of their lower-case word. What comes
    when the table is full is worked out again each time: frequent words come early."""

    def __init__(self, path: str):
        self.words = _Words(path)

    def __missing__(self, part: str) -> bytes:
        words, tail = self.words, b""
        word = part
        if part and max(part) < "\u0100":
            word = part.lower()
            if len(word) > 1 and word[-1] in ".," and word[-2].isalpha():
                tail, word = words[word[-1]], word[:-1]
        ids = words[word] + tail
        if len(part) <= REMEMBERED_CHARS and len(self) < REMEMBERED_PARTS:
            self[part] = ids
        return ids


#: Sentences on which a vocabulary must give the same ids whole and by parts.
_TRIALS = ("The word, the Word and THE WORD.", "two  blanks\n\nand lines \n here", " edges ", "don't we'll it's x2y 3.5 a-b", "Zoë NAÏVE Äpfel, été.", "漢字 mixed with ɣ and 🙂 signs!")


@lru_cache(maxsize=2)
def parts(path: str) -> _Parts | None:
    """The table of parts; None for a vocabulary that needs whole texts."""
    table = _Parts(path)
    rules = json.loads(table.words.tokenizer.to_str())
    steps = [rules["normalizer"] or {}, *(rules["normalizer"] or {}).get("normalizers", [])]
    if not any(r.get("type") == "Lowercase" or r.get("lowercase") for r in steps):
        return None
    whole = table.words.tokenizer
    return table if all(_by_parts(t, table) == _whole(t, whole) for t in _TRIALS) else None


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def largest_id(path: str) -> int:
    """The largest id of a vocabulary."""
    return max(_tokenizer(path).get_vocab(with_added_tokens=True).values(), default=0)


def _by_parts(text: str, table: _Parts) -> bytes:
    return b"".join(map(table.__getitem__, text.replace("\n", " ").split(" ")))


def _whole(text: str, tokenizer) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def ids_of(text: str | None, path: str) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
    if not text:
        return b""
    table = parts(path)
    return _whole(text, _tokenizer(path)) if table is None else _by_parts(text, table)
