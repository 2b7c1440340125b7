"""Byte-level BPE of whole texts with the tokenizers library, with a shortcut for pre-tokens seen before.

A text is cut at the special strings, then into pre-tokens. A pre-token that is a vocabulary string proven to encode alone as
one token needs no merging; any other is merged and remembered in a bounded table.

The cut into pre-tokens uses Python's re inside SAFE, blocks of characters over which its classes equal the library's; a text
with any other character goes to the library whole. Both ways give the library's ids.

Ids (not counts) come from tiktoken, pattern and merges together, where its merges are proven to be the library's: its pattern has
re's classes within SAFE, written out. It gets blocks, cut where a pre-token begins in any case, as its pattern fails on very long runs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

#: Fixed value: the pattern of the vocabulary's pre-tokenizer, in terms of re's classes. Within SAFE, letters are what is in \w but
#: neither digit nor underscore, and numbers are \d.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
SAFE = r"\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u0530\u1E00-\u1FFF\u2010-\u205F\u20A0-\u20BF\u3040-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3\U0001F300-\U0001F5FF"
#: Pre-tokens remembered by a worker at most, and the longest one that is.
REMEMBERED, LONGEST = 250_000, 64
#: Characters that tiktoken gets at a time, about, and at most; a block without a place for a cut is longer and goes the other way.
BLOCK, MOST_BLOCK = 1 << 16, 1 << 17
#: A single blank between other characters belongs to the pre-token that it begins, so a text may be cut before it.
CUT = re.compile(r" (?<=\S )(?=\S)")


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def direct_pattern() -> str:
    """PRE_TOKEN with re's classes within SAFE as ranges, in the syntax of Rust's regular expressions."""

    def ranges(one: str) -> str:
        fits, out = re.compile(one).match, []
        for c in safe:
            if fits(chr(c)):
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
        return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)

    is_safe = re.compile(f"[{SAFE}]").match
    safe = [c for c in range(0x110000) if is_safe(chr(c))]
    letter, digit, space, other = map(ranges, (r"[^\W\d_]", r"\d", r"\s", r"[^\s\w]|_"))
    return rf" ?[{letter}]+| ?[{digit}]+|'(?:s|t|re|ve|m|ll|d)| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+"


class Remembered(dict):
    """What a pre-token becomes."""

    def __init__(self, merge, result, known):
        super().__init__(known)
        self.merge, self.result, self.known = merge, result, known

    def __missing__(self, piece: str):
        out = self.result(self.merge(piece))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.known)
            self[piece] = out
        return out


def blocks(text: str) -> Iterator[str]:
    """text in blocks of about BLOCK characters, longer ones where there is no place for a cut."""
    at = 0
    while len(text) - at > MOST_BLOCK and (cut := CUT.search(text, at + BLOCK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        #: Ids as encode() gives them: two bytes where the vocabulary allows.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = re.compile(PRE_TOKEN).findall
        self.unsafe = re.compile(f"[^{SAFE}]").search

    @functools.cached_property
    def whole(self) -> dict[str, int]:
        """Vocabulary strings that are pre-tokens and that the model encodes alone as one token, with its id."""
        back = {c: b for b, c in self.letters.items()}
        out = {}
        for shown, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                piece = bytes(back[c] for c in shown).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if len(piece) <= LONGEST and [t.id for t in self.model.tokenize(shown)] == [i]:
                out[piece] = i
        return out

    @functools.cached_property
    def ranks(self) -> dict[bytes, int] | None:
        """The vocabulary as tiktoken has it, if every merge makes the next id: then the order of merges is the order of ids. Else None."""
        import json

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocabulary, first = model["vocab"], len(self.letters)
        if all(vocabulary.get(a + b) == first + i for i, (a, b) in enumerate(pairs)) and len(vocabulary) == first + len(pairs):
            back = {c: b for b, c in self.letters.items()}
            return {bytes(back[c] for c in shown): i for shown, i in vocabulary.items()}
        return None

    @functools.cached_property
    def merge(self):
        """The ids of one pre-token.

        Where the order of merges is the order of ids, tiktoken's merging by ids gives the same result in a fifth of the time; any other
        vocabulary is left to the tokenizers library.
        """
        import tiktoken

        if self.ranks:
            return tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        return lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids

    @functools.cached_property
    def direct(self):
        """The ids of a text of SAFE, special strings as plain ones; None if the vocabulary's merges are not in the order of ids."""
        import tiktoken

        return tiktoken.Encoding("texts", pat_str=direct_pattern(), mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary if self.ranks else None

    @functools.cached_property
    def counts(self) -> Remembered:
        return Remembered(self.merge, len, dict.fromkeys(self.whole, 1))

    @functools.cached_property
    def packed(self) -> Remembered:
        size = 2 if self.kind == "<u2" else 4
        return Remembered(self.merge, lambda ids: b"".join([i.to_bytes(size, "little") for i in ids]), {p: i.to_bytes(size, "little") for p, i in self.whole.items()})

    def parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def odd(self, text: str) -> bool:
        """Whether a character is outside SAFE; of ASCII only four are."""
        return not (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) and self.unsafe(text) is not None

    def count(self, text: str) -> int:
        if self.odd(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        table, special = self.counts, self.special
        return sum(1 if p in special else sum(map(table.__getitem__, self.pieces(p))) for p in self.parts(text))

    def encode(self, text: str) -> np.ndarray:
        if self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        direct, special, out = self.direct, self.special, []
        for part in self.parts(text):
            if part in special:
                out.append(np.array([special[part]], self.kind))
                continue
            for b in blocks(part):
                if direct and len(b) <= MOST_BLOCK:
                    out.append(np.array(direct(b), self.kind))
                else:
                    out.append(np.frombuffer(b"".join(map(self.packed.__getitem__, self.pieces(b))), self.kind))
        return out[0] if len(out) == 1 else np.concatenate(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder; it lives as long as the worker."""
    return Encoder(path)
