"""Pre-tokens of whole chunks of text, and token counts and ids made from them.

Both tokenizers merge only inside a pre-token, so a text's ids follow from its
sequence of pre-tokens. A chunk of texts is cut into pre-tokens with numpy over
its bytes (the rules of the tokenizers' own split patterns, restated below),
Arrow makes the distinct ones, and only those are looked up or merged.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from kestrel.llm.common import raw

#: Merged pre-tokens a task remembers before it starts anew.
KEPT = 200_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties."""
    out = np.zeros(0x110000, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            shift = lambda i: i if i < 0xD800 else i + 0x800  # noqa: E731  the surrogates are left out above
            a, b = m.span()
            out[shift(a) : shift(b - 1) + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    table = _classes()
    out = table[:256][data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        lead = data[high].astype(np.uint32)
        after = [data[np.minimum(high + k, len(data) - 1)].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
        two = (lead & 0x1F) << 6 | after[0]
        three = (lead & 0x0F) << 12 | after[0] << 6 | after[1]
        four = (lead & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2]
        kind = table[np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)]
        for k, least in ((0, 0xC0), (1, 0xC0), (2, 0xE0), (3, 0xF0)):
            there = (lead >= least) & (high + k < len(data))
            out[high[there] + k] = kind[there]
    return out


def _contractions(data: np.ndarray, run: np.ndarray, kind: np.ndarray, nxt: np.ndarray, end: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are one apostrophe followed by 's 't 'm 'd 're 've or 'll, and
    how many letters belong to it. nxt: the start of the run after each; end:
    of its text."""
    at = np.flatnonzero(data[run] == 39)
    at = at[allowed[at] & (nxt[at] - run[at] == 1) & (nxt[at] < end[at])]
    at = at[kind[at + 1] == LETTER] if len(at) else at
    if not len(at):
        return at, at
    a = data[nxt[at]]
    b = np.where(nxt[at + 1] - nxt[at] > 1, data[np.minimum(nxt[at] + 1, len(data) - 1)], 0)
    letters = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    letters = np.where(two, 2, letters)
    return at[letters > 0], letters[letters > 0]


def _runs(data: np.ndarray, first: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one class within a text: start, class, next start, the text's end."""
    change = np.ones(len(data), bool)
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change[first[first < len(data)]] = True
    run = np.flatnonzero(change)
    per_text = np.diff(np.searchsorted(run, first))
    return run, cls[run], np.append(run[1:], len(data)), np.repeat(first[1:], per_text)


def spaced_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    that together cover every text: a run of white space gives its last
    character to what follows (joined to it if that is a blank)."""
    run, kind, nxt, end = _runs(data, first, byte_classes(data))
    start = np.zeros(len(data) + 1, bool)
    start[run] = True
    gives = (kind == SPACE) & (nxt < end)
    last = nxt[gives] - 1
    for _ in range(3):  # back to the first byte of the last character
        last -= (data[last] & 0xC0) == 0x80
    start[last] = True
    joined = gives & (data[nxt - 1] == 32)
    start[nxt[joined]] = False
    free = np.ones(len(run), bool)
    free[1:] = ~joined[:-1]
    at, letters = _contractions(data, run, kind, nxt, end, free)
    start[nxt[at]] = False
    start[nxt[at] + letters] = True  # the rest of the letters, or the run after them
    return np.flatnonzero(start[:-1])


def bare_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``
    and of the runs of white space between them."""
    cls = byte_classes(data)
    run, kind, nxt, end = _runs(data, first, cls)
    start = np.zeros(len(data) + 1, bool)
    start[run] = True
    start[:-1] |= (cls == NUMBER) & ((data & 0xC0) != 0x80)
    at, letters = _contractions(data, run, kind, nxt, end, np.ones(len(run), bool))
    start[nxt[at]] = False
    start[nxt[at] + letters] = True
    return np.flatnonzero(start[:-1])


def distinct(data: np.ndarray, at: np.ndarray, starts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of a chunk, the index of each pre-token among
    them, and the index of each text's first pre-token."""
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begin_of = starts(data, at)
    offsets = np.append(begin_of, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.searchsorted(begin_of, at)


class Spaced:
    """Ids of the byte-level vocabulary ``<name>.json``, made with the rank file
    of the same vocabulary; a text that holds a special string goes whole to
    the library that reads the .json file."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(f"{name}.tiktoken")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.merge = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.merged: dict[bytes, list[int]] = {}
        self.special = [x["content"].encode() for x in json.load(open(public_tokenizers.path(f"{name}.json")))["added_tokens"]]

    def ids(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (each text's end with ``last``), and where each text's start."""
        data, at = raw(texts)
        pieces, index, first = distinct(data, at, spaced_starts)
        if len(self.merged) > KEPT:
            self.merged = {}
        get, merge = self.merged.get, self.merge._encode_single_piece
        lists = [get(p) or self.merged.setdefault(p, merge(p)) for p in pieces]
        lists.append([last])
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        index = np.insert(index, first[1:], len(lists) - 1)
        first = first + np.arange(len(first))
        n = size[index]
        place = np.append(0, np.cumsum(n))
        out = flat[np.repeat(begin[index] - place[:-1], n) + np.arange(place[-1])]
        return self._specials(data, at, out, place[first], last)

    def _specials(self, data, at, out, start, last):
        whole = data.tobytes()
        if not any(s in whole for s in self.special):
            return out, start
        parts = []
        for i in range(len(at) - 1):
            text = whole[at[i] : at[i + 1]]
            if any(s in text for s in self.special):
                parts.append(np.array([*self.library.encode(text.decode(), add_special_tokens=False).ids, last], np.uint32))
            else:
                parts.append(out[start[i] : start[i + 1]])
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


class Bare:
    """Token counts of the lower-case vocabulary ``word_bpe_49k.json``.

    ``whole`` holds the strings that are proved, by encoding each alone, to be
    one token; a pre-token among them counts one, the rest are merged by the
    library, each distinct one once a chunk. A text with a special string goes
    whole to the library."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.whole = whole_tokens(self.library, spec["model"]["vocab"], spec["model"]["end_of_word_suffix"])

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = ["" if t is None else t for t in texts.to_pylist()]
        data, at = raw(pa.array([self.normal(t) for t in texts], pa.large_string()))
        pieces, index, first = distinct(data, at, bare_starts)
        weight = np.ones(max(1, len(pieces)), np.int64)
        unknown = [i for i, p in enumerate(pieces) if p not in self.whole]
        rest = [pieces[i].decode() for i in unknown]
        for a in range(0, len(rest), 10_000):
            found = self.library.encode_batch_fast(rest[a : a + 10_000], add_special_tokens=False)
            weight[unknown[a : a + 10_000]] = [len(x) for x in found]  # white space alone has none
        out = np.diff(np.append(0, np.cumsum(weight[index]))[first]) if len(index) else np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if "<|" in t and any(s in t for s in self.special):
                out[i] = len(self.library.encode(t, add_special_tokens=False))
        return out

    def normal(self, text: str) -> str:
        """As the library normalizes (white space aside, which is dropped). Where
        lower-casing depends on more than the character, the library does it."""
        if text.isascii():
            return text.lower()
        if unicodedata.is_normalized("NFC", text) and not re.search("[İΣ]", text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)


def whole_tokens(library, vocab: dict[str, int], suffix: str) -> set[bytes]:
    """The strings that the library encodes, alone, as the one token of their
    own (with the word end): the proof is the encoding itself."""
    decode = {c: b for b, c in byte_characters().items()}
    own = {w: bytes(decode[c] for c in w[: -len(suffix)]) for w in vocab if w.endswith(suffix) and len(w) > len(suffix)}
    readable = {}
    for w, b in own.items():
        try:
            readable[w] = b.decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
    found = library.encode_batch_fast(list(readable.values()), add_special_tokens=False)
    return {own[w] for w, x in zip(readable, found) if x.ids == [vocab[w]]}


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself
    where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
