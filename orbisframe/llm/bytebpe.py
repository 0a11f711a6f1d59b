"""Exact token ids of a byte-level BPE file of the tokenizers library, by batch.

The library splits a text into pre-tokens and encodes each by itself, so equal
pre-tokens have equal ids. Here a whole slice of texts is split at once with
byte-class tables, the distinct pre-tokens that this worker hasn't met are
encoded by the library, and all others come from its memory. Texts with an
added token's string, or with a character whose class has changed between
Unicode versions, go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa

from orbisframe.llm.textvec import Texts, ranges

#: The pre-token pattern of byte-level BPE files, which the splitter below follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSAFE = 0, 1, 2, 3, 9
#: Pre-tokens that a worker remembers at most, about 40 bytes each; beyond it,
#: those go that no later slice has asked for again.
_MEMORY_LIMIT = 1_000_000
#: Bytes of text in a slice that is encoded at once.
SLICE = 1 << 20


def _class_of(code: int) -> int:
    ch = chr(code)
    now, old = unicodedata.category(ch), unicodedata.ucd_3_2_0.category(ch)
    white = code in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, 0x202F, 0x205F, 0x3000, 0x2028, 0x2029) or 0x2000 <= code <= 0x200A
    if now[0] != old[0] or old == "Cn" or code in (0x85, 0x180E, 0x200B, 0xFEFF) or 0x1C <= code <= 0x1F or 0xD800 <= code <= 0xDFFF:
        return _UNSAFE
    if white:
        return _SPACE
    return _LETTER if now[0] == "L" else _NUMBER if now[0] == "N" else _OTHER


_CLASSES: np.ndarray | None = None
_ASCII = np.array([_class_of(c) for c in range(128)] + [_OTHER] * 128, np.uint8)


def _classes() -> np.ndarray:
    """Class by code point; all planes beyond the first go to the library."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.full(0x110000, _UNSAFE, np.uint8)
        _CLASSES[:0x10000] = [_class_of(c) for c in range(0x10000)]
    return _CLASSES


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    cls = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        table, padded = _classes(), np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        b0 = padded[lead]
        for low, high, more, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            at = lead[(b0 >= low) & (b0 < high)]
            code = padded[at] & bits
            for k in range(1, more + 1):
                code = (code << 6) | (padded[at + k] & 0x3F)
            c = table[np.clip(code, 0, 0x10FFFF)]
            for k in range(more + 1):
                cls[np.minimum(at + k, len(cls) - 1)] = c
    return cls


def pretoken_starts(t: Texts, cls: np.ndarray) -> np.ndarray:
    """Start of every pre-token of every text, in order."""
    data, n = t.data, len(t.data)
    if not n:
        return np.empty(0, np.int64)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    begins = t.off[:-1][t.lengths > 0]
    first = np.zeros(n, bool)
    first[begins] = True
    start |= first
    # white space before a word: its last character stands alone, or, if it is a blank, begins the word
    word = np.flatnonzero(start & (cls != _SPACE) & ~first)
    word = word[cls[word - 1] == _SPACE]
    back = word - 1
    while True:
        inner = (data[back] & 0xC0) == 0x80
        if not inner.any():
            break
        back = back - inner
    start[back] = True
    start[word[data[word - 1] == 32]] = False
    # contractions: an apostrophe that begins a pre-token, directly before letters
    quote = np.flatnonzero(data[:-1] == 39) if n > 1 else np.empty(0, np.int64)
    if len(quote):
        quote = quote[start[quote] & (cls[quote + 1] == _LETTER) & ~first[quote + 1]]
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        follows = np.concatenate((first, np.zeros(4, bool)))
        a, b = padded[quote + 1], padded[quote + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~follows[quote + 2] & ~one
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


class ByteBpe:
    """Ids of whole texts, with a memory of pre-tokens for this worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in spec.get("added_tokens", []) if x["content"]]
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (spec.get("model") or {}).get("type") == "BPE"
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.ids, self.used, self.asked = np.empty(0, np.uint32), 0, np.empty(0, bool)

    def _shrink(self) -> None:
        """Keep what has been asked for again since the last time, if that is
        little enough."""
        keep = np.flatnonzero(self.asked)
        if len(keep) > _MEMORY_LIMIT // 2:
            self._forget()
            return
        size = self.size[keep]
        self.ids = self.ids[ranges(self.first[keep], size)]
        self.used = len(self.ids)
        self.keys, self.size = self.keys[keep], size
        self.first = (np.cumsum(size, dtype=np.int64) - size).astype(np.uint32)
        self.asked = np.zeros(len(keep), bool)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode distinct new pre-tokens; keys are in order."""
        got = []
        for k in range(0, len(words), 8192):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + 8192], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.uint32, len(got))
        flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(size.sum()))
        del got
        if self.used + len(flat) > len(self.ids):
            room = np.empty(max(3 * len(self.ids) // 2, self.used + len(flat), 1 << 16), np.uint32)
            room[: self.used] = self.ids[: self.used]
            self.ids = room
        self.ids[self.used : self.used + len(flat)] = flat
        first = (self.used + np.cumsum(size) - size).astype(np.uint32)
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size, self.asked = (
            np.insert(old, at, new) for old, new in ((self.keys, keys), (self.first, first), (self.size, size), (self.asked, np.zeros(len(keys), bool)))
        )

    def encode(self, t: Texts, column: pa.Array, with_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids in text order (None if not wanted) and n+1 offsets."""
        n = t.n
        if not self.split:
            rest = np.arange(n)
            cls = starts = None
        else:
            cls = byte_classes(t.data)
            starts = pretoken_starts(t, cls)
            odd = t.per_text(cls == _UNSAFE) > 0
            for x in self.added:
                odd |= np.asarray(pa.compute.fill_null(pa.compute.match_substring(column, x), False), bool)
            rest = np.flatnonzero(odd)
        counts = np.zeros(n, np.int64)
        flat = None
        if starts is not None and len(starts):
            ends = np.append(starts[1:], len(t.data))
            text = np.searchsorted(t.off, starts, side="right") - 1
            if len(rest):
                use = ~odd[text]
                starts, ends, text = starts[use], ends[use], text[use]
            keys = t.hashes(starts, ends)
            unique, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
            known = np.searchsorted(self.keys, unique)
            known[known == len(self.keys)] = 0
            new = np.ones(len(unique), bool) if not len(self.keys) else self.keys[known] != unique
            self.asked[known[~new]] = True
            if new.any():
                if len(self.keys) and len(self.keys) + int(new.sum()) > _MEMORY_LIMIT:
                    self._shrink()
                    known = np.searchsorted(self.keys, unique)
                    known[known == len(self.keys)] = 0
                    new = np.ones(len(unique), bool) if not len(self.keys) else self.keys[known] != unique
                raw = t.data.tobytes()
                words = [raw[s:e].decode() for s, e in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)]
                self._learn(unique[new], words)
                known = np.searchsorted(self.keys, unique)
            size = self.size[known][inverse]
            counts = np.bincount(text, size, n).astype(np.int64)
            if with_ids:
                flat = self.ids[ranges(self.first[known][inverse], size)]
        whole = self._whole([column[int(k)].as_py() or "" for k in rest]) if len(rest) else []
        for k, ids in zip(rest.tolist(), whole, strict=True):
            counts[k] = len(ids)
        off = np.concatenate(([0], np.cumsum(counts)))
        if not with_ids:
            return None, off
        if not len(rest):
            return (np.empty(0, np.uint32) if flat is None else flat), off
        out = np.empty(int(off[-1]), np.uint32)
        split = np.ones(n, bool)
        split[rest] = False
        if flat is not None:
            out[ranges(off[:-1][split], counts[split])] = flat
        for k, ids in zip(rest.tolist(), whole, strict=True):
            out[off[k] : off[k + 1]] = ids
        return out, off


_WORKER: dict[str, ByteBpe] = {}


def worker_encoder(path: str) -> ByteBpe:
    """The encoder of this Python worker, loaded once."""
    if path not in _WORKER:
        _WORKER[path] = ByteBpe(path)
    return _WORKER[path]


def file_digest(path: str) -> str:
    """Digest of a tokenizer file: its version in the count cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
