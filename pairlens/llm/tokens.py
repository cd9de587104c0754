"""Token ids of whole batches of texts, by the tokenizers library, word by word.

Both supported tokenizers split a text into words before they merge, and a word's ids
do not depend on its neighbours. So a batch is split with array operations, each word
that the worker's table does not hold yet goes through the library, and ids are gathered.
Texts that hold a special token's string go through the library whole, and so do texts with
code points that this Python's Unicode table does not know: the library's may.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

from .common import chunks, distinct, ragged, slice_hashes

#: Code points of white space (Unicode's White_Space), fixed.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE, EDGE = 1, 2, 3, 4, 9


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _unknown() -> np.ndarray:
    """The code points of which the library may know more than this Python does, or know it otherwise."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)], bool)


def unsure(some: list[str]) -> list[int]:
    """The texts that hold unknown code points."""
    cp = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(cp > 0x377)  # the code points up to here are all assigned
    at = at[_unknown()[cp[at]]]
    if not len(at):
        return []
    ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
    return np.unique(np.searchsorted(ends, at, side="right")).tolist()


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[_WHITE] = SPACE
    return out


class Words:
    """The words of joined texts: code points, word starts and ends, first word of each text."""

    def __init__(self, texts: list[str], attach_space: bool):
        """``attach_space``: a space belongs to the run after it and white space is kept
        (byte-level pattern); else white space is dropped and digits stand alone."""
        self.text = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.points = cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(cp)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        cls = char_classes()[cp]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        prev = np.empty(n, np.uint8)
        prev[1:] = cls[:-1]
        prev[edge[:n]] = EDGE
        after = np.empty(n, np.uint8)
        after[:-1] = cls[1:]
        after[edge[1:]] = EDGE
        white = cls == SPACE
        start = cls != prev
        glued = np.zeros(n, bool)
        if attach_space:
            glued[1:] = cp[:-1] == 32
            glued &= ~edge[:n] & ~white
            start &= ~glued
            start |= white & (after != SPACE) & (after != EDGE)
        else:
            start |= cls == NUMBER
        # Contractions: an apostrophe that begins a word, with the letters that go with it.
        at = np.flatnonzero((cp == 39) & (prev != OTHER) & (after == LETTER) & ~glued)
        if len(at):
            one = cp[at + 1]
            second = np.minimum(at + 2, n - 1)
            two = np.where((at + 2 < n) & ~edge[second], cp[second], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = np.zeros(len(at), bool)
            for a, b in ("re", "ve", "ll"):
                pair |= (one == ord(a)) & (two == ord(b))
            at, length = at[short | pair], np.where(short, 1, 2)[short | pair]
            start[at + 1] = False
            rest = at + 1 + length
            rest = rest[rest < n]
            rest = rest[(cls[rest] == LETTER) & ~edge[rest]]
            start[rest] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n)
        if not attach_space:
            word = ~white[self.starts]
            self.starts, self.ends = self.starts[word], self.ends[word]
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return slice_hashes(self.points, self.starts, self.ends)

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[s:e] for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist())]


class Encoder:
    """A tokenizer's ids for many texts; one for each worker process and file."""

    SLOTS, WIDE, CHARS = 1 << 21, 8, 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.byte_level = spec["pre_tokenizer"]["type"] == "ByteLevel"
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.ends_word = np.zeros(self.size, bool)
        if self.byte_level:
            if spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
                raise ValueError("only byte-level tokenizers without normaliser and prefix space are known")
            self.newline = vocab["Ċ"]
        else:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.keys, self.seconds = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.counts = np.zeros(self.SLOTS, np.uint8)
        self.values = np.zeros((self.SLOTS, self.WIDE), np.uint16 if self.size <= 1 << 16 else np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's bounds among them."""
        ids, sizes = [], []
        for a, b in chunks(texts, list(map(len, texts)), self.CHARS):
            part = texts[a:b]
            odd = sorted({i for i, t in enumerate(part) if any(s in t for s in self.special)}.union(unsure(part)))
            whole = {i: np.array(self.library.encode(part[i], add_special_tokens=False).ids, np.uint32) for i in odd}
            for i in odd:
                part[i] = ""
            flat, bounds = self._encode(part)
            if not odd:
                ids.append(flat)
                sizes.append(np.diff(bounds))
                continue
            for i in range(len(part)):
                one = whole.get(i, flat[bounds[i] : bounds[i + 1]])
                ids.append(one)
                sizes.append([len(one)])
        bounds = np.zeros(len(texts) + 1, np.int64)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=bounds[1:])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), bounds

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.byte_level:
            # Capital sigma has one lower form here, whatever follows it.
            texts = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        words = Words(texts, self.byte_level)
        h, second = words.hashes()
        slot = (h >> np.uint64(43)).astype(np.int64)
        hit = (self.keys[slot] == h) & (self.seconds[slot] == second)
        sizes = self.counts[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if len(missed):
            first, back, _ = distinct(h[missed], second[missed])
            flat, n = self._library(words.strings(missed[first]))
            begin = np.cumsum(n) - n
            sizes[missed] = n[back]
        bounds = np.zeros(len(h) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        out = np.empty(bounds[-1], np.uint32)
        left = np.flatnonzero(hit)
        to, of, size = bounds[left], slot[left], sizes[left]
        for j in range(self.WIDE):
            more = size > j
            if not more.all():
                to, of, size = to[more], of[more], size[more]
            out[to + j] = self.values[of, j]
        if len(missed):
            out[ragged(bounds[missed], sizes[missed])] = flat[ragged(begin[back], n[back])]
            self._remember(h[missed[first]], second[missed[first]], flat, begin, n)
        return out, bounds[words.first]

    def _remember(self, new: np.ndarray, second: np.ndarray, flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        """First come, first kept: frequent words come early."""
        slot = (new >> np.uint64(43)).astype(np.int64)
        fits = np.flatnonzero((n <= self.WIDE) & (self.keys[slot] == 0))
        slot, one = np.unique(slot[fits], return_index=True)
        fits = fits[one]
        self.keys[slot], self.seconds[slot], self.counts[slot] = new[fits], second[fits], n[fits]
        padded = np.append(flat, np.zeros(self.WIDE, np.uint32))
        self.values[slot] = padded[begin[fits][:, None] + np.arange(self.WIDE)]

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each word: many in one call where their ends can be told."""
        n = np.zeros(len(words), np.int64)
        parts: list[np.ndarray | None] = [None] * len(words)
        if self.byte_level:
            together = [i for i, w in enumerate(words) if not w[-1].isspace() and "\n" not in w]
            between = "\n"
        else:
            together, between = list(range(len(words))), " "
        alone = set(range(len(words))) - set(together)
        blocks = [together[k : k + 256] for k in range(0, len(together), 256)]
        joined = [between.join([words[i] for i in block]) + between for block in blocks]
        for block, e in zip(blocks, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(got == self.newline if self.byte_level else self.ends_word[got])
            if len(cut) != len(block):
                alone.update(block)
                continue
            begin = 0
            for i, end in zip(block, cut.tolist()):
                parts[i] = got[begin : end + (not self.byte_level)]
                begin = end + 1
        left = sorted(alone)
        for i, e in zip(left, self.library.encode_batch_fast([words[i] for i in left], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        n[:] = [len(p) for p in parts]
        return np.concatenate(parts), n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
