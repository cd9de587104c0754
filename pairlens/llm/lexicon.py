"""Byte-level BPE with a lexicon of frequent words kept as a minimal acyclic transducer.

The corpus's most frequent words (counted over all texts) are compiled, in sorted order,
into an acyclic automaton whose equal suffixes are shared. Its arcs carry numbers; their
sum along a word is the word's place in the table of id sequences. The compiled file goes
to every executor, whose workers map it into memory. A word that the automaton does not
accept is merged exactly, by the lowest rank first, leftmost first.

Texts are split by the tokenizer's own pattern; its special tokens are cut out first,
as the tokenizers library does. Nulls: a null text is the empty text and has no ids; a
null or repeated ``doc_id`` is handed through, row by row. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import Scratch, chunks, distinct, ragged, texts
from .tokens import Words, unsure

#: Words in the lexicon, and the bytes of its longest word.
LEXICON, LONGEST = 1 << 17, 48
CHARS = 1 << 20
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """The vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normaliser and prefix space is known")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 20 | vocab[right], len(self.result))
            self.result.append(vocab[left + right])

    def merge(self, word: bytes) -> list[int]:
        if len(word) > 64:
            return self._merge_long(word)
        get, result = self.rank.get, self.result
        ids = [self.of_byte[b] for b in word]
        ranks = list(map(get, [a << 20 | b for a, b in zip(ids, ids[1:])], repeat(_NONE)))
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [result[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n for words of any length."""
        get = self.rank.get
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.result[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    r = get(ids[left] << 20 | ids[right], _NONE)
                    if r != _NONE:
                        heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of sorted, distinct words, with the words' places as arc sums.

    After each word the suffix that no later word can change is replaced by an equal state
    if there is one. A state is (accepts, arcs by byte); arcs of a state stand in byte order.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []
    accepts: list[bool] = []
    path: list[list] = [[False, []]]  # states on the path of the last word: accepts, arcs
    last = b""

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        found = register.get(key)
        if found is None:
            found = register[key] = len(arcs)
            arcs.append(key[1])
            accepts.append(state[0])
        return found

    def shorten(to: int) -> None:
        while len(path) > to + 1:
            done = freeze(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], done)

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        shorten(common)
        for b in word[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    shorten(0)
    root = freeze(path[0])
    # States are frozen after all states they lead to: one pass counts the words below each.
    below = np.zeros(len(arcs), np.int64)
    keys, targets, adds = [], [], []
    for state, own in enumerate(arcs):
        passed = int(accepts[state])
        for b, to in own:
            keys.append(state << 8 | b)
            targets.append(to)
            adds.append(passed)
            passed += int(below[to])
        below[state] = passed
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int64),
        "adds": np.array(adds, np.int64),
        "accepts": np.array(accepts, np.int64),
        "root": np.array([root], np.int64),
    }


_PARTS = ("keys", "targets", "adds", "accepts", "root", "bounds", "ids")


def write_lexicon(path: str, words: list[bytes], merges: Merges) -> None:
    words = sorted(set(words))
    parts = compile_words(words)
    ids = [merges.merge(w) for w in words]
    parts["bounds"] = np.cumsum([0, *map(len, ids)])
    parts["ids"] = np.array([i for own in ids for i in own], np.int64)
    with open(path, "wb") as f:
        np.array([len(parts[p]) for p in _PARTS], np.int64).tofile(f)
        for p in _PARTS:
            parts[p].astype(np.int64).tofile(f)


class Lexicon:
    """A compiled lexicon, mapped into memory: workers of one machine share its pages."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        at = len(_PARTS)
        for p, n in zip(_PARTS, data[: len(_PARTS)].tolist()):
            setattr(self, p, data[at : at + n])
            at += n

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table of id sequences, or -1; all words walk in step."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        alive = np.flatnonzero(size <= LONGEST)
        state, total = np.full(len(alive), self.root[0]), np.zeros(len(alive), np.int64)
        for j in range(LONGEST + 1):
            ended = size[alive] == j
            here = ended & (self.accepts[state] == 1)
            out[alive[here]] = total[here]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            if not len(alive):
                break
            key = state << 8 | flat[begin[alive] + j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            state, total = self.targets[at], total[ok] + self.adds[at]
        return out


class Codec:
    """Encoder and decoder of one worker: the merges, the lexicon, words met before."""

    REMEMBERED = 200_000

    def __init__(self, path: str, lexicon: str):
        self.merges, self.lexicon = Merges(path), Lexicon(lexicon)
        self.split = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.splitter = ByteLevel(add_prefix_space=False)
        self.unseen: dict[bytes, list[int]] = {}
        size = np.fromiter(map(len, self.merges.bytes), np.int64, self.merges.size)
        self.token_size, self.token_start = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(self.merges.bytes), np.uint8)

    def _merged(self, word: bytes) -> list[int]:
        got = self.unseen.get(word)
        if got is None:
            got = self.merges.merge(word)
            if len(word) <= LONGEST:
                if len(self.unseen) >= self.REMEMBERED:
                    self.unseen.clear()
                self.unseen[word] = got
        return got

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and the bounds of each text."""
        words = Words(parts, attach_space=True)
        if not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(len(parts) + 1, np.int64)
        first, back, _ = distinct(*words.hashes())
        own = [w.encode("utf-8", "surrogatepass") for w in words.strings(first)]
        place = self.lexicon.places(own)
        known, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        merged = [self._merged(own[i]) for i in new.tolist()]
        size, begin = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        table = self.lexicon.bounds
        begin[known] = table[place[known]]
        size[known] = table[place[known] + 1] - begin[known]
        size[new] = [len(m) for m in merged]
        begin[new] = len(self.lexicon.ids) + np.cumsum(size[new]) - size[new]
        source = np.concatenate([self.lexicon.ids, np.array([i for m in merged for i in m], np.int64)])
        n = size[back]
        bounds = np.append(0, np.cumsum(n))
        return source[ragged(begin[back], n)], bounds[words.first]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_plain``; parts with code points unknown here are split into words by the library."""
        odd = {i: self._split_by_library(parts[i]) for i in unsure(parts)}
        ids, bounds = self._plain(["" if i in odd else t for i, t in enumerate(parts)])
        if not odd:
            return ids, bounds
        each = [odd[i] if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(parts))]
        return np.concatenate(each), np.append(0, np.cumsum([len(e) for e in each]))

    def _split_by_library(self, text: str) -> np.ndarray:
        words = self.splitter.pre_tokenize_str(text)
        return np.array([i for _, (a, b) in words for i in self._merged(text[a:b].encode("utf-8"))], np.int64)

    def encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[str] = []
        marks: list[int] = []  # before each part: a special id, -1 within a text, -2 for a new text
        for text in some:
            pieces = self.split.split(text) if self.split and any(s in text for s in self.merges.special) else [text]
            parts += pieces[::2]
            marks += [-2, *(self.merges.special[s] for s in pieces[1::2])]
        ids, bounds = self._parts(parts)
        out, ends, at = [], [], 0
        if len(parts) == len(some):
            return ids, bounds
        for k, mark in enumerate(marks):
            if mark == -2:
                ends.append(at)
            else:
                out.append(np.array([mark], np.int64))
                at += 1
            out.append(ids[bounds[k] : bounds[k + 1]])
            at += len(out[-1])
        return np.concatenate(out), np.array([*ends, at], np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        size = self.token_size[ids]
        data = self.token_bytes[ragged(self.token_start[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def _codec(path: str, lexicon: str) -> Codec:
    return Codec(path, SparkFiles.get(lexicon))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of up to LONGEST bytes occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            some = batch.column(0).to_pylist()
            for a, b in chunks(some, list(map(len, some)), CHARS):
                words = Words(some[a:b], attach_space=True)
                if not len(words.starts):
                    continue
                first, _, n = distinct(*words.hashes())
                short = words.ends[first] - words.starts[first] <= LONGEST
                for word, k in zip(words.strings(first[short]), n[short].tolist()):
                    seen[word] = seen.get(word, 0) + k
            if len(seen) > 500_000:
                yield rows()
                seen = {}
        yield rows()

    return texts(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int, scratch: Scratch) -> list[bytes]:
    """The most frequent words, ``size`` at most: all that are frequent enough to fit together.

    The least frequency comes from a histogram of frequencies (32 steps for each doubling),
    so only words of the lexicon travel to the driver.
    """
    counted = scratch.keep(count_words(docs), "words")
    step = F.floor(F.log2("n") * 32).alias("step")
    total, least = 0, None
    for r in counted.where("n > 1").groupBy(step).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > size:
            break
        least = r.step
    if least is None:
        return []
    chosen = counted.where("n > 1").where(step >= least).select("word").collect()
    return [w for r in chosen if len(w := r.word.encode()) <= LONGEST]


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compile up to ``size`` frequent words and give the file to all executors."""
    scratch = Scratch(docs.sparkSession, "lexicon")
    words = frequent_words(docs, size, scratch)
    scratch.drop()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = os.path.join(tempfile.mkdtemp(prefix="pairlens-lexicon-"), name)
    write_lexicon(place, words, Merges(path))
    docs.sparkSession.sparkContext.addFile(place)
    return name


def encode(docs: DataFrame, path: str, lexicon: str) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit little-endian), decoded."""

    def run(batches):
        codec = _codec(path, lexicon)
        for batch in batches:
            some = batch.column(1).to_pylist()
            for a, b in chunks(some, list(map(len, some)), CHARS):
                ids, bounds = codec.encode(some[a:b])
                data, cut = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([data[s:e] for s, e in zip(cut, cut[1:])], pa.binary()),
                        pa.array(codec.decode(ids, bounds), pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
