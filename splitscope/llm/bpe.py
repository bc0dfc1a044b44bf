"""Byte-pair encoding of a word-level vocabulary, from the published tokenizer file.

`Vocabulary` holds what the file states: ranks of merges, ids, added tokens.
Pieces between white space are encoded on their own (white space is dropped by
the pre-tokenizer, and no merge crosses it), so encoded pieces are kept in a
cache of bounded size. Two ways to merge a pre-token: a heap of merge ranks over
a doubly linked symbol list (`merge_with_heap`), and for many short pre-tokens
at once the same merges in numpy (`merge_batch`).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import regex

from splitscope.llm.common import CACHES

#: Characters that the vocabulary's white-space rule matches.
_SPACE = "\t-\r \x85\xa0  -     　"
_SPACE_RUN = regex.compile(f"[{_SPACE}]+")
#: str.split() also cuts at these, which the vocabulary's rule does not.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_NEXT_SPACE = regex.compile(f"[{_SPACE}]")
#: Entries of one generation of the piece cache; two generations are held.
CACHE = 300_000
#: Characters of a text encoded at once; cut at white space.
PIECE = 1 << 20
_MARKS = ".,;:!?"
NONE = np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """Letter standing for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for s, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = s
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        self.first_ids, self.last_ids = np.array(self.first, np.int32), np.array(self.last, np.int32)
        self.result = np.zeros(len(model["merges"]), np.int32)
        self._table()

    # --- merging -------------------------------------------------------------

    def _table(self) -> None:
        """Open-addressing table of the pairs for numpy lookups."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.full(1 << bits, -1, np.int64)
        ranks = np.full(1 << bits, NONE, np.int32)
        for (a, b), (rank, new) in self.pairs.items():
            key = a << 32 | b
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits)
            while keys[at] >= 0:
                at = at + 1 & mask
            keys[at], ranks[at] = key, rank
            self.result[rank] = new
        self.keys, self.ranks, self.mask = keys, ranks, np.int64(mask)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where there is none (a negative id is no symbol)."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(key.size, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        k = key.ravel()[todo]
        at = (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)
        while len(todo):
            held = self.keys[at]
            same = held == k
            out[todo[same]] = self.ranks[at[same]]
            more = ~same & (held >= 0)
            todo, k, at = todo[more], k[more], at[more] + 1 & self.mask
        return out.reshape(key.shape)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw]
        # The suffix belongs to the last character's last byte.
        ids[-1] = self.last[raw[-1]]
        return ids

    def merge_with_heap(self, ids: list[int]) -> list[int]:
        """Merge by rank, leftmost first: a heap of (rank, position) over a doubly linked list of symbols.

        A heap entry is stale if its left symbol is gone or has another
        pair now; stale ones are skipped when they come up. O(n log n).
        """
        n = len(ids)
        if n < 2:
            return ids
        pairs, push, pop = self.pairs, heapq.heappush, heapq.heappop
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if p := pairs.get((ids[i], ids[i + 1])):
                heap.append((p[0], i, p[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = pop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if p := pairs.get((new, ids[k])):
                    push(heap, (p[0], i, p[1], new, ids[k]))
            h = prv[i]
            if h >= 0 and (p := pairs.get((ids[h], new))):
                push(heap, (p[0], h, p[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def merge_batch(self, words: list[str]) -> list[bytes]:
        """The same merges for many words at once, one merge of each word a step; ids as 32-bit integers."""
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        ids = self.first_ids[data]
        ids[ends - 1] = self.last_ids[data[ends - 1]]
        order = np.argsort(sizes, kind="stable")
        out: list[bytes] = [b""] * len(words)
        long = int(np.searchsorted(sizes[order], 48, "right"))
        for i in order[long:].tolist():
            out[i] = array("I", self.merge_with_heap(ids[ends[i] - sizes[i] : ends[i]].tolist())).tobytes()
        for start in range(0, long, 8192):
            rows = order[start : min(long, start + 8192)]
            n = sizes[rows]
            m = np.full((len(rows), int(n[-1]) + 1), -1, np.int32)
            cols = np.arange(m.shape[1])
            live = cols < n[:, None]
            m[live] = ids[((ends[rows] - n)[:, None] + cols)[live]]
            self._merge_rows(m, rows, out)
        return out

    def _merge_rows(self, m: np.ndarray, who: np.ndarray, out: list[bytes]) -> None:
        r = self._ranks(m[:, :-1], m[:, 1:])
        while len(who):
            at = r.argmin(1) if r.shape[1] else np.zeros(len(who), np.int64)
            line = np.arange(len(who))
            best = r[line, at] if r.shape[1] else np.full(len(who), NONE)
            done = best == NONE
            if done.any():
                ended = m[done]
                held = ended >= 0
                flat, stops = ended[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
                start = 0
                for i, stop in zip(who[done].tolist(), stops, strict=True):
                    out[i] = flat[start:stop]
                    start = stop
                left = ~done
                who, m, r, at, best = who[left], m[left], r[left], at[left], best[left]
                if not len(who):
                    return
                line = np.arange(len(who))
                width = int((m >= 0).sum(1).max()) + 1
                m, r = m[:, :width], r[:, : width - 1]
            m[line, at] = self.result[best]
            # close the gap: what stands right of the merged symbol moves one to the left
            right = np.arange(m.shape[1] - 1) > at[:, None]
            m[:, :-1] = np.where(right, m[:, 1:], m[:, :-1])
            m[:, -1] = -1
            r[:, :-1] = np.where(right[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = NONE
            r[line, at] = self._ranks(m[line, at], m[line, at + 1])
            before = np.flatnonzero(at)
            r[before, at[before] - 1] = self._ranks(m[before, at[before] - 1], m[before, at[before]])

    # --- texts ---------------------------------------------------------------

    def pretokens(self, piece: str) -> list[str | int]:
        """Split a piece without white space as the vocabulary does; added tokens stand as their ids."""
        got: list[str | int] = []
        at = 0
        for m in self.specials.finditer(piece) if "<|" in piece else ():
            got += self.words.findall(normal(piece[at : m.start()]))
            got.append(self.added[m[0]])
            at = m.end()
        return got + self.words.findall(normal(piece[at:]))

    def _encode_pieces(self, pieces: Iterable[str], heap: bool) -> None:
        """Put the ids of pieces into the cache, as little-endian 32-bit integers."""
        whole: dict[str, str] = {}  # pieces of letters alone
        marked: dict[str, str] = {}  # letters and one mark after them
        others: dict[str, list] = {}
        for p in pieces:
            low = normal(p)
            if low.isalpha():
                whole[p] = low
            elif low[-1:] in _MARKS and low[:-1].isalpha():
                marked[p] = low
            else:
                others[p] = self.pretokens(p)
        if len(self.merged) > CACHE:
            self.merged = {}
        merged = self.merged
        wanted = {*whole.values(), *_MARKS}
        wanted.update([x[:-1] for x in marked.values()])
        for got in others.values():
            wanted.update([w for w in got if w.__class__ is str])
        fresh = list(wanted.difference(merged))
        if heap:
            for w in fresh:
                merged[w] = array("I", self.merge_with_heap(self.symbols(w))).tobytes()
        else:
            merged.update(zip(fresh, self.merge_batch(fresh), strict=True))
        new = self.new
        new.update(zip(whole, map(merged.__getitem__, whole.values()), strict=True))
        for p, low in marked.items():
            new[p] = merged[low[:-1]] + merged[low[-1]]
        for p, got in others.items():
            new[p] = b"".join([merged[w] if w.__class__ is str else array("I", [w]).tobytes() for w in got])

    def pieces(self, text: str) -> list[str]:
        if _NOT_SPACE.search(text):
            return [x for x in _SPACE_RUN.split(text) if x]
        return text.split()

    def _hold(self, pieces: set[str], heap: bool) -> None:
        """Make sure that the cache holds the pieces."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        missing = pieces.difference(self.new)
        if missing:
            held = missing.intersection(self.old)
            self.new.update(zip(held, map(self.old.__getitem__, held), strict=True))
            self._encode_pieces(missing - held if held else missing, heap)

    def encode(self, text: str | None, heap: bool = False) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_many([text], heap)[0]

    def encode_many(self, texts: list[str | None], heap: bool = False) -> list[bytes]:
        """Texts of one group: their new pieces are encoded together. Long texts go part by part."""
        split = [self.pieces(t) if t and len(t) <= PIECE else () for t in texts]
        seen: set[str] = set()
        seen.update(*split)
        self._hold(seen, heap)
        out = [b"".join(map(self.new.__getitem__, s)) for s in split]
        for i, t in enumerate(texts):
            if t and len(t) > PIECE:
                parts = []
                for part in cuts(t, PIECE):
                    s = self.pieces(part)
                    self._hold(set(s), heap)
                    parts.append(b"".join(map(self.new.__getitem__, s)))
                out[i] = b"".join(parts)
        return out

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings joined by a space: the file names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


def normal(piece: str) -> str:
    """NFC, then each character's lower case (a final sigma like any other)."""
    if piece.isascii():
        return piece.lower()
    return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()


def cuts(text: str, size: int) -> Iterable[str]:
    """The text in parts of about `size` characters, cut before white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        m = _NEXT_SPACE.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once a worker process."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def _forget() -> None:
    for v in _held.values():
        v.old, v.new, v.merged = {}, {}, {}


CACHES.append(_forget)
