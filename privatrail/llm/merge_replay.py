"""Byte-level BPE by corpus-level merge replay.

The distinct words of a task's documents are laid end to end. An inverted index holds, for each rank, the positions
whose token pair merges at that rank; ranks are taken in order from a heap, every position of a rank is merged, and
only the two neighbours of a merge enter the index again. The words' ids are kept by the worker, so that a word seldom
costs its merges twice. Nothing is shuffled: a table of all words would cost more to join than the replay itself.

Null texts count as empty and have no ids. Ids travel as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame

from privatrail.llm.common import add_columns

NONE = 1 << 40
#: Pieces whose ids a worker keeps before it starts anew (their number bounds its memory, not the result).
PIECES_KEPT = 250_000
#: Texts split at a time.
GROUP = 64


def read_ranks(path: str) -> bytes:
    """The rank file as it is: one base64 token and its rank a line. Its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Replay:
    """Encodes words (bytes) by the ranks."""

    def __init__(self, data: bytes):
        self.ranks = _ranks(data)
        self.size = max(self.ranks.values()) + 1
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of: list[bytes] = [b""] * self.size
        keys, found = [], []
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.found = np.append(np.array(found, np.int64)[order], NONE)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.found[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word. A word that is itself a token is that token, as in the public library."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif word:
                rest.append(i)
        for i, ids in zip(rest, self._replay([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        token = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts + sizes - 1] = n
        before[starts] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n + 1, NONE)
        left = np.flatnonzero(after[:n] < n)
        rank_at[left] = self.pair_ranks(token[left], token[left + 1])
        # the inverted index: rank -> positions of its pair (one token may be put together from several pairs)
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []
        self._enter(index, ranks, left, rank_at[left])
        odd: list[np.ndarray] = []
        while ranks:
            rank = heapq.heappop(ranks)
            found = index.pop(rank)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            at = np.sort(at[rank_at[at] == rank])
            if len(at) > 1:
                fresh = np.empty(len(at), bool)
                fresh[0] = True
                np.not_equal(at[1:], at[:-1], out=fresh[1:])
                at = at[fresh]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():
                at = at[self._apart(at.tolist(), right.tolist())]
                right = after[at]
            beyond = after[right]
            inside = beyond < n
            inner = at[inside]
            follow = beyond[inside]
            # a pair of lower rank that stands only until the next merge of this rank in the same word
            hidden = self.pair_ranks(rank, token[follow])
            token[at] = rank
            alive[right] = False
            rank_at[right] = NONE
            rank_at[at] = NONE
            after[at] = beyond
            before[follow] = inner
            rank_at[inner] = self.pair_ranks(rank, token[follow])
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            rank_at[ahead] = self.pair_ranks(token[ahead], token[after[ahead]])
            touched = np.concatenate([inner, ahead])
            new = rank_at[touched]
            if (new <= rank).any() or (hidden < rank).any():
                odd.append(np.concatenate([touched[new <= rank], inner[hidden < rank]]))
            self._enter(index, ranks, touched, new)
        packed = token[:n][alive].astype("<u4").tobytes()
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        ends = (np.cumsum(counts) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if odd:
            for i in np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist():
                out[i] = self._alone(words[i])
        return out

    @staticmethod
    def _enter(index: dict[int, list[np.ndarray]], ranks: list[int], places: np.ndarray, values: np.ndarray) -> None:
        known = values < NONE
        places, values = places[known], values[known]
        if not len(places):
            return
        order = np.argsort(values, kind="stable")
        places, values = places[order], values[order]
        firsts = np.flatnonzero(values[1:] != values[:-1]) + 1
        bounds = [0, *firsts.tolist(), len(values)]
        for k, value in enumerate(values[bounds[:-1]].tolist()):
            part = places[bounds[k] : bounds[k + 1]]
            if value in index:
                index[value].append(part)
            else:
                index[value] = [part]
                heapq.heappush(ranks, value)

    @staticmethod
    def _apart(at: list[int], right: list[int]) -> np.ndarray:
        """Of overlapping pairs the leftmost are merged: a run of one token merges two by two from its start."""
        kept, used = [], -1
        for k, (a, b) in enumerate(zip(at, right, strict=True)):
            if a != used:
                kept.append(k)
                used = b
        return np.array(kept)

    def _alone(self, word: bytes) -> bytes:
        """One word by itself, the lowest and leftmost pair first: for words where a merge makes a pair of lower
        rank than its own, so that the order inside the word matters."""
        n = len(word)
        parts = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i] if parts[i] else n
            if j >= n or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := self.ranks.get(parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(waiting, (r, a))
        return b"".join(self.ranks[p].to_bytes(4, "little") for p in parts if p)


class Encoder:
    """Encodes whole texts. Texts are cut at single blanks, where every match of the pattern ends; a text with blanks
    beside other white space is matched as a whole. Pieces between blanks keep their ids from batch to batch."""

    def __init__(self, data: bytes, pattern: str):
        self.replay = Replay(data)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes | None] = {}

    def _matches(self, piece: str) -> list[str]:
        """The matches in a blank and a piece; words of plain letters need no pattern."""
        if max(piece) < "\u0250":
            if piece.isalpha():
                return [" " + piece]
            if piece[-1] in ".," and piece[:-1].isalpha():
                return [" " + piece[:-1], piece[-1]]
        return self.pattern.findall(" " + piece)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.pieces) > PIECES_KEPT:
            self.pieces = {}
        new: set[str] = set()
        heads: set[str] = set()
        for a in range(0, len(texts), GROUP):
            seen: set[str] = set()
            for text in texts[a : a + GROUP]:
                parts = (text or "").split(" ")
                heads.add(parts[0])
                seen.update(parts[1:])
            new |= seen.difference(self.pieces)
        self.pieces.update(dict.fromkeys(new))
        matched = {p: self._matches(p) for p in new if p and not p[0].isspace() and not p[-1].isspace()}
        words: dict[str, bytes] = {}
        for found in matched.values():
            words.update(dict.fromkeys(found))
        for head in heads:
            words.update(dict.fromkeys(self.pattern.findall(head)))
        self._learn(words)
        for piece, found in matched.items():
            self.pieces[piece] = words[found[0]] if len(found) == 1 else b"".join(map(words.__getitem__, found))
        return [self._text(text or "", words) for text in texts]

    def _learn(self, words: dict[str, bytes]) -> None:
        listed = list(words)
        words.update(zip(listed, self.replay.encode([w.encode() for w in listed]), strict=True))

    def _text(self, text: str, words: dict[str, bytes]) -> bytes:
        parts = text.split(" ")
        try:
            if len(parts) > 1 and parts[0][-1:].isspace():
                raise TypeError
            rest = b"".join(map(self.pieces.__getitem__, parts[1:]))
            found = self.pattern.findall(parts[0])
        except TypeError:  # a piece without ids of its own
            rest = b""
            found = self.pattern.findall(text)
        if missing := {w: b"" for w in found if w not in words}:
            self._learn(missing)
            words.update(missing)
        return b"".join(map(words.__getitem__, found)) + rest


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    """One for the life of a Python worker, so that its pieces serve the worker's later tasks too."""
    return Encoder(data, pattern)


class Decoder:
    """Bytes of packed ids."""

    def __init__(self, data: bytes):
        found = _ranks(data)
        self.bytes_of = [b""] * (max(found.values()) + 1)
        for token, rank in found.items():
            self.bytes_of[rank] = token

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


def encode(
    df: DataFrame, ranks: bytes, pattern: str, keep: list[str], text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """The columns `keep` and `ids`: the packed ids of the whole text (empty for null or empty texts). With `decoded`
    also the bytes that these ids stand for, decoded by the same worker."""

    def work():
        coder = _encoder(ranks, pattern)
        if decoded is None:
            return lambda texts: [coder.encode(texts)]
        back = Decoder(ranks)

        def both(texts: list) -> list[list[bytes]]:
            packed = coder.encode(texts)
            return [packed, [back.decode(p) for p in packed]]

        return both

    return add_columns(df, text, {ids: "binary"} | ({decoded: "binary"} if decoded else {}), work, keep, rows=1024)


def decode(df: DataFrame, ranks: bytes, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns `keep` and `out`: the bytes that the packed ids stand for (null ids: empty)."""

    def work():
        back = Decoder(ranks)
        return lambda packed: [[back.decode(p) for p in packed]]

    return add_columns(df, ids, {out: "binary"}, work, keep)
