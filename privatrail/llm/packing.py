"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut from the back into full pieces, which are sequences of their own; the rest are
items. Items are dealt over blocks of about BLOCK_ITEMS by a hash, and each block evolves on several islands: an
individual is a set of bins, its seed a best fit of the items in nearly random order. Crossover injects bins of one parent's
fuller half into another, drops the bins that hold an injected item and the emptiest, and makes new bins of their
displaced items, each the largest and those that fill it best. After each epoch an island's best individual migrates to the next island of its block. A
block is done when it has no more bins than its tokens need. Bins that stay badly filled are opened again, and their
items packed once more over all blocks.

Ids are those of the public `tokenizers` library. `tiktoken` gives the same ids from the same vocabulary (compared in
the tests) about four times as fast and is used for all texts but those that hold the vocabulary's special token. Words
that repeat among a task's documents are encoded once a group.
A null text is empty: one end token. Ids and rows may repeat; every row is packed.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut

CAPACITY = 2048
BLOCK_ITEMS = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 16
#: Items among which a crossover looks for those that fill a bin.
CHOICE = 96
#: Of the order in which seeds are fitted: what is good about a packing has to come out of the crossovers.
NOISE = 100.0
#: Bins filled less than this are packed again over all blocks.
OPEN_BELOW = 0.97
SPECIAL = "<|endoftext|>"
#: Bytes of texts that are encoded together (a longer text alone), and documents that are taken at a time.
GROUP_BYTES = 1 << 21
GROUP_ROWS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _sure() -> np.ndarray:
    """Of each byte, whether a character that begins with it cannot be white space (of any kind known to Unicode)."""
    sure = np.arange(256) > 0x20
    sure[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    return sure


SURE = _sure()


def _sure_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end before the places are surely not white space: ASCII, or of such a first byte."""
    last = data[at - 1]
    return SURE[last] & ((last < 0x80) | SURE[data[np.maximum(at - 2, 0)]] & SURE[data[np.maximum(at - 3, 0)]])


class _FastCoder:
    """Ids of many texts at once. Texts are cut at single blanks between characters that are surely not white space: every
    match of the pattern ends there. Each distinct piece of a group is encoded once, all of them in one call."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), "<u4")

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces in a row; where those of each piece start, and how many they are."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        first, end = offsets[:-1], offsets[1:]
        # these can be joined, as they would be cut again at the same places
        plain = (data[first] == 0x20) & (end - first > 1) & SURE[data[np.minimum(first + 1, len(data) - 1)]] & _sure_before(data, end)
        ends = np.cumsum((end - first)[plain])
        joined = pieces.filter(pa.array(plain)).buffers()[2].to_pybytes()[: ends[-1]] if len(ends) else b""
        ids = self._ids(joined.decode())
        after = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
        others = [self._ids(pieces[i].as_py()) for i in np.flatnonzero(~plain).tolist()]
        counts = np.zeros(len(pieces), np.int64)
        counts[plain] = np.diff(after, prepend=0)
        counts[~plain] = [len(x) for x in others]
        starts = np.zeros(len(pieces), np.int64)
        starts[plain] = after - counts[plain]
        starts[~plain] = len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
        return np.concatenate([ids, *others]), starts, counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order. texts: large strings without nulls."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        a = 0
        while a < len(texts):  # groups bound the memory
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP_BYTES, "right")) - 1)
            yield from self._group(texts.buffers()[2], offsets[a : b + 1])
            a = b

    def _group(self, buffer: pa.Buffer, offsets: np.ndarray) -> list[np.ndarray]:
        low, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not size:
            return [np.zeros(0, "<u4")] * (len(offsets) - 1)
        data = np.frombuffer(buffer, np.uint8, size, low)
        at = np.flatnonzero(data[1:-1] == 0x20) + 1
        cut_at = np.zeros(size + 1, bool)
        cut_at[at[_sure_before(data, at) & SURE[data[at + 1]]]] = True
        cut_at[offsets - low] = True
        cuts = np.flatnonzero(cut_at)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), buffer.slice(low, size)])
        coded = pieces.dictionary_encode()
        ids, starts, counts = self._pieces(coded.dictionary)
        which = coded.indices.to_numpy()
        many = counts[which]
        ends = np.cumsum(many)
        ids = ids[np.repeat((starts[which] - ends + many).astype(np.int32), many) + np.arange(ends[-1], dtype=np.int32)]
        bounds = np.append(0, ends)[np.searchsorted(cuts, offsets - low)].tolist()
        return [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _exact_coder(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document's ids and its end token 0: only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made for the task alone, and the large one only where a text needs it: workers live on with what they hold
        exact, fast = None, _FastCoder(ranks_path, pattern)
        end = np.zeros(1, "<u4")
        for batch in (b.slice(k, GROUP_ROWS) for b in batches for k in range(0, b.num_rows, GROUP_ROWS)):
            rows: list[tuple] = []
            values = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            special = pc.match_substring(values, SPECIAL)
            coded = fast.encode(pc.if_else(special, "", values))
            for doc_id, value, odd, ids in zip(batch.column(0).to_pylist(), values, special.to_pylist(), coded, strict=True):
                if odd:
                    exact = exact or _exact_coder(json_path)
                    ids = np.array(exact.encode(value.as_py(), add_special_tokens=False).ids, "<u4")
                ids = np.concatenate([ids, end])
                n, a = len(ids), 0
                b = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    a, b = b, b + capacity
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


class Bins:
    """Bins over items of given sizes, found by their free room: a bit of `rooms` is set where some bin has it."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.held: list[list[int]] = []
        self.free: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def _offer(self, b: int) -> None:
        room = self.free[b]
        if not self.by_room[room]:
            self.rooms |= 1 << room
        self.by_room[room].append(b)

    def add(self, items: list[int]) -> None:
        self.held.append(items)
        self.free.append(self.capacity - sum(self.sizes[i] for i in items))
        self._offer(len(self.held) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Each item, the largest first, into the fullest bin with room for it, or into a new one."""
        for i in items:
            size = self.sizes[i]
            above = self.rooms >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                b = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.rooms &= ~(1 << room)
                self.held[b].append(i)
                self.free[b] = room - size
                self._offer(b)
            else:
                self.add([i])

    def fitness(self) -> float:
        """Fewer bins first; among equals the one whose fill is less even, as its gaps are of more use."""
        return -len(self.held) + sum((1 - f / self.capacity) ** 2 for f in self.free) / (len(self.held) + 1)


def _seeded(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Bins:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    out = Bins(sizes, capacity)
    out.best_fit(order)
    return out


def fullest(sizes: list[int], items: list[int], room: int) -> list[int]:
    """Of the items those that fill the room best: sums that can be reached are the bits of a number."""
    reach = [1]
    within = (1 << (room + 1)) - 1
    for i in items:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & within)
        if reach[-1] >> room:
            break
    total = reach[-1].bit_length() - 1
    chosen = []
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> total & 1:
            chosen.append(items[k - 1])
            total -= sizes[items[k - 1]]
    return chosen


def refill(out: Bins, items: list[int], rng: random.Random) -> None:
    """New bins, each round the largest item left and what fills it best among some others; when these no longer fill a bin,
    the rest goes where it fits best."""
    left = sorted(items, key=lambda i: out.sizes[i])
    while left:
        first = left.pop()
        at = rng.sample(range(len(left)), min(CHOICE, len(left)))
        chosen = fullest(out.sizes, [left[k] for k in at], out.capacity - out.sizes[first])
        if out.capacity - out.sizes[first] - sum(out.sizes[i] for i in chosen) > out.capacity // 64:
            left.append(first)
            break
        out.add([first, *chosen])
        gone = set(chosen)
        left = [i for i in left if i not in gone]
    out.best_fit(left[::-1])


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Bins of b's fuller half go whole into a; a's bins that share an item with them are opened again, and its emptiest."""
    good = sorted(range(len(b.held)), key=lambda k: b.free[k])[: -(-len(b.held) // 2)]
    injected = [list(b.held[k]) for k in rng.sample(good, -(-len(good) // 2))]
    taken = {i for items in injected for i in items}
    out = Bins(a.sizes, a.capacity)
    displaced: list[int] = []
    # the emptiest bins are opened too: their items may fit into gaps
    worst = set(sorted((k for k in range(len(a.held)) if a.free[k]), key=lambda k: -a.free[k])[: max(1, len(a.held) // 8)])
    for k, items in enumerate(a.held):
        if k in worst or not taken.isdisjoint(items):
            displaced += [i for i in items if i not in taken]
        else:
            out.add(list(items))
    for items in injected:
        out.add(items)
    refill(out, displaced, rng)
    return out


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[list[int]]) -> Bins:
    """The best individual of an island. guests: individuals from other islands, as the bin of each item."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = []
    for bins in guests:
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(bins):
            groups.setdefault(b, []).append(i)
        guest = Bins(sizes, capacity)
        for items in groups.values():
            guest.add(items)
        people.append(guest)
    while len(people) < POPULATION:
        people.append(_seeded(sizes, capacity, rng, NOISE))
    for generation in range(GENERATIONS):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].held) <= least:
            break
        if generation == GENERATIONS // 4:
            # where crossovers alone have not reached the bound, a packing by falling size joins: the result is never worse
            people[-1] = _seeded(sizes, capacity, rng, 0.0)
            people.sort(key=Bins.fitness, reverse=True)
        a, b = rng.sample(people, 2)
        child = crossover(a, b, rng)
        if child.fitness() > people[-1].fitness():
            people[-1] = child
    return max(people, key=Bins.fitness)


def _assignment(bins: Bins) -> bytes:
    out = np.zeros(len(bins.sizes), np.int32)
    for b, items in enumerate(bins.held):
        out[items] = b
    return out.tobytes()


def _evolved(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(block, best): the best assignment of each block after all epochs. items: block, row, length."""

    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        people = [np.frombuffer(x, np.int32).tolist() for x in pdf["bins"].dropna()]
        own = pdf[pdf["row"].notna()].sort_values("row")
        block, isle = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        best = evolve([int(x) for x in own["length"]], capacity, hash((seed, block, isle, len(people))) & 0xFFFFFFFF, people)
        return pd.DataFrame({"block": [block], "island": [isle], "fit": [best.fitness()], "bins": [_assignment(best)]})

    state = None
    for _ in range(EPOCHS):
        dealt = items.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "row", "length", F.lit(None).cast("binary").alias("bins"))
        if state is not None:
            # elites: an island's own, and that of the island before it
            for shift in (0, 1):
                moved = F.pmod(F.col("island") + shift, F.lit(ISLANDS)).cast("int").alias("island")
                dealt = dealt.unionByName(state.select("block", moved, F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("length"), "bins"))
        state = cut(dealt.groupBy("block", "island").applyInPandas(island, "block long, island int, fit double, bins binary"))
    return state.groupBy("block").agg(F.max_by("bins", F.struct("fit", "island")).alias("bins"))


def _settled(items: DataFrame, best: DataFrame, capacity: int) -> DataFrame:
    """Items with their block's bin, its fill and their place in it."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["row"].notna()].sort_values("row")
        out = pd.DataFrame({"block": own["block"], "row": own["row"].astype("int64"), "length": own["length"].astype("int64")})
        out["bin"] = np.frombuffer(pdf["bins"].dropna().iloc[0], np.int32).astype("int64")
        grouped = out.groupby("bin")["length"]
        out["offset"] = grouped.cumsum() - out["length"]
        out["fill"] = grouped.transform("sum")
        return out[["block", "row", "length", "bin", "offset", "fill"]]

    rows = items.select("block", "row", "length", F.lit(None).cast("binary").alias("bins"))
    rows = rows.unionByName(best.select("block", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("length"), "bins"))
    return rows.groupBy("block").applyInPandas(settle, "block long, row long, length long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """pieces (length, ...) with `sequence_id` and `offset`; sequences hold at most `capacity`, offsets have no gaps."""
    rest = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = cut(pieces.select(*rest).withColumn("row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == capacity).select(*rest, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity).select("row", "length")
    placed = None
    base = 0
    for last in (False, True):
        n = items.count()
        if not n:
            break
        blocks = -(-n // BLOCK_ITEMS)
        blocked = items.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed + last)), F.lit(blocks)))
        settled = cut(_settled(blocked, _evolved(blocked, capacity, seed + last), capacity))
        done = settled if last else settled.where(F.col("fill") >= OPEN_BELOW * capacity)
        sequence = (F.col("block") + base) * F.lit(1 << 24) + F.col("bin")
        done = done.select("row", sequence.alias("sequence_id"), "offset")
        placed = done if placed is None else placed.unionByName(done)
        items = settled.where(F.col("fill") < OPEN_BELOW * capacity).select("row", "length")
        base += blocks
    if placed is None:
        return whole
    return whole.unionByName(pieces.join(placed, "row").select(*rest, "sequence_id", "offset"))
