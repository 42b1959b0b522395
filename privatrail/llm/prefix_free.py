"""Removal of repeated passages by prefix-free parsing.

A rolling hash of GRAM bytes triggers phrase ends: a window of `length` bytes is ruled by the least hash of its grams, so
every window, wherever it stands, has one trigger, and windows with equal bytes have the same. A phrase is the run of
windows ruled by one trigger. The dictionary holds every distinct phrase once, with its first occurrence; the parse is
the phrases of each document in order. As no window leaves its phrase, corpus order is that of the dictionary:

1. Phrases meet by themselves. Of equal phrases all but the first occurrence repeat, whole.
2. Distinct phrases that share a trigger may share windows. Their bytes meet by trigger, and the windows of these
   dictionary entries are grouped by a 64-bit hash of `length` bytes, in place of a suffix array: in each class of equal
   hashes all but the one of earliest occurrence repeat. Bytes are not compared.
3. The covered bytes of each document go.

Copies inside a batch are settled there, so of a passage of a third of all documents the inner phrases send one row a batch.
Its two edge phrases stretch into each document's own text and differ everywhere. So triggers are counted, never gathered:
one that more than CROWD dictionary entries share sends single windows as hashes, without bytes, whose earliest occurrence
is a combining minimum and is joined back to the others. No task holds all the rows of a trigger or of a window.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; a null id is before all others; rows that
repeat an id are one document, in which equal starts do not precede each other. Further columns pass through, but the
text gives way to what is kept of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import add_columns, cut, discard

GRAM = 32
#: Bytes parsed at a time, which bounds memory for very long texts.
BLOCK = 1 << 20
#: Documents parsed together, whose copies are settled on the spot.
BATCH_DOCS = 2048
CROWD = 4096
NO_ID = -(1 << 63)
#: Documents whose phrases make a group of the second step, and documents of a group in the last, about.
GROUP_DOCS, PART_DOCS = 256, 256

_TABLE = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
SPAN_TYPE = "doc long, start long, windows int, phrase long, kind int"


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hash of every `size` bytes, put together by doubling."""
    out, have, done = None, 0, 0
    part, width, power = _TABLE[data], 1, _BASE
    while True:
        if size >> done & 1:
            if out is None:
                out, have = part, width
            else:  # the longer part follows what is there
                n = len(data) - have - width + 1
                out = out[:n] * np.uint64(power) + part[have : have + n]
                have += width
        done += 1
        if size >> done == 0:
            return out
        part = part[:-width] * np.uint64(power) + part[width:]
        width *= 2
        power = power * power & _WRAP


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def phrases(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, first window and number of windows of each phrase. Blocks overlap by a window less a byte."""
    found = []
    for a in range(0, len(raw) - length + 1, BLOCK):
        data = np.frombuffer(raw, np.uint8, min(len(raw) - a, BLOCK + length - 1), a)
        h = _mixed(rolling(data, GRAM))
        # the hash's high bits before the place: the least is the leftmost of the least hashes
        packed = (h & np.uint64(_WRAP << 24 & _WRAP)) | np.arange(len(h), dtype=np.uint64)
        wide, have = length - GRAM + 1, 1
        while have * 2 <= wide:
            packed = np.minimum(packed[:-have], packed[have:])
            have *= 2
        if have < wide:
            packed = np.minimum(packed[: len(packed) - (wide - have)], packed[wide - have :])
        ruler = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], ruler[1:] != ruler[:-1]]))
        found.append((h[ruler[starts]].view(np.int64), starts + a, np.diff(np.append(starts, len(ruler)))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digest(raw: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(raw)
    return x - (1 << 64) if x >> 63 else x


def _firsts(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys, document and start; for each place in it whether it begins a class, and whether it comes
    after the class's first occurrence."""
    order = np.lexsort([start, doc, *keys[::-1]])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    late = (doc[order] != doc[head]) | (start[order] != start[head])
    return order, new, late


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, BATCH_DOCS):
        yield batch.slice(a, BATCH_DOCS)


def _parse(length: int, groups: int) -> Callable:
    """Phrases of a batch of documents. kind 0: a repeat, settled; 1: to be compared with other tasks' phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            trigger, start, windows, digests, doc = [], [], [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (value.as_py() or "").encode()
                if len(raw) < length:
                    continue
                t, s, w = phrases(raw, length)
                trigger.append(t)
                start.append(s)
                windows.append(w)
                digests += [_digest(raw[a:b]) for a, b in zip(s.tolist(), (s + w + (length - 1)).tolist(), strict=True)]
                doc.append(np.full(len(t), doc_id, np.int64))
            if not doc:
                continue
            trigger, start, windows, doc = (np.concatenate(x) for x in (trigger, start, windows, doc))
            digest = np.array(digests, np.int64)
            order, _, late = _firsts([trigger, digest], doc, start)
            kind = np.where(late, 0, 1).astype(np.int32)
            trigger, start, windows, doc, digest = (x[order] for x in (trigger, start, windows, doc, digest))
            # by phrase, not by trigger: the edges of a passage have one trigger but differ in every document
            spread = np.where(late, start + doc, trigger ^ digest).view(np.uint64)
            group = (_mixed(spread) % np.uint64(groups)).astype(np.int64)
            arrays = [group, trigger, digest, doc, start, windows.astype(np.int32), kind]
            for a in range(0, len(kind), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in arrays], names=["group", "trigger", "phrase", "doc", "start", "windows", "kind"])

    return run


def _compare(table: pa.Table) -> pa.Table:
    """One group of phrases. kind 0: repeats, whole; 1: first occurrences, the entries of the dictionary."""
    trigger, phrase, doc, start, windows, kind = (table.column(c).to_numpy() for c in ("trigger", "phrase", "doc", "start", "windows", "kind"))
    settled = kind == 0
    open_ = np.flatnonzero(~settled)
    order, new, late = _firsts([trigger[open_], phrase[open_]], doc[open_], start[open_])
    order = open_[order]
    at = np.concatenate([np.flatnonzero(settled), order[late], order[new]])
    kinds = np.concatenate([np.zeros(settled.sum() + late.sum(), np.int32), np.ones(new.sum(), np.int32)])
    return pa.table({"trigger": trigger[at], "doc": doc[at], "start": start[at], "windows": windows[at], "phrase": phrase[at], "kind": kinds})


def _fetch(length: int, groups: int) -> Callable:
    """The bytes of the phrases asked for; where the trigger is crowded, the hashes of single windows without bytes."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"group": [], "trigger": [], "doc": [], "start": [], "windows": [], "bytes": []}
        by_doc: dict[int, list[tuple]] = {}
        for row in zip(*(asked.column(c).to_pylist() for c in ("doc", "trigger", "start", "windows", "phrase", "kind")), strict=True):
            by_doc.setdefault(row[0], []).append(row[1:])
        seen: set[tuple] = set()
        for doc_id, value in zip(docs.column("doc").to_pylist(), docs.column("text"), strict=True):
            if doc_id not in by_doc:
                continue
            raw = (value.as_py() or "").encode()
            for trigger, start, windows, phrase, kind in by_doc[doc_id]:
                part = raw[start : start + windows + length - 1]
                # rows that repeat an id with other texts do not hold the phrase
                if (doc_id, start, phrase) in seen or _digest(part) != phrase:
                    continue
                seen.add((doc_id, start, phrase))
                rows = [(trigger, start, windows, part)]
                if kind == 2:
                    rows = [(_digest(part[i : i + length]), start + i, 1, None) for i in range(windows)]
                for t, s, w, b in rows:
                    out["group"].append(t)
                    out["trigger"].append(t)
                    out["doc"].append(doc_id)
                    out["start"].append(s)
                    out["windows"].append(w)
                    out["bytes"].append(b)
        group = (_mixed(np.array(out["group"], np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        types = {"trigger": pa.int64(), "doc": pa.int64(), "start": pa.int64(), "windows": pa.int32(), "bytes": pa.binary()}
        return pa.table({"group": pa.array(group, pa.int64())} | {c: pa.array(out[c], t) for c, t in types.items()})

    return run


def _order(length: int) -> Callable:
    """The windows of a group's dictionary entries, by rolling hash: runs of windows with an earlier equal."""

    def run(table: pa.Table) -> pa.Table:
        doc, start, windows, trigger = (table.column(c).to_numpy() for c in ("doc", "start", "windows", "trigger"))
        texts = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begins[row] + nth
        suffix = rolling(data, length)[at]
        wdoc, wstart = doc[row], start[row] + nth
        order, _, late = _firsts([trigger[row], suffix], wdoc, wstart)
        hit = order[late]
        hit = hit[np.lexsort([wstart[hit], wdoc[hit]])]
        d, s = wdoc[hit], wstart[hit]
        begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(d)))
        place, first_row, flat = at[hit][begin], row[hit][begin], data.tobytes()
        digest, keep, many = [], [], []
        for k, (p, r, n) in enumerate(zip(place.tolist(), first_row.tolist(), count.tolist(), strict=True)):
            # a run may go on in the next phrase of the document, whose bytes lie elsewhere: cut it there
            n = min(n, int(begins[r] + sizes[r]) - p - length + 1)
            digest.append(_digest(flat[p : p + n + length - 1]))
            many.append(n)
            keep.append(k)
        spans = (d[begin], s[begin], np.array(many, np.int64))
        rest = count - spans[2] if len(count) else count
        if len(rest) and rest.any():  # the cut-off windows, one by one
            more = np.concatenate([np.arange(b + n, b + c) for b, n, c in zip(begin.tolist(), many, count.tolist(), strict=True) if c > n])
            spans = (np.concatenate([spans[0], d[more]]), np.concatenate([spans[1], s[more]]), np.concatenate([spans[2], np.ones(len(more), np.int64)]))
            digest += [_digest(flat[p : p + length]) for p in at[hit][more].tolist()]
        return pa.table({"doc": pa.array(spans[0], pa.int64()), "start": pa.array(spans[1], pa.int64()), "windows": pa.array(spans[2], pa.int32()), "phrase": pa.array(digest, pa.int64()), "kind": pa.array(np.zeros(len(digest), np.int32))})

    return run


def _remove(length: int, rest: list[str]) -> Callable:
    """The texts of a group of documents without the bytes that repeated windows cover."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        by_doc: dict[int, list[tuple]] = {}
        for d, *span in zip(*(spans.column(c).to_pylist() for c in ("doc", "start", "windows", "phrase")), strict=True):
            by_doc.setdefault(d, []).append(span)
        kept, removed, runs = [], [], []
        for doc_id, value in zip(docs.column("doc").to_pylist(), docs.column("text"), strict=True):
            raw = (value.as_py() or "").encode()
            pieces, at, gone, n = [], 0, 0, 0
            end = None
            for start, windows, phrase in sorted(by_doc.get(doc_id, [])):
                stop = start + windows + length - 1
                if stop > len(raw) or _digest(raw[start:stop]) != phrase:
                    continue  # of another row with this id
                if end is None or start > end:
                    pieces.append(raw[at:start])
                    n += 1
                    end = start
                gone += max(0, stop - end)
                end = at = max(end, stop)
            pieces.append(raw[at:])
            kept.append(b"".join(pieces))
            removed.append(gone)
            runs.append(n)
        out = {c: docs.column(c) for c in rest}
        return pa.table(out | {"kept": pa.array(kept, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64())})

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, crowd: int = CROWD) -> DataFrame:
    """docs with `kept` (the remaining bytes) in place of the text, `n_removed` and `n_spans`: every byte goes that is covered by a string of
    `length` bytes which also starts earlier, in a document of smaller id or before in the same."""
    rest = [c for c in docs.columns if c not in (text, "kept", "n_removed", "n_spans")]
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    n = docs.count()
    groups, parts = max(16, n // GROUP_DOCS), max(16, n // PART_DOCS)
    parsed = own.mapInArrow(_parse(length, groups), "group long, trigger long, phrase long, doc long, start long, windows int, kind int")
    answers = cut(parsed.groupBy("group").applyInArrow(_compare, f"trigger long, {SPAN_TYPE}"), sweep=True)
    entries = answers.where("kind = 1")
    shared = cut(entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1"))
    part = F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("part")
    kind = F.when(F.col("entries") > crowd, 2).otherwise(1).alias("kind")
    asked = entries.drop("kind").join(shared, "trigger").select(part, "trigger", "doc", "start", "windows", "phrase", kind)
    fetched = (
        own.select(part, "doc", "text").groupBy("part").cogroup(asked.groupBy("part"))
        .applyInArrow(_fetch(length, groups), "group long, trigger long, doc long, start long, windows int, bytes binary")
    )
    fetched = cut(fetched, sweep=True)
    late = cut(fetched.where("bytes IS NOT NULL").groupBy("group").applyInArrow(_order(length), SPAN_TYPE), sweep=True)
    # single windows: of each hash the earliest, which combines before the shuffle, and a join that skew does not hold up
    single = fetched.where("bytes IS NULL").select(F.col("trigger").alias("phrase"), "doc", "start")
    first = cut(single.groupBy("phrase").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "start")).alias("first")).where("times > 1"))
    later = cut(
        single.join(first.select("phrase", "first"), "phrase").where(F.struct("doc", "start") != F.col("first"))
        .select("doc", "start", F.lit(1).alias("windows"), "phrase", F.lit(0).alias("kind"))
    )
    discard(shared, fetched, first)
    spans = answers.where("kind = 0").select(*SPAN_NAMES).unionByName(late).unionByName(later).select(part, *SPAN_NAMES)
    full = docs.select(*[F.col(f"`{c}`").alias(f"x_{c}") for c in rest], F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    full = full.select(part, *full.columns)
    schema = ", ".join([f"`x_{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + ["kept binary", "n_removed long", "n_spans long"])
    out = full.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_remove(length, [f"x_{c}" for c in rest]), schema)
    return out.select(*[F.col(f"`x_{c}`").alias(c) for c in rest], "kept", "n_removed", "n_spans")


SPAN_NAMES = ["doc", "start", "windows", "phrase", "kind"]


def as_text(kept: DataFrame, source: str, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and `text`: the kept bytes as a string, without the halves of characters that were cut."""

    def work():
        return lambda values: [[(v or b"").decode("utf-8", "ignore") for v in values]]

    return add_columns(kept, source, {text: "string"}, work, keep)
