"""Conversations as token ids with a loss mask, assembled from tokens.

Roles and texts are encoded by themselves, and ids beyond the vocabulary are spliced in as marks: one opens a turn, one
ends its role, one ends the turn. So no text can make a mark. In the rendered text the marks are control strings, and
every control string inside a role or a text is escaped: of backslashes before it there are twice as many and one more.
The mask comes from running sums of the pieces' lengths: it covers the ids of the assistant's texts and nothing else.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length stands in as many ranges as it
needs. The output is a row per fragment of a conversation; nearly all conversations have one. `whole` says that its range
holds its conversation's neighbours on both sides, so that it surely is all of it; the fragments of others follow each
other by (part, number).

Results on odd input: a null role or text is empty; a null turn comes first, rows of one turn go by the SHA-256 of role
and text, and repeated rows all count; rows without a conversation id are one conversation, of id null; only the role
`assistant` as written is under the mask; an empty table has no fragments.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut
from privatrail.llm.ordering import ranged
from privatrail.llm.prefix_trie import turn_digest

#: How the three marks are rendered: a turn opens, its role ends, it ends.
MARKS = ("### ", " ###\n", "\n</turn>\n")
CONTROL = ("###", "</turn>")
LEARNED = "assistant"
#: A fragment ends behind the turn that reaches this many ids.
FRAGMENT = 1 << 17
FIELDS = "conv_id long, part int, number long, whole boolean, n_turns long, ids binary, loss_from array<long>, loss_to array<long>"
_ESCAPED = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\1\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2], text)


class Coder:
    """Ids of ordinary text, and the three marks behind the vocabulary's last id."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.opens, self.named, self.ends = (np.array([first + i], "<u4") for i in range(3))
        self.marks = dict(zip(range(first, first + 3), MARKS, strict=True))
        self.roles: dict[str, np.ndarray] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")

    def role(self, role: str) -> np.ndarray:
        if role not in self.roles:
            if len(self.roles) > 1000:
                self.roles.clear()
            self.roles[role] = self.encode(escape(role))
        return self.roles[role]

    def decode(self, ids: np.ndarray) -> str:
        return self.plain.decode_bytes(ids.tolist()).decode()

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some turns, and where the runs under the mask start and end."""
        pieces: list[np.ndarray] = []
        for role, text in turns:
            pieces += [self.opens, self.role(role), self.named, self.encode(escape(text)), self.ends]
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        learned = np.array([5 * i + 3 for i, (role, text) in enumerate(turns) if role == LEARNED and text], np.int64)
        return np.concatenate(pieces), ends[learned - 1], ends[learned]

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The turns that were assembled."""
        at = np.flatnonzero(ids >= self.opens[0])
        if len(at) % 3 or (ids[at].reshape(-1, 3) != np.concatenate([self.opens, self.named, self.ends])).any():
            raise ValueError("marks out of order")
        return [(unescape(self.decode(ids[a + 1 : b])), unescape(self.decode(ids[b + 1 : c]))) for a, b, c in at.reshape(-1, 3).tolist()]

    def render(self, ids: np.ndarray) -> str:
        """The formatted text, marks as control strings."""
        out, last = [], 0
        for i in np.flatnonzero(ids >= self.opens[0]).tolist():
            out += [self.decode(ids[last:i]), self.marks[int(ids[i])]]
            last = i + 1
        return "".join([*out, self.decode(ids[last:])])


def mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One flag an id: the running sum of +1 where a run starts and -1 where it ends."""
    steps = np.zeros(n + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def parse(text: str) -> list[tuple[str, str]]:
    """Turns from rendered text alone: control strings behind no backslash are marks."""
    turns, begin, role = [], 0, None
    for m in _ESCAPED.finditer(text):
        if m[1]:
            continue
        if m[2] == CONTROL[1]:
            turns.append((unescape(role), unescape(text[begin : m.start() - 1])))
            begin, role = m.end() + 1, None
        elif role is None and m.start() == begin:
            begin, role = m.end() + 1, ""
        else:
            role, begin = text[begin : m.start() - 1], m.end() + 1
    return turns


def format_conversations(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The fragments of all conversations (conv_id, turn, role, text): `ids` as little-endian unsigned 32-bit integers, and
    the runs of ids under the mask, from `loss_from` to before `loss_to`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks_path, pattern)
        part, number, sure, now, started = 0, 0, False, None, False
        turns: list[tuple[str, str]] = []
        done: list[tuple] = []
        first = True  # of its conversation in this range
        held = 0

        def close(last: bool) -> None:
            nonlocal number, first, held
            ids, a, b = coder.assemble(turns) if turns else (np.zeros(0, "<u4"), [], [])
            done.append((now, part, number, sure and first and last, len(turns), ids.tobytes(), a, b))
            number, first, held = number + 1, False, 0
            turns.clear()

        def out() -> pa.RecordBatch:
            made = _table(done, FIELDS)
            done.clear()
            return made

        for batch in batches:
            for part, conv, role, text in zip(*[batch.column(i) for i in range(4)], strict=True):
                part, conv, role, text = part.as_py(), conv.as_py(), role.as_py(), text.as_py()
                if not started or conv != now:
                    if started:
                        if turns or not first:
                            close(True)
                        sure = True  # the first of a range may have begun in the one before
                    started, now, first = True, conv, True
                turns.append((role, text))
                held += len(text)
                if held >= 2 * FRAGMENT:
                    close(False)
                    if sum(len(x[5]) for x in done) > 8 * FRAGMENT:
                        yield out()
            if done:
                yield out()
        if turns:
            close(False)  # the last of a range may go on in the next
        yield out()

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), turn_digest().alias("digest"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = ranged(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")])
    return dealt.select(F.spark_partition_id().alias("part"), "conv", "role", "text").mapInArrow(run, FIELDS)


SUMMARY = "conv_id long, part int, number long, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns binary, loss binary"


def read_back(fragments: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What the ids and masks of the fragments say: per conversation conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. The bytes of conversations in several fragments stream through one hash each, fragment by
    fragment: a hash of a whole conversation has no other order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks_path, pattern)
        for batch in batches:
            done = []
            for row in zip(*[batch.column(i) for i in range(8)], strict=True):
                conv, part, number, whole, n_turns, ids, starts, ends = (x.as_py() for x in row)
                ids = np.frombuffer(ids, "<u4")
                turns = "".join(f"{role}\n{text}\n" for role, text in coder.read(ids)).encode()
                loss = "".join(unescape(coder.decode(ids[a:b])) for a, b in zip(starts, ends, strict=True))
                digests = [hashlib.sha256(x).hexdigest() if whole else None for x in (turns, loss.encode())]
                texts = (None, None) if whole else (turns, loss.encode())
                done.append((conv, part, number, whole, n_turns, digests[0], len(loss), digests[1], len(coder.render(ids)), *texts))
            yield _table(done, SUMMARY)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, sums, hashes, done = None, False, [0, 0, 0], [], []
        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(6)], strict=True):
                conv, n_turns, chars, formatted, turns, loss = (x.as_py() for x in row)
                if not started or conv != now:
                    if started:
                        done.append((now, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]))
                    started, now, sums, hashes = True, conv, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                sums = [a + b for a, b in zip(sums, (n_turns, chars, formatted), strict=True)]
                hashes[0].update(turns)
                hashes[1].update(loss)
            yield _table(done, RESULT)
            done = []
        if started:
            yield _table([(now, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2])], RESULT)

    summary = cut(fragments.mapInArrow(run, SUMMARY))
    names = [f.split()[0] for f in RESULT.split(", ")]
    parts = summary.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    rest = parts.select("conv_id", "n_turns", "loss_chars", "formatted_chars", "turns", "loss").mapInArrow(fold, RESULT)
    return summary.where("whole").select(*names).unionByName(rest)


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[tuple], fields: str) -> pa.RecordBatch:
    named = [f.split() for f in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


#: The planted conversation of the query: its texts hold both control strings, one of them escaped already.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

_ESC_SQL = "regexp_replace({0}, '(\\\\*)(###|</turn>)', '\\1\\1\\\\\\2', 'g')"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS p FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  sum({sum(map(len, MARKS))} + length({_ESC_SQL.format("role")}) + length({_ESC_SQL.format("text")}))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
