"""Prefix trie, Merkle manifest and chat formatting against brute force: nulls, ties, repeated rows, long conversations,
empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from privatrail.llm import chat_format, merkle, ordering, prefix_trie
from privatrail.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
CODER = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables in as many ranges as there are partitions, so that conversations and groups stand in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(40), 101, 103, 5000, 5003, -3, -5, 1 << 54, (1 << 54) + 1]:
        for t in range(rng.choice([1, 2, 3, 9, 12, 30])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "Grüße", "", None, "### x", "a\\</turn>", f"{c} {t}"])))
    rows += [(200, t, "user", "same") for t in range(300)] + [(201, t, "user", "same") for t in range(300)]  # deep
    rows += [(300 + i, t, "user", f"common {t}") for i in range(40) for t in range(11)]  # copies
    rows += [(400, None, "system", "first"), (400, 0, "user", "b"), (400, 0, "user", "a"), (400, 0, "user", "a"), (400, None, None, None)]
    rows += [(None, 0, "user", "nobody"), (None, 1, "assistant", "no one")]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    held = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        held[c].append((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    return {c: [(x[3], x[4]) for x in sorted(v)] for c, v in held.items()}


def brute_trie(rows):
    turns = ordered([r for r in rows if r[0] is not None])
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return {
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
         sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))))
        for node, m in members.items()
    }


def frame(spark, rows):
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    for c in ("depth", "pos", "size", "n", "conv", "first", "base", "level", "part", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_prefix_trie(spark):
    rows = odd_conversations()
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    one = prefix_trie.prefix_trie(frame(spark, [(3, 0, "user", "x")])).collect()  # 3's first turns go and 0 has none to lend
    assert {tuple(r) for r in one} == brute_trie([(3, 0, "user", "x")])


def test_bands_and_blocks_of_any_height(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 3)
    plain = ordering.running
    monkeypatch.setattr(prefix_trie, "running", lambda *a: plain(*a, fan=6))
    rows = odd_conversations()
    assert {tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()} == brute_trie(rows)


def test_positions_of_a_long_group(spark):
    rows = [(1, i // 3) for i in range(900)] + [(2, 5), (3, 1), (3, 0)]
    placed, groups = ordering.place(spark.createDataFrame(rows, "g int, v int").repartition(9), ["g"], [F.col("v")])
    at = placed.join(groups, ["g", ordering.PART]).withColumn("pos", F.col(ordering.AT) - F.col("first") + F.col("before")).collect()
    assert placed.select(ordering.PART).distinct().count() > 1
    for g, n in ((1, 900), (2, 1), (3, 2)):
        mine = sorted((r.pos, r.v, r["size"]) for r in at if r.g == g)
        assert [p for p, _, _ in mine] == list(range(n)) and [v for _, v, _ in mine] == sorted(v for x, v in rows if x == g) and {s for _, _, s in mine} == {n}


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def brute_manifest(rows):
    def leaf(r):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(hashes):
        """root and each leaf's (side, sibling) upwards"""
        place, proofs = list(range(len(hashes))), [[] for _ in hashes]
        while len(hashes) > 1:
            for i, p in enumerate(place):
                j = p ^ 1
                proofs[i].append(("N", "") if j >= len(hashes) else ("L" if j < p else "R", hashes[j]))
            place = [p // 2 for p in place]
            hashes = [sha("".join(hashes[i : i + 2])) for i in range(0, len(hashes), 2)]
        return hashes[0], proofs

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    kept = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: tree([leaf(r) for r in kept[g]]) for g in names}
    root, over = tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, over, strict=True):
        for r, below in zip(kept[g], trees[g][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for side, other in below + above:
                now = sha(other + now if side == "L" else now + other)
            out.append((r[0], leaf(r), trees[g][0], root, sha("".join(h for _, h in below + above)), now, now == root))
    return sorted(map(str, out))


def manifest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    for c in ("leaf", "tree", "idx", "level", "hash", "size", "weight", "seg", "root", "changed"):
        df = df.withColumn(c, F.lit("clash"))
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(str(tuple(r)) for r in merkle.manifest(df, FIELDS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, altered).collect())


def odd_documents(n):
    rows = [(i, f"s{i % 3}", "en", 3 * i, f"text {i}") for i in range(n)]
    rows += [(10_000 + i, None, f"l{i:02}", None if i % 2 else i, None if i % 3 else "") for i in range(37)]
    rows += [(20_000 + i, "s", None, i, "ü" * i) for i in range(5)] + [(None, None, None, None, None), (None, "a", "en", 1, "x"), (None, "a", "", 1, "x")]
    return rows + rows[:3] + [(7, "other", "en", 1, "a row of the same id"), (1, "s", "x" * 70, 1, "long name"), (2, "s", "x" * 71, 1, "long name")]


@pytest.mark.parametrize("bits", [10, 2])
def test_merkle_manifest(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rows = odd_documents(333)
    assert manifest(spark, rows) == brute_manifest(rows)


def test_merkle_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HOT", 2)
    for rows in ([], odd_documents(1)[:1], odd_documents(5)[:5], [(1, "s", "a", 1, "x"), (2, "s", "b", 1, "x")]):
        assert manifest(spark, rows) == (brute_manifest(rows) if rows else [])
    rows = odd_documents(40)
    assert manifest(spark, rows) == brute_manifest(rows)


def brute_chat(rows):
    out = set()
    for c, turns in ordered(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "".join(f"### {chat_format.escape(r)} ###\n{chat_format.escape(t)}\n</turn>\n" for r, t in turns)
        assert chat_format.parse(shown) == turns
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(shown)))
    return out


@pytest.mark.parametrize("size", [1 << 17, 40])
def test_chat_format(spark, monkeypatch, size):
    monkeypatch.setattr(chat_format, "FRAGMENT", size)
    rows = odd_conversations() + chat_format.PLANTED + [(900, i, "assistant", "long " * 50) for i in range(200)] + [(901, 0, "assi</turn>###", "\\\\###\\")]
    made = chat_format.format_conversations(frame(spark, rows), *CODER)
    got = [tuple(r) for r in chat_format.read_back(made, *CODER).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_chat(rows)
    assert chat_format.format_conversations(frame(spark, []), *CODER).count() == 0


def test_chat_ids_and_mask():
    coder = chat_format.Coder(*CODER)
    texts = ["", "\\", "###", "\\###", "#####", "</turn>", "\\\\</turn>\\", "x\n</turn>\n### user ###\n", "Ünï 日本", "<|endoftext|>"]
    turns = [(r, t) for t in texts for r in ("user", "assistant", "### ", "</turn>")]
    ids, starts, ends = coder.assemble(turns)
    flags = chat_format.mask(len(ids), starts, ends)
    assert coder.read(ids) == turns and chat_format.parse(coder.render(ids)) == turns
    assert [chat_format.unescape(coder.decode(ids[a:b])) for a, b in zip(starts, ends, strict=True)] == [t for r, t in turns if r == "assistant" and t]
    assert flags.sum() == (ends - starts).sum() and not (flags & (ids >= coder.opens[0])).any()
    # an id of a mark comes from no text
    assert all((coder.encode(chat_format.escape(t)) < coder.opens[0]).all() for t in [*texts, *chat_format.MARKS])
    assert np.array_equal(coder.encode("### "), coder.encode("### ")) and coder.render(ids).count("\n</turn>\n") >= len(turns)


def test_registered_queries(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    assert {tuple(r) for r in QUERIES["op11_prefix_trie"](spark, sf).collect()} == brute_trie(turns)
    assert sorted(str(tuple(r)) for r in QUERIES["op12_merkle"](spark, sf).collect()) == brute_manifest(docs)
    assert {tuple(r) for r in QUERIES["op13_chat_format"](spark, sf).collect()} == brute_chat(turns + chat_format.PLANTED)
