"""Bucketed logs, daily states of distinct counts, and address blocks folded inside a row."""

import random
import re

from pyspark.sql import functions as F

from privatrail.operators import history as H
from privatrail.operators import pii
from privatrail.operators import sketches as K
from privatrail.sources.tables import append_bucketed

DAY = K.DAY_US


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_logs_meet_without_a_shuffle(spark, tmp_path):
    events = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 7).alias("us"))
    decisions = spark.range(1_000).select((F.col("id") % 390).alias("event_id"), F.col("id").alias("seq"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("outcome"), F.lit(0.5).alias("risk"))
    answers = spark.range(300).select((F.col("id") * 2 % 200).alias("event_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("action"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        logs = []
        for name, df in (("ev", events), ("de", decisions), ("an", answers)):
            half = F.col("us" if name == "ev" else "seq") % 2 == 0
            append_bucketed(df.where(half), f"bucketed_{name}", "event_id", 4, str(tmp_path / name))
            logs.append(append_bucketed(df.where(~half), f"bucketed_{name}", "event_id", 4))
        got, want = H.event_history(*logs), H.event_history(events, decisions, answers)
        assert "Exchange" in plan(want) and "Exchange" not in plan(got)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert got.count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("ev", "de", "an"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_day_states_merge_to_any_range(spark, tmp_path):
    # sites recur on several days, so daily counts cannot be added up
    seen = spark.range(600_000).select(
        (F.col("id") % 6 * DAY + F.col("id") % 1_000).alias("us"), F.when(F.col("id") % 5 < 2, "a").otherwise("b").alias("kind"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(90_000))).alias("site"),
    )
    path = str(tmp_path / "days")
    K.write_days(K.day_sketches(seen, ["kind"], {"sites": F.col("site")}), path)
    # the second day again, as after a failure
    K.write_days(K.day_sketches(seen.where(F.floor(F.col("us") / DAY) == 1), ["kind"], {"sites": F.col("site")}), path)
    states = spark.read.parquet(path)
    assert states.count() == 12
    for first, last in ((0, 5), (1, 1), (2, 4), (None, 3)):
        got = {r.kind: r.sites for r in K.merged(states, ["kind"], ["sites"], first, last).collect()}
        exact = seen.where(F.floor(F.col("us") / DAY).between(first or 0, last)).groupBy("kind").agg(F.count_distinct("site").alias("n")).collect()
        assert len(got) == len(exact) == 2
        for r in exact:
            assert r.n > 30_000 and abs(got[r.kind] - r.n) <= 3 * K.relative_error() * r.n
    assert K.merged(states, ["kind"], ["sites"], 9, 9).count() == 0


def blocks(text, spans):
    """Line by line: (first line, last line, start, end)."""
    out, at, first, start = [], 0, 0, 0
    for no, line in enumerate(text.split("\n")):
        codes = list(re.finditer(r"(?<!\d)\d{6}(?!\d)", line))
        if codes and first < no:
            end = at + codes[-1].end()
            if not any(c and s <= end - 6 and end <= e for s, e, c in spans):
                out.append((first, no, start, end))
        kept = any(not c and s < at + len(line) and at < e for s, e, c in spans)
        if kept or re.search(r"(?i)\b(?:female|dob)\b", line):
            first, start = no + 1, at + len(line) + 1
        at += len(line) + 1
    return out


def test_address_blocks(spark):
    rng = random.Random(3)
    words = ["House 7", "", "Town 560001", "female", "560002 and 560003", "1234567", "dob 560004", "čtvrť 560005 😀", "x"]
    texts = ["", "560001", "a\n560001", None, "\n".join(["Town 560001"] * 3_000)]
    texts += ["\n".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    spans = []
    for i, t in enumerate(texts):
        if t and i > 4 and i % 2:
            spans += [(i, a, min(len(t), a + rng.randint(1, 12)), rng.random() < 0.6) for a in (rng.randrange(len(t)) for _ in range(4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.address_blocks(docs, spark.createDataFrame(spans, "doc_id long, start int, end int, covered boolean"))
    got = sorted((r.doc_id, r.first_line, r.last_line, r.start, r.end) for r in found.collect())
    own = {i: [s[1:] for s in spans if s[0] == i] for i in range(len(texts))}
    want = sorted((i, *b) for i, t in enumerate(texts) if t is not None for b in blocks(t, own[i]))
    assert got == want and len(want) > 3_000
    bare = pii.address_blocks(docs)
    assert "hashpartitioning" not in plan(bare) and "Window" not in plan(bare)
