"""Diffs, logs and the compacting stream."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrafold.streaming import edits


def test_text_diffs(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdé😀 \n", k=n))
    rows = [("", ""), ("", "abc"), ("abc", ""), ("abc", "abc"), ("aaa", "aa"), (word(3000), word(2500)), ("x" * 20_000, "x" * 19_999 + "y"), (None, "a"), ("a", None)]
    for _ in range(60):
        t = word(r.randrange(0, 40))
        cut = r.randrange(len(t) + 1)
        rows.append((t, t[:cut] + word(r.randrange(4)) + t[cut + r.randrange(4) :]))
    df = spark.createDataFrame(rows, "old string, new string").withColumn("e", edits.text_diff(F.col("old"), F.col("new")))
    for x in df.withColumn("got", edits.splice(F.col("old"), F.col("e"))).collect():
        assert x.got == (x.new if x.old is not None else None)
        if x.old == x.new and x.old:
            assert [s.op for s in x.e] == ["retain"]


def test_list_diffs(spark):
    r = random.Random(4)
    some = lambda: [r.choice([1, 2, 3, None]) for _ in range(r.randrange(0, 7))]
    rows = [([], []), ([1, 2], [1, 2]), ([], [1]), ([1], []), (None, [1, 2])] + [(some(), some()) for _ in range(120)]
    df = spark.createDataFrame(rows, "old array<int>, new array<int>").withColumn("e", edits.list_diff(F.col("old"), F.col("new")))
    old = F.coalesce("old", F.array().cast("array<int>"))
    for x in df.withColumn("got", edits.splice_list(old, F.col("e"))).collect():
        assert x.got == x.new
        want, k, was = [], 0, x.old or []
        if was != x.new:
            for a, b in zip(was, x.new):
                if a == b:
                    want[-1:] = [("retain", want[-1][1] + 1)] if want and want[-1][0] == "retain" else [*want[-1:], ("retain", 1)]
                else:
                    want.append(("set", 1))
            k = len(x.new) - len(was)
            want += [("insert", k)] if k > 0 else [("delete", -k)] if k < 0 else []
        assert [(s.op, s.n) for s in x.e] == want


def test_logs_and_registries(spark):
    log = spark.createDataFrame([("a", 1, "k", "set", 1.0), ("a", 2, "k", "del", None), ("b", 1, "k", "set", 1.0), ("b", 3, "j", "set", 2.0), ("c", 5, "k", "set", 1.0), ("d", 1, "k", "??", 1.0)], "resource string, clock long, key string, op string, value double")
    state = spark.createDataFrame([("b", "k", 1.0), ("b", "j", 2.0), ("c", "k", 1.0), ("d", "k", 7.0)], "resource string, key string, value double")
    got = sorted((r.resource, r.clock, r.key, r.rebuilt) for r in edits.validated_log(log, state).collect())
    assert got == [("a", 1, "k", False), ("a", 2, "k", False), ("b", 3, "j", True), ("b", 3, "k", True), ("c", 5, "k", False), ("d", 1, "k", True)]
    live = spark.createDataFrame([("b", "j"), ("b", "j"), ("d", "x")], "resource string, key string")
    assert sorted(tuple(r)[:2] for r in edits.collected(state, live).collect()) == [("b", "j"), ("c", "k")]


def test_compacting_stream(spark, tmp_path):
    """State holds live keys and recent clients only, through a restart; keys that leave the registry and quiet resources go."""
    schema = "resource string, kind string, client string, seq long, key string, op string, value double, ts timestamp"
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    parts = [
        [("r", "edit", "a", n, f"k{n % 3}", "set", float(n), at(0)) for n in range(30)] + [("q", "edit", "z", 0, "k", "set", 5.0, at(0))],
        [("r", "edit", "a", 29, "k0", "set", 0.0, at(5)), ("r", "edit", "a", 30, "k1", "del", None, at(5)), ("r", "gone", None, None, "k2", None, None, at(6))],
        [("r", "edit", "b", 0, "k9", "set", 1.0, at(100)), ("s", "edit", "c", 1, "k", "set", 1.0, at(100))],
        [("r", "edit", "a", 31, "k0", "set", 2.0, at(190)), ("r", "edit", "b", 1, "k9", "set", 3.0, at(130))],
        [("t", "edit", "d", 0, "k", "set", 1.0, at(400))],
    ]
    rows = []
    for n, part in enumerate(parts):  # each part is a new run of the stream from its log
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = edits.compacted(source, "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 3 for p in q.recentProgress if p["stateOperators"])
        rows.append(sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str))
    out = rows[-1]
    of = lambda status: sorted((r.resource, r.client, r.seq, r.clock, r.key) for r in out if r.status == status)
    assert [(r[0], r[2], r[3]) for r in of("ok") if r[1] == "a"] == [("r", n, n + 1) for n in range(31)]
    assert of("duplicate") == [("r", "a", 29, None, "k0")]
    assert of("collected") == [("r", None, None, 30, "k2")]
    assert ("r", "a", 31, None, "k0") in of("gap") and ("s", "c", 1, None, "k") in of("gap")  # a was forgotten, c never began
    assert ("q", None, None, 1, "k") in of("kept")
