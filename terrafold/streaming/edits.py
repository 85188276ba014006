"""Mergeable edits: maps, counters and texts in batch, and an ordered, deduplicated ingest as a stream.

A batch edit is a row (resource, key, op, value, clock). Folds are aggregates that combine before
their shuffle, so a resource with a third of all edits is no burden.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def map_state(edits: DataFrame) -> DataFrame:
    """(resource, key, value): the last edit of each key, if it set a value."""
    last = edits.groupBy("resource", "key").agg(F.max_by(F.struct("op", "value"), "clock").alias("last"))
    return last.filter("last.op = 'set'").select("resource", "key", "last.value")


def map_rebase(mine: DataFrame, prior: DataFrame, prior_is_service: bool) -> DataFrame:
    """My edits after a concurrent prior edit: of keys that it touched mine stay only if it came from the service."""
    return mine if prior_is_service else mine.join(prior.select("resource", "key").distinct(), ["resource", "key"], "left_anti")


def counter_state(edits: DataFrame) -> DataFrame:
    """(resource, key, value): the sum of what was added after the last delete; keys with nothing since are absent."""
    gone = edits.filter("op = 'del'").groupBy("resource", "key").agg(F.max("clock").alias("gone"))
    live = edits.filter("op = 'add'").join(gone, ["resource", "key"], "left").filter("gone is null or clock > gone")
    return live.groupBy("resource", "key").agg(F.sum("value").alias("value"))


def counter_rebase(mine: DataFrame, prior: DataFrame, prior_is_service: bool) -> DataFrame:
    """``mine`` after ``prior``: a key that ``prior`` deletes loses its edits, unless ``prior`` is the service's."""
    if prior_is_service:
        return mine
    return mine.join(prior.filter("op = 'del'").select("resource", "key").distinct(), ["resource", "key"], "left_anti").select(mine.columns)


def counter_composed(edits: DataFrame) -> DataFrame:
    """(resource, key, op, value) as edits compose: the first op of each key stays and all values add up."""
    return edits.groupBy("resource", "key").agg(F.min_by("op", "clock").alias("op"), F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))


def record_diff(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Edits (resource, key, op, value) that turn old records (resource, key, value) to new ones; with ``replace``, missing keys are deleted."""
    joined = old.withColumnRenamed("value", "was").withColumn("had", F.lit(True)).join(new.withColumn("has", F.lit(True)), ["resource", "key"], "full")
    changed = joined.filter(F.col("has") & ~(F.coalesce("had", F.lit(False)) & F.col("was").eqNullSafe(F.col("value")))).select("resource", "key", F.lit("set").alias("op"), "value")
    if not replace:
        return changed
    dropped = joined.filter("has is null").select("resource", "key", F.lit("del").alias("op"), F.lit(None).cast(new.schema["value"].dataType).alias("value"))
    return changed.unionByName(dropped)


def sequence_status(events: DataFrame, client: str = "client", seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """Adds ``status``: ok, duplicate (not above what came before) or gap (skips numbers)."""
    w = Window.partitionBy(client).orderBy(arrival)
    before = F.coalesce(F.max(seq).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return events.withColumn("status", F.when(F.col(seq) <= before, "duplicate").when(F.col(seq) > before + 1, "gap").otherwise("ok"))


def splice(text: Column, edits: Column) -> Column:
    """A text after one edit: array<struct<op, n, data>> of ``retain`` and ``delete`` n characters, ``insert`` and ``set`` data."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, e: Column) -> Column:
        here = F.substring(text, acc["at"], e["n"])
        out = F.concat(acc["out"], F.when(e["op"] == "retain", here).when(e["op"].isin("insert", "set"), e["data"]).otherwise(""))
        return F.struct(out.alias("out"), (acc["at"] + F.when(e["op"] == "insert", 0).otherwise(e["n"])).alias("at"))

    return F.aggregate(edits, start, step, lambda acc: acc["out"])


def edit_lengths(edits: Column) -> Column:
    """(before, after): lengths of the text that an edit takes and gives."""
    total = lambda *ops: F.aggregate(F.filter(edits, lambda e: e["op"].isin(*ops)), F.lit(0), lambda s, e: s + e["n"])
    return F.struct(total("retain", "delete", "set").alias("before"), total("retain", "insert", "set").alias("after"))


def inserted_at_start(text: Column, data: Column) -> Column:
    """The edit that puts ``data`` before a text."""
    return F.array(_step("insert", F.char_length(data), data), _step("retain", F.char_length(text), F.lit("")))


def inserted_at_end(text: Column, data: Column) -> Column:
    """The edit that puts ``data`` behind a text."""
    return F.array(_step("retain", F.char_length(text), F.lit("")), _step("insert", F.char_length(data), data))


def _step(op: str, n: Column, data: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), n.cast("int").alias("n"), data.alias("data"))


#: Characters of a changed stretch up to which it is compared character by character.
DIFF_CHARS = 1_000


def text_steps(old: str, new: str) -> list[tuple[str, int, str]]:
    """Steps (op, n, data) from one text to another: what both begin and end with stays; a short stretch between is
    compared by its longest common runs, a long one is put in place of the other."""
    head = 0
    for a, b in zip(old, new):
        if a != b:
            break
        head += 1
    tail = 0
    for a, b in zip(reversed(old[head:]), reversed(new[head:])):
        if a != b:
            break
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    blocks = [("replace", 0, len(a), 0, len(b))]
    if len(a) <= DIFF_CHARS and len(b) <= DIFF_CHARS:
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    out = [("retain", head, "")]
    for tag, i, j, k, m in blocks:
        if tag == "equal":
            out.append(("retain", j - i, ""))
        else:
            out += [("delete", j - i, ""), ("insert", m - k, b[k:m])]
    return [s for s in [*out, ("retain", tail, "")] if s[1]]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.StringType())])))
def _text_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [{"op": o, "n": n, "data": d} for o, n, d in text_steps(a, b)] for a, b in zip(old, new)])


def text_diff(old: Column, new: Column) -> Column:
    """The edit that makes one text the other, for :func:`splice`; null if either is."""
    return _text_diff(old, new)


def list_diff(old: Column, new: Column) -> Column:
    """The edit that makes one list the other, place by place: runs of equal elements are retained, others set, and the
    rest of the longer list is inserted or deleted. A null old list is empty; equal lists give no steps; data are lists.
    """
    old = F.coalesce(old, F.slice(new, 1, 0))
    m = F.least(F.size(old), F.size(new))
    met = F.zip_with(F.slice(old, F.lit(1), m), F.slice(new, F.lit(1), m), lambda a, b: F.struct(a.eqNullSafe(b).alias("same"), b.alias("v")))
    before = F.concat(F.array(F.lit(False)), F.transform(F.slice(met, F.lit(1), F.greatest(m - 1, F.lit(0))), lambda s: s["same"]))
    runs = F.filter(F.transform(F.zip_with(met, F.slice(before, F.lit(1), m), lambda s, p: F.struct(s["same"], s["v"], (s["same"] & p).alias("joined"))), lambda s, i: F.struct(s["same"], s["v"], s["joined"], i.alias("at"))), lambda s: ~s["joined"])
    ends = F.concat(F.slice(F.transform(runs, lambda s: s["at"]), F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(m))
    none = F.slice(new, 1, 0)
    steps = F.zip_with(F.slice(runs, F.lit(1), F.size(runs)), F.slice(ends, F.lit(1), F.size(runs)), lambda s, e: _list_step(F.when(s["same"], "retain").otherwise("set"), e - s["at"], F.when(s["same"], none).otherwise(F.array(s["v"]))))
    more, less = F.size(new) - m, F.size(old) - m
    tail = F.filter(F.array(_list_step(F.lit("insert"), more, F.slice(new, m + 1, more)), _list_step(F.lit("delete"), less, none)), lambda s: s["n"] > 0)
    return F.when(old.eqNullSafe(new), F.slice(tail, 1, 0)).otherwise(F.concat(steps, tail))


def _list_step(op: Column, n: Column, data: Column) -> Column:
    return F.struct(op.alias("op"), n.cast("int").alias("n"), data.alias("data"))


def splice_list(values: Column, edits: Column) -> Column:
    """A list after one edit of lists; an edit without steps changes nothing."""
    start = F.struct(F.slice(values, 1, 0).alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, e: Column) -> Column:
        here = F.slice(values, acc["at"], e["n"])
        out = F.concat(acc["out"], F.when(e["op"] == "retain", here).when(e["op"].isin("insert", "set"), e["data"]).otherwise(F.slice(here, 1, 0)))
        return F.struct(out.alias("out"), (acc["at"] + F.when(e["op"] == "insert", 0).otherwise(e["n"])).alias("at"))

    return F.when(F.size(edits) == 0, values).otherwise(F.aggregate(edits, start, step, lambda acc: acc["out"]))


def collected(state: DataFrame, live: DataFrame) -> DataFrame:
    """State (resource, key, value) without keys that their resource's registry (resource, key) doesn't name; a resource without a registry keeps all."""
    known = live.select("resource").distinct().withColumn("_known", F.lit(True))
    named = live.select("resource", "key").distinct().withColumn("_named", F.lit(True))
    met = state.join(known, "resource", "left").join(named, ["resource", "key"], "left")
    return met.filter("_known is null or _named is not null").select(state.columns)


def validated_log(log: DataFrame, state: DataFrame) -> DataFrame:
    """The log (resource, clock, key, op, value) with ``rebuilt``: a resource's rows stay if their clocks follow on each other
    without gaps or repeats and all ops are known; otherwise its state (resource, key, value) stands in their place, as sets at its last clock."""
    bad = F.max((~F.coalesce(F.col("op").isin("set", "del"), F.lit(False))).cast("int"))
    ends = log.groupBy("resource").agg(F.count("*").alias("n"), F.countDistinct("clock").alias("d"), F.min("clock").alias("low"), F.max("clock").alias("high"), bad.alias("bad"))
    ends = ends.select("resource", "high", ((F.col("bad") == 0) & (F.col("n") == F.col("d")) & (F.col("high") - F.col("low") + 1 == F.col("n"))).alias("good"))
    kept = log.join(ends.filter("good").select("resource"), "resource", "left_semi").select("resource", "clock", "key", "op", "value", F.lit(False).alias("rebuilt"))
    made = state.join(ends.filter("not good"), "resource").select("resource", F.col("high").alias("clock"), "key", F.lit("set").alias("op"), "value", F.lit(True).alias("rebuilt"))
    return kept.unionByName(made)


def compacted(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """A stream of edits and registry rows, kept as one entry a key: (resource, client, seq, clock, status, key, value).

    Rows (resource, kind, client, seq, key, op, value, ts): ``edit`` rows are taken as :func:`ingest` does; ``gone`` rows say that a
    key's name has left the registry. Instead of a log, a resource's state holds its clock, the last value and clock of each live key, and each client's last
    number and moment. A key that goes is ``collected``; a client not heard of for ``idle`` of event time is forgotten (it starts anew from
    0); a resource quiet for so long gives its keys out as ``kept`` and its state goes. So state grows with live keys and recent clients, not with edits.
    """
    schema = "resource string, client string, seq long, clock long, status string, key string, value double"
    span = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, clients, keys = state.get if state.exists else (0, [], [])
        seen = {c: (n, at) for c, n, at in clients}
        held = {k: (v, at) for k, v, at in keys}
        out = []
        if state.hasTimedOut:
            out = [(key[0], None, None, at, "kept", k, v) for k, (v, at) in held.items()]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["kind", "client", "seq"], kind="stable")
            rows["at"] = rows["ts"].astype("int64") // (1000 if rows["ts"].dtype == "datetime64[us]" else 1_000_000)
            latest = int(max(rows["at"].max(), state.getCurrentWatermarkMs()))
            seen = {c: (n, at) for c, (n, at) in seen.items() if at + span >= latest}
            for kind, client, seq, k, op, value, at in zip(*(rows[c] for c in ("kind", "client", "seq", "key", "op", "value", "at"))):
                if kind == "gone":
                    if k in held:
                        out.append((key[0], None, None, held.pop(k)[1], "collected", k, None))
                    continue
                last = seen.get(client, (-1, 0))[0]
                if seq == last + 1:
                    clock += 1
                    seen[client] = (int(seq), int(at))
                    held.pop(k, None)
                    if op == "set":
                        held[k] = (float(value), clock)
                    out.append((key[0], client, seq, clock, "ok", k, value))
                else:
                    if seq > last:
                        seen.pop(client, None)
                    out.append((key[0], client, seq, None, "duplicate" if seq <= last else "gap", k, value))
            state.update((clock, [(c, n, at) for c, (n, at) in seen.items()], [(k, v, at) for k, (v, at) in held.items()]))
            state.setTimeoutTimestamp(latest + span)
        yield pd.DataFrame(out, columns=["resource", "client", "seq", "clock", "status", "key", "value"]).astype({"seq": "Int64", "clock": "Int64"})

    form = "clock long, clients array<struct<client:string,seq:long,at:long>>, keys array<struct<key:string,value:double,clock:long>>"
    return events.withWatermark("ts", idle).groupBy("resource").applyInPandasWithState(run, schema, form, "append", GroupStateTimeout.EventTimeTimeout)


def ingest(events: DataFrame) -> DataFrame:
    """A stream (resource, client, seq, key, value) as accepted edits with clocks and rejects: (resource, client, seq, clock, status, key, value).

    Per resource the state holds the clock and each client's last number: the next number is
    ``ok`` and gets the next clock, an old one is ``duplicate``, a later one a ``gap`` that
    makes the client start anew from 0. Events of one batch are taken in order of client and number.
    """
    schema = "resource string, client string, seq long, clock long, status string, key string, value double"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, clients, numbers = state.get if state.exists else (0, [], [])
        seen = dict(zip(clients, numbers))
        rows = pd.concat(list(batches)).sort_values(["client", "seq"], kind="stable")
        out = []
        for client, seq, k, value in zip(rows["client"], rows["seq"], rows["key"], rows["value"]):
            last = seen.get(client, -1)
            if seq == last + 1:
                clock += 1
                seen[client] = seq
                out.append((key[0], client, seq, clock, "ok", k, value))
            else:
                if seq > last:
                    seen.pop(client, None)
                out.append((key[0], client, seq, None, "duplicate" if seq <= last else "gap", k, value))
        state.update((clock, list(seen), [int(n) for n in seen.values()]))
        yield pd.DataFrame(out, columns=["resource", "client", "seq", "clock", "status", "key", "value"]).astype({"clock": "Int64"})

    return events.groupBy("resource").applyInPandasWithState(run, schema, "clock long, clients array<string>, numbers array<long>", "append", GroupStateTimeout.NoTimeout)
