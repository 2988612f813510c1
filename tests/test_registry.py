"""The registry as a batch and as a stream, against a fold over its events."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import registry
from lectern.streaming.registry import RegistryStream

SCHEMA = "workspace string, seq long, op string, source_name string, kb_id string, chunk_count int, text_hash string"


def events_of(seed, n, workspaces=("u", "v")):
    rng = random.Random(seed)
    out = []
    for seq in rng.sample(range(1000), n):
        op = rng.choice(("upsert", "upsert", "delete", "delete", "select"))
        out.append((rng.choice(workspaces), seq, op, f"s{rng.randint(0, 6)}", f"k{seq}" if op == "upsert" else None, seq % 5 + 2, f"h{seq}"))
    return out


def fold(events):
    """{workspace: (documents in order as (name, kb_id), active place, messages that are left as (name, seq))}; each event but a delete is answered by a message."""
    state = {}
    for w, seq, op, name, kb, _, _ in sorted(events, key=lambda e: e[1]):
        docs, act = state.setdefault(w, ([], [0]))
        at = next((i for i, d in enumerate(docs) if d[0] == name), None)
        if op == "upsert":
            if at is None:
                docs.append(None)
                at = len(docs) - 1
            docs[at] = (name, kb, [])
            act[0] = at
        elif op == "delete" and at is not None:
            docs.pop(at)
            if act[0] >= len(docs):
                act[0] = max(0, len(docs) - 1)
        elif op == "select" and at is not None:
            act[0] = at
        if docs:
            docs[act[0]][2].append(seq * 10 + 1)
    return {w: ([d[:2] for d in docs], act[0], {(d[0], m) for d in docs for m in d[2]}) for w, (docs, act) in state.items()}


def seen(current, active):
    out = {}
    for r in current.orderBy("position").collect():
        out.setdefault(r.workspace, []).append((r.source_name, r.kb_id))
    places = {r.workspace: (r.position, r.source_name, r.kb_id) for r in active.collect()}
    for w, (place, name, kb) in places.items():
        assert out[w][place] == (name, kb)
    return {w: (docs, places[w][0]) for w, docs in out.items()}


def wanted(events):
    return {w: (docs, place) for w, (docs, place, _) in fold(events).items() if docs}


@pytest.mark.parametrize("seed", range(6))
def test_batch_registry_equals_the_fold(spark, seed):
    events = events_of(seed, 10 + 25 * seed)
    df = spark.createDataFrame(events, SCHEMA)
    assert seen(registry.current(df, ["workspace"]), registry.active(df, ["workspace"])) == wanted(events)
    # messages: one row for each that the fold ever handed out
    given, past = {}, []
    for e in sorted(events, key=lambda e: e[1]):
        past.append(e)
        for w, (_, _, messages) in fold(past).items():
            given.update({(w, name, m): None for name, m in messages})
    rows = spark.createDataFrame(list(given), "workspace string, source_name string, seq_10 long").select("workspace", "source_name", (F.col("seq_10") / 10).alias("seq"), "seq_10")
    left = {(r.workspace, r.source_name, r.seq_10) for r in registry.live_messages(df, rows, ["workspace"]).collect()}
    assert left == {(w, name, m) for w, (_, _, messages) in fold(events).items() for name, m in messages}


def test_one_workspace_and_none(spark):
    events = events_of(9, 40, ("only",))
    df = spark.createDataFrame(events, SCHEMA).drop("workspace")
    docs, place, _ = fold(events)["only"]
    assert [(r.source_name, r.kb_id) for r in registry.current(df).orderBy("position").collect()] == docs
    assert [(r.position, r.kb_id) for r in registry.active(df, []).collect()] == ([(place, docs[place][1])] if docs else [])
    assert registry.current(df.limit(0)).count() == 0 == registry.active(df.limit(0), []).count() == registry.active(df.limit(0).withColumn("w", F.lit("x")), ["w"]).count()


@pytest.mark.parametrize("cuts", [(), (500,), (100, 101, 300, 700, 990)])
def test_stream_registry_equals_the_batch(spark, tmp_path, cuts):
    events = events_of(21, 70)
    source, state, mark = (f"file://{tmp_path}/{x}" for x in ("in", "state", "mark"))
    registry_at = RegistryStream(spark, state, ["workspace"])
    assert registry_at.current().count() == 0 == registry_at.active().count()
    edges = [0, *cuts, 1000]
    done = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = [e for e in events if a <= e[1] < b]
        done += part
        if not part:
            continue
        random.Random(a).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # a new object each time: all that counts is in the checkpoint and the state
        query = RegistryStream(spark, state, ["workspace"])
        query.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), mark).awaitTermination()
        assert seen(registry_at.current(), registry_at.active()) == wanted(done)
    number = registry_at.at.latest()[0]
    registry_at.merge(spark.createDataFrame(events[:9], SCHEMA), 0)  # a batch that came before comes again
    assert registry_at.at.latest()[0] == number and seen(registry_at.current(), registry_at.active()) == wanted(events)


def test_batches_out_of_order_give_the_same_documents(spark, tmp_path):
    events = events_of(33, 60)
    at = RegistryStream(spark, f"file://{tmp_path}/state", ["workspace"])
    for k, a in enumerate((40, 0, 20)):
        at.merge(spark.createDataFrame(sorted(events, key=lambda e: e[1])[a : a + 20], SCHEMA), k)
    got = {}
    for r in at.current().orderBy("position").collect():
        got.setdefault(r.workspace, []).append((r.source_name, r.kb_id))
    assert got == {w: docs for w, (docs, _) in wanted(events).items()}


def test_a_stream_without_workspaces(spark, tmp_path):
    events = events_of(5, 30, ("only",))
    at = RegistryStream(spark, f"file://{tmp_path}/state")
    ordered = sorted(events, key=lambda e: e[1])
    for k in range(3):
        at.merge(spark.createDataFrame(ordered[10 * k : 10 * k + 10], SCHEMA).drop("workspace"), k)
    docs, place, _ = fold(events)["only"]
    assert [(r.source_name, r.kb_id) for r in at.current().orderBy("position").collect()] == docs
    assert [r.position for r in at.active().collect()] == ([place] if docs else [])
