"""Versions of stored data, vectors by content, the ledger of calls, ordered scans."""

import functools
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import SMALL, Settings
from lectern.operators import answer, chunking, ordered, retrieve
from lectern.plans import store, storage
from lectern.plans.ledger import Ledger
from lectern.plans.snapshots import Snapshots
from lectern.plans.vector_table import VectorTable
from lectern.providers import HashingEmbedder
from tests.test_engine import asks, documents, index


def part_of(made, cond):
    return retrieve.Index(*(getattr(made, p).where(cond) for p in store.PARTS), made.stop_words)


def kbs(frame):
    return {r[0] for r in frame.select("kb_id").distinct().collect()}


# versions


def test_a_number_is_published_once(spark, tmp_path):
    at = Snapshots(spark, f"file://{tmp_path}/x")
    assert at.latest() == (0, {}) and at.publish(1, {"a": 1}) and not at.publish(1, {"a": 2}) and at.latest() == (1, {"a": 1})
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if at.publish(2, {"by": k}) else None) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert at.latest()[0] == 2 and at.latest()[1]["by"] in won and not [n for n in at.names("manifests") if n.startswith("_")]


def test_an_interrupted_save_leaves_the_old_index(spark, tmp_path, monkeypatch):
    path, made = f"file://{tmp_path}/index", index(spark)
    store.save(part_of(made, "kb_id IN ('d0', 'd1')"), path, SMALL, slots=2)
    old = store.load(spark, path, SMALL)
    write, calls = store._write, []

    def breaks(rows, target, slots, writers):
        calls.append(target)
        if len(calls) == 2:  # after the chunks
            raise RuntimeError("killed")
        write(rows, target, slots, writers)

    monkeypatch.setattr(store, "_write", breaks)
    with pytest.raises(RuntimeError, match="killed"):
        store.save(made, path, SMALL)
    monkeypatch.undo()
    now = store.load(spark, path, SMALL)
    assert [kbs(getattr(now, p)) for p in store.PARTS] == [{"d0", "d1"}] * 3 == [kbs(getattr(old, p)) for p in store.PARTS]
    store.save(made, path, SMALL)
    assert kbs(store.load(spark, path, SMALL).postings) == {"d0", "d1", "d2", "d3"}


def test_two_writers_lose_no_collection(spark, tmp_path, monkeypatch):
    """The second writer publishes while the first has written, but not published."""
    path, made = f"file://{tmp_path}/index", index(spark)
    for slots, root in ((1, "one"), (64, "many")):
        where, publish, once = f"{path}-{root}", Snapshots.publish, []

        def late(self, number, content, where=where, once=once, publish=publish):
            if not once:
                once.append(1)
                store.save(part_of(made, "kb_id IN ('d1', 'd2')"), where, SMALL, slots=slots)
            return publish(self, number, content)

        store.save(part_of(made, "kb_id = 'd0'"), where, SMALL, slots=slots)
        monkeypatch.setattr(Snapshots, "publish", late)
        store.save(part_of(made, "kb_id = 'd3'"), where, SMALL)
        monkeypatch.undo()
        back = store.load(spark, where, SMALL)
        assert [kbs(getattr(back, p)) for p in store.PARTS] == [{"d0", "d1", "d2", "d3"}] * 3
        assert back.postings.count() == made.postings.count() and back.chunks.count() == made.chunks.count()


def test_readers_keep_their_version_until_it_expires(spark, tmp_path):
    path, made = f"file://{tmp_path}/index", index(spark)
    store.save(made, path, SMALL, slots=2)
    reader = store.load(spark, path, SMALL)
    for _ in range(2):
        store.save(part_of(made, "kb_id = 'd1'"), path, SMALL)
    assert kbs(reader.chunks) == {"d0", "d1", "d2", "d3"}
    assert store.expire(spark, path, SMALL, keep=1) == []  # too young
    gone = store.expire(spark, path, SMALL, keep=1, older_than_s=-5)
    assert gone and kbs(store.load(spark, path, SMALL).vocab) == {"d0", "d1", "d2", "d3"}
    assert store.versions(spark, path, SMALL).numbers() == [3]


def test_empty_saves_and_empty_parts(spark, tmp_path):
    path, made = f"file://{tmp_path}/index", index(spark)
    store.save(part_of(made, "false"), path, SMALL)
    assert store.load(spark, path, SMALL) is None
    bare = retrieve.Index(made.chunks.where("kb_id = 'd0'"), made.vocab.where("false"), made.postings.where("false"), made.stop_words)
    store.save(bare, path, SMALL)
    back = store.load(spark, path, SMALL)
    assert back.chunks.count() > 0 and back.vocab.count() == 0 == store.load(spark, path, SMALL, ["d9"]).chunks.count()


# vectors by content


class Counting(HashingEmbedder):
    """Leaves a file for each text that it encodes."""

    def __init__(self, folder):
        super().__init__(64)
        self.folder = folder

    def encode(self, texts):
        for t in texts:
            with open(f"{self.folder}/{len(os.listdir(self.folder))}-{os.getpid()}-{random.random()}", "w") as f:
                f.write(t)
        return super().encode(texts)


def test_texts_are_encoded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    table = VectorTable(spark, f"file://{tmp_path}/vectors", "counting", functools.partial(Counting, str(calls)))
    seen = lambda: sorted(f.read_text() for f in calls.iterdir())
    chunks = storage.materialize(chunking.chunks(documents(spark), SMALL), "chunks")
    made = retrieve.build_index(chunks, SMALL, table=table)
    texts = {r[0] for r in chunks.select("embed_text").collect()}
    assert seen() == sorted(texts)
    made.chunks.count()
    plain = {(r.kb_id, r.chunk_idx): r.embedding for r in retrieve.build_index(chunks, SMALL).chunks.collect()}
    assert {(r.kb_id, r.chunk_idx): r.embedding for r in made.chunks.collect()} == plain
    retrieve.build_index(chunks, SMALL, table=table).chunks.count()
    assert len(seen()) == len(texts)
    found = retrieve.rerank(retrieve.hybrid(made, asks(spark), SMALL, table=table), SMALL)
    first = answer.answers(found, SMALL, table=table)
    n = len(seen())
    have = sorted(map(str, first.collect()))
    assert len(set(seen())) == len(seen()) == n and sorted(map(str, first.collect())) == have  # sentences too, and no action encodes
    assert sorted(map(str, answer.answers(retrieve.rerank(retrieve.hybrid(made, asks(spark), SMALL, table=table), SMALL), SMALL, table=table).collect())) == have and len(seen()) == n
    assert have == sorted(map(str, answer.answers(retrieve.rerank(retrieve.hybrid(made, asks(spark), SMALL), SMALL), SMALL).collect()))


def test_vector_tables_are_kept_small(spark, tmp_path, monkeypatch):
    from lectern.plans import vector_table

    monkeypatch.setattr(vector_table, "MOST_FOLDERS", 2)
    table = VectorTable(spark, f"file://{tmp_path}/v", "hashing", HashingEmbedder)
    for k in range(4):
        assert table.learn(spark.createDataFrame([(f"text {k}",), ("again",), (None,), ("",)], "text string")) == (3 if k == 0 else 1)
    assert len(table.at.latest()[1]["folders"]) <= 2 and table.vectors().count() == 6


# the ledger


class Paid:
    """Answers a prompt, and leaves a file for each call; the first task that meets a prompt with 'kill' dies before it calls."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, prompts):
        out = []
        for p in prompts:
            if "kill" in p and not os.path.exists(f"{self.folder}/killed"):
                open(f"{self.folder}/killed", "w").close()
                os._exit(1)
            with open(f"{self.folder}/call-{os.getpid()}-{random.random()}", "w") as f:
                f.write(p)
            out.append("" if "fails" in p else f"answer to {p}")
        return out


def calls_in(folder):
    return sorted(f.read_text() for f in folder.iterdir() if f.name.startswith("call-"))


@pytest.mark.parametrize(("in_flight", "per_task"), [(1, 2), (4, 3), (64, 8)])
def test_prompts_are_paid_once(spark, tmp_path, in_flight, per_task):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "paid", functools.partial(Paid, str(calls)), in_flight, per_task)
    rows = spark.createDataFrame([(k, f"prompt {k % 11}") for k in range(40)] + [(90, None)], "n long, p string")
    got = ledger.answered(rows, "p", "a")
    want = {k: f"answer to prompt {k % 11}" for k in range(40)} | {90: ""}
    for _ in range(2):  # two actions
        assert {r.n: r.a for r in got.collect()} == want
    assert calls_in(calls) == sorted(f"prompt {k}" for k in range(11))
    more = rows.unionByName(spark.createDataFrame([(91, "prompt new"), (92, "fails")], "n long, p string"))
    again = Ledger(spark, f"file://{tmp_path}/ledger", "paid", functools.partial(Paid, str(calls)))
    assert again.ask(more.select(F.col("p").alias("prompt"))) == 2 and len(calls_in(calls)) == 13
    assert again.ask(more.select(F.col("p").alias("prompt"))) == 1  # the failed one
    keeps = Ledger(spark, f"file://{tmp_path}/ledger", "paid", functools.partial(Paid, str(calls)), retry_failed=False)
    assert keeps.ask(more.select(F.col("p").alias("prompt"))) == 0 and Ledger(spark, f"file://{tmp_path}/ledger", "other", None).answers().count() == 0


@pytest.mark.parametrize(("per_task", "extra"), [(1, 0), (3, 2)])
def test_a_killed_worker_costs_its_own_task_alone(spark, tmp_path, per_task, extra):
    """Here, on one machine, a dead worker ends the job; what rounds before it have published isn't asked again."""
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "paid", functools.partial(Paid, str(calls)), 1, per_task)
    prompts = spark.createDataFrame([(f"prompt {k}" + " kill" * (k == 5),) for k in range(12)], "prompt string")
    with pytest.raises(Exception, match="(?s)crash|exited|aborted|EOF"):
        ledger.ask(prompts)
    ledger.ask(prompts)
    paid = calls_in(calls)
    assert len(set(paid)) == 12 <= len(paid) <= 12 + extra and ledger.answers().count() == 12


def test_bad_ledgers_are_refused(spark):
    with pytest.raises(ValueError, match="positive"):
        Ledger(spark, "file:///nowhere", "m", None, in_flight=0)


def test_generated_answers_are_not_made_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    made, cfg = index(spark), Settings(chunk_size=100, overlap=10, mode="local")
    got = answer.answers(retrieve.rerank(retrieve.hybrid(made, asks(spark), cfg), cfg), cfg, generator=functools.partial(Paid, str(calls)))
    first = sorted(map(str, got.collect()))
    assert sorted(map(str, got.collect())) == first and len(calls_in(calls)) == len(set(calls_in(calls))) == 4


# ordered scans


def ordered_rows(rng, n=900):
    keys = [None, "a", "b", "c"] + [f"k{i}" for i in range(20)]
    return [(rng.choice(keys) if rng.random() < 0.5 else "hot", k, rng.choice([None, rng.randint(0, 9)])) for k in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16, None])
def test_running_and_last_values(spark, partitions):
    rows = ordered_rows(random.Random(partitions or 0))
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "key string, at long, v int").repartition(5)
    total, number, last = {}, {}, {}
    want = {}
    for n, (key, at, v) in enumerate(rows):
        last[key] = v if v is not None else last.get(key)
        want[at] = (total.get(key, 0), number.get(key, 0), last[key], n)
        total[key], number[key] = total.get(key, 0) + (v or 0), number.get(key, 0) + 1
    got = {r.at: r.s for r in ordered.running(df, ["key"], ["at"], F.col("v"), "s", partitions).collect()}
    assert got == {at: w[0] for at, w in want.items()}
    got = {r.at: r.position for r in ordered.running(df, ["key"], ["at"], partitions=partitions).collect()}
    assert got == {at: w[1] for at, w in want.items()}
    got = {r.at: r.position for r in ordered.running(df, [], ["at"], partitions=partitions).collect()}
    assert got == {at: w[3] for at, w in want.items()}
    got = {r.at: r.filled for r in ordered.last_value(df, ["key"], ["at"], "v", "filled", partitions).collect()}
    assert got == {at: w[2] for at, w in want.items()}
    assert ordered.running(df.limit(0), ["key"], ["at"]).count() == 0 == ordered.last_value(df.limit(0), ["key"], ["at"], "v", "f").count()


def test_a_hot_key_lies_in_many_partitions(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("at"))
    done = ordered._worked(rows.withColumn("_value", F.lit(1).cast("long")), ["key"], ["at"], 16, ordered._running, T.LongType())
    spread = done.groupBy("_part").count().collect()
    assert len(spread) == 16 and max(r["count"] for r in spread) < 2 * 20_000 / 16
    assert done.where("key = 0").select("_part").distinct().count() >= 8


def test_written_partitions_may_be_read_in_pieces(spark, monkeypatch):
    """Files that are cut and dealt anew when they are read change nothing."""
    rows = ordered_rows(random.Random(12), 4000)
    df = spark.createDataFrame(rows, "key string, at long, v int")
    write = storage.materialize
    monkeypatch.setattr(ordered, "materialize", lambda frame, tag: write(write(frame, tag).repartition(13), tag))
    got = {r.at: r.s for r in ordered.running(df, ["key"], ["at"], F.col("v"), "s", 7).collect()}
    filled = {r.at: r.f for r in ordered.last_value(df, ["key"], ["at"], "v", "f", 7).collect()}
    total, last = {}, {}
    for key, at, v in rows:
        last[key] = v if v is not None else last.get(key)
        assert got[at] == total.get(key, 0) and filled[at] == last[key]
        total[key] = total.get(key, 0) + (v or 0)


def test_saves_move_collections_not_terms(spark, tmp_path):
    """A stored row is a collection's vocabulary and postings; what is read back is the same by rows of terms."""
    made = index(spark)
    plain = retrieve.Index(made.chunks, made.vocab, made.postings, made.stop_words)
    rows = lambda frame: sorted(map(str, frame.collect()))
    for name, first, second in (("runs", made, made), ("mixed", plain, made)):
        path = f"file://{tmp_path}/{name}"
        store.save(first.where("kb_id <> 'd0'"), path, SMALL, slots=2)
        store.save(second.where("kb_id <> 'd1'"), path, SMALL)
        back = store.load(spark, path, SMALL)
        assert rows(back.postings) == rows(made.postings) and rows(back.vocab) == rows(made.vocab)
        assert name == "mixed" or back.runs.count() == 4 < back.postings.count() / 10
    newest = store.versions(spark, path, SMALL).latest()[1]
    assert set(newest["schemas"]) == {"chunks", "runs"}


def test_vocabularies_are_exported_by_runs(spark):
    """The export of an index's runs is that of its terms; no term is grouped as a row of its own."""
    made = index(spark)
    flat, runs = store.vocabulary_json(made.vocab), store.vocabulary_json(made)
    assert sorted(map(str, runs.collect())) == sorted(map(str, flat.collect())) and runs.count() == 4
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan(flat) and "Generate" not in plan(runs)
