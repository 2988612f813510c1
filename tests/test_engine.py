"""Registry, store, streaming, rerankers and generators."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.config import SMALL, Settings
from lectern.operators import answer, chunking, registry, retrieve, tfidf, vectors
from lectern.plans import storage, store
from lectern.providers import CrossEncoderReranker, FunctionGenerator, HostedGenerator, LocalGenerator
from lectern.streaming import ingest


def documents(spark, n=4):
    text = lambda k: "\n".join(f"Document {k} says that reactor number {k} reached criticality after {j} hours of operation." for j in range(40))
    return spark.createDataFrame([(f"d{k}", text(k)) for k in range(n)], "kb_id string, text string")


def asks(spark):
    return spark.createDataFrame([(k, f"d{k}", f"when did reactor number {k} reach criticality") for k in range(4)], "q_id long, kb_id string, question string")


def index(spark):
    return retrieve.build_index(chunking.chunks(documents(spark), SMALL), SMALL)


def test_answers_and_modes(spark):
    found = retrieve.rerank(retrieve.hybrid(index(spark), asks(spark), SMALL), SMALL)
    plain = answer.answers(found, SMALL).collect()
    assert len(plain) == 4 and all("criticality" in r.answer_text for r in plain)
    hosted = Settings(chunk_size=100, overlap=10, mode="hosted")
    made = answer.answers(found, hosted, generator=lambda: FunctionGenerator(lambda p: "The reactor reached criticality after some hours.")).collect()
    assert {r.answer_text for r in made} == {"The reactor reached criticality after some hours."}
    failed = answer.answers(found, hosted, generator=lambda: FunctionGenerator(lambda p: 1 / 0)).collect()
    assert sorted(r.answer_text for r in failed) == sorted(r.answer_text for r in plain)


def test_reranker_keeps_scores(spark):
    class Last:
        def score(self, questions, chunks):
            return [float(len(c)) * -1 for c in chunks]

    candidates = retrieve.hybrid(index(spark), asks(spark), SMALL)
    again = retrieve.rerank(candidates, SMALL, Last).where("q_id = 1").orderBy("rank").collect()
    assert [len(r.chunk) for r in again] == sorted(len(r.chunk) for r in again)
    scores = {(r.kb_id, r.chunk_idx): r.score for r in candidates.collect()}
    assert all(scores[r.kb_id, r.chunk_idx] == r.score for r in again)


def test_registry_places(spark):
    events = spark.createDataFrame(
        [(1, "upsert", "a", "k1", 3, "h1"), (2, "upsert", "b", "k2", 3, "h2"), (3, "upsert", "a", "k3", 4, "h3"), (4, "delete", "b", None, None, None), (5, "upsert", "c", "k4", 2, "h4"), (6, "upsert", "b", "k5", 2, "h5")],
        "seq long, op string, source_name string, kb_id string, chunk_count int, text_hash string",
    )
    now = registry.current(events)
    assert [(r.source_name, r.kb_id) for r in now.orderBy("position").collect()] == [("a", "k3"), ("c", "k4"), ("b", "k5")]
    more = registry.upsert(events, spark.createDataFrame([(7, "d", "k6", 2, "h")], "seq long, source_name string, kb_id string, chunk_count int, text_hash string"))
    assert registry.current(more).count() == 4
    rest, active = registry.delete_at(now, 0, 2)
    assert active == 1 and [r.source_name for r in rest.orderBy("position").collect()] == ["c", "b"]
    assert registry.delete_at(now, 9, 2) == (now, 2)
    assert registry.active_document(now, 7).count() == 0


def test_store_reads_only_its_settings(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert store.load(spark, path, SMALL) is None
    made = index(spark)
    store.save(made, path, SMALL)
    store.save(retrieve.Index(*(getattr(made, p).where("kb_id = 'd1'") for p in store.PARTS)), path, SMALL)
    back = store.load(spark, path, SMALL, ["d1", "d2"])
    assert {r.kb_id for r in back.chunks.select("kb_id").collect()} == {"d1", "d2"}
    assert store.load(spark, path, SMALL).chunks.count() == made.chunks.count()
    assert store.load(spark, path, Settings(chunk_size=90, overlap=10)) is None
    assert store.missing(documents(spark, 6), store.load(spark, path, SMALL)).count() == 2
    want = {(r.kb_id, r.term): r.idf for r in made.vocab.collect()}
    assert all(abs(want[r.kb_id, r.term] - r.idf) < 1e-6 for r in back.vocab.collect())
    assert '"term"' in store.vocabulary_json(back.vocab).first().json


def test_store_keeps_its_slots(spark, tmp_path):
    path, made = f"file://{tmp_path}/index", index(spark)
    store.save(made, path, SMALL, slots=3, writers=2)
    store.save(retrieve.Index(*(getattr(made, p).where("kb_id = 'd2'") for p in store.PARTS)), path, SMALL)
    assert store.load(spark, path, SMALL, ["d2", "d3"]).chunks.select("kb_id").distinct().count() == 2
    assert store.load(spark, path, SMALL).postings.count() == made.postings.count()
    assert store.load(spark, path, SMALL, model="other") is None and store.load(spark, path, SMALL, stop_words=("a",)) is None


def test_collections_of_one_chunk_are_not_indexed(spark):
    docs = documents(spark, 1).unionByName(spark.createDataFrame([("one", "a single short paragraph about reactors")], "kb_id string, text string"))
    docs = docs.unionByName(spark.createDataFrame([("null", None), ("empty", ""), ("short", "too short"), (None, "x")], "kb_id string, text string")).unionByName(documents(spark, 2).where("kb_id = 'd1'")).unionByName(documents(spark, 2).where("kb_id = 'd1'"))
    made = retrieve.build_index(chunking.chunks(docs, SMALL), SMALL)
    assert {r.kb_id for r in made.chunks.select("kb_id").distinct().collect()} == {"d0"} == {r.kb_id for r in made.vocab.select("kb_id").distinct().collect()}
    told = {(r.kb_id, r.n_chunks > 1, r.err) for r in chunking.indexable(docs, chunking.chunks(docs, SMALL), SMALL).collect()}
    short = "Not enough text to index. Try a longer document."
    assert told == {("d0", True, ""), ("one", False, short), ("null", False, short), ("empty", False, short), ("short", False, short), (None, False, short), ("d1", True, "The collection's id is given more than once.")}
    assert chunking.indexable(docs.limit(0), chunking.chunks(docs.limit(0), SMALL), SMALL).count() == 0


def hybrid_plain(chunks, asked, sparse, cfg, k=None):
    """Every pair scored: {(q, kb): [(chunk, score)]} in order of rank."""
    out = {}
    for (q, kb), vector in asked.items():
        own = {i: v for (b, i), v in chunks.items() if b == kb}
        if not own:
            continue
        dense = {i: float(np.dot(v, vector)) for i, v in own.items()}
        thin = {i: sparse.get((q, kb, i), 0.0) for i in own}
        scale = lambda x: {i: 0.0 if max(x.values()) - min(x.values()) < 1e-12 else (v - min(x.values())) / (max(x.values()) - min(x.values())) for i, v in x.items()}
        a, b = scale(dense), scale(thin)
        score = {i: cfg.alpha * a[i] + (1 - cfg.alpha) * b[i] for i in own}
        most = k or min(cfg.dynamic_high, max(cfg.dynamic_low, len(own) // cfg.dynamic_divisor))
        out[q, kb] = [(i, round(score[i], 9)) for i in sorted(own, key=lambda i: (-round(score[i], 9), i))[:most]]
    return out


@pytest.mark.parametrize(("cell", "pack", "k"), [(1024, 256, None), (7, 3, 5), (16, 1, 60), (5, 2, 1)])
def test_hybrid_is_complete(spark, monkeypatch, cell, pack, k):
    """Against all pairs: collections of one size and another, many chunks of one score, questions given twice."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "PACK", pack)
    rng = np.random.default_rng(4)
    few = [np.round(rng.normal(size=6), 2) for _ in range(3)]  # few different vectors make ties
    chunks = {(f"kb{b}", i): few[int(rng.integers(3))] if b % 2 else rng.normal(size=6) for b, n in enumerate((1, 130, 90, 3, 61)) for i in range(n)}
    asked = {(q, f"kb{b}"): rng.normal(size=6) for q in range(5) for b in range(6)}
    sparse = {(q, kb, i): float(np.round(rng.random(), 3)) for q in range(4) for kb, i in chunks if rng.random() < 0.15}
    rows = spark.createDataFrame([(kb, i, f"text {i}", "", None, f"text {i}", [float(x) for x in v]) for (kb, i), v in chunks.items()], "kb_id string, chunk_idx int, chunk string, section string, page int, embed_text string, embedding array<double>")
    given = spark.createDataFrame([(q, kb, f"{q}/{kb}") for q, kb in asked] * 2 + [(None, "kb0", "x"), (1, None, "x")], "q_id long, kb_id string, question string")

    class Known:
        dim = 6

        def encode(self, texts):
            return np.array([asked[int(t.split("/")[0]), t.split("/")[1]] for t in texts])

    monkeypatch.setattr(retrieve, "sparse_scores", lambda *a: spark.createDataFrame([(*key, v) for key, v in sparse.items()], "q_id long, kb_id string, chunk_idx int, sparse double"))
    got = {}
    for r in retrieve.hybrid(retrieve.Index(rows, None, None), given, SMALL, k, Known).orderBy("rank").collect():
        got.setdefault((r.q_id, r.kb_id), []).append((r.chunk_idx, round(r.score, 9)))
        assert r["rank"] == len(got[r.q_id, r.kb_id])
    want = hybrid_plain(chunks, asked, sparse, SMALL, k)
    assert {p: [i for i, _ in x] for p, x in got.items()} == {p: [i for i, _ in x] for p, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for p in want for a, b in zip(got[p], want[p], strict=True))


@pytest.mark.parametrize("cell", [3, 64, 1024])
def test_dense_topk_with_ties_and_repeats(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "PACK", 2)
    rng = np.random.default_rng(7)
    table = {i: np.round(rng.normal(size=4), 1) for i in range(100)} | {i: np.ones(4) for i in range(100, 130)}
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in table.items()] + [(500, None)], "vec_id long, embedding array<double>")
    asks_ = spark.createDataFrame([(k, [float(x) for x in table[k]]) for k in (3, 50, 110)] * 2 + [(9, None)], "q_id long, q_embedding array<double>")
    got = sorted((r.q_id, r["rank"], r.vec_id) for r in vectors.dense_topk(vecs, asks_, 4).collect())
    want = [(q, n + 1, i) for q in (3, 50, 110) for n, i in enumerate(sorted(table, key=lambda i: (-round(float(table[i] @ table[q]), 6), i))[:4])]
    assert got == sorted(want * 2)
    assert vectors.dense_topk(vecs.limit(0), asks_, 4).count() == 0 == vectors.dense_topk(vecs, asks_.limit(0), 4).count()


@pytest.mark.parametrize("most", [30, 30_000])
def test_collections_weighed_as_a_whole_or_by_terms(spark, most):
    """Both ways of `index_terms` give the same vocabulary and weights, with a cap that bites and without, chunks without terms included."""
    cfg = Settings(chunk_size=100, overlap=10, max_features=most)
    rows = [(f"k{b}", k, " ".join(f"t{(j * b + k) % (9 * b + 3)}" for j in range(k % 11 + b)) if k % 4 else "a . !") for b in range(1, 7) for k in range(5 * b)] + [("none", 0, None), ("tie", 0, "é z a1 b2 c3 ｆ é")]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_idx int, embed_text string")

    def both(together):
        vocab, postings = tfidf.index_terms(chunks, cfg, together=together)
        return sorted((r.kb_id, r.term, r.df, r.cf, round(r.idf, 9)) for r in vocab.collect()), sorted((r.kb_id, r.chunk_idx, r.term, round(r.weight, 9)) for r in postings.collect())

    whole = both(1 << 20)
    assert whole == both(0) == both(120) and whole[0] and {r[0] for r in whole[0]} == {r[0] for r in whole[1]}


@pytest.mark.parametrize(("most", "summary", "held"), [(5, 8, 10**6), (5, 20, 60), (30, 31, 10**6), (12, 400, 10**6), (300, 300, 40)])
def test_summaries_name_the_frequent_terms(spark, monkeypatch, most, summary, held):
    """The cut by summaries equals an exact one, whether they can tell or not, and names few terms where a few are frequent."""
    monkeypatch.setattr(tfidf, "MOST_HELD", held)
    rng = np.random.default_rng(most)
    rows = [(f"k{b}", k, " ".join(f"t{int(x)}x" for x in rng.zipf(1.5, 60) % 5000)) for b in range(3) for k in range(40)]
    counts = storage.materialize(tfidf.term_counts(spark.createDataFrame(rows, "kb_id string, chunk_idx int, t string").repartition(6), ["kb_id", "chunk_idx"], "t", ()), "counts")
    exact, seen = {}, {}
    for r in counts.collect():
        seen.setdefault(r.kb_id, {}).setdefault(r.term, [0, 0])
        seen[r.kb_id][r.term][0] += 1
        seen[r.kb_id][r.term][1] += r.n
    for kb, table in seen.items():
        exact |= {(kb, t): tuple(table[t]) for t in sorted(table, key=lambda t: (-table[t][1], t))[:most]}
    cfg = Settings(chunk_size=100, overlap=10, max_features=most)
    got = {(r.kb_id, r.term): (r.df, r.cf) for r in tfidf.vocabulary(counts, cfg, summary=summary).collect()}
    assert got == exact
    likely = tfidf.candidates(counts, most, summary).collect()
    named = {(r.kb_id, r.term) for r in likely}
    told = {kb for kb, _ in named}
    assert {x for x in exact if x[0] in told} <= named
    if (most, summary) == (12, 400):
        assert told == set(seen) and len(named) < 0.2 * sum(map(len, seen.values()))


def test_terms_count_like_words(spark):
    rows = spark.createDataFrame([(0, "The reactor, the REACTOR core of a reactor_2"), (1, None), (2, ""), (3, "İstanbul ΟΔΟΣ été 42")], "n long, t string")
    got, heads = {k: {} for k in range(4)}, []
    for r in tfidf.term_counts(rows.withColumnRenamed("n", "k"), ["k"], "t").collect():
        got[r.k] |= {r.term: r.n} if r.term is not None else {}
        heads += [r.k] * r["head"]
    assert sorted(heads) == [0, 1, 2, 3]
    assert got[0] == {"reactor": 2, "core": 1, "reactor_2": 1, "reactor reactor": 1, "reactor core": 1, "core reactor_2": 1} and got[1] == got[2] == {}
    assert got[3]["οδος"] == 1 and got[3]["été 42"] == 1


def test_vocabulary_caps_large_collections_alone(spark):
    few = Settings(chunk_size=100, overlap=10, max_features=30)
    rows = [("big", k, " ".join(f"t{j}" for j in range(k % 7, 120, k % 5 + 1))) for k in range(12)] + [("small", 0, "some few words here")]
    counts = tfidf.term_counts(spark.createDataFrame(rows, "kb_id string, chunk_idx int, embed_text string"), ["kb_id", "chunk_idx"], "embed_text")
    got = tfidf.vocabulary(counts, few).collect()
    seen = {}
    for kb, _, text in rows:
        words = [w for w in text.split() if len(w) > 1 and w not in tfidf.STOP_WORDS]
        for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            seen.setdefault(kb, {}).setdefault(term, 0)
            seen[kb][term] += 1
    want = {(kb, t) for kb, n in seen.items() for t, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:30]}
    assert {(r.kb_id, r.term) for r in got} == want and all(seen[r.kb_id][r.term] == r.cf for r in got)


def test_passages_fall_back_to_three_sentences(spark):
    lines = ["\\[ x = y + a formula of some length \\]"] + [f"Sentence number {k} of a chunk that nothing in the question comes near to." for k in range(5)]
    sents = [(k, s, False, "" if k == 0 else s, 0.0, [0.0], 0.0) for k, s in enumerate(lines)]
    cols = "q_id long, kb_id string, question string, tops array<struct<rank:int,chunk_idx:int,chunk:string,score:double,attr:string,sents:array<struct<si:int,sent:string,noise:boolean,clean:string,rel:double,emb:array<double>,raw_rel:double>>>>"
    rows = spark.createDataFrame([(1, "k", "why", [(1, 0, " ".join(lines), 0.5, "", sents)])], cols)
    original, answer.gathered = answer.gathered, lambda *a: rows
    try:
        got = answer.answers(rows, SMALL).first()
    finally:
        answer.gathered = original
    assert got.picked == [] and got.answer_text == "I cannot determine this from the document." and got.focused == " ".join(lines[1:4])


def test_formulas_leave_passages_that_stand_in(spark):
    """A picked sentence may hold a formula; the supporting passage doesn't, and isn't shown where it says what the answer says."""
    sent = "The first sentence \\[ x = y \\] carries a formula inside its words."
    cols = "q_id long, kb_id string, question string, tops array<struct<rank:int,chunk_idx:int,chunk:string,score:double,attr:string,sents:array<struct<si:int,sent:string,noise:boolean,clean:string,rel:double,emb:array<double>,raw_rel:double>>>>"
    rows = spark.createDataFrame([(1, "k", "why", [(1, 0, sent, 0.5, "", [(0, sent, False, sent, 0.0, [0.0], 0.0)])])], cols)
    original, answer.gathered = answer.gathered, lambda *a: rows
    try:
        got = answer.answers(rows, SMALL).first()
    finally:
        answer.gathered = original
    assert got.focused == "The first sentence carries a formula inside its words." == got.answer_text and "Supporting passage" not in got.answer_html


def test_evidence_ranks_sentences_as_they_stand(spark):
    class Counts:
        dim = 2

        def encode(self, texts):
            return np.array([[float("formula" in t), float("question" in t)] for t in texts]) if len(texts) else np.zeros((0, 2))

    chunk = "\\[ formula \\] The first sentence is about nothing at all here. The second sentence is about a question asked. The third one is plain text without anything."
    cols = "q_id long, kb_id string, question string, q_embedding array<double>, rank int, chunk_idx int, chunk string, score double, section string, page int"
    rows = spark.createDataFrame([(1, "k", "formula", [1.0, 0.2], 1, 0, chunk, 0.5, "", None)], cols)
    sents = answer.gathered(rows, SMALL, Counts).first().tops[0].sents
    assert [(s.rel, s.raw_rel) for s in sents] == [(0.0, 1.0), (0.2, 0.2), (0.0, 0.0)]


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.asked.append((self.path, self.headers.get("Authorization"), body))
        prompt = body.get("inputs") or body.get("prompt")
        if "slow" in prompt:
            time.sleep(1.5)
        self.send_response(503 if "loading" in prompt else 200)
        self.end_headers()
        reply = [{"generated_text": f" hosted {prompt} "}] if "inputs" in body else {"response": f"local {prompt}"}
        self.wfile.write(b"{broken" if "broken" in prompt else json.dumps(reply).encode())

    def log_message(self, *args):
        pass


def test_generators_over_http():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        hosted, local = HostedGenerator(f"{url}/hosted", "secret", timeout=1), LocalGenerator(f"{url}/local", timeout=1)
        assert hosted.generate(["one", "loading", "broken", "slow", "two"]) == ["hosted one", "", "", "", "hosted two"]
        assert local.generate(["one", "slow"]) == ["local one", ""]
        assert Service.asked[0] == ("/hosted", "Bearer secret", {"inputs": "one", "parameters": {"max_new_tokens": 300, "temperature": 0.2, "do_sample": False, "return_full_text": False}})
        assert next(a for a in Service.asked if a[0] == "/local")[2] == {"model": "llama3.1:8b", "prompt": "one", "stream": False}
    finally:
        server.shutdown()
    assert LocalGenerator(f"{url}/gone", timeout=1).generate(["x"]) == [""]
    assert HostedGenerator("").timeout == 45 and LocalGenerator().timeout == 60


def test_large_replies_are_errors():
    from http.server import BaseHTTPRequestHandler as Handler

    from lectern.sources.html import HttpFetcher

    class Large(Handler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<p>" + b"x" * 1000)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Large)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert HttpFetcher().fetch(url)[1] == "" and HttpFetcher(max_bytes=1003).fetch(url)[1] == ""
    assert HttpFetcher(max_bytes=1002).fetch(url)[0] == "" and "1002" in HttpFetcher(max_bytes=1002).fetch(url)[1]
    server.shutdown()


def test_generators_see_relevant_questions_only(spark, tmp_path):
    log = tmp_path / "asked"

    def note(prompt):
        with log.open("a") as f:
            f.write("x\n")
        return "The reactor reached criticality after some hours."

    odd = asks(spark).unionByName(spark.createDataFrame([(9, "d1", "zzz qqq")], "q_id long, kb_id string, question string"))
    hosted = Settings(chunk_size=100, overlap=10, mode="hosted")
    found = retrieve.rerank(retrieve.hybrid(index(spark), odd, SMALL), SMALL).withColumn("score", F.when(F.col("q_id") == 9, 0.0).otherwise(F.col("score")))
    got = {r.q_id: r.answer_text for r in answer.answers(found, hosted, generator=lambda: FunctionGenerator(note)).collect()}
    assert got[9] == answer.NOTHING and len(got) == 5 and log.read_text().count("x") == 4


def test_rerankers_without_a_model_keep_the_order(spark):
    found = retrieve.hybrid(index(spark), asks(spark), SMALL)
    plain, again = (retrieve.rerank(found, SMALL, r).orderBy("q_id", "rank").select("q_id", "chunk_idx").collect() for r in (None, CrossEncoderReranker))
    assert plain == again


def test_clusters_need_a_shared_folder(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = Conf

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_tables_of_a_piece_of_work_are_deleted(spark):
    with storage.tables_of():
        made = storage.materialize(spark.range(3), "gone")
        assert made.count() == 3
        path = made._written_at.removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_pieces_of_work_in_threads_keep_their_tables(spark):
    """Each piece of work deletes its own tables alone, however they overlap in time."""
    gate, results, left = threading.Barrier(2), {}, {}

    def work(name, n):
        with storage.tables_of():
            first = storage.materialize(spark.range(n), f"first-{name}")
            gate.wait()

            def build():
                inner = storage.materialize(first.selectExpr("id * 2 AS id"), f"inner-{name}")
                gate.wait()
                return inner.where("id >= 0")

            made = storage.materialize_alone(build, f"made-{name}")
            gate.wait()
            results[name] = (first.count(), made.count())
            left[name] = (first._written_at, made._written_at)
            if name == "a":  # ends while the other still reads
                return
            done.wait()
            results[name] += (first.count(), made.count())

    done = threading.Event()
    threads = [threading.Thread(target=work, args=x) for x in (("a", 3), ("b", 5))]
    for t in threads:
        t.start()
    threads[0].join()
    done.set()
    threads[1].join()
    assert results == {"a": (3, 3), "b": (5, 5, 5, 5)}
    for paths in left.values():
        assert not any(os.path.exists(p.removeprefix("file://")) or p in storage._MADE for p in paths)


def test_tables_pass_to_the_work_around(spark):
    with storage.tables_of():
        made = storage.materialize_alone(lambda: storage.materialize(spark.range(4), "inner"), "outer")
        storage.release(storage.materialize(spark.range(1), "released"))
        assert made.count() == 4
        path = made._written_at.removeprefix("file://")
    assert not os.path.exists(path)


def test_streaming_ingest_adds_each_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "kb_id string, text string"
    for k, n in ((0, 2), (1, 4)):
        documents(spark, n).where(F.lit(k == 0) | F.col("kb_id").isin("d2", "d3")).write.mode("append").parquet(source)
        ingest.ingest(ingest.stream_documents(spark, source, schema), out, mark, SMALL).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == chunking.chunks(documents(spark), SMALL).count() and got.select("kb_id").distinct().count() == 4


def _plans(monkeypatch, *modules):
    """The plans of all tables that modules write, by tag."""
    seen = {}
    for module in modules:
        def recorded(df, tag, *rest, write=module.materialize):
            seen[tag] = df._jdf.queryExecution().executedPlan().toString()
            return write(df, tag, *rest)

        monkeypatch.setattr(module, "materialize", recorded)
    return seen


def test_hybrid_broadcasts_no_table_that_grows(spark, monkeypatch):
    chunks = storage.materialize(chunking.chunks(documents(spark), SMALL), "chunks")
    built = retrieve.build_index(chunks, SMALL)
    seen = _plans(monkeypatch, retrieve, tfidf)
    found = retrieve.hybrid(built, asks(spark), SMALL)
    seen["found"] = found._jdf.queryExecution().executedPlan().toString()
    assert {"ask-weights", "sparse", "cells", "parts", "ranked", "open"} <= set(seen)
    assert [tag for tag, plan in seen.items() if "Broadcast" in plan] == []
    assert found.select("q_id").distinct().count() == 4


def test_turns_are_not_broadcast(spark):
    kind = "q_id long, kb_id string, question string, answer_text string, attr_text string, extras array<string>"
    done = storage.materialize(spark.createDataFrame([(k, f"d{k % 3}", "q", "a", "", []) for k in range(9)], kind), "done")
    old = spark.createDataFrame([], "kb_id string, turn int, role string, content string, answer_text string, attr_text string, extras array<string>")
    turns = done.select("kb_id").distinct().withColumn("next_turn", F.lit(2))
    out = registry.append_turn(old, done, turns)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.turn for r in out.where("kb_id = 'd1'").collect()) == [2, 3, 4, 5, 6, 7]


def test_dense_topk_copies_no_packs_into_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(400)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    top = vectors.dense_topk(rows, asked, 3)
    assert top.count() == 24
    top.collect()
    assert "BroadcastHashJoin" not in top._jdf.queryExecution().executedPlan().toString()


def test_terms_meet_packed(spark):
    texts = [(q, f"k{q % 3}", t) for q, t in enumerate(["red fox", "red red hen", "", "blue fox fox", None, "hen house", "red fox red fox", "nothing known"])]
    asked = spark.createDataFrame(texts, "q_id long, kb_id string, question string")
    rows = spark.createDataFrame([(f"k{k % 3}", k, t) for k, t in enumerate(["red fox and hen", "blue hen house", "fox red fox", "hen hen fox", "red fox", "house of fox"])], "kb_id string, chunk_idx int, embed_text string")
    vocab, postings = tfidf.index_terms(rows, SMALL)
    by = ["q_id", "kb_id"]
    key = lambda f, *names: {tuple(r[n] for n in names[:-1]): pytest.approx(r[names[-1]], abs=1e-12) for r in f.collect()}
    made = tfidf.text_weights(asked, by, "question", vocab)
    flat = tfidf.weights(tfidf.term_counts(asked, by, "question"), vocab, by)
    assert key(made, *by, "term", "weight") == {k: v.expected for k, v in key(flat, *by, "term", "weight").items()} and flat.count() > 8
    some = made.where("term <> 'fox'")
    kept = tfidf.text_weights(asked, by, "question", vocab, only=some)
    assert key(kept, *by, "term", "weight") == {(r.q_id, r.kb_id, r.term): r.weight for r in made.join(some.select("kb_id", "term").distinct(), ["kb_id", "term"]).collect()}
    plain = made.withColumnRenamed("weight", "w").join(postings, ["kb_id", "term"]).groupBy(*by, "chunk_idx").agg(F.sum(F.col("w") * F.col("weight")).alias("cosine"))
    close = tfidf.cosine(made, postings, by, ["kb_id", "chunk_idx"])
    assert key(close, *by, "chunk_idx", "cosine") == {(r.q_id, r.kb_id, r.chunk_idx): r.cosine for r in plain.collect()}
    # no row of a term is shuffled for itself
    assert not any("Exchange" in line and "term" in line.split("Exchange")[1].split("]")[0] for line in close._jdf.queryExecution().executedPlan().toString().splitlines())
    assert tfidf.unpacked(tfidf.packed(postings)).exceptAll(postings).isEmpty()


def test_sentences_meet_their_terms_packed(spark, monkeypatch):
    from lectern.plans import queries_index

    seen = _plans(monkeypatch, queries_index)
    out = queries_index.score_sentences(spark, "/root/testdata/sf0.001")
    assert "term-counts" not in seen and "vocab" not in seen
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "term" in line.split("Exchange")[1].split("]")[0] for line in plan.splitlines())


def test_stored_index_is_copied_once(spark):
    from lectern.plans import queries_index

    before = set(storage._MADE)
    assert queries_index.index_roundtrip(spark, "/root/testdata/sf0.001").count() > 0
    made = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(storage._MADE) - before}
    assert "weighed-terms" in made and not made & {"postings", "chunks"}


def test_index_for_questions_alone_has_their_terms(spark):
    """The values of the whole index, for the terms that a collection's questions have; large collections are weighed as ever."""
    docs = documents(spark).unionByName(spark.createDataFrame([("short", "Too short a text, of one chunk."), (None, "No id. " * 200)], "kb_id string, text string"))
    chunks = chunking.chunks(docs, SMALL)
    asked = asks(spark).unionByName(asks(spark)).unionByName(spark.createDataFrame([(7, "d1", "criticality after hours"), (8, "d2", None), (9, "short", "a text"), (10, None, "reactor"), (11, "absent", "reactor")], "q_id long, kb_id string, question string"))
    whole, some = retrieve.build_index(chunks, SMALL), retrieve.build_index(chunks, SMALL, asks=asked)
    known = {f"d{k}": set(tfidf.terms(f"when did reactor number {k} reach criticality")) for k in range(4)}
    known["d1"] |= set(tfidf.terms("criticality after hours"))
    for part in ("vocab", "postings"):
        rows = {tuple(r) for r in getattr(some, part).collect()}
        at = getattr(whole, part).columns.index("term")
        every = [tuple(r) for r in getattr(whole, part).collect()]
        assert rows == {r for r in every if r[at] in known.get(r[0], ())} and 0 < len(rows) < len(every)
    found = lambda built: sorted(map(str, retrieve.hybrid(built, asked, SMALL).select("q_id", "kb_id", "chunk_idx", F.round("sparse", 9), F.round("score", 9), "rank").collect()))
    assert found(some) == found(whole) != []
    large = tfidf.index_terms(chunks.where("kb_id IS NOT NULL AND kb_id <> 'short'"), SMALL, together=10, asks=asked)
    assert found(retrieve.Index(whole.chunks, *large)) == found(whole)


def test_many_rejected_collections_are_not_broadcast(spark, monkeypatch):
    """Their ids are counted: a written table of them may be few bytes and many rows."""
    seen = {}
    write = storage.materialize

    def materialize(df, tag, *given):
        seen[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag, *given)

    for module in (retrieve, tfidf):
        monkeypatch.setattr(module, "materialize", materialize)
    docs = documents(spark).unionByName(spark.createDataFrame([("short", "Too short a text, of one chunk.")], "kb_id string, text string"))
    chunks = chunking.chunks(docs, SMALL)
    few = {r.kb_id for r in retrieve.build_index(chunks, SMALL).chunks.collect()}
    assert "Broadcast" in seen["index-chunks"]
    monkeypatch.setattr(retrieve, "FEW", 0)
    assert few == {r.kb_id for r in retrieve.build_index(chunks, SMALL).chunks.collect()} == {f"d{k}" for k in range(4)}
    assert "Broadcast" not in seen["index-chunks"]


def test_answers_plan_neither_retrieval_nor_a_second_encoder(spark, monkeypatch):
    """What follows retrieval is planned once, over written candidates, and sentences with and without formulas are encoded in one call."""
    monkeypatch.setattr(vectors, "ARRAYS", 3)
    docs = spark.createDataFrame([(f"d{k}", "\n".join(f"\\[ energy = mass \\] The reactor of plant number {k} reached criticality after hour {j}. Then it ran." for j in range(40))) for k in range(4)], "kb_id string, text string")
    built = retrieve.build_index(chunking.chunks(docs, SMALL), SMALL)
    found = retrieve.rerank(retrieve.hybrid(built, asks(spark), SMALL), SMALL)
    rows = answer.gathered(found, SMALL)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    got = [s for r in rows.collect() for t in r.tops for s in t.sents if not s.noise]
    model = retrieve.default_embedder(SMALL)()
    assert len(got) > 4 * vectors.ARRAYS and np.allclose([s.emb for s in got], model.encode([s.clean for s in got]))
    asked = [model.encode([r.question])[0] for r in rows.collect() for t in r.tops for s in t.sents if not s.noise]
    assert np.allclose([s.raw_rel for s in got], (model.encode([s.sent for s in got]) * np.array(asked)).sum(axis=1))


def test_questions_asked_again_are_not_planned_again(spark):
    """Ranks of questions whose bound proves nothing are written; chunks of other collections aren't scanned for them."""
    chunks = chunking.chunks(documents(spark, 3), Settings(chunk_size=20, overlap=2))
    same = chunks.withColumn("embed_text", F.when(F.col("kb_id") == "d0", F.lit("one text for all")).otherwise(F.col("embed_text")))
    found = retrieve.hybrid(retrieve.build_index(same, SMALL), asks(spark), SMALL, top_k=3)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.chunk_idx for r in found.where("kb_id = 'd0'").orderBy("rank").collect()] == [0, 1, 2]
