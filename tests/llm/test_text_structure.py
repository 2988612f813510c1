"""Fill-in-middle, periodic runs and the piece table against brute-force versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from lectern.llm import fill_middle, periodic_runs, piece_table, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = ["", " ", "<P>", "a<S>b", "x <M", "<", "<S", "é", "aé", "éa", "漢字kana字", "😀a😀", "a" * 70, "\n\n", "ab12cd", "A-b-C " * 9, "…", "<P", "P>", "S><M"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n string, output string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def fim_brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or h3 % 100 >= 90 or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 13])
def test_chunks_count_and_cut_like_a_list_of_units(monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "TOGETHER", 3 * chunk)
    rng = random.Random(chunk)
    for _ in range(40):
        texts = [rng.choice(ODD) if rng.random() < 0.3 else "".join(rng.choice("abZé漢 1.\n<") for _ in range(rng.randint(0, 30))) for _ in range(6)]
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, data)])
        chunks = fill_middle.Chunks(np.frombuffer(b"".join(data), np.uint8), offsets)
        units = [UNIT.findall(t) for t in texts]
        assert chunks.n_units().tolist() == [len(u) for u in units]
        for k, u in enumerate(units):
            for rank in range(len(u) + 1):
                head = "".join(u[:rank])
                assert chunks.cut(k, rank) == (offsets[k] + len(head.encode()), len(head))


def test_fill_in_middle_brute(spark):
    rng = random.Random(2)
    rows = [(k, t, "n", "o") for k, t in enumerate(ODD * 12)] + [(None, "no id here", None, None), (None, None, None, None), (7, None, "n", "o"), (7, "again", "n", "o"), (7, "again", "n", "o")]
    rows += [(1000 + k, "".join(rng.choice("abcXYZ  \n.,1é漢<PSM>") for _ in range(rng.randint(1, 400))), "n", "o") for k in range(150)]
    made = fill_middle.fill_in_middle(frame(spark, rows)).withColumn("back", fill_middle.restore("output", "form"))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()), key=str)
    assert got == sorted(((i, *fim_brute(i, t), t or "") for i, t, _, _ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_long_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(("word ", "Wörter ", "漢", "x", "1")) for _ in range(1_400_000)), "q" * 5_000_000, "é" * 2_500_000]
    made = fill_middle.fill_in_middle(frame(spark, [(k, t, "", "") for k, t in enumerate(texts)]))
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_brute(r.doc_id, texts[r.doc_id])


def test_draws_are_parameters(spark):
    rows = frame(spark, [(k, f"text number {k} here", "", "") for k in range(60)])
    draw = fill_middle.Draw(seed="s", plain_percent=0, spm_percent=100, prefix="[p]", suffix="[s]", middle="[m]")
    made = fill_middle.fill_in_middle(rows, draw, carry=["text"]).withColumn("back", fill_middle.restore("output", "form", draw))
    assert all(r.form == "spm" and r.back == r.text and r.output.startswith("[s]") for r in made.collect())


# periodic runs


def runs_brute(words, least=24, exponent=3):
    """By the definition: for each lag the maximal stretches, and for each of these its smallest period."""
    out = set()
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, exponent * q):
                part = words[at : end + q]
                if not any(all(x == y for x, y in zip(part, part[p:], strict=False)) for p in range(1, q)):
                    out.add((at, len(part), q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    words = []
    while len(words) < rng.randint(0, 160):
        part = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        words += part * rng.choice((1, 1, 3, 4, 9)) + part[: rng.randint(0, len(part))]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (1, 2), (5, 2), (30, 4), (8, 3)])
def test_lag_runs_brute(monkeypatch, least, exponent):
    rng = random.Random(least)
    for turn in range(250):
        monkeypatch.setattr(periodic_runs, "BLOCK", (1 << 19, 50)[turn % 2])
        words = periodic_text(rng)
        found = []
        edges = sorted({1, len(words) + 1, *(rng.randint(1, len(words) + 1) for _ in range(turn % 3))})
        for low, high in zip(edges, edges[1:], strict=False):
            found += periodic_runs.lag_runs(periodic_runs._numbers([w.encode() for w in words]), low, high, least, exponent)
        assert periodic_runs.primitive(found) == runs_brute(words, least, exponent)


def expected(doc_id, text):
    words = WORD.findall((text or "").encode())
    order = periodic_runs.planted(doc_id, len(words))
    words = words if order is None else [words[k] for k in order]
    runs = runs_brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


@pytest.mark.parametrize(("whole_bytes", "most"), [(periodic_runs.WHOLE_BYTES, periodic_runs.MOST_COMPARES), (60, 700), (-1, 1)])
def test_periodic_runs_brute(spark, whole_bytes, most):
    rng = random.Random(6)
    rows = [(k, " ".join(periodic_text(rng)), "n", "o") for k in range(60)] + [(None, "a b " * 30, "", ""), (None, None, "", ""), (3, "", "", ""), (3, "x " * 40, "", ""), (3, "x " * 40, "", ""), (90, " \n\t", "", ""), (91, "ü\xa0ü " * 25, "", "")]
    got = periodic_runs.periodic_runs(frame(spark, rows), rewrite=periodic_runs.planted, whole_bytes=whole_bytes, most_compares=most).collect()
    have = sorted(((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got), key=str)
    assert have == sorted(((i, *expected(i, t)) for i, t, _, _ in rows), key=str)


def test_periodic_runs_of_long_texts(spark):
    rng = random.Random(8)
    head = [f"w{rng.randint(0, 99999)}" for _ in range(120_000)]
    words = head + [f"p{k}" for k in range(50_000)] * 3 + ["z"] * 30 + head[:500]
    text = "\n".join(words) + " " * 4_500_000
    got = periodic_runs.periodic_runs(frame(spark, [(1, text, "", ""), (2, "a b c " * 9, "", "")]), most_compares=1 << 32)
    rows = {r.doc_id: r for r in got.collect()}
    assert [tuple(x) for x in rows[1].runs] == [(120_000, 150_000, 50_000), (270_000, 30, 1)]
    assert len(rows[1].collapsed.split()) == len(words) - 100_000 - 29 and rows[2].collapsed == "a b c"


def test_bad_run_settings_are_refused(spark):
    for bad in ({"least": 0}, {"exponent": 1}):
        with pytest.raises(ValueError, match="exponent"):
            periodic_runs.periodic_runs(frame(spark, []), **bad)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_periodic_runs"])
def test_sql_on_repeated_rows(spark, tables, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables.repeated}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, tables.repeated), con.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    index = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=str)


# piece table


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_table.default_vocabulary())


def ids_of(texts):
    return [np.frombuffer(x, np.int32).tolist() for x in piece_table.load_parts(piece_table.default_vocabulary()).documents(texts)]


def odd_texts(seed, n):
    rng = random.Random(seed)
    alpha = "abcdefghinorstTHE  \n\t▁éß漢字ゼ<>0123456789.,;'\"()=-_\x00　😀ሴ\xa0²́​"
    out = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["", " ", "  ", "\n", "▁", "▁▁ ▁", " lead", "trail ", "<s> </s> <unk> <0x0A>", " " * 700, "a" * 3000, "the" * 500, "=" * 777 + "-" * 50, "0" * 99, "漢" * 80 + "a", "﻿�", "x\r\ny"]


def test_ids_equal_the_library(library):
    texts = odd_texts(1, 6000)
    assert ids_of(texts) == library.encode(texts)


def test_small_memos_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_table, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(piece_table, "MOST_PAIRS", 50)
    monkeypatch.setattr(piece_table, "LONGEST_PART", 5)
    monkeypatch.setattr(piece_table, "TOGETHER", 3)
    parts = piece_table.Parts(piece_table.load_table(piece_table.default_vocabulary()))
    texts = odd_texts(2, 300)
    for at in range(0, len(texts), 40):
        assert [np.frombuffer(x, np.int32).tolist() for x in parts.documents(texts[at : at + 40])] == library.encode(texts[at : at + 40])
    assert parts.size <= 10_000 + 500 and all(len(p) <= 5 for p in parts)


def test_every_prefix_has_the_last_piece_of_its_own_encoding(library):
    table = piece_table.load_table(piece_table.default_vocabulary())
    rng = random.Random(3)
    for _ in range(200):
        text = piece_table.MARK + "".join(rng.choice("thersaioncduk") for _ in range(rng.randint(1, 14)))
        last, size = table.last_pieces(text)
        for end in range(1, len(text) + 1):
            pieces = table.merged(text[:end])
            assert table.text[last[end]] == pieces[-1] and size[end] == len(pieces[-1])


def test_tables_of_other_piece_sets():
    with pytest.raises(ValueError, match="marks have to lead"):
        piece_table.Table({"ab": -1.0}, {"a": 0, "ab": 1}, [])
    with pytest.raises(ValueError, match="marks have to lead"):
        piece_table.Table({}, {"a": 0, "▁": 1, "a▁": 2}, [])
    scores = {"a": -9.0, "b": -9.0, "ab": -3.0, "ba": -2.0, "aba": -1.0, "bab": -2.0, "abab": -2.0}  # ties, and scores that rise again
    table = piece_table.Table(scores, {p: k for k, p in enumerate(scores)}, [])
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        assert [table.text[k] for k in table.known_ids(text)] == table.merged(text)
        assert np.frombuffer(table.many_ids([text, text[:1]])[0], np.int32).tolist() == table.known_ids(text)


def test_sentencepiece_query_against_the_library(spark, tables, library):
    got = piece_table.op13_sentencepiece(spark, tables.repeated).collect()
    want = []
    for i, text, _ in tables.repeated_rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)


def test_long_texts_go_through_the_table_whole(spark, library):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(("river", "Straße", "xq", "12,5", "漢字", "\n")) for _ in range(900_000)), "ab" * 1_000_000, None]
    coded = piece_table.encode(frame(spark, [(k, t, "", "") for k, t in enumerate(texts)]), carry=["n"])
    for r in piece_table.decode(coded.withColumn("text_of", coded.doc_id)).join(coded.select("doc_id", "ids"), "doc_id").collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.text == (library.decode(ids) if ids else "") and r.n == ""
