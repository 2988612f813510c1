"""Every operator against its SQL or a brute-force version, on small adversarial tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lectern.llm import cover_dedup, fm_index, kernels, mixing, noisy_channel, quality_rules, queries, repeats, simhash, subwords, suffix_dedup, token_files, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, tables.full)
    want = tables.con.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    index = [want.columns.index(n) for n in names]
    assert rows_of(got) == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tables, name):
    got = queries.QUERIES[name](spark, tables.empty)
    assert got.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_repeated_rows_and_null_ids(spark, tables, name):
    got = queries.QUERIES[name](spark, tables.repeated)
    key = "page_id" if "page_id" in got.columns else "doc_id"
    want = [p[0] for p in [*tables.pages, *tables.pages[:3], (None,), (None,)]] if key == "page_id" else [r[0] for r in tables.repeated_rows]
    assert sorted((r[key] for r in got.select(key).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op1_warc", "op3_decontaminate", "op4_quality_rules"])
def test_values_on_repeated_rows(spark, tables, name):
    """Against the SQL; documents get numbers there, since the SQL groups by their id."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tables.repeated}/pages.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{tables.repeated}/benchmark.parquet'")
    con.sql(f"CREATE TABLE named AS SELECT *, row_number() OVER () AS n FROM '{tables.repeated}/documents.parquet'; CREATE VIEW documents AS SELECT n AS doc_id, text FROM named")
    got, want = queries.QUERIES[name](spark, tables.repeated), con.sql(queries.ORACLES[name])
    if name != "op1_warc":
        want = con.sql(f"SELECT k.doc_id, q.* EXCLUDE (doc_id) FROM ({queries.ORACLES[name]}) q JOIN named k ON q.doc_id = k.n")
    names = sorted(got.columns)
    index = [want.columns.index(n) for n in names]
    assert rows_of(got) == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=str)


def test_files_and_fingerprints_of_repeated_rows(spark, tables):
    """Rows with equal texts get equal values, whatever their ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    want = []
    for i, text, _ in tables.repeated_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)))
    got = token_files.op7_token_files(spark, tables.repeated).collect()
    assert sorted(((r.doc_id, r.ids_crc32, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    marks = simhash.op6_simhash(spark, tables.repeated).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in marks), key=str) == sorted(((i, f"{simhash.fingerprint((t or '').encode()):016x}") for i, t, _ in tables.repeated_rows), key=str)
    least = {}
    for r in marks:
        least.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(x) == 1 for x in least.values())


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_long_texts_are_counted_in_blocks(block):
    rng = np.random.default_rng(block)
    for _ in range(60):
        text = "".join(rng.choice(list("ab é\xa0\x1c\n"), int(rng.integers(0, 80))))
        words = WORD.findall(text.encode())
        assert quality_rules.long_counts(text, block) == (len(words), quality_rules.repeated_words(words))


def test_trie_tasks_keep_groups_whole(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    groups = np.sort(rng.integers(0, 9, 400))
    values = rng.integers(0, 200, 400)
    once = np.unique(np.stack((groups, values), axis=1), axis=0)
    batches = [pa.RecordBatch.from_arrays([pa.array(once[a : a + 13, 0]), pa.array(once[a : a + 13, 1])], names=["grp", "fp"]) for a in range(0, len(once), 13)]

    def found():
        return {(int(u), int(v)) for b in simhash._trie_task(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}

    whole = found()
    monkeypatch.setattr(simhash, "RUN", 20)
    assert found() == whole and whole


def repeats_brute(rows, split, window):
    """For each row: units and which of them stand in windows that start in a smaller id."""
    units = [split((t or "").encode()) for _, t, _ in rows]
    least = {}
    for (i, _, _), u in zip(rows, units, strict=True):
        if i is not None:
            for k in range(len(u) - window + 1):
                w = tuple(u[k : k + window]) if isinstance(u, list) else u[k : k + window]
                least[w] = min(least.get(w, i), i)
    out = []
    for (i, _, _), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for k in range(len(u) - window + 1 if i is not None else 0):
            w = tuple(u[k : k + window]) if isinstance(u, list) else u[k : k + window]
            if least[w] < i:
                gone[k : k + window] = [True] * window
        out.append((i, u, gone))
    return out


def brute_bytes(rows):
    want = []
    for i, u, gone in repeats_brute(rows, lambda b: b, 50):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want.append((i, kept, len(u), sum(gone), spans))
    return sorted(want, key=str)


def test_suffix_dedup_brute(spark, tables):
    want = [(i, hashlib.sha256(kept).hexdigest(), *rest) for i, kept, *rest in brute_bytes(tables.repeated_rows)]
    assert rows_of(suffix_dedup.op2_suffix_dedup(spark, tables.repeated)) == sorted(want, key=str)


@pytest.mark.parametrize("spread", [4096, 1, 0])
def test_suffix_dedup_spreads(spark, tables, monkeypatch, spread):
    monkeypatch.setattr(repeats, "pack_slices", lambda docs, pack=repeats.pack_slices: pack(docs, 1))
    docs = spark.read.parquet(f"{tables.repeated}/documents.parquet")
    found = [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_bytes(docs, spread).collect()]
    assert sorted(found, key=str) == brute_bytes(tables.repeated_rows)


class Forged(suffix_dedup.Bytes):
    """Anchors and contexts of few bits, so that very different ones collide."""

    def anchors(self):
        a = super().anchors()
        return repeats.Anchors(a.anchor & np.uint64(3 << 40), a.context & np.uint64(1), a.doc, a.first, a.last)


def test_suffix_dedup_looks_at_bytes(spark, tables, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "Bytes", Forged)
    docs = spark.read.parquet(f"{tables.repeated}/documents.parquet")
    found = [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_bytes(docs).collect()]
    assert sorted(found, key=str) == brute_bytes(tables.repeated_rows)


def brute_words(rows):
    return sorted(((i, b" ".join(w for w, g in zip(u, gone, strict=True) if not g), sum(gone), len(u)) for i, u, gone in repeats_brute(rows, WORD.findall, 13)), key=str)


class ForgedWords(cover_dedup.Words):
    def anchors(self):
        a = super().anchors()
        return repeats.Anchors(a.anchor & np.uint64(3 << 40), a.context & np.uint64(1), a.doc, a.first, a.last)

    def window_hashes(self, at):
        return super().window_hashes(at) & np.uint64(7 << 40)


@pytest.mark.parametrize("spread,forged", [(4096, True), (0, True), (1, False), (0, False)])
def test_cover_dedup_looks_at_words(spark, tables, monkeypatch, spread, forged):
    if forged:
        monkeypatch.setattr(cover_dedup, "Words", ForgedWords)
    else:
        monkeypatch.setattr(repeats, "pack_slices", lambda docs, pack=repeats.pack_slices: pack(docs, 1))
    docs = spark.read.parquet(f"{tables.repeated}/documents.parquet")
    found = [(r.doc_id, bytes(r.kept_text), r.n_removed, r.n_words) for r in cover_dedup.dedup_words(docs, spread).collect()]
    assert sorted(found, key=str) == brute_words(tables.repeated_rows)


def test_representatives_of_collisions():
    rng = np.random.default_rng(2)
    ids, texts, hashes = rng.integers(0, 9, 300), rng.integers(0, 20, 300), rng.integers(0, 3, 20)
    like = repeats.representatives((hashes[texts],), ids, lambda i, j: texts[i] == texts[j], exact=True)
    assert all(texts[like] == texts) and all(ids[like][k] == ids[texts == texts[k]].min() for k in range(300))
    assert all(len(set(like[texts == t])) == 1 for t in texts)


def test_minimizers_of_long_texts_fall_alike():
    rng = np.random.default_rng(4)
    copy = rng.integers(97, 99, 3000).astype(np.uint8)
    units, starts = suffix_dedup.Bytes(), (100, suffix_dedup.PIECE - 1500, 17 << 20)
    data = rng.integers(97, 101, 18 << 20).astype(np.uint8)
    for at in starts:
        data[at : at + 3000] = copy
    units.load(repeats.Slice(np.array([1]), np.array([0], np.uint8), data, np.array([0, len(data)])))
    least = units._least()
    a, b, c = (least[at : at + 2951] - at for at in starts)
    assert (a == b).all() and (a == c).all()


@pytest.mark.parametrize("most", [4 << 20, 1])
def test_cover_dedup_brute(spark, tables, monkeypatch, most):
    monkeypatch.setattr(repeats, "pack_slices", lambda docs, pack=repeats.pack_slices: pack(docs, most))
    got = rows_of(cover_dedup.op8_cover_dedup(spark, tables.repeated))
    want = []
    for i, u, gone in repeats_brute(tables.repeated_rows, WORD.findall, 13):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want.append((i, hashlib.sha256(kept).hexdigest(), sum(gone), len(u)))
    assert got == sorted(want, key=str)


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    at = np.arange(2900)
    kind = suffix_dedup.deep_shallow(data, at)
    texts = [data[k : k + 50].tobytes() for k in at]
    rank = {t: n for n, t in enumerate(sorted(set(texts)))}
    assert [rank[t] for t in texts] == kind.tolist()


def test_difference_cover_and_minimizers_align():
    assert {(a - b) % cover_dedup.PERIOD for a in cover_dedup.COVER for b in cover_dedup.COVER} == set(range(cover_dedup.PERIOD))


def test_simhash_brute(spark, tables):
    rows = tables.rows
    def mark(text):
        words = WORD.findall((text or "").encode().lower())
        if not words:
            return 0
        k = min(3, len(words))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (marks[a] ^ marks[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b], key=lambda k: rows[k][0])
    want = sorted((rows[label[k]][0], r[0], f"{marks[k]:016x}") for k, r in enumerate(rows))
    assert sorted(rows_of(simhash.op6_simhash(spark, tables.full))) == want


def test_simhash_of_bytes_is_the_native_hash(spark):
    text = "a b c"
    native = spark.sql(f"SELECT xxhash64('{text}') AS h").first().h
    assert f"{simhash.fingerprint(text.encode()):016x}" == f"{native & (2**64 - 1):016x}"


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_links_brute(budget):
    rng = np.random.default_rng(budget)
    for _ in range(30):
        base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        values = base[rng.integers(0, 4, 60)]
        for _ in range(rng.integers(0, 5)):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
        values = np.unique(values)
        a, b = simhash.trie_links(np.zeros(len(values), np.int64), values, budget)
        place = {int(v): k for k, v in enumerate(values)}
        found = simhash.local_components(len(values), np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
        near = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget)
        assert (found == simhash.local_components(len(values), *near)).all()


def test_simhash_splits_large_groups(spark):
    values = [(k % 50) << 20 | (1 << (k % 16)) for k in range(600)]
    df = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
    plain = {tuple(sorted(r)) for r in simhash.components(simhash.link_fingerprints(df)).collect()}
    split = {tuple(sorted(r)) for r in simhash.components(simhash.link_fingerprints(df, split_over=5)).collect()}
    assert plain == split and plain


def test_token_files_brute(spark, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    at, want = 0, []
    for i, text, _ in sorted(tables.rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids), at))
        at += len(ids)
    assert rows_of(token_files.op7_token_files(spark, tables.full)) == sorted(want, key=str)


def test_token_pieces_are_kept_without_commas():
    pieces = token_files.Pieces((known := token_files.load_pieces(token_files.default_vocabulary())).tokenizer, known.special)
    pieces.document("so foxes, foxes. and foxes, \nfoxes. end")
    assert "foxes" in pieces and not {"foxes,", "foxes."} & set(pieces)
    draw = random.Random(7)
    odd = [", a", "x), y", "a_, b", "it's, 'x. y", "½, ². ", "a, , b", "\x01, a", "...., . ,", "中, 文. 字", "a,\nb. \n. c"]
    for text in odd + ["".join(draw.choice("ab1é_()'!., \n\u0301\x01 , .") for _ in range(draw.randint(1, 14))) for _ in range(3000)]:
        assert pieces.document(text) == pieces.coded(text), text


@pytest.mark.parametrize("text", ["a  b", " x", "x ", "a\n\nb", "it's don't I'll", "a\tb", "x y  z", "<|endoftext|> hi", "end.\nNew 12,5 a.b! ¿qué?", "a\n b", "\n", "w'.x", "x1. y²", "", "\x00a b", "a \x00b", "don't.\n'tis", "日本語 テスト。"])
def test_pieces_equal_whole_texts(text):
    pieces = token_files.load_pieces(token_files.default_vocabulary())
    assert pieces.document(text) == (pieces.coded(text) if text else b"")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 65_536, 65_537, 200_000])
def test_rans_round_trip_and_damage(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 50_000).astype("<u4")
    data = token_files.pack_file(ids, [1, None], np.array([1, n - 1]), (0, 0), 2)
    header, doc_ids, lengths, back = token_files.unpack_file(data)
    assert (back == ids).all() and doc_ids == [1, None] and lengths.tolist() == [1, n - 1]
    broken = bytearray(data)
    broken[-1] ^= 1
    if header["words"]:
        with pytest.raises(ValueError, match="checksum"):
            token_files.unpack_file(bytes(broken))


@pytest.mark.parametrize("n", [131_072, 131_073, 300_000])
def test_rans_groups_of_blocks(monkeypatch, n):
    monkeypatch.setattr(token_files, "GROUP", 2)
    ids = np.random.default_rng(n).integers(0, 3000, n).astype("<u4")
    assert (token_files.unpack_file(token_files.pack_file(ids, [7], np.array([n]), (1, 2), 2))[3] == ids).all()


def test_memo_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_BYTES", 20_000)
    whole = token_files.load_pieces(token_files.default_vocabulary())
    pieces = token_files.Pieces(whole.tokenizer, whole.special)
    text = " ".join(f"word{k % 700}, x{k}." for k in range(3000)) + " " + "y" * 500
    assert pieces.document(text) == whole.coded(text)
    assert pieces.size <= 10_300 and len(pieces) + len(pieces.old) < 150 and all(len(p) <= 64 for p in pieces)


def test_scaled_frequencies():
    counts = np.concatenate((np.ones(5000, int), [10**9]))
    freq, bits = token_files.scaled(counts)
    assert freq.sum() == 1 << bits and freq.min() >= 1


@pytest.mark.parametrize("version", [1, 2])
def test_arc_layouts(version):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\npay\nload\n"
    stream = warc.arc_block(version, "a.arc") + warc.arc_record(version, "http://x/ü y", "20200102030405", block, 7, "a.arc") + warc.arc_block(3 - version, "b.arc") + warc.arc_record(3 - version, "http://z", "2021", b"plain", 0, "b.arc")
    first, second = warc.read_arc(stream)
    made = warc.synthesised(first)
    assert first["block"] == block and first["url"] == "http://x/%C3%BC%20y" and made["date"] == "2020-01-02T03:04:05Z"
    assert made["payload"] == b"pay\nload\n" and made["digest"] == base64.b32encode(hashlib.sha1(b"pay\nload\n").digest()).decode()
    assert second["block"] == b"plain" and warc.synthesised(second)["payload"] == b"plain"
    ((headers, back),) = warc.read_warc(warc.warc_record("response", made).split(b"\n"))
    assert back == block and headers["warc-record-id"] == f"<{made['record_id']}>"


@pytest.mark.parametrize("damage", [lambda s: s[:-20], lambda s: s.replace(b" 5\n", b" five\n"), lambda s: s.replace(b"1 0 lectern", b"9 0 lectern")])
def test_arc_errors(damage):
    stream = warc.arc_block(1, "a.arc") + warc.arc_record(1, "http://x", "2020", b"hello", 0, "a.arc")
    with pytest.raises(ValueError, match="ARC"):
        list(warc.read_arc(damage(stream)))


def test_archives_are_plain_gzip(spark, tables, tmp_path):
    import gzip

    path = str(tmp_path / "warc")
    warc.write_archives(warc.convert(warc.pages_to_arc(spark.read.parquet(f"{tables.full}/pages.parquet"))), "file://" + path)
    files = [f for f in (tmp_path / "warc").iterdir() if f.name.endswith(".gz")]
    records = [r for f in files for r in warc.read_warc(gzip.decompress(f.read_bytes()).split(b"\n"))]
    assert len(records) == len(tables.pages) and {h["warc-type"] for h, _ in records} == {"response", "revisit"}


def test_decontamination_in_blocks(spark, tables):
    docs, bench = (spark.read.parquet(f"{tables.full}/{t}.parquet") for t in ("documents", "benchmark"))
    names = ["doc_id", "n_words", "hit_from", "item_ids"]
    whole = fm_index.decontaminate(docs, bench).select(*names)
    parts = fm_index.decontaminate(docs, bench, block_bytes=40).select(*names)
    assert rows_of(whole) == rows_of(parts)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_benchmark_rows_without_id(spark, block_bytes):
    docs = spark.createDataFrame([(1, "so one two three then"), (2, "four five"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five"), (None, "four five"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in fm_index.removal_spans(fm_index.decontaminate(docs, bench, block_bytes=block_bytes)).collect()}
    assert {i: (len(r.hit_from), r.item_ids, r.clean_text) for i, r in got.items()} == {1: (3, [], "so  then"), 2: (2, ["7"], ""), 3: (0, [], "none")}


@pytest.mark.parametrize("most", [1, 20, 90, 10_000])
def test_parts_of_long_items_hold_all_windows(most):
    text = "Aé, b" + " word-é x1; ".join(str(k) for k in range(60))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower().encode())
    windows = lambda t: {tuple(w[k : k + 10]) for w in [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower().encode())] for k in range(len(w) - 9)}
    parts = list(fm_index._parts(text, 10, most))
    assert set().union(*map(windows, parts)) == windows(text) and len(words) > 60
    assert all(len(p.encode()) <= max(most, 120) or len(parts) == 1 for p in parts)


def test_fm_index_search_and_locate():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = fm_index.FMIndex(text, sample=7)
    for n in (1, 2, 3, 5):
        rows = np.unique(rng.integers(1, 5, (40, n)), axis=0)
        low, high = index.search(rows)
        for row, a, b in zip(rows, low, high, strict=True):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_line_rules():
    rules = quality_rules.LineRules()
    assert quality_rules.line_fails("a b c d e f g h", "a b c d e f g h".split(), rules)
    assert not quality_rules.line_fails("A clean line of some words ends so.", "A clean line of some words ends so.".split(), rules)
    assert quality_rules.line_fails("Home | News | About | Us", "Home | News | About | Us".split(), rules)
    assert quality_rules.line_fails("All rights reserved.", "All rights reserved.".split(), rules)
    text = "Good text stands here.\nHome | News | About | Us\nGood text stands here."
    assert quality_rules.clean(text, rules)[0] == "Good text stands here."


def test_mix_totals(spark, tables):
    got = mixing.mix(spark.read.parquet(f"{tables.repeated}/documents.parquet")).collect()
    total = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        total.setdefault(r.source, [0, r.target, 0])
        total[r.source][0] += r.taken
        total[r.source][2] += r.size
    for taken, target, size in total.values():
        assert abs(taken - target) <= 0.5 and target <= 2 * size + 1e-9
    assert abs(sum(t for _, t, _ in total.values()) - 1.5 * sum(s for _, _, s in total.values())) < 1e-6


def test_targets_clamp_and_reshare(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 100), ("c", 10_000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    assert got == {"a": 20, "b": 200, "c": 1.5 * 10_110 - 220, None: 0}


LARGER = "/root/testdata/sf0.1"


def held_out_scores(spark, query, label):
    got = query(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, rank = got[label].to_numpy() == 1, got.score.rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    return got, y, got.predicted.to_numpy() == 1, auc


def test_quality_classifier_held_out(spark):
    got, y, said, auc = held_out_scores(spark, subwords.op5_quality_classifier, "quality")
    assert got.score.between(0, 1).all()
    assert auc >= 0.99 and said[y].mean() >= 0.98 and (~said[~y]).mean() >= 0.98


def test_toxicity_held_out(spark):
    """Documents with a word that many toxic ones and no clean ones have are all found; some labels mark documents without anything of the kind, which bounds the plain recall."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: set(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in docs.join(labels, "doc_id", "left_semi").collect()}
    toxic, clean = {}, set()
    for r in labels.where(~noisy_channel.held_out()).collect():
        if r.toxic:
            for w in texts[r.doc_id]:
                toxic[w] = toxic.get(w, 0) + 1
        else:
            clean |= texts[r.doc_id]
    lexicon = {w for w, n in toxic.items() if n >= 40 and w not in clean}
    got, y, said, auc = held_out_scores(spark, noisy_channel.op10_toxicity, "toxic")
    named = np.array([bool(texts[i] & lexicon) for i in got.doc_id])
    assert len(lexicon) >= 5 and (y & named).sum() >= 40
    assert said[y & named].all() and (~said[~y]).mean() >= 0.99
    assert said[y].mean() >= 0.88 and auc >= 0.95


def hash_of(data):
    return int(kernels.range_hash(kernels.prefix_hash(kernels.BYTE_VALUE[np.frombuffer(data, np.uint8)]), np.array([0]), np.array([len(data)]))[0])


def mixed(value):
    return int(kernels.mix64(np.array([value % 2**64], np.uint64))[0])


def brute_quality(text, model):
    """A document's score from its features one by one."""
    words, buckets = WORD.findall(text.encode()), []
    hashes = [hash_of(w) for w in words]
    buckets += [h % subwords.BUCKETS for h in hashes]
    buckets += [(1 if a == b else mixed(a * 3 + b)) % subwords.BUCKETS for a, b in zip(hashes, hashes[1:], strict=False)]
    for w in words:
        chars = w.decode()
        for n in (3, 4):
            buckets += [hash_of(chars[k : k + n].encode()) * (0x9E3779B97F4A7C15 + 2 * n) % 2**64 >> 48 for k in range(len(chars) - n + 1)]
    logit = sum(model.table[b] for b in buckets) / max(1, len(buckets)) + model.bias
    return 1 / (1 + np.exp(-logit))


@pytest.mark.parametrize("which", ["full", "repeated"])
def test_quality_scores_brute(spark, tables, which):
    docs, labels = (spark.read.parquet(f"{getattr(tables, which)}/{t}.parquet") for t in ("documents", "labels"))
    model = subwords.fit(docs, labels)
    assert len(set(model.table.tolist())) > 100
    rows = tables.rows if which == "full" else tables.repeated_rows
    want = sorted(((i, brute_quality(t or "", model)) for i, t, _ in rows), key=str)
    got = sorted(((r.doc_id, r.score) for r in subwords.score(docs, model).collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted(g[1] for g in got) == pytest.approx(sorted(w[1] for w in want), abs=2e-9)


def brute_entries(word, longest=True):
    return {hash_of(word), *(mixed(hash_of(word[:n]) + n) for n in (4, 5, 6) if longest and len(word) > n)}


def brute_disguised(text):
    """Tokens and runs of single letters that may be disguised, found token by token."""
    letter = lambda c: "a" <= c <= "z" or ord(c) >= 128
    size = lambda s: len(s.encode())
    found, run = [], []
    tokens = []
    for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text):
        t = m[0]
        signs = [c in "0123456789" or c in noisy_channel.IMITATES for c in t]
        letters = [letter(c) for c in t]
        n_letters = sum(size(c) for c, x in zip(t, letters, strict=True) if x)
        alone = (n_letters == 1 or sum(signs) == 1) and size(t) <= 2
        marks = not n_letters and not any(signs) and size(t) <= 2
        tokens.append((m.start(), m.end(), t, n_letters, alone, alone or marks))
        ending = t[-1] in "@$!|+(<%#"
        solid = [x or y for x, y in zip(signs, letters, strict=True)]
        inner = any(not solid[k] and any(solid[:k]) and any(solid[k + 1 :]) for k in range(len(t)))
        twice = any(x == y and letter(x) for x, y in zip(t, t[1:], strict=False))
        if n_letters and (sum(signs) - ending >= 1 or inner or twice) and not alone:
            found.append(t)
        if not n_letters and sum(signs) >= 3 and sum(signs) > sum(c in "0123456789" for c in t) and not alone:
            found.append(t)

    def end_run(k):
        if sum(tokens[i][4] for i in run) >= 3:
            a, b = run[0], run[-1]
            near = lambda i: 0 <= i < len(tokens) and tokens[i][3] > 0 and size(tokens[i][2]) <= 4
            found.append(text[tokens[a][0] : tokens[b][1]])
            found.append(text[tokens[a - 1 if near(a - 1) else a][0] : tokens[b + 1 if near(b + 1) else b][1]])
        run.clear()

    for k, token in enumerate(tokens):
        if token[5]:
            run.append(k)
        else:
            end_run(k)
    end_run(len(tokens))
    return found


def brute_toxicity(text, model):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    known = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    hashes = set().union(*(brute_entries(w) for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.encode())))
    for token in brute_disguised(low):
        for piece in noisy_channel.pieces(token):
            for reading in noisy_channel.readings(piece, model.costs):
                parts = [p.encode() for p in reading.split(noisy_channel.GLUE) if p]
                for i in range(len(parts)):
                    for j in range(i + 1, len(parts) + 1):
                        hashes |= brute_entries(b"".join(parts[i:j]), longest=j == len(parts))
    total = min(noisy_channel._MOST, sum(known.get(h, 0.0) for h in hashes))
    return 1 / (1 + np.exp(-(model.slope * total + model.bias)))


def test_toxicity_scores_brute(spark):
    rng = np.random.default_rng(8)
    plain = ["the", "house", "stands", "near", "water", "and", "people", "walk", "there", "often", "é", "日本"]
    bad = ["idiot", "stupid", "1d10t", "s t u p i d", "id-iot", "stuuupid", "i.d.i.o.t", "such a i d i o t x"]
    texts = []
    for k in range(160):
        words = [plain[i] for i in rng.integers(0, 12, 25)] + [f"w{k}q{j}" for j in range(12)]
        if k % 4 == 0:
            words[int(rng.integers(0, 20))] = bad[0] if k < 80 else bad[k // 4 % 8]
        texts.append(" ".join(words))
    texts += ["", None, "a " * 40, "IDIOT!!! st.upid " + "x" * 200, "\x1c i\x1cdiot 1d¡0t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    model = noisy_channel.fit(docs, labels)
    assert len(model.hashes) and model.slope > 0
    got = {r.doc_id: r.score for r in noisy_channel.score(docs, model).collect()}
    want = {k: brute_toxicity(t or "", model) for k, t in enumerate(texts)}
    assert got == pytest.approx(want, abs=2e-9)
    assert len({round(v, 6) for v in want.values()}) > 1


@pytest.mark.parametrize("word", ["1d10t", "!d!ot", "i-d1t", "a.b", "aab", "x1", "¡i", "iiit", "@@s"])
def test_readings_are_the_cheapest(word):
    import itertools

    costs, edge = language(["idiot", "audio", "bat", "the", "ab"] * 20), noisy_channel.EDGE
    best = {}
    for path in itertools.product(*noisy_channel.lattice(word)):
        cost, a, b, text = 0.0, edge, edge, ""
        for c, fee in path:
            cost += fee
            if c == noisy_channel.GAP:
                if b == edge:
                    break
                cost, a, b, text = cost + costs[a, b, edge], edge, edge, text + noisy_channel.GLUE
            elif c == noisy_channel.GLUE:
                text += c
            elif c:
                k = noisy_channel.letter(c)
                cost, a, b, text = cost + costs[a, b, k], b, k, text + c
        else:
            cost += costs[a, b, edge] if b != edge else 0.0
            if text.strip(noisy_channel.GLUE):
                best[text] = min(cost, best.get(text, np.inf))
    want = [t for t, _ in sorted(best.items(), key=lambda x: x[1])]
    got = noisy_channel.readings(word, costs)
    assert [best[t] for t in got] == pytest.approx([best[t] for t in want[: len(got)]])


def test_samples_are_bounded(spark):
    from lectern.llm.labelled import sample

    docs = spark.createDataFrame([(k, "x" * 100) for k in range(200)] + [(k, "x" * 100) for k in range(50)] + [(300, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in [*range(200), 300]], "doc_id long, quality int")
    rows = sample(docs, labels, "quality", 1000, 4000).collect()
    assert len(rows) == 40 and len({r.doc_id for r in rows}) == 40 and all(len(r.text) == 100 for r in rows)
    assert len(sample(docs, labels, "quality", 7, 1 << 20).collect()) <= 7


def language(words):
    data = np.frombuffer((" ".join(words)).encode(), np.uint8)
    return noisy_channel.language_model(noisy_channel.trigram_counts(data, np.array([0, len(data)])))


@pytest.mark.parametrize("form", ["1d10t", "!d!ot", "id1ot", "idiiiot", "i d i o t", "i.d.i.o.t", "i-d-i-0-t", "1 d 1 0 t"])
def test_restores_disguised_words(form):
    costs = language(["idiot", "ridicule", "audio", "patriot", "the", "other"] * 40)
    assert "idiot" in noisy_channel.restore(form, costs)
    low = np.frombuffer(f"so {form} it is".encode(), np.uint8)
    docs, texts = noisy_channel.disguised(low, np.array([0, len(low)]))
    assert any("idiot" in noisy_channel.restore(t, costs) for t in texts) and set(docs.tolist()) == {0}


def test_disguised_toxic_words_are_found():
    rng = np.random.default_rng(1)
    plain = ["the", "house", "stands", "near", "water", "and", "people", "walk", "there", "often"]
    docs = []
    for k in range(300):
        words = [plain[i] for i in rng.integers(0, 10, 30)] + [f"w{k}x{j}" for j in range(3)]
        if k % 5 == 0:
            words[int(rng.integers(0, 30))] = "idiot"
        docs.append((int(k % 5 == 0), " ".join(words).encode()))
    costs = language([w for _, t in docs for w in t.decode().split()])
    memo = noisy_channel.Memo(costs)

    def hashes(text):
        low = kernels.LOWER[np.frombuffer(text, np.uint8)]
        return np.unique(np.concatenate([h for h, _ in noisy_channel.evidence(low, np.array([0, len(low)]), memo)]))

    model = noisy_channel.train([(y, hashes(t).tobytes()) for y, t in docs], costs, noisy_channel.Training())
    for text, toxic in ((b"near the 1D10T house", True), (b"an i d i o t there", True), (b"near the house", False), (b"house 12 and 500 people", False)):
        assert np.isin(hashes(text), model.hashes).any() == toxic


def found_in(text, words=("idiot", "stupid", "asshole"), corpus=("idiot", "stupid", "asshole", "such", "a", "the", "other", "patriot", "audio", "ridicule")):
    """Which of the words are among the entries of a text."""
    low = kernels.LOWER[np.frombuffer(text.encode(), np.uint8)]
    got = np.concatenate([h for h, _ in noisy_channel.evidence(low, np.array([0, len(low)]), noisy_channel.Memo(language(corpus * 40)))])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    hashes = next(noisy_channel.entries(data, np.concatenate(([0], ends[:-1])), ends))[0]
    return [w for w, h in zip(words, hashes, strict=True) if h in got]


@pytest.mark.parametrize("before", ["", "a ", "7 ", "x y ", " ".join("abcdefghijklmnopqrstuvwxyz" * 3) + " "])
@pytest.mark.parametrize("after", ["", " a", " 7", " " + " ".join("qrstuvw" * 9)])
def test_spaced_words_are_found_anywhere_in_a_run(before, after):
    assert found_in(f"such {before}i d i o t{after} it is") == ["idiot"]
    assert found_in(f"such {before}s t u p 1 d i d i 0 t{after} it is") == ["idiot", "stupid"]


@pytest.mark.parametrize("form", ["id" + "i" * 90 + "ot", "i" * 5000 + "d1ot", "id10" + "t" * 70, "-".join("suchapatriot" * 4 + "idiot"), ".".join("idiot" + "other" * 9), ".".join("thesuch" * 300 + "idiot" + "audio" * 300), "i" + "-" * 80 + "d-i-o-t", ".-.-".join("idiot"), (".-" * 10).join("idiot"), ("-." * 8).join("idi0t"), " .: ".join("id1ot")])
def test_long_disguised_words_are_found(form):
    assert found_in(f"so {form} it is") == ["idiot"]


@pytest.mark.parametrize("form", ["i  d  i  o  t", "i\nd\ti \n o t", "i / d / i / o / t", "i|d|i|o|t", "i d i ot", "s t u pid", "id i o t", "! d ! 0 7"])
def test_spaced_and_signed_words_are_found(form):
    assert ("stupid" if "pid" in form else "idiot") in found_in(f"so {form} it is")
    assert found_in("an @$$ and 455 there", words=("ass",), corpus=("ass", "the", "other")) == ["ass"] and found_in("455 there", words=("ass",), corpus=("ass", "the", "other")) == []


def test_squeezing_keeps_the_order_of_readings():
    costs = language(["idiot", "audio", "bat", "the", "ab"] * 20)
    for word in ("i.-.-d-i", "a..b", "!--1..t", "iiiiid", "a-b_.c", "..ab--"):
        assert noisy_channel.readings(noisy_channel.squeezed(word), costs, 1)[0].replace(noisy_channel.GLUE, "") == noisy_channel.readings(word, costs, 1)[0].replace(noisy_channel.GLUE, "")


def test_windows_of_long_words_overlap():
    word = "".join(chr(0x4E00 + k) for k in range(500))
    for size in (1, 64, 65, 96, 97, 500):
        got = noisy_channel.pieces(word[:size])
        assert max(map(len, got)) <= noisy_channel.MAX_WORD
        assert all(any(word[a : min(size, a + 32)] in p for p in got) for a in range(size))


@pytest.mark.parametrize("form,word", [("1d107", "idiot"), ("455h0l3", "asshole"), ("id-iot", "idiot"), ("st.upid", "stupid"), ("st-up-id", "stupid"), ("iddiot", "idiot"), ("¡diot", "idiot"), ("id:iot", "idiot"), ("(st'upid)", "stupid"), ("дуррак", "дурак")])
def test_slightly_disguised_words_are_found(form, word):
    assert found_in(f"so {form} it is", words=("idiot", "stupid", "asshole", "дурак")) == [word]


def test_language_model_counts_all_documents(spark):
    texts = [f"Some 0text {k} é " + "abcdefgh"[k % 8 :] for k in range(40)] + [None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    whole = [np.frombuffer((t or "").lower().encode(), np.uint8) for t in texts]
    counts = sum(noisy_channel.trigram_counts(t, np.array([0, len(t)])) for t in whole if len(t))
    assert np.allclose(noisy_channel.fit(docs, labels).costs, noisy_channel.language_model(counts))


@pytest.mark.parametrize("kind,pattern", [(kernels.TEXT_WORD, rb"[^\x20\x09-\x0D]+"), (kernels.ALNUM_WORD, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_word_bounds(kind, pattern):
    texts = ["", "a b", " é ñ\n", "x", "", "a1-b2 c", "end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    starts, ends, firsts = kernels.word_bounds(data, offsets, kind)
    for d, t in enumerate(texts):
        own = [data[a:b].tobytes() for a, b in zip(starts[firsts[d] : firsts[d + 1]], ends[firsts[d] : firsts[d + 1]], strict=True)]
        assert own == re.findall(pattern, t.encode())
