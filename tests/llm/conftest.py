import random
from types import SimpleNamespace

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("n_words", pa.string()), ("_row", pa.int64()), ("fp", pa.string()), ("hit_from", pa.string())])


def documents(rows):
    """Rows (doc_id, text, source) with extra columns whose names clash with the operators' own."""
    return pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": None if (i or 0) % 5 == 0 else "en", "source": s, "n_chars": len(t or ""), "n_words": "x", "_row": 7, "fp": "f", "hit_from": None} for i, t, s in rows], schema=DOC_SCHEMA)


def corpus(seed=3):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, ties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    texts = ["\n".join(sentence(rng.randint(5, 14)) for _ in range(rng.randint(4, 12))) for _ in range(24)]
    passage = sentence(30)
    for k in range(0, 24, 3):
        texts[k] += "\n" + passage
    texts += [texts[1], texts[1], texts[4] + " extra.", "Dear " + texts[5][3:], texts[6][:200] + "X" + texts[6][201:]]
    texts += [None, "", " \n\t ", "one", "two words", " ".join(["same"] * 400), "x" * 5000, "ÄÖÜ " * 30, "\n".join([sentence(9)] * 6)]
    odd = [sentence(9)[:-1].replace(" ", c) + " " + sentence(9) for c in "\xa0\u3000\x1c\x1f\u2028"]
    texts += ["\n".join(odd * 2 + [sentence(12) for _ in range(6)]), "\r".join(odd) + " TOUS DROITS RÉSERVÉS\n" + "\n".join(sentence(10) for _ in range(8)) + "\nTous Droits Réservés.\nAccept cookİes.\nClicK here. \u212a"]
    texts += [" | ".join(vocab[:40]), "A\x0bb\x0cc\rd\x1ce  f g", "\n".join(sentence(12) for _ in range(900))]
    return [(i * 2 + 1, t, f"src{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    """A folder of small tables, the same as DuckDB views, and folders of empty and of repeated rows."""
    rng = random.Random(5)
    rows = corpus()
    rng.shuffle(rows)
    bench = [(1, rows[3][1] or "none"), (2, "short one here"), (3, None), (4, " ".join((rows[8][1] or "a b").split()[5:25])), (10, "!!"), (4, "two words"), (None, "dear "), (None, " ".join((rows[12][1] or "c d").split()[1:9]))]
    bench += [(20 + k, " ".join(t.split()[2:16])) for k, (_, t, _) in enumerate(rows) if t and len(t.split()) > 30][:8]
    pages = [(3, "http://a.example/x y?z", "<p>é</p>"), (1, None, None), (2, "http://b.example", "<p>é</p>"), (9, "http://c.example", ""), (5, "ftp://d", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\nx"), (6, "http://e", "a\nb\r\nc\r\n\r\n"), (7, "http://f", "<p>é</p>"), (8, "", "z" * 300_000)]
    labels = [(r[0], None if k % 9 == 0 else int(k % 3 > 0), int(k % 4 == 0)) for k, r in enumerate(rows)]

    def write(name, docs, pages, bench, labels):
        where = tmp_path_factory.mktemp(name)
        pq.write_table(documents(docs), where / "documents.parquet")
        pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "digest": pa.array([None] * len(pages), pa.string())}), where / "pages.parquet")
        pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": pa.array([b[1] for b in bench], pa.string()), "doc_id": pa.array([None] * len(bench), pa.int64())}), where / "benchmark.parquet")
        pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), where / "labels.parquet")
        return str(where)

    full = write("full", rows, pages, bench, labels)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{full}/{t}.parquet'")
    repeated = [*rows, *rows[:10], (None, rows[2][1], "src1"), (None, None, None), (rows[4][0], "another text " * 30, "src2")]
    return SimpleNamespace(
        rows=rows, bench=bench, pages=pages, labels=labels, full=full, con=con, repeated_rows=repeated,
        empty=write("empty", [], [], [], []), repeated=write("repeated", repeated, [*pages, *pages[:3], (None, "http://n", "<p>é</p>"), (None, None, None)], [*bench, bench[0]], labels),
    )
