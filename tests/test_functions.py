"""Scalar functions, gates, chunking, sources: hand-made cases and plain Python versions."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions import gates
from lectern.functions import text as T
from lectern.operators import chunking, vectors
from lectern.sources import html, pdf


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in given.items())) if given else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("given,want", [("a\nb\tc", "a b c"), ("  hello  ", "hello"), ("a 　b\x1cc", "a b c"), (None, ""), ("", "")])
def test_normalize_ws(spark, given, want):
    assert value(spark, T.normalize_ws("x"), x=given) == want


@pytest.mark.parametrize("given,want", [("example.com", "https://example.com"), ("  https://example.com  ", "https://example.com"), ("http://a", "http://a"), ("  ", ""), (None, ""), ("HTTP://a", "https://HTTP://a")])
def test_normalize_url(spark, given, want):
    assert value(spark, T.normalize_url("x"), x=given) == want


@pytest.mark.parametrize("given,want", [("Hello world. How are you? I am fine!", ["Hello world.", "How are you?", "I am fine!"]), ("no end", ["no end"]), ("", []), ("a.b c. d", ["a.b c.", "d"])])
def test_split_sentences(spark, given, want):
    assert value(spark, T.split_sentences("x"), x=given) == want


@pytest.mark.parametrize("score,want", [(0.30, "strong match"), (0.25, "strong match"), (0.15, "partial match"), (0.08, "partial match"), (0.05, "weak match")])
def test_match_label(spark, score, want):
    assert value(spark, T.match_label("x"), x=score).label == want


@pytest.mark.parametrize("given,want", [
    ("", True), ("Too short", True), ("\\[ x = \\frac{1}{2} + a long enough formula here \\]", True), ("A sentence with the sign − that is long enough to pass.", True),
    ("This is a perfectly normal sentence with enough length.", False), ("An ordinary sentence where x = 5 holds for all of them.", False),
])
def test_is_noise(spark, given, want):
    assert value(spark, T.is_noise_sentence("x"), x=given) is want


def test_latex(spark):
    assert value(spark, T.strip_leading_latex("x"), x="\\[ E = mc^2 \\] Some text after.") == "Some text after."
    assert value(spark, T.remove_latex("x"), x="A \\[ x \\] B \\[ y\nz \\] C") == "A B C"


def test_clean_raw_passage(spark):
    given = "Key Result: it works\n\nsum ∑ here\n\\[ z \\]\n8.9 Heading here\nend of it"
    assert value(spark, T.clean_raw_passage("x"), x=given) == "it works\n\nend of it"
    long = value(spark, T.clean_raw_passage("x"), x="word " * 200)
    assert len(long) <= 501 and long.endswith("word…")


def test_attribution_and_escape(spark):
    assert value(spark, T.attribution(F.lit("Methods"), F.lit(3))) == "§ Methods  ·  p. 3"
    assert value(spark, T.attribution(F.lit(""), F.lit(None).cast("int"))) == ""
    assert value(spark, T.html_escape("x"), x="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"


def test_format_extractive(spark):
    assert value(spark, T.format_extractive(F.array(F.lit("One."), F.lit("Two.")), F.lit("p. 3"))) == "One. Two.\n\nEvidence: (p. 3)"
    assert value(spark, T.format_extractive(F.array().cast("array<string>"), F.lit(""))) == T.CANNOT


def test_as_text(spark):
    assert value(spark, T.as_text(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), "array")) == "a b"
    assert value(spark, T.as_text(F.lit(42))) == "42" and value(spark, T.as_text("x"), x=None) == ""


def test_gates(spark):
    evidence = "The reactor reached criticality after seven hours of operation."
    good = "The reactor reached criticality ;("
    assert value(spark, gates.hosted_answer("a", "e"), a="[INST] x [/INST] " + good, e=evidence) == good[:-3].strip()
    assert value(spark, gates.hosted_answer("a", "e"), a="reactor reactor reactor hours", e=evidence) is None
    assert value(spark, gates.hosted_answer("a", "e"), a="Completely unrelated statement entirely", e=evidence) is None
    assert value(spark, gates.hosted_answer("a", "e"), a="hours", e=evidence) is None
    assert value(spark, gates.local_answer("a", "e"), a="reactor op", e=evidence) == "reactor op"
    assert value(spark, gates.overlap_ratio("a", "e"), a="", e=evidence) == 0.0


def dedup_plain(text, least=40):
    seen, out = set(), []
    for line in text.splitlines():
        line = line.strip()
        key = " ".join(line.split()).lower()
        if line and (len(key) < least or key not in seen):
            out.append(line)
        if line and len(key) >= least:
            seen.add(key)
    return "\n".join(out)


def chunks_plain(text, size, overlap, least=20):
    """Chunks from first principles: words of paragraphs run together, windows cut from the front."""
    out, run = [], []
    for para in (p.split() for p in text.split("\n") if p.strip()):
        if run and len(run) + len(para) > size:
            out.append(run)
            run = run[-overlap:]
        run = run + para
        while len(run) > int(size * 1.5):
            out.append(run[:size])
            run = run[size - overlap :]
    if run:
        out.append(run)
    return [c for c in map(" ".join, out) if len(c.strip()) >= least]


def test_dedup_and_chunks_on_random_texts(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice((1, 3, 12, 30, 200)))) for _ in range(30)]
    texts = ["\n".join(rng.choice(pool) + rng.choice(("", " ", "  x")) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", "  \n ", "tiny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    long = {r.doc_id: r.text for r in chunking.dedup_long(df).collect()}
    for cfg in (Settings(chunk_size=20, overlap=5), Settings(chunk_size=50, overlap=5), DEFAULT):
        for r in df.select("doc_id", "text", chunking.dedup_paragraphs("text").alias("d"), chunking.chunk_array("text", cfg).alias("c")).collect():
            assert r.d == dedup_plain(r.text) == long[r.doc_id]
            assert r.c == chunks_plain(r.text, cfg.chunk_size, cfg.overlap)


def test_chunk_counts(spark):
    one = value(spark, chunking.chunk_array("x", Settings(chunk_size=100, overlap=10)), x=" ".join(["word"] * 1000))
    assert [len(c.split()) for c in one] == [100] * 11
    two = value(spark, chunking.chunk_array("x", Settings(chunk_size=50, overlap=5)), x="\n".join(f"word{k}" for k in range(200)))
    assert [len(c.split()) for c in two] == [50, 50, 50, 50, 20]
    assert all(b.split()[:5] == a.split()[-5:] for a, b in zip(two, two[1:], strict=False))


def test_chunks_with_maps(spark):
    docs = spark.createDataFrame([("k", " ".join(["word"] * 400), {0: "A", 2: "B"}, {1: 7})], "kb_id string, text string, section_map map<int,string>, page_map map<int,int>")
    got = chunking.chunks(docs, Settings(chunk_size=100, overlap=10)).orderBy("chunk_idx").collect()
    assert [(r.section, r.page) for r in got][:4] == [("A", None), ("A", 7), ("B", 7), ("B", 7)]
    assert got[0].embed_text.startswith("A. word")


@pytest.mark.parametrize("bad", [{"overlap": 0}, {"overlap": 800}, {"alpha": 1.5}, {"mode": "other"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError, match=".+"):
        Settings(**bad)


def test_fingerprint_follows_what_an_index_needs():
    assert Settings(alpha=0.5).fingerprint() == DEFAULT.fingerprint() != Settings(chunk_size=700).fingerprint()


def mmr_plain(pool, k=3, min_rel=0.2, weight=0.72, most=650):
    left, taken, total = [i for i, p in enumerate(pool) if round(p[0], 9) >= min_rel], [], 0
    while left and len(taken) < k and total < most:
        score = lambda i: round(weight * pool[i][0] - (1 - weight) * max([sum(a * b for a, b in zip(pool[i][1], pool[j][1], strict=True)) for j in taken], default=0.0), 9)
        best = max(left, key=lambda i: (score(i), -i))
        if taken and total + 1 + pool[best][2] > most:
            break
        taken.append(best)
        total += pool[best][2] + 1
        left.remove(best)
    return sorted(taken)


def test_mmr_on_random_pools(spark):
    rng = random.Random(9)
    pools = [[(rng.random(), [rng.random() for _ in range(3)], rng.choice((40, 200, 400, 700))) for _ in range(rng.randint(0, 9))] for _ in range(80)]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pools)], "k int, p array<struct<rel:double,emb:array<double>,chars:int>>")
    for r in df.select("k", vectors.mmr("p").alias("c")).collect():
        assert r.c == mmr_plain(pools[r.k])


PAGE = """<html><head><title>Title here</title><style>x{}</style></head><body><nav>menu<p>in nav</p></nav><h1>Main <b>head</b></h1>
<p>First &amp; best <i>part</i></p><div><p>Inner</p></div><h2>Next</h2><ul><li>Item one that is quite long so that the page passes the guard of text length</li></ul>
<p>open paragraph<p>nested one</p><pre>code</pre><!-- no --><footer>foot</footer></body></html>"""


def test_html_tree():
    text, sections, err = html.read_page(PAGE)
    assert err == "" and "menu" not in text and "foot" not in text and "no -->" not in text
    assert text.split("\n")[:6] == ["Title here", "Main", "head", "First & best", "part", "Inner"]
    # leaf paragraphs in order: in nav (no heading yet), first, inner, item, nested, pre; the open paragraph is an outer one
    assert sections == {1: "Mainhead", 2: "Mainhead", 3: "Next", 4: "Next", 5: "Next"}
    assert html.read_page("<p>short</p>") == ("", {}, html.TOO_SHORT) and html.read_page(None)[2]


class Pages:
    def pages(self, content):
        if content == b"bad":
            raise ValueError("broken")
        return [("INTRODUCTION\nThis line has enough text to count as a page.", []), ("", [(0.0, 1.0, "from blocks " * 5)]), ("tiny", [])]


def test_pdf_flow(spark):
    files = spark.createDataFrame([("a", bytearray(b"ok"), 2), ("b", bytearray(b"bad"), 3), ("c", bytearray(b""), 60 << 20)], "path string, content binary, length long")
    pages = pdf.parse_pages(pdf.within_limit(files), Pages)
    got = {r.path: r for r in pdf.assemble(pdf.page_texts(pages)).collect()}
    assert got["a"].text == "INTRODUCTION\nThis line has enough text to count as a page.\n\n" + ("from blocks " * 5).strip() and got["a"].err == ""
    assert got["a"].section_map == {0: "INTRODUCTION"} and got["a"].page_map == {0: 1, 2: 2, 3: 3}
    assert got["b"].err == "PDF parse error: broken" and got["b"].text == "" and got["c"].err.startswith("PDF exceeds the 50 MB")
    read = pdf.page_texts(pages, F.when(F.col("page") == 3, "TEXT READ BY OCR, long enough for a page of it")).where("path = 'a'")
    assert pdf.assemble(read).first().err == pdf.OCR_NOTE
    assert pdf.assemble(pdf.page_texts(pdf.parse_pages(pdf.within_limit(files), None))).where("path = 'a'").first().err == pdf.NO_PARSER


@pytest.mark.parametrize("n,want", [(39, True), (40, False)])
def test_scanned_threshold(spark, n, want):
    assert value(spark, T.looks_scanned("x"), x=" " + "a" * n + "\n") is want


def test_url_loading_with_errors(spark):
    class Fetch:
        def fetch(self, url):
            return (PAGE, "") if "good" in url else ("", html.fetch_error("http", "404"))

    urls = spark.createDataFrame([("good.example",), ("bad.example",), ("",)], "url string")
    got = {r.url: r for r in html.load_urls(urls, Fetch).collect()}
    assert got["https://good.example"].err == "" and got["https://bad.example"].err.startswith("HTTP 404") and got[""].err == html.NO_URL
    assert re.search("15s", html.fetch_error("timeout")) and html.fetch_error("connection")


def test_pdf_files_over_the_limit_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"x" * 50)
    cfg = Settings(pdf_max_bytes=20)
    got = {r.path.rsplit("/", 1)[1]: r for r in pdf.load_pdfs(spark, f"file://{tmp_path}", Pages, cfg=cfg).collect()}
    assert got["a.pdf"].err == "" and got["a.pdf"].page_map and got["b.pdf"].err.startswith("PDF exceeds the 0 MB") and got["b.pdf"].section_map == {}
    plan = spark.read.format("binaryFile").load(f"file://{tmp_path}").where(F.col("length") <= 20)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,20)]" in plan
    monkeypatch.setattr(pdf, "installed_parser", lambda: None)
    assert pdf.load_pdfs(spark, f"file://{tmp_path}/a.pdf").first().err == pdf.NO_PARSER


class Scans(Pages):
    def ocr(self, content, page):
        return f"TEXT OF PAGE {page}, read from its image and long enough to count"


def test_parsers_that_read_images(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    got = pdf.load_pdfs(spark, f"file://{tmp_path}", Scans).first()
    assert got.err == pdf.OCR_NOTE and "TEXT OF PAGE 3" in got.text and "TEXT OF PAGE 1" not in got.text and "TEXT OF PAGE 2" not in got.text


def test_chunks_are_computed_once(spark):
    docs = spark.createDataFrame([("k", "word " * 400)], "kb_id string, text string")
    plan = chunking.chunks(docs, Settings(chunk_size=100, overlap=10))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_headings_with_any_space(spark):
    assert value(spark, T.is_heading("x"), x="2.1\u00a0Results") is True
    assert value(spark, T.is_heading("x"), x="2.1\tResults") is True


def test_text_of_templates_is_left_out():
    page = "<html><body><template>hidden</template><ruby>kan<rp>(</rp><rt>reading</rt></ruby><p>" + "enough text for a page " * 6 + "</p></body></html>"
    text = html.read_page(page)[0]
    assert "hidden" not in text and "reading" not in text and "(" not in text and "kan" in text


class Tree(HTMLParser):
    """A page as nested lists [name, children], built first and walked afterwards."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["", []]
        self.path = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.path[-1][1].append(node)
        if tag not in html.VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        names = [n[0] for n in self.path]
        if tag in names[1:]:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.path[-1][1].append(data)


def page_plain(source):
    """Text and sections by walks over the whole tree."""
    root = Tree(source).root

    def names_below(node):
        return {x for c in node[1] if not isinstance(c, str) for x in {c[0], *names_below(c)}}

    def strings(node):
        return [s for c in node[1] for s in ([c.strip()] if isinstance(c, str) else strings(c)) if s]

    def visible(node):
        for c in node[1]:
            if isinstance(c, str):
                if c.strip() and node[0] not in html.UNREAD:
                    yield c.strip()
            elif c[0] not in html.NOISE:
                yield from visible(c)

    found, heading, at = {}, "", 0

    def walk(node):
        nonlocal heading, at
        for c in node[1]:
            if isinstance(c, str):
                continue
            if c[0] in {f"h{k}" for k in range(1, 7)}:
                heading = "".join(strings(c))
            elif c[0] in ("p", "li", "td", "div", "blockquote", "pre") and not names_below(c) & {"p", "li", "td", "div", "blockquote"}:
                if heading:
                    found[at] = heading
                at += 1
            walk(c)

    walk(root)
    text = "\n".join(visible(root)).strip()
    return (text, found, "") if len(text) >= 100 else ("", {}, html.TOO_SHORT)


def test_pages_against_a_tree():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pandas().html.tolist()
    rng = random.Random(6)
    tags = ["p", "div", "h1", "h3", "li", "td", "nav", "script", "br", "pre", "span", "template", "button", "rt"]
    for _ in range(400):
        pages.append("".join(rng.choice((f"<{(t := rng.choice(tags))}>", f"</{t}>", f"some words number {rng.randint(0, 99)} &amp; more ", "<br/>", "<!-- c -->")) for _ in range(rng.randint(3, 60))))
    made = [html.read_page(p) for p in pages]
    assert made == [page_plain(p or "") for p in pages]
    assert sum(bool(s) for _, s, _ in made) > 50


def test_clean_passage_cases(spark):
    """Each rule alone, with Unicode spaces and digits."""
    cases = {
        "Note:\u00a0kept text": "kept text", "No label:here": "No label:here", "A\u2003B: both": "both", "\u0663.\u0664 Heading: rest": ": rest", "x 1.2 y": "x", "1 y": "1 y",
        "a\\[ b \n c \\]d": "ad", "line\n\n \u2003\nother": "line\n\nother", "sum \u2211 gone\nstays": "stays", "see 8.9 The Heading. After it": "see . After it", "": "", "Word: ": "Word:",
    }
    rows = spark.createDataFrame(list(cases.items()), "given string, want string")
    got = {r.given: r.v for r in rows.select("given", T.clean_raw_passage("given").alias("v")).collect()}
    assert got == cases


def test_normalising_and_sentences_against_python(spark):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas().text.tolist() + ["a\x85b\u2028c\x1cd \u3000 e. f!\xa0g?h", "\x1f", "One.\u2003Two? three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.normalize_ws("t").alias("n"), T.split_sentences("t").alias("s"), T.words("t").alias("w"))
    for r in rows.collect():
        words = texts[r.k].split()
        assert r.w == words and r.n == " ".join(words) and r.s == [s for s in re.split(r"(?<=[.!?])\s+", " ".join(words)) if s]
