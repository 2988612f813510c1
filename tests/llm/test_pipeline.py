"""The pipeline against a brute-force version, stage by stage, and on awkward tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lectern.llm import quality_rules, token_files

TEXT_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def without_passages(text, bench):
    """The text without runs of words that occurrences of benchmark windows cover."""
    words = list(ITEM_WORD.finditer(lowered(text)))
    names = [m[0] for m in words]
    hit = set()
    for _, item in bench:
        own = ITEM_WORD.findall(lowered(item or ""))
        for k in range(max(1, len(own) - 9) if own else 0):
            w = own[k : k + 10]
            for p in range(len(names) - len(w) + 1):
                if names[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
    out, at, k = [], 0, 0
    while k < len(words):
        if k in hit:
            j = k
            while j + 1 in hit:
                j += 1
            out.append(text[at : words[k].start()])
            at, k = words[j].end(), j
        k += 1
    return "".join(out) + text[at:]


def kept_lines(text):
    """The text without failing lines, or None if the rules reject it: the module's rules, said again."""
    text = text or ""
    words = TEXT_WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(set(windows)) < len(windows) else ()
    if len(words) < 50 or 2 * len(repeated) > len(words):
        return None
    kept, seen, lost = [], [], 0
    for line in text.split("\n"):
        own = TEXT_WORD.findall(line)
        n = len(own)
        shouted = sum(bool(re.search(r"([#*$%&|<>]+|!!+|\?\?+)$", w)) for w in own)
        menu = sum(w in quality_rules.SEPARATORS for w in own)
        phrase = n <= 20 and any(p in line.replace("\u0130", "i").lower() for p in quality_rules.PHRASES)
        fails = line in seen or (n >= 8 and not set(line) & set(".!?…。！？")) or (shouted >= 2 and shouted >= 0.3 * n) or (menu >= 3 and menu >= 0.2 * n) or phrase
        if own and fails:
            lost += sum(map(len, own))
        else:
            kept.append(line)
        if own:
            seen.append(line)
    return "\n".join(kept) if lost <= 0.5 * sum(map(len, words)) else None


def fingerprint(text):
    words = TEXT_WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def mixed(rows):
    """For rows (id, text, source): (id, whole copies, words of a part, size), by water-filling in rounds."""
    sizes = [len(TEXT_WORD.findall(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in sources}
    target, left, free = {}, 1.5 * sum(sizes), list(sources)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    out = []
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = round(target[s] - whole * total[s])
        own = [(hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), i, n) for (i, _, src), n in zip(rows, sizes, strict=True) if src == s]
        for _, i, n in sorted(own):
            part = max(0, min(n, rest))
            rest -= part
            out.append((i, whole, part, n))
    return out


def brute(rows, bench):
    kept = sorted((i, clean, source) for i, text, source in rows if (clean := kept_lines(text)) is not None)
    marks = [fingerprint(t) for _, t, _ in kept]
    label = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(a):
                if (marks[a] ^ marks[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    stay = [r for k, r in enumerate(kept) if label[k] == k]
    clean = [(i, without_passages(t, bench), s) for i, t, s in stay]
    texts, copies = {i: t for i, t, _ in clean}, []
    for i, whole, part, size in mixed(clean):
        copies += [(i, texts[i])] * (whole + (part >= size > 0))
        if 0 < part < size:
            copies.append((i, " ".join(TEXT_WORD.findall(texts[i])[:part])))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    out = []
    for i, t in copies:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tables):
    got = corpus_pipeline.run(spark, tables.full).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == brute(tables.rows, tables.bench)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)


@pytest.mark.parametrize("which", ["empty", "repeated"])
def test_stages_keep_columns(spark, tables, which):
    where = getattr(tables, which)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == names and out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert all(r["_row"] == 7 and r["n_words"] == "x" for r in rows)
        assert bool(rows) == (which == "repeated")
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, where).count() == docs.count()
