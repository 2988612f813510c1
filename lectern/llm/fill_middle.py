"""Fill-in-middle transformation by overlapping chunks.

A text is a sequence of units, each a run of ASCII letters or one other character.  A unit begins
wherever a character isn't a letter behind a letter, so whether one begins at a place is a predicate of
two adjacent characters.  Texts are cut into chunks of `CHUNK` bytes that overlap by the character before
them; units and characters that begin in a chunk are counted for all chunks at once, prefix sums over the
chunks of a document say in which of them a cut's rank lies, and only those chunks are scanned again for
the place.  No list of units is ever made, so a text of any length takes its own bytes and a few numbers
for each chunk.  Everything happens in the task that reads the text: no shuffle, one pass.

Two numbers drawn from a document's id place the cuts, two more choose its form.  ``psm`` is prefix,
suffix, middle behind their marks, ``spm`` is suffix, prefix, middle; ``plain`` is the text as it is: an
empty one, one that holds a mark already, or one that the draw leaves alone.  `restore` rebuilds a text
from its output and form alone.

Nulls: a null text is empty; a null id draws as an empty string of digits would.  An empty text has no
units, its form is plain.  Rows are independent of each other, so repeated rows get equal results, ties
can't arise, and an empty table gives an empty one.  Cuts may fall on the text's ends or on each other:
prefix, middle or suffix are then empty.  Extra columns are kept out unless they are to be carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as K

#: Bytes of a chunk, and of the chunks that are counted together.
CHUNK, TOGETHER = 1 << 13, 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


@dataclass(frozen=True)
class Draw:
    """How documents are cut: the seed before an id, and percentages of documents left alone and of spm among the others."""

    seed: str = "1:"
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def numbers(self, doc_id) -> tuple[int, int, int, int]:
        digits = hashlib.sha256(f"{self.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))


def _begins(data: np.ndarray, a: int, b: int, first: bool) -> np.ndarray:
    """Whether a unit begins at each byte of data[a:b]; the byte before a is looked at unless the text begins there."""
    letter = _LETTER[data[a - (not first) : b]]
    out = _LEADS[data[a:b]]
    if first:
        out[1:] &= ~(letter[1:] & letter[:-1])
    else:
        out &= ~(letter[1:] & letter[:-1])
    return out


class Chunks:
    """Units and characters that begin before each chunk of a slice of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        per = -(-np.diff(offsets) // CHUNK)
        self.first = np.concatenate(([0], np.cumsum(per)))  # a document's first chunk; n + 1 values
        self.starts = np.repeat(offsets[:-1], per) + (np.arange(self.first[-1]) - np.repeat(self.first[:-1], per)) * CHUNK
        units, chars = np.zeros(len(self.starts), np.int64), np.zeros(len(self.starts), np.int64)
        edges = np.append(self.starts, len(data))
        at, texts = 0, offsets[:-1][per > 0]
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + TOGETHER, side="right")) - 1)
            a, b = int(edges[at]), int(edges[to])
            begins = _begins(data, a, b, a == 0)
            heads = texts[np.searchsorted(texts, a) : np.searchsorted(texts, b)]
            begins[heads - a] = _LEADS[data[heads]]  # the letter before it is another text's
            units[at:to] = np.add.reduceat(begins, edges[at:to] - a, dtype=np.int64)
            chars[at:to] = np.add.reduceat(_LEADS[data[a:b]], edges[at:to] - a, dtype=np.int64)
            at = to
        self.units, self.chars = np.concatenate(([0], np.cumsum(units))), np.concatenate(([0], np.cumsum(chars)))

    def n_units(self) -> np.ndarray:
        return np.diff(self.units[self.first])

    def cut(self, doc: int, rank: int) -> tuple[int, int]:
        """The byte (in the slice) at which a document's unit of this rank begins, its end for the rank past the last; and the characters before it."""
        a, z = int(self.first[doc]), int(self.first[doc + 1])
        base, start, end = int(self.units[a]), int(self.offsets[doc]), int(self.offsets[doc + 1])
        if rank >= int(self.units[z]) - base:
            return end, int(self.chars[z] - self.chars[a])
        own = int(np.searchsorted(self.units[a : z + 1], base + rank, side="right")) - 1 + a
        at = int(self.starts[own])
        begins = _begins(self.data, at, min(at + CHUNK, end), at == start)
        inside = int(np.flatnonzero(begins)[base + rank - int(self.units[own])])
        before = int(self.chars[own] - self.chars[a]) + int(np.count_nonzero(_LEADS[self.data[at : at + inside]]))
        return at + inside, before


def fill_in_middle(docs: DataFrame, draw: Draw | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns to carry, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    draw = draw or Draw()
    own = ["doc_id", *(carry or [])]
    marks = tuple(m.encode() for m in (draw.prefix, draw.suffix, draw.middle))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.slices(batches):
            chunks = Chunks(data, offsets)
            units = chunks.n_units().tolist()
            forms, before, between, out = [], [], [], []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                n, a, z = units[k], int(offsets[k]), int(offsets[k + 1])
                text = data[a:z].tobytes()
                h1, h2, h3, h4 = draw.numbers(doc_id)
                if not n or h3 % 100 >= 100 - draw.plain_percent or any(m in text for m in marks):
                    forms.append("plain")
                    before.append(None)
                    between.append(None)
                    out.append(text)
                    continue
                ranks = h1 % (n + 1), h2 % (n + 1)
                (p, p_chars), (m, m_chars) = chunks.cut(k, min(ranks)), chunks.cut(k, max(ranks))
                prefix, middle, suffix = text[: p - a], text[p - a : m - a], text[m - a :]
                spm = h4 % 100 < draw.spm_percent
                forms.append("spm" if spm else "psm")
                before.append(p_chars)
                between.append(m_chars - p_chars)
                out.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)))
            columns = [pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *columns], names=[*own, "n", "form", "prefix_chars", "middle_chars", "output"])
        K.trim()

    added = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    return docs.select(*dict.fromkeys([*own, "text"])).mapInArrow(work, T.StructType([*(docs.schema[c] for c in own), *added.fields]))


def restore(output: Column | str, form: Column | str, draw: Draw | None = None) -> Column:
    """The text behind an output: native, and exact, since a text that is cut holds no mark and parts can't make one at their seams."""
    draw = draw or Draw()
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    quoted = "|".join(rf"\Q{m}\E" for m in (draw.prefix, draw.suffix, draw.middle))
    parts = F.split(output, quoted)  # what stands before the first mark is empty
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Cuts, forms, and digests of outputs and of the texts rebuilt from them, for every document."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
ranked AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cut AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""
