"""SentencePiece encoding by a table of prefixes, and decoding.

The model is of merge type: adjacent pieces whose joined text is a piece merge, best score first and of
equal scores the leftmost.  Two facts make a table enough.  The pieces of a text's prefix that ends
between two of its pieces are the first of its pieces, so each prefix has one last piece; and a sequence of
pieces is what merging gives just when each two neighbours are, taken alone.  So for every prefix the one
last piece is, among the pieces that an Aho-Corasick automaton finds to end there, that which merging
leaves whole behind the last piece of the prefix before it (`Table.compatible`, remembered by pair).  Ids
are then read off from the end backwards.  The greedy merge itself runs on two pieces only.

White space becomes the piece mark, and a text gets one before it.  Text without pieces (characters that
no piece holds) goes out as its UTF-8 bytes' ids.  No piece holds a mark behind another character, which
is checked when a model is loaded, and most join neither letters with other characters nor digits with
each other; texts are parted where no piece can reach across (`_parts`).  Parts are encoded one by one,
and a worker remembers them in a memo of two generations that is bounded by its bytes.  A part of any
length goes through the table at once.

Models other than merge models with byte fallback and without normalising rules are refused.

Nulls: a null text is empty and has no ids.  Rows are independent of each other, so repeated rows get
equal results, ids may be null or repeat, and an empty table gives an empty one.  Ties can't arise beyond
equal scores.  Texts of any length are coded whole.  Extra columns are kept out unless they are to be carried.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as K

MARK = "▁"
#: Stands for the last piece of an empty prefix.
NONE = (1 << 31) - 1
#: Bytes of a worker's memo of parts, what an entry needs besides its text and ids, the longest part it keeps, and how many pairs are remembered.
MEMO_BYTES, ENTRY_BYTES, LONGEST_PART, MOST_PAIRS = 256 << 20, 180, 64, 1_000_000
#: Parts whose tables are filled together.
TOGETHER = 1 << 15


def _parts(pieces) -> str:
    """A pattern that parts texts, marks written as spaces, where no piece reaches across.

    Characters are of one class if they stand next to each other in some piece, or through others that do.
    A part is marks with characters of one class behind them; a character that no piece joins to another is a part.
    """
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    joined = set()
    for piece in pieces:
        body = piece.lstrip(MARK)
        joined.update(body if len(piece) > 1 else "")
        for c in body[1:]:
            root[top(c)] = top(body[0])
    classes: dict[str, str] = {}
    for c in sorted(joined):
        classes[top(c)] = classes.get(top(c), "") + c
    some = "|".join(f"[{re.escape(chars)}]+" for chars in sorted(classes.values(), key=len, reverse=True))
    return f" *(?:{some})| +|." if some else "(?s).+"


class Table:
    """Pieces with their scores and ids, and the pairs that merging leaves apart."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int]) -> None:
        import ahocorasick

        self.scores, self.byte_ids = scores, byte_ids
        self.known = frozenset("".join(ids))
        if any(c not in ids for c in self.known) or any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("every character of a piece has to be a piece, and marks have to lead")
        self.text = {k: p for p, k in ids.items()} | {NONE: ""}
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)  # the same, sorted, as far as batches have asked
        self.gap = next(c for c in map(chr, range(0x110000)) if c not in self.known)
        self.find = ahocorasick.Automaton()
        for piece, k in ids.items():
            if self.merged(piece) == [piece]:  # others are never reached
                self.find.add_word(piece, k << 8 | len(piece))
        self.find.make_automaton()
        self.pattern = re.compile(_parts(ids), re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves two pieces as they are when they stand next to each other; remembered."""
        a, b = self.text[left], self.text[right]
        got = self.pairs[left << 32 | right] = not a or self.merged(a + b) == [a, b]
        return got

    def last_pieces(self, text: str) -> tuple[list[int], list[int]]:
        """For each prefix of a text of known characters its last piece, and that piece's length."""
        last, size, pairs = [NONE] + [-1] * len(text), [0] * (len(text) + 1), self.pairs
        for end, value in self.find.iter(text):
            end, piece, length = end + 1, value >> 8, value & 255
            if last[end] < 0:
                left = last[end - length]
                fits = pairs.get(left << 32 | piece)
                if self.compatible(left, piece) if fits is None else fits:
                    last[end], size[end] = piece, length
        return last, size

    def known_ids(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        last, size = self.last_pieces(text)
        at, out = len(text), []
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def part_ids(self, part: str) -> list[int]:
        """Ids of any text in which marks stand as marks."""
        known = self.known
        if known.issuperset(part):
            return self.known_ids(part)
        out, at = [], 0
        while at < len(part):
            end = at
            while end < len(part) and part[end] in known:
                end += 1
            if end > at:
                out += self.known_ids(part[at:end])
            at = end
            while at < len(part) and part[at] not in known:
                out += [self.byte_ids[b] for b in part[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out


    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs (left << 32 | right) are compatible."""
        at = np.searchsorted(self.pair_keys, keys)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == keys[known]
        out = np.zeros(len(keys), dtype=bool)
        out[known] = self.pair_fits[at[known]]
        if not known.all():
            once, place = np.unique(keys[~known], return_inverse=True)
            got = [self.pairs.get(k) for k in once.tolist()]
            out[~known] = np.array([self.compatible(k >> 32, k & 0xFFFFFFFF) if g is None else g for k, g in zip(once.tolist(), got, strict=True)], dtype=bool)[place]
        return out

    def many_ids(self, parts: list[str]) -> list[bytes]:
        """Packed ids of many short parts of known characters: one table for all, filled prefix length by prefix length."""
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.find.iter(self.gap.join(parts))), np.int64).reshape(-1, 2)
        ends, piece, length = found[:, 0] + 1, found[:, 1] >> 8, found[:, 1] & 255
        level = ends - starts[np.searchsorted(starts, ends, side="left") - 1]
        order = np.argsort(level, kind="stable")
        ends, piece, length, edges = ends[order], piece[order], length[order], np.searchsorted(level[order], np.arange(1, int(sizes.max()) + 2))
        last, size = np.full(int(starts[-1] + sizes[-1]) + 1, -1, dtype=np.int64), np.zeros(int(starts[-1] + sizes[-1]) + 1, dtype=np.int64)
        last[starts] = NONE
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            fits = self._fits(last[ends[a:b] - length[a:b]] << 32 | piece[a:b])
            last[ends[a:b][fits]], size[ends[a:b][fits]] = piece[a:b][fits], length[a:b][fits]
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        if len(self.pair_keys) != len(self.pairs):
            keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
            order = np.argsort(keys)
            self.pair_keys, self.pair_fits = keys[order], np.fromiter(self.pairs.values(), bool, len(self.pairs))[order]
        at, who, steps = starts + sizes, np.arange(len(parts)), []
        while len(who):
            steps.append((who, last[at]))
            at = at - size[at]
            who, at = who[at > starts[who]], at[at > starts[who]]
        counts = np.zeros(len(parts), dtype=np.int64)
        for who, _ in steps:
            counts[who] += 1
        stops = np.cumsum(counts)
        ids = np.empty(int(stops[-1]), dtype=np.int32)
        for k, (who, pieces) in enumerate(steps):
            ids[stops[who] - 1 - k] = pieces
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True)]


class Parts(dict):
    """Ids (bytes of i32) of parts of texts, remembered in two generations: what is asked again comes back from the older one."""

    def __init__(self, table: Table) -> None:
        super().__init__()
        self.table, self.old, self.size = table, {}, 0

    def learned(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of parts that the memo hasn't got, which gets the short ones."""
        new = {p: got for p in parts if (got := self.old.get(p)) is not None}
        marked = {p.replace(" ", MARK): p for p in parts if p not in new}
        short = [m for m in marked if len(m) <= LONGEST_PART and self.table.known.issuperset(m)]
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            new.update(zip([marked.pop(m) for m in some], self.table.many_ids(some), strict=True))
        for m, part in marked.items():
            new[part] = array("i", self.table.part_ids(m)).tobytes()
        for part, got in new.items():
            if len(part) <= LONGEST_PART:
                self.size += len(part) + len(got) + ENTRY_BYTES
                if self.size > MEMO_BYTES // 2:
                    self.old, self.size = dict(self), 0
                    self.clear()
                self[part] = got
        return new

    def documents(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        parts, ends, split = [], [0], self.table.pattern.findall
        for text in texts:
            if text:
                parts += split(" " + text.replace(MARK, " "))  # in the parts a mark is a space, which keeps them small
            ends.append(len(parts))
        got = list(map(self.get, parts))
        missing = [k for k, g in enumerate(got) if g is None]
        if missing:
            new = self.learned({parts[k] for k in missing})
            for k in missing:
                got[k] = new[parts[k]]
        return [b"".join(got[a:b]) for a, b in pairwise(ends)]


def load_table(vocabulary: str) -> Table:
    """The table of a model file; ValueError for a model of another kind."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary, "rb") as file:  # a library's own file, present on every machine
        model.ParseFromString(file.read())
    kind, rules, spec = model.SentencePiece, model.normalizer_spec, model.trainer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap or spec.treat_whitespace_as_suffix)
    if spec.model_type != spec.BPE or not plain or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError("only merge models without normalising rules, own symbols and unused pieces")
    normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
    byte_ids = [k for k, p in enumerate(model.pieces) if p.type == kind.BYTE]
    if len(byte_ids) != 256 or [model.pieces[k].piece for k in byte_ids] != [f"<0x{b:02X}>" for b in range(256)]:
        raise ValueError("only models with byte fallback")
    return Table({p: model.pieces[k].score for p, k in normal.items()}, normal, byte_ids)


_LOADED: dict[str, Parts] = {}


def load_parts(vocabulary: str) -> Words:
    """A worker's memo for a model; tasks of one worker share it."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Parts(load_table(vocabulary))
    return _LOADED[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _list_of(rows: list[bytes]) -> pa.Array:
    """list<int32> of rows of packed ids."""
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids for one batch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(docs: DataFrame, vocabulary: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns to carry, ids (array<int>) of whole texts."""
    vocabulary, own = vocabulary or default_vocabulary(), ["doc_id", *(carry or [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = load_parts(vocabulary)
        for batch, _, _ in K.slices(batches):
            ids = parts.documents(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), _list_of(ids)], names=[*own, "ids"])
        K.trim()

    return docs.select(*dict.fromkeys([*own, "text"])).mapInArrow(work, T.StructType([*(docs.schema[c] for c in own), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """coded without ids, and text: what the library's decoder makes of them."""
    vocabulary, others = vocabulary or default_vocabulary(), [c for c in coded.columns if c != "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([library.decode(row) if row else "" for row in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), texts], names=[*others, "text"])
        K.trim()

    return coded.select(*others, "ids").mapInArrow(work, T.StructType([*(coded.schema[c] for c in others), T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns to carry, ids, and decoded: `encode` and `decode` in one pass, so that ids cross over once and one worker does both."""
    vocabulary, own = vocabulary or default_vocabulary(), ["doc_id", *(carry or [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        parts, library = load_parts(vocabulary), SentencePieceProcessor(model_file=vocabulary)
        for batch, _, _ in K.slices(batches):
            ids = parts.documents(batch.column("text").to_pylist())
            texts = pa.array([library.decode(np.frombuffer(row, np.int32).tolist()) if row else "" for row in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), _list_of(ids), texts], names=[*own, "ids", "decoded"])
        K.trim()

    added = T.StructType.fromDDL("ids array<int>, decoded string")
    return docs.select(*dict.fromkeys([*own, "text"])).mapInArrow(work, T.StructType([*(docs.schema[c] for c in own), *added.fields]))


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    coded = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
