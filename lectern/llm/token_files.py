"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A file holds the ids of consecutive documents.  Its frequency table, scaled to a power of two, is
shared by all its blocks; a block of 65,536 ids is coded by 64 interleaved 64-bit states that share
one stream of 32-bit words.  The block index is a list of checkpoints (first id, first word, the
states) with a CRC-32 of each block's ids, so that blocks decode independently and in parallel, and
32 blocks at a time go through numpy together.  A file holds about eight million ids (some 14 MB).

    magic "LTOK0001" | header length u32 | header JSON | sections, zlib-packed as the header says:
    symbols u32, frequencies u32, doc ids i64 and null flags, doc lengths u64, words per block u64,
    block checksums u32, states u64 | words u32

Documents are brought in doc_id order by a range shuffle of their texts; each partition tokenises,
codes and writes its documents, so that ids are never shuffled.  Texts are split where the byte-level
pre-tokeniser surely splits them (before a single space or line feed between other characters) and
the pieces' ids are kept in a memo bounded by its bytes (two generations, so that frequent ones stay), which gives the same ids as coding the text at
once; pieces of over 64 characters (text without spaces) are coded each time.

Nulls: a null text is empty and has the end id only.  A null doc_id sorts first.  Repeated rows are
documents of their own, in an order among them that depends on their text only.  An empty table gives
no files and no rows.  Texts of any length are coded whole; one of over eight million ids is a file of
its own.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.plans.storage import materialize, new_path

MAGIC = b"LTOK0001"
BLOCK = 1 << 16
LANES = 64
LOW = np.uint64(1 << 32)
FILE_IDS = 1 << 23
GROUP = 32  # blocks that are coded together
#: Bytes of a worker's memo, what an entry needs besides its text and ids, and the longest piece it keeps.
MEMO_BYTES, ENTRY_BYTES, LONGEST_PIECE = 128 << 20, 180, 64


def scaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that sum up to a power of two, and its exponent."""
    bits = min(24, max(12, int(len(counts)).bit_length() + 3))
    full = 1 << bits
    out = np.maximum(1, counts.astype(np.int64) * full // int(counts.sum()))
    order = np.argsort(-out, kind="stable")
    left = full - int(out.sum())
    if left > 0:
        out[order[0]] += left
    elif left < 0:  # rare ids were rounded up: the frequent ones pay
        spare = out[order] - 1
        paid = np.minimum(spare, np.maximum(0, -left - (np.cumsum(spare) - spare)))
        out[order] -= paid
    return out, bits


def _lookup(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    return start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def rans_encode(symbols: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words per block, and start states (blocks x lanes) for indexes into freq.

    The last block is padded with index 0; decoding drops what is past the length.
    """
    blocks = max(1, -(-len(symbols) // BLOCK))
    steps = -(-min(len(symbols), BLOCK) // LANES) if blocks == 1 else BLOCK // LANES
    padded = np.zeros(blocks * steps * LANES, dtype=np.uint32)
    padded[: len(symbols)] = symbols
    grid = padded.reshape(blocks, steps, LANES)
    start, _ = _lookup(freq)
    f64 = freq.astype(np.uint64)
    limit = f64 << np.uint64(64 - bits)  # f * (LOW >> bits) << 32; 0 stands for 2**64
    states = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words = np.empty((blocks, steps, LANES), dtype=np.uint32)
    emits = np.empty((blocks, steps, LANES), dtype=bool)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = f64[s]
        out = states >= limit[s]
        if len(freq) == 1:
            out = np.zeros_like(out)
        emits[:, t] = out
        words[:, t] = states.astype(np.uint32)
        states = np.where(out, states >> np.uint64(32), states)
        whole = states // f
        states = (whole << np.uint64(bits)) + (states - whole * f) + start[s]
    return words[emits], emits.sum(axis=(1, 2)), states


def rans_decode(words: np.ndarray, per_block: np.ndarray, states: np.ndarray, n: int, freq: np.ndarray, bits: int) -> np.ndarray:
    """The n indexes that rans_encode coded."""
    blocks = len(per_block)
    steps = -(-min(n, BLOCK) // LANES) if blocks == 1 else BLOCK // LANES
    start, table = _lookup(freq)
    f64, mask, shift = freq.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64(bits)
    at = (np.cumsum(per_block) - per_block).astype(np.int64)
    words = np.concatenate((words, np.zeros(1, np.uint32)))
    out = np.empty((blocks, steps, LANES), dtype=np.uint32)
    states = states.copy()
    for t in range(steps):
        slot = states & mask
        s = table[slot]
        out[:, t] = s
        states = f64[s] * (states >> shift) + slot - start[s]
        need = states < LOW
        where = at[:, None] + np.cumsum(need, axis=1) - 1
        states = np.where(need, (states << np.uint64(32)) | words[np.where(need, np.minimum(where, len(words) - 1), -1)], states)
        at += need.sum(axis=1)
    if (states != LOW).any():  # a checksum for free: the coder began with these
        raise ValueError("the states don't return to their start, as a checksum of all words")
    return out.reshape(-1)[:n]


def pack_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, order: tuple[int, int], end_id: int) -> bytes:
    """The bytes of one file."""
    top = int(ids.max())
    if top < 1 << 22:  # vocabularies are small: count by position
        every = np.bincount(ids)
        present = np.flatnonzero(every)
        rank = np.zeros(top + 1, dtype=np.uint32)
        rank[present] = np.arange(len(present), dtype=np.uint32)
        dense, counts = rank[ids], every[present]
    else:
        present, dense, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq, bits = scaled(counts)
    dense = dense.astype(np.uint32, copy=False)
    coded = [rans_encode(dense[i : i + GROUP * BLOCK], freq, bits) for i in range(0, len(dense), GROUP * BLOCK)]
    words, per_block, states = (np.concatenate(x) for x in zip(*coded, strict=True))
    checks = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], dtype="<u4")
    parts = {
        "symbols": present.astype("<u4"), "freq": freq.astype("<u4"), "doc_ids": np.array([d or 0 for d in doc_ids], dtype="<i8"), "doc_null": np.array([d is None for d in doc_ids], dtype="u1"),
        "lengths": lengths.astype("<u8"), "per_block": per_block.astype("<u8"), "checks": checks, "states": states.astype("<u8"),
    }
    packed = {k: zlib.compress(v.tobytes(), 1) for k, v in parts.items()}
    header = {"order": order, "ids": len(ids), "bits": bits, "end_id": end_id, "block": BLOCK, "lanes": LANES, "sections": [[k, parts[k].dtype.str, len(v)] for k, v in packed.items()], "words": len(words)}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed.values(), words.astype("<u4").tobytes()])


def unpack_file(data: bytes) -> tuple[dict, list[int | None], np.ndarray, np.ndarray]:
    """Header, doc ids, lengths and ids of a file; ValueError if it is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", data, 8)
    header, at, got = json.loads(data[12 : 12 + size]), 12 + size, {}
    for name, kind, length in header["sections"]:
        got[name] = np.frombuffer(zlib.decompress(data[at : at + length]), dtype=kind)
        at += length
    words = np.frombuffer(data, "<u4", header["words"], at)
    freq = got["freq"].astype(np.int64)
    per_block, states, ids, word = got["per_block"].astype(np.int64), got["states"].reshape(-1, LANES), np.empty(header["ids"], "<u4"), 0
    for k in range(0, len(per_block), GROUP):
        own = per_block[k : k + GROUP]
        part = ids[k * BLOCK : (k + GROUP) * BLOCK]
        part[:] = got["symbols"][rans_decode(words[word : word + int(own.sum())], own, states[k : k + GROUP], len(part), freq, header["bits"])]
        word += int(own.sum())
    for k, check in enumerate(got["checks"]):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != check:
            raise ValueError(f"block {k} doesn't match its checksum")
    return header, [None if null else int(d) for d, null in zip(got["doc_ids"], got["doc_null"], strict=True)], got["lengths"].astype(np.int64), ids


class OddSpace(ValueError):
    """White space other than single spaces and line feeds between other characters."""


def _byte_letters() -> dict[int, int]:
    """The printable characters that byte-level BPE writes for bytes: its own for printable bytes, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class Pieces(dict):
    """Ids (bytes of u32) of pieces of text.

    A piece that starts with a line feed or with NUL (the start of a text) stands for what follows
    these; any other stands for itself behind a space.  Letters and the marks behind them are never
    one pre-token, so letters go to the library's model alone, and marks have a memo of their own.
    A comma or full stop between a letter or digit and a space is a pre-token of its own, so where all
    are such (no `UNSURE`), they are split off as pieces that start with `ALONE`: a word isn't kept once for each.
    """

    ALONE = "\x01"
    UNSURE = re.compile(r"[,.](?<=[\W_].) ")

    BEHIND = ".,;:!?*%&$#|)\"]}"
    LETTERS = _byte_letters()

    def __init__(self, tokenizer, special: tuple[str, ...]) -> None:
        super().__init__()
        self.tokenizer, self.model, self.special, self.marks, self.size = tokenizer, tokenizer.model, special, {}, 0
        self.old: dict[str, bytes] = {}  # the generation before: what is asked again comes back from there
        self.line, self.space = self.coded("\n"), chr(self.LETTERS[0x20])

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else struct.pack(f"<{len(ids)}I", *ids)

    def coded(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is not None:
            self.keep(self, piece, got)
            return got
        lead, body = ("", piece[1:]) if piece[:1] in ("\n", "\x00", self.ALONE) else (" ", piece)
        word = body.rstrip(self.BEHIND)
        if word.isalpha() and len(word) < len(body):
            marks = body[len(word) :]
            end = self.marks.get(marks)
            if end is None:
                end = self.coded(marks)
                self.keep(self.marks, marks, end)
            got = self[piece[: -len(marks)]] + end
            self.keep(self, piece, got)
            return got
        if word.isalpha():
            token = (self.space if lead else "") + (word if word.isascii() else word.encode().decode("latin-1").translate(self.LETTERS))
            got = self.packed([t.id for t in self.model.tokenize(token)])
        elif body.split() != [body]:
            raise OddSpace
        else:
            got = self.coded(lead + body)
        if piece[:1] == "\n":
            got = self.line + got
        self.keep(self, piece, got)
        return got

    def keep(self, memo: dict[str, bytes], piece: str, got: bytes) -> None:
        if len(piece) > LONGEST_PIECE:
            return
        self.size += len(piece) + len(got) + ENTRY_BYTES
        if self.size > MEMO_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.marks.clear()
            self.size = 0
        memo[piece] = got

    def document(self, text: str) -> bytes:
        if not text:
            return b""
        if "\x00" in text or self.ALONE in text or any(s in text for s in self.special):
            return self.coded(text)
        parted = "\x00" + text.replace("\n", " \n")
        if not self.UNSURE.search(parted):
            parted = parted.replace(", ", f" {self.ALONE}, ").replace(". ", f" {self.ALONE}. ")
        try:
            return b"".join(map(self.__getitem__, parted.split(" ")))
        except OddSpace:
            return self.coded(text)


_LOADED: dict[str, Pieces] = {}


def load_pieces(vocabulary: str) -> Pieces:
    """A worker's memo for a vocabulary; tasks of one worker share it."""
    if vocabulary not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        _LOADED[vocabulary] = Pieces(tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()))
    return _LOADED[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Tokenise whole texts and write token files in ascending doc_id order."""
    vocabulary = vocabulary or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = load_pieces(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        partition, seq, parts, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def packed() -> pa.RecordBatch:
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            data = pack_file(np.frombuffer(b"".join(parts), "<u4"), names, lengths, (partition, seq), end_id)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.large_binary())], names=["file"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                parts.append(pieces.document(text.as_py() or "") + end)
                names.append(doc_id.as_py())
                size += len(parts[-1]) // 4
                if size >= FILE_IDS:
                    yield packed()
                    seq, parts, names, size = seq + 1, [], [], 0
        if parts:
            yield packed()
        parts.clear()
        K.trim()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = ordered.mapInArrow(work, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                header, doc_ids, lengths, ids = unpack_file(content.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                partition, seq = header["order"]
                columns = [pa.array([partition] * len(sums), pa.int32()), pa.array([seq] * len(sums), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = materialize(files.mapInArrow(work, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-docs")
    # ids before a file: those of earlier partitions (one row each in a window), then of earlier files of its own
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n")), "token-files")
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("before_part"))
    starts = files.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("before")).join(parts, "part")
    starts = materialize(starts.select("part", "seq", (F.col("before") + F.col("before_part")).alias("before")), "token-file-starts")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents tokenised, written, and read back."""
    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path)
