"""Token ids in patched frame-of-reference files.

A file holds the ids of its documents in blocks of 256. Of each block the minimum is subtracted; the rest is packed at
the width that ``percentile`` of the values need; values that need more keep their low bits there, and their positions
and whole values go to the block's exception list. Layout, little-endian::

    "PFOR1\\0\\0\\0"
    block: minimum u32, width u8, 0 u8, exceptions u16, 4 * width words u64, positions u8 each, values u32 each
    index: start of each block u64, and the end of the last
    documents: id i64 (null: -2**63) each, then number of ids u64 each
    trailer: start of index u64, blocks u64, documents u64, ids u64, "PFOR1END"

Documents are dealt to files by ranges of doc_id, so files and the documents in them are in ascending order. Each attempt
of a task writes a file with a name of its own; the table of files, committed with the tasks, names the one that counts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Utf8, column_of, give_back, kept, lean, partitions, shared_path, small_batches, table, written

BLOCK = 256
#: Pieces of a generation that a worker process keeps, and bytes of texts that it encodes at a time.
PIECES, SLICE = 240_000, 1 << 19
HEAD, TAIL, NO_ID = b"PFOR1\0\0\0", b"PFOR1END", -(1 << 63)


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """(blocks, bytes of each) for ids, of which the last block is filled up with its own last id."""
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, np.uint32)
    v[: len(ids)] = ids
    v[len(ids) :] = ids[-1] if len(ids) else 0
    v = v.reshape(n, BLOCK)
    low = v.min(1)
    rest = v - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    typical = np.partition(rest, at, axis=1)[:, at]
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    over = rest >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0
    over[width > 31] = False
    exceptions = over.sum(1)
    size = 8 + 32 * width + 5 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4")[:, None].view(np.uint8)
    head[:, 4] = width
    head[:, 6:] = exceptions.astype("<u2")[:, None].view(np.uint8)
    out[start[:, None] + np.arange(8)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            part = (rest[rows].astype(np.uint64) & np.uint64((1 << int(w)) - 1)).reshape(-1, 64).T.copy()
            packed = np.zeros((int(w), part.shape[1]), np.uint64)
            for j in range(64):
                word, shift = divmod(j * int(w), 64)
                packed[word] |= part[j] << np.uint64(shift)
                if shift + w > 64:
                    packed[word + 1] |= part[j] >> np.uint64(64 - shift)
            body = np.ascontiguousarray(packed.T).astype("<u8").view(np.uint8).reshape(len(rows), -1)
            out[(start[rows] + 8)[:, None] + np.arange(32 * int(w))] = body
    if exceptions.any():
        r, c = np.nonzero(over)
        k = np.arange(len(r)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = start[r] + 8 + 32 * width[r]
        out[base + k] = c
        out[(base + exceptions[r] + 4 * k)[:, None] + np.arange(4)] = v[r, c].astype("<u4")[:, None].view(np.uint8)
    return out.tobytes(), size


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that begin at ``starts``."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    exceptions = np.ascontiguousarray(head[:, 6:]).view("<u2")[:, 0].astype(np.int64)
    v = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            body = data[(starts[rows] + 8)[:, None] + np.arange(32 * int(w))]
            packed = np.ascontiguousarray(np.ascontiguousarray(body).view("<u8").reshape(-1, int(w)).T)
            part = np.empty((64, packed.shape[1]), np.uint32)
            mask = np.uint64((1 << int(w)) - 1)
            for j in range(64):
                word, shift = divmod(j * int(w), 64)
                x = packed[word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | packed[word + 1] << np.uint64(64 - shift)
                part[j] = x & mask
            v[rows] = part.T.reshape(len(rows), BLOCK)
    v += low[:, None]
    if exceptions.any():
        r = np.repeat(np.arange(n), exceptions)
        k = np.arange(len(r)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = starts[r] + 8 + 32 * width[r]
        c = data[base + k]
        v[r, c] = np.ascontiguousarray(data[(base + exceptions[r] + 4 * k)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return v.reshape(-1)


class TokenWriter:
    """One file, written front to back; only the index and the document table are held."""

    def __init__(self, stream, blocks_at_once: int = 1024, percentile: float = 0.9):
        self.stream, self.hold, self.percentile = stream, blocks_at_once * BLOCK, percentile
        self.waiting, self.n_waiting = [], 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.n_ids = 0
        stream.write(HEAD)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.extend(NO_ID if d is None else d for d in doc_ids)
        self.lengths.extend(lengths.tolist())
        self.n_ids += len(ids)
        self.waiting.append(ids.astype(np.uint32))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.hold:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        if n:
            data, size = pack(every[:n], self.percentile)
            self.stream.write(data)
            self.sizes.append(size)
        self.waiting, self.n_waiting = [every[n:]], len(every) - n

    def close(self) -> None:
        self._flush(self.n_waiting)
        size = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        starts = len(HEAD) + np.concatenate([[0], np.cumsum(size)])
        self.stream.write(starts.astype("<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.stream.write(struct.pack("<QQQQ", int(starts[-1]), len(size), len(self.docs), self.n_ids) + TAIL)


class TokenReader:
    """Random access to one file: any block by the index, or all documents front to back."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        end = source.read_at(40, size - 40)
        if end[32:] != TAIL or source.read_at(8, 0) != HEAD:
            raise ValueError("not a token file")
        at, blocks, docs, self.n_ids = struct.unpack("<QQQQ", end[:32])
        foot = source.read_at(size - 40 - at, at)
        self.starts = np.frombuffer(foot, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(foot, "<i8", docs, 8 * (blocks + 1))
        self.lengths = np.frombuffer(foot, "<u8", docs, 8 * (blocks + 1 + docs)).astype(np.int64)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of the file, from the blocks that hold them."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        b, e = first // BLOCK, -(-(first + count) // BLOCK)
        lo, hi = int(self.starts[b]), int(self.starts[e])
        data = np.frombuffer(self.source.read_at(hi - lo, lo), np.uint8)
        return unpack(data, self.starts[b:e] - lo)[first - b * BLOCK :][:count]

    def documents(self, at_once: int = 1 << 20):
        """(doc_id, first id's place in the file, number of ids, crc32 of the ids) in order; a long document is read in pieces."""
        place = np.concatenate([[0], np.cumsum(self.lengths)])
        d = 0
        while d < len(self.lengths):
            e = max(d + 1, int(np.searchsorted(place, place[d] + at_once, "right")) - 1)
            if e == d + 1 and self.lengths[d] > at_once:
                crc = 0
                for at in range(int(place[d]), int(place[e]), at_once):
                    crc = zlib.crc32(self.ids(at, min(at_once, int(place[e]) - at)).astype("<u4").tobytes(), crc)
                crcs = [crc]
            else:
                raw = memoryview(self.ids(int(place[d]), int(place[e] - place[d])).astype("<u4").tobytes())
                cut = 4 * (place[d : e + 1] - place[d])
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield self.doc_ids[d:e], place[d:e], self.lengths[d:e], crcs
            d = e


# White space as the tokenizer's pattern has it (fixed values).
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A line end before text; a word before punctuation; text with the white space before it; white space at the end.
_PIECE = re.compile(f"\\n(?=[^{_S}])|[{_S}]*+(?:[0-9A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?])|[^{_S}]++)|[{_S}]++")
_INNER = re.compile(f" ?[^{_S}]+")


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs of ``length`` from ``begin`` on, one run after the other."""
    done = np.cumsum(length)
    return np.repeat(begin - done + length, length) + np.arange(int(done[-1]) if len(done) else 0)


class _Generation(dict):
    """Numbers of pieces, in the order in which they are first asked for, with their ids; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used, self.ids = np.zeros(1 << 18, np.uint32), 0, 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n

    def append(self, length: np.ndarray, ids: np.ndarray) -> None:
        n, m = self.used + len(length), self.ids + len(ids)
        if n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.begin, self.length))
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(m, np.uint32)])
        self.begin[self.used : n] = self.ids + np.cumsum(length) - length
        self.length[self.used : n] = length
        self.flat[self.ids : m] = ids
        self.used, self.ids = n, m


class PieceEncoder:
    """The tokenizer's ids of whole texts, with each distinct piece encoded once as long as it is kept.

    The byte-level pattern never joins characters across the start of white space that follows other text, nor across
    ``.,;:!?`` after a letter or digit, nor a line end with text that follows it, so the ids of a text are those of its
    pieces. A line end between two pieces is always one token, so many new pieces are encoded in one call, a line each.
    Pieces are kept in two generations of at most ``most``; one that is met again moves to the younger, and the older is dropped when
    the younger is full. Texts go to the tokenizer whole where it is of another kind, or where they hold an added token
    that takes in white space.
    """

    def __init__(self, path: str, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.pieces = kind.get("normalizer") is None and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
        self.wide = [t["content"] for t in kind.get("added_tokens") or [] if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{_S}]", t["content"])]
        line = self._ids(["\n"])[1]
        self.line = line[0] if len(line) == 1 else None
        self.most = most
        self.old, self.young = _Generation(), _Generation()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, all ids) by the tokenizer itself."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        return length, np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum()))

    def _encode_pieces(self, pieces: list[str], at_once: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids by piece, all ids); pieces with white space other than one space in front go one by one."""
        inner = [_INNER.fullmatch(p) is not None for p in pieces] if self.line is not None else [False] * len(pieces)
        lines = [p for p, ok in zip(pieces, inner, strict=True) if ok]
        parts = [lines[lo : lo + at_once] for lo in range(0, len(lines), at_once)]
        lengths, found = [], []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.line)
            if len(cut) + 1 == len(part):
                lengths.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                found.append(np.delete(ids, cut))
            else:  # a piece holds the line end's id
                n, ids = self._ids(part)
                lengths.append(n)
                found.append(ids)
        n, ids = self._ids([p for p, ok in zip(pieces, inner, strict=True) if not ok])
        inner = np.array(inner, bool)
        length = np.empty(len(pieces), np.int64)
        length[inner], length[~inner] = np.concatenate([*lengths, n[:0]]), n
        begin = np.cumsum(length) - length
        out = np.empty(int(length.sum()), np.uint32)
        out[_spans(begin[inner], length[inner])] = np.concatenate([*found, ids[:0]])
        out[_spans(begin[~inner], n)] = ids
        return length, out

    def _learn(self, at_once: int = 20_000) -> None:
        """Ids of the pieces that the younger generation lacks, from the older one or the tokenizer."""
        every, self.young.new = self.young.new, []
        for lo in range(0, len(every), at_once):
            pieces = every[lo : lo + at_once]
            known = np.fromiter((self.old.get(p, -1) for p in pieces), np.int64, len(pieces))
            fresh, ids = self._encode_pieces([p for p, n in zip(pieces, known, strict=True) if n < 0])
            has = known >= 0
            length = np.empty(len(pieces), np.int64)
            length[has], length[~has] = self.old.length[known[has]], fresh
            begin = np.cumsum(length) - length
            out = np.empty(int(length.sum()), np.uint32)
            out[_spans(begin[~has], fresh)] = ids
            out[_spans(begin[has], length[has])] = self.old.flat[_spans(self.old.begin[known[has]], length[has])]
            self.young.append(length, out)

    def encode(self, texts: list[str], end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids by text, all ids); every text ends with ``end``."""
        whole = [i for i, t in enumerate(texts) if any(w in t for w in self.wide)] if self.pieces else range(len(texts))
        if len(whole):
            n, ids = self._ids([texts[i] for i in whole])
            others = sorted(set(range(len(texts))).difference(whole))
            m, more = self.encode([texts[i] for i in others], end) if others else (np.zeros(0, np.int64), ids[:0])
            runs = dict(zip(others, np.split(more, np.cumsum(m)[:-1]), strict=True)) if others else {}
            runs |= {i: np.append(run, np.uint32(end)) for i, run in zip(whole, np.split(ids, np.cumsum(n)[:-1]), strict=True)}
            return np.array([len(runs[i]) for i in range(len(texts))]), np.concatenate([runs[i] for i in range(len(texts))])
        if len(self.young) > self.most:
            self.old, self.young = self.young, _Generation()
            give_back()
        split = [_PIECE.findall(t) for t in texts]
        pieces = np.array([len(s) for s in split], np.int64)
        young = self.young
        index = np.fromiter(map(young.__getitem__, chain.from_iterable(split)), np.int64, int(pieces.sum()))
        if young.new:
            self._learn()
        length = young.length[index]
        ids = young.flat[_spans(young.begin[index], length)]
        upto = np.concatenate([[0], np.cumsum(length)])[np.cumsum(pieces)]  # where each text ends
        return np.diff(upto, prepend=0) + 1, np.insert(ids, upto, end)


def piece_encoder(path: str, most: int) -> PieceEncoder:
    """The encoder of this process, with the pieces that earlier tasks met, until a task of another operator runs here."""
    encoders = kept.setdefault("token_files", {})
    if (path, most) not in encoders:
        encoders[path, most] = PieceEncoder(path, most)
    return encoders[path, most]


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = 0, files: int | None = None, pieces: int = PIECES, slice_bytes: int = SLICE) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order below ``path``; a table of the files (part, file, docs, ids).

    A null text is empty; a null doc_id comes first. Equal doc_ids are in one file, in the order of their texts. A text of
    any length is one document; only its own ids are held at a time. Extra columns are ignored; an empty table gives
    files without documents. Ids are those of ``encode(text, add_special_tokens=False)`` with the tokenizer as its file has it,
    so an added token that stands in a text is that token. Fewer ``pieces`` and ``slice_bytes`` take less memory and more time.
    """
    files = files or partitions(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        from tessera.llm.token_files import piece_encoder  # the module's own, not a copy that came with the task

        encoder = piece_encoder(tokenizer, pieces)
        fs, base = _filesystem(path)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
        with fs.open_output_stream(f"{base}/{name}") as stream:
            w = TokenWriter(stream)
            for b in batches:
                column, ids = column_of(b, "text"), column_of(b, "doc_id").to_pylist()
                for i, j in Utf8(column).slices(slice_bytes):
                    n, tokens = encoder.encode(column.slice(i, j - i).to_pylist(), end)
                    w.add(ids[i:j], n, tokens)
            w.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{path}/{name}"]), pa.array([len(w.docs)], pa.int64()), pa.array([w.n_ids], pa.int64())], ["part", "file", "docs", "ids"])

    dealt = src.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with small_batches(docs.sparkSession, 1000):
        return written(dealt.mapInArrow(lean(run, keeps=True), "part long, file string, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files; start counts the ids of all before it."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file, not for each document
    todo = files.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def run(batches):
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = _filesystem(file)
                with fs.open_input_file(at) as source:
                    for ids, place, lengths, crcs in TokenReader(source).documents():
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(place + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.repartition(max(1, partitions(files.sparkSession))).mapInArrow(lean(run, keeps=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, name: str = "byte_bpe_50k.json", pieces: int = PIECES, slice_bytes: int = SLICE) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    import public_tokenizers

    return read_token_files(write_token_files(docs, public_tokenizers.path(name), shared_path(docs.sparkSession, "tokens"), pieces=pieces, slice_bytes=slice_bytes))


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Token files of whole documents, as read back."""
    return token_table(table(spark, sf_dir, "documents"))
