"""Bounded-space online packing of documents into training sequences.

Each partition keeps at most ``open_windows`` open windows. A document's full
windows are emitted at once; its rest goes to the open window it fits best. When
none fits, the fullest open window is filled up with the front of the rest (documents
may be cut) and emitted. Windows still open at a partition's end are
merged the same way, ``merge_fan_in`` partitions at a time; the few that are left
then are cut into powers of two, so no sequence needs padding.

Token ids are made by ``tokenizers`` from the given file. Byte-level BPE never merges across
pre-tokens (a word with the space before it, a run of digits, of white space, of other characters), and every pre-token lies in one
run of non-blanks with the space before it, or in a run of blanks. So each worker splits texts at blanks, splits a run it has not met
by the library's own rule, asks the library once per distinct pre-token, and keeps the ids of the short ones for all its tasks.
Files with another pre-tokenizer, a normalizer or more than the plain BPE, texts with a special token and runs with characters
on which the two Unicode tables differ go to the library whole.

Defined results: null text is empty and packs as the end token alone; documents of
any length are cut; repeated rows are packed each; an empty table gives no piece;
other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from telemill.llm.common import scratch, text_of

END_ID = 1
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " closed boolean, grp long, ids binary"
)
#: Unicode's white space, and the byte-level pre-tokenizer's rule within a run of blanks or of non-blanks.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{L}\p{N}]+"


@functools.cache
def newer_characters() -> frozenset[str]:
    """Letters and digits that are younger than Python's Unicode table: the tables of ``regex`` and ``tokenizers`` may differ on them."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn")


@functools.cache
def byte_symbols() -> dict[int, str]:
    """The symbol that byte-level pre-tokenizers write for each byte which UTF-8 has, as the library gives them."""
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    characters = [*range(0x80, 0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)]
    out = {}
    for c in [*map(chr, range(0x80)), *map(chr, characters)]:
        out.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
    return out


class Encoder(dict):
    """Text to ids, without special tokens, as ``tokenizers`` gives them for the file at ``path``; as a dict, the ids (little-endian, as bytes) of the runs and pre-tokens met so far."""

    def __init__(self, path: str, cache_limit: int = 600_000, longest: int = 32) -> None:
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
        self.by_parts = plain and model["type"] == "BPE" and not model.get("dropout")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.runs, self.split = re.compile(RUNS), regex.compile(SPLIT)
        self.cache_limit, self.longest = cache_limit, longest
        self.older: dict[str, bytes] = {}

    def ask(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def made(self, part: str) -> bytes:
        """The ids of a run or pre-token: a short pre-token's by the library's model, which takes the symbols of its bytes."""
        if not (part.isascii() or newer_characters().isdisjoint(part)):
            return self.ask(part)
        parts = self.split.findall(part)
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        if len(part) > self.longest:
            return self.ask(part)
        symbols = part.encode().decode("latin-1").translate(byte_symbols())
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        found = self.older.pop(part, None) or self.made(part)
        if len(part) <= self.longest:
            if len(self) >= self.cache_limit:
                # what is met again comes back from the older half, what is not goes with it
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found

    def __call__(self, text: str, at_once: int = 1 << 18) -> np.ndarray:
        if not self.by_parts or any(s in text for s in self.special):
            return np.frombuffer(self.ask(text), "<u4")
        if len(text) <= at_once:
            return np.frombuffer(b"".join(map(self.__getitem__, self.runs.findall(text))), "<u4")
        parts, out = self.runs.finditer(text), []
        while some := [m.group() for m in itertools.islice(parts, at_once // 4)]:
            out.append(b"".join(map(self.__getitem__, some)))
        return np.frombuffer(b"".join(out), "<u4")


@functools.cache
def encoder(path: str, cache_limit: int) -> Encoder:
    """The worker's encoder for a file; workers that are reused keep what earlier tasks have met."""
    return Encoder(path, cache_limit)


class Windows:
    """Open windows of one stream of pieces; ``out`` receives finished sequences."""

    def __init__(self, size: int, limit: int, out: Callable[[list[tuple]], None]) -> None:
        self.size, self.limit, self.out = size, limit, out
        self.open: list[tuple[int, list[tuple]]] = []  # (tokens in it, pieces)

    def add(self, doc: int | None, total: int, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self.out([(doc, total, start, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fitting = [i for i, (n, _) in enumerate(self.open) if n + len(ids) <= self.size]
        if not fitting and len(self.open) >= self.limit:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            n, pieces = self.open.pop(fullest)
            gap = self.size - n
            self.out([*pieces, (doc, total, start, ids[:gap])])
            start, ids = start + gap, ids[gap:]
        if fitting:
            best = max(fitting, key=lambda i: self.open[i][0])
            n, pieces = self.open.pop(best)
        else:
            n, pieces = 0, []
        pieces.append((doc, total, start, ids))
        if n + len(ids) == self.size:
            self.out(pieces)
        else:
            self.open.append((n + len(ids), pieces))


class Rows:
    """Pieces as columns, given out as record batches."""

    def __init__(self, first: int, with_ids: bool, schema: pa.Schema) -> None:
        self.next, self.with_ids, self.schema, self.rows = first, with_ids, schema, []

    def sequence(self, pieces: list[tuple], closed: bool = True, grp: int = 0) -> None:
        at = 0
        for doc, total, start, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next, at, closed, grp, raw if self.with_ids or not closed else None))
            at += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows = []
        return out


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PIECE_SCHEMA.split(","))])


def powers_of_two(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """One short window cut into sequences whose lengths are powers of two, largest first."""
    left = sum(len(p[3]) for p in pieces)
    pieces = list(pieces)
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out = []
        while want:
            doc, total, start, ids = pieces.pop(0)
            out.append((doc, total, start, ids[:want]))
            if len(ids) > want:
                pieces.insert(0, (doc, total, start + want, ids[want:]))
            want -= len(out[-1][3])
        yield out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = 2048,
    open_windows: int = 32,
    merge_fan_in: int = 64,
    end_id: int = END_ID,
    with_ids: bool = True,
    cache_limit: int = 600_000,
) -> DataFrame:
    """Pieces of all documents, a row each, in the columns of ``PIECE_SCHEMA`` without closed and grp.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers; it is null
    with ``with_ids=False``. Sequence ids are the partition's number in the upper and a
    counter in the lower 32 bits; merged sequences have bit 62 set. ``cache_limit``: a worker
    keeps the ids of up to twice as many pre-tokens; it changes time and memory, not the ids.
    """
    spark = docs.sparkSession

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path, cache_limit), TaskContext.get().partitionId()
        rows = Rows(part << 32, with_ids, _schema())
        windows = Windows(window, open_windows, rows.sequence)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                windows.add(doc, len(ids), 0, ids)
                if len(rows.rows) >= 4096:
                    yield rows.batch()
            yield rows.batch()
        for _, pieces in windows.open:
            rows.sequence(pieces, closed=False, grp=part // merge_fan_in)
        yield rows.batch()

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        rows = Rows((1 << 62) | (key[0].as_py() << 32), with_ids, _schema())
        windows = Windows(window, open_windows, rows.sequence)
        for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.add(r["doc_id"], r["doc_tokens"], r["start"], np.frombuffer(r["ids"], "<u4"))
        left = Windows(window, 1, rows.sequence)
        for _, pieces in windows.open:
            for piece in pieces:
                left.add(piece[0], piece[1], piece[2], piece[3])
        for _, pieces in left.open:
            for short in powers_of_two(pieces):
                rows.sequence(short)
        return pa.Table.from_batches([rows.batch()], schema=_schema())

    path = scratch(spark, "packed")
    docs.select(F.col(id_column).cast("long"), text_of(text_column)).mapInArrow(online, PIECE_SCHEMA).write.parquet(path)
    pieces = spark.read.parquet(path)
    rest = pieces.where("not closed").groupBy("grp").applyInArrow(merged, PIECE_SCHEMA)
    return pieces.where("closed").unionByName(rest).drop("closed", "grp")
