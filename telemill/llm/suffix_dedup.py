"""Repeated passages by sorting suffixes, on bytes, exactly.

Of the suffixes of all texts only those at anchors are sorted. The anchor of a
window of ``width`` bytes is its smallest gram of ``gram`` bytes (by hash), so equal windows have
their anchors at the same place. Windows in a row with one anchor are a run. A run's
suffix is led by two tokens: the anchor's gram and the run's content, both as
hashes.

1. Blocks (bounded sets of whole texts, stored once in a table bucketed by block, so that texts are not
   shuffled again) sort their
   runs and deal them to buckets at splitters sampled from the runs. A bucket
   sorts by the first token and, within ties only, by the next (multikey
   quicksort's order) and compares neighbours; the first and last suffix of each bucket
   are compared across the boundary. Runs with equal content repeat as a whole. Runs with an
   equal gram but different content may share some windows.
2. For the latter, one representative per content, every single window becomes a suffix of
   ``width`` bytes and is dealt, sorted and compared in the same way.
3. Bytes covered by a repeated window are removed.

What goes to a bucket is pre-aggregated per block and holds keys only, no text; what comes back are
marks in the order of the keys sent. Hashes have 128 bits in total.

Defined results: null text is empty; matches never cross texts; repeated rows are copies of each other, so texts of
``width`` bytes and more vanish in all of them; shorter texts stay; texts of any length are used whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import scratch, text_of, unit_hash, written
from telemill.llm.packed import PACKED, PACKED_KINDS, PACKED_NAMES, as_batch, pack_keys, squeeze, unpack_keys, unsqueeze

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 18  # bytes handled at a time
PLACE = np.uint64((1 << 24) - 1)  # of a window value: the bits for the place in the piece


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at every place, by doubling."""
    cur, cur_n, out, out_n, left = data.astype(np.uint64) + np.uint64(1), 1, None, 0, gram
    while left:
        if left & 1:
            if out is None:
                out, out_n = cur, cur_n
            else:
                n = len(data) - out_n - cur_n + 1
                out = out[:n] * np.uint64(pow(BASE, cur_n, 1 << 64)) + cur[out_n : out_n + n]
                out_n += cur_n
        left >>= 1
        if left:
            n = len(data) - 2 * cur_n + 1
            cur = cur[:n] * np.uint64(pow(BASE, cur_n, 1 << 64)) + cur[cur_n : cur_n + n]
            cur_n *= 2
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def least_in_windows(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    size, m = len(x) - n + 1, 1
    while m * 2 <= n:
        x = np.minimum(x[: len(x) - m], x[m:])
        m *= 2
    return np.minimum(x[:size], x[n - m : n - m + size]) if m < n else x[:size]


def pieces(lengths: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of about ``PIECE`` bytes: whole texts, or parts of long ones that overlap by a window."""
    at = end = 0
    for n in lengths.tolist():
        if end + n - at > PIECE and end > at:
            yield at, end
            at = end
        end += n
        while end - at > 2 * PIECE:
            yield at, at + PIECE + width - 1
            at += PIECE
    if end > at:
        yield at, end


def runs_of(raw: bytes, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, gram token, content token) of all runs, by place in ``raw``."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(raw) + 1, np.int32)
    long = lengths >= width
    np.add.at(inside, (ends - lengths)[long], 1)
    np.add.at(inside, (ends - width + 1)[long], -1)
    inside = np.cumsum(inside)[:-1] > 0  # a window may start here
    out = []
    for a, b in pieces(lengths, width):
        if b - a < width:
            continue
        tokens = gram_hashes(data[a:b], gram)
        place = (least_in_windows((tokens & ~PLACE) | np.arange(len(tokens), dtype=np.uint64), width - gram + 1) & PLACE).astype(np.int64)
        valid = inside[a : a + len(place)]
        change = place[1:] != place[:-1]
        first = np.flatnonzero(valid & np.r_[True, change | ~valid[:-1]])
        last = np.flatnonzero(valid & np.r_[change | ~valid[1:], True])
        content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a + s : a + e + width]) for s, e in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
        out.append((first + a, last + a, tokens[place[first]], content))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def multikey_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by the first token, then, among ties only, by the second."""
    order = np.argsort(first, kind="stable")
    lead = first[order]
    tie = np.zeros(len(lead), bool)
    tie[1:] = lead[1:] == lead[:-1]
    tied = tie.copy()
    tied[:-1] |= tie[1:]
    at = np.flatnonzero(tied)
    if len(at):
        group = np.cumsum(~tie)[at]
        order[at] = order[at][np.lexsort((second[order[at]], group))]
    return order


class Keys:
    """Distinct (first, second) keys of a block in order, and where each came from."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.order = multikey_order(first, second)
        a, b = first[self.order], second[self.order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.starts = np.flatnonzero(new)
        self.first, self.second = a[self.starts], b[self.starts]
        self.counts = np.diff(np.append(self.starts, len(a)))
        self.group = np.empty(len(a), np.int64)
        self.group[self.order] = np.cumsum(new) - 1

    def packed(self, block: int, splitters: list[tuple[int, int]]) -> Iterator[tuple]:
        """Rows of ``PACKED``, cut at the splitters."""
        at = 0
        for shard, to in enumerate([*(self._place(*s) for s in splitters), len(self.first)]):
            if to > at:
                values = np.stack([self.second[at:to], self.counts[at:to].astype(np.uint64)])
                yield 1, shard, block, pack_keys(self.first[at:to]), squeeze(values)
            at = max(at, to)

    def _place(self, first: int, second: int) -> int:
        """How many keys come before (first, second)."""
        a = np.searchsorted(self.first, np.uint64(first))
        b = np.searchsorted(self.first, np.uint64(first), "right")
        return int(a + np.searchsorted(self.second[a:b], np.uint64(second)))


REPEATED, PARTLY, FIRST = 1, 2, 4


def compare(rows: DataFrame) -> DataFrame:
    """Sort each bucket and mark its keys: ``REPEATED`` when seen more than once, ``PARTLY`` when a neighbour has the
    same first token, ``FIRST`` in the first block that sent the key. Block -1 holds the bucket's first and last key."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        shard = table.column("shard")[0].as_py()
        firsts = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        values = [unsqueeze(v, "u8").reshape(2, -1) for v in table.column("values").to_pylist()]
        first, second, counts = np.concatenate(firsts), np.concatenate([v[0] for v in values]), np.concatenate([v[1] for v in values])
        order = multikey_order(first, second)
        a, b = first[order], second[order]
        same = np.zeros(len(a), bool)
        same[1:] = a[1:] == a[:-1]
        equal = same.copy()
        equal[1:] &= b[1:] == b[:-1]
        starts = np.flatnonzero(~equal)
        marks = np.where(np.add.reduceat(counts[order], starts) > 1, REPEATED, 0).astype(np.uint8)
        near = same[starts]  # the key before has the same first token
        marks[near] |= PARTLY
        marks[:-1][near[1:]] |= PARTLY
        out = np.empty(len(a), np.uint8)
        out[order] = np.repeat(marks, np.diff(np.append(starts, len(a))))
        out[order[starts]] |= FIRST
        rows_, at = [], 0
        for block, part in zip(table.column("block").to_pylist(), firsts, strict=True):
            rows_.append((1, shard, block, b"", squeeze(out[at : at + len(part)])))
            at += len(part)
        rows_.append((1, shard, -1, b"", np.array([a[0], b[0], a[-1], b[-1]], np.uint64).tobytes()))
        return pa.Table.from_batches([as_batch(rows_, PACKED_NAMES, PACKED_KINDS)])

    return rows.groupBy("shard").applyInArrow(bucket, PACKED)


def across_boundaries(compared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys at bucket ends whose neighbour beyond the boundary has the same first token: two keys a bucket at most."""
    ends = [np.frombuffer(r["values"], np.uint64) for r in compared.where("block = -1").orderBy("shard").select("values").collect()]
    keys = {k for x, y in zip(ends, ends[1:], strict=False) if x[2] == y[0] for k in ((int(x[2]), int(x[3])), (int(y[0]), int(y[1])))}
    found = np.array(sorted(keys), np.uint64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def marks_of(rows: list[dict], keys: Keys, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A block's marks by key, completed at the bucket boundaries."""
    marks = np.concatenate([unsqueeze(r["values"], "u1") for r in sorted(rows, key=lambda r: r["shard"])] or [np.zeros(0, np.uint8)]).copy()
    for first, second in zip(*ends, strict=True):
        at = keys._place(int(first), int(second))
        if at < len(keys.first) and keys.first[at] == first and keys.second[at] == second:
            marks[at] |= PARTLY
    return marks


def windows_of(raw: bytes, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, Keys]:
    """(places, keys) of all windows of the given runs."""
    n = last - first + 1
    places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[p : p + width]) for p in places.tolist()]), np.uint64).reshape(-1, 2)
    return places, Keys(both[:, 0], both[:, 1])


def blocks_of(docs: DataFrame, id_column: str, text_column: str, block_bytes: int) -> DataFrame:
    """Blocks of whole texts: (block, doc_ids, lengths, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids.copy()], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([b"".join(texts)], pa.large_binary())],
                names=["block", "doc_ids", "lengths", "raw"],
            )
            ids.clear()
            texts.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield block()
                    number, size = number + 1, 0
        if ids:
            yield block()

    return docs.select(F.col(id_column).cast("long"), text_of(text_column).cast("binary")).mapInArrow(
        run, "block long, doc_ids array<long>, lengths array<long>, raw binary"
    )


def sampled_splitters(docs: DataFrame, text_column: str, width: int, gram: int, shards: int, per_shard: int = 64, seed: int = 9) -> list[tuple[int, int]]:
    """Keys that cut the runs into ``shards`` buckets of like size, from the runs of a bounded sample of texts."""
    total = docs.count()
    sample = docs.select(text_of(text_column).alias("text")).where(unit_hash(F.col("text"), seed=seed) < min(1.0, 4.0 * shards / max(1, total))).limit(64 * shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                _, _, a, b = runs_of(t, np.array([len(t)]), width, gram)
                few = slice(None, None, max(1, len(a) // per_shard))
                yield pa.RecordBatch.from_arrays([pa.array(a[few].view(np.int64)), pa.array(b[few].view(np.int64))], names=["a", "b"])

    rows = sample.select(F.col("text").cast("binary")).mapInArrow(run, "a long, b long").collect()
    keys = sorted({(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in rows})
    if len(keys) < shards:
        return [((i << 64) // shards, 0) for i in range(1, shards)]
    return [keys[len(keys) * i // shards] for i in range(1, shards)]


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 200, gram: int = 100,
    block_bytes: int = 2 << 20, shard_bytes: int = 16 << 20, with_text: bool = True,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for every row.

    ``spans`` lists (start, end) of the removed runs; ``kept`` is the remaining text as bytes, null with ``with_text=False``.
    """
    spark = docs.sparkSession
    table = f"suffix_blocks_{uuid.uuid4().hex}"
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks_of(docs, id_column, text_column, block_bytes).write.bucketBy(buckets, "block").option("compression", "zstd").option("path", scratch(spark, "suffix-blocks")).saveAsTable(table)
    blocks = spark.table(table)
    total = blocks.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = int(max(8, total // shard_bytes))
    splitters = sampled_splitters(docs, text_column, width, gram, shards)
    even = [((i << 64) // shards, 0) for i in range(1, shards)]  # windows' keys are hashes

    def load(row: dict) -> tuple[bytes, np.ndarray, tuple[np.ndarray, ...], Keys]:
        raw, lengths = bytes(row["raw"]), np.array(row["lengths"], np.int64)
        runs = runs_of(raw, lengths, width, gram)
        return raw, lengths, runs, Keys(runs[2], runs[3])

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield as_batch([*load(row)[3].packed(row["block"], splitters)], PACKED_NAMES, PACKED_KINDS)

    runs_compared = written(compare(blocks.select("block", "lengths", "raw").mapInArrow(send_runs, PACKED)), "suffix-runs")
    ends = across_boundaries(runs_compared)

    def send_windows(block_rows: pa.Table, returned: pa.Table) -> pa.Table:
        out = []
        for row in block_rows.to_pylist():
            raw, _, (first, last, _, _), keys = load(row)
            marks = marks_of(returned.to_pylist(), keys, ends)
            whole = (marks[keys.group] & REPEATED) > 0 if len(first) else np.zeros(0, bool)
            # one run stands for all of its content: the first of the block that sent it first
            chosen = np.flatnonzero((marks & PARTLY > 0) & (marks & FIRST > 0))
            stand_in = keys.order[keys.starts[chosen]]
            places, windows = windows_of(raw, first[stand_in], last[stand_in], width)
            out += windows.packed(row["block"], even)
            spans = np.stack([first[whole], last[whole] + width])
            # places in the order of the windows' keys, so that what comes back fits
            out.append((0, -1, row["block"], squeeze(spans), squeeze(np.stack([places[windows.order], windows.group[windows.order]]))))
        return pa.Table.from_batches([as_batch(out, PACKED_NAMES, PACKED_KINDS)])

    halfway = written(
        blocks.select("block", "lengths", "raw").groupBy("block").cogroup(runs_compared.where("block >= 0").groupBy("block")).applyInArrow(send_windows, PACKED),
        "suffix-windows",
    )
    windows_compared = compare(halfway.where("level = 1"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"

    def remove(block_rows: pa.Table, returned: pa.Table) -> pa.Table:
        out = []
        for row in block_rows.to_pylist():
            raw, lengths = bytes(row["raw"]), np.array(row["lengths"], np.int64)
            rows = returned.to_pylist()
            (own,) = (r for r in rows if r["level"] == 0)
            spans = unsqueeze(own["keys"], "i8").reshape(2, -1)
            places, group = unsqueeze(own["values"], "i8").reshape(2, -1)
            marks = np.concatenate([unsqueeze(r["values"], "u1") for r in sorted((r for r in rows if r["level"] == 1), key=lambda r: r["shard"])] or [np.zeros(0, np.uint8)])
            hit = places[marks[group] & REPEATED > 0] if len(places) else places
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, spans[0], 1)
            np.add.at(edge, spans[1], -1)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + width, -1)
            gone = np.cumsum(edge)[:-1] > 0
            at = 0
            for i, n in zip(row["doc_ids"], lengths.tolist(), strict=True):
                text, off = raw[at : at + n], gone[at : at + n]
                at += n
                if off.any():
                    change = np.flatnonzero(np.diff(np.r_[False, off, False]))
                    found = [{"start": int(s), "end": int(e)} for s, e in change.reshape(-1, 2)]
                    kept = np.frombuffer(text, np.uint8)[~off].tobytes()
                else:
                    found, kept = [], text
                out.append((i, n, n - len(kept), len(found), hashlib.sha256(kept).hexdigest(), found, kept if with_text else None))
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_batches([as_batch(out, names, kinds)])

    back = windows_compared.where("block >= 0").unionByName(halfway.where("level = 0"))
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(remove, schema)
