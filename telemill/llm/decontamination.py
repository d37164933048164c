"""Benchmark decontamination with a distributed positional inverted index.

The index is a table with a row per block of whole documents: the block's terms in order,
how often each occurs, and the positions of each term, term after term, as compressed
differences. A block is about ``block_words`` words, so a row has a bounded size
(but for a single longer document) and a frequent term has no long list anywhere. Nothing is shuffled to build it, and
a lost executor costs its blocks only.

A search takes the windows of the test items, in groups of at most ``most_windows`` (a documented bound on what is sent to
every task; more windows mean more passes over the index). In a block each window starts from the postings of its rarest term
there, shifted by the term's place in the window, and is intersected with the shifted postings of its other terms, rarest first:
what is left are exact phrases. Proximity matches start from the same postings: all words of the window, in any order, among
``slop`` more consecutive words than it has. Terms are compared as bytes, so there are no false matches. Positions of
neighbouring documents have a gap between them, so no phrase crosses documents.

Words are runs of letters and digits and of all bytes from 0x80, A-Z lower-cased. Defined results: null and empty texts have no words and a row
of zeros; an item of fewer words than a window is one window; an item without words is never found; items that share an
identifier count as one, a null identifier counts as the empty string; repeated rows get a row each; no items or no
documents give zeros or an empty result; other columns are ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import free_name, shared_dir, text_of, written
from telemill.llm.packed import squeeze, unsqueeze

#: Bytes of words stay, A-Z become a-z, all others become blanks.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "block long, ids array<long>, places binary, n_words binary, terms binary, counts binary, positions binary"
FOUND = "block long, place int, id long, n_words long, runs array<struct<first: long, last: long>>, items array<string>, near array<string>"
RUN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def words_of(text: bytes, step: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words in lists, each of about ``step`` bytes of text."""
    at = 0
    while at < len(text):
        to = at + step
        piece = text[at:to].translate(TO_WORDS)
        while to < len(text) and piece[-1:] != b" ":  # not within a word
            more = text[to : to + 256].translate(TO_WORDS)
            cut = more.find(b" ") + 1
            piece, to = piece + (more[:cut] if cut else more), to + (cut or len(more))
        yield piece.split()
        at = to


class Block:
    """Documents on their way into a row of the index."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.pieces: list[pa.Array] = []
        self.n = 0

    def add(self, name: int | None, text: bytes) -> None:
        n = 0
        for words in words_of(text):
            self.pieces.append(pa.array(words, pa.large_binary()))
            n += len(words)
        self.ids.append(name)
        self.sizes.append(n)
        self.n += n

    def row(self, number: int) -> tuple:
        sizes = np.array(self.sizes, np.int64)
        places = np.cumsum(sizes + 1) - sizes - 1  # a gap of one position between documents
        coded = (pa.concat_arrays(self.pieces) if self.pieces else pa.array([], pa.large_binary())).dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy()
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        codes = rank[codes]
        at = np.argsort(codes, kind="stable")
        position = (at + np.repeat(np.arange(len(sizes)), sizes)[at]).astype(np.uint32)
        steps = np.diff(position, prepend=np.uint32(0))  # modulo 2^32, over the ends of the lists as well
        return (
            number, self.ids, squeeze(places), squeeze(sizes), squeeze(np.frombuffer(b" ".join(terms.take(pa.array(order)).to_pylist()), np.uint8)),
            squeeze(np.bincount(codes, minlength=len(order)).astype(np.uint32)), squeeze(steps.view(np.uint8).reshape(-1, 4).T),
        )


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_words: int = 1_000_000, block_rows: int = 20_000) -> DataFrame:
    """The index of ``docs`` (columns of ``INDEX``), written to the shared folder."""
    shared_dir(docs.sparkSession)
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    names = [f.split()[0] for f in INDEX.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block.row(number), kinds, strict=True)], names=names)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(name, text.as_py())
                if block.n >= block_words or len(block.ids) >= block_rows:
                    yield done()
                    number, block = number + 1, Block()
        if block.ids:
            yield done()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).cast("binary").alias("text"))
    return written(rows.mapInArrow(build, INDEX), "position-index")


def windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = 10) -> DataFrame:
    """(item, words): the distinct windows of each item, words joined by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [w for part in words_of(text.as_py()) for w in part]
                grams = sorted({b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}) if words else []
                for at in range(0, len(grams), 10_000):
                    part = grams[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "words"])

    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), text_of(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item string, words binary").distinct()


@dataclass
class Asked:
    """A group of windows: its terms in order; per window (a row) the numbers of its words, -1 beyond its end; the item of each."""

    terms: pa.Array
    words: np.ndarray
    items: list[str]
    item: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, bytes]]) -> Asked:
        split = [w.split(b" ") for _, w in rows]
        terms = sorted({t for words in split for t in words})
        number = {t: i for i, t in enumerate(terms)}
        table = np.full((len(rows), max(map(len, split), default=1)), -1, np.int64)
        for i, words in enumerate(split):
            table[i, : len(words)] = [number[t] for t in words]
        items = sorted({item for item, _ in rows})
        place = {x: i for i, x in enumerate(items)}
        return Asked(pa.array(terms, pa.binary()), table, items, np.array([place[x] for x, _ in rows], np.int64))


class Postings:
    """A row of the index, read for the terms of a group of windows."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, asked: pa.Array) -> None:
        own = unsqueeze(terms, "u1").tobytes()
        found = pc.index_in(asked, value_set=pa.array(own.split(b" ") if own else [], pa.binary()))
        n = unsqueeze(counts, np.uint32).astype(np.int64)
        steps = np.ascontiguousarray(unsqueeze(positions, "u1").reshape(4, -1).T).view(np.uint32).ravel()
        position = np.cumsum(steps, dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(n)
        there = found.is_valid().to_numpy(zero_copy_only=False)
        local = found.fill_null(0).to_numpy()
        self.counts = np.where(there, n[local] if len(n) else 0, 0)
        self.starts = np.cumsum(self.counts) - self.counts
        first = (ends - n)[local] if len(n) else np.zeros(len(local), np.int64)
        at = np.repeat(first - self.starts, self.counts) + np.arange(int(self.counts.sum()))
        self.position = position[at]
        self.keys = (np.repeat(np.arange(len(local)), self.counts) << 32) | self.position  # in order: by term, then position

    def each(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of all postings of the term in every row."""
        n = self.counts[term]
        row = np.repeat(np.arange(len(term)), n)
        return row, self.position[np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(len(row))]

    def next(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The term's first position at or after the given one; a very large number if there is none."""
        key = (term << 32) | np.maximum(position, 0)
        at = np.searchsorted(self.keys, key)
        got = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (got >> 32 == term), got & 0xFFFFFFFF, np.int64(1) << 40)


def rarest_first(asked: Asked, postings: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows whose terms all occur: their numbers, the places of their words from the rarest to the commonest, and how many there are."""
    n = np.where(asked.words >= 0, postings.counts[np.maximum(asked.words, 0)] if len(postings.counts) else 0, np.int64(1) << 40)
    alive = np.flatnonzero(n.min(axis=1) > 0) if len(n) else np.zeros(0, np.int64)
    return alive, np.argsort(n[alive], axis=1, kind="stable"), (asked.words[alive] >= 0).sum(axis=1)


def phrases(asked: Asked, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of all exact matches: lists shifted by the words' places, intersected from the rarest on."""
    alive, order, length = rarest_first(asked, postings)
    row, position = postings.each(asked.words[alive, order[:, 0]])
    start = position - order[row, 0]
    row, start = row[start >= 0], start[start >= 0]
    for j in range(1, asked.words.shape[1]):
        place = order[row, j]
        term = asked.words[alive[row], place]
        inside = j < length[row]
        want = start + place
        keep = ~inside | (postings.next(np.maximum(term, 0), want) == want)
        row, start = row[keep], start[keep]
    return alive[row], start


def nearby(asked: Asked, postings: Postings, doc_first: np.ndarray, doc_last: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, document) of all proximity matches: every word of the window among ``length + slop`` consecutive words of the document."""
    alive, order, length = rarest_first(asked, postings)
    row, anchor = postings.each(asked.words[alive, order[:, 0]])
    doc = np.searchsorted(doc_first, anchor, "right") - 1
    span = length[row] + slop
    for j in range(1, asked.words.shape[1]):  # each other word within reach of the rarest one
        term = asked.words[alive[row], order[row, j]]
        low = np.maximum(anchor - span + 1, doc_first[doc])
        keep = (j >= length[row]) | (postings.next(np.maximum(term, 0), low) < np.minimum(anchor + span, doc_last[doc]))
        row, anchor, doc, span = row[keep], anchor[keep], doc[keep], span[keep]
    good = np.zeros(len(row), bool)
    for back in range(int(span.max(initial=0))):  # spans that begin at or before the rarest word
        first = anchor - back
        fits = (back < span) & (first >= doc_first[doc]) & ~good
        at = np.flatnonzero(fits)
        for j in range(asked.words.shape[1]):
            term = asked.words[alive[row[at]], order[row[at], j]]
            ok = (j >= length[row[at]]) | (postings.next(np.maximum(term, 0), first[at]) < np.minimum(first[at] + span[at], doc_last[doc[at]]))
            at = at[ok]
        good[at] = True
    return alive[row[good]], doc[good]


def runs_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals (last exclusive) joined where they touch or overlap, in order."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > upto[:-1]]
    return first[new], upto[np.r_[np.flatnonzero(new)[1:] - 1, len(upto) - 1]]


def search(index_table: DataFrame, items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = 10, slop: int = 4, most_windows: int = 100_000) -> DataFrame:
    """A row per document of the index (columns of ``FOUND``): the runs of words inside exact matches, the items found exactly, those found nearby."""
    spark = index_table.sparkSession
    asked_table = written(windows(items, id_column, text_column, window), "test-windows")
    groups = max(1, -(-2 * asked_table.count() // most_windows)) if asked_table.count() > most_windows else 1
    numbered = asked_table.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(groups)))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(RUN), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["block", "place", "id", "n_words", "runs", "items", "near"]
    found = None
    for part in range(groups):
        rows = numbered.where(F.col("part") == part).select("item", "words").collect()  # most_windows rows at most, but for the spread of the hash
        shared = spark.sparkContext.broadcast(Asked.of([(r["item"], bytes(r["words"])) for r in rows]))

        def look(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for batch in batches:
                for block, ids, places, sizes, terms, counts, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first, n = unsqueeze(places, np.int64), unsqueeze(sizes, np.int64)
                    last = first + n
                    postings = Postings(terms, counts, positions, asked.terms)
                    window_, start = phrases(asked, postings)
                    near_window, near_doc = nearby(asked, postings, first, last, slop)
                    doc = np.searchsorted(first, start, "right") - 1
                    begin, end = runs_of(start, start + (asked.words[window_] >= 0).sum(axis=1))
                    runs: list[list] = [[] for _ in ids]
                    for a, b, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(first, begin, "right") - 1).tolist(), strict=True):
                        runs[d].append({"first": a - int(first[d]), "last": b - int(first[d])})
                    whole, close = ([[] for _ in ids] for _ in range(2))
                    for out, pairs in ((whole, np.stack([doc, asked.item[window_]])), (close, np.stack([near_doc, asked.item[near_window]]))):
                        for d, item in np.unique(pairs, axis=1).T.tolist():
                            out[d].append(asked.items[item])
                    keep = [i for i in range(len(ids)) if part == 0 or runs[i] or close[i]]  # the first pass gives every document a row
                    values = [[block] * len(keep), keep, [ids[i] for i in keep], n[keep].tolist(), [runs[i] for i in keep], [whole[i] for i in keep], [close[i] for i in keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        one = index_table.mapInArrow(look, FOUND)
        if groups > 1:
            one = written(one, "test-matches")
            shared.unpersist()
        found = one if found is None else found.unionByName(one)
    if groups == 1:
        return found
    return found.groupBy("block", "place", "id", "n_words").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")])  # a row per document and pass


def covered(runs: str) -> F.Column:
    """How many words lie inside the runs, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda a, r: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(r["first"], a["upto"]))).alias("n"), F.greatest(a["upto"], r["last"]).alias("upto"))
    return F.aggregate(F.array_sort(runs), start, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 10, slop: int = 4, **sizes) -> DataFrame:
    """A row per document: id, n_words, n_hit (words inside exact matches), n_items, n_near_items, items_sha256, contaminated."""
    found = search(index(docs, id_column, text_column, **sizes), items, window=window, slop=slop)
    names = F.array_sort(F.array_distinct("items"))
    rows = found.select("id", "n_words", covered("runs").alias("n_hit"), names.alias("_items"), F.size(F.array_distinct("near")).cast("long").alias("n_near_items"))
    return rows.select(
        "id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), "n_near_items", F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the identifiers of a document in which more than ``most_share`` of the words are hit; all columns stay."""
    name = free_name(docs.columns, "_contaminated")
    bad = contamination(docs, items, id_column, text_column, **options).where(F.col("contaminated") & (F.col("n_hit") > most_share * F.col("n_words")))
    bad = bad.select(F.col("id").alias(name)).distinct()
    return docs.join(bad, F.col(id_column).cast("long").eqNullSafe(F.col(name)), "left_anti")
