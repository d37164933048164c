"""Katz backoff language model: counted, normalised and evaluated as Spark jobs.

Model (bigrams over lower-cased words, every text closed by an end token):

* unigrams: P(w) = d(c) c / (N + 1) for words of training count c > 0; what is left goes to
  the one symbol for unseen words;
* bigrams of training count c >= ``least``: P(w|h) = d(c) c / (C(h) + 1);
* any other bigram backs off: P(w|h) = a(h) P(w), where
  a(h) = (1 - sum of kept P(w|h)) / (1 - sum of the same words' P(w)),
  so every context sums to 1 over the vocabulary and the unseen symbol; contexts
  without training count have a(h) = 1.

d(c) is Katz's Good-Turing discount for c up to ``katz_k``, 1 above. The 1 in the
denominators leaves mass even in contexts whose counts are all above ``katz_k``.

Plan. Texts are tokenised once into blocks (bounded runs of documents), stored in a
table: local vocabulary as 64-bit hashes, tokens as local numbers. Blocks hand their distinct
n-grams, pre-aggregated and packed in sorted runs, to shards by hash; a shard adds up
and returns each block the totals of just the n-grams it sent. Two such
exchanges, for counts and for the contexts' sums, are all: no table is broadcast, no n-gram is
looked up per token through a shuffle, and a very frequent n-gram arrives once per block. A block sends ``cells`` rows at most;
beyond as many shards the exchange takes further hops, so its rows grow with the corpus, not with its square. The kept n-grams are
stored in a table partitioned by order (``model_path``).

Words are told apart by a 64-bit hash, bigrams by the hash of both: with some
hundred million different ones a collision is unlikely.

Defined results: null text is empty and consists of the end token; a null identifier counts as
empty text in the hold-out rule; repeated rows count each; without training rows all scores use the unseen symbol
alone (probability 1); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import scratch, text_of, written
from telemill.llm.packed import PACKED, PACKED_KINDS, PACKED_NAMES, as_batch, pack_keys, squeeze, unpack_keys, unsqueeze

START, END = 1, 2  # keys of the start context and the end token
LONGEST = 1 << 14  # longer words are hashed one by one

_powers = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))
_space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) * np.uint64(0xA24BAED4963EE407) + second)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words per text)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t + b" " for t in texts).lower(), np.uint8)
    inside = ~_space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(first)
    runs = np.flatnonzero(first[at])
    place = at - np.repeat(starts, np.diff(np.append(runs, len(at))))
    hashes = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _powers[np.minimum(place, LONGEST - 1)], runs)
    size = np.diff(np.append(runs, len(at)))
    for i in np.flatnonzero(size > LONGEST):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + size[i]].tobytes())
    text_of_word = np.searchsorted(np.cumsum(lengths), starts, "right")
    return mixed(hashes), np.bincount(text_of_word, minlength=len(texts))


def tokenised(docs: DataFrame, id_column: str, text_column: str, held_out: Column, block_tokens: int) -> DataFrame:
    """Blocks: (block, n, doc_ids, held, lengths, vocab, tokens)."""
    schema = "block long, n long, doc_ids array<long>, held array<boolean>, lengths array<long>, vocab binary, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, lengths, hashes, n = [], [], [], [], 0
        texts: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size, n
            if texts:
                words, per_text = word_hashes(texts)
                ends = np.cumsum(per_text)
                hashes.append(np.insert(words, ends, np.uint64(END)))
                lengths.extend((per_text + 1).tolist())
                n += len(words) + len(texts)
                texts.clear()
                size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, n
            vocab, tokens = np.unique(np.concatenate([*hashes, np.array([START, END], np.uint64)]), return_inverse=True)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([n]), pa.array([ids.copy()], pa.list_(pa.int64())), pa.array([held.copy()], pa.list_(pa.bool_())),
                 pa.array([lengths.copy()], pa.list_(pa.int64())), pa.array([vocab.tobytes()]), pa.array([squeeze(tokens[:-2].astype(np.uint32))])],
                names=["block", "n", "doc_ids", "held", "lengths", "vocab", "tokens"],
            )
            number, n = number + 1, 0
            for x in (ids, held, lengths, hashes):
                x.clear()
            return out

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= 1 << 20:
                    flush()
                    if n >= block_tokens:
                        yield block()
        flush()
        if ids:
            yield block()

    rows = docs.select(F.col(id_column).cast("long"), held_out.alias("held"), text_of(text_column).cast("binary"))
    return rows.mapInArrow(run, schema)


class Block:
    """A block's arrays: tokens, their contexts and distinct bigrams in the order of their keys."""

    def __init__(self, row: dict) -> None:
        self.number, self.doc_ids, self.held = row["block"], row["doc_ids"], np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.tokens = unsqueeze(row["tokens"], "u4").view(np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.training = np.repeat(~self.held, self.lengths)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = np.searchsorted(self.vocab, np.uint64(START))
        pairs, inverse = np.unique(before.astype(np.int64) * len(self.vocab) + self.tokens, return_inverse=True)
        self.before = before
        keys = pair_key(self.vocab[pairs // len(self.vocab)], self.vocab[pairs % len(self.vocab)])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.pairs, self.pair_keys, self.inverse = pairs[order], keys[order], place[inverse]


def cut(level: int, keys: np.ndarray, values: np.ndarray, shards: int, sender: int) -> Iterator[tuple]:
    """Rows of ``PACKED``: sorted keys cut by shard; ``values`` has a row per key."""
    cuts = np.searchsorted(keys, (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64))
    for shard, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        if b > a:
            yield level, shard, sender, pack_keys(keys[a:b]), squeeze(values[a:b])


class Merged:
    """Rows of ``PACKED`` of one shard from several senders, added up by key."""

    def __init__(self, table: pa.Table, kind: str, width: int) -> None:
        table = table.sort_by("block")
        self.senders = table.column("block").to_pylist()
        parts = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        self.sizes = [len(p) for p in parts]
        values = np.concatenate([unsqueeze(v, kind).reshape(-1, width) for v in table.column("values").to_pylist()])
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        runs = np.flatnonzero(new)
        self.keys, self.totals = keys[order][runs], np.add.reduceat(values[order], runs, axis=0)
        self.group = np.empty(len(keys), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.first = order[runs]  # the first sender's place of each key

    def given_back(self, level: int, shard: int, totals: np.ndarray, owned: np.ndarray) -> Iterator[tuple]:
        """A row per sender: totals in the order of the keys it sent, and 1 for those it owns, being the first to send an ``owned`` key."""
        owner = np.zeros(len(self.group), np.uint8)
        owner[self.first[owned]] = 1
        at = 0
        for sender, n in zip(self.senders, self.sizes, strict=True):
            yield level, shard, sender, squeeze(owner[at : at + n]), squeeze(totals[self.group[at : at + n]])
            at += n


def exchange(rows: DataFrame, kind: str, width: int, shards: int, cells: int, least: dict[int, int] | None = None, cells_now: int | None = None) -> DataFrame:
    """Totals by key over all senders, returned to each sender in the order of its keys.

    Values are ``width`` numbers of ``kind`` per key. A returned row's keys hold one byte per key: 1 in the
    first sender of it. With ``least`` there are two more rows per shard: block -1
    with the keys and totals that reach the level's least count (the model's table),
    block -2 with the numbers of keys of count 1 to 64, the sum and the number of counts over 0.

    A sender cuts its keys into ``cells`` at most, however many shards there are, so rows grow with the senders alone. Where
    shards are more than cells, the rows of a cell are first added up by groups of senders about as large as a shard, which
    send on what they have in the same way: one hop more for every factor of ``cells``.
    """
    now = cells_now or min(shards, cells)
    if now < shards:
        return _by_way_of_groups(rows, kind, width, shards, cells, least, now)

    def add(table: pa.Table) -> pa.Table:
        level, shard = table.column("level")[0].as_py(), table.column("shard")[0].as_py()
        m = Merged(table, kind, width)
        out = list(m.given_back(level, shard, m.totals, np.ones(len(m.keys), bool)))
        if least:
            count = m.totals[:, 0]
            kept = count >= least[level]
            out.append((level, shard, -1, pack_keys(m.keys[kept]), squeeze(m.totals[kept])))
            small = np.bincount(count[(count > 0) & (count <= 64)], minlength=65)[1:]
            out.append((level, shard, -2, b"", squeeze(np.r_[small, count.sum(), (count > 0).sum()].astype(np.int64))))
        return pa.Table.from_batches([as_batch(out, PACKED_NAMES, PACKED_KINDS)])

    return rows.groupBy("level", "shard").applyInArrow(add, PACKED)


def _by_way_of_groups(rows: DataFrame, kind: str, width: int, shards: int, cells: int, least: dict[int, int] | None, now: int) -> DataFrame:
    finer = min(shards, now * cells)
    group = F.shiftleft(F.col("shard").cast("long"), 31) + F.pmod(F.xxhash64("block"), F.lit(-(-shards // now)))
    rows = written(rows.withColumn("via", group), "exchange-hop")

    def combine(table: pa.Table) -> pa.Table:
        level, via = table.column("level")[0].as_py(), table.column("via")[0].as_py()
        m = Merged(table, kind, width)
        return pa.Table.from_batches([as_batch(list(cut(level, m.keys, m.totals, finer, via)), PACKED_NAMES, PACKED_KINDS)])

    returned = written(exchange(rows.groupBy("level", "via").applyInArrow(combine, PACKED), kind, width, shards, cells, least, finer), "exchange-back")

    def hand_on(own: pa.Table, back: pa.Table) -> pa.Table:
        parts = sorted(back.to_pylist(), key=lambda r: r["shard"])
        totals = np.concatenate([unsqueeze(r["values"], kind).reshape(-1, width) for r in parts])
        owned = np.concatenate([unsqueeze(r["keys"], "u1") for r in parts]) == 1
        m = Merged(own, kind, width)
        out = list(m.given_back(own.column("level")[0].as_py(), own.column("shard")[0].as_py(), totals, owned))
        return pa.Table.from_batches([as_batch(out, PACKED_NAMES, PACKED_KINDS)])

    to_groups = returned.where("block >= 0").withColumnRenamed("block", "via")
    back = rows.groupBy("level", "via").cogroup(to_groups.groupBy("level", "via")).applyInArrow(hand_on, PACKED)
    return back.unionByName(returned.where("block < 0"))


def discounts(counts: np.ndarray, k: int) -> np.ndarray:
    """d(0..k + 1) by Katz's formula from the numbers of n-grams seen once, twice, ...; 1 where it has no sense."""
    d = np.ones(k + 2)
    n = np.r_[0, counts].astype(float)
    if n[1] > 0:
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and common < 1:
                x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                d[r] = x if 0.05 <= x <= 1 else 1.0
    return d


def score(
    docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", least: int = 1, katz_k: int = 5,
    block_tokens: int = 2_000_000, shard_tokens: int = 1_000_000, cells: int = 4096, model_path: str | None = None,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from rows that are not held out."""
    spark = docs.sparkSession
    # bucketed by block, so that blocks are not shuffled again
    table, buckets = f"katz_blocks_{uuid.uuid4().hex}", max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokenised(docs, id_column, text_column, held_out, block_tokens).write.bucketBy(buckets, "block").option("path", scratch(spark, "katz-blocks")).saveAsTable(table)
    blocks = spark.table(table)
    shards = int(max(8, (blocks.agg(F.sum("n")).first()[0] or 0) // shard_tokens))

    first_hop = min(shards, cells)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0])
                words = np.bincount(b.tokens[b.training], minlength=len(b.vocab))
                pairs = np.bincount(b.inverse[b.training], minlength=len(b.pairs))
                rows = [*cut(1, b.vocab, words, first_hop, b.number), *cut(2, b.pair_keys, pairs, first_hop, b.number)]
                yield as_batch(rows, PACKED_NAMES, PACKED_KINDS)

    path = model_path or scratch(spark, "katz-counts")
    exchange(blocks.mapInArrow(counts, PACKED), "i8", 1, shards, cells, {1: 1, 2: least}).write.partitionBy("level").parquet(path)
    counted = spark.read.schema("shard int, block long, keys binary, values binary, level int").parquet(path).select(*PACKED_NAMES)

    stats = {1: np.zeros(66, np.int64), 2: np.zeros(66, np.int64)}
    for r in counted.where("block = -2").select("level", "values").toLocalIterator():  # 66 numbers a shard
        stats[r["level"]] += unsqueeze(r["values"], "i8")
    n, v = int(stats[1][64]), int(stats[1][65])
    d1, d2 = discounts(stats[1], katz_k), discounts(stats[2], katz_k)
    # sum of d(c) c over words: all tokens less what the discounts take
    taken = sum((1 - d1[r]) * r * stats[1][r - 1] for r in range(1, katz_k + 1))
    unseen = 1.0 - (n - taken) / (n + 1)
    starts = blocks.select(F.size(F.filter("held", lambda x: ~x)).alias("n")).agg(F.sum("n")).first()[0] or 0

    def ordered(table: pa.Table, level: int, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first-sender marks, totals) in the order of the block's keys."""
        rows = sorted((r for r in table.to_pylist() if r["level"] == level), key=lambda r: r["shard"])
        return (
            np.concatenate([unsqueeze(r["keys"], "u1") for r in rows]),
            np.concatenate([unsqueeze(r["values"], kind).reshape(-1, width) for r in rows]),
        )

    names = [*PACKED_NAMES, "doc_ids", "held", "lengths", "known", "base", "part", "backed"]
    kinds = [*PACKED_KINDS, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]

    def evaluate(block_rows: pa.Table, returned: pa.Table) -> pa.Table:
        rows = []
        for row in block_rows.to_pylist():
            b = Block(row)
            _, c = ordered(returned, 1, "i8", 1)
            owner, c2 = ordered(returned, 2, "i8", 1)
            c, c2 = c[:, 0], c2[:, 0]
            p1 = np.where(c > 0, d1[np.minimum(c, katz_k + 1)] * c / (n + 1), unseen)
            context = c.copy()
            context[np.searchsorted(b.vocab, np.uint64(START))] = starts
            first, second = b.pairs // len(b.vocab), b.pairs % len(b.vocab)
            kept = c2 >= least
            p2 = np.where(kept, d2[np.minimum(c2, katz_k + 1)] * c2 / (context[first] + 1), 1.0)
            own = kept & (owner == 1)
            sums = np.stack([
                np.bincount(first[own], weights=x[own], minlength=len(b.vocab)) for x in (p2, p1[second])
            ], axis=1)
            rows += [(*r, None, None, None, None, None, None, None) for r in cut(1, b.vocab, sums, first_hop, b.number)]
            backs = ~kept[b.inverse]
            log_p = np.where(backs, np.log10(p1[b.tokens]), np.log10(p2)[b.inverse])
            base = np.log10((c[b.tokens] + 1) / (n + v + 1))
            add = lambda x: np.add.reduceat(x, b.starts).tolist()
            weighted = np.where(backs & (context[b.before] > 0), b.before, -1).astype(np.int32)
            rows.append((
                0, -1, b.number, None, None, b.doc_ids, b.held.tolist(), b.lengths.tolist(), add((c[b.tokens] > 0).astype(np.int64)),
                add(base), add(log_p), squeeze(weighted),
            ))
        return pa.Table.from_batches([as_batch(rows, names, kinds)])

    schema = PACKED + ", doc_ids array<long>, held array<boolean>, lengths array<long>, known array<long>, base array<double>, part array<double>, backed binary"
    halfway = written(
        blocks.groupBy("block").cogroup(counted.where("block >= 0").select(*PACKED_NAMES).groupBy("block")).applyInArrow(evaluate, schema), "katz-halfway"
    )
    summed = exchange(halfway.where("shard >= 0").select(*PACKED_NAMES), "f8", 2, shards, cells)

    def finish(parts: pa.Table, returned: pa.Table) -> pa.Table:
        out = []
        for row in parts.to_pylist():
            _, sums = ordered(returned, 1, "f8", 2)
            log_a = np.log10((1 - sums[:, 0]) / (1 - sums[:, 1]))
            before = unsqueeze(row["backed"], "i4")
            weights = np.where(before >= 0, log_a[before], 0.0)
            lengths = np.array(row["lengths"], np.int64)
            more = np.add.reduceat(weights, np.cumsum(lengths) - lengths)
            out.append(pa.table({
                "id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(lengths),
                "n_known": pa.array(row["known"], pa.int64()), "train_tokens": pa.array(np.full(len(lengths), n, np.int64)),
                "base_score": pa.array(row["base"], pa.float64()), "score": pa.array(np.array(row["part"]) + more),
            }))
        return pa.concat_tables(out)

    result = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    docs_part = halfway.where("shard = -1").select("block", "doc_ids", "held", "lengths", "known", "base", "part", "backed")
    return docs_part.groupBy("block").cogroup(summed.groupBy("block")).applyInArrow(finish, result)
