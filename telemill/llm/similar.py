"""Near-duplicates on word shingles by SimHash: all pairs of a Jaccard similarity of 0.8 or more, nearly.

A similarity of 0.8 leaves about 0.15 of a SimHash's bits different, far more than a threshold on 64 bits
can search for exactly. So the fingerprint has sixteen bands of 23 bits, each an
anchor-point covering of its own (``simhash``'s Golay code words): a fingerprint goes to its band's home anchor and to every
anchor one beyond the covering radius. At similarity 0.8 two texts meet in a band with probability 0.31 a direction, in one of sixteen
bands with 0.999 (measured on 2,000 planted pairs), at 0.9 all of them did. Cells are anchors split by length, as sets of such similarity
differ in size by a fifth at most.

In a cell, members are first compared with leaders only (a member that is near no leader becomes one), so a group
of copies costs a row each, not a row per pair. What is near on 128 bits is then compared exactly on the texts'
shingle sets, and the links that hold form groups. A text near a leader, but not similar to it, must still meet all
others that it is near to and not yet in one group with; only the texts that are near another one in a cell, of the cells where more than one group is left, are dealt out again for that. It can go in rounds: a text is
first compared with ``members`` members each of the ``groups`` groups it is near to most often, then with eight times as many, and so on until no pair is left that
could join two groups. By default one round looks at all pairs: rounds write their tables anew, and where few texts connect they spare few pairs. Sizes and the triangle inequality of Jaccard distances (what was compared with the same text and differs in distance to it by over 0.2 is not similar) rule out more.
So does a parity sketch of the shingle sets: a bit that differs between two sketches holds a shingle that one text has and the other has not, so as many bits
as differ is the least the sets differ by, and a pair that differs in more than a similarity of 0.8 allows is left out before it becomes a row. No similar pair is lost by that.
Only texts that are near, and neither connected in the end nor told apart by these bounds, cost a row per pair.

Defined results: null, empty and blank texts share the empty set and form a group; repeated rows share a
fingerprint; identifiers are taken to be unique: where texts share one, a row is dropped with the other; an empty table gives an
empty result; other columns are ignored (``keep_one_each`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import free_name, shared_dir, text_of, written
from telemill.llm.components import connected_components
from telemill.llm.katz import mixed
from telemill.llm.simhash import BLOCK_BITS, covering, syndrome_of

#: Two of the words are compared in the cells: 128 bits, of which a similarity of 0.8 leaves 19 different, 34 at most but for one in ten thousand.
BANDS, EXCESS, NEAR_BITS = 16, 1, 34
WORDS = -(-BANDS * BLOCK_BITS // 64)
NAMES = [f"w{i}" for i in range(WORDS)]
#: The words that cells compare; all six took the stage over its limit of disk.
COMPARED = [1, 2]
#: 64-bit words of the parity sketch; it tells sets apart that differ in up to about half as many shingles as it has bits.
PARITY = 8
SKETCH = [f"p{i}" for i in range(PARITY)]
SALTS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words make one shingle, none the empty set."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` 64-bit words of SimHash over a set of hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        h = mixed(hashes[at : at + 4096, None] ^ SALTS)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """``PARITY`` words: a bit is 1 if an odd number of the hashes falls on it. Two sketches differ in no more bits than the sets do in hashes."""
    odd = np.bincount((mixed(hashes) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def cells_of(words: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of every place that fingerprints (``WORDS`` words a row) of sets of the given sizes go to."""
    nearest, lists = covering(EXCESS)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8 * WORDS), axis=1, bitorder="little")
    step = 2 * math.log(1 / similarity)
    place = np.log(np.maximum(sizes, 1)) / step
    bucket = np.floor(place).astype(np.int64)
    other = np.where(place - bucket < 0.5, bucket - 1, bucket + 1)
    out = []
    for band in range(BANDS):
        value = bits[:, band * BLOCK_BITS : (band + 1) * BLOCK_BITS].astype(np.int64) @ (1 << np.arange(BLOCK_BITS))
        syndrome, near = syndrome_of()[value].astype(np.int64), nearest[value].astype(np.int64)

        def cell(anchor, b):
            return ((np.int64(band) << 40) | ((b + 1) << 24) | anchor).astype(np.int64)

        rows = np.arange(len(words))
        out.append((rows, cell(near, bucket), np.ones(len(rows), bool)))
        out.append((rows, cell(near, other), np.zeros(len(rows), bool)))
        offsets, found = lists[EXCESS]
        first = offsets[syndrome]
        n = offsets[syndrome + 1] - first
        each = np.repeat(rows, n)
        at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        anchor = near[each] ^ found[at].astype(np.int64)
        for b in (bucket, other):
            out.append((each, cell(anchor, b[each]), np.zeros(len(each), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def leader_links(cell: np.ndarray, home: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (leader, member) of rows sorted by cell, homes first: each round the first home left in every cell leads, the rows near it leave with it.

    A row in no such pair that is near one of the rows that are, one of the two at home, is linked with it: so both rows of every near pair with a home are in some link of the cell."""
    left = np.arange(len(cell))
    a, b = [], []
    while len(left):
        first = np.ones(len(left), bool)
        first[1:] = cell[left][1:] != cell[left][:-1]
        starts = np.flatnonzero(first)
        n = np.diff(np.append(starts, len(left)))
        go = home[left[starts]] & (n > 1)
        keep = np.repeat(go, n)
        if not keep.any():
            break
        leaders = np.repeat(left[starts], n)[keep]
        members = left[keep]
        near = np.bitwise_count(word[leaders] ^ word[members]).sum(axis=1) <= NEAR_BITS
        link = near & (leaders != members)
        a.append(leaders[link])
        b.append(members[link])
        left = members[~near & (leaders != members)]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    taken = np.unique(np.concatenate([*a, *b]))
    alone = np.setdiff1d(np.arange(len(cell)), taken)
    first, last = np.searchsorted(cell[taken], cell[alone]), np.searchsorted(cell[taken], cell[alone], "right")
    alone, first, last = (x[last > first] for x in (alone, first, last))
    part = np.cumsum(last - first) // 2_000_000
    for k in np.unique(part):
        one, at, n = alone[part == k], first[part == k], (last - first)[part == k]
        each = np.repeat(one, n)
        other = taken[np.repeat(at, n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        near = np.flatnonzero((home[each] | home[other]) & (np.bitwise_count(word[each] ^ word[other]).sum(axis=1) <= NEAR_BITS))
        near = near[np.unique(each[near], return_index=True)[1]]
        each, other = each[near], other[near]
        a.append(np.where(home[other], other, each))
        b.append(np.where(home[other], each, other))
    return np.concatenate(a), np.concatenate(b)


def few_each(row: np.ndarray, group: np.ndarray, turn: np.ndarray, members: int, groups: int) -> np.ndarray:
    """Which pairs to look at first: of each row those with ``members`` rows of each of the ``groups`` groups it has most pairs with, in order of ``turn``."""
    order = np.lexsort((turn, group, row))
    new_row = np.r_[True, row[order][1:] != row[order][:-1]]
    new = new_row | np.r_[True, group[order][1:] != group[order][:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    of = np.cumsum(new) - 1
    place = np.arange(len(order)) - first[of]
    # runs of one row, the largest first
    owner = np.cumsum(new_row)[first]
    by_size = np.lexsort((group[order][first], -size, owner))
    start = np.r_[True, owner[by_size][1:] != owner[by_size][:-1]]
    rank = np.empty(len(first), np.int64)
    rank[by_size] = np.arange(len(first)) - np.maximum.accumulate(np.where(start, np.arange(len(first)), 0))
    keep = np.zeros(len(order), bool)
    keep[order[(place < members) & (rank[of] < groups)]] = True
    return keep


def open_pairs(cell: np.ndarray, home: np.ndarray, group: np.ndarray, word: np.ndarray, most: int = 2_000_000, seen: tuple[np.ndarray, np.ndarray] | None = None, apart: float = 0.2, sizes: np.ndarray | None = None, sketch: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (home, row) of one cell and different groups that are near, of rows sorted by cell; at most about ``most`` are looked at together.

    ``word``: the words compared in cells. With ``sizes``, those of the sets, pairs whose sizes differ by more than ``apart`` of the larger are left out, with ``sketch``
    those whose parity sketches differ in more bits than sets of these sizes and similarity can.
    ``seen``: a text each row was compared with and the distance to it; distances that differ by more than ``apart`` rule a pair out."""
    order = np.lexsort((group, cell))
    cell, home, group, word = cell[order], home[order], group[order], word[order]
    new_cell = np.r_[True, cell[1:] != cell[:-1]]
    new_group = new_cell | np.r_[True, group[1:] != group[:-1]]
    cells, groups = np.flatnonzero(new_cell), np.flatnonzero(new_group)
    of_cell, of_group = np.cumsum(new_cell) - 1, np.cumsum(new_group) - 1
    first, last = cells[of_cell], np.append(cells[1:], len(cell))[of_cell]
    own, after = groups[of_group], np.append(groups[1:], len(cell))[of_group]
    leads = np.flatnonzero(home)
    # a home meets the rows before its group in the cell, then those after it
    rows, at = np.concatenate([leads, leads]), np.concatenate([first[leads], after[leads]])
    n = np.concatenate([own[leads] - first[leads], last[leads] - after[leads]])
    rows, at, n = rows[n > 0], at[n > 0], n[n > 0]
    part = (np.cumsum(n) - n) // most
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
    for lo, hi in zip(bounds, bounds[1:]):
        a = np.repeat(rows[lo:hi], n[lo:hi])
        b = np.repeat(at[lo:hi], n[lo:hi]) + np.arange(len(a)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        once = ~home[b] | (a < b)
        a, b = a[once], b[once]
        near = np.bitwise_count(word[a] ^ word[b]).sum(axis=1) <= NEAR_BITS
        a, b = a[near], b[near]
        near = np.ones(len(a), bool)
        if sizes is not None:
            less, more = np.minimum(sizes[order[a]], sizes[order[b]]), np.maximum(sizes[order[a]], sizes[order[b]])
            near &= less >= (1 - apart - 1e-9) * more
            if sketch is not None:
                bits = np.bitwise_count(sketch[order[a]] ^ sketch[order[b]]).sum(axis=1)
                near &= bits <= apart / (2 - apart) * (less + more) + 1e-9
        if seen is not None:
            by, far = seen
            near &= (by[order[a]] != by[order[b]]) | (np.abs(far[order[a]] - far[order[b]]) <= apart + 1e-9)
        yield order[a[near]], order[b[near]]


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = 0.8, chunk: int = 400_000, members: int = 1 << 40, groups: int = 1 << 40) -> DataFrame:
    """(id, component_id) for every row; identifiers are taken to be unique, null ones are left alone. ``members`` and ``groups``: see the module."""
    shared_dir(docs.sparkSession)

    key = [*NAMES, "size", *SKETCH]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            words = np.array([np.concatenate([wide_fingerprint(s), parity_sketch(s)]) for s in sets], np.uint64).reshape(-1, WORDS + PARITY).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(words[:, i]) for i in range(WORDS)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(words[:, WORDS + i]) for i in range(PARITY))], names=["id", *key]
            )

    known = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), text_of(text_column).cast("binary").alias("text"))
    fps = written(known.mapInArrow(fingerprints, "id long, " + ", ".join(f"{w} long" for w in key)), "similar-fingerprints")
    # texts of one fingerprint, size and sketch are one node, but their sets are compared too, with that of the smallest identifier
    nodes = written(fps.groupBy(*key).agg(F.min("id").alias("node")), "similar-nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of each node."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words = np.stack([batch.column(i + 1).to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
            sizes = batch.column(WORDS + 1).to_numpy()
            for at in range(0, len(ids), 4096):
                part = slice(at, at + 4096)
                row, cell, home = cells_of(np.ascontiguousarray(words[part]), sizes[part], similarity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(~home), pa.array(ids[part][row]), *(pa.array(words[part][row, i].view(np.int64)) for i in COMPARED)],
                    names=["cell", "away", "node", *(NAMES[i] for i in COMPARED)],
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole cells at a time; of a cell larger than ``chunk`` its homes go on as leaders."""
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)]

        def linked(x: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0][a]), pa.array(x[2][a]), pa.array(x[2][b]), pa.array(~x[1][b])], names=["cell", "a", "b", "away"])

        def whole(x: list[np.ndarray]) -> pa.RecordBatch:
            return linked(x, *leader_links(x[0], x[1], x[3]))

        for batch in batches:
            new = [batch.column(0).to_numpy(), ~batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), np.stack([batch.column(i).to_numpy() for i in (3, 4)], axis=1).view(np.uint64)]
            held = [np.concatenate(p) for p in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
            if cut:
                yield whole([x[:cut] for x in held])
                held = [x[cut:] for x in held]
            if len(held[0]) > chunk:
                a, b = leader_links(held[0], held[1], held[3])
                yield linked(held, a, b)
                leads = held[1] & ~np.isin(np.arange(len(held[0])), b)
                held = [x[leads] for x in held]
        if len(held[0]):
            yield whole(held)

    def meet(batches: Iterator[pa.RecordBatch], members: int, groups: int) -> Iterator[pa.RecordBatch]:
        """Of the open pairs of whole cells ``members`` for each row and other group, in ``groups`` groups, and, without a pair, the cells that hold more. A cell larger than ``chunk``
        comes in parts, its homes, which come first, stay for all of them."""
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(COMPARED)), np.uint64), np.zeros(0, np.int64), np.zeros((0, PARITY), np.uint64)]
        fresh = 0

        def met(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in open_pairs(x[0], x[1], x[3], x[6], seen=(x[4], x[5]), apart=1 - similarity, sizes=x[7], sketch=x[8]):
                if not len(a):
                    continue
                turn = mixed(x[2][a].view(np.uint64) ^ mixed(x[2][b].view(np.uint64)))  # another order of partners for each row, the same in all its cells
                keep = few_each(a, x[3][b], turn, members, groups)
                more = np.unique(x[0][a[~keep]])
                none = pa.nulls(len(more), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x[2][a[keep]]), pa.array(x[2][b[keep]]), pa.nulls(int(keep.sum()), pa.int64())], names=["a", "b", "cell"])
                yield pa.RecordBatch.from_arrays([none, none, pa.array(more)], names=["a", "b", "cell"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            at = 6 + len(COMPARED)
            new = [column[0], ~column[1], *column[2:6], np.stack(column[6:at], axis=1).view(np.uint64), column[at], np.stack(column[at + 1 :], axis=1).view(np.uint64)]
            held = [np.concatenate(p) for p in zip(held, new, strict=True)]
            fresh += batch.num_rows
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from met([x[:cut] for x in held])
                held = [x[cut:] for x in held]
                fresh = len(held[0])
            if fresh > chunk:
                yield from met(held)
                held, fresh = [x[held[1]] for x in held], 0
        if len(held[0]):
            yield from met(held)

    placed = nodes.select("node", *NAMES, "size").mapInArrow(spread, "cell long, away boolean, node long, w1 long, w2 long")
    met = written(placed.repartition("cell").sortWithinPartitions("cell", "away", "node").mapInArrow(link, "cell long, a long, b long, away boolean"), "similar-cell-links")
    # members of one node: compared with it as well
    same = fps.join(nodes, key).where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().unionByName(same)

    def end(name: str) -> DataFrame:
        return fps.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("size", *SKETCH)))

    # whole sets are compared of pairs only that sizes and sketches leave
    bits = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH)
    possible = bits <= (1 - similarity) / (1 + similarity) * (F.col("a_size") + F.col("b_size")) + 1e-9
    pairs = written(pairs.join(end("a"), "a").join(end("b"), "b").where(possible).select("a", "b"), "similar-pairs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                union = len(one) + len(other) - common
                found.append((common >= similarity * union, 1 - common / union if union else 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.bool_()), pa.array([d for _, d in found], pa.float64())], names=["a", "b", "similar", "far"]
            )

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Every pair with its texts' exact distance, and whether they are similar."""
        linked = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "similar-linked")
        texts = written(known.join(linked, "id").mapInArrow(sets, "id long, set binary"), "similar-sets")  # a small table of links is broadcast by its size on disk
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similar boolean, far double"), name)

    compared = verified(pairs, "similar-links")
    links = compared.where("similar").select("a", "b")
    # of the texts that each was compared with, itself included, the one with the smallest identifier
    seen = compared.select(F.col("b").alias("node"), F.struct(F.col("a").alias("by"), "far").alias("seen")).groupBy("node").agg(F.min("seen").alias("seen"))
    # the nodes that are near another one in a cell; leaders are at home there
    ends = met.select("cell", F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(False).alias("away")), F.struct(F.col("b").alias("node"), "away"))).alias("end"))
    ends = written(ends.select("cell", "end.*").distinct(), "similar-cell-ends")
    cells = None
    while True:
        roots = written(connected_components(links, "a", "b"), "similar-groups")
        # a cell is open if the nodes that were near in it are in more than one group: wherever two rows are near, a link was found
        group = F.coalesce("root", "node")
        still = ends.join(roots, "node", "left").groupBy("cell").agg(F.min(group).alias("x"), F.max(group).alias("y")).where("x <> y").select("cell")
        cells = written(still if cells is None else still.join(cells, "cell", "left_semi"), "similar-open-cells")
        if cells.isEmpty():
            break
        grouped = nodes.join(roots, "node", "left").join(seen, "node", "left").select(
            "node", F.coalesce("root", "node").alias("group"), F.coalesce("seen.by", "node").alias("by"), F.coalesce("seen.far", F.lit(0.0)).alias("far"), *(NAMES[i] for i in COMPARED), "size", *SKETCH
        )
        placed = ends.join(cells, "cell", "left_semi").join(grouped, "node").select("cell", "away", "node", "group", "by", "far", *(NAMES[i] for i in COMPARED), "size", *SKETCH)
        found = placed.repartition("cell").sortWithinPartitions("cell", "away", "node").mapInArrow(lambda batches, m=members, g=groups: meet(batches, m, g), "a long, b long, cell long")
        found = written(found, "similar-open-pairs")
        more = found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        more = written(more, "similar-more-pairs")
        links = links.unionByName(verified(more, "similar-more-links").where("similar").select("a", "b"))
        pairs = pairs.unionByName(more)
        cells = found.where("cell is not null").select("cell").distinct()  # those that hold pairs not looked at yet
        members, groups = members * 8, groups * 8
    roots = roots.select(F.col("node").alias("id"), F.col("root").alias("component_id"))
    return fps.select("id").join(roots, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))


def keep_one_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are in a group of similar texts and have not its smallest identifier; all columns stay."""
    name = free_name(docs.columns, "_dropped")
    drop = similar_groups(docs, id_column, text_column, **options).where("id <> component_id").select(F.col("id").alias(name))
    return docs.join(drop, F.col(id_column).cast("long") == F.col(name), "left_anti")
