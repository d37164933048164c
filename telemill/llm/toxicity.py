"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled texts (a bounded sample per label, a documented bound on
training only): words, and word beginnings that stand for their whole
family, are chosen greedily by how many toxic texts they cover that are not yet covered
``covers`` times, provided clean texts hardly hold them; an entry's weight is its
log-odds. Words that only a group of toxic copies shares gain nothing once the
group is covered. Words of a text run through an automaton that
accepts everything within an edit distance of a lexicon entry: the product of
the trie with Levenshtein automata, its deterministic states made when first needed.
Each hit is weighed by its context window: hits inside quotation marks or
after a reporting word count as quotation, other hits near further hits as abuse.
A logistic model over the sums gives the score.

Defined results: null and empty texts hold no hit and get the score of such texts; without labels of
both kinds every score is 0; texts of any length are used whole; repeated rows get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import text_of, unit_hash, written
from telemill.llm.quality import fit_logistic

#: A word may hold masking characters between its letters, as in "b*d" or "b@d".
WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
#: Look-alikes of letters (fixed values).
LOOKALIKES = str.maketrans("0134578@$!", "oieastbasi")
#: Words that report speech (fixed values).
REPORTING = frozenset("said says quoted quote called calls wrote word term phrase insult dit a-t-il sagte nannte dijo llamó appelé".split())
QUOTES = "\"“”«»„‟"


class Lexicon:
    """Accepts words within an entry's edit distance; entries (text, weight, edits) ending in ``*`` accept any continuation.

    States are sets of (trie node, edits so far), one per reachable cell of the
    Levenshtein automaton; transitions are kept once computed.
    """

    def __init__(self, entries: list[tuple[str, float, int]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]  # edits allowed at this node's end, -1: no entry ends here
        self.family: list[bool] = [False]
        self.weight: list[float] = [0.0]
        self.reach: list[int] = [0]  # most edits allowed by an entry below
        for entry, weight, edits in entries:
            stem, node = entry.rstrip("*"), 0
            self.reach[0] = max(self.reach[0], edits)
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                    self.family.append(False)
                    self.weight.append(0.0)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.end[node] = max(self.end[node], edits)
            self.family[node] |= entry.endswith("*")
            self.weight[node] = max(self.weight[node], weight)
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.ids: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.result: list[tuple[int, float]] = []
        self.alphabet = frozenset(c for entry, _, _ in entries for c in entry)
        self.start = self._state({0: 0})

    def _state(self, cells: dict[int, int]) -> int:
        """State of the cells (node: fewest edits), closed under skipping entry letters."""
        queue = list(cells)
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                edits = cells[node] + 1
                if edits <= self.reach[child] and edits < cells.get(child, 99):
                    cells[child] = edits
                    queue.append(child)
        key = tuple(sorted(cells.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            # (kind, weight); kind 0: no hit, 1: exact, 2: with edits, 3: a family's stem was read, whatever follows, 4: the same with edits
            found = [(0, 0.0)]
            for n, e in key:
                if e == 0 and self.family[n]:
                    found.append((3, self.weight[n]))
                elif e == 0 and self.end[n] >= 0:
                    found.append((1, self.weight[n]))
                elif e <= self.end[n]:
                    found.append((4 if self.family[n] else 2, self.weight[n]))
            self.result.append(max(found, key=lambda x: (x[0] % 2, x)))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        cells: dict[int, int] = {}
        for node, edits in self.states[state]:
            if edits + 1 <= self.reach[node]:
                cells[node] = min(cells.get(node, 99), edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.reach[child]:
                    cells[child] = min(cells.get(child, 99), cost)
        return self._state(cells) if cells else -1

    def match(self, word: str) -> tuple[int, float]:
        """(0, 0) no hit; (1, weight) an entry or a family's member; (2, weight) an entry with edits."""
        state, stem = self.start, (0, 0.0)
        for c in word:
            c = c if c in self.alphabet else "\0"
            moves = self.moves[state]
            after = moves.get(c)
            if after is None:
                after = moves[c] = self._move(state, c)
            if after < 0:
                return stem
            state = after
            kind, weight = self.result[state]
            if kind > 2:
                # an exact stem before one with edits, then the greater weight
                stem = max(stem, (1, weight) if kind == 3 else (2, weight), key=lambda x: (x[0] % 2, x[1]))
        return stem if self.result[state][0] > 2 else max(stem, self.result[state], key=lambda x: (x[0] % 2, x[1]))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Matcher:
    """Lexicon hits of texts, with what is known about words kept for the next text."""

    N_FEATURES = 7

    def __init__(self, entries: list[tuple[str, float]], window: int = 12, cache_limit: int = 500_000) -> None:
        self.lexicon, self.window, self.cache_limit = Lexicon(entries), window, cache_limit
        self.cache: dict[str, tuple[int, float]] = {}

    def hit(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            found = self.lexicon.match(word)
            if not found[0] and not word.isalpha() and not word.isdigit():
                kind, weight = self.lexicon.match(word.translate(LOOKALIKES))
                found = (2, weight) if kind else found
            if len(self.cache) >= self.cache_limit:
                self.cache.clear()
            self.cache[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        """Weights of the hits summed: exact abuse, misspelled abuse, quoted; crowded hits; the most of one hit; per root of the length; different words."""
        lower = text.lower()
        words = WORD.findall(lower)
        out = np.zeros(self.N_FEATURES)
        hit, cache = self.hit, self.cache
        hits = {w for w in set(words) if (cache[w] if w in cache else hit(w))[0]}
        if not hits:
            return out
        at, places = [], []
        for i, m in enumerate(WORD.finditer(lower)):
            if m.group() in hits:
                at.append(i)
                places.append(m)
        quote_marks = np.array([i for i, c in enumerate(lower) if c in QUOTES], np.int64)
        line_starts = np.array([0, *[i + 1 for i, c in enumerate(lower) if c == "\n"]], np.int64)
        positions = np.array(at)
        near = np.searchsorted(positions, positions + self.window, "right") - np.searchsorted(positions, positions - self.window) - 1
        for i, m, n in zip(at, places, near.tolist(), strict=True):
            line = line_starts[np.searchsorted(line_starts, m.start(), "right") - 1]
            before = int(np.searchsorted(quote_marks, m.start()) - np.searchsorted(quote_marks, line))
            after = int(np.searchsorted(quote_marks, m.end())) < len(quote_marks)
            quoted = (before % 2 == 1 and after) or not REPORTING.isdisjoint(words[max(0, i - 3) : i])
            kind, weight = hit(m.group())
            if quoted:
                out[2] += weight
            else:
                out[kind - 1] += weight
                out[3] += n > 0
                out[4] = max(out[4], weight)
        out[5] = (out[0] + out[1]) / np.sqrt(len(words))
        out[6] = len(hits)
        return np.log1p(out)


def learn_lexicon(
    sample: DataFrame, least_texts: int = 4, least_stem: int = 4, most_clean_share: float = 0.25, covers: int = 4,
) -> list[tuple[str, float, int]]:
    """Lexicon entries, their log-odds and the edits they allow, from rows (id, text, y) of a bounded sample.

    Terms are words of 3 to 40 letters and their stems of ``least_stem`` to 11. All that ``least_texts`` toxic texts of the sample hold are looked at, and entries
    are added as long as one newly covers that many: the sample's bound is the only one.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: dict[str, list[int]] = {}
            clean: Counter[str] = Counter()
            for i, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = set()
                for w in set(words_of(text)):
                    if 3 <= len(w) <= 40 and w.isalpha():
                        found.add(w)
                        found.update(w[:n] + "*" for n in range(least_stem, min(len(w), 12)))
                if y:
                    for t in found:
                        toxic.setdefault(t, []).append(i)
                else:
                    clean.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*toxic, *clean]), pa.array([*toxic.values(), *[[] for _ in clean]], pa.list_(pa.int64())), pa.array([*[0] * len(toxic), *clean.values()], pa.int64())],
                names=["term", "ids", "clean"],
            )

    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return []
    grouped = sample.select("id", "text", "y").mapInArrow(terms, "term string, ids array<long>, clean long").groupBy("term").agg(
        F.flatten(F.collect_list("ids")).alias("ids"), F.sum("clean").alias("clean")
    )
    share = F.size("ids") / kinds[1]
    candidates = grouped.where((F.size("ids") >= least_texts) & (F.col("clean") / kinds[0] <= share * most_clean_share)).orderBy(
        F.desc(F.size("ids")), "term"
    ).collect()  # of a bounded sample
    left = {r["term"]: (set(r["ids"]), r["clean"] / kinds[0] * kinds[1]) for r in candidates}
    covered: Counter[int] = Counter()
    entries: list[tuple[str, float]] = []
    # among equals a whole word, which may be misspelled, then the longest stem, which is the most specific
    queue = [(3 * clean - len(ids), t[-1] == "*", -len(t), t) for t, (ids, clean) in left.items()]
    heapq.heapify(queue)
    while queue:
        before, *rest, best = heapq.heappop(queue)
        if best not in left:
            continue
        ids, clean = left[best]
        now = sum(covered[i] < covers for i in ids) - 3 * clean
        if now < least_texts:
            continue
        if -now > before:  # gains only shrink: back into the queue with what it is now
            heapq.heappush(queue, (-now, *rest, best))
            continue
        entries.append((best, float(np.log((len(ids) + 0.5) / (clean + 0.5)))))
        covered.update(ids)
        del left[best]
        # shorter and longer stems of the same texts say nothing new
        stem = best.rstrip("*")
        for t in [t for t in left if t.startswith(stem) or stem.startswith(t.rstrip("*"))]:
            if len(left[t][0] & ids) >= 0.9 * len(left[t][0] | ids):
                del left[t]
    # whole words may be misspelled from five letters on, stems, which accept whatever follows, from six on
    return [(e, w, (len(e) >= 7) + (len(e) >= 10) if e[-1] == "*" else (len(e) >= 5) + (len(e) >= 8)) for e, w in entries]


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic", text_column: str = "text",
    texts_per_label: int = 4000, seed: int = 5,
):
    """(entries, logistic model) from the texts of labelled identifiers; None without both labels.

    At most about ``texts_per_label`` identifiers of each label are used. They are chosen in
    ``labels`` first, so only their texts move.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column), F.col(label_column).cast("int").alias("y")).groupBy(id_column).agg(F.max("y").alias("y"))  # the worse of labels that disagree
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    u = unit_hash(F.col(id_column), seed=seed)
    chosen = known.where(u < F.when(F.col("y") == 1, texts_per_label / counts[1]).otherwise(texts_per_label / counts[0]))
    texts = docs.select(id_column, text_of(text_column).alias("text")).join(F.broadcast(chosen), id_column)  # 2 * texts_per_label rows, about
    sample = written(texts.groupBy("text").agg(F.max("y").alias("y")).withColumn("id", F.xxhash64("text")), "toxicity-sample")
    entries = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for batch in batches:
            x = [matcher.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(run, "x array<double>, y int").collect()  # short rows of the bounded sample
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    mean, scale, beta = fit_logistic(np.array([r["x"] for r in rows]), y)
    # the sample is balanced; move the intercept to the labels' own shares
    kept = y.mean()
    toxic = counts[1] / (counts[0] + counts[1])
    beta[-1] += np.log(toxic / (1 - toxic)) - np.log(kept / (1 - kept))
    return entries, (mean, scale, beta)


def score(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, exact, misspelled, quoted) for every row; the last three are summed weights of hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model[0] if model else [])
        for batch in batches:
            x = np.array([matcher.features(t.as_py()) for t in batch.column(1)]).reshape(-1, Matcher.N_FEATURES)
            if model is None:
                p = np.zeros(len(x))
            else:
                mean, scale, beta = model[1]
                p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ beta[:-1] + beta[-1], -30, 30)))
            weights = np.expm1(x[:, :3])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), *(pa.array(weights[:, k]) for k in range(3))], names=["id", "score", "exact", "misspelled", "quoted"]
            )

    return docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column)).mapInArrow(
        run, "id long, score double, exact double, misspelled double, quoted double"
    )
