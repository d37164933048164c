"""Language identification by compression with per-language zstandard dictionaries.

Each language's raw-content dictionary holds its most frequent words, the most
frequent last, where references to them are shortest. They are counted over at most about
``docs_per_language`` labelled texts of a language (chosen by hash; a documented
bound on training only); words over ``longest_word`` letters are no words of a dictionary. A text is predicted by compressing
the whole lower-cased text, as it stands, with every dictionary: the smallest frame wins. A frame of a few bytes hardly
tells languages apart, so near ties are decided by the frames of all its words one by one, repeats counted, then by
the language seen more often in training. ``accepted`` is false where the winning margin is narrow.

Defined results: null texts and texts without a letter give ``und`` with score 0; so does
every text when nothing was learned from; texts of any length are used whole;
repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.llm.common import unit_hash

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str) -> Counter[str]:
    """The words of a lower-cased text and how often each occurs."""
    return Counter(WORD.findall(text))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def learn(
    labelled: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    docs_per_language: int = 1000,
    dictionary_bytes: int = 65_536,
    words_per_language: int = 12_000,
    longest_word: int = 64,
    seed: int = 7,
) -> list[tuple[str, int, bytes]]:
    """(language, labelled texts, dictionary) for every language with a labelled text, the most frequent first."""
    known = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_language / n))])
    chosen = known.where(unit_hash(F.col("text"), seed=seed) < F.element_at(share, F.col("lang")))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in words_of(text.lower()) if len(w) <= longest_word]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = (
        chosen.mapInArrow(distinct_words, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rank", rank).where(F.col("rank") <= words_per_language)
    )
    words: dict[str, list[tuple[int, str]]] = {}
    for r in top.select("lang", "word", "rank").collect():  # words_per_language rows a language at most
        words.setdefault(r["lang"], []).append((r["rank"], r["word"]))
    out = []
    for lang, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        used, content = 1, []
        for _, word in sorted(words.get(lang, [])):
            used += len(raw := word.encode()) + 1
            if used > dictionary_bytes:
                break
            content.append(raw)
        out.append((lang, n, b" " + b" ".join(reversed(content)) + b" "))
    return out


class Classifier:
    """Compressors with the learned dictionaries; made once per task."""

    def __init__(self, model: list[tuple[str, int, bytes]], level: int = 6, cache_limit: int = 200_000) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_limit = cache_limit
        self.langs = [lang for lang, _, _ in model]
        self.compressors = []
        for _, _, content in model:
            # zstandard takes no raw dictionary under 8 bytes
            d = zstandard.ZstdCompressionDict(content.rjust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def word_sizes(self, word: str) -> tuple[int, ...]:
        """Sizes of a single word's frames, kept for the next text."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= self.cache_limit:
                self.cache.clear()
            raw = f" {word} ".encode(errors="replace")
            found = self.cache[word] = tuple(len(c.compress(raw)) for c in self.compressors)
        return found

    def predict(self, text: str | None, near: int = 4) -> tuple[str, float, int]:
        """(language, score, margin in bytes)."""
        if not self.langs or not text or not has_letter(text):
            return UNDETERMINED, 0.0, 0
        lower = text.lower()
        raw = f" {lower} ".encode(errors="replace")
        sizes = [len(c.compress(raw)) for c in self.compressors]
        ranked = sorted(sizes)
        margin = ranked[1] - ranked[0] if len(ranked) > 1 else len(raw)
        if margin <= near and len(sizes) > 1:
            for word, n in words_of(lower).items():
                sizes = [s + n * one for s, one in zip(sizes, self.word_sizes(word), strict=True)]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        score = 1.0 / sum(2.0 ** (-min(500, s - sizes[best]) * 0.5) for s in sizes)
        return self.langs[best], score, margin


def classify(
    docs: DataFrame, model: list[tuple[str, int, bytes]], id_column: str = "doc_id", text_column: str = "text", reject_margin: int = 2
) -> DataFrame:
    """(id, lang_pred, score, margin, accepted) for every row; accepted: the margin is over ``reject_margin`` bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionary_bytes a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.predict(t.as_py()) for t in batch.column(1)]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()),
                 pa.array([m > reject_margin for m in margin], pa.bool_())],
                names=["id", "lang_pred", "score", "margin", "accepted"],
            )

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string")).mapInArrow(
        run, "id long, lang_pred string, score double, margin long, accepted boolean"
    )
