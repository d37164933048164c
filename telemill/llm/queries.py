"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import ann, decontamination, exact_dedup, katz, langid, mixing, packing, quality, simhash, suffix_dedup, toxicity, vector_codes, whitening
from telemill.llm.common import crc_bucket

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), crc_bucket("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id", "links"
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def site_columns() -> tuple:
    """Host and path of a document. Documents have no address: the source serves as host, its language section as path."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.learn(documents(spark, sf_dir), labels(spark, sf_dir))
    return quality.posteriors(documents(spark, sf_dir), model, ["doc_id"], *site_columns()).withColumn("kept", F.col("p_good") >= 0.5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER, with_ids=False).drop("ids")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), crc_bucket("doc_id", 3) == 1
    model = langid.learn(docs.where(~held_out))
    found = langid.classify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket("doc_id", 5) == 0
    model = toxicity.learn(documents(spark, sf_dir), labels(spark, sf_dir).where(~held_out))
    found = toxicity.score(documents(spark, sf_dir), model).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "exact", "misspelled", "quoted"
    )


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    """The mix's weights: the quality classifier's posterior, from 0.25 for surely bad to 1 for surely good documents."""
    model = quality.learn(docs, labels(spark, sf_dir))

    def weights(rows: DataFrame, keep: list[str]) -> DataFrame:
        # rounded: sums of floating-point numbers differ in the last bits between runs
        return quality.posteriors(rows, model, keep, *site_columns()).select(*keep, (0.25 + 0.75 * F.round("p_good", 6)).alias("quality"))

    return weights


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take_plan(documents(spark, sf_dir), quality=by_quality(spark, documents(spark, sf_dir), sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies", "quality", "key"
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir)).withColumnRenamed("id", "doc_id")


SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPLIT} FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SPLIT} FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(w)) AS k, w[s : s + least(10, len(w)) - 1] AS words FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(s) WHERE len(w) > 0),
p AS (SELECT rid, s, w[s] AS word FROM d, unnest(range(1, len(w) + 1)) t(s)),
grams AS (SELECT rid, s, k, array_to_string(w[s : s + k - 1], ' ') AS gram FROM d, (SELECT DISTINCT k FROM q), unnest(range(1, len(w) - k + 2)) t(s)),
hits AS (SELECT rid, s, q.k, item FROM grams JOIN q ON grams.k = q.k AND gram = array_to_string(words, ' ')),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + k)) AS at FROM hits) GROUP BY 1),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1),
often AS (SELECT word, count(*) AS c FROM p GROUP BY 1),
rare AS (SELECT item, k, words, arg_min(word, (c, word)) AS word FROM (SELECT item, k, words, unnest(list_distinct(words)) AS word FROM q) JOIN often USING (word)
  GROUP BY ALL HAVING count(*) = len(list_distinct(words))),
close AS (SELECT rid, count(DISTINCT item) AS n_near_items FROM rare JOIN p USING (word) JOIN d USING (rid), unnest(range(greatest(1, p.s - k - 3), p.s + 1)) t(a)
  WHERE list_has_all(w[a : a + k + 3], words) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid) LEFT JOIN close USING (rid)
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.codes(embeddings(spark, sf_dir), parts=16, entries=64, rounds=2, scale=256)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _round_sql(r: int) -> str:
    """Assignment ``a`` to the entries ``b{r}`` and, for all but the last, the next entries."""
    return f"""d{r} AS (SELECT rid, part, e, sum((x - y) * (x - y)) AS far FROM x JOIN b{r} USING (part, place) GROUP BY ALL),
a{r} AS (SELECT rid, part, arg_min(e, (far, e)) AS e, min(far) AS far FROM d{r} GROUP BY ALL),
b{r + 1} AS (SELECT part, place, e, coalesce(m, y) AS y FROM b{r} LEFT JOIN (SELECT part, place, e, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM x JOIN a{r} USING (rid, part) GROUP BY ALL) USING (part, place, e))"""


OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
x AS (SELECT rid, i // (len // 16) AS part, i % (len // 16) AS place, x FROM (SELECT rid, len(x) AS len, unnest(range(len(x))) AS i, unnest(x) AS x FROM v)),
b0 AS (SELECT part, place, rid AS e, x AS y FROM x WHERE rid < 64),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
coded AS (SELECT rid, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY 1),
books AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, e, place)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), books
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), k=8, scale=1024, offset=100_000).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_katz": op1_katz,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_langid": op7_langid,
    "op8_ann": op8_ann,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
