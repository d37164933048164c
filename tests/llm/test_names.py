"""Columns of the input that bear names the operators use inside: nothing breaks, and all columns stay as they came."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm import common, decontamination, exact_dedup, mixing, quality, queries, similar, simhash

HERE = Path(common.__file__).parent


def internal_names():
    """Every quoted name that starts with an underscore in the modules of the subpackage, and common ones without."""
    found = {m for f in HERE.glob("*.py") for m in re.findall(r'"(_[a-z_0-9]+)"', f.read_text())} - {"__init__"}
    return sorted(found | {"id", "fp", "key", "n", "a", "b", "node", "group", "digest", "locator", "text_sha256", "size", "copies", "row", "quality", "llr", "x", "v", "block", "place", "gap", "of", "class"})


def table(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice("xyz") for _ in range(rng.randint(0, 40))), "en", "ab"[i % 2], 9) for i in range(40)]
    rows += [(100 + i, t, *rest) for i, t, *rest in rows[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({n: F.lit(f"mine {n}") for n in internal_names()})


def kept(name, df, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    if name == "mix":
        return mixing.mix(df)
    if name == "mix by quality":
        model = quality.learn(df, labels)
        return mixing.mix(df, quality=lambda rows, keep: quality.posteriors(rows, model, keep, *queries.site_columns()).select(*keep, (0.25 + F.col("p_good")).alias("quality")))
    if name == "keep_good":
        return quality.keep_good(df, quality.learn(df, labels), *queries.site_columns())
    return {"similar": similar.keep_one_each, "simhash": simhash.keep_one_each, "exact": exact_dedup.keep_first_copies,
            "clean": lambda d: decontamination.drop_contaminated(d, d.limit(1).select(F.col("doc_id").alias("item_id"), "text"))}[name](df)


@pytest.mark.parametrize("name", ["mix", "mix by quality", "keep_good", "similar", "simhash", "exact", "clean"])
def test_columns_stay(spark, name):
    df = table(spark)
    plain = df.select("doc_id", "text", "lang", "source", "n_chars")
    got = kept(name, df, spark)
    assert got.columns == df.columns
    rows = got.collect()
    assert rows and all(r[n] == f"mine {n}" for r in rows for n in internal_names())
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in kept(name, plain, spark).collect())


def test_a_name_is_free_whatever_its_case():
    assert common.free_name(["A", "_b", "__B"], "_b") == "___b"
    assert common.free_name([], "_b") == "_b"


def test_stages_are_the_ones_that_keep_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "packing"]
