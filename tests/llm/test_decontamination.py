import hashlib
import random

import pytest

from telemill.llm import decontamination as D

WORDS = "amber basil cedar dune ember fjord gorse heath iris".split() + ["café", "naïve", "x1"]


def split(text):
    return [w for part in D.words_of((text or "").encode()) for w in part]


def simple(text, items, window=10, slop=4):
    """(n_words, hit positions, items found, items nearby) by looking everywhere."""
    words, hit, found, near = split(text), set(), set(), set()
    for item, body in items:
        own = split(body)
        for i in range(max(1, len(own) - window + 1)) if own else []:
            part = own[i : i + window]
            for s in range(len(words) - len(part) + 1):
                if words[s : s + len(part)] == part:
                    hit |= set(range(s, s + len(part)))
                    found.add(item)
            if any(set(part) <= set(words[s : s + len(part) + slop]) for s in range(len(words))):
                near.add(item)
    return len(words), hit, found, near


def planted(seed=1):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, line(rng.randint(3, 30))) for i in range(12)] + [(12, "amber, BASIL"), (13, None), (14, " .!? "), (5, line(12)), (15, "zebra zebra quagga")]
    docs = []
    for i in range(40):
        own = line(rng.randint(0, 60)).split()
        if i % 2:
            body = (items[rng.randrange(12)][1]).split()
            if i % 4 == 1:  # near only: words swapped
                a = rng.randrange(len(body) - 1)
                body[a], body[a + 1] = body[a + 1], body[a]
            at = rng.randint(0, len(own))
            own[at:at] = body
        docs.append((i, (" " if i % 3 else " -- ").join(own)))
    docs += [(40, None), (41, ""), (42, "\t \n"), (None, items[2][1]), (43, items[0][1].upper() + ";" + items[1][1]), (44, line(5000) + " " + items[3][1]), (45, "zebra quagga zebra zebra quagga")]
    # the end of one and the start of the next together make an item, but none alone
    halves = items[4][1].split()
    return [*docs, (46, " ".join(halves[:2])), (47, " ".join(halves[2:4])), docs[1], docs[1]], items


@pytest.mark.parametrize(("block_words", "most_windows"), [(1_000_000, 100_000), (150, 100_000), (150, 20)])
def test_equals_looking_everywhere(spark, block_words, most_windows):
    docs, items = planted()
    docs_df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, block string, place int").repartition(3)
    items_df = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, words string")
    index = D.index(docs_df, block_words=block_words, block_rows=7 if block_words < 1000 else 20_000)
    found = D.search(index, items_df, most_windows=most_windows)
    found = found.select("id", "n_words", D.covered("runs").alias("n_hit"), D.F.array_sort(D.F.array_distinct("items")).alias("items"), D.F.array_sort(D.F.array_distinct("near")).alias("near"))
    got = sorted((-1 if r["id"] is None else r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near"])) for r in found.collect())
    want = []
    for i, t in docs:
        n, hit, whole, near = simple(t, items)
        want.append((-1 if i is None else i, n, len(hit), tuple(sorted(map(str, whole))), tuple(sorted(map(str, near)))))
    assert got == sorted(want)
    assert sum(1 for w in want if w[3] != w[4]) > 3  # proximity finds more


def test_contract_columns_and_empty_tables(spark, empty):
    docs, items = planted(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    rows = {(r["id"], r["n_words"]): r for r in D.contamination(df, items_df).collect()}
    for i, t in docs:
        n, hit, whole, near = simple(t, items)
        r = rows[i, n]
        assert (r["n_hit"], r["n_items"], r["n_near_items"], r["contaminated"]) == (len(hit), len(whole), len(near), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, whole))).encode()).hexdigest()
    assert D.contamination(empty, items_df).count() == 0
    assert D.contamination(df, items_df.limit(0)).where("n_hit > 0 or n_near_items > 0").count() == 0
    clean = D.drop_contaminated(df.withColumnRenamed("text", "body").withColumn("_contaminated", D.F.lit(7)), items_df, text_column="body")
    assert clean.columns == ["doc_id", "body", "_contaminated"]
    bad = {i for i, t in docs if simple(t, items)[1]}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_words_do_not_depend_on_pieces():
    text = (" ".join(WORDS * 200) + "\n" + "w" * 900).encode()
    assert [w for part in D.words_of(text, 97) for w in part] == [w for part in D.words_of(text) for w in part] == text.translate(D.TO_WORDS).split()
