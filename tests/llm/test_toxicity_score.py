"""The toxicity score against a plain recomputation, and what quotation changes in verdicts."""

from __future__ import annotations

import math
import random
import re

import numpy as np

from telemill.llm import toxicity

#: Far enough from each other that no word is within the edits of two.
ENTRIES = [("idiot", 3.0, 1), ("scoundrel*", 2.0, 1), ("blockhead", 2.5, 2), ("vermin", 1.5, 1), ("trash", 1.0, 1)]
PLAIN = "the weather report from our village was long and mostly about rain wind snow bread and a quiet market".split()
WRITTEN = ["idiot", "idiott", "1d1ot", "scoundrels", "scoundrelly", "scondrel", "blockhead", "blokhed", "bl0ckhead", "vermin", "vremin", "trash", "trashy", "tra$h", "ttrash"]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(word: str) -> tuple[int, float]:
    found = (0, 0.0)
    for entry, weight, edits in ENTRIES:
        stem = entry.rstrip("*")
        least = min(distance(word[:n], stem) for n in (range(len(word) + 1) if entry.endswith("*") else [len(word)]))
        if least <= edits:
            found = max(found, (2 if least else 1, weight), key=lambda x: (x[0] % 2, x[1]))
    return found


def plain_hit(word: str) -> tuple[int, float]:
    found = plain_match(word)
    if not found[0] and not word.isalpha() and not word.isdigit():
        kind, weight = plain_match(word.translate(toxicity.LOOKALIKES))
        return (2, weight) if kind else found
    return found


def plain_features(text: str | None) -> list[float]:
    """Hit by hit, from the text before and after it."""
    lower = (text or "").lower()
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:[@$*!][^\W_]+)*", lower)]
    hits = {i: plain_hit(w) for i, (w, _, _) in enumerate(words) if plain_hit(w)[0]}
    out = [0.0] * 7
    for i, (kind, weight) in hits.items():
        _, start, end = words[i]
        line = lower[:start].rsplit("\n", 1)[-1]
        opened = sum(c in toxicity.QUOTES for c in line) % 2 == 1 and any(c in toxicity.QUOTES for c in lower[end:])
        reported = any(w in toxicity.REPORTING for w, _, _ in words[max(0, i - 3) : i])
        if opened or reported:
            out[2] += weight
            continue
        out[kind - 1] += weight
        out[3] += any(j != i and abs(j - i) <= 12 for j in hits)
        out[4] = max(out[4], weight)
    if hits:
        out[5] = (out[0] + out[1]) / math.sqrt(len(words))
        out[6] = len({words[i][0] for i in hits})
    return [math.log1p(x) for x in out]


def test_score_equals_plain_recomputation(spark):
    rng = random.Random(7)
    texts: list[str | None] = [None, "", "\n\"", "idiot", '"idiot"', "said idiot", 'open " quote idiot']
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(1, 60)):
            kind = rng.random()
            word = rng.choice(WRITTEN) if kind < 0.12 else rng.choice(PLAIN)
            if kind > 0.95:
                word = rng.choice(["said", "called", "wrote"])
            words.append(f'"{word}"' if rng.random() < 0.1 else word)
            if rng.random() < 0.05:
                words.append(rng.choice(['"', "\n", "“"]))
        texts.append(" ".join(words))
    texts.append(" ".join(PLAIN * 5_000) + " idiot")
    mean, scale, beta = np.full(7, 0.25), np.linspace(0.5, 2.0, 7), np.array([0.9, 0.7, -0.6, 0.3, 0.2, 0.4, 0.1, -0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in toxicity.score(df, (ENTRIES, (mean, scale, beta))).collect()}
    assert len(got) == len(texts)
    quoted = 0
    for i, text in enumerate(texts):
        x = np.array(plain_features(text))
        p = 1 / (1 + math.exp(-float((x - mean) / scale @ beta[:-1] + beta[-1])))
        assert abs(got[i]["score"] - p) < 1e-9, text
        for name, value in zip(("exact", "misspelled", "quoted"), np.expm1(x[:3]), strict=True):
            assert abs(got[i][name] - value) < 1e-9, (name, text)
        quoted += x[2] > 0
    assert quoted > 50


def test_quotation_changes_verdicts(spark):
    """The same words, meant and quoted: a model that has seen a few clean texts quote them tells the two apart."""
    rng = random.Random(11)
    bad = ["idiot", "scoundrel", "blockhead", "vermin", "trash", "imbecile"]

    def meant() -> str:
        words = [rng.choice(PLAIN) for _ in range(30)]
        for word in rng.sample(bad, 3):
            words.insert(rng.randrange(len(words)), word)
        return " ".join(words)

    def cited() -> str:
        words = [rng.choice(PLAIN) for _ in range(30)]
        for word in rng.sample(bad, 2):
            words.insert(rng.randrange(len(words)), f'"{word}"')
        return " ".join(words)

    rows = [(i, meant() if i % 2 else cited() if i % 20 == 0 else " ".join(rng.choice(PLAIN) for _ in range(33)), i % 2) for i in range(600)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(train.drop("toxic"), train.select("doc_id", "toxic"))
    fresh = [cited() for _ in range(40)]
    pairs = [(i, t) for i, t in enumerate(fresh)] + [(100 + i, t.replace('"', "")) for i, t in enumerate(fresh)]
    got = {r["id"]: r["score"] for r in toxicity.score(spark.createDataFrame(pairs, "doc_id long, text string"), model).collect()}
    assert sum(got[i] < 0.5 for i in range(40)) >= 36
    assert sum(got[100 + i] >= 0.5 for i in range(40)) >= 36
