from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import phrases

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top, longest=5, share=100):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), f in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], f)
    result = []
    for lang in {p[0] for p in candidates}:
        found = []
        for (own, w), a in candidates.items():
            if own != lang or 100 * inside[lang, w] >= share * a:
                continue
            cuts = []
            for k in range(1, len(w)):
                l, r = counts[lang, w[:k]], counts[lang, w[k:]]
                cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            found.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(result)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def mined(docs, least, top, **options):
    return rows_of(phrases.best_collocations(phrases.collocations(docs, least, **options), top))


@pytest.mark.parametrize("least, top, share, bits", [(3, 50, 100, 1 << 16), (5, 2000, 60, 64), (2, 10, 100, 8)])
def test_given_documents(spark, least, top, share, bits):
    """Also with tables so small that every sequence passes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert mined(docs, least, top, share=share, bits=max(bits, 1 << 15)) == brute(rows, least, top, share=share)


def test_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    got = phrases.op11_phrases(spark, SF)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert rows_of(got) == brute(rows, 100, 2000) and got.count() > 10


def test_edge_rows(spark):
    long = "Long LONG word. " * 30000 + "x" * 500_000
    rows = [(None, None), (None, "a b a b"), ("und", "A  B\tA b!a b"), ("en", ""), ("en", " .,; "), ("en", long), ("en", long),
            ("fr", "É é É é É é"), ("fr", "a\x0bb a\x0cb a\xa0b a\xa0b"), ("", "a b c a b c a b c"), ("en", "ABC abc")] * 2
    docs = spark.createDataFrame([(*r, k, "p") for k, r in enumerate(rows)], "lang string, text string, n int, phrase string")
    assert mined(docs, 2, 2000, bits=1 << 16) == brute(rows, 2, 2000)
    assert mined(docs.limit(0), 2, 2000, bits=1 << 16) == []


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With eight fingerprints in all, counts are still those of the words."""
    real = phrases.Words.fingerprints
    monkeypatch.setattr(phrases.Words, "fingerprints", lambda self, k: real(self, k) & np.uint64(7))
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(200)).encode() for _ in range(3)]
    words = phrases.Words(texts, ["x", "y", None])
    words.number_words()
    at = words.frequent(2, SimpleNamespace(value=np.full(8, 255, np.uint8)))
    head, count = phrases.pointers(words, at, words.fingerprints(2)[at], 2)
    got = {(words.langs[words.lang[h]], words.different[words.number[h]], words.different[words.number[h + 1]]): n for h, n in zip(head, count)}
    want = Counter()
    for lang, t in zip(["x", "y", "und"], texts):
        w = t.split()
        want.update((lang, *p) for p in zip(w, w[1:]))
    assert got == want and len(head) == len(want)


def test_scores_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 10**13), ("en", 1, "b", 10**13), ("en", 2, "a b", 9 * 10**12)]
    given = spark.createDataFrame(counts, "lang string, size int, phrase string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: given)
    (r,) = phrases.collocations(given).collect()
    assert r["score"] == 1000 * 9 * 10**12 * 9 * 10**15 // 10**26


def test_tasks_of_the_verification_follow_the_cores(spark):
    texts = spark.createDataFrame([("en", "a b a b")] * 90, "lang string, text string").repartition(45)
    tables = [spark.sparkContext.broadcast(np.full(8, 255, np.uint8)) for _ in range(2)]
    found = phrases.verified(texts, 2, tables)
    assert found.rdd.getNumPartitions() == phrases.TASKS * spark.sparkContext.defaultParallelism < 45
    counts = Counter()
    for r in found.collect():
        counts[r["size"], r["phrase"]] += r["n"]
    assert counts == {(0, ""): 360, (1, "a"): 180, (1, "b"): 180, (2, "a b"): 180, (2, "b a"): 90}


def test_full_tasks_keep_what_they_meet_often():
    """A phrase of each batch is handed on once or twice, not with every batch of others."""
    tables = [SimpleNamespace(value=np.full(8, 255, np.uint8))] * 2
    texts = [f"hot spot. hot spot. {' '.join(f'w{k}x{j}' for j in range(40))}" for k in range(30)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [t]}) for t in texts]
    rows = [r for b in phrases._phrase_batches(2, tables, held=60)(iter(batches)) for r in b.to_pylist()]
    hot = [r["n"] for r in rows if r["phrase"] == "hot spot"]
    assert sum(hot) == 60 and len(hot) <= 2
    counts = Counter()
    for r in rows:
        counts[r["lang"], *r["phrase"].split()] += r["n"] if r["size"] else 0
    assert {n for p, n in counts.items() if p[-1].startswith("w") and p[1] != "spot"} == {1} and len(counts) > 30 * 79


def test_tables_of_bits_are_given_back(spark, monkeypatch):
    made, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: made.append(real(value)) or made[-1])
    docs = spark.createDataFrame([("en", "a b c")] * 5, "lang string, text string")
    assert phrases.frequent_phrases(docs, least=5, bits=1 << 15).count() == 7
    assert len(made) == 5 and not any(Path(t._path).exists() for t in made)
