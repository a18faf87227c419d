from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lorekeep.llm import periods

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words, length=6, exponent=4):
    """Every maximal stretch with its smallest period, by extending each period from each position."""
    found = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(length, exponent * q):
                found.setdefault((i, size), q)  # smaller periods come first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start = best or (None, None, None)
    milli = 1000 * best[1] // best[2] if best else None
    return (str(doc_id), len(runs), *start, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (4, 2), (9, 3), (1, 5)])
def test_runs_of_random_words(length, exponent):
    rng = random.Random(length * 10 + exponent)
    for _ in range(400):
        alphabet = rng.choice([1, 2, 3, 5])
        words = [rng.randrange(alphabet) for _ in range(rng.choice([0, 1, 5, 20, 60, 120]))]
        if rng.random() < 0.5 and words:
            unit = words[: rng.randrange(1, 6)]
            words += unit * rng.randrange(2, 9) + words
        got = periods.find_runs(np.array(words, np.int64), length, exponent)
        assert [tuple(r) for r in got.tolist()] == brute_runs(words, length, exponent), words


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = periods.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted((str(r["doc_id"]), *r[1:]) for r in got.collect())
    assert rows == sorted(expected(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in rows) > 5


def test_edge_rows(spark, folder):
    long = " ".join(f"w{k}" for k in range(3000)) + " tail" * 40000 + " " + "x" * 1_000_000
    rows = [(1, None), (1, ""), (None, " \t\n "), (None, "a a a a a a"), (20, "é é\x0bé é\ré é ü"), (3, long), (3, long), (4, "    " * 9)]
    rows += [(k, f"{k} " + "x y " * (k % 9) + "end") for k in range(100, 160)]
    extra = [(*r, "runs", k, None) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(extra, "doc_id bigint, text string, runs string, words int, `a b` double")
    docs.select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    got = sorted((str(r["doc_id"]), *r[1:]) for r in periods.op12_periodic_runs(spark, folder).collect())
    quick = lambda d, t: expected(d, t) if t is not long else None
    want = [quick(*r) for r in rows if r[1] is not long]
    assert sorted(r for r in got if r[0] != "3") == sorted(want)
    found = periods.with_runs(docs)
    assert found.columns == ["doc_id", "runs", "words", "a b", "__words", "__runs", "__collapsed"]
    for r in found.collect():
        text = rows[r["words"]][1]
        assert r["__words"] == len(words_of(text))
        if text is long:
            assert [tuple(x) for x in r["__runs"]] == [(3000, 40000, 1)]
            assert r["__collapsed"] == " ".join(f"w{k}" for k in range(3000)) + " tail " + "x" * 1_000_000
        else:
            runs = brute_runs(words_of(text))
            assert [tuple(x) for x in r["__runs"]] == runs and r["__collapsed"] == collapsed(words_of(text), runs)
    assert periods.with_runs(docs.limit(0)).count() == 0
