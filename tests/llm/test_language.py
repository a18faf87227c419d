from __future__ import annotations

import zlib

import numpy as np
import pytest

from lorekeep.llm import language
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(truth)
    for doc, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
    held = [d for d, r in got.items() if r["held_out"]]
    right = sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held)
    assert len(held) > 200 and right > 0.97, right


def test_prediction_reads_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    plain = docs.select("doc_id", "text")
    moved = docs.selectExpr("doc_id + 5 as doc_id", "text", "'xx' as lang", "'s' as source")
    a = {r["doc_id"]: (r["__lang"], r["__score"]) for r in language.identify(plain, model).collect()}
    b = {r["doc_id"] - 5: (r["__lang"], r["__score"]) for r in language.identify(moved, model).collect()}
    assert a == b
    assert model.decode([b"xy"] * 2)[0].shape == (2,)


def test_edge_rows(spark):
    rows = [
        (1, "the and of the", "en"), (1, "the and of the", "en"), (2, "der und die", "de"), (3, None, "en"),
        (4, "", "de"), (5, "123 !?", None), (None, "the of", None), (6, "你好", "zh"), (7, "the of and " * 60000, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, score string")
    model = language.train(df)
    assert model.languages == ["de", "en", "zh"]
    got = [(r["doc_id"], r["__lang"]) for r in language.identify(df, model).orderBy("doc_id").collect()]
    assert got == [(None, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "zh"), (7, "en")]
    nothing = language.train(df.limit(0))
    assert {r["__lang"] for r in language.identify(df, nothing).collect()} == {"und"}
    one = language.train(df.where("lang = 'en'"))
    assert {r["__lang"] for r in language.identify(df, one).collect()} == {"und", "en"}
    assert language.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize("count", [2, 3, 4, 6, 7, 40])
def test_codewords_are_apart(count):
    code = language.codewords(count)
    apart = (code.shape[1] - code @ code.T) / 2
    np.fill_diagonal(apart, 99)
    assert apart.min() >= (1 if count == 2 else 2 if count < 7 else 5)
    assert (np.abs(code.sum(0)) < count).all()


def test_close_calls_are_flagged():
    code = language.codewords(3)
    model = language.Model(["a", "b", "c"], code, np.zeros((language.FEATURES, 3)), np.zeros(3), np.full((3, 3), 1 / 3))
    assert model.decode([b"anything"])[2].all()


def slow_features(text: bytes) -> np.ndarray:
    """Gram by gram, in Python numbers."""
    folded = [b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in text]
    found = np.zeros(language.FEATURES)
    for width in (1, 2, 3, 4):
        for at in range(len(folded) - width + 1):
            code = 0
            for b in folded[at : at + width]:
                code = (code * 257 + b) % 2**32
            found[((code * 2654435761 + width * 40503) % 2**32 >> 7) % language.FEATURES] += 1
    found = np.log1p(found)
    return found / max(np.sqrt((found**2).sum()), 1e-9)


def test_model_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    texts, labels = [r["text"].encode()[:400] for r in docs], [r["lang"] for r in docs]
    x = np.array([slow_features(t) for t in texts])
    assert np.abs(language.histograms(texts) - x).max() < 1e-5
    model = language.fit(x.astype(np.float32), labels)
    names = sorted(set(labels))
    index = [names.index(v) for v in labels]
    weight = np.array([1 / labels.count(v) for v in labels])
    weight = np.sqrt(weight / weight.mean())[:, None]
    code = language.codewords(len(names))
    dense = np.hstack((x, np.ones((len(x), 1)))) * weight
    fitted = np.linalg.lstsq(
        np.vstack((dense, np.sqrt(language.RIDGE) * np.eye(dense.shape[1]))),
        np.vstack((code[index] * weight, np.zeros((dense.shape[1], code.shape[1])))),
        rcond=None,
    )[0]
    assert np.abs(fitted[:-1] - model.weights).max() < 1e-3 and np.abs(fitted[-1] - model.bias).max() < 1e-3
    best, score, _ = model.decode(texts)
    for row in range(0, len(texts), 7):
        out = x[row] @ fitted[:-1] + fitted[-1]
        loss = [sum(t * max(0, 1 - o * c) for o, c, t in zip(out, code[k], model.trust[k])) for k in range(len(names))]
        shares = np.exp(-language.SHARPNESS * np.array(loss))
        assert best[row] == np.argmin(loss) and abs(score[row] - shares.max() / shares.sum()) < 1e-2


@pytest.mark.parametrize("rows", [90, language.FEATURES + 200])
def test_both_forms_of_the_fit_agree(rows):
    rng = np.random.default_rng(2)
    x, labels = rng.random((rows, language.FEATURES), np.float32), [str(k % 3) for k in range(rows)]
    model = language.fit(x, labels)
    code = language.codewords(3)[[int(v) for v in labels]]
    wide = np.hstack((x, np.ones((rows, 1), np.float32))).astype(np.float64)
    left = wide.T @ (wide @ np.vstack((model.weights, model.bias))) + language.RIDGE * np.vstack((model.weights, model.bias))
    assert np.abs(left - wide.T @ code).max() / np.abs(wide.T @ code).max() < 1e-2


def test_seventy_languages_are_all_learned(spark):
    rng = np.random.default_rng(5)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrst"), 5)) for _ in range(12)] for _ in range(70)]
    rows = [(f"l{k:02}", " ".join(rng.choice(words[k], 30))) for k in range(70) for _ in range(40 if k else 400)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language.train(df)
    assert len(model.languages) == 70
    got = language.identify(df, model).select("lang", "__lang").collect()
    right = [r["lang"] == r["__lang"] for r in got]
    assert sum(right) / len(right) > 0.97 and {r["__lang"] for r in got} == set(model.languages)


def test_losses_by_slices(monkeypatch):
    rng = np.random.default_rng(1)
    out, code, trust = rng.normal(size=(23, 5)), rng.choice([-1.0, 1.0], (4, 5)), rng.random((4, 5))
    whole = language.losses(out, code, trust)
    monkeypatch.setattr(language, "LOSS_CELLS", 41)
    assert np.allclose(language.losses(out, code, trust), whole) and language.losses(out[:0], code, trust).shape == (0, 4)
