"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword of signs.  One binary classifier per bit, a ridge regression on hashed
byte n-grams, predicts that bit; decoding takes the language whose codeword has the least
loss over all bits, each bit weighted by how reliably its classifier gets that language right.  A text
whose best and second-best language are nearly as close is flagged as ambiguous.

The classifiers are fitted on the driver from a sample of labelled rows that is spread evenly over all languages:
``SAMPLE_ROWS`` in all, or ``LANGUAGE_ROWS`` a language where that is more; copies of one text count once.  The driver holds
these rows and, with more rows than features, one matrix of ``FEATURES`` squared.  The prediction reads every whole text.

Rows and edge cases: a null text, an empty one and one without a letter are ``und`` with score 0; so is every
text if no language could be learned (as from an empty table).  An empty table gives an empty result and very long
texts are hashed in pieces.  With one learned language every other text gets it.  Null or unseen
values of ``lang`` change nothing, and neither do extra columns.  Repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep.llm.common import as_bytes, read, slices, use_python

FEATURES = 2048
SAMPLE_ROWS = 2000
LANGUAGE_ROWS = 31
"""Rows of each language beyond ``SAMPLE_ROWS / LANGUAGE_ROWS`` languages."""
LOSS_CELLS = 1 << 22
"""Rows x languages x bits compared at once."""
RIDGE = 0.3
AMBIGUOUS = 0.02
"""Least gap of the two best languages' mean losses."""
SHARPNESS = 8.0
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not 97 <= b <= 122 and not 65 <= b <= 90]] = 32


def histograms(texts: list[bytes]) -> np.ndarray:
    """(texts, FEATURES): unit vectors of damped counts of hashed 1- to 4-grams of folded bytes.

    ASCII letters are lower-cased, other ASCII bytes become spaces, all others stay.
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        for at in range(0, len(text), 1 << 20):  # long texts in pieces, 3 bytes overlapping
            code = _FOLD[np.frombuffer(text[max(0, at - 3) : at + (1 << 20)], np.uint8)].astype(np.uint32)
            fresh = 3 if at else 0
            gram = code
            for width in (1, 2, 3, 4):
                if width > 1:
                    gram = gram[:-1] * np.uint32(257) + code[width - 1 :]
                if not len(gram):
                    break
                new = gram[max(0, fresh - width + 1) :]
                slot = ((new * np.uint32(2654435761) + np.uint32(width * 40503)) >> np.uint32(7)) % np.uint32(FEATURES)
                out[row] += np.bincount(slot, minlength=FEATURES)
    np.log1p(out, out=out)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out / np.maximum(norm, 1e-9)


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of signs: the exhaustive code for few languages, a seeded random code for many.

    The exhaustive code has every way to split the languages in two once, so all codewords differ in half the
    bits.  Beyond six languages the random code with the largest least distance of 200 is taken.
    """
    if languages <= 6:
        columns = [(1, *c) for c in product((1, -1), repeat=languages - 1)][1:]
        return np.array(columns, np.float64).T.reshape(languages, -1)
    bits = 10 * int(np.ceil(np.log2(languages))) + 1
    best, widest = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > widest and (np.abs(code.sum(0)) < languages).all():
            best, widest = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    """(languages, bits): share of the language's sample rows whose bit came out right; rows sum to one."""

    def decode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its score and whether the choice is ambiguous."""
        n = len(texts)
        if len(self.languages) < 2:
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        outputs = histograms(texts) @ self.weights + self.bias
        loss = losses(outputs, self.code, self.trust)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        least = loss[np.arange(n), best]
        gap = loss[np.arange(n), order[:, 1]] - least
        score = 1 / np.exp(-SHARPNESS * (loss - least[:, None])).sum(axis=1)
        return best, score, gap < AMBIGUOUS


def losses(outputs: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Weighted hinge loss of each row against each codeword, some rows at a time."""
    step = max(1, LOSS_CELLS // max(1, code.size))
    found = [
        (np.maximum(0, 1 - part[:, None, :] * code[None]) * trust[None]).sum(axis=2)
        for part in (outputs[at : at + step] for at in range(0, len(outputs), step))
    ]
    return np.concatenate(found) if found else np.zeros((0, len(code)))


def fit(texts: np.ndarray, labels: list[str]) -> Model:
    """Fits one ridge regression per bit on the rows' feature vectors, in the form with the smaller matrix."""
    languages = sorted(set(labels))
    count = len(languages)
    if count < 2:
        return Model(languages, np.zeros((count, 0)), np.zeros((FEATURES, 0)), np.zeros(0), np.zeros((count, 0)))
    index = np.array([languages.index(x) for x in labels])
    code = codewords(count)
    target = code[index]
    weight = 1 / np.bincount(index)[index]  # languages count alike
    weight = np.sqrt(weight / weight.mean())[:, None]
    x = np.concatenate((texts, np.ones((len(texts), 1), np.float32)), axis=1) * weight
    if len(x) <= x.shape[1]:
        full = x.T @ np.linalg.solve(x @ x.T + RIDGE * np.eye(len(x)), target * weight)
    else:
        full = np.linalg.solve(x.T @ x + RIDGE * np.eye(x.shape[1]), x.T @ (target * weight))
    weights, bias = full[:-1].astype(np.float32), full[-1]
    right = np.sign(texts @ weights + bias) == target
    trust = np.stack([right[index == k].mean(axis=0) for k in range(count)]) + 1e-6
    return Model(languages, code, weights, bias, trust / trust.sum(axis=1, keepdims=True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        vectors = histograms(as_bytes(batch.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("pick"), pa.array([v.tobytes() for v in vectors], pa.binary())],
            names=["lang", "pick", "vector"],
        )


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on a bounded sample of ``labelled`` (columns ``text``, ``lang``), the same for the same rows.

    Each language's rows are taken by a hash of their text, so copies fall in or out together.
    """
    use_python(labelled.sparkSession)
    rows = labelled.select("text", "lang").where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counts.collect()}  # one row a language
    if not sizes:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    most = max(sample_rows, LANGUAGE_ROWS * len(sizes))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    odds = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, most // len(sizes) / n))])
    picked = rows.withColumn("pick", place / odds[F.col("lang")]).where("pick < 1")
    near = picked.mapInArrow(_features, "lang string, pick double, vector binary").distinct()
    sample = near.orderBy("pick", "vector", "lang").limit(most).toArrow()
    vectors = [np.frombuffer(v, np.float16) for v in sample.column("vector").to_pylist()]
    return fit(np.array(vectors, np.float32).reshape(-1, FEATURES), sample.column("lang").to_pylist())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _identify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches, "text"):
            best, score, ambiguous = model.decode(as_bytes(batch.column("text")))
            no = ~batch.column("__letter").to_numpy(zero_copy_only=False) | (not model.languages)
            found = np.where(no, len(model.languages), best)
            kept = [n for n in batch.schema.names if n != "__letter"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in kept],
                    pa.array(names[found].tolist(), pa.string()),
                    pa.array(np.where(no, 0.0, score)),
                    pa.array(ambiguous | no),
                ],
                names=[*kept, "__lang", "__score", "__ambiguous"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__lang``, ``__score`` (0 to 1) and ``__ambiguous``; only ``text`` is looked at."""
    spark = docs.sparkSession
    use_python(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("__letter", has_letter(F.col("text"))).mapInArrow(
        _identify(shared), f"{schema}, __lang string, __score double, __ambiguous boolean"
    )


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select(
        "doc_id",
        "held_out",
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
        F.col("__ambiguous").alias("ambiguous"),
    )
