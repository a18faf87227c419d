from __future__ import annotations

import corpus_pipeline
from lorekeep.llm import packing
from tests.llm import test_nearcopies, test_packing, test_wordspans

SF = "/root/testdata/sf0.001"


def stage(spark, folder, number, docs):
    name, fn = corpus_pipeline.STAGES[number]
    fn(spark, docs, SF).write.parquet(f"{folder}/{number}-{name}")
    return spark.read.parquet(f"{folder}/{number}-{name}")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = stage(spark, folder, 0, docs)
    assert sorted(pairs(first)) == sorted(pairs(docs)) and first.columns == docs.columns
    second = stage(spark, folder, 1, first)
    kept = test_nearcopies.survivors(pairs(first))
    assert sorted(pairs(second)) == sorted(p for p in pairs(first) if p[0] in kept) and len(kept) < first.count()
    third = stage(spark, folder, 2, second)
    rows = pairs(second)
    want = dict(zip((d for d, _ in rows), test_wordspans.expected([t for _, t in rows], 50)))
    assert third.count() == second.count() and third.dtypes == docs.dtypes
    assert dict(pairs(third)) == want and want != dict(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect())
    fourth = stage(spark, folder, 3, third)
    assert sorted(pairs(fourth)) == sorted(pairs(third)) and fourth.columns == docs.columns
    fifth = corpus_pipeline.STAGES[4][1](spark, fourth, SF).collect()
    test_packing.check(pairs(fourth), fifth, packing.MAX_TOKENS, packing.BUCKETS, packing.BATCH_TOKENS)
    # batches follow the mixed order of the files
    order = {r[0]: k for k, r in enumerate(fourth.orderBy("_metadata.file_path", "_metadata.row_index").select("doc_id").collect())}
    inside = sorted((r["bucket"], r["batch"], r["place"], order[r["doc_id"]]) for r in fifth)
    assert all(a[3] <= b[3] for a, b in zip(inside, inside[1:]) if a[0] == b[0])


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_edge_rows_in_every_stage(spark, folder):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "123 !", None), (4, text, "en"), (4, text, "en"), (5, text + " more", "en"),
        (None, "only null here to stay", "de"), (None, "another null row that stays too", None), (6, "x " * 100000, "de"),
        (7, "short", "en"), (7, "short but other words", "en"),
    ]
    df = spark.createDataFrame(
        [(*r, None if k % 3 else "s", len(r[1] or ""), 1, "c") for k, r in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, component_id string",
    )
    for docs in (df, df.limit(0)):
        root = f"{folder}/{docs.count()}"
        kept = [docs]
        for number in range(4):
            kept.append(stage(spark, root, number, kept[-1]))
            assert kept[-1].columns == docs.columns
        corpus_pipeline.STAGES[4][1](spark, kept[-1], SF).collect()
        if docs is df:
            ids = lambda d: sorted(str(r["doc_id"]) for r in d.collect())
            assert ids(kept[1]) == sorted(str(r[0]) for r in rows if r[0] not in (1, 2, 3))
            assert ids(kept[2]) == ["4", "6", "7", "7", "None", "None"]
            assert ids(kept[4]) == ids(kept[2])
    plain = spark.createDataFrame([(1, "in memory")], "doc_id bigint, text string")
    assert corpus_pipeline.packing(spark, plain, SF).count() == 1
