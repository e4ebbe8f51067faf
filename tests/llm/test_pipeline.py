"""The pipeline's stages where ids are null or repeat."""

import corpus_pipeline

from .cases import documents

WORDS = [f"word{k}" for k in range(400)]
ITEM = "which of the seven harbours lies furthest from the old lighthouse on the northern coast"


def text(k):
    return " ".join(WORDS[(k * 37 + j * (k + 3)) % 400] for j in range(40))


def texts_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_near_stage_keeps_distinct_texts_whatever_their_ids(spark):
    same_id, nulls = [(1, text(k)) for k in range(4)], [(None, text(k)) for k in range(4, 9)]
    copies = [(5, text(0)), (None, text(0)), (None, text(4)), (1, text(1)), (7, None), (8, "")]
    got = corpus_pipeline.near_stage(spark, documents(spark, same_id + nulls + copies), "")
    assert got.columns == documents(spark).columns
    assert texts_of(got) == texts_of(documents(spark, [*same_id, *nulls, (7, None)]))


def test_leak_stage_drops_the_leaking_rows_alone(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, text(k)) for k in range(3)] + [(4, text(5)), (None, None), (6, text(6))]
    leaking = [(None, "x " + ITEM), (4, ITEM + " y"), (9, ITEM)]
    got = corpus_pipeline.leak_stage(spark, documents(spark, clean + leaking), str(tmp_path))
    assert texts_of(got) == texts_of(documents(spark, clean))
