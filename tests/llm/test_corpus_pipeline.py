"""Each stage of the pipeline on its own input, and the whole on odd and empty tables."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from pulsegrid.llm import decontaminate, neardup

STAGES = dict(pipeline.STAGES)


def ids(df):
    return sorted(map(str, (r["doc_id"] for r in df.select("doc_id").collect())))


def test_stages(spark, tmp_path):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, n = docs.columns, 0
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        n = docs.count()
        if name == "near_duplicates":
            marked = neardup.near_duplicates(before)
            assert ids(docs) == ids(marked.where("kept")) and n < before.count()
        elif name == "decontamination":
            hit = decontaminate.contaminated(before, spark.read.parquet(f"{path}/benchmark.parquet"))
            assert n == before.count() - hit.select("doc_id").distinct().count()
        elif name == "personal_data":
            assert ids(docs) == ids(before)
            assert docs.where(r"text rlike '[a-z0-9]@[a-z0-9]+\\.[a-z]' or n_chars <> length(text)").count() == 0
    packed = STAGES["packing"](spark, docs, path)
    assert packed.select("doc_id").distinct().count() == n


def test_odd_and_empty(spark, odd_dir, empty_dir):
    assert pipeline.run(spark, empty_dir).count() == 0
    found = {r["doc_id"] for r in pipeline.run(spark, odd_dir).select("doc_id").collect()}
    assert {1, 4, 5, 6, 7, 8, 9, 11, 15, None} <= found and not {2, 3, 10, 16} & found


def test_near_duplicates_by_row_and_text(spark, odd_dir):
    """Ids that clash lose no text: one row of each group of texts stays, and every row of none."""
    stage = STAGES["near_duplicates"]
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = STAGES["near_duplicates"](spark, docs.unionByName(docs.where("doc_id in (8, 15)")), odd_dir)
    assert ids(kept) == sorted(map(str, {r["doc_id"] for r in docs.collect()} - {2, 3, 16}))
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abdeglm") * rng.randint(2, 9) + rng.choice("noprstu") for _ in range(60)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2].upper()), (2, texts[2]), (3, texts[1] + " too"), (4, texts[3])]
    rows += [(5, texts[3]), (5, texts[4]), (None, texts[0]), (None, texts[5]), (None, texts[5]), (6, None), (6, ""), (6, "a b"), (7, "a b"), (7, texts[4])]
    rows += [(8, texts[2])] * 40
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, size long").repartition(3)
    got = stage(spark, table, odd_dir)
    assert got.columns == table.columns
    left = Counter((r["doc_id"], r["text"].lower() if r["text"] else r["text"]) for r in got.collect())
    want = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (4, texts[3]), (5, texts[4]), (None, texts[0]), (None, texts[5]), (None, texts[5]), (6, None), (6, ""), (6, "a b")]
    assert left == Counter((i, t.lower() if t else t) for i, t in want)
