"""Texts laid end to end as audio, and the spectra of all their frames."""

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.constants import FRAME_SIZE, LOWEST_MIDI
from pulsegrid.functions import kernels as K
from pulsegrid.operators.series import lay_end_to_end
from pulsegrid.plans import queries as Q
from pulsegrid.sources import recordings as R

ROWS = [(i, "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(1 + i * 37 % 1500))) for i in range(400)]
ROWS += [(7, "again, with an é"), (7, "again, with an é"), (9, ""), (10, None), (401, "x" * 700_001)]
ROWS += [(None, chr(65 + k % 26) * 20_000) for k in range(40)]


def laid():
    parts = {}
    for doc_id, text in sorted((r for r in ROWS if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        parts[None if doc_id is None else doc_id // 200] = parts.get(None if doc_id is None else doc_id // 200, b"") + text.encode()
    return {part: text + b"\0" * (len(text) % 2) for part, text in parts.items()}


def documents(spark, folder):
    spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_short_texts_make_frames_together(spark, tmp_path):
    """Every whole frame of a part's joined texts has its spectrum, though most texts are shorter than a frame."""
    got = {}
    for r in Q.constant_q_spectrum(spark, documents(spark, tmp_path)).collect():
        got.setdefault((r.part, r.frame), {})[r.bin] = r.mag
    want = {}
    for part, text in laid().items():
        x = np.frombuffer(text, "<i2") / 32768
        for frame in range(len(x) // FRAME_SIZE):
            want[part, frame] = K.constant_q_rows(x[None, frame * FRAME_SIZE : (frame + 1) * FRAME_SIZE], LOWEST_MIDI, K.FRAME_CENTRES)[0]
    assert set(got) == set(want) and len(want) > 400 and max(frame for _, frame in want) >= 2 * Q.BLOCK_FRAMES
    for at, row in want.items():
        assert np.allclose([got[at][b] for b in range(88)], row, atol=1.1e-5)


def test_blocks_are_bounded_and_whole(spark, tmp_path):
    blocks = {r.path: bytes(r.content) for r in Q._long_audio(spark, documents(spark, tmp_path)).collect()}
    size = 2 * FRAME_SIZE * Q.BLOCK_FRAMES
    assert max(map(len, blocks.values())) == size
    for part, text in laid().items():
        name = "" if part is None else part
        assert b"".join(blocks[f"{name}:{k}"] for k in range(-(-len(text) // size))) == text


def test_positions_do_not_depend_on_slices(spark):
    rows = spark.createDataFrame([(k, t) for k, t in ROWS if t], "k bigint, t string").withColumn("part", F.expr("k div 200"))
    ranges = ["k", F.substring("t", 1, 4)]
    one, many = (
        sorted((r.part is not None, r.part or 0, r.at, r.t) for r in lay_end_to_end(rows, ["part"], ["k", "t"], "octet_length(t)", ranges, slice_length=n).collect())
        for n in (1 << 30, 1 << 16)
    )
    assert one == many and len(one) == len([t for _, t in ROWS if t])


def test_one_worker_reads_a_task(spark, tmp_path):
    """Frames are not handed from one Python worker of a task to another, in batches of their own."""
    plan = Q.constant_q_spectrum(spark, documents(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_tasks_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    """What a task reads as one batch is bounded by bytes, whatever the number of shuffle partitions is."""
    folder, whole = documents(spark, tmp_path), sum(map(len, laid().values()))
    for task in (1 << 19, 1 << 20):
        monkeypatch.setattr(Q, "TASK_BYTES", task, raising=False)
        dealt = Q._long_audio(spark, folder).groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("content")).alias("n")).collect()
        assert sum(r.n for r in dealt) == whole and len(dealt) > 1
        assert Q._long_audio(spark, folder).rdd.getNumPartitions() == -(-whole // task)


def test_full_frames_are_the_kernel_over_own_samples(spark):
    """Segments overlap; each full-size frame is taken once, what does not fill one is left, failures give no rows."""
    x = np.random.default_rng(5).integers(-30_000, 30_000, 5 * FRAME_SIZE * 16 + 700).astype("<i2")
    files = spark.createDataFrame(
        [("a", bytearray(x.tobytes()), R.RAW_TYPE), ("short", bytearray(x[:9].tobytes()), R.RAW_TYPE), ("none", bytearray(), R.RAW_TYPE), ("bad", bytearray(b"no"), "audio/wav")],
        "path string, content binary, content_type string",
    ).coalesce(1)
    rows = R.decode(files, frames=64, then=R.full_frames(K.constant_q(LOWEST_MIDI), 64), schema=R.FULL_FRAME_SCHEMA).collect()
    got = {r.seg * 16 + r.i: r.out for r in rows}
    want = K.constant_q_rows(x[: len(x) // FRAME_SIZE * FRAME_SIZE].reshape(-1, FRAME_SIZE) / 32768, LOWEST_MIDI, K.FRAME_CENTRES)
    assert {r.recording_id for r in rows} == {"a"} and len(rows) == len(got) == len(want) and max(r.seg for r in rows) >= 4
    assert all(np.allclose(got[k], row, atol=1e-9) for k, row in enumerate(want))


def test_rows_move_once_to_be_placed(spark):
    """NULL keys or not, the join that adds the earlier slices finds the rows where the window over a slice left them."""
    rows = spark.createDataFrame([(k, t) for k, t in ROWS if t], "k bigint, t string").withColumn("part", F.expr("k div 200"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid_out = lay_end_to_end(rows, ["part"], ["k", "t"], "octet_length(t)", ["k", F.substring("t", 1, 4)], slice_length=1 << 16)
        plan = laid_out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # One of the rows, three of the sizes of slices.
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") == 4
    assert sorted(laid_out.columns) == ["at", "k", "part", "t"]
