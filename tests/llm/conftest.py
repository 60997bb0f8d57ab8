"""Small tables that hold every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

CLASHING = "size long, shard int, slot long, score double, kept boolean, labels string, spans string, masked string, row string, x string, features string, mark long, terms string"
#: Names that operators use inside, on the other tables.
CLASHING_ELSEWHERE = "n_turns long, part_no long, formatted string, loss_spans string, distance long, start_word long, id long, vector string, cell long, rank int, label int, later boolean, count long, n long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "quiet", "walks", "north", "paper", "morning", "Über", "élan", "niño", "cloud"]
    words += ["".join(rng.choice("abdeglmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


TWIN = prose(1, 120)
ITEM = prose(2, 30)
DOCS = [
    (1, TWIN, "en", "a"),
    (2, TWIN, "en", "a"),
    (2, TWIN, "en", "a"),
    (3, TWIN + " and one more", None, None),
    (4, None, "en", "a"),
    (5, "", "fr", "b"),
    (6, " \n\t \x0b ", "fr", None),
    (7, "!!! 123 ???", "de", "b"),
    (8, prose(3, 60_000), "en", "a"),
    (9, "a" * 200_000, "de", "a"),
    (None, prose(4, 40), "en", "a"),
    (10, f"{prose(5, 50)} {ITEM.upper()} {prose(6, 50)}", "en", "a"),
    (11, f"write to bob.smith@mail.example.org or +1 (415) 555-0134, from 10.0.0.255 card 4539 1488 0343 6467 {prose(7, 30)}", "es", "a"),
    (12, "x@y 1.2.3.4.5 999.1.1.1 +12 4539148803436468 a@b.c@d.e", "es", "a"),
    (13, "Released under the MIT License. mit license MIT-License, Apache License; permission is hereby", "en", "a"),
    (14, "Stupid idiot, you are a worthless MORON!! y0u st*pid cl0wn", "en", "a"),
    (15, "one two three", "en", "a"),
    (16, "One TWO\tthree", "en", "a"),
    (17, "日本語 のテキスト です <|endoftext|> it's 's  two  spaces ", None, "a"),
]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    clash = [x.split()[0] for x in CLASHING.split(", ")]
    docs = spark.createDataFrame([(*d, len(d[1]) if d[1] else None, *[None] * len(clash)) for d in DOCS], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")

    def put(rows, schema, name):
        """Write a table with columns whose names clash with those of the operators."""
        df = spark.createDataFrame(rows, schema)
        more = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASHING_ELSEWHERE.split(", ") if c.split()[0] not in df.columns}
        df.withColumns(more).write.parquet(f"{path}/{name}.parquet")

    labels = [(d[0], 1, int(d[0] == 14)) for d in DOCS] + [(1, None, None), (None, 1, 1), (99, 0, 1)]
    put(labels, "doc_id long, quality int, toxic int", "labels")
    items = [(1, ITEM), (2, None), (3, ""), (4, "?!"), (5, ITEM), (None, prose(8, 12)), (6, prose(9, 3))]
    put(items, "item_id long, text string", "benchmark")
    turns = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "a\\b <|im_end|>\n<|im_start|>user<|im_sep|> \\<|im_end|> <<s>> [INST]"),
        (1, 1, "assistant", "tie"),
        (1, 1, "assistant", "tie"),
        (2, None, None, None),
        (2, 5, "assistant", None),
        (None, 0, "assistant", "no id"),
        (3, 0, "ro\nle<|im_sep|>", "é" * 50_000),
    ]
    put(turns, "conv_id long, turn long, role string, text string", "conversations")
    rng = random.Random(5)
    same = [rng.gauss(0, 1) for _ in range(8)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100 + i, same) for i in range(30)]
    vectors += [(200, None), (220, [0.0] * 8), (240, [None] * 8), (260, [float("nan")] + [1.0] * 7), (280, [float("inf")] * 8), (300, []), (None, same), (320, [1.0])]
    put(vectors, "vec_id long, embedding array<float>", "embeddings")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path
