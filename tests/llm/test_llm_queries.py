"""Each numbered query on odd and empty tables against plain versions, and against its SQL where there is one."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pulsegrid.llm import chat, licences, packing, privacy, sharding
from pulsegrid.llm.queries import ORACLE, QUERIES, tokenizer_path
from tokenizers import Tokenizer

TABLES = ("documents", "labels", "benchmark", "conversations", "embeddings")


def held_out(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def rows(spark, name, path):
    return [r.asDict() for r in QUERIES[name](spark, path).collect()]


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert len(rows(spark, name, empty_dir)) == (1 if name == "op2_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(ORACLE[name]).columns)
    expected = con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, expected))


# op1


def test_language_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    found = rows(spark, "op1_language_id", path)
    assert {r["doc_id"] for r in found} == set(truth)
    assert all(r["held_out"] == (held_out(r["doc_id"], 5) == 0) for r in found)
    later = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in later]) > 0.95
    assert all(r["lang"] in (r["lang_pred"], "und") and r["rejected"] == (r["margin"] < 0.01) for r in found)


def test_language_odd(spark, odd_dir):
    found = rows(spark, "op1_language_id", odd_dir)
    assert len(found) == len(documents(spark, odd_dir))
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 7))
    assert by[15]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in found)


def test_language_brute_force(spark):
    """Sizes by a plain loop over pieces and dictionaries, on all rows of the small tables."""
    import zstandard
    from pulsegrid.llm import langid
    from pulsegrid.llm.queries import remainder
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, train=~(remainder(5) == 0))
    assert len(model.dictionaries) > 2
    found = {r["doc_id"]: r for r in langid.identify(docs, model, F.lit(False)).collect()}
    for doc, text in documents(spark, "/root/testdata/sf0.001"):
        plain = "".join(c if c.isalpha() else " " for c in text or "").split()
        data = " ".join(plain).lower().encode()
        sizes = {}
        for lang, held in model.dictionaries.items():
            for at in range(0, len(data), 1024):
                one = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[lang] = sizes.get(lang, 0) + len(one.compress(data[at : at + 1024]))
        best = min(sizes, key=lambda x: (sizes[x], x)) if sizes else "und"
        # A precomputed dictionary may choose other matches: a byte or two a piece.
        got = found[doc]["lang_best"]
        assert got == best or sizes[got] - sizes[best] <= 2 * (1 + len(data) // 1024)


def test_many_languages(spark):
    """More languages than the sample has room for at full size: each keeps an excerpt."""
    from pulsegrid.llm import langid
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:6]
        words = ["".join(rng.choice(letters, 5)) for _ in range(12)]
        rows += [(3 * k + j, " ".join(rng.choice(words, 60)), f"l{k}") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, train=F.lit(True), sample=400)
    assert len(model.dictionaries) == 300
    found = langid.identify(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r["lang_best"] == truth[r["doc_id"]] for r in found]) > 0.95


# op2


def test_chat_odd(spark, odd_dir):
    turns = spark.read.parquet(f"{odd_dir}/conversations.parquet").collect()
    said = defaultdict(list)
    key = lambda t: ((t["turn"] is not None, t["turn"] or 0), (t["role"] is not None, t["role"] or ""), (t["text"] is not None, t["text"] or ""))
    for t in sorted(turns, key=key):
        said[t["conv_id"]].append((t["role"] or "", t["text"] or ""))
    said[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in rows(spark, "op2_chat_format", odd_dir)}
    assert set(found) == set(said)
    for conv, whole in said.items():
        learned = "".join(t for r, t in whole if r == "assistant")
        got = found[conv]
        assert got["n_turns"] == len(whole) and got["loss_chars"] == len(learned)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in whole).encode()).hexdigest()
        assert got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_parts_of_one_hot_conversation(spark):
    turns = spark.range(3000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('</s> ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be read as one
    parts = chat.format_chats(turns.repartition(5), part_bytes=4096)
    collected = parts.collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p["part_partition"] for p in collected}) > 1 and max(len(p["formatted"]) for p in collected) <= 4096
    assert all(s not in p["formatted"] for p in collected for s in ("</s>", "[INST]"))
    got = chat.digests(parts).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 3000
    whole = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n</s> {i}\n" for i in range(3000))
    assert got[0]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


# op3


def shard_of(key, tree):
    """The tree walked by plain loops."""
    name = "\0null" if key is None else str(key)

    def draw(label, weight):
        h = xxhash.xxh64(f"{name}|{label}".encode(), seed=42).intdigest()
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    weigh = lambda keep: sum(x.weight for x in tree if keep(x))
    region = min({x.region for x in tree}, key=lambda r: draw(f"region {r}", weigh(lambda x: x.region == r)))
    racks = {x.rack for x in tree if x.region == region}
    rack = min(racks, key=lambda k: draw(f"rack {region}/{k}", weigh(lambda x: (x.region, x.rack) == (region, k))))
    return min((x for x in tree if (x.region, x.rack) == (region, rack)), key=lambda x: draw(f"shard {x.shard}", x.weight)).shard


def check_shards(spark, path):
    docs = documents(spark, path)
    found = rows(spark, "op3_sharding", path)
    plain = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(map(str, (plain(*d) for d in docs))) == sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    tree = sharding.topology(40)
    for r in found[:300]:
        assert r["shard"] == shard_of(r["doc_id"], tree)
    return slots


def test_shards(spark, odd_dir):
    check_shards(spark, odd_dir)
    assert len(check_shards(spark, "/root/testdata/sf0.01")) == 40


def test_weights_move_only_their_subtree(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.topology(40)
    other = sharding.reweighted(tree, {0: 2.0})
    both = sharding.with_shard(sharding.with_shard(ids, "doc_id", tree), "doc_id", other, "later").collect()
    place = {x.shard: (x.region, x.rack) for x in tree}
    moved = [(r["shard"], r["later"]) for r in both if r["shard"] != r["later"]]
    assert moved and all(place[b] == place[0] or place[b][0] == place[0][0] for _, b in moved)
    share = np.bincount([r["later"] for r in both], minlength=40) / len(both)
    assert abs(share[0] - 2 / 41) < 0.006 and abs(share[1:].mean() - 1 / 41) < 0.002


# op4


def test_decontamination(spark, odd_dir):
    found = rows(spark, "op4_decontamination", odd_dir)
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(10, 1), (10, 5)}
    assert all(r["distance"] == 0 and r["item_words"] == 30 and r["start_word"] == 50 for r in found)


def test_decontamination_recall_of_edited_passages(spark):
    from pulsegrid.llm import decontaminate

    rng = np.random.default_rng(1)
    items = [" ".join(f"w{rng.integers(0, 4000)}" if rng.random() < 0.6 else "the" for _ in range(int(rng.integers(12, 60)))) for _ in range(60)]
    docs, wanted = [], set()
    for d in range(240):
        words = items[d % 60].split()
        for _ in range(int(0.2 * len(words))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 9999)}"
        before = [f"w{rng.integers(0, 4000)}" for _ in range(80)]
        docs.append((d, " ".join([*before, *words, *before])))
        wanted.add((d, d % 60))
    docs += [(1000 + d, " ".join(f"w{rng.integers(0, 4000)}" for _ in range(200))) for d in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert len(wanted & got) >= 0.98 * len(wanted) and not got - wanted
    clean = {r["doc_id"] for r in decontaminate.uncontaminated(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    passes = decontaminate.contaminated(frame, bench, decontaminate.Settings(block_items=25))
    assert len({(r["doc_id"], r["item_id"]) for r in passes.collect()} & wanted) >= 0.98 * len(wanted)


@pytest.mark.parametrize("size", [8, 16, 31, 32])
def test_decontamination_whole_at_the_allowed_rate(spark, size):
    from pulsegrid.llm import decontaminate

    rng = np.random.default_rng(size)
    items = [[f"w{rng.integers(0, 10**6)}" for _ in range(size)] for _ in range(40)]
    docs = []
    for d in range(400):
        words = list(items[d % 40])
        spread = rng.choice(size, size // 4, replace=False) if d % 2 else np.arange(d // 2 % 4, size, 4)[: size // 4]
        for k in spread.tolist():
            words[k] = f"e{rng.integers(0, 10**6)}"
        around = [f"x{rng.integers(0, 10**6)}" for _ in range(40)]
        docs.append((d, " ".join([*around[:20], *words, *around[20:]])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(d, d % 40) for d in range(400)}


def test_decontamination_walks_stay_inside_items(spark):
    from pulsegrid.llm import decontaminate

    rng = np.random.default_rng(2)
    items = [" ".join(f"w{rng.integers(0, 10**6)}" for _ in range(n)) for n in [1] * 5 + [2] * 80 + [3, 4, 5, 8, 9, 16, 17, 33] * 3]
    items += [f"often w{k}" for k in range(40)]
    index = decontaminate.Index(list(range(len(items))), items, decontaminate.Settings())
    for walk, _, held, _ in index.tables:
        for i, start in zip(*held, strict=True):
            words = index.words[i]
            running = np.concatenate([words, rng.integers(1, 1 << 62, 99, dtype=np.uint64)])
            assert walk.levels(words, start)[-1] == walk.signatures(running, np.array([start]))[1][0]
    docs = [(k, f"before it {x} come {k} others") for k, x in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} >= {(k, k, 0) for k in range(len(items))}


def planted(size, n, seed):
    """`n` items of `size` words and a document for each, with a quarter of the words edited at random places."""
    from pulsegrid.llm import decontaminate

    rng = np.random.default_rng([seed, size])
    items = [[f"w{rng.integers(0, 3000)}" if rng.random() < 0.7 else f"the{rng.integers(0, 5)}" for _ in range(size)] for _ in range(n)]
    docs = []
    for words in items:
        changed = decontaminate.edited(np.arange(1, size + 1, dtype=np.uint64), size // 4, rng).tolist()
        said = [words[k - 1] if k <= size else f"e{k}" for k in changed]
        around = [f"x{rng.integers(0, 3000)}" for _ in range(60)]
        docs.append(" ".join([*around[:30], *said, *around[30:]]))
    return [" ".join(x) for x in items], docs


def test_decontamination_by_walks_alone(spark):
    """At each of many lengths walks find 0.97 of the passages with a quarter of their words edited, 0.99 of all; no piece helps."""
    from pulsegrid.llm import decontaminate

    s = decontaminate.Settings(exact=False)
    hits = {}
    for size in [8, 9, 11, 12, 15, 16, 19, 24, 27, 31, 32, 37, 45, 50, 57, 63, 64]:
        items, docs = planted(size, 200, 5)
        index = decontaminate.Index(list(range(len(items))), items, s)
        assert not index.pieces and not index.short
        found = {(d, i) for d, i, *_ in decontaminate._found(pa.array(docs), index, s)}
        hits[size] = np.mean([(k, k) in found for k in range(200)])
        without = decontaminate.Index(list(range(len(items))), items, s)
        without.tables, without.begins = [], ([], [])
        assert not list(decontaminate._found(pa.array(docs), without, s))
    assert min(hits.values()) >= 0.97 and np.mean(list(hits.values())) >= 0.99, hits


def test_decontamination_says_what_the_walks_found(spark):
    from pulsegrid.llm import decontaminate

    items, docs = zip(*(planted(size, 60, 6) for size in (8, 20, 40)), strict=True)
    items, docs = sum(items, []), sum(docs, [])
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [r for r in decontaminate.contaminated(frame, bench).collect() if r["doc_id"] == r["item_id"]]
    assert len(got) == len(docs) and 0.98 <= np.mean([r["by_walk"] for r in got]) <= 1
    # Where walks are not allowed enough repetitions, pieces find the rest, and only what they find says so.
    few = decontaminate.Settings(exact=False, max_repetitions=1)
    got = [r for r in decontaminate.contaminated(frame, bench, few).collect() if r["doc_id"] == r["item_id"]]
    assert len(got) == len(docs) and 0.05 < np.mean([r["by_walk"] for r in got]) < 0.9


def plain_distance(item, words):
    """Smallest edit distance of `item` to any run of `words`, by the whole table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
    return min(row)


def test_decontamination_brute_force(spark, sf_dir):
    """All documents against all items of the small tables."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in t or ""))
    items = {r["item_id"]: fold(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for doc, text in documents(spark, sf_dir):
        words = fold(text)
        held = Counter(words)
        for i, item in items.items():
            most = len(item) // 4
            # Too few words in common for any run.
            if not item or sum(min(n, held[w]) for w, n in Counter(item).items()) < len(item) - most:
                continue
            d = plain_distance(item, words)
            if d <= most:
                want.add((doc, i, d))
    found = rows(spark, "op4_decontamination", sf_dir)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == want and len(found) == len(want)


# op5


@pytest.mark.parametrize("size", ["odd", "/root/testdata/sf0.01"])
def test_packing_round_trip(spark, odd_dir, size):
    path = odd_dir if size == "odd" else size
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = documents(spark, path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in docs}
    found = rows(spark, "op5_packing", path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        whole = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(whole)
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, whole in ids.items():
        copies = sum(d == i for d, _ in docs)
        assert sum(n for _, n in pieces[i]) == copies * len(whole)
        covered = np.zeros(len(whole), int)
        for a, n in pieces[i]:
            covered[a : a + n] += 1
        assert (covered == copies).all()
    padding = total = 0
    for x in sequences.values():
        at = 0
        for a, n in sorted(x):
            assert a == at
            at += n
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * total


def test_least_squares():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 30)), np.where(rng.random(30) < 0.2, rng.random(30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    listed = packing.combinations(16, 3)
    assert len(set(listed)) == len(listed) and all(sum(c) == 16 for c in listed)


# op6


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.75), ("sf0.1", 0.85)])
def test_toxicity(spark, size, least):
    path = f"/root/testdata/{size}"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    found = rows(spark, "op6_toxicity", path)
    assert len(found) in (1000, 10_000) and all(r["held_out"] == (held_out(r["doc_id"], 3) == 1) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    later = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    hot, cold = [s for s, y in later if y], [s for s, y in later if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in hot for b in cold]) > least
    assert np.mean([s >= 0.7 for s in cold]) < 0.03 and np.mean([s >= 0.7 for s in hot]) >= 0.6


def grown(model):
    """The trees of a model as nested tuples (feature, threshold, left, right) or predictions, read from their description."""
    trees = []
    for tree in model.trees.trees:
        lines = [line for line in tree.toDebugString.splitlines()[1:] if line.strip()]

        def node(depth, lines=lines):
            line = lines.pop(0).strip()
            if line.startswith("Predict:"):
                return float(line.split()[1])
            feature, threshold = re.search(r"feature (\d+) <= ([-\d.eE]+)", line).groups()
            left = node(depth + 1)
            assert lines.pop(0).strip().startswith("Else")
            return int(feature), float(threshold), left, node(depth + 1)

        trees.append(node(0))
    return trees


def test_toxicity_brute_force(spark):
    """The score of the same trees and calibration by plain loops, text by text."""
    from pulsegrid.llm import toxicity
    from pulsegrid.llm.queries import toxicity_model

    path = "/root/testdata/sf0.1"  # enough labels for a calibration
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity_model(docs, spark.read.parquet(f"{path}/labels.parquet"))
    measure, trees, weights = toxicity.Measure(model.lexicon), grown(model), model.trees.treeWeights
    bounds, values = list(model.calibration.boundaries), list(model.calibration.predictions)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for doc, text in documents(spark, path):
        (x,) = measure(pa.array([text]))
        total = 0.0
        for tree, weight in zip(trees, weights, strict=True):
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            total += weight * tree
        p = 1 / (1 + math.exp(-2 * total))
        assert found[doc] == pytest.approx(min(1, max(0, np.interp(p, bounds, values))), abs=1e-9)
    assert len(trees) == 24 and len(set(found.values())) > 10


def test_toxicity_odd(spark, odd_dir):
    found = rows(spark, "op6_toxicity", odd_dir)
    assert len(found) == len(documents(spark, odd_dir)) and all(0 <= r["score"] <= 1 for r in found)


# op7


def test_licences(spark, odd_dir):
    for path in (odd_dir, "/root/testdata/sf0.01"):
        wanted = defaultdict(list)
        for i, t in documents(spark, path):
            words, places, labels = licences.words_of(t or ""), [], set()
            for phrase, label in licences.BASE.items():
                p = phrase.split()
                hits = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
                places += hits
                labels |= {label} if hits else set()
            wanted[i].append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
        for r in rows(spark, "op7_licence_scan", path):
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in wanted[r["doc_id"]]
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = {r["doc_id"]: r["labels"] for r in rows(spark, "op7_licence_scan", odd_dir)}
    assert got[13] == "apache,mit" and got[4] == ""


def test_licence_templates(spark):
    texts = [(k, f"lead in words {t.text} and then others follow") for k, t in enumerate(licences.TEMPLATES)]
    texts += [(1000 + k, "the work is of the people and for the people by version of the terms " * 30) for k in range(60)]
    found = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, t in enumerate(licences.TEMPLATES):
        assert t.label in found[k]["labels"].split(","), t
    assert all(found[1000 + k]["labels"] == "" for k in range(60))


def test_licence_labels_brute_force(spark):
    """All documents against all templates: phrases by plain search, the template's weight over every band of diagonals."""
    sf_dir = "/root/testdata/sf0.01"
    docs = documents(spark, sf_dir)
    s = licences.Settings()
    split = [(d, licences.words_of(t or "")) for d, t in docs]
    n = Counter(w for _, words in split for w in set(words))
    want = {}
    for d, words in split:
        labels, score, at = {label for phrase, label in licences.BASE.items() if f" {phrase} " in f" {' '.join(words)} "}, 0.0, defaultdict(list)
        base = bool(labels)
        for k, w in enumerate(words):
            at[w].append(k)
        for template in licences.TEMPLATES:
            said = licences.words_of(template.text)
            weight = [math.log((len(docs) + 1) / (n[w] + 1)) + 1e-3 for w in said]
            phrases = [licences.words_of(p) for p in template.mandatory]
            places = [(q, k - q) for p in phrases for q in [licences.Index._place(said, p)] for k in at[p[0]] if words[k : k + len(p)] == p]
            if len({q for q, _ in places}) < len(phrases):
                continue
            width = max(s.band, s.slack * len(said)) + 2 * s.slack
            for start in {x - k for _, x in places for k in range(width)}:
                inside = [(q, x) for q, x in places if start <= x < start + width]
                if len({q for q, _ in inside}) == len(phrases):
                    held = sum(v for q, (w, v) in enumerate(zip(said, weight, strict=True)) if any(start <= k - q < start + width for k in at[w]))
                    if held / sum(weight) >= s.min_coverage:
                        labels.add(template.label)
                        score = max(score, min(1.0, held / sum(weight)))
        want[d] = ",".join(sorted(labels)), round(score or 0.5 * base, 6)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in rows(spark, "op7_licence_scan", sf_dir)}
    assert got == want and sum(bool(x) for x, _ in want.values()) > 10


def test_licence_base_phrases_come_from_the_index(spark, odd_dir, monkeypatch):
    """Without its postings no base phrase is found."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    index = licences.Index(licences.TEMPLATES, *licences.document_frequencies(docs, licences.TEMPLATES), licences.Settings())
    (block,) = licences.word_blocks(pa.array(["an apache mit license license, mit apache license mit license", "license mit"]), licences.ALNUM)
    held = {(label, int(d), int(k)) for label, docs_, at in index.base_places(block.hashes(), block.first) for d, k in zip(docs_, at, strict=True)}
    assert held == {("mit", 0, 2), ("apache", 0, 6), ("mit", 0, 8)}
    index.base_words = licences.HashSet([])
    assert not list(index.base_places(block.hashes(), block.first))


def test_licence_after_a_run_of_anchors(spark):
    table = " ".join(f"{k}.0" for k in range(1, 20_000))
    frame = spark.createDataFrame([(0, f"{table} by Licensed under CC BY 4.0. {table}"), (1, table)], "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in licences.scan_licences(frame).collect()}
    assert found == {0: ("cc-by-4.0", 1.0), 1: ("", 0.0)}


# op8


def shingles(text):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def test_near_duplicates_odd(spark, odd_dir):
    found = rows(spark, "op8_minhash_near_dedup", odd_dir)
    sets = defaultdict(set)
    for i, t in documents(spark, odd_dir):
        sets[i] |= shingles(t)
    assert len(found) == len(documents(spark, odd_dir))
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in found)
    groups = {r["doc_id"]: r["component_id"] for r in found}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[16] == 15 and groups[4] == 4 and groups[6] == 6
    assert groups[None] is None and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_in_blocks(spark):
    """Groups far larger than a block: exact copies, and a chain in which only neighbours are linked."""
    from pulsegrid.llm import neardup

    words = [f"w{k}" for k in range(3000)]
    docs = [(k, " ".join(words[8 * k : 8 * k + 130])) for k in range(200)]
    docs += [(1000 + k, "the same text that many documents repeat word for word") for k in range(300)]
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(400)]
    for k in range(150):
        changed = list(base)
        for _ in range(8):
            changed[int(rng.integers(0, 400))] = f"c{rng.integers(0, 10**6)}"
        docs.append((2000 + k, " ".join(changed)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame, neardup.Settings(block=16)).collect()}
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    listed = sorted(sets)
    for n, i in enumerate(listed):
        for j in listed[n + 1 :]:
            if i // 1000 == j // 1000:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in sets}


def test_components_and_id_tables(spark):
    from pulsegrid.llm.graph import components, in_table

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    up = {n: n for e in edges for n in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in linked}
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "wanted")
    rows = spark.range(3000).selectExpr("if(id = 5, null, id) as doc_id")
    for bits in (8, 24):
        maybe = {r[0] for r in in_table(rows, "doc_id", ids, bits).collect()}
        surely_not = {r[0] for r in in_table(rows, "doc_id", ids, bits, "left_anti").collect()}
        assert set(range(0, 3000, 3)) <= maybe and not maybe & surely_not and len(maybe) + len(surely_not) == 3000
    assert len(maybe) < 1010


# op9


@pytest.mark.parametrize("size", ["odd", "/root/testdata/sf0.01"])
def test_neighbours(spark, odd_dir, size):
    path = odd_dir if size == "odd" else size
    good = [
        (r["vec_id"], np.array(r["embedding"], dtype=float))
        for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()
        if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])
    ]
    d = max({len(v) for _, v in good}, key=lambda n: sum(len(v) == n for _, v in good))
    good = [(i, v) for i, v in good if len(v) == d]
    found = defaultdict(list)
    for r in rows(spark, "op9_nearest_neighbours", path):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i, _ in good if i % 20 == 0}
    hit = total = 0
    vectors = dict(good)
    for q, got in found.items():
        scores = sorted((-round(float((v * vectors[q]).sum()), 12), i) for i, v in good if i != q)[:20]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, len(scores) + 1))
        assert all(abs(float((vectors[i] * vectors[q]).sum()) - s) < 1e-12 for _, i, s in got)
        assert [(-round(s, 12), i) for _, i, s in got] == sorted((-round(s, 12), i) for _, i, s in got)
        hit += len({i for _, i, _ in got} & {i for _, i in scores})
        total += len(scores)
    assert hit >= 0.9 * total


# op10

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            right = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if right():
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, odd_dir):
    for path in (odd_dir, "/root/testdata/sf0.01"):
        wanted = {i: plain_spans(t or "") for i, t in documents(spark, path)}
        for r in rows(spark, "op10_personal_data", path):
            base = wanted[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
            spans = [s for s in r["spans"].split(",") if s]
            assert [s for s in spans if not s.startswith("term:")] == base


def plain_term_spans(docs, s):
    """Spans of all kinds of each text, with the disclosing terms counted by plain loops."""
    word = re.compile(r"[^\x00-\x60\x7B-\x7F]+")

    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return [(m.start(), m.end(), m[0]) for m in word.finditer(low)]

    contexts, both, holding, n = defaultdict(set), defaultdict(set), defaultdict(set), Counter()
    for row, (_, text) in enumerate(docs):
        text = text or ""
        n.update({w for _, _, w in words(text)})
        spans = [x.split(":") for x in plain_spans(text)]
        blank = list(text)
        for _, a, b in spans:
            blank[int(a) : int(b)] = " " * (int(b) - int(a))
        long = [(a, w) for a, _, w in words("".join(blank)) if len(w.encode()) >= s.min_bytes]
        for kind, a, b in spans:
            value = text[int(a) : int(b)]
            entity = kind, value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
            holding[entity].add(row)
            k = sum(start < int(a) for start, _ in long)
            around = tuple(w for _, w in long[max(0, k - s.reach) : k + s.reach])
            for w in around:
                contexts[entity, w].add(around)
                both[entity, w].add(row)
    terms = set()
    for (entity, w), seen in contexts.items():
        share = min(1.0, len(both[entity, w]) / n[w])
        if len(seen) >= s.support and share >= s.share and math.log2(share / (len(holding[entity]) / len(docs))) >= s.bits:
            terms.add(w)
    out = []
    for doc, text in docs:
        order = {k: i for i, k in enumerate([*PATTERNS, "term"])}
        spans = plain_spans(text or "") + [f"term:{a}:{b}" for a, b, w in words(text or "") if w in terms]
        out.append((doc, ",".join(sorted(spans, key=lambda x: (int(x.split(":")[1]), order[x.split(":")[0]], int(x.split(":")[2]))))))
    return out, terms


def test_personal_terms_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = documents(spark, path)
    want, terms = plain_term_spans(docs, privacy.Settings())
    got = [(r["doc_id"], r["spans"]) for r in rows(spark, "op10_personal_data", path)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # A table with more to disclose: few names, each with its own address, in other words each time.
    rng = np.random.default_rng(9)
    names = [f"person{chr(97 + k)}{chr(97 + k // 3)}x" for k in range(12)]
    filler = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    docs = []
    for d in range(400):
        k = int(rng.integers(0, 12))
        said = [str(w) for w in rng.choice(filler, 14)]
        if d % 2:
            said[5:5] = [names[k], f"{names[k]}@corp.example.com" if rng.random() < 0.9 else "10.1.2.3"]
        docs.append((d, " ".join(said)))
    want, terms = plain_term_spans(docs, privacy.Settings())
    found = privacy.sanitise(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["spans"]) for r in found) == sorted(want) and len(terms) >= 6


def test_linear_in_text():
    assert privacy.base_spans("a" * 300_000 + "@") == [] and privacy.base_spans("1" * 300_000) == []
    assert privacy.base_spans("x a@b.c@d.e y") == [(2, 0, 7)]


def test_disclosing_terms(spark):
    filler = ["meadow", "harbour", "lantern", "copper", "valley", "orchard", "winter", "market"]
    docs = [(k, f"{filler[k % 8]} zorblatt wrote from {filler[(k + 3) % 8]} zed@corp.example.com {filler[(k + 5) % 8]}") for k in range(8)]
    docs += [(100 + k, f"{filler[k % 8]} and {filler[(k * 3 + 1) % 8]} stand here wrote from") for k in range(200)]
    docs += [(500, "later zorblatt came back"), (501, None), (501, ""), (None, "zorblatt again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.sanitise(frame, ["doc_id"]).collect()}
    joined = privacy.sanitise(frame, ["doc_id"], privacy.Settings(broadcast_terms=0))
    assert sorted(map(str, joined.collect())) == sorted(map(str, privacy.sanitise(frame, ["doc_id"]).collect()))
    assert found[500]["spans"] == "term:6:14" and found[500]["masked"] == "later [TERM] came back"
    assert found[None]["spans"] == "term:0:8" and found[0]["spans"].startswith("term:7:15,email:")
    assert found[100]["spans"] == "" and found[501]["masked"] in (None, "")


def test_disclosing_terms_of_copies(spark):
    filler = ["meadow", "harbour", "lantern", "copper", "valley"]
    notes = ", ".join(f"'{w} zorblatt wrote to zed@corp.example.com {w}'" for w in filler)
    words = ["".join(chr(97 + (k * 7 + j * j * 3 + j * k) % 26) for j in range(6)) for k in range(160)]
    often = " ".join(f"{' '.join(words[8 * k : 8 * k + 8])} quorfeld amy@corp.example.com" for k in range(20))
    frame = spark.range(5000).selectExpr("id", f"element_at(array({notes}), cast(id % 5 + 1 as int))")
    frame = frame.union(spark.range(5000, 50_000).selectExpr("id", "'nothing of note stands here'"))
    more = [(60_000, "later zorblatt came back"), (60_001, often)] + [(60_100 + k, "a clean quorfeld text") for k in range(20)]
    frame = frame.union(spark.createDataFrame(more, "id long, text string")).toDF("doc_id", "text")
    found = privacy.sanitise(frame, ["doc_id"]).where("doc_id % 1000 < 5 or doc_id >= 60000")
    found = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert found[60_000] == "term:6:14" and found[0].startswith("term:7:15,") and found[4004].startswith("term:7:15,")
    assert found[60_100] == "" and found[5004] == ""
