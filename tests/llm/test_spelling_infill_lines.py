"""Spelling variants, fill-in-the-middle and line dedup against plain versions, on odd, crowded and random tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pulsegrid.llm import infill, lines, spelling
from pulsegrid.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11


def plain_words(docs, least=5, rare=3):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= rare}


def plain_variants(words):
    near = defaultdict(set)
    shorter = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in shorter.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def found_variants(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def crowded_vocabulary(seed, n):
    """Words over few letters: long lists, many repeated grams, long words, letters above U+00C0."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(n)}
    words |= {"thing" + "".join(rng.choice("xyz÷") for _ in range(rng.randint(0, 4))) for _ in range(n // 4)}
    words |= {"a" * k for k in (5, 6, 7, 8, 31, 32, 33, 34, 100, 101, 5000, 5001)} | {"b" * 5000 + "c", "b" * 5001 + "c", "b" * 4999 + "cc"}
    out = []
    for w in sorted(words):
        out += [w] * rng.choice([1, 3, 3, 4, 7, 20])
    rng.shuffle(out)
    return [(i, " ".join(out[i::40])) for i in range(40)]


@pytest.mark.parametrize("settings", [spelling.Settings(), spelling.Settings(block=16, frequent_bits=4, sketch_bits=4), spelling.Settings(longest=3)])
def test_spelling_brute_force(spark, settings):
    docs = crowded_vocabulary(3, 900)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_variants(plain_words(docs))
    assert len(want) > 500 and any(w[1] is not None and w[2] != w[1] for w in want)
    assert found_variants(spelling.spelling_variants(df, settings)) == want


def test_spelling_odd(spark, odd_dir):
    assert found_variants(QUERIES["op11_spelling_variants"](spark, odd_dir)) == plain_variants(plain_words(documents(spark, odd_dir)))


def test_spelling_tables(spark):
    path = "/root/testdata/sf0.01"
    want = plain_variants(plain_words(documents(spark, path)))
    assert found_variants(QUERIES["op11_spelling_variants"](spark, path)) == want
    short = spelling.vocabulary(spark.read.parquet(f"{path}/documents.parquet"), spelling.Settings(), held_words=100)
    assert {(r["word"], r["n"]) for r in short.collect()} == {(w[0], w[3]) for w in want}


def test_checksums_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    size = rng.integers(0, 90, 300)
    seed = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    got = spelling.span_crc32(data, start, size, seed)
    assert [int(x) for x in got] == [zlib.crc32(data[a : a + n].tobytes(), int(s)) for a, n, s in zip(start, size, seed, strict=True)]


def test_frequent_grams_are_bounded(spark):
    vocab = spark.createDataFrame([(w,) for _, t in crowded_vocabulary(5, 2000) for w in set(t.split())], "word string")
    latin = vocab.selectExpr("encode(word, 'ISO-8859-1') as latin", "1L as n")
    held = spelling.dictionary(latin, spelling.Settings(frequent_bits=5))
    assert 0 < len(held.frequent) <= 32 and held.sketch.sum() > 0


# op12


def plain_infill(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if d % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc, n, form, len(prefix), len(middle), sha(output), sha(text)


def check_infill(found, docs):
    rows = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in found.collect()]
    assert sorted(map(str, rows)) == sorted(str(plain_infill(*d)) for d in docs)
    return rows


def test_infill_odd(spark, odd_dir):
    check_infill(QUERIES["op12_fill_in_middle"](spark, odd_dir), documents(spark, odd_dir))


def test_infill_marks_and_bytes(spark, tmp_path):
    texts = ["<P> there", "a<M>", "<S", "<" * 5, "x<P", "S>M>", "\x00\x01 a\x00b", "é" * 300 + "<", "日本語<", "\\1 \\0 $1", "\n\n", "z" * 70_000 + "!" * 70_000, None, ""]
    docs = [(i, texts[i % len(texts)]) for i in range(400)] + [(None, "no id at all <"), (7, "twice"), (7, "twice")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    forms = Counter(r[2] for r in check_infill(QUERIES["op12_fill_in_middle"](spark, str(tmp_path)), docs))
    assert forms["psm"] > forms["spm"] > 20 and forms["plain"] > 80


def test_infill_other_marks(spark):
    s = infill.Settings(prefix="{p.}", suffix="{s*}", middle="{m|}", rate=100, spm=50)
    docs = spark.createDataFrame([(i, f"one {i} two. {'{p.} ' if i % 10 == 0 else '{'}") for i in range(200)], "doc_id long, text string")
    found = infill.fill_in_middle(docs, s).withColumn("back", infill.restored(s)).join(docs, "doc_id").collect()
    assert all(r["back"] == r["text"] for r in found) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert all((r["form"] == "plain") == (r["doc_id"] % 10 == 0) for r in found)
    with pytest.raises(ValueError):
        infill.Settings(prefix="<P>", suffix="<S<", middle="<M>").marks()


def test_infill_in_small_blocks():
    texts = pa.array([f"ab c{i} é".encode() * (i % 7) for i in range(50)], pa.large_binary())
    draws = [pa.array([(i * k) % 1000 for i in range(50)], pa.int64()) for k in (3, 7, 11, 13)]
    whole = infill.transform(texts, draws, infill.Settings())
    for at in range(0, 50, 9):  # slices of a larger array
        part = infill.transform(texts.slice(at, 9), [d.slice(at, 9) for d in draws], infill.Settings())
        assert all(p.to_pylist() == w.slice(at, 9).to_pylist() for p, w in zip(part, whole, strict=True))


# op13


def plain_lines(texts, min_docs=10, min_chars=1):
    keyed = [[(line, line.strip(SPACE).translate(LOWERED)) for line in (t or "").split("\n")] for t in texts]
    n = Counter(k for doc in keyed for k in {k for _, k in doc})
    out = []
    for doc in keyed:
        left = [line for line, k in doc if len(k) < min_chars or n[k] < min_docs]
        out.append((len(doc), len(doc) - len(left), "\n".join(left)))
    return out


def line_table(seed, n):
    rng = random.Random(seed)
    common = ["Share this", " share THIS\t", "© ü", "x", "", "  ", "\r", "cookie\x0bs", "Ünder"] + [f"notice {i}" for i in range(30)]
    texts = []
    for i in range(n):
        body = [f"line {i} {k}" if rng.random() < 0.4 else rng.choice(common) for k in range(rng.randint(0, 12))]
        texts.append("\n".join(body))
    return [*texts, None, "", "\n", "\n\n", "share this", "Share this\n", "\nshare this", "a b", "q" * 70_000 + "\nx", *["twin\nline\n"] * 9, *["copied text"] * 10]


FORCED = lines.Settings(broadcast_bytes=0, shard_keys=8, part_rows=50)


@pytest.mark.parametrize("settings", [lines.Settings(), lines.Settings(shard_keys=4), FORCED, lines.Settings(min_docs=3, min_chars=2), lines.Settings(min_docs=3, broadcast_bytes=0)])
def test_lines_brute_force(spark, settings):
    texts = line_table(2, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(6)
    found = {r["i"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.drop_repeated_lines(df, ["i"], settings).collect()}
    want = plain_lines(texts, settings.min_docs, settings.min_chars)
    assert found == dict(enumerate(want)) and sum(w[1] for w in want) > 300


@pytest.mark.parametrize("settings", [lines.Settings(), FORCED])
def test_lines_without_rows_or_repeats(spark, settings):
    none = spark.createDataFrame([], "i long, text string")
    assert lines.drop_repeated_lines(none, ["i"], settings).collect() == []
    few = spark.createDataFrame([(1, "a\nb"), (2, None)], "i long, text string")
    assert {(r["i"], r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.drop_repeated_lines(few, ["i"], settings).collect()} == {(1, 2, 0, "a\nb"), (2, 1, 0, "")}


def test_lines_odd(spark, odd_dir):
    docs = documents(spark, odd_dir)
    want = [(d, n, dropped, sha(kept)) for (d, _), (n, dropped, kept) in zip(docs, plain_lines([t for _, t in docs]), strict=True)]
    rows = [tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in QUERIES["op13_line_dedup"](spark, odd_dir).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_minimal_perfect_hash():
    rng = np.random.default_rng(4)
    s = lines.Settings()
    for n in (1, 2, 50, 5000):
        one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for _ in range(2))
        count = rng.integers(1, 1 << 20, n)
        built = lines.build_shard(one, two, count, s)
        index = lines.Index(0, [(0, *built)])
        assert len(index.fingerprints) == len(index.counts) == n  # one slot a key, none empty
        assert (index.documents(one, two) == np.minimum(count, (1 << 16) - 1)).all()
        assert not index.documents(*(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(2))).any()
        assert not index.documents(one, two + np.uint64(1)).any()
        assert len(built[1]) * 8 < 6 * n + 1024  # bits a key
