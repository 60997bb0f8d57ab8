"""Personal data: fixed patterns, and terms that disclose them by co-occurrence.

Values found by the patterns are protected entities. The words around them are counted over the corpus, in documents: the share of
a word's documents in which it stands near the entity estimates p(entity | word), the share of all documents that hold the entity
p(entity). A word with enough support whose share and information gain, log2 p(entity | word) / p(entity), pass the thresholds
discloses the entity wherever it stands; it is generalised, or removed if the share is near one. Support alone counts different
contexts, so copies of one text do not add to it; documents are counted each, copies too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.stream import record_batch
from pulsegrid.llm.text import code_points, HashSet, lean, mix, utf8, word_blocks
from pulsegrid.session import stage_table

KINDS = ("email", "ip", "card", "phone", "term")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does: earlier failures fail again inside the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = _LETTERS[128:] = True


@dataclass(frozen=True)
class Settings:
    """A term needs `support` different contexts with an entity, `share` of its documents and `bits` of information.

    `reach` words on either side of an entity are its context. `bits_table` bounds the tables that are broadcast; up to
    `broadcast_terms` disclosing terms (16 bytes each) are broadcast, more are joined with their occurrences.
    """

    reach: int = 8
    min_bytes: int = 3
    support: int = 2
    share: float = 0.5
    bits: float = 3.0
    remove_share: float = 0.9
    bits_table: int = 20
    broadcast_terms: int = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ to either side, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_SIGN = np.zeros(256, dtype=bool)
_SIGN[48:58] = _SIGN[64] = True


def with_signs(texts: pa.Array) -> np.ndarray:
    """Rows that hold a digit or an @; no pattern matches without one."""
    data, offsets = utf8(texts)
    at = np.flatnonzero(_SIGN[data])
    return np.flatnonzero(np.diff(np.searchsorted(at, offsets)))


def _entity(kind: int, value: str) -> int:
    plain = value.lower() if kind < 2 else _digits(value)
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


_CONTEXT = pa.schema([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("docs", pa.int64())])


def contexts(docs: DataFrame, s: Settings) -> DataFrame:
    """(entity, term, context, docs) of each word near each entity; entities themselves are no words.

    `docs` is 1 once for each entity and term of a document, else 0; a row without a term stands for each entity of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in with_signs(batch.column(0)).tolist():
                text = batch.column(0)[row].as_py()
                spans = base_spans(text)
                if not spans:
                    continue
                plain = list(text)
                for a, _, b in spans:
                    plain[a:b] = " " * (b - a)
                (words, where), size = _words("".join(plain)), np.array([a for a, _, _ in spans])
                near = np.searchsorted(where, size)
                met: set[tuple[int, int | None]] = set()
                for (a, kind, b), k in zip(spans, near.tolist(), strict=True):
                    around = words[max(0, k - s.reach) : k + s.reach]
                    context = int(mix(around * np.uint64(3) + np.arange(len(around), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
                    entity = _entity(kind, text[a:b])
                    if (entity, None) not in met:
                        out.append((entity, None, None, 1))
                    terms = set(around.view(np.int64).tolist())
                    out += [(entity, t, context, int((entity, t) not in met)) for t in terms]
                    met.update((entity, t) for t in (None, *terms))
            if out:
                yield record_batch(_CONTEXT, list(zip(*out, strict=True)))

    def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of one text, and the code points where they begin."""
        for block in word_blocks(pa.array([text], pa.string()), _LETTERS):
            long = block.end - block.start >= s.min_bytes
            return block.hashes()[long], code_points(block.data)[block.start[long]]
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    return docs.select("text").where("text is not null").mapInArrow(lean(run), "entity long, term long, context long, docs long")


def _slot(term: Column, s: Settings) -> Column:
    return F.shiftrightunsigned(term, 64 - s.bits_table)


def bit_table(terms: DataFrame, s: Settings) -> np.ndarray:
    """A table of 2 ** bits_table flags of the slots of terms; words outside are surely none of them."""
    slots = terms.select(_slot(F.col("term"), s).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    out = np.zeros(1 << s.bits_table, dtype=bool)
    out[slots] = True
    return out


_KEY = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())])


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a mark of their text; rows alike in doc_id and mark have the same spans."""
    return docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def term_counts(docs: DataFrame, table: np.ndarray, s: Settings) -> DataFrame:
    """(term, n): documents that hold each word of `table`'s slots, over all rows; counted within batches first."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in word_blocks(batch.column(0), _LETTERS):
                h = block.hashes()
                at = np.flatnonzero(shared.value[h >> np.uint64(64 - s.bits_table)])
                pairs = np.stack([h[at].view(np.int64), block.owner()[at]], axis=1)
                found.append(np.unique(pairs, axis=0)[:, 0])
            if found:
                terms, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, s: Settings) -> DataFrame | None:
    """(term, share) of the words that disclose an entity, staged; None if there is none."""
    near = contexts(docs, s).groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs"))
    near = stage_table(near, "contexts")
    together = near.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("support"), F.sum("docs").alias("both"))
    together = stage_table(together.where(F.col("support") >= s.support), "together")
    if not together.take(1):
        return None
    rows = docs.count()
    seen = term_counts(docs, bit_table(together, s), s)
    entities = near.where("term is null").select("entity", F.col("docs").alias("holding"))
    rated = together.join(seen, "term").join(entities, "entity")
    share = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    gain = F.log2(share / (F.col("holding") / F.lit(float(max(rows, 1)))))
    chosen = rated.where((share >= s.share) & (gain >= s.bits)).groupBy("term").agg(F.max(share).alias("share"))
    chosen = stage_table(chosen, "terms")
    return chosen if chosen.take(1) else None


def term_spans(docs: DataFrame, terms: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, mark, terms: array of start, end, remove) of the documents that hold disclosing terms."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(terms, s))
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in word_blocks(batch.column(2), _LETTERS):
                h = block.hashes()
                at = np.flatnonzero(shared.value[h >> np.uint64(64 - s.bits_table)])
                if not len(at):
                    continue
                chars, owner = code_points(block.data), block.owner()[at]
                base = chars[block.begin[owner]]
                rows = (block.lo + owner).tolist()
                yield record_batch(
                    schema,
                    [[ids[r] for r in rows], [marks[r] for r in rows], h[at].view(np.int64), chars[block.start[at]] - base, chars[block.end[at]] - base],
                )

    found = keyed(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "mark", "text")
    found = found.mapInArrow(lean(run), "doc_id long, mark long, term long, start long, end long")
    hits = found.join(terms, "term").select("doc_id", "mark", F.struct("start", "end", (F.col("share") >= s.remove_share).alias("remove")).alias("hit"))
    return hits.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("hit")).alias("terms"))


def _collected(terms: DataFrame, s: Settings) -> tuple[HashSet, np.ndarray]:
    """A bounded number of terms, and which of them are removed, by rank."""
    held = terms.orderBy("term").toArrow()
    hashes = held["term"].to_numpy().view(np.uint64)
    return HashSet(hashes, s.bits_table), (held["share"].to_numpy() >= s.remove_share)[np.argsort(hashes)]


def _occurrences(texts: pa.Array, terms: HashSet, remove: np.ndarray) -> dict[int, list[tuple[int, int, int, bool]]]:
    """Spans (start, kind, end, remove) of the terms in each row of a batch that holds some."""
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    for block in word_blocks(texts, _LETTERS):
        at, rank = terms.find(block.hashes())
        if not len(at):
            continue
        chars, owner = code_points(block.data), block.owner()[at]
        base = chars[block.begin[owner]]
        spans = (chars[block.start[at]] - base, chars[block.end[at]] - base, remove[rank])
        for row, a, b, gone in zip((block.lo + owner).tolist(), *(x.tolist() for x in spans), strict=True):
            out.setdefault(row, []).append((a, 4, b, gone))
    return out


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with base spans and generalised terms replaced by their kind in brackets, and removed terms left out.

    Spans that overlap are replaced as one, by the kind of the first.
    """
    out, at = [], 0
    for a, kind, b, remove in spans:
        if a >= at:
            out.append(text[at:a])
            out.append("" if remove else f"[{KINDS[kind].upper()}]")
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def sanitise(docs: DataFrame, keep: list[str], settings: Settings | None = None) -> DataFrame:
    """The `keep` columns of `docs` (doc_id, text among them or not) with the findings in each whole text.

    `n_*` count base spans, `base_sha256` is the digest of their list, `spans` lists all spans as kind:start:end in code points, end exclusive, by
    start, then kind. `masked` is the sanitised text; null stays null and has no spans, nor have empty texts. One row for each row; repeated
    rows are alike. Term counts run over all rows. Spans that begin together are in order of their kinds, then of their ends. A long text is read
    whole, in time linear in it. An empty table gives no rows. Names in `keep` may be any but those of the findings; no other column is read.
    """
    s = settings or Settings()
    terms = disclosing_terms(docs, s)
    few = terms is not None and terms.count() <= s.broadcast_terms
    lexicon = docs.sparkSession.sparkContext.broadcast(_collected(terms, s) if few else None)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), *[F.col(c).alias(f"k_{c}") for c in keep], "text"))
    hit_type = "array<struct<start:bigint,end:bigint,remove:boolean>>"
    if terms is None or few:
        rows = rows.withColumn("terms", F.lit(None).cast(hit_type))
    else:
        found = term_spans(docs, terms, s).withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
        rows = rows.join(found, F.col("__id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    rows = rows.select(*[f"k_{c}" for c in keep], F.col("__text"), "terms")
    kept = [f"k_{c}" for c in keep]
    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL(FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n, texts, hits = batch.num_rows, batch.column(len(kept)), batch.column(len(kept) + 1)
            inside = _occurrences(texts, *lexicon.value) if lexicon.value else {}
            counts = np.zeros((4, n), dtype=np.int64)
            digest, listed = [nothing] * n, [""] * n
            clean: dict[int, str] = {}
            found = np.union1d(with_signs(texts), np.flatnonzero(np.asarray(hits.is_valid())))
            for row in sorted({*found.tolist(), *inside}):
                text = texts[row].as_py()
                base = base_spans(text)
                more = inside.get(row) or [(x["start"], 4, x["end"], x["remove"]) for x in hits[row].as_py() or []]
                if not base and not more:
                    continue
                for _, kind, _ in base:
                    counts[kind, row] += 1
                digest[row] = hashlib.sha256(_listed(base).encode()).hexdigest()
                spans = sorted([(a, kind, b, False) for a, kind, b in base] + more)
                listed[row] = _listed([x[:3] for x in spans])
                clean[row] = masked(text, spans)
            if clean:
                said = texts.to_pylist()
                for row, text in clean.items():
                    said[row] = text
                texts = pa.array(said, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *(pa.array(c) for c in counts), pa.array(digest), pa.array(listed), texts],
                names=[*kept, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"],
            )

    return rows.mapInArrow(lean(run), schema).withColumnsRenamed({f"k_{c}": c for c in keep})
