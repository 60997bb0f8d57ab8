"""Further registered queries, each with its SQL: byte ranges, joins by nearness, scans, products, kept statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.constants import C1_MIDI, FRAME_SIZE, HOP_SIZE
from pulsegrid.functions import arrays as A
from pulsegrid.functions.polyphase import WINDOW
from pulsegrid.functions.registry import register_functions
from pulsegrid.operators import chords, products, scans
from pulsegrid.operators.daily import DailyStatistics
from pulsegrid.operators.frames import sliding_frames
from pulsegrid.operators.nearest import nearest_join, ratio_anti_join
from pulsegrid.plans import oracle as O
from pulsegrid.plans import queries as Q
from pulsegrid.plans import transcribe as T
from pulsegrid.session import stage_root
from pulsegrid.sources import ranges
from pulsegrid.sources import recordings as R
from pulsegrid.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return register


def own_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared stage folder."""
    return f"{stage_root(spark).rstrip('/')}/pulsegrid/{name}-{uuid.uuid4().hex}"


@query(O.ORACLE["pcm16_scan"])
def range_scan(spark, sf_dir):
    """Whole documents as raw 16-bit files, each read by byte ranges."""
    files = Q._document_audio(spark, sf_dir).where("octet_length(content) > 0")
    folder = own_folder(spark, "audio")
    # Dealt over folders, since listing them holds the names of one.
    inner = F.lpad(F.hex(F.pmod(F.xxhash64("path", "content"), F.lit(1024))), 3, "0")
    named = files.select(F.concat(inner, F.lit("/"), "path", F.lit("-"), F.hex(F.xxhash64("content")), F.lit(".raw")).alias("name"), "content")
    written = R.write_files(named, folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # Small ranges, so that longer documents take several: some 64 in all, more where a task would have too many files.
    segments = ranges.scan_segments(spark, folder, rangeBytes=max(1 << 15, written // 64), frames=64) if written else R.decode(files.limit(0))
    doc_id = F.regexp_extract("recording_id", r"([^/]*)-[0-9A-F]+\.raw$", 1).cast("bigint")
    return (
        segments.select(doc_id.alias("doc_id"), "n_samples", F.expr(R.own_samples(64)).alias("own"))
        .groupBy("doc_id", "n_samples")
        .agg(
            F.sum(F.expr("aggregate(own, 0D, (acc, v) -> acc + v) * 32768D")).cast("bigint").alias("total"),
            F.max(F.expr("cast(array_max(own) * 32768D as int)")).alias("largest"),
            F.min(F.expr("cast(array_min(own) * 32768D as int)")).alias("smallest"),
        )
    )


#: Microseconds since 1970 of a time without zone, whatever zone the session has.
MICROS = "unix_date(cast(ts as date)) * 86400000000 + (hour(ts) * 3600 + minute(ts) * 60) * 1000000L + cast(extract(second from ts) * 1000000 as bigint)"


def _typed_events(spark, sf_dir, kind, *columns):
    rows = V.table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select("user_id", F.expr(MICROS).alias("us"), *columns)


@query(
    """WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS near_id, user_id, epoch_us(ts) AS near_us FROM events WHERE event_type = 'view'),
c AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(near_us - us), near_us, near_id) AS k FROM l LEFT JOIN r USING (user_id))
SELECT event_id, user_id, us, near_us, near_id FROM c WHERE k = 1"""
)
def nearest_event(spark, sf_dir):
    """For each purchase the view of the same user that lies nearest in time."""
    left = _typed_events(spark, sf_dir, "purchase", "event_id")
    right = _typed_events(spark, sf_dir, "view", F.col("event_id").alias("near_id"))
    return nearest_join(left, right, ["user_id"], "us", ["near_id"]).select("event_id", "user_id", "us", "near_us", "near_id")


@query(
    """WITH l AS (SELECT l_suppkey AS k, l_extendedprice AS p FROM lineitem),
r AS (SELECT s_suppkey AS k, s_acctbal AS p, s_nationkey FROM supplier WHERE s_acctbal IS NOT NULL),
m AS (SELECT l.k, l.p, min(abs(r.p - l.p)) AS d FROM l LEFT JOIN r ON l.k % 7 = r.k % 7 GROUP BY 1, 2)
SELECT m.k AS series_id, count(*) AS n, round(sum(d), 2) AS total FROM l JOIN m ON l.k = m.k AND l.p = m.p GROUP BY 1"""
)
def nearest_balance(spark, sf_dir):
    """How far the prices of each supplier lie from the nearest balance among the suppliers of its seventh."""
    left = V.table(spark, sf_dir, "lineitem").select(
        F.expr("l_suppkey % 7").alias("part"), F.col("l_suppkey").alias("series_id"), F.col("l_extendedprice").alias("p")
    )
    right = V.table(spark, sf_dir, "supplier").select(F.expr("s_suppkey % 7").alias("part"), F.col("s_acctbal").alias("p"), "s_nationkey")
    near = nearest_join(left, right, ["part"], "p", ["s_nationkey"])
    return near.groupBy("series_id").agg(F.count("*").alias("n"), (F.round(F.sum(F.abs(F.col("near_p") - F.col("p"))), 2) + 0.0).alias("total"))


@query(
    """SELECT event_id, user_id, value FROM events c WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events e, (SELECT unnest(range(2, 7)) AS h) WHERE e.event_type = 'purchase' AND e.user_id = c.user_id
    AND e.value > 0 AND c.value > 0 AND abs(c.value / e.value - h) < 0.1)"""
)
def harmonic_filter(spark, sf_dir):
    """Views whose value is no near multiple of a value that the same user paid."""
    events = V.table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "value")
    return ratio_anti_join(views, events.where("event_type = 'purchase'"), ["user_id"], "value")


LAGS = 32


@query(
    O.with_(O.LN)
    + f"""SELECT a.series_id, g AS lag, round(sum(a.x * b.x) / any_value(e), 6) AS products,
  round(sum((a.x - b.x) * (a.x - b.x)) / any_value(e), 6) AS differences
FROM ln a, (SELECT CAST(unnest(range({LAGS + 1})) AS INT) AS g), ln b, (SELECT series_id, sum(x * x) AS e FROM ln GROUP BY 1) w
WHERE b.series_id = a.series_id AND b.t = a.t + g AND w.series_id = a.series_id GROUP BY 1, 2"""
)
def lag_sums(spark, sf_dir):
    """Autocorrelation and squared differences of whole price series, over their energy."""
    rows = scans.lag_sums(V.line_series(spark, sf_dir), ["series_id"], "t", "x", LAGS, length=256)
    energy = rows.where("lag = 0").select(F.col("series_id").alias("_s"), F.col("products").alias("_e"))
    rows = rows.where("lag >= 0").join(energy, F.col("series_id") == F.col("_s"))
    return rows.select("series_id", F.col("lag").cast("int").alias("lag"), *[Q.rounded(f"{c} / _e", 6, c) for c in ("products", "differences")])


UP, DOWN, FEW_LOBES = 3, 4, 8


def _polyphase_sql() -> str:
    taper = " + ".join(f"{a} * cos(pi() * {k} * u / {FEW_LOBES})" for k, a in enumerate(WINDOW))
    reach = -(-FEW_LOBES * DOWN // UP)
    return O.with_(
        O.LN,
        f"taps AS (SELECT p, i, (p / {UP}.0 - i) * {UP} / {DOWN} AS u FROM (SELECT unnest(range({UP})) AS p), (SELECT unnest(range(1 - {reach}, {reach + 1})) AS i))",
        f"""raw AS (SELECT p, i, CASE WHEN abs(u) >= {FEW_LOBES} THEN 0 WHEN u = 0 THEN 1 ELSE sin(pi() * u) / (pi() * u) END * ({taper}) AS w FROM taps)""",
        "bank AS (SELECT p, i, w / sum(w) OVER (PARTITION BY p) AS w FROM raw)",
        f"outs AS (SELECT series_id, unnest(range(n * {UP} // {DOWN})) AS j FROM (SELECT series_id, count(*) AS n FROM ln GROUP BY 1))",
    ) + f"""SELECT o.series_id, o.j, round(coalesce(sum(x * w), 0), 2) + 0.0 AS y
FROM outs o JOIN bank ON p = (j * {DOWN}) % {UP} LEFT JOIN ln ON ln.series_id = o.series_id AND ln.t = (j * {DOWN}) // {UP} + i GROUP BY 1, 2"""


@query(_polyphase_sql())
def polyphase_series(spark, sf_dir):
    """Whole price series at three quarters of their rate, by short filters."""
    rows = scans.resample_polyphase(V.line_series(spark, sf_dir), ["series_id"], "t", "x", UP, DOWN, FEW_LOBES, length=128)
    return rows.select("series_id", "j", Q.rounded("y", 2, "y"))


@query(
    O.with_(O.LN)
    + """SELECT a.series_id, a.t, round((any_value(a.x) - 0.0001 * coalesce(sum(pow(0.9999, a.t - b.t - 1) * b.x), 0)) / 10, 1) + 0.0 AS y
FROM ln a LEFT JOIN ln b ON b.series_id = a.series_id AND b.t < a.t GROUP BY 1, 2"""
)
def highpass_scan(spark, sf_dir):
    """Slow high-pass of whole price series, composed over segments of 64 values."""
    rows = scans.highpass_scan(V.line_series(spark, sf_dir), ["series_id"], "t", "x", alpha=0.9999, length=64, fan=4)
    return rows.select("series_id", "t", Q.rounded("y / 10", 1, "y"))


@query(O.ORACLE["chord_match"])
def chord_match_join(spark, sf_dir):
    """The best chord template of each frame, by a join with the template table instead of a kernel."""
    chroma = Q._with_chroma(V.embedding_frames(spark, sf_dir)).select(*Q.FRAME, F.posexplode("chroma").alias("pc", "c"))
    templates = chords.chord_templates(spark).select("pc", "tid", "weight")
    scores = products.product(chroma, templates, Q.FRAME, "pc", ["tid"], {"score": "c * weight"})
    best = products.best_of(scores, Q.FRAME, "tid", "score")
    root = F.expr(f"cast(tid div {len(chords.QUALITIES)} as int)")
    return best.select(*Q.FRAME, "tid", F.expr(chords.template_label("tid")).alias("label"), root.alias("root_pc"), Q.rounded("score", 6, "score"))


@query(O.ORACLE["dft_magnitude"])
def dft_product(spark, sf_dir):
    """The Fourier magnitudes of price frames, by a join with the table of the transform's weights."""
    frames = sliding_frames(V.line_series(spark, sf_dir), ["series_id"], "t", "x", Q.SIZE, Q.HOP)
    mags = products.magnitudes(frames, ["series_id", "frame"], "f", products.fourier_basis(spark, Q.SIZE))
    return mags.select("series_id", "frame", "bin", Q.rounded("mag", 2, "mag"))


TONES = 24


@query(
    O.with_(
        O.LN,
        O.FR,
        f"tones AS (SELECT bin, 55.0 * pow(2, bin / 12.0) AS hz FROM (SELECT unnest(range({TONES})) AS bin))",
        f"sized AS (SELECT bin, hz, least(64, CAST(ceil(1 / (pow(2, 1 / 12.0) - 1) * {Q.LAG_RATE} / hz) AS INT)) AS n FROM tones)",
        f"""kernel AS (SELECT bin, (64 - n) // 2 + k AS i, (0.5 - 0.5 * cos(2 * pi() * (k + 0.5) / n)) / sqrt(n) AS w, 2 * pi() * hz * k / {Q.LAG_RATE} AS a
  FROM (SELECT *, unnest(range(n)) AS k FROM sized))""",
    )
    + """SELECT series_id, frame, CAST(bin AS INT) AS bin, round(sqrt(pow(sum(x * w * cos(a)), 2) + pow(sum(x * w * sin(a)), 2)), 2) + 0.0 AS mag
FROM fr JOIN kernel USING (i) GROUP BY 1, 2, 3"""
)
def tone_product(spark, sf_dir):
    """Constant-Q magnitudes of price frames, by a join with a sparse kernel table."""
    frames = sliding_frames(V.line_series(spark, sf_dir), ["series_id"], "t", "x", Q.SIZE, Q.HOP)
    kernel = products.tone_kernel(spark, Q.SIZE, Q.LAG_RATE, TONES, 55.0)
    return products.magnitudes(frames, ["series_id", "frame"], "f", kernel).select("series_id", "frame", "bin", Q.rounded("mag", 2, "mag"))


@query(
    """SELECT event_type, 'value' AS feature, round(median(value) + 1.5 * stddev_pop(value), 6) AS threshold FROM events GROUP BY 1
UNION ALL SELECT event_type, 'user', round(median(user_id) + stddev_pop(user_id), 6) FROM events GROUP BY 1"""
)
def daily_thresholds(spark, sf_dir):
    """Thresholds of all days, from statistics that were filed day by day in two lots, the second of which holds one day again."""
    events = V.table(spark, sf_dir, "events").select("event_type", "value", F.col("user_id").alias("user"), F.expr("date_format(ts, 'yyyy-MM-dd')").alias("day"))
    held = DailyStatistics(spark, own_folder(spark, "daily"), ["event_type"])
    held.add(events.where("day <= '2024-01-20'"), ["value", "user"])
    held.add(events.where("day >= '2024-01-20'"), ["value", "user"])
    return held.thresholds({"value": 1.5, "user": 1.0}).select("event_type", "feature", Q.rounded("threshold", 6, "threshold"))


@query(O.ORACLE["midi_scalars"])
def sql_functions(spark, sf_dir):
    """The scalar functions by name, in SQL text."""
    register_functions(spark)
    V.table(spark, sf_dir, "events").createOrReplaceTempView("_scalar_events")
    return spark.sql(
        """SELECT event_id, midi, round(midi_to_hz(midi), 6) + 0D AS hz, hz_to_midi(midi_to_hz(midi)) AS midi_again,
  note_name(midi) AS name, pitch_class(midi) AS pc, hz_to_piano(value) AS value_midi
FROM (SELECT event_id, value, cast(21 + event_id % 88 AS int) AS midi FROM _scalar_events)"""
    )


SCORE = f"""score AS (
  SELECT s_suppkey // {Q.SLOTS} AS recording_id, s_suppkey % {Q.SLOTS} AS slot, CAST(48 + (s_suppkey * 5 + coalesce(s_nationkey, 0)) % 24 AS INT) AS midi
  FROM supplier WHERE s_suppkey IS NOT NULL)"""


@query(
    O.with_(SCORE)
    + f"""SELECT CAST(recording_id AS VARCHAR) AS recording_id, count(*) AS events, count(*) AS found,
  round(({Q.LEAD_IN} + {Q.SLOTS} * {Q.EVENT}) / 44100.0, 6) AS duration_seconds, 44100 AS sample_rate FROM score GROUP BY 1"""
)
def transcription_events(spark, sf_dir):
    """Events of each recording that an onset of the whole job marks within 60 ms, and the durations."""
    done = T.transcribe(Q.supplier_audio(spark, sf_dir))
    start = F.expr(f"({Q.LEAD_IN} + slot * {Q.EVENT}) / 44100D")
    # An onset can only belong to the slot that it falls into, or to the next one.
    near = F.explode(F.expr(f"array(cast(floor((time_seconds * 44100D - {Q.LEAD_IN}) / {Q.EVENT}) as int), cast(floor((time_seconds * 44100D - {Q.LEAD_IN}) / {Q.EVENT}) + 1 as int))"))
    marked = done.onsets.select("recording_id", "time_seconds", near.alias("slot")).where(F.abs(F.col("time_seconds") - start) <= 0.06)
    score = Q.supplier_score(spark, sf_dir).select(F.col("recording_id").cast("string").alias("recording_id"), "slot").distinct()
    hits = score.join(marked.select("recording_id", "slot").distinct().withColumn("hit", F.lit(1)), ["recording_id", "slot"], "left")
    counts = hits.groupBy("recording_id").agg(F.count("*").alias("events"), F.count("hit").alias("found"))
    return counts.join(done.summary.select("recording_id", Q.rounded("duration_seconds", 6, "duration_seconds"), "sample_rate"), "recording_id")


@query(
    O.with_(SCORE)
    + "SELECT recording_id, slot, midi AS loudest FROM score WHERE slot NOT IN (4, 8)"
)
def constant_q_tones(spark, sf_dir):
    """The loudest bin of the recordings' constant-Q track in the middle of each single tone: the note that was played."""
    frames = T.frame_features(R.decode(Q.supplier_audio(spark, sf_dir))).where("frame is not null")
    middle = F.expr(f"({Q.LEAD_IN} + slot * {Q.EVENT} + {Q.EVENT // 2} - {FRAME_SIZE // 2}) div {HOP_SIZE}").alias("frame")
    score = Q.supplier_score(spark, sf_dir).where("size(notes) = 1").select("recording_id", "slot", middle)
    loudest = F.expr(f"cast({A.first_argmax('cqt', 6)} as int) + {C1_MIDI}").alias("loudest")
    rows = frames.select(F.col("recording_id").cast("bigint").alias("recording_id"), "frame", loudest)
    return score.join(rows, ["recording_id", "frame"]).select("recording_id", F.col("slot").cast("bigint").alias("slot"), "loudest")
