"""SQL with the meaning of each registered query, over the same tables.

Written in long form, one row per sample, bin or lag, straight from the definitions.
"""

from __future__ import annotations

from pulsegrid.constants import CHORD_INTERVALS, ROOTS

ORACLE: dict[str, str] = {}

NAMES = "[" + ", ".join(f"'{r}'" for r in ROOTS) + "]"
QUALITIES = ", ".join(
    f"({i}, '{q}', {steps})" for i, (q, steps) in enumerate(CHORD_INTERVALS.items())
)
RATE = "2756.25"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def name_of(m: str) -> str:
    return f"{NAMES}[CAST({m} % 12 AS INT) + 1] || CAST(CAST(floor({m} / 12) - 1 AS INT) AS VARCHAR)"


def midi_of(hz: str) -> str:
    return f"CAST(round_even(69 + 12 * log2(({hz}) / 440.0), 0) AS INT)"


def piano_of(hz: str) -> str:
    return f"CASE WHEN {midi_of(hz)} BETWEEN 21 AND 108 THEN {midi_of(hz)} END"


def hz_of(m: str) -> str:
    return f"(440.0 * pow(2.0, ({m} - 69) / 12.0))"


# ---- signals ----------------------------------------------------------------------------

EV = """ev AS (
  SELECT user_id AS series_id, value AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t
  FROM events)"""

LN = """ln AS (
  SELECT l_suppkey AS series_id, l_extendedprice AS x, l_quantity,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                            l_partkey, l_extendedprice) - 1 AS t,
         count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM lineitem)"""

FR = """fr AS (
  SELECT series_id, t // 16 - k AS frame, t - 16 * (t // 16 - k) AS i, x
  FROM ln, (SELECT unnest(range(4)) AS k)
  WHERE t // 16 - k BETWEEN 0 AND (n - 64) // 16 AND n >= 64)"""

BL = """bl AS (
  SELECT series_id, t // 64 AS frame, t % 64 AS i, x, count(*) OVER (PARTITION BY series_id, t // 64) AS nb FROM ln)"""

EM = """em AS (
  SELECT label AS recording_id, vec_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame
  FROM embeddings)"""

SP = """sp AS (
  SELECT recording_id, vec_id, frame, bin, f, abs(f) AS mag, max(abs(f)) OVER (PARTITION BY vec_id) AS mx
  FROM (SELECT recording_id, vec_id, frame, unnest(range(64)) AS bin,
               CAST(unnest(embedding) AS DOUBLE) AS f FROM em))"""

LOUD = SP.replace("abs(f) AS mag, max(abs(f))", "abs(f) * 1000 AS mag, max(abs(f) * 1000)")


def onsets_cte(name: str, source: str, key: str, pos: str, val: str, *extra: str) -> str:
    more = "".join(f", {c}" for c in extra)
    return f"""{name} AS (
  SELECT {key}, {pos}, {val}, thr{more} FROM (
    SELECT *, lag({val}) OVER w AS before_, lead({val}) OVER w AS after_,
      avg(CASE WHEN {pos} >= 1 THEN {val} END)
        OVER (PARTITION BY {key} ORDER BY {pos} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
      + 1.5 * stddev_pop(CASE WHEN {pos} >= 1 THEN {val} END)
        OVER (PARTITION BY {key} ORDER BY {pos} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS thr
    FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {pos}))
  WHERE {pos} >= 1 AND {val} > before_ AND {val} > after_ AND {val} > thr)"""


EV_ONSETS = onsets_cte("eo", "ev", "series_id", "t", "x")

ORACLE["onset_events"] = (
    with_(EV, EV_ONSETS) + "SELECT series_id, t, x, round(thr, 6) AS threshold FROM eo"
)
ORACLE["onset_summary"] = (
    with_(EV, EV_ONSETS)
    + """SELECT a.series_id, n_points, coalesce(n, 0) AS total_onsets, top AS largest_onset
FROM (SELECT series_id, count(*) AS n_points FROM ev GROUP BY 1) a
LEFT JOIN (SELECT series_id, count(*) AS n, max(x) AS top FROM eo GROUP BY 1) b USING (series_id)"""
)
ORACLE["line_onsets"] = (
    with_(LN, onsets_cte("lo", "ln", "series_id", "t", "x")) + "SELECT series_id, t, x FROM lo"
)
ORACLE["normalize_max"] = (
    with_(EV)
    + """SELECT series_id, t, round(CASE WHEN m > 0 THEN x / m ELSE x END, 9) AS v
FROM (SELECT *, max(x) OVER (PARTITION BY series_id) AS m FROM ev)"""
)
ORACLE["mean_center"] = (
    with_(EV)
    + "SELECT series_id, t, round((x - avg(x) OVER (PARTITION BY series_id)) * pi(), 6) + 0.0 AS v_pi FROM ev"
)
ORACLE["midi_scalars"] = f"""
SELECT event_id, midi, round({hz_of('midi')}, 6) AS hz, {midi_of(hz_of('midi'))} AS midi_again,
  {name_of('midi')} AS name, midi % 12 AS pc, {piano_of('value')} AS value_midi
FROM (SELECT event_id, value, CAST(21 + event_id % 88 AS INT) AS midi FROM events)"""
ORACLE["scalar_functions"] = (
    with_(EV)
    + """SELECT series_id, round(sum(greatest(0.0, x - 50)), 4) AS clipped,
  round(sum(ln(x + 1e-8)), 4) AS ln_sum, round(sum(log2(x)), 4) AS log2_sum,
  round(sqrt(sum(x * x)), 4) AS norm, round(avg(x), 6) AS mean,
  round(stddev_pop(x), 6) AS deviation, max(x) AS largest,
  min(CASE WHEN x = top THEN t END) AS first_argmax
FROM (SELECT *, max(x) OVER (PARTITION BY series_id) AS top FROM ev) GROUP BY series_id"""
)
ORACLE["series_median"] = (
    "SELECT l_suppkey AS series_id, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1"
)

# ---- frames -----------------------------------------------------------------------------

HANN = "(0.5 - 0.5 * cos(2 * pi() * i / {d}))"
ORACLE["sliding_frames_check"] = (
    with_(LN, FR)
    + """SELECT series_id, frame, max(CASE WHEN i = 0 THEN x END) AS first_x,
  max(CASE WHEN i = 63 THEN x END) AS last_x, round(sum(x), 2) AS sum_x,
  round(sum(x * (i + 1)), 2) AS weighted_x FROM fr GROUP BY ALL"""
)
ORACLE["hann_frames"] = (
    with_(LN, FR)
    + f"""SELECT series_id, frame, round(sum(x * {HANN.format(d=64.0)}), 2) AS periodic,
  round(sum(x * {HANN.format(d=63.0)}), 2) AS even_ended FROM fr GROUP BY ALL"""
)
# Padded to 128, symmetric taper, mean removed. `ids` stands for the frame key.
PADDED = """pd AS (
  SELECT {ids}, i, v - avg(v) OVER (PARTITION BY {ids}) AS v FROM (
    SELECT {ids}, i, {x} * (0.5 - 0.5 * cos(2 * pi() * i / 127.0)) AS v FROM {src}
    UNION ALL
    SELECT {ids}, i, 0.0 AS v FROM (SELECT DISTINCT {ids} FROM {src}), (SELECT unnest(range(64, 128)) AS i)))"""
LINE_PADDED = PADDED.format(ids="series_id, frame", x="x", src="fr")
ORACLE["padded_frames"] = (
    with_(LN, FR, LINE_PADDED)
    + """SELECT series_id, frame, CAST(count(*) AS INT) AS n,
  round(max(CASE WHEN i = 0 THEN v END), 3) AS first_value,
  round(max(CASE WHEN i = 32 THEN v END), 3) AS value_32,
  round(sum(v * v) / 1e9, 4) AS energy FROM pd GROUP BY ALL"""
)
ORACLE["frame_time"] = (
    with_(LN, FR)
    + "SELECT DISTINCT series_id, frame, round(frame * 512.0 / 44100.0, 6) AS time_seconds FROM fr"
)
ORACLE["series_duration"] = """
SELECT l_suppkey AS series_id, count(*) AS n, round(count(*) / 44100.0, 9) AS duration_seconds
FROM lineitem GROUP BY 1"""
ORACLE["highpass_series"] = (
    with_(
        EV,
        """hp AS (
  SELECT series_id, t, x, x AS y FROM ev WHERE t = 0
  UNION ALL
  SELECT ev.series_id, ev.t, ev.x, ev.x - hp.x + 0.95 * hp.y
  FROM hp JOIN ev ON ev.series_id = hp.series_id AND ev.t = hp.t + 1)""",
    )
    + "SELECT series_id, t, round(y * pi(), 6) + 0.0 AS y_pi FROM hp"
)

# ---- spectra ----------------------------------------------------------------------------

LINE_DFT = f"""ft AS (
  SELECT series_id, frame, bin, sqrt(re * re + im * im) AS mag FROM (
    SELECT series_id, frame, bin, sum(v * cos(2 * pi() * bin * i / 64.0)) AS re,
           sum(v * sin(2 * pi() * bin * i / 64.0)) AS im
    FROM (SELECT series_id, frame, i, x * {HANN.format(d=64.0)} AS v FROM fr),
         (SELECT unnest(range(33)) AS bin)
    GROUP BY ALL))"""
ORACLE["dft_magnitude"] = (
    with_(LN, FR, LINE_DFT)
    + "SELECT series_id, frame, CAST(bin AS INT) AS bin, round(mag, 2) AS mag FROM ft"
)
ORACLE["bin_frequency"] = (
    with_(EM, SP)
    + """SELECT recording_id, vec_id, CAST(bin AS INT) AS bin, round(bin * 44100.0 / 2048, 6) AS hz,
  round(mag, 6) AS mag FROM sp"""
)


def flux_cte(name: str, source: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, frame, coalesce(sum(pow(greatest(0.0, mag - earlier), 2)), 0.0) AS flux FROM (
    SELECT {key}, frame, mag, lag(mag) OVER (PARTITION BY {key}, bin ORDER BY frame) AS earlier
    FROM {source}) GROUP BY ALL)"""


EM_FLUX = flux_cte("fx", "sp", "recording_id")
ORACLE["spectral_flux"] = (
    with_(EM, SP, EM_FLUX) + "SELECT recording_id, frame, round(flux, 9) AS flux FROM fx"
)
ORACLE["flux_onsets"] = (
    with_(
        LN, FR, LINE_DFT, flux_cte("lf", "ft", "series_id"), onsets_cte("lo", "lf", "series_id", "frame", "flux")
    )
    + "SELECT series_id, frame, round(frame * 512.0 / 44100.0, 6) AS time_seconds FROM lo"
)
NEAR = """nb AS (
  SELECT *, lag(mag) OVER (PARTITION BY vec_id ORDER BY bin) AS l,
         lead(mag) OVER (PARTITION BY vec_id ORDER BY bin) AS r FROM sp)"""
PEAK = "mag > l AND mag > r AND mag > {f} * mx"
ORACLE["spectral_peaks"] = (
    with_(EM, SP, NEAR)
    + f"""SELECT recording_id, vec_id, CAST(bin AS INT) AS bin, round(mag, 9) AS mag,
  round(bin * 44100.0 / 2048, 6) AS hz FROM nb WHERE {PEAK.format(f=0.1)}"""
)
ORACLE["peak_counts"] = (
    with_(EM, SP, NEAR)
    + "SELECT recording_id, vec_id, "
    + ", ".join(
        f"CAST(count(CASE WHEN {PEAK.format(f=f)} THEN 1 END) AS INT) AS n_{n}"
        for n, f in (("01", 0.01), ("10", 0.1), ("25", 0.25))
    )
    + " FROM nb GROUP BY ALL"
)
REFINED = f"""pk AS (
  SELECT recording_id, vec_id, bin, mag,
    (bin + CASE WHEN l - 2 * mag + r = 0 THEN 0 ELSE -((r - l) / 2) / (l - 2 * mag + r) END) * 44100.0 / 2048 AS freq,
    row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS nth
  FROM nb WHERE {PEAK.format(f=0.01)})"""
ORACLE["peak_refine"] = (
    with_(EM, SP, NEAR, REFINED)
    + """SELECT recording_id, vec_id, CAST(bin AS INT) AS bin, round(freq, 6) AS freq,
  round(mag, 9) AS mag FROM pk WHERE nth <= 50"""
)
ORACLE["top_peaks"] = (
    with_(EM, SP, NEAR, REFINED)
    + """SELECT recording_id, vec_id,
  CAST(row_number() OVER (PARTITION BY vec_id ORDER BY mag DESC, bin) - 1 AS INT) AS rank,
  CAST(bin AS INT) AS bin, round(mag, 9) AS mag FROM pk WHERE nth <= 50"""
)
ORACLE["peak_phase"] = (
    with_(
        EM,
        SP,
        """cx AS (
  SELECT recording_id, vec_id, k, sum(f * cos(2 * pi() * k * bin / 64.0)) AS re,
         -sum(f * sin(2 * pi() * k * bin / 64.0)) AS im
  FROM sp, (SELECT unnest(range(33)) AS k) GROUP BY ALL)""",
        """cn AS (
  SELECT *, sqrt(re * re + im * im) AS m, lag(sqrt(re * re + im * im)) OVER w AS l,
         lead(sqrt(re * re + im * im)) OVER w AS r, max(sqrt(re * re + im * im)) OVER (PARTITION BY vec_id) AS mx
  FROM cx WINDOW w AS (PARTITION BY vec_id ORDER BY k))""",
    )
    + """SELECT recording_id, vec_id, CAST(k AS INT) AS bin, round(atan2(im, re), 6) AS phase
FROM cn WHERE m > l AND m > r AND m > 0.1 * mx"""
)

# ---- chords -----------------------------------------------------------------------------

CH = """ch AS (
  SELECT recording_id, vec_id, frame, pc, s / (sqrt(sum(s * s) OVER (PARTITION BY vec_id)) + 1e-6) AS c
  FROM (SELECT recording_id, vec_id, frame, bin % 12 AS pc, sum(mag) AS s FROM sp GROUP BY ALL))"""
TM = f"""tq(qi, quality, steps) AS (VALUES {QUALITIES}),
tm AS (
  SELECT CAST(root_pc * 9 + qi AS INT) AS tid, {NAMES}[root_pc + 1] || ':' || quality AS label, quality,
         CAST(root_pc AS INT) AS root_pc, (root_pc + unnest(steps)) % 12 AS pc,
         1 / sqrt(len(steps)) AS w, len(steps) AS n_classes
  FROM tq, (SELECT unnest(range(12)) AS root_pc))"""
CM = """cs AS (
  SELECT recording_id, vec_id, frame, tid, label, root_pc, round(sum(c * w), 9) AS score
  FROM ch JOIN tm USING (pc) GROUP BY ALL),
cm AS (
  SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tid) = 1)"""
CHORDS = (EM, SP, CH, TM, CM)
TOP2 = """t2 AS (
  SELECT recording_id, vec_id, frame, max(CASE WHEN k = 1 THEN c END) AS c1, max(CASE WHEN k = 2 THEN c END) AS c2
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS k FROM ch) GROUP BY ALL)"""
BASS = """bs AS (
  SELECT recording_id, vec_id, frame, CAST(min(CASE WHEN mag >= 0.1 * mx THEN bin END) AS INT) AS low
  FROM sp GROUP BY ALL)"""

ORACLE["chroma_fold"] = (
    with_(EM, SP, CH)
    + "SELECT recording_id, vec_id, CAST(pc AS INT) AS pc, round(c, 9) AS c FROM ch"
)
ORACLE["chord_templates"] = (
    with_(*CHORDS)
    + """SELECT tid, label, quality, root_pc, CAST(n_classes AS INT) AS n_classes, round(w, 9) AS weight,
  coalesce(n, 0) AS n_frames
FROM (SELECT DISTINCT tid, label, quality, root_pc, n_classes, w FROM tm)
LEFT JOIN (SELECT tid, count(*) AS n FROM cm GROUP BY 1) USING (tid)"""
)
ORACLE["chord_match"] = (
    with_(*CHORDS)
    + "SELECT recording_id, vec_id, tid, label, root_pc, round(score, 6) AS score FROM cm"
)
ORACLE["note_match"] = (
    with_(EM, SP, CH)
    + """SELECT recording_id, vec_id, CAST(pc AS INT) AS pc, round(c, 6) AS note_score FROM ch
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, pc) = 1"""
)
ORACLE["bass_class"] = (
    with_(EM, SP, BASS)
    + "SELECT recording_id, vec_id, low % 12 AS bass_pc, (low + 9) % 12 AS bass_pc_a0 FROM bs"
)
POINTS = "CAST(c2 >= 0.5 * c1 AS INT) + CAST(score > round(c1, 9) AS INT)"
ORACLE["chord_gate"] = (
    with_(*CHORDS, TOP2)
    + f"SELECT recording_id, vec_id, {POINTS} AS points FROM cm JOIN t2 USING (recording_id, vec_id)"
)
INVERSION = """CASE WHEN low % 12 = root_pc THEN 'root'
  WHEN low % 12 IN ((root_pc + 3) % 12, (root_pc + 4) % 12) THEN 'first'
  WHEN low % 12 = (root_pc + 7) % 12 THEN 'second' ELSE 'slash' END"""
ORACLE["chord_inversion"] = (
    with_(*CHORDS, BASS)
    + f"""SELECT recording_id, vec_id, label, root_pc, low % 12 AS bass_pc, {INVERSION} AS inversion
FROM cm JOIN bs USING (recording_id, vec_id)"""
)

# ---- gate -------------------------------------------------------------------------------

FT = """gf AS (
  SELECT a.recording_id, a.vec_id, a.frame, c2 / (c1 + 1e-9) AS peak_ratio, score / (c1 + 1e-9) AS score_ratio,
         entropy, flatness
  FROM t2 a JOIN cm b USING (vec_id) JOIN (
    SELECT vec_id, -sum(p * ln(p + 1e-9)) AS entropy,
           exp(avg(ln(mag + 1e-9))) / avg(mag + 1e-9) AS flatness
    FROM (SELECT vec_id, mag, mag / (sum(mag) OVER (PARTITION BY vec_id) + 1e-9) AS p FROM sp) GROUP BY 1) c
  USING (vec_id))"""
GATE = (*CHORDS, TOP2, FT)
for _key, _col in {
    "peak_ratio": "peak_ratio",
    "score_ratio": "score_ratio",
    "spectral_entropy": "entropy",
    "spectral_flatness": "flatness",
}.items():
    ORACLE[_key] = (
        with_(*GATE) + f"SELECT recording_id, vec_id, round({_col}, 6) AS {_col} FROM gf"
    )
THR = """th AS (
  SELECT recording_id, median(peak_ratio) + stddev_pop(peak_ratio) AS thr_peak_ratio,
    median(score_ratio) + 1.5 * stddev_pop(score_ratio) AS thr_score_ratio,
    median(entropy) + 0.5 * stddev_pop(entropy) AS thr_entropy,
    median(flatness) + 0.5 * stddev_pop(flatness) AS thr_flatness
  FROM gf GROUP BY 1)"""
VOTE = """vt AS (
  SELECT recording_id, vec_id, frame, CAST(peak_ratio > thr_peak_ratio AS INT) + CAST(score_ratio > thr_score_ratio AS INT)
    + CAST(entropy > thr_entropy AS INT) + CAST(flatness > thr_flatness AS INT) AS votes
  FROM gf JOIN th USING (recording_id))"""
ORACLE["gate_thresholds"] = (
    with_(*GATE, THR)
    + """SELECT recording_id, round(thr_peak_ratio, 6) AS thr_peak_ratio, round(thr_score_ratio, 6) AS thr_score_ratio,
  round(thr_entropy, 6) AS thr_entropy, round(thr_flatness, 6) AS thr_flatness FROM th"""
)
ORACLE["gate_vote"] = (
    with_(*GATE, THR, VOTE)
    + "SELECT recording_id, frame, votes, votes >= 3 AS gate_raw FROM vt"
)
SMOOTH = """sg AS (
  SELECT recording_id, frame, votes >= {v} AS loose,
    sum(CAST(votes >= {v} AS INT)) OVER (PARTITION BY recording_id ORDER BY frame
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 3 AS gate FROM vt)"""
ORACLE["gate_smooth"] = (
    with_(*GATE, THR, VOTE, SMOOTH.format(v=2)) + "SELECT recording_id, frame, loose, gate FROM sg"
)
EM_ONSETS = onsets_cte("fo", "fx", "recording_id", "frame", "flux")
ORACLE["event_routing"] = (
    with_(*GATE, THR, VOTE, SMOOTH.format(v=1), EM_FLUX, EM_ONSETS)
    + """SELECT recording_id, frame, CASE WHEN gate THEN 'chord' ELSE 'note' END AS path
FROM fo JOIN sg USING (recording_id, frame)"""
)
ORACLE["chord_records"] = (
    with_(*CHORDS, TOP2, BASS, EM_FLUX, EM_ONSETS)
    + f"""SELECT fo.recording_id, fo.frame AS frame_index, round(fo.frame * 512.0 / 44100.0, 3) AS time_seconds,
  'chord' AS type, label, {INVERSION} AS inversion, round(score, 6) AS confidence, round(c1, 6) AS note_score
FROM fo JOIN cm USING (recording_id, frame) JOIN t2 USING (recording_id, frame) JOIN bs USING (recording_id, frame)
WHERE {POINTS} >= 1"""
)
# Forward pass with back pointers, then the path from the last frame.
_STAY, _MOVE = "CAST(round(ln(0.9) * 1000000) AS BIGINT) * 128", "CAST(round(ln(0.1 / 107) * 1000000) AS BIGINT) * 128"
ORACLE["viterbi_smooth"] = (
    with_(
        *CHORDS,
        f"""ems AS (
  SELECT recording_id, frame,
    list(CAST(round(ln(score + 1e-8) * 1000000) AS BIGINT) * 128 - tid ORDER BY tid) AS e
  FROM cs GROUP BY 1, 2)""",
        f"""fwd AS (
  SELECT recording_id, frame, e AS v, [CAST(NULL AS BIGINT)] AS bp FROM ems WHERE frame = 0
  UNION ALL
  SELECT ems.recording_id, ems.frame,
    list_transform(range(1, 109), lambda j: ems.e[j] + greatest(fwd.v[j] + {_STAY}, list_max(fwd.v) + {_MOVE})),
    list_transform(range(1, 109), lambda j: CASE WHEN fwd.v[j] + {_STAY} >= list_max(fwd.v) + {_MOVE}
      THEN j ELSE list_position(fwd.v, list_max(fwd.v)) END)
  FROM fwd JOIN ems ON ems.recording_id = fwd.recording_id AND ems.frame = fwd.frame + 1)""",
        """pth AS (
  SELECT recording_id, frame, CAST(list_position(v, list_max(v)) AS BIGINT) AS state FROM fwd
  WHERE (recording_id, frame) IN (SELECT (recording_id, max(frame)) FROM ems GROUP BY recording_id)
  UNION ALL
  SELECT f.recording_id, f.frame - 1, CAST(f.bp[pth.state] AS BIGINT) FROM pth JOIN fwd f
    ON f.recording_id = pth.recording_id AND f.frame = pth.frame WHERE f.frame > 0)""",
    )
    + """SELECT DISTINCT recording_id, frame, label FROM pth JOIN (SELECT DISTINCT tid, label FROM tm) ON tid = state - 1"""
)

# ---- pitch ------------------------------------------------------------------------------

# Nearest bin to each harmonic, from the bin frequencies.
HM = """bf AS (SELECT bin, 440.0 * pow(2.0, (bin + 21 - 69) / 12.0) AS hz FROM (SELECT unnest(range(64)) AS bin)),
hm AS (
  SELECT b, h, CAST(arg_min(bin, dist) AS BIGINT) AS target FROM (
    SELECT a.bin AS b, h, c.bin, abs(c.hz - a.hz * h) AS dist
    FROM bf a, (SELECT unnest(range(1, 6)) AS h), bf c) GROUP BY 1, 2)"""
ORACLE["harmonic_map"] = (
    with_(EM, SP, HM)
    + """SELECT recording_id, vec_id, CAST(h AS INT) AS h, round(sum(mag), 6) AS sum_mag, count(*) AS n
FROM sp JOIN hm ON sp.bin = target GROUP BY ALL"""
)


def hps_round(k: int) -> str:
    """One voice: scores on the rest, the pick, and the rest after it."""
    least = "0.08" if k == 1 else "0.4"
    alive = "" if k == 1 else f" JOIN pick{k - 1} USING (vec_id)"
    return f"""sc{k} AS (
  SELECT a.vec_id, a.bin, any_value(a.mx) AS mx,
    round(CASE WHEN any_value(a.res) < 0.05 * any_value(a.mx) THEN -1e6 ELSE 3 * ln(any_value(a.res) + 1e-8)
      + 0.5 * sum(CASE WHEN target <> b THEN ln(o.res + 1e-8) / (h * h) ELSE 0 END) END, 9) AS score
  FROM rest{k} a JOIN hm ON b = a.bin AND h >= 2 JOIN rest{k} o ON o.vec_id = a.vec_id AND o.bin = target
  GROUP BY 1, 2),
pick{k} AS (
  SELECT vec_id, bin AS best FROM (
    SELECT sc{k}.vec_id, bin, score, mx FROM sc{k}{alive}
    QUALIFY row_number() OVER (PARTITION BY sc{k}.vec_id ORDER BY score DESC, bin) = 1)
  WHERE mx > 0 AND score >= ln({least} * mx)),
rest{k + 1} AS (
  SELECT r.vec_id, r.bin, r.mag, r.mx, greatest(0.0, r.res - r.mag * coalesce(take, 0)) AS res
  FROM rest{k} r LEFT JOIN (
    SELECT vec_id, target AS bin, sum(0.9 / h) AS take FROM pick{k} JOIN hm ON b = best GROUP BY 1, 2) t
  USING (vec_id, bin))"""


REST1 = "rest1 AS (SELECT vec_id, bin, mag, mx, mag AS res FROM sp)"
HPS1 = (HM, REST1, hps_round(1), "hp AS (SELECT vec_id, CAST(best + 21 AS INT) AS note FROM pick1)")
ORACLE["hps_pitch"] = (
    with_(EM, SP, *HPS1) + "SELECT recording_id, vec_id, note FROM em LEFT JOIN hp USING (vec_id)"
)
ORACLE["hps_multivoice"] = (
    with_(EM, LOUD, HM, REST1, *[hps_round(k) for k in (1, 2, 3, 4)])
    + """SELECT recording_id, vec_id,
  CAST(row_number() OVER (PARTITION BY vec_id ORDER BY best, k) - 1 AS INT) AS voice, CAST(best + 21 AS INT) AS note
FROM ("""
    + " UNION ALL ".join(f"SELECT {k} AS k, vec_id, best FROM pick{k}" for k in (1, 2, 3, 4))
    + ") JOIN em USING (vec_id)"
)
HSUM = """hs AS (
  SELECT a.vec_id, a.bin, any_value(a.mag) AS mag, any_value(a.mx) AS mx,
    round(2 * CASE WHEN any_value(a.mag) > 0.1 * any_value(a.mx) THEN any_value(a.mag) ELSE 0 END
      + sum(CASE WHEN o.mag > 0.06 * a.mx THEN o.mag / h ELSE 0 END), 9) AS score
  FROM sp a JOIN hm ON b = a.bin AND h >= 2 JOIN sp o ON o.vec_id = a.vec_id AND o.bin = target
  GROUP BY 1, 2),
hb AS (
  SELECT vec_id, bin AS best, mag, mx FROM hs WHERE mx >= 0.1
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, bin) = 1)"""
ORACLE["harmonic_sum_pitch"] = (
    with_(EM, SP, HM, HSUM)
    + "SELECT recording_id, vec_id, CAST(best + 21 AS INT) AS note FROM em LEFT JOIN hb USING (vec_id)"
)
MISS = """am AS (
  SELECT vec_id, bin - 12 AS low, mx FROM sp
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(mag, 9) DESC, bin) = 1),
mf AS (
  SELECT am.vec_id, low FROM am JOIN sp f ON f.vec_id = am.vec_id AND f.bin = low
  JOIN (SELECT am.vec_id, sum(mag) AS backing FROM am JOIN hm ON b = low AND h IN (2, 3, 4)
        JOIN sp o ON o.vec_id = am.vec_id AND o.bin = target GROUP BY 1) s ON s.vec_id = am.vec_id
  WHERE low >= 0 AND backing > 4 * f.mag AND backing > 0.7 * f.mx AND f.mag < 0.2 * f.mx),
sn AS (
  SELECT vec_id, CAST(21 + CASE WHEN mag < 0.3 * mx AND low IS NOT NULL THEN low ELSE best END AS INT) AS note
  FROM hb LEFT JOIN mf USING (vec_id))"""
ORACLE["missing_fundamental"] = (
    with_(EM, SP, HM, HSUM, MISS) + "SELECT recording_id, vec_id, note FROM em LEFT JOIN sn USING (vec_id)"
)
ORACLE["missing_fundamental_test"] = (
    with_(EM, SP, HM, HSUM, MISS)
    + "SELECT recording_id, vec_id, CAST(low AS INT) AS lower_bin FROM em LEFT JOIN mf USING (vec_id)"
)
AROUND = """ar AS (
  SELECT recording_id, vec_id, bin,
    max(mag) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m2,
    max(mag) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m3,
    max(mag) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m5
  FROM sp)"""
ORACLE["neighbourhood_max"] = (
    with_(EM, SP, AROUND)
    + "SELECT recording_id, vec_id, CAST(bin AS INT) AS bin, round(m2, 9) AS mx FROM ar"
)
FFT = f"""fp AS (SELECT vec_id, bin AS k, mag FROM nb WHERE bin BETWEEN 1 AND 26 AND {PEAK.format(f=0.1)}),
fs AS (
  SELECT vec_id, k, round(mag + 0.3 * coalesce(over_, 0) - 0.5 * coalesce(under_, 0), 9) AS score
  FROM fp
  LEFT JOIN (SELECT vec_id, k, sum(m2 / (h * h)) AS over_ FROM fp
             JOIN (SELECT unnest(range(2, 6)) AS h) ON true JOIN ar USING (vec_id)
             WHERE ar.bin = k * h GROUP BY 1, 2) USING (vec_id, k)
  LEFT JOIN (SELECT vec_id, k, sum(CASE WHEN m2 > 0.5 * fp.mag THEN m2 * s ELSE 0 END) AS under_ FROM fp
             JOIN (SELECT unnest(range(2, 5)) AS s) ON true JOIN ar USING (vec_id)
             WHERE ar.bin = k // s AND k * 44100.0 / 2048 / s >= 40 GROUP BY 1, 2) USING (vec_id, k)),
fn AS (
  SELECT vec_id, CAST(k AS INT) AS k, {piano_of('k * 44100.0 / 2048')} AS note FROM fs
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) = 1)"""
ORACLE["fft_fundamental"] = (
    with_(EM, SP, NEAR, AROUND, FFT)
    + "SELECT recording_id, vec_id, k AS bin, note FROM em LEFT JOIN fn USING (vec_id)"
)


def lag_ctes(ids: str, src: str, x: str) -> tuple[str, ...]:
    """Lag curves of padded frames and the two period estimators; `ids` is the frame key."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in ids.split(","))
    ids_a = ", ".join(f"a.{c.strip()}" for c in ids.split(","))
    return (
        PADDED.format(ids=ids, x=x, src=src),
        f"""lg AS (
  SELECT {ids_a}, lag, sum(a.v * b.v) AS acf, sum(pow(a.v - b.v, 2)) AS d
  FROM pd a JOIN (SELECT unnest(range(56)) AS lag) ON true JOIN pd b ON {on} AND b.i = a.i + lag GROUP BY ALL)""",
        f"""na AS (
  SELECT {ids}, lag, acf / max(CASE WHEN lag = 0 THEN acf END) OVER (PARTITION BY {ids}) AS r FROM lg),
nl AS (
  SELECT *, lag(r) OVER w AS before_, lead(r) OVER w AS after_ FROM na WINDOW w AS (PARTITION BY {ids} ORDER BY lag)),
ac AS (
  SELECT {ids}, lag FROM nl WHERE lag BETWEEN 4 AND 43 AND r > before_ AND r > after_ AND r > 0.25
  QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY
    round(r * CASE WHEN {RATE} / lag < 150 THEN 1.2 ELSE 1 END, 9) DESC, lag) = 1)""",
        f"""cv AS (
  SELECT {ids}, lag, CASE WHEN total > 0 THEN d * lag / total ELSE 1 END AS c FROM (
    SELECT {ids}, lag, d, sum(d) OVER (PARTITION BY {ids} ORDER BY lag) AS total FROM lg WHERE lag BETWEEN 3 AND 55)),
cl AS (
  SELECT *, lag(c) OVER w AS before_, lead(c) OVER w AS after_ FROM cv WINDOW w AS (PARTITION BY {ids} ORDER BY lag)),
hit AS (SELECT {ids}, min(lag) AS hit FROM cv WHERE c < 0.15 AND lag < 55 GROUP BY {ids}),
settled AS (
  SELECT {ids}, lag FROM cv JOIN hit USING ({ids}) WHERE lag BETWEEN hit - 3 AND hit + 3 AND lag < 55
  QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY c, lag <> hit, lag) = 1),
low AS (
  SELECT {ids}, lag FROM (
    SELECT {ids}, lag, c FROM cl WHERE lag BETWEEN 4 AND 53 AND c < before_ AND c < after_
    QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY
      round(c * CASE WHEN {RATE} / lag < 200 THEN 0.9 ELSE 1 END, 9), lag) = 1)
  WHERE c <= 0.8),
chosen AS (
  SELECT * FROM settled UNION ALL SELECT {ids}, lag FROM low ANTI JOIN hit USING ({ids})),
yl AS (
  SELECT {ids}, lag + CASE WHEN lag > 3 AND lag < 54 AND before_ - 2 * c + after_ > 0
      AND abs(((after_ - before_) / 2) / (before_ - 2 * c + after_)) <= 0.5
    THEN -((after_ - before_) / 2) / (before_ - 2 * c + after_) ELSE 0 END AS lag
  FROM chosen JOIN cl USING ({ids}, lag))""",
    )


LINE_LAGS = (LN, FR, *lag_ctes("series_id, frame", "fr", "x"))
ALL_FRAMES = "(SELECT DISTINCT series_id, frame FROM fr)"
ORACLE["autocorr_period"] = (
    with_(*LINE_LAGS)
    + f"""SELECT series_id, frame, CAST(lag AS INT) AS lag, {piano_of(f'{RATE} / lag')} AS note
FROM {ALL_FRAMES} LEFT JOIN ac USING (series_id, frame)"""
)
ORACLE["lag_difference"] = (
    with_(*LINE_LAGS)
    + """SELECT series_id, frame, CAST(lag AS INT) AS lag, round(d / 1e9, 4) AS d
FROM lg WHERE lag BETWEEN 3 AND 55"""
)
ORACLE["cmnd"] = (
    with_(*LINE_LAGS)
    + "SELECT series_id, frame, CAST(lag AS INT) AS lag, round(c, 6) AS v FROM cv"
)
TONE = LN.replace("ln AS", "plain AS") + """,
ln AS (SELECT series_id, t, n, round(x / (40 + 460 * (series_id % 2)) + 1000 * cos(2 * pi() * t / (6 + series_id % 25)), 3) AS x FROM plain)"""
ORACLE["yin_period"] = (
    with_(*[TONE if part is LN else part for part in LINE_LAGS])
    + f"""SELECT series_id, frame, round(lag, 6) AS lag, {piano_of(f'{RATE} / lag')} AS note
FROM {ALL_FRAMES} LEFT JOIN yl USING (series_id, frame)"""
)


def fit_cte(name: str, source: str) -> str:
    """Harmonic fit of rows `(vec_id, note)`."""
    return f"""{name} AS (
  SELECT vec_id, note, (CASE WHEN hz < 150 AND found >= 2 THEN fund * 0.2 + harm * 0.8
      WHEN hz < 150 THEN fund * 0.6 + harm * 0.4 WHEN found > 0 THEN fund * 0.4 + harm * 0.6 ELSE fund END)
    * CASE WHEN found >= 3 THEN 1.2 ELSE 1 END AS fit
  FROM (
    SELECT vec_id, note, any_value(hz) AS hz, any_value(fund) AS fund,
      sum(CASE WHEN w > thr THEN w * CASE WHEN hz < 100 THEN 1.5 ELSE 1 END / h ELSE 0 END) AS harm,
      sum(CASE WHEN w > thr THEN 1 ELSE 0 END) AS found
    FROM (
      SELECT c.vec_id, c.note, c.hz, h, f.m2 AS fund, CASE WHEN c.hz > 100 THEN o.m3 ELSE o.m5 END AS w,
        t.mx * CASE WHEN c.hz < 150 THEN 0.05 ELSE 0.1 END AS thr
      FROM (SELECT DISTINCT vec_id, note, {hz_of('note')} AS hz FROM {source}) c
      JOIN (SELECT unnest(range(2, 9)) AS h) ON h <= CASE WHEN c.hz < 150 THEN 8 ELSE 5 END
      JOIN ar f ON f.vec_id = c.vec_id AND f.bin = least(63, CAST(round(c.hz / (44100.0 / 2048)) AS BIGINT))
      JOIN ar o ON o.vec_id = c.vec_id AND o.bin = least(63, CAST(round(c.hz * h / (44100.0 / 2048)) AS BIGINT))
      JOIN (SELECT DISTINCT vec_id, mx FROM sp) t ON t.vec_id = c.vec_id)
    GROUP BY vec_id, note))"""


ORACLE["harmonic_fit"] = (
    with_(
        EM,
        SP,
        AROUND,
        "trial AS (SELECT vec_id, CAST(note AS INT) AS note FROM em, (SELECT unnest([26, 38, 47, 57, 66]) AS note))",
        fit_cte("hf", "trial"),
    )
    + "SELECT recording_id, vec_id, note, round(fit, 6) AS fit FROM hf JOIN em USING (vec_id)"
)
ESTIMATES = (
    EM,
    SP,
    NEAR,
    AROUND,
    FFT,
    *HPS1,
    HSUM,
    MISS,
    "sx AS (SELECT vec_id, bin AS i, f AS x FROM sp)",
    *lag_ctes("vec_id", "sx", "x"),
    f"""cd AS (
  SELECT * FROM (
    SELECT vec_id, 'FFT' AS method, 0 AS ord, note FROM fn
    UNION ALL SELECT vec_id, 'CQT_Simple', 1, note FROM sn
    UNION ALL SELECT vec_id, 'HPS', 2, note FROM hp
    UNION ALL SELECT vec_id, 'Autocorr', 3, {piano_of(f'{RATE} / lag')} FROM ac
    UNION ALL SELECT vec_id, 'YIN', 4, {piano_of(f'{RATE} / lag')} FROM yl) WHERE note IS NOT NULL)""",
    """win AS (
  SELECT vec_id, pc, votes FROM (
    SELECT vec_id, note % 12 AS pc, count(*) AS votes, min(ord) AS seen FROM cd GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, seen) = 1),
wc AS (SELECT cd.*, votes, pc FROM cd JOIN win ON win.vec_id = cd.vec_id AND note % 12 = pc)""",
    fit_cte("hf", "wc"),
    f"""rb AS (
  SELECT vec_id, note, CASE WHEN votes = 1 THEN method ELSE method || ' (octave-corrected)' END AS method
  FROM (SELECT wc.*, round(fit * CASE
      WHEN {hz_of('wc.note')} < 150 THEN CASE method WHEN 'YIN' THEN 1.3 WHEN 'Autocorr' THEN 1.2 WHEN 'FFT' THEN 1.1 ELSE 1 END
      WHEN {hz_of('wc.note')} < 300 AND method IN ('YIN', 'HPS') THEN 1.1 ELSE 1 END, 9) AS score
    FROM wc JOIN hf USING (vec_id, note))
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) = 1)""",
)
ORACLE["pitch_candidates"] = (
    with_(*ESTIMATES)
    + "SELECT recording_id, vec_id, method, ord, note FROM cd JOIN em USING (vec_id)"
)
ORACLE["pitch_vote"] = (
    with_(*ESTIMATES)
    + """SELECT recording_id, vec_id, any_value(pc) AS pc, CAST(count(*) AS INT) AS votes,
  CAST(floor(median(note)) AS INT) AS median_note FROM wc JOIN em USING (vec_id) GROUP BY 1, 2"""
)
ORACLE["octave_select"] = (
    with_(*ESTIMATES)
    + "SELECT recording_id, vec_id, note, method FROM em LEFT JOIN rb USING (vec_id)"
)
ORACLE["method_cascade"] = (
    with_(*[LOUD if part is SP else part for part in ESTIMATES])
    + """SELECT recording_id, vec_id,
  CASE WHEN rn IS NOT NULL THEN rn WHEN s IS NOT NULL THEN s WHEN h IS NOT NULL THEN h ELSE f END AS note,
  CASE WHEN rn IS NOT NULL THEN 'Robust (' || method || ')' WHEN s = h THEN 'CQT (consensus)'
    WHEN s IS NOT NULL THEN 'CQT (simple)' WHEN h IS NOT NULL THEN 'CQT (HPS)' WHEN f IS NOT NULL THEN 'FFT'
    ELSE 'None' END AS method,
  CAST(CASE WHEN rn IS NOT NULL THEN 0.9 WHEN s = h THEN 0.8 WHEN s IS NOT NULL THEN 0.7 WHEN h IS NOT NULL THEN 0.6
    WHEN f IS NOT NULL THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence
FROM (
  SELECT em.recording_id, em.vec_id, CASE WHEN rb.method LIKE '%corrected)' AND rb.note % 3 = 0 THEN rb.note END AS rn, rb.method,
    CASE WHEN sn.note % 2 = 0 THEN sn.note END AS s, CASE WHEN hp.note % 4 <> 1 THEN hp.note END AS h,
    CASE WHEN fn.note % 5 <> 0 THEN fn.note END AS f
  FROM em LEFT JOIN rb USING (vec_id) LEFT JOIN sn USING (vec_id) LEFT JOIN hp USING (vec_id) LEFT JOIN fn USING (vec_id))"""
)


def mismatch(source: str) -> str:
    """Rows `(vec_id, f0, err)` for trial fundamentals `(vec_id, f0)`."""
    return f"""SELECT vec_id, f0, round((fwd + coalesce(bwd, 0)) / (terms + 1), 9) AS err FROM (
    SELECT vec_id, f0, sum(gap) AS fwd, count(*) AS terms FROM (
      SELECT vec_id, f0, h, min(abs(freq - f0 * h)) AS gap
      FROM {source} JOIN (SELECT unnest(range(1, 11)) AS h) ON f0 * h <= 22050 JOIN pk USING (vec_id) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) LEFT JOIN (
    SELECT vec_id, f0, sum(abs(freq - f0 * round_even(freq / f0, 0)) * mag) AS bwd
    FROM {source} JOIN pk USING (vec_id)
    WHERE freq >= 0.8 * f0 AND round_even(freq / f0, 0) BETWEEN 1 AND 10 GROUP BY 1, 2) USING (vec_id, f0)"""


ORACLE["twm_error"] = (
    with_(
        EM,
        SP,
        NEAR,
        REFINED,
        "trial AS (SELECT vec_id, CAST(f0 AS DOUBLE) AS f0 FROM em, (SELECT unnest([90, 150, 300, 700]) AS f0))",
        f"er AS ({mismatch('trial')})",
    )
    + "SELECT recording_id, vec_id, f0 AS trial, round(coalesce(err, 1e6), 6) AS error FROM trial JOIN em USING (vec_id) LEFT JOIN er USING (vec_id, f0)"
)
ORACLE["twm_grid"] = (
    with_(
        EM,
        SP,
        NEAR,
        REFINED,
        "grid1 AS (SELECT vec_id, CAST(80 + 2 * g AS DOUBLE) AS f0 FROM em, (SELECT unnest(range(361)) AS g))",
        f"er1 AS ({mismatch('grid1')})",
        "b1 AS (SELECT vec_id, f0, err FROM er1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY err, f0) = 1)",
        """grid2 AS (
  SELECT vec_id, round(greatest(80.0, f0 - 5) + 0.2 * g, 1) AS f0 FROM b1, (SELECT unnest(range(60)) AS g)
  WHERE round(greatest(80.0, f0 - 5) + 0.2 * g, 1) < least(800.0, f0 + 5) + 1)""",
        f"er2 AS ({mismatch('grid2')})",
        "b2 AS (SELECT vec_id, f0, err FROM er2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY err, f0) = 1)",
    )
    + """SELECT recording_id, em.vec_id, CAST(CASE WHEN b1.err IS NULL OR least(b1.err, b2.err) >= 50 THEN 0
  WHEN b2.err < b1.err THEN b2.f0 ELSE b1.f0 END AS DOUBLE) AS f0
FROM em LEFT JOIN b1 USING (vec_id) LEFT JOIN b2 USING (vec_id)"""
)
ORACLE["harmonic_suppress"] = (
    with_(
        EM,
        SP,
        NEAR,
        AROUND,
        FFT,
        """rs AS (
  SELECT sp.vec_id, bin, lead, CASE WHEN lead IS NOT NULL AND bin - (lead - 21) IN
      (SELECT CAST(round(12 * log2(h)) AS BIGINT) FROM (SELECT unnest(range(1, 8)) AS h))
    THEN greatest(0.0, mag - 0.8 * mag) ELSE mag END AS res
  FROM sp LEFT JOIN (SELECT vec_id, note AS lead FROM fn) USING (vec_id))""",
        """ad AS (
  SELECT vec_id, bin + 21 AS note, row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS nth, lead
  FROM (SELECT *, max(res) OVER (PARTITION BY vec_id) AS mres FROM rs)
  WHERE res > 0.8 * mres AND (lead IS NULL OR (bin + 21 <> lead AND NOT EXISTS (
    SELECT 1 FROM (SELECT unnest(range(2, 7)) AS h) WHERE abs(pow(2.0, (bin + 21 - lead) / 12.0) - h) < 0.1))))""",
        """alln AS (
  SELECT vec_id, note FROM ad WHERE nth <= 4 - CASE WHEN lead IS NULL THEN 0 ELSE 1 END
  UNION ALL SELECT vec_id, note FROM fn WHERE note IS NOT NULL)""",
    )
    + """SELECT recording_id, vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY note) - 1 AS INT) AS voice,
  CAST(note AS INT) AS note FROM alln JOIN em USING (vec_id)"""
)

# ---- sources, sinks, reports ------------------------------------------------------------

DF = """df AS (
  SELECT source || '/' || doc_id || CASE WHEN lang <> 'de' THEN '.' || lang ELSE '' END AS path,
    strlen(text) AS length, lang, encode(text) AS content, doc_id, source FROM documents)"""
REASON = """CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'Unsupported file type: ' || lang
  WHEN length > 8192 THEN 'File too large' END"""
ORACLE["recordings_admission"] = (
    with_(DF)
    + f"""SELECT path, length, lower(substr(hex(content), 1, 24)) AS header,
  CASE WHEN lang <> 'de' THEN '.' || lang ELSE '.wav' END AS extension, {REASON} AS error FROM df"""
)
ORACLE["quarantine_rows"] = (
    with_(DF)
    + f"""SELECT path AS recording_id, 'admission' AS stage, {REASON} AS error FROM df WHERE {REASON} IS NOT NULL"""
)
ORACLE["rate_assertion"] = """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 22050 ELSE 44100 END AS INT) AS rate,
  CASE WHEN event_type = 'error' THEN 'Expected 44100 Hz, got 22050' END AS error FROM events"""
ORACLE["channel_mixdown"] = (
    with_(LN) + "SELECT series_id, t, round((x + l_quantity) / 2.0, 4) AS mono FROM ln"
)
ORACLE["pcm16_scan"] = """
WITH words AS (
  SELECT doc_id, (strlen(text) + 1) // 2 AS n,
    unnest(regexp_extract_all(hex(encode(text)) || CASE WHEN strlen(text) % 2 = 1 THEN '00' ELSE '' END, '[0-9A-F]{4}')) AS w
  FROM documents),
samples AS (
  SELECT doc_id, n, CAST('0x' || substr(w, 3, 2) || substr(w, 1, 2) AS INT) AS v FROM words),
signed AS (SELECT doc_id, n, v - CASE WHEN v >= 32768 THEN 65536 ELSE 0 END AS v FROM samples)
SELECT doc_id, any_value(n) AS n_samples, CAST(sum(v) AS BIGINT) AS total, CAST(max(v) AS INT) AS largest,
  CAST(min(v) AS INT) AS smallest FROM signed GROUP BY 1"""
# Fourier interpolation written as a sum over the n samples of a block, for every n.
def resampled(target: str) -> str:
    return (
        with_(
            LN,
            BL,
            f"sizes AS (SELECT DISTINCT nb, {target} AS m FROM bl)",
            """kn AS (
  SELECT nb, p, i, (1 + coalesce(sum(CASE
      WHEN 2 * k < least(nb, m) OR m = nb THEN 2 * cos(2 * pi() * k * (p / CAST(m AS DOUBLE) - i / CAST(nb AS DOUBLE)))
      WHEN m < nb THEN 2 * cos(2 * pi() * k * i / nb) * cos(pi() * p)
      ELSE cos(pi() * i) * cos(2 * pi() * k * p / m) END), 0)) / nb AS w
  FROM (SELECT nb, m, unnest(range(m)) AS p FROM sizes) JOIN (SELECT nb, unnest(range(nb)) AS i FROM sizes) USING (nb)
    LEFT JOIN (SELECT unnest(range(1, 33)) AS k) ON 2 * k <= least(nb, m) GROUP BY 1, 2, 3)""",
        )
        + "SELECT series_id, frame, CAST(p AS INT) AS i, round(sum(x * w), 3) + 0.0 AS y FROM bl JOIN kn USING (nb, i) GROUP BY ALL"
    )


ORACLE["resample_blocks"] = resampled("nb * 3 // 4")
ORACLE["resample_up"] = resampled("nb * 3 // 2")
ORACLE["resample_series"] = (
    with_(EV)
    + """SELECT series_id, j, round(a.x + (coalesce(b.x, a.x) - a.x) * ((j * 160 - a.t * 147) / 147.0), 6) + 0.0 AS y
FROM (SELECT series_id, unnest(range(count(*) * 147 // 160)) AS j FROM ev GROUP BY 1)
  JOIN ev a USING (series_id) LEFT JOIN ev b ON b.series_id = a.series_id AND b.t = a.t + 1
WHERE a.t = j * 160 // 147"""
)

# Onsets and notes of the event series; values count as frequencies.
EN = f"""ons AS (
  SELECT CAST(series_id AS VARCHAR) AS recording_id, t AS frame_index, round(t * 512.0 / 44100.0, 3) AS time_seconds, x FROM eo),
nts AS (
  SELECT *, {name_of('midi_note')} AS note_name, round({hz_of('midi_note')}, 2) AS frequency_hz,
    CASE WHEN midi_note >= 60 THEN 'High' ELSE 'Low' END AS method,
    CAST(CASE WHEN midi_note >= 60 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence
  FROM (SELECT recording_id, frame_index, time_seconds, {piano_of('x')} AS midi_note FROM ons) WHERE midi_note IS NOT NULL),
recs AS (SELECT CAST(series_id AS VARCHAR) AS recording_id, count(*) * 512 AS n_samples FROM ev GROUP BY 1),
sm AS (
  SELECT recording_id, coalesce(o, 0) AS total_onsets, coalesce(k, 0) AS total_notes, CAST(0 AS BIGINT) AS total_chords,
    round(n_samples / 44100.0, 6) AS duration_seconds, CAST(44100 AS INT) AS sample_rate
  FROM recs LEFT JOIN (SELECT recording_id, count(*) AS o FROM ons GROUP BY 1) USING (recording_id)
  LEFT JOIN (SELECT recording_id, count(*) AS k FROM nts GROUP BY 1) USING (recording_id))"""
EVENTS = (EV, EV_ONSETS, EN)
ORACLE["analysis_summary"] = with_(*EVENTS) + "SELECT * FROM sm"
ORACLE["detection_rate"] = (
    with_(*EVENTS)
    + """SELECT recording_id,
  CASE WHEN total_onsets > 0 THEN round(total_notes / total_onsets * 100, 1) END AS detection_rate FROM sm"""
)
_SUMMARY_JSON = (
    "'\"total_onsets\":' || total_onsets || ',\"total_notes\":' || total_notes || "
    "',\"total_chords\":0,\"sample_rate\":44100}'"
)
ORACLE["result_json"] = (
    with_(*EVENTS)
    + f"SELECT '{{\"recording_id\":\"' || recording_id || '\",' || {_SUMMARY_JSON} AS document FROM sm"
)
ORACLE["file_info"] = (
    with_(DF)
    + """SELECT path AS recording_id, doc_id || CASE WHEN lang <> 'de' THEN '.' || lang ELSE '' END AS filename,
  lang AS content_type, CAST(44100 AS INT) AS original_sample_rate, CAST(44100 AS INT) AS processed_sample_rate,
  CAST(1 AS INT) AS channels FROM df"""
)
ORACLE["analysis_frames"] = (
    with_(EV, EV_ONSETS)
    + """SELECT series_id, t, least(t + 3, last_t) AS analysed
FROM eo JOIN (SELECT series_id, max(t) AS last_t FROM ev GROUP BY 1) USING (series_id)"""
)
ORACLE["onset_records"] = with_(*EVENTS) + "SELECT recording_id, frame_index, time_seconds FROM ons"
ORACLE["note_records"] = (
    with_(*EVENTS)
    + """SELECT recording_id, frame_index, time_seconds, midi_note, note_name, frequency_hz, method, confidence
FROM nts"""
)
ORACLE["note_lines"] = (
    with_(*EVENTS)
    + """SELECT recording_id, frame_index,
  printf('%6.2fs: %4s (%6.1fHz) - %s', time_seconds, note_name, frequency_hz, method) AS line,
  printf('%.2fs: %s (%.0f%%)', time_seconds, note_name, confidence * 100) AS timing FROM nts"""
)
ORACLE["report_rows"] = (
    with_(*EVENTS)
    + """SELECT recording_id, round(coalesce(c, 0), 6) AS confidence, coalesce(m, 'No detection') AS method,
  printf('%.1f%%', coalesce(c, 0) * 100) AS confidence_text
FROM recs LEFT JOIN (
  SELECT recording_id, avg(confidence) AS c, arg_min(method, frame_index) AS m FROM nts GROUP BY 1) USING (recording_id)"""
)
ORACLE["event_lists"] = (
    with_(*EVENTS)
    + """SELECT recording_id, CAST(0 AS BIGINT) AS part, coalesce(n, 0) AS n_onsets, coalesce(ot, '') AS onset_times,
  coalesce(nn, 'None detected') AS note_names
FROM recs
LEFT JOIN (SELECT recording_id, count(*) AS n, string_agg(printf('%.3f', time_seconds), ', ' ORDER BY frame_index) AS ot
           FROM ons GROUP BY 1) USING (recording_id)
LEFT JOIN (SELECT recording_id, string_agg(note_name, ', ' ORDER BY frame_index) AS nn FROM nts GROUP BY 1) USING (recording_id)"""
)
ORACLE["result_document"] = (
    with_(*EVENTS)
    + f"""SELECT recording_id, CAST(0 AS BIGINT) AS part,
  '{{"onsets":[' || coalesce(ol, '') || '],"notes":[' || coalesce(nl, '') || '],"analysis_summary":{{' || {_SUMMARY_JSON} || '}}' AS document
FROM sm
LEFT JOIN (SELECT recording_id, string_agg('{{"frame_index":' || frame_index || '}}', ',' ORDER BY frame_index) AS ol
           FROM ons GROUP BY 1) USING (recording_id)
LEFT JOIN (SELECT recording_id, string_agg('{{"frame_index":' || frame_index || ',"midi_note":' || midi_note || ',"note_name":"'
             || note_name || '","method":"' || method || '"}}', ',' ORDER BY frame_index) AS nl
           FROM nts GROUP BY 1) USING (recording_id)"""
)
ORACLE["duration_format"] = """
SELECT event_id, CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(printf('%.1f', value % 60 + CASE WHEN (value % 60) * 4 = floor((value % 60) * 4) THEN 0.01 ELSE 0 END), 4, '0') AS clock
FROM events"""
ORACLE["export_names"] = """
SELECT event_id, 'piano_recording_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || '.wav' AS name FROM events"""
ORACLE["top_candidates"] = (
    with_(EM, SP, HM, HSUM)
    + """SELECT recording_id, vec_id, CAST(k - 1 AS INT) AS rank, CAST(bin + 21 AS INT) AS note, round(score, 6) AS score
FROM (SELECT vec_id, bin, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, bin) AS k FROM hs)
JOIN em USING (vec_id) WHERE k <= 3"""
)

# Samples of the texts of 200 ids laid end to end, and Hann-windowed tones written out sample by sample.
ORACLE["constant_q_spectrum"] = """
WITH joined AS (
  SELECT doc_id // 200 AS part, string_agg(text, '' ORDER BY doc_id, text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1),
words AS (
  SELECT part, unnest(regexp_extract_all(hex(encode(text)) || CASE WHEN strlen(text) % 2 = 1 THEN '00' ELSE '' END, '[0-9A-F]{4}')) AS w,
    generate_subscripts(regexp_extract_all(hex(encode(text)) || CASE WHEN strlen(text) % 2 = 1 THEN '00' ELSE '' END, '[0-9A-F]{4}'), 1) - 1 AS t
  FROM joined),
samples AS (SELECT part, t, CAST('0x' || substr(w, 3, 2) || substr(w, 1, 2) AS INT) AS v FROM words),
frames AS (
  SELECT part, t // 2048 AS frame, list((v - CASE WHEN v >= 32768 THEN 65536 ELSE 0 END) / 32768.0 ORDER BY t) AS f
  FROM samples GROUP BY 1, 2 HAVING count(*) = 2048),
bins AS (
  SELECT bin, 440 * pow(2, (21 + bin - 69) / 12.0) AS hz, 44100 / (pow(2, 1 / 12.0) - 1) / (440 * pow(2, (21 + bin - 69) / 12.0)) AS span
  FROM (SELECT unnest(range(88)) AS bin)),
tones AS (
  SELECT bin, centre, list(w * cos(a) ORDER BY n) AS re, list(w * sin(a) ORDER BY n) AS im FROM (
    SELECT bin, centre, n, 2 * pi() * hz * (n - centre) / 44100 AS a,
      CASE WHEN abs(n - centre) <= span / 2 THEN 0.5 + 0.5 * cos(2 * pi() * (n - centre) / span) ELSE 0 END * 2 / sqrt(span) AS w
    FROM bins, (SELECT unnest(range(0, 2049, 512)) AS centre), (SELECT unnest(range(2048)) AS n))
  GROUP BY 1, 2)
SELECT part, frame, CAST(bin AS INT) AS bin,
  round(avg(sqrt(pow(list_inner_product(f, re), 2) + pow(list_inner_product(f, im), 2))), 5) + 0.0 AS mag
FROM frames, tones GROUP BY 1, 2, 3
"""
