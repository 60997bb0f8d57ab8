"""Fixed values that results depend on."""

# Sampling contract: 44.1 kHz, mono, 16 bit; frames of 2048 samples every 512.
SAMPLE_RATE = 44100
CHANNELS = 1
BITS_PER_SAMPLE = 16
FRAME_SIZE = 2048
HOP_SIZE = 512
PADDED_SIZE = 4096
CQT_BINS = 88
LOWEST_MIDI = 21
HIGHEST_MIDI = 108
C1_MIDI = 24

# Pitch-class names, from C upwards.
ROOTS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

# Chord qualities as semitones above the root.
CHORD_INTERVALS = {
    "maj": [0, 4, 7],
    "min": [0, 3, 7],
    "dim": [0, 3, 6],
    "aug": [0, 4, 8],
    "sus2": [0, 2, 7],
    "sus4": [0, 5, 7],
    "maj7": [0, 4, 7, 11],
    "min7": [0, 3, 7, 10],
    "dom7": [0, 4, 7, 10],
}

# Admission of uploads.
ALLOWED_CONTENT_TYPES = [
    "audio/wav",
    "audio/wave",
    "audio/x-wav",
    "audio/aac",
    "audio/mpeg",
    "audio/mp3",
]
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
DEFAULT_EXTENSION = ".wav"

# One-pole high-pass coefficient.
HIGHPASS_ALPHA = 0.95

# Onset rule: trailing window length and deviation factor.
ONSET_WINDOW = 50
ONSET_K = 1.5

# Gate: standard deviations added to the median, in feature order
# peak_ratio, score_ratio, entropy, flatness; votes needed; smoothing width.
GATE_FEATURES = ["peak_ratio", "score_ratio", "entropy", "flatness"]
GATE_K = [1.0, 1.5, 0.5, 0.5]
GATE_VOTES = 3
GATE_SMOOTH = 5

# Frames between an onset and the frame that is analysed for it.
ANALYSIS_DELAY = 3

# Estimators in voting order.
METHODS = ["FFT", "CQT_Simple", "HPS", "Autocorr", "YIN"]
