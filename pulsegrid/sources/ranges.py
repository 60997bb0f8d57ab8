"""Recording files of any size as a data source whose partitions are byte ranges.

`spark.read.format("recording_ranges").load(folder)` gives the segments that `recordings.decode` gives, but a long file is
read by many tasks: each reads the header and the bytes that the segments of its own range look at. Files are read through
Arrow's file systems (local and shared folders, hdfs, s3, gs, abfs); folders that only Spark can open are for `recordings.scan`.
"""

from __future__ import annotations

import fnmatch
import math
import pickle
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from pulsegrid.constants import ALLOWED_CONTENT_TYPES, HIGHPASS_ALPHA, HOP_SIZE, SAMPLE_RATE
from pulsegrid.functions.polyphase import Polyphase
from pulsegrid.session import stage_root
from pulsegrid.sources import recordings as R

RANGE_BYTES = 64 << 20
# Short files that go to one task, at most, and those that it is told of directly instead of by a listing.
TASK_FILES = 1 << 15
FEW_FILES = 1 << 8
# Samples before a range after which the high-pass has forgotten where it began (to 1e-18).
WARM = math.ceil(math.log(1e-18) / math.log(HIGHPASS_ALPHA))


@dataclass(frozen=True)
class Range:
    """Bytes `lo` to `hi` of a file; segments belong to the range that their first own sample starts in."""

    path: str
    length: int
    lo: int
    hi: int


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a long file, or several whole short ones."""

    ranges: tuple[Range, ...]

    def __init__(self, ranges: tuple[Range, ...]):
        super().__init__(0)
        self.ranges = ranges


@dataclass
class ListedRanges(InputPartition):
    """As `Ranges`, of many whole short files: `size` bytes at `begin` of a listing in the shared folder name them."""

    listing: str
    begin: int
    size: int

    def __init__(self, listing: str, begin: int, size: int):
        super().__init__(0)
        self.listing, self.begin, self.size = listing, begin, size

    @property
    def ranges(self) -> tuple[Range, ...]:
        system, place = opened(self.listing)
        with system.open_input_file(place) as file:
            block = file.read_at(self.size, self.begin)
        return tuple(Range(path, length, 0, length + 1) for path, length in pickle.loads(zlib.decompress(block)))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; `file:/x` as Spark writes it, a URI, or a local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(folder: str, pattern: str | None = None) -> Iterator[tuple[str, int]]:
    """(path, length) of the files under `folder`, in order; names that start with `_` or `.` are left out, as Spark does.

    Folders are read one by one, so what is held at once are the names of the fullest one.
    """
    system, base = opened(folder)
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else folder[: len(folder) - len(base)] if folder.endswith(base) else ""

    def walk(place: str) -> Iterator[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(place, allow_not_found=place != base))
        found = [f for f in found if not f.base_name.startswith(("_", "."))]
        found.sort(key=lambda f: f.path + "/" * (f.type == fs.FileType.Directory), reverse=True)
        while found:
            f = found.pop()
            if f.type == fs.FileType.Directory:
                yield from walk(f.path)
            else:
                yield f

    info = system.get_file_info(base)
    for f in [info] if info.type == fs.FileType.File else walk(base):
        if f.type == fs.FileType.File and (pattern is None or fnmatch.fnmatch(f.base_name, pattern)):
            yield prefix + f.path, f.size


def packed_ranges(files: Iterable[tuple[str, int]], size: int) -> Iterator[Ranges]:
    """Long files cut at multiples of `size`, short ones together up to that size and `TASK_FILES`."""
    waiting, held = [], 0
    for path, length in files:
        cuts = list(range(0, max(length, 1), size))
        pieces = [Range(path, length, a, b) for a, b in zip(cuts, [*cuts[1:], length + 1])]
        if len(pieces) > 1:
            yield from (Ranges((p,)) for p in pieces)
            continue
        if waiting and (held + length > size or len(waiting) >= TASK_FILES):
            yield Ranges(tuple(waiting))
            waiting, held = [], 0
        waiting += pieces
        held += length
    if waiting:
        yield Ranges(tuple(waiting))


def spooled(parts: Iterable[Ranges], folder: str) -> Iterator[Ranges | ListedRanges]:
    """`parts`, where the files of a task that are more than a few are named in a listing in the shared `folder`."""
    system, base = opened(folder)
    name = f"listing-{uuid.uuid4().hex}"
    out, begin = None, 0
    try:
        for part in parts:
            if len(part.ranges) <= FEW_FILES:
                yield part
                continue
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base.rstrip('/')}/{name}")
            block = zlib.compress(pickle.dumps([(r.path, r.length) for r in part.ranges]), 1)
            out.write(block)
            yield ListedRanges(f"{folder.rstrip('/')}/{name}", begin, len(block))
            begin += len(block)
    finally:
        if out is not None:
            out.close()


@dataclass(frozen=True)
class Options:
    highpass: bool = False
    resample: bool = True
    raw_rate: int = SAMPLE_RATE
    frames: int = R.SEGMENT_FRAMES


def samples_between(sound: R.Sound, first: int, stop: int, highpass: bool) -> np.ndarray:
    """Samples `first` to `stop` at the common rate, from the stored samples around them."""
    begin = max(0, first - WARM) if highpass else first
    if sound.rate == SAMPLE_RATE:
        x = sound.samples(begin, stop)
    else:
        bank = Polyphase(sound.rate, SAMPLE_RATE)
        a, b = bank.inputs(begin, stop)
        a, b = max(0, a), min(sound.n_samples, b)
        x = bank.outputs(sound.samples(a, b), a, begin, stop)
    return (R.highpass_block(x) if highpass else x)[first - begin :]


def segments_of(part: Range, options: Options) -> Iterator[tuple]:
    """Rows of the segments that start in a range; a failure is reported by the range at the file's beginning."""
    try:
        system, place = opened(part.path)
        file = system.open_input_file(place)
        raw = R.CONTENT_TYPES.get(_extension(part.path)) == R.RAW_TYPE
        sound = R.read_header(R.FileView(file, 0, part.length), raw, options.raw_rate)
        if sound.rate != SAMPLE_RATE and not options.resample:
            raise ValueError(f"Expected {SAMPLE_RATE} Hz, got {sound.rate}")
        n = sound.n_samples if sound.rate == SAMPLE_RATE else sound.n_samples * SAMPLE_RATE // sound.rate
        step = sound.width * sound.channels

        def byte(seg: int) -> int:
            return sound.begins + seg * options.frames * HOP_SIZE * sound.rate // SAMPLE_RATE * step

        segments = range(R.segment_count(n, options.frames))
        for seg in segments[bisect_left(segments, part.lo, key=byte) : bisect_left(segments, part.hi, key=byte)]:
            lead, first, stop = R.segment_span(seg, n, options.frames)
            x = samples_between(sound, first, stop, options.highpass).astype(np.float32)
            yield part.path, seg, lead, x, n, sound.rate, sound.channels, None
    except Exception as failure:  # a bad file must not stop the job
        if part.lo == 0:
            yield R.failure_row(part.path, failure)


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1].lower()}" if "." in name.lstrip(".") else ".wav"


def _switch(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() == "true"


class RecordingRanges(DataSource):
    """Options: `path`, `pathGlobFilter` (file names), `rangeBytes`, `maxBytes` (longer files are left out), `rawRate`, `highpass`,
    `resample`, `frames` (of a segment), `listings` (a folder that driver and executors share: the names of many short files
    are written there instead of being held by the driver). Files of other content types than WAV and raw PCM are left out.

    With `pushFilters` filters on `recording_id` choose files before any is read; the session must then have
    `spark.sql.python.filterPushdown.enabled` set, as `session.build_session` does. `scan_segments` gives the option where it may.
    """

    @classmethod
    def name(cls) -> str:
        return "recording_ranges"

    def schema(self) -> str:
        return R.SEGMENT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        wanted = _switch({k.lower(): v for k, v in options.items()}.get("pushfilters"), False)
        return FilteringReader(options) if wanted else RangeReader(options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if "path" not in given:
            raise ValueError("recording_ranges needs a path")
        self.folder, self.pattern = given["path"], given.get("pathglobfilter")
        self.size = int(given.get("rangebytes", RANGE_BYTES))
        self.most = int(given["maxbytes"]) if "maxbytes" in given else None
        self.listings = given.get("listings")
        self.options = Options(
            _switch(given.get("highpass"), False),
            _switch(given.get("resample"), True),
            int(given.get("rawrate", SAMPLE_RATE)),
            int(given.get("frames", R.SEGMENT_FRAMES)),
        )
        self.conditions: list[Filter] = []

    def _chosen(self, path: str) -> bool:
        tests = {
            EqualTo: lambda f: path == f.value,
            In: lambda f: path in f.value,
            StringStartsWith: lambda f: path.startswith(f.value),
            StringEndsWith: lambda f: path.endswith(f.value),
            StringContains: lambda f: f.value in path,
        }
        return all(tests[type(f)](f) for f in self.conditions)

    def partitions(self) -> list[Ranges | ListedRanges]:
        allowed = {*ALLOWED_CONTENT_TYPES, R.RAW_TYPE}
        files = (
            (path, length)
            for path, length in listed(self.folder, self.pattern)
            if R.CONTENT_TYPES.get(_extension(path)) in allowed and self._chosen(path) and (self.most is None or length <= self.most)
        )
        parts = packed_ranges(files, self.size)
        return [*(parts if self.listings is None else spooled(parts, self.listings))] or [Ranges(())]

    def read(self, partition: Ranges | ListedRanges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            for row in segments_of(part, self.options):
                yield R.segment_batch([row])


class FilteringReader(RangeReader):
    """Takes filters on the recording over; a session in which they are not pushed down refuses such a reader."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("recording_id",):
                self.conditions.append(f)
            else:
                yield f


def _listings(spark: SparkSession) -> str | None:
    """Where listings go; None, so that partitions name their files, where no folder is shared or Arrow cannot open it."""
    context = spark.sparkContext
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{stage_root(spark).rstrip('/')}/pulsegrid")
        folder = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
        opened(folder)
    except (ValueError, OSError, NotImplementedError, Py4JJavaError):
        return None
    return folder if folder.startswith("file:") or "://" in folder else None


def scan_segments(spark: SparkSession, path: str, **options) -> DataFrame:
    """The segments of all recordings under `path`, read by byte ranges; options as of the data source."""
    spark.dataSource.register(RecordingRanges)
    options.setdefault("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if "listings" not in options and (listings := _listings(spark)):
        options["listings"] = listings
    return spark.read.format("recording_ranges").options(**{k: str(v) for k, v in options.items()}).load(path)


def read_listed(files: DataFrame, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """The segments of listed `files` (path, length): ranges are rows, dealt evenly over tasks, so no list of files is gathered.

    `options` are the fields of `Options`.
    """
    chosen = Options(**options)
    starts = F.expr(f"sequence(0L, greatest(length - 1, 0L) div {range_bytes} * {range_bytes}, {range_bytes}L)")
    # A range ends with the file where no other follows.
    end = F.expr(f"if(lo + {range_bytes} >= length, length + 1, lo + {range_bytes})")
    rows = files.select("path", "length", F.explode(starts).alias("lo")).withColumn("hi", end)
    rows = rows.repartition("path", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                for row in segments_of(Range(**part), chosen):
                    yield R.segment_batch([row])

    return rows.mapInArrow(run, R.SEGMENT_SCHEMA)
