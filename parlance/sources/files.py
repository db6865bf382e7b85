"""Audio and subtitle files as data sources: planned byte ranges to read, staged files to write.

``spark.read.format("wav").load(folder)`` gives rows of at most ``block`` samples.  A plan
is made from file sizes alone: files are cut into ranges of ``partition_bytes`` and
small ones share a partition; beyond ``max_partitions`` of these, as many as are needed go to one
task, range by range.  Each task reads the headers of its own files.  A row belongs
to the range in which its first sample lies, so rows are the same however files are cut.

``df.write.format("wav").mode("append").save(folder)`` writes a file for each row
(name, rate, samples); ``format("ass")`` writes a subtitle file for each run of rows with one
name (name, event), as ``name.ass.gz`` with the option ``compression=gzip``.  Tasks write to a staging folder beside the target; the commit
moves all of it and marks the folder, an abort or a failed task leaves nothing but what was
there.  A name that is taken, in the folder or twice in one write, fails the write.

An unreadable file is one row without rate and samples; a file without samples is one row
with none.  Folders are named by any address that pyarrow knows.
"""

from __future__ import annotations

import io
import struct
import uuid
import wave
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK, PARTITION_BYTES, MAX_PARTITIONS = 160_000, 1 << 26, 1000
#: Samples' bytes that a task puts together before it hands rows on.
BATCH_BYTES = 1 << 20
WAV_ROWS = "recording string, first long, rate int, channels int, samples array<short>"
# The head of a subtitle file.
ASS_HEAD = (
    "[Script Info]", "Title: {name}", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "WrapStyle: 0", "", "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
    "Style: Default,Noto Sans CJK TC,80,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2,1,2,60,60,100,1", "",
    "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range:
    """Bytes ``low`` to ``high`` of a file."""

    path: str
    low: int
    high: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def planned(files: list[tuple[str, int]], most: int) -> list[list[Range]]:
    """Ranges of at most ``most`` bytes, small ones put together in order."""
    out, size = [], most
    for path, length in sorted(files):
        for low in range(0, max(length, 1), most):
            high = min(low + most, length)
            if size + high - low > most:
                out.append([])
                size = 0
            out[-1].append(Range(path, low, high))
            size += high - low
    return out


def gathered(plan: list[list[Range]], most: int) -> list[list[Range]]:
    """The plan's ranges, in order, in at most ``most`` parts of about as many of its partitions."""
    n = min(len(plan), most)
    return [[r for p in plan[k * len(plan) // n : (k + 1) * len(plan) // n] for r in p] for k in range(n)]


def wav_head(file) -> tuple[int, int, int, int] | None:
    """Rate, channels, place of the first sample and number of frames of 16-bit PCM; None for anything else."""
    if (head := file.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, form = 12, None
    while len(head := file.read(8)) == 8:
        kind, size = head[:4], struct.unpack("<I", head[4:])[0]
        at += 8
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            form = (rate, channels) if code in (1, 0xFFFE) and bits == 16 and channels else None
        elif kind == b"data":
            return (*form, at, min(size, file.size() - at) // (2 * form[1])) if form else None
        at += size + size % 2
        file.seek(at)
    return None


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block, self.most = options["path"], int(options.get("block", BLOCK)), int(options.get("partition_bytes", PARTITION_BYTES))
        self.parts = int(options.get("max_partitions", MAX_PARTITIONS))

    def partitions(self) -> list[InputPartition]:
        where, folder = opened(self.path)
        found = where.get_file_info(fs.FileSelector(folder, recursive=True))
        plan = planned([(f.path, f.size) for f in found if f.is_file and f.extension.lower() == "wav"], self.most)
        return [Ranges(r) for r in gathered(plan, self.parts)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in WAV_ROWS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int16())]
        held, size = [], 0
        for row in self.rows(partition):
            held.append(row)
            size += 64 + (0 if row[4] is None else 2 * len(row[4]))
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)

    def rows(self, partition: Ranges) -> Iterator[tuple]:
        where, _ = opened(self.path)
        for part in partition.ranges:
            name = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with where.open_input_file(part.path) as file:
                head = wav_head(file)
                if head is None or not head[3]:
                    if part.low == 0:
                        yield name, 0, *(head[:2] if head else (None, None)), [] if head else None
                    continue
                rate, channels, at, n = head
                size = 2 * channels
                # the first block whose first byte is not before ``low``; the first range also has what lies before the samples
                step = self.block * size
                k = 0 if part.low <= at else -(-(part.low - at) // step)
                while k * self.block < n and at + k * step < part.high:
                    file.seek(at + k * step)
                    data = file.read(min(self.block, n - k * self.block) * size)
                    yield name, k * self.block, rate, channels, np.frombuffer(data, "<i2")
                    k += 1


class Staged(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class StagedWriter(DataSourceWriter):
    """Files under a staging folder, and their names, until all of a write's tasks are done."""

    suffix, compression = "", None

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.staging = options["path"].rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def contents(self, rows: Iterator) -> Iterator[tuple[str, Iterator[bytes]]]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> Staged:
        where, folder = opened(self.path)
        mine, files = f"{folder}/{self.staging}/{uuid.uuid4().hex}", []
        where.create_dir(mine, recursive=True)
        for name, pieces in self.contents(rows):
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file's name: {name!r}")
            files.append((f"{mine}/{len(files)}", f"{name}.{self.suffix}"))
            with where.open_output_stream(files[-1][0], compression=self.compression) as out:
                for piece in pieces:
                    out.write(piece)
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        where, folder = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        twice = {n for n, k in Counter(names).items() if k > 1}
        taken = set() if self.overwrite else {f.base_name for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True))} & set(names)
        if twice or taken:
            raise ValueError(f"names that are taken: {sorted(twice | taken)[:5]}")
        for staged, name in files:
            where.move(staged, f"{folder}/{name}")
        self._clear(where, folder)
        with where.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, where: fs.FileSystem, folder: str) -> None:
        if where.get_file_info(f"{folder}/{self.staging}").type != fs.FileType.NotFound:
            where.delete_dir(f"{folder}/{self.staging}")


class WavWriter(StagedWriter):
    suffix = "wav"

    def contents(self, rows: Iterator) -> Iterator[tuple[str, Iterator[bytes]]]:
        for row in rows:
            data = io.BytesIO()
            with wave.open(data, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(row["rate"])
                w.writeframes(np.asarray(row["samples"] if row["samples"] is not None else [], "<i2").tobytes())
            yield row["name"], iter([data.getvalue()])


class SubtitleWriter(StagedWriter):
    suffix = "ass"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        if (kind := options.get("compression", "none")) not in ("none", "gzip"):
            raise ValueError(f"no compression of this name: {kind}")
        if kind == "gzip":
            self.suffix, self.compression = "ass.gz", "gzip"

    def contents(self, rows: Iterator) -> Iterator[tuple[str, Iterator[bytes]]]:
        """A file for each run of rows with one name; its lines go out as they come."""
        rows = iter(rows)
        row = next(rows, None)

        def lines() -> Iterator[bytes]:
            nonlocal row
            name = row["name"]
            yield ("\n".join(ASS_HEAD).replace("{name}", name) + "\n").encode()
            while row is not None and row["name"] == name:
                yield (row["event"] + "\n").encode()
                row = next(rows, None)

        while row is not None:
            yield row["name"], lines()


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return WAV_ROWS

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WavWriter(self.options, overwrite)


class SubtitleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ass"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SubtitleWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (WavFiles, SubtitleFiles):
        spark.dataSource.register(source)


def write_slices(audio: DataFrame, spans: DataFrame, keys: list[str], name: str, folder: str, rate: int = 16000) -> None:
    """Each span (start_s, end_s, and a file's name) of a recording's samples as a WAV file, exact to the sample."""
    from parlance.sources.transcripts import sample_range, sliced

    register(audio.sparkSession)
    cut = audio.join(spans, keys).withColumn("b", sample_range(F.col("start_s"), F.col("end_s"), rate))
    cut.select(F.col(name).alias("name"), F.lit(rate).alias("rate"), sliced(F.col("samples"), F.col("b")).cast("array<smallint>").alias("samples")).write.format("wav").mode("append").save(folder)


def write_subtitles(events: DataFrame, name: str, order: list[str], folder: str, compression: str = "none") -> None:
    """A subtitle file for each name, its events in order."""
    write_dealt_subtitles(events.repartition(name).sortWithinPartitions(name, *order), name, folder, compression)


def write_dealt_subtitles(events: DataFrame, name: str, folder: str, compression: str = "none") -> None:
    """The same for events of which a name's are in one partition already, one after another and in order."""
    register(events.sparkSession)
    events.select(F.col(name).alias("name"), "event").write.format("ass").option("compression", compression).mode("append").save(folder)
