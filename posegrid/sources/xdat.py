"""Raw electrophysiology recordings as a Spark data source: ``spark.read.format("xdat")``.

A recording is three files: ``NAME.xdat.json`` with its metadata, ``NAME_data.xdat`` with float32 values interleaved by sample,
and ``NAME_timestamp.xdat`` with an int64 time stamp for each sample. A partition is a range of samples, read as one range of
bytes of each file, so a recording of any length is many tasks and none holds more than a batch.

Options: ``path`` (a recording without its endings, or a folder of recordings, as a path or URI), ``time_start`` and ``time_end`` (seconds,
default: the whole recording), ``channels`` (numbers, comma-separated) and ``block`` (samples of a partition). With
``pushdown`` (for sessions with ``spark.sql.python.filterPushdown.enabled``) filters on channel and sample narrow
what is read as well.

A range outside the recording raises ``ValueError``, and files that hold different numbers of samples for it raise
``RuntimeError``, before any task starts; a last block that isn't full is read as far as it goes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

META, DATA, STAMPS = ".xdat.json", "_data.xdat", "_timestamp.xdat"
SCHEMA = "recording string, channel int, sample long, timestamp long, seconds double, v float"
#: Samples of a partition and of a batch.
BLOCK, BATCH = 1 << 20, 1 << 12


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


@dataclass
class Recording:
    """Metadata of a recording and the place of its samples in its files."""

    base: str
    rate: float
    total: int
    first_sample: int
    time_range: tuple[float, float]

    @property
    def name(self) -> str:
        return self.base.rstrip("/").rsplit("/", 1)[-1]

    @classmethod
    def open(cls, store, base: str) -> Recording:
        try:
            with store.open_input_stream(base + META) as file:
                status = json.loads(file.read())["status"]
        except (OSError, ValueError, KeyError) as error:
            raise ValueError(f"could not read the metadata of {base}") from error
        return cls(base, status["samp_freq"], status["signals"]["total"], status["timestamp_range"][0], tuple(status["t_range"]))

    def span(self, store, start: float | None, end: float | None) -> tuple[int, int]:
        """Rows [from, to) of the files for a range of seconds."""
        start, end = (self.time_range[i] if x is None else x for i, x in enumerate((start, end)))
        low, high = (round(x * self.rate) - self.first_sample for x in (start, end))
        stamped, sampled = (store.get_file_info(self.base + e).size or 0 for e in (STAMPS, DATA))
        if low < 0:
            raise ValueError(f"{self.name}: the start {start} lies before the recording's, {self.time_range[0]}")
        if high > stamped // 8:
            raise ValueError(f"{self.name}: the end {end} lies after the recording's, {self.time_range[1]}")
        if sampled // (4 * self.total) < high:
            raise RuntimeError(f"{self.name}: {sampled // (4 * self.total)} samples of signals, {stamped // 8} time stamps")
        return low, max(low, high)


def recordings(path: str) -> list[Recording]:
    """The recording at ``path``, or those in the folder ``path``."""
    from pyarrow.fs import FileSelector, FileType

    store, base = _store(path)
    if store.get_file_info(base).type == FileType.Directory:
        found = sorted(i.path for i in store.get_file_info(FileSelector(base)) if i.path.endswith(META))
        return [Recording.open(store, p[: -len(META)]) for p in found]
    return [Recording.open(store, base.removesuffix(META))]


@dataclass
class Samples(InputPartition):
    recording: Recording
    low: int
    high: int


class XdatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.end = (float(options[k]) if options.get(k) not in (None, "") else None for k in ("time_start", "time_end"))
        chosen = options.get("channels")
        self.channels = None if chosen in (None, "") else [int(c) for c in str(chosen).split(",")]
        self.block = int(options.get("block") or BLOCK)
        #: First and last sample that filters leave.
        self.least: int | None = None
        self.most: int | None = None

    def partitions(self) -> Sequence[InputPartition]:
        store, _ = _store(self.path)
        parts = []
        for one in recordings(self.path):
            bad = [c for c in self.channels or [] if not 0 <= c < one.total]
            if bad:
                raise ValueError(f"{one.name} has no channels {bad}")
            low, high = one.span(store, self.start, self.end)
            low = low if self.least is None else max(low, self.least - one.first_sample)
            high = high if self.most is None else min(high, self.most + 1 - one.first_sample)
            parts += [Samples(one, at, min(at + self.block, high)) for at in range(low, high, self.block)]
        return parts

    def read(self, partition: Samples | None) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if partition is None:  # an empty range has no partitions, and Spark asks once all the same
            return
        one = partition.recording
        store, _ = _store(self.path)
        wanted = np.arange(one.total) if self.channels is None else np.array(self.channels)
        with store.open_input_file(one.base + STAMPS) as stamps, store.open_input_file(one.base + DATA) as data:
            for low in range(partition.low, partition.high, BATCH):
                n = min(BATCH, partition.high - low)
                times = np.frombuffer(stamps.read_at(8 * n, 8 * low), "<i8")
                raw = data.read_at(4 * one.total * n, 4 * one.total * low)
                values = np.frombuffer(raw[: len(raw) // (4 * one.total) * 4 * one.total], "<f4").reshape(-1, one.total)
                if len(times) != n or len(values) != n:
                    raise RuntimeError(f"{one.name}: the files end inside samples {low} to {low + n}")
                m = len(wanted)
                samples = np.arange(one.first_sample + low, one.first_sample + low + n)
                columns = [
                    pa.array([one.name]).take(pa.array(np.zeros(n * m, np.int32))),
                    pa.array(np.tile(wanted, n).astype(np.int32)),
                    pa.array(np.repeat(samples, m)),
                    pa.array(np.repeat(times, m)),
                    pa.array(np.repeat(times / one.rate, m)),
                    pa.array(values[:, wanted].ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["recording", "channel", "sample", "timestamp", "seconds", "v"])


class PushedXdatReader(XdatReader):
    """Narrows by filters; Spark evaluates them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "channel" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.channels = sorted(asked if self.channels is None else asked & set(self.channels))
            if name == "sample" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.least = max(f.value, f.value if self.least is None else self.least)
            if name == "sample" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.most = min(f.value, f.value if self.most is None else self.most)
            yield f


class XdatDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xdat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedXdatReader if str(self.options.get("pushdown", "")).lower() == "true" else XdatReader)(dict(self.options))


def read_xdat(spark: SparkSession, path: str, time_start: float | None = None, time_end: float | None = None, channels: list[int] | None = None) -> DataFrame:
    """(recording, channel, sample, timestamp, seconds, v) of the recording or folder at ``path``."""
    spark.dataSource.register(XdatDataSource)
    asked = {"time_start": time_start, "time_end": time_end, "channels": None if channels is None else ",".join(map(str, channels))}
    reader = spark.read.format("xdat").options(**{k: str(v) for k, v in asked.items() if v is not None})
    return reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(path)


def write_xdat(df: DataFrame, folder: str, rate: float, n_channels: int) -> None:
    """Recordings (recording, sample, timestamp, v array of ``n_channels``) as files in ``folder``, a URI.

    A recording is a file by its format, so one task writes it, streaming its rows in order of samples.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        import numpy as np

        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
        for name, own in groupby(rows, key=lambda row: row[0]):
            first = last = None
            with store.open_output_stream(f"{path}/{name}{DATA}") as data, store.open_output_stream(f"{path}/{name}{STAMPS}") as stamps:
                for _, sample, stamp, values in own:
                    if len(values) != n_channels or (last is not None and sample != last + 1):
                        raise ValueError(f"{name}: sample {sample} does not follow {last} with {n_channels} values")
                    first, last = sample if first is None else first, sample
                    data.write(np.array(values, "<f4").tobytes())
                    stamps.write(np.array([stamp], "<i8").tobytes())
            status = {"samp_freq": rate, "timestamp_range": [first, last + 1], "t_range": [first / rate, (last + 1) / rate], "signals": {"total": n_channels}}
            with store.open_output_stream(f"{path}/{name}{META}") as meta:
                meta.write(json.dumps({"status": status}).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["recording"])

    rows = df.select(F.col("recording").cast("string"), F.col("sample").cast("long"), F.col("timestamp").cast("long"), F.col("v").cast("array<float>"))
    whole = rows.repartition("recording").sortWithinPartitions("recording", "sample")
    whole.mapInArrow(write, "recording string").write.format("noop").mode("overwrite").save()
