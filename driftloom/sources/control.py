"""Control frames: files of JSON lines that grow, read in batch or as a stream.

    spark.dataSource.register(ControlFrames)
    spark.read.format("control_frames").load(folder)
    spark.readStream.format("control_frames").load(folder)

A file is one connection, and its frames hold in their order. A line that its writer has not ended yet is
left for later, by either reader. What is no frame of the protocol comes out as a row with an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FRAME = "file string, pos long, kind string, token string, on boolean, config string, error string, line string"
PROTOCOL = 1
#: The fields of each kind of frame besides its type and protocol (fixed values of the protocol).
FIELDS = {
    "register": {"port": int, "mcp_port": int, "version": str, "pid": int},
    "mint": {"token": str, "config": dict},
    "evict": {"token": str},
    "shadow": {"on": bool},
    "kill": {"on": bool},
    "gc": {},
    "shutdown": {},
}
#: How much is looked at for the end of a file's last whole line at a time.
BACK = 1 << 16


def typed(value, kind: type) -> bool:
    """Of its kind and not empty: numbers count from 1, texts have a character."""
    if kind is bool:
        return isinstance(value, bool)
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool) and value >= 1
    return isinstance(value, kind) and (kind is dict or value != "")


def parsed(line: bytes) -> tuple:
    """(kind, token, on, config, error) of a line."""
    none = (None, None, None, None)
    try:
        frame = json.loads(line)
    except ValueError:
        return *none, "no json"
    if not isinstance(frame, dict):
        return *none, "no object"
    kind = frame.get("type")
    if kind not in FIELDS if isinstance(kind, str) else True:
        return *none, "unknown type"
    if frame.get("protocol") != PROTOCOL or isinstance(frame["protocol"], (bool, float)):
        return *none, "other protocol"
    fields = FIELDS[kind]
    if set(frame) - {"type", "protocol"} != set(fields):
        return *none, "other fields"
    if not all(typed(frame[k], t) for k, t in fields.items()):
        return *none, "bad value"
    config = frame.get("config")
    return kind, frame.get("token"), frame.get("on"), None if config is None else json.dumps(config, sort_keys=True, ensure_ascii=False), None


class Span(InputPartition):
    """Bytes of a file that hold whole lines."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def opened(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_lines(path: str) -> dict[str, int]:
    """For each file of a folder and its folders, or a file alone, how many bytes of ended lines it has. Names that begin
    with a dot or an underscore are passed over."""
    from pyarrow import fs

    system, at = opened(path)
    found = system.get_file_info([at])[0]
    if found.type == fs.FileType.NotFound:
        return {}
    inside = lambda p: p[len(at) :].strip("/").split("/")
    files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not any(x[0] in "._" for x in inside(f.path))]
    out = {}
    for info in files:
        end = info.size
        with system.open_input_file(info.path) as f:
            while end > 0:
                start = max(0, end - BACK)
                last = f.read_at(end - start, start).rfind(b"\n")
                if last >= 0:
                    end = start + last + 1
                    break
                end = start
        out[info.path] = end
    return out


def frames_of(path: str, span: Span | None) -> Iterator[tuple]:
    """The frames of a span, read through a buffer, whatever its length. Spark reads no span where there is no file."""
    if span is None:
        return
    system, at = opened(path)
    name, pos = span.file[len(at) :].strip("/") or span.file.rsplit("/", 1)[-1], span.start
    with system.open_input_file(span.file) as f:
        rest, at = b"", span.start
        while at < span.end:
            block = f.read_at(min(1 << 20, span.end - at), at)
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if line.strip():
                    yield name, pos, *parsed(line), line.decode("utf-8", "replace")
                pos += len(line) + 1


class Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Span(f, 0, end) for f, end in sorted(whole_lines(self.path).items())]

    def read(self, partition):
        return frames_of(self.path, partition)


class Stream(DataSourceStreamReader):
    """An offset is how many bytes of each file have been read: spans between two offsets never change, so a
    micro-batch that is run again gives the same."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return whole_lines(self.path)

    def partitions(self, start, end):
        return [Span(f, start.get(f, 0), n) for f, n in sorted(end.items()) if n > start.get(f, 0)]

    def read(self, partition):
        return frames_of(self.path, partition)


class ControlFrames(DataSource):
    @classmethod
    def name(cls):
        return "control_frames"

    def schema(self):
        return FRAME

    def reader(self, schema):
        return Batch(self.options["path"])

    def streamReader(self, schema):
        return Stream(self.options["path"])


def in_force(frames: DataFrame) -> DataFrame:
    """The frames that took effect: a connection ends with its first bad frame, and after a shutdown."""
    ends = frames.where("error is not null or kind = 'shutdown'").groupBy(F.col("file").alias("_file")).agg(F.min("pos").alias("_end"))
    held = frames.join(ends, F.col("file") == F.col("_file"), "left").where("error is null and (_end is null or pos <= _end)")
    return held.drop("_file", "_end")
