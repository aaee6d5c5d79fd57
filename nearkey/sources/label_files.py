"""The two binary label formats as a data source that is read in byte ranges and written by tasks.

``.out`` is a 32-bit V and, for each vertex 0 .. V - 1, n and n pairs (hub, dist). Where a vertex begins follows from all
before it, so planning makes one pass over the counts, without the pairs between them, and cuts the file at vertices. ``.labelForward``
is pairs (hub, dist): one of distance 0 opens its vertex, (-1, -1) ends. Its ranges are cut anywhere, and a task looks
back for the vertex that its first pairs belong to. A table of any size is so many tasks, each holding a range.
Paths are local ones or URIs of file systems that pyarrow knows; a folder is all its files of the format.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from nearkey.folders import delete, scratch, shared_path, tasks_for

RANGE_BYTES = 32 << 20
SCHEMA = "vertex int, hub int, dist int"
OUT, FORWARD = ".out", ".labelForward"
#: Bytes looked at a time.
BLOCK = 1 << 20
END = np.array([-1, -1], "<i4").tobytes()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files of the format at ``path`` with their sizes, by name."""
    store, at = _place(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    inside = store.get_file_info(fs.FileSelector(at))
    named = sorted((x.base_name, x.size) for x in inside if x.is_file and x.base_name.endswith(suffix))
    return [(posixpath.join(path, name), size) for name, size in named]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    vertex: int = 0

    def __init__(self, path: str, begin: int, end: int, vertex: int = 0):
        self.path, self.begin, self.end, self.vertex = path, begin, end, vertex


def _out_ranges(path: str, size: int, step: int) -> Iterator[Range]:
    store, at = _place(path)
    with store.open_input_file(at) as file:
        held, base = b"", 0

        def number(place: int) -> int:
            nonlocal held, base
            if not base <= place <= base + len(held) - 4:
                base = place
                held = file.read_at(BLOCK, place)
            return int.from_bytes(held[place - base : place - base + 4], "little", signed=True)

        if size < 4:
            return
        begin, place, first = 4, 4, 0
        for vertex in range(number(0)):
            if place + 4 > size:
                raise ValueError(f"{path} ends before vertex {vertex}")
            place += 4 + 8 * number(place)
            if place - begin >= step:
                yield Range(path, begin, place, first)
                begin, first = place, vertex + 1
        if place > size:
            raise ValueError(f"{path} ends inside a vertex")
        if place > begin:
            yield Range(path, begin, place, first)


def _forward_ranges(path: str, size: int, step: int) -> Iterator[Range]:
    store, at = _place(path)
    end = size // 8 * 8
    with store.open_input_file(at) as file:
        if end and file.read_at(8, end - 8) != END:
            for begin in range(0, end, BLOCK):  # something stands behind the end, or there is none
                pairs = np.frombuffer(file.read_at(min(BLOCK, end - begin), begin), "<i4").reshape(-1, 2)
                over = np.flatnonzero((pairs == -1).all(1))
                if len(over):
                    end = begin + 8 * int(over[0])
                    break
        elif end:
            end -= 8
    step = max(8, step // 8 * 8)
    for begin in range(0, end, step):
        yield Range(path, begin, min(end, begin + step))


def _batch(vertex: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(x), pa.int32()) for x in (vertex, pairs[:, 0], pairs[:, 1])]
    return pa.RecordBatch.from_arrays(columns, ["vertex", "hub", "dist"])


def _read_out(part: Range) -> pa.RecordBatch:
    store, at = _place(part.path)
    with store.open_input_file(at) as file:
        values = np.frombuffer(file.read_at(part.end - part.begin, part.begin), "<i4")
    heads, place = [], 0
    while place < len(values):
        heads.append(place)
        place += 1 + 2 * int(values[place])
    heads = np.array(heads, np.int64)
    counts = values[heads].astype(np.int64)
    vertex = np.repeat(np.arange(part.vertex, part.vertex + len(heads)), counts)
    return _batch(vertex, np.delete(values, heads).reshape(-1, 2))


def _read_forward(part: Range) -> pa.RecordBatch:
    store, at = _place(part.path)
    with store.open_input_file(at) as file:
        pairs = np.frombuffer(file.read_at(part.end - part.begin, part.begin), "<i4").reshape(-1, 2)
        before, back = -1, part.begin
        while len(pairs) and pairs[0, 1] != 0 and before < 0 and back > 0:
            begin = max(0, back - BLOCK)
            earlier = np.frombuffer(file.read_at(back - begin, begin), "<i4").reshape(-1, 2)
            opens = np.flatnonzero(earlier[:, 1] == 0)
            before, back = int(earlier[opens[-1], 0]) if len(opens) else -1, begin
    opens = pairs[:, 1] == 0
    owner = np.r_[before, pairs[opens, 0]][np.cumsum(opens)]
    if len(owner) and owner[0] < 0:
        raise ValueError(f"{part.path} has pairs before any vertex")
    return _batch(owner, pairs)


class LabelReader(DataSourceReader):
    def __init__(self, path: str, form: str, step: int):
        self.path, self.form, self.step = path, form, step

    def partitions(self) -> list[Range]:
        cut = _out_ranges if self.form == OUT else _forward_ranges
        return [x for path, size in _files(self.path, self.form) for x in cut(path, size, self.step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end > part.begin:
            yield (_read_out if self.form == OUT else _read_forward)(part)


@dataclass
class Written(WriterCommitMessage):
    name: str


class ForwardWriter(DataSourceArrowWriter):
    """Rows sorted by vertex to one ``.labelForward`` file a task; a task that is run again leaves what it began without its final name."""

    def __init__(self, path: str):
        self.path = path
        store, at = _place(path)
        store.create_dir(at, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = _place(self.path)
        name = f"part-{task.partitionId():06d}"
        draft = posixpath.join(at, f"{name}.{task.taskAttemptId()}.draft")
        with store.open_output_stream(draft) as file:
            last = None
            for batch in batches:
                vertex, hub, dist = (batch.column(c).to_numpy(zero_copy_only=False).astype("<i4") for c in ("vertex", "hub", "dist"))
                if not len(vertex):
                    continue
                # each vertex is opened by its own pair (vertex, 0), which its label to itself is not written as again
                begins = np.flatnonzero(np.r_[vertex[0] != last, vertex[1:] != vertex[:-1]])
                own = (hub == vertex) & (dist == 0)
                if ((dist == 0) & ~own).any():
                    raise ValueError("the format cannot hold a distance of 0 to another vertex")
                pairs = np.insert(np.stack([hub, dist], 1), begins, np.stack([vertex[begins], np.zeros(len(begins), "<i4")], 1), axis=0)
                opener = np.zeros(len(pairs), bool)
                opener[begins + np.arange(len(begins))] = True
                file.write(pairs[opener | ~np.insert(own, begins, False)].astype("<i4").tobytes())
                last = vertex[-1]
            file.write(END)
        return Written(f"{name}.{task.taskAttemptId()}.draft")

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _place(self.path)
        for m in filter(None, messages):
            store.move(posixpath.join(at, m.name), posixpath.join(at, m.name.split(".")[0] + FORWARD))

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _place(self.path)
        for m in filter(None, messages):
            store.delete_file(posixpath.join(at, m.name))


class LabelFiles(DataSource):
    """``format("label_files")``; options ``form`` (``.out`` or ``.labelForward``) and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LabelReader:
        return LabelReader(self.options["path"], self.options.get("form", OUT), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ForwardWriter:
        if self.options.get("form") != FORWARD:
            raise ValueError("only .labelForward can be written by several tasks; write_out writes the other")
        return ForwardWriter(self.options["path"])


def read(spark: SparkSession, path: str, form: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``labels(vertex, hub, dist)`` of a file or folder, a task a range."""
    spark.dataSource.register(LabelFiles)
    return spark.read.format("label_files").option("form", form).option("range_bytes", range_bytes).load(path)


def write_forward(labels: DataFrame, path: str) -> None:
    """``labels`` as ``.labelForward`` files; vertices get their pair of distance 0 whether they have that label or not."""
    labels.sparkSession.dataSource.register(LabelFiles)
    rows = labels.selectExpr("cast(vertex as int) as vertex", "cast(hub as int) as hub", "cast(dist as int) as dist")
    rows.repartitionByRange("vertex").sortWithinPartitions("vertex", "dist", "hub").write.format("label_files").option("form", FORWARD).mode("append").save(path)


def _segment(rows: Iterator[pa.RecordBatch], path: str) -> tuple[int, int] | None:
    """``rows(vertex, hub, dist)`` sorted by vertex as a piece of an ``.out`` file, from its first vertex to its last, which are returned."""
    store, at = _place(path)
    first = last = None
    held: list[np.ndarray] = []  # pairs of the last vertex, whose number stands before them
    with store.open_output_stream(at) as file:

        def close() -> None:
            pairs = np.concatenate(held)
            file.write(np.r_[len(pairs), pairs.ravel()].astype("<i4").tobytes())
            held.clear()

        for batch in rows:
            vertex, hub, dist = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vertex", "hub", "dist"))
            pairs = np.stack([hub, dist], 1)
            begins = np.flatnonzero(np.r_[True, vertex[1:] != vertex[:-1]]) if len(vertex) else []
            for begin, end in zip(begins, [*begins[1:], len(vertex)]):
                now = int(vertex[begin])
                if last is not None and now != last:
                    close()
                    file.write(bytes(4 * (now - last - 1)))  # vertices between have no pairs
                first, last = now if first is None else first, now
                held.append(pairs[begin:end])
        if held:
            close()
    return None if first is None else (first, last)


def _joined(segments: list[tuple[str, int, int]], vertices: int, path: str) -> None:
    """The ``.out`` file of ``segments`` in order, copied a block at a time."""
    store, at = _place(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    following = 0
    with store.open_output_stream(at) as file:
        file.write(np.array([vertices], "<i4").tobytes())
        for place, first, last in segments:
            file.write(bytes(4 * (first - following)))
            piece, name = _place(place)
            with piece.open_input_stream(name) as part:
                while block := part.read(BLOCK):
                    file.write(block)
            following = last + 1


def write_out(labels: DataFrame, path: str) -> None:
    """``labels`` as one ``.out`` file: vertices have no ids there but their order.

    Tasks sort and write ranges of vertices as pieces beside the file, and one task joins their bytes; no task holds more than a range.
    """
    spark = labels.sparkSession
    # as a scratch table, which tells how many rows there are
    with scratch() as put:
        rows = put(labels.selectExpr("cast(vertex as int) as vertex", "cast(hub as int) as hub", "cast(dist as int) as dist"), "out")
        pieces = shared_path(spark, "pieces")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            store, at = _place(pieces)
            store.create_dir(at, recursive=True)
            place = posixpath.join(pieces, f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}")
            ends = _segment(batches, place)
            if ends:
                yield pa.RecordBatch.from_pydict({"place": [place], "first": pa.array([ends[0]], pa.int32()), "last": pa.array([ends[1]], pa.int32())})

        dealt = rows.repartitionByRange(tasks_for(spark, rows.count()), "vertex").sortWithinPartitions("vertex", "dist", "hub")
        segments_of = put(dealt.mapInArrow(write, "place string, first int, last int"), "segments")

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segments = [(r["place"], r["first"], r["last"]) for batch in batches for r in batch.to_pylist() if r["place"]]
            vertices = segments[-1][2] + 1 if segments else 0
            _joined(segments, vertices, path)
            yield pa.RecordBatch.from_arrays([pa.array([vertices], pa.int32())], ["vertices"])

        # a row a piece, and one more, so that the file of an empty table is written too
        one = spark.range(1).selectExpr("cast(null as string) as place", "-1 as first", "-1 as last")
        segments_of.unionByName(one).repartition(1).sortWithinPartitions("first").mapInArrow(join, "vertices int").collect()
        delete(spark, pieces)
