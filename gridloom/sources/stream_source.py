"""Byte streams of values as a Spark data source: ``spark.read.format("gridloom_stream")`` and ``df.write.format(...)``.

A row is a value: a column of 0-based places for each axis of the stream, fastest
first, and v. Options ``only.<axis>`` name the wanted places of an axis ("3",
"2,9,11", "4:7" with both ends): only stretches of the stream that hold wanted
places become partitions, and of those only wanted places become rows, so a volume,
a slab or a box of a stream reads little else. They are options and not conditions
that Spark pushes down because this version of Spark keeps a Python source's pushed
conditions with the loaded table: a second query of one loaded table would get the
first one's rows only. Streams are plain files, folders of parts, gzip in members (a
task each) or other gzip (one task). Writing puts every value at its place in one
file that takes the path's name once all are there; a task that runs twice writes
the same bytes.

Options: ``path`` (on all workers), ``type``, ``axes`` (names, "i,j,k"), ``dims``
("50,7,12"); ``endian``, ``offset``, ``slope``, ``intercept`` as in a
StorageDescriptor. Values of ``int`` types without scaling are read as long, others
as double; NaN is read as NULL. On writing every place must come once: the number
of rows and the sum of their places are checked, and places, missing values and
values that don't fit fail. No column may be named twice.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..image import wide_enough
from ..streaming.decode import MemberStream, chunks, is_seekable, members, open_stream, skip
from .codec import RUN, WIDER, StorageDescriptor, _preallocate, _segments
from .shared import mounted

NAME = "gridloom_stream"
#: Bytes decoded at once.
CHUNK = 4 << 20


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(ImageStream)


def widened(frame: DataFrame, options: dict[str, str]) -> dict[str, str]:
    """The options with the integer type, or the first wider one, that holds the column v of a frame with their scaling; one pass over it."""
    form = ImageStream(options).form
    if form.type not in WIDER:
        return options
    row = frame.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return options | {"type": wide_enough(form.type, row["lo"], row["hi"], form.slope or 1.0, form.intercept or 0.0, WIDER)}


class ImageStream(DataSource):
    """The source; one object for each read or write."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        get = lambda name, kind: kind(options[name]) if name in options else None
        missing = [x for x in ("path", "type", "axes", "dims") if x not in options]
        if missing:
            raise ValueError(f"{NAME} needs the options {', '.join(missing)}")
        self.path = mounted(options["path"])
        self.form = StorageDescriptor(options["type"], get("endian", str) or "little", get("offset", int) or 0, get("slope", float), get("intercept", float))
        if self.form.dtype.kind not in "iuf" or self.form.type in ("bit", "rgb24", "rgba32"):
            raise ValueError(f"{NAME} holds real numbers, not {self.form.type}")
        self.axes = [x.strip() for x in options["axes"].split(",")]
        self.dims = tuple(int(x) for x in options["dims"].split(","))
        if len(self.axes) != len(self.dims) or len({*map(str.lower, self.axes), "v"}) <= len(self.axes) or min(self.dims) < 0:
            raise ValueError("axes and dims must be as many, the names different and other than v")

        self.only = {k.lower().removeprefix("only."): x for k, x in options.items() if k.lower().startswith("only.")}
        if unknown := set(self.only) - {x.lower() for x in self.axes}:
            raise ValueError(f"no axis is named {', '.join(sorted(unknown))}")

    @classmethod
    def name(cls) -> str:
        return NAME

    def value_type(self) -> str:
        scaled = (self.form.slope or 1.0) != 1.0 or (self.form.intercept or 0.0) != 0.0
        return "double" if scaled or self.form.dtype.kind == "f" else "long"

    def schema(self) -> str:
        return ", ".join([*(f"`{x}` long" for x in self.axes), f"v {self.value_type()}"])

    def reader(self, schema) -> StreamReader:
        return StreamReader(self)

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self, schema, overwrite)


@dataclass
class Stretch(InputPartition):
    """Values ``first`` to ``end`` of the stream, which lie in ``file``: from byte ``at`` on, or ``ahead`` values into the gzip member there."""

    first: int
    end: int
    file: str
    at: int
    ahead: int = 0
    packed: str = ""


class Wanted:
    """The places of one axis that an option leaves: from ``low`` to ``high``, and of ``some`` where given."""

    def __init__(self, n: int, text: str | None = None):
        self.low, self.high, self.some = 0, n - 1, None
        self.all = text is None
        if text is None:
            return
        low, colon, high = text.partition(":")
        if colon:
            self.low, self.high = max(0, int(low or 0)), min(n - 1, int(high or n - 1))
        else:
            self.some = {int(x) for x in text.split(",") if x.strip()}

    def ranges(self) -> list[tuple[int, int]]:
        """Stretches (first, end) of wanted places in order."""
        if self.some is None:
            return [(self.low, self.high + 1)] if self.low <= self.high else []
        return [(x, x + 1) for x in sorted(self.some) if self.low <= x <= self.high]

    def holds(self, x: np.ndarray) -> np.ndarray:
        inside = (x >= self.low) & (x <= self.high)
        return inside if self.some is None else inside & np.isin(x, list(self.some))


class StreamReader(DataSourceReader):
    def __init__(self, source: ImageStream):
        self.source = source
        self.wanted = [Wanted(n, source.only.get(name.lower())) for name, n in zip(source.axes, source.dims, strict=True)]
        self.narrowed = not all(w.all for w in self.wanted)

    def stretches(self, axis: int, base: int) -> Iterator[tuple[int, int]]:
        """Stretches of the stream, RUN values long at most, that hold all wanted places of the axes up to ``axis``."""
        stride = prod(self.source.dims[:axis])
        for first, end in self.wanted[axis].ranges():
            if stride > RUN:
                for x in range(first, end):
                    yield from self.stretches(axis - 1, base + x * stride)
            else:
                step = max(1, RUN // max(1, stride))
                for x in range(first, end, step):
                    yield base + x * stride, base + min(x + step, end) * stride

    def merged(self) -> Iterator[tuple[int, int]]:
        held = None
        for first, end in self.stretches(len(self.source.dims) - 1, 0):
            if held and held[1] == first and end - held[0] <= RUN:
                held = held[0], end
            else:
                if held:
                    yield held
                held = first, end
        if held:
            yield held

    def partitions(self) -> list[Stretch]:
        path, form, total = self.source.path, self.source.form, prod(self.source.dims)
        if any(not w.ranges() for w in self.wanted):
            return [Stretch(0, 0, path, 0)]
        if not os.path.isdir(path) and not is_seekable(path):
            chain = members(path)
            if chain is None:  # read forward by one task, as far as anything is wanted
                spans = list(self.merged())
                return [Stretch(spans[0][0], spans[-1][1], path, form.offset, spans[0][0], "whole")]
            if -sum(a for a, _ in chain if a < 0) != form.offset:
                raise ValueError("the offset is not the one that the stream was written with")
            places = [(a, at) for a, at in chain if a >= 0]
            held = [(a, end - a, path, at) for (a, at), end in zip(places, [*(a for a, _ in places[1:]), total], strict=True)]
        else:
            held, chain = _segments(path, form, total), None
        out, k = [], 0
        for first, end in self.merged():
            while k and held[k][0] > first:
                k -= 1
            while held[k][0] + held[k][1] <= first:
                k += 1
            at = first
            while at < end:
                begins, n, file, byte = held[k]
                stop = min(end, begins + n)
                out.append(Stretch(at, stop, file, byte, at - begins, "member" if chain else ""))
                at, k = stop, min(k + 1, len(held) - 1)
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        source, form = self.source, self.source.form
        names, size = [*source.axes, "v"], form.dtype.itemsize
        if part.first == part.end:
            return
        with MemberStream(part.file, part.at) if part.packed == "member" else open_stream(part.file) as stream:
            skip(stream, part.ahead * size + (0 if part.packed == "member" else part.at))
            at = part.first
            for raw in chunks(stream, (part.end - part.first) * size, CHUNK, size):
                x = np.frombuffer(raw, form.dtype)
                p, places, keep = np.arange(at, at + len(x)), [], np.ones(len(x), bool)
                at += len(x)
                for n, wanted in zip(source.dims, self.wanted, strict=True):
                    places.append(p % n)
                    p = p // n
                    if self.narrowed:
                        keep &= wanted.holds(places[-1])
                if self.narrowed:
                    x, places = x[keep], [a[keep] for a in places]
                if source.value_type() == "long":
                    v = pa.array(x.astype(np.int64))
                else:
                    y = x.astype(float)
                    v = pa.array(y * (form.slope or 1.0) + (form.intercept or 0.0), mask=np.isnan(y))
                yield pa.RecordBatch.from_arrays([*map(pa.array, places), v], names)


@dataclass
class Done(WriterCommitMessage):
    count: int
    places: int


class StreamWriter(DataSourceArrowWriter):
    def __init__(self, source: ImageStream, schema, overwrite: bool):
        self.source, self.total = source, prod(source.dims)
        names = [f.name for f in schema.fields]
        if sorted(names) != sorted([*source.axes, "v"]):
            raise ValueError(f"the columns must be {', '.join([*source.axes, 'v'])}")
        if source.path.endswith((".gz", ".parts")):
            raise ValueError("write_image writes gzip and parts")
        if os.path.exists(source.path) and not overwrite:
            raise FileExistsError(source.path)
        self.names = names
        self.target = f"{source.path}.writing-{uuid.uuid4().hex}"
        _preallocate(self.target, source.form.offset + self.total * source.form.dtype.itemsize)

    def _encoded(self, v: pa.Array) -> np.ndarray:
        form = self.source.form
        code, slope, intercept = form.dtype, form.slope or 1.0, form.intercept or 0.0
        if code.kind in "iu":
            if v.null_count:
                raise ValueError("integers can't hold missing values")
            if pa.types.is_integer(v.type) and slope == 1 and intercept == 0:
                x = v.to_numpy()
            else:
                x = np.rint((v.cast(pa.float64()).to_numpy() - intercept) / slope)
            limits = np.iinfo(code)
            if len(x) and not (np.all(np.isfinite(x)) and x.min() >= limits.min and x.max() <= limits.max):
                raise ValueError(f"the values don't fit {form.type}")
            return x.astype(code)
        x = v.cast(pa.float64()).to_numpy(zero_copy_only=False)
        return ((x - intercept) / slope).astype(code)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        form, count, total = self.source.form, 0, 0
        size = form.dtype.itemsize
        out = os.open(self.target, os.O_RDWR)  # gone if the write was given up
        try:
            for batch in iterator:
                columns = dict(zip(self.names, batch.columns, strict=True))
                p, stride = np.zeros(batch.num_rows, np.int64), 1
                for name, n in zip(self.source.axes, self.source.dims, strict=True):
                    at = columns[name].cast(pa.int64())
                    if at.null_count or batch.num_rows and not (0 <= (a := at.to_numpy()).min() and a.max() < n):
                        raise ValueError(f"a place of axis {name} is missing or out of range")
                    p += at.to_numpy() * stride
                    stride *= n
                x = self._encoded(columns["v"])
                order = np.argsort(p, kind="stable")
                p, x = p[order], x[order]
                edges = [0, *(np.flatnonzero(np.diff(p) != 1) + 1).tolist(), len(p)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b > a:
                        os.pwrite(out, x[a:b].tobytes(), form.offset + int(p[a]) * size)
                count, total = count + len(p), total + sum(map(int, np.add.reduceat(p, range(0, len(p), 1 << 16))) if len(p) else ())
        finally:
            os.close(out)
        return Done(count, total)

    def commit(self, messages: list[Done | None]) -> None:
        done = [m for m in messages if m is not None]
        if sum(m.count for m in done) != self.total or sum(m.places for m in done) != self.total * (self.total - 1) // 2:
            self.abort(messages)
            raise ValueError("the image lacks cells, or has some twice")
        if os.path.isdir(self.source.path):
            shutil.rmtree(self.source.path)
        os.replace(self.target, self.source.path)

    def abort(self, messages: list[Done | None]) -> None:
        if os.path.exists(self.target):
            os.remove(self.target)
