"""Raw and Y4M video files as rows of frames, and frames as files.

Spark lists the files and deals out frame places (path, frame, offset, size);
tasks then read just those bytes, so a long file is read by many tasks. A file
is written in parts by many tasks; one task then joins its parts chunk by chunk.
"""

from __future__ import annotations

import hashlib
import posixpath

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import dealt

MAGIC, MARKER, LONGEST_LINE = b"YUV4MPEG2", b"FRAME", 4096
#: Frame places of one task's read.
FRAMES_A_TASK = 64
#: Frames of a part that one task writes, and bytes of a part that are held at once when it is joined to its file.
FRAMES_A_PART, CHUNK = 256, 1 << 22
FRAME = "path string, frame long, data binary"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files, without their contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def frame_bytes(sampling: Column, depth: Column, width: Column, height: Column) -> Column:
    """Bytes of a frame: 400, 420, 422, 444 planes or packed rgb; two bytes a sample above 8 bits; null for other samplings."""
    luma, half = width * height, F.floor((width + 1) / 2)
    samples = F.when(sampling == "400", luma).when(sampling == "420", luma + 2 * half * F.floor((height + 1) / 2)).when(sampling == "422", luma + 2 * half * height).when(sampling.isin("444", "rgb"), 3 * luma)
    return (samples * F.when(depth > 8, 2).otherwise(1)).cast("long")


def _assembled(names: tuple[str, ...], rows: int, cols: int, sampling: str, depth: int):
    def work(table: pa.Table) -> pa.Table:
        frame, row, col = (table.column(c).to_numpy() for c in ("frame", "row", "col"))
        data = []
        for k, name in enumerate(names):
            px = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            grid = np.full((rows, cols, 8, 8), -1, np.int64)
            grid[row, col] = px.reshape(-1, 8, 8)
            if (grid < 0).any() or grid.max() >= 1 << depth:
                raise ValueError(f"frame {frame[0]} lacks a block or has a sample beyond {depth} bits")
            plane = grid.transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            if k and sampling in ("420", "422"):
                plane = plane[:: 2 if sampling == "420" else 1, ::2]
            data.append(plane.astype("<u2" if depth > 8 else "u1").tobytes())
        return pa.Table.from_arrays([pa.array(frame[:1]), pa.array([b"".join(data)], pa.binary())], names=["frame", "data"])

    return work


def frames_of_blocks(blocks: DataFrame, rows: int, cols: int, sampling: str = "444", depth: int = 8, planes: tuple[str, ...] = ("px", "cb", "cr")) -> DataFrame:
    """(frame, data): planar frames put together of 8x8 blocks (frame, row, col, a column a plane, all of full size).

    Of subsampled chroma the even places are kept. A frame that lacks a block raises. A task holds one frame.
    """
    d = blocks.select(*(F.col(c).cast("long").alias(c) for c in ("frame", "row", "col")), *(F.col(c).cast("array<int>").alias(c) for c in planes))
    return d.groupBy("frame").applyInArrow(_assembled(planes, rows, cols, sampling, depth), "frame long, data binary")


def clip(places: DataFrame, first: int) -> DataFrame:
    """The places of the first frames of each file; a file that has fewer raises."""
    short = places.groupBy("path").agg(F.count("*").alias("n"))
    d = places.where(F.col("frame") < first).join(short, "path")
    why = F.concat(F.lit(f"has fewer than {first} frames: "), F.col("path"))
    return d.withColumn("offset", F.when(F.col("n") >= first, F.col("offset")).otherwise(F.raise_error(why).cast("long"))).drop("n")


def raw_places(listed: DataFrame, size: Column, frames: int = 0) -> DataFrame:
    """Places of the frames of headerless files: all of them, or the first `frames`.

    With no number given a file that ends within a frame raises; with one, only whole frames are taken.
    """
    d = listed.withColumn("size", size).withColumn("n", F.floor(F.col("length") / F.col("size")).cast("long"))
    if frames:
        d = d.withColumn("n", F.least("n", F.lit(frames)))
    else:
        cut = F.concat(F.lit("ends within a frame: "), F.col("path"))
        d = d.withColumn("n", F.when(F.col("length") % F.col("size") == 0, F.col("n")).otherwise(F.raise_error(cut).cast("long")))
    d = d.where("n > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return d.select("path", "frame", (F.col("frame") * F.col("size")).alias("offset"), "size")


def chroma_tag(tag: Column) -> Column:
    """struct(sampling, depth) of a Y4M chroma tag; a missing one is 420, an unknown one null."""
    tag = F.coalesce(tag, F.lit("420"))
    deep = F.regexp_extract(tag, "^(420|422|444)p([0-9]+)$", 2)
    plain = F.when(tag.isin("420", "420jpeg", "420mpeg2", "420paldv"), "420").when(tag.isin("422", "444"), tag).when(tag == "mono", "400")
    sampling = F.coalesce(plain, F.when(deep.try_cast("int").between(9, 16), F.substring(tag, 1, 3)))
    return F.when(sampling.isNotNull(), F.struct(sampling.alias("sampling"), F.coalesce(deep.try_cast("int"), F.lit(8)).alias("depth")))


def _headers(batches):
    for batch in batches:
        rows = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            fs, name = place(path)
            with fs.open_input_file(name) as f:
                line, end, _ = f.read(LONGEST_LINE).partition(b"\n")
            words = line.split(b" ")
            if not end or words[0] != MAGIC:
                raise ValueError(f"no Y4M header: {path}")
            tags = {w[:1].decode(): w[1:].decode() for w in words[1:] if w}
            rows.append({"path": path, "length": length, "begin": len(line) + 1, "width": int(tags["W"]), "height": int(tags["H"]), "fps": tags.get("F"), "tag": tags.get("C")})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("length", pa.int64()), ("begin", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("fps", pa.string()), ("tag", pa.string())]))


def y4m_headers(listed: DataFrame) -> DataFrame:
    """One row a file: path, length, begin (of its frames), width, height, fps, tag, sampling, depth and size of a frame."""
    d = listed.mapInArrow(_headers, "path string, length long, begin long, width long, height long, fps string, tag string")
    d = d.withColumn("c", chroma_tag(F.col("tag"))).select("*", "c.sampling", "c.depth").drop("c")
    return d.withColumn("size", frame_bytes(F.col("sampling"), F.col("depth"), F.col("width"), F.col("height")))


def check_headers(headers: DataFrame, planned: DataFrame) -> DataFrame:
    """The headers, compared with the planned (path, width, height, sampling, depth); a file that differs raises."""
    want = planned.select("path", F.struct("width", "height", "sampling", "depth").alias("want"))
    got = F.struct(*(F.col(c).cast(t) for c, t in (("width", "long"), ("height", "long"), ("sampling", "string"), ("depth", "int"))))
    want_cast = F.struct(*(F.col(f"want.{c}").cast(t) for c, t in (("width", "long"), ("height", "long"), ("sampling", "string"), ("depth", "int"))))
    d = headers.join(want, "path", "left").withColumn("begin", F.when(got.eqNullSafe(want_cast), F.col("begin")).otherwise(F.raise_error(F.concat(F.lit("header differs from plan: "), F.col("path"))).cast("long")))
    return d.drop("want")


def _marks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            if row["size"] is None:
                raise ValueError(f"unknown chroma tag: {row['path']}")
            fs, name = place(row["path"])
            at, offsets = row["begin"], []
            with fs.open_input_file(name) as f:
                while at < row["length"]:
                    f.seek(at)
                    line, end, _ = f.read(min(LONGEST_LINE, row["length"] - at)).partition(b"\n")
                    if not end or not line.startswith(MARKER) or line[len(MARKER) :][:1] not in (b"", b" "):
                        raise ValueError(f"no frame marker at {at}: {row['path']}")
                    at += len(line) + 1
                    if at + row["size"] > row["length"]:
                        raise ValueError(f"ends within a frame: {row['path']}")
                    offsets.append(at)
                    at += row["size"]
            n = len(offsets)
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(offsets, pa.int64()), pa.array([row["size"]] * n, pa.int64())], names=["path", "frame", "offset", "size"])


def y4m_places(headers: DataFrame) -> DataFrame:
    """Places of the frames of Y4M files. Marker lines differ in length, so one task steps over a file's markers."""
    return headers.select("path", "length", "begin", "size").mapInArrow(_marks, "path string, frame long, offset long, size long")


def _read(batches):
    for batch in batches:
        held, source, last = None, None, None
        try:
            for path, frame, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "size")), strict=True):
                if path != last:
                    if held:
                        held.close()
                    source, name = place(path)
                    held, last = source.open_input_file(name), path
                held.seek(offset)
                data = held.read(size)
                if len(data) != size:
                    raise ValueError(f"frame {frame} is cut short: {path}")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([frame], pa.int64()), pa.array([data], pa.binary())], names=["path", "frame", "data"])
        finally:
            if held:
                held.close()


def read_frames(places: DataFrame, first: int = 0) -> DataFrame:
    """(path, frame, data) at the places, or at the `first` frames of each file; runs of frames are dealt over all tasks."""
    d = places.where(F.col("frame") < first) if first else places
    d = d.withColumn("run", F.floor(F.col("frame") / FRAMES_A_TASK))
    d = dealt(d, "path", "run").sortWithinPartitions("path", "frame")
    return d.drop("run").mapInArrow(_read, FRAME)


def _samples(depth: int):
    def run(batches):
        for batch in batches:
            for path, frame, data in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "data")), strict=True):
                px = np.frombuffer(data, "<u2" if depth > 8 else "u1").astype(np.int32)
                if len(px) and int(px.max()) >= 1 << depth:
                    raise ValueError(f"a sample of frame {frame} has more than {depth} bits: {path}")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([frame], pa.int64()), pa.array([px], pa.list_(pa.int32()))], names=["path", "frame", "px"])

    return run


def planes(frames: DataFrame, sampling: str, depth: int, width: int, height: int) -> DataFrame:
    """(path, frame, plane, width, height, px): the planes of planar frames, in raster order; a bit above `depth` raises."""
    half_w, half_h = (width + 1) // 2, (height + 1) // 2
    chroma = {"400": (0, 0), "420": (half_w, half_h), "422": (half_w, height), "444": (width, height)}[sampling]
    sides = [(width, height)] + [chroma] * (2 if sampling != "400" else 0)
    starts = np.concatenate([[0], np.cumsum([w * h for w, h in sides])]).tolist()
    cut = F.array(*(F.struct(F.lit(k).alias("plane"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.slice("px", starts[k] + 1, w * h).alias("px")) for k, (w, h) in enumerate(sides)))
    d = frames.mapInArrow(_samples(depth), "path string, frame long, px array<int>")
    return d.select("path", "frame", F.explode(cut).alias("p")).select("path", "frame", "p.*")


def _plane_totals(batches):
    for batch in batches:
        rows = []
        for px in batch.column("px"):
            v = px.values.to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append((len(v), int(v.sum()), int(v @ np.arange(1, len(v) + 1))))
        n, total, weighted = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)) if rows else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "frame", "plane")), n, total, weighted], names=["path", "frame", "plane", "n", "total", "weighted"])


def plane_totals(found: DataFrame) -> DataFrame:
    """path, frame, plane, n, total, weighted of planes: how many samples, their sum, and their sum by place from 1."""
    return found.select("path", "frame", "plane", "px").mapInArrow(_plane_totals, "path string, frame long, plane int, n long, total long, weighted long")


def _temporary(to: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a file, and a new name beside it that readers of its folder pass over."""
    fs, name = place(to)
    folder = f"{posixpath.dirname(name)}/_parts"
    fs.create_dir(folder, recursive=True)
    return fs, f"{folder}/{posixpath.basename(name)}.{np.random.default_rng().integers(1 << 62):x}"


def _parts(batches):
    key, out, file, sizes = None, None, None, []

    def ended():
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([file]), pa.array([sizes], pa.list_(pa.int64()))], names=["path", "part", "file", "sizes"])

    for batch in batches:
        for path, part, data in zip(*(batch.column(c).to_pylist() for c in ("path", "part")), batch.column("data"), strict=True):
            if (path, part) != key:
                if out:
                    yield ended()
                fs, file = _temporary(path)
                key, out, sizes = (path, part), fs.open_output_stream(file), []
            data = data.as_buffer()
            out.write(data)
            sizes.append(data.size)
    if out:
        yield ended()


def _join(header: bytes, marker: bytes):
    def run(batches):
        path, done, frames, digest = None, [], 0, None
        fs = out = name = None

        def ended():
            out.close()
            fs.move(name, place(path)[1])  # a name that readers see is a whole file
            for file in done:
                fs.delete_file(file)
            return pa.RecordBatch.from_pylist([{"path": path, "frames": frames, "sha256": digest.hexdigest()}])

        for batch in batches:
            for to, file, sizes in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "sizes")), strict=True):
                if to != path:
                    if out:
                        yield ended()
                    fs, name = _temporary(to)
                    path, done, frames, digest, out = to, [], 0, hashlib.sha256(), fs.open_output_stream(name)
                    out.write(header)
                with fs.open_input_stream(file) as source:
                    for size in sizes if marker else [sum(sizes)]:
                        out.write(marker)
                        while size:
                            data = source.read(min(size, CHUNK))
                            if not data:
                                raise ValueError(f"a part of {path} is cut short: {file}")
                            out.write(data)
                            digest.update(data)
                            size -= len(data)
                done.append(file)
                frames += len(sizes)
        if out:
            yield ended()

    return run


def write_frames(frames: DataFrame, header: bytes = b"", marker: bytes = b"", part: int = FRAMES_A_PART, tasks: int = 0) -> DataFrame:
    """Write (path, frame, data), the frames of a path in order; lazily, one row a file: path, frames, sha256 of the frames.

    Ranges of `part` frame numbers are sorted and written apart, in a folder _parts beside the file; the parts are then joined and
    deleted, and the file moved to its name when whole, so a task that runs again leaves no torn file. A join that runs again when its parts are gone raises.
    A task sorts the parts that are dealt to it: with about as many `tasks` as parts that is one or a few.
    """
    # dealt by number: an adaptive plan would join parts by their compressed bytes, and a task's sort grow as they shrink
    d = dealt(frames.withColumn("part", F.floor(F.col("frame") / part).cast("long")), "path", "part", tasks=tasks).sortWithinPartitions("path", "part", "frame")
    parts = d.select("path", "part", "data").mapInArrow(_parts, "path string, part long, file string, sizes array<long>")
    return parts.repartition("path").sortWithinPartitions("path", "part").select("path", "file", "sizes").mapInArrow(_join(header, marker), "path string, frames long, sha256 string")


def write_y4m(frames: DataFrame, width: int, height: int, fps: str, tag: str, tasks: int = 0) -> DataFrame:
    """write_frames as Y4M files, fps as num:den."""
    return write_frames(frames, b"%s W%d H%d F%s Ip C%s\n" % (MAGIC, width, height, fps.encode(), tag.encode()), MARKER + b"\n", tasks=tasks)
