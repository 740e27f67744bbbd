"""Corner tables as text, images, and point clouds."""

from __future__ import annotations

import fnmatch
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.observations import corner_weight


def read_corners(spark: SparkSession, path: str, weight: str | None = "level") -> DataFrame:
    """(filename, line, x, y, w) of a corner table ``filename x y [level or weight]``; ``-`` is null, ``#`` starts a comment.

    A file is read whole by one task, as its order of lines numbers the corners.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return parse_corners(files, weight)


def parse_corners(lines: DataFrame, weight: str | None = "level") -> DataFrame:
    """The same of (file, line, text)."""
    f = F.split(F.trim(F.regexp_replace("text", "#.*$", "")), r"\s+")
    number = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("-")).try_cast("double")
    rows = lines.filter(F.size(f) >= 3).select("file", F.get(f, F.lit(0)).alias("filename"), "line", number(1).alias("x"), number(2).alias("y"), F.get(f, F.lit(3)).alias("field"))
    w = F.when(F.col("field").isNull(), 1.0).otherwise(corner_weight(F.col("field"), weight)) if weight else F.lit(1.0)
    return rows.select("file", "filename", "line", "x", "y", F.when(F.col("x").isNull() | (F.col("x") < 0) | (F.col("y") < 0), -1.0).otherwise(w).alias("w"))


def assign_cameras(corners: DataFrame, globs: list[str]) -> DataFrame:
    """Adds ``cam``, the first glob that matches the file name; files that match none go."""
    cam = F.lit(None).cast("int")
    for i in reversed(range(len(globs))):
        pattern = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", fnmatch.translate(globs[i]))
        cam = F.when(F.col("filename").rlike(f"^(?s:{pattern})$") | F.regexp_extract("filename", "[^/]*$", 0).rlike(f"^(?s:{pattern})$"), i).otherwise(cam)
    return corners.withColumn("cam", cam).filter("cam is not null")


# -- images ------------------------------------------------------------------------------------
def decode_image(data: bytes) -> np.ndarray:
    """PGM, PPM (8 or 16 bits) or PNG (grey or RGB, 8 or 16 bits, not interlaced); colour comes as BGR."""
    if data[:2] in (b"P5", b"P6"):
        head, at = [], 2
        while len(head) < 3:
            m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
            head.append(int(m[1]))
            at = m.end()
        w, h, top = head
        kind = np.dtype(">u2") if top > 255 else np.dtype("u1")
        c = 3 if data[:2] == b"P6" else 1
        a = np.frombuffer(data, kind, w * h * c, at + 1).reshape((h, w, c) if c > 1 else (h, w)).astype(kind.newbyteorder("="))
        return a[..., ::-1] if c > 1 else a
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PGM, PPM or PNG image")
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, bits, color, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if color not in (0, 2) or bits not in (8, 16) or lace:
        raise ValueError("only plain grey and RGB PNG images are read")
    c, size = (3 if color == 2 else 1), bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * c * size)
    step = c * size
    out = np.zeros((h + 1, w + 1, step), np.int64)  # a row above and a pixel to the left of the image are 0
    lines = raw[:, 1:].reshape(h, w, step).astype(np.int64)
    for y in range(h):
        kind, line, up, row = raw[y, 0], lines[y], out[y], out[y + 1]
        if kind == 0:
            row[1:] = line
        elif kind == 2:
            row[1:] = (line + up[1:]) & 255
        elif kind == 1:  # each pixel adds the one to its left: a running sum
            row[1:] = np.cumsum(line, 0) & 255
        else:
            for x in range(w):
                left, above, corner = row[x], up[x + 1], up[x]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
                    guess = np.choose(far.argmin(0), [left, above, corner])  # ties go to the left, then above
                row[x + 1] = (line[x] + guess) & 255
    out = out[:, 1:].reshape(h + 1, -1)
    px = out[1:].astype(np.uint8).tobytes()
    a = np.frombuffer(px, ">u2" if bits == 16 else "u1").reshape((h, w, c) if c > 1 else (h, w)).astype("u2" if bits == 16 else "u1")
    return a[..., ::-1] if c > 1 else a


def encode_image(a: np.ndarray, end: str) -> bytes:
    """By file extension: png, pgm (grey) or ppm (colour, given as BGR)."""
    color = a.ndim == 3
    if color:
        a = a[..., ::-1]
    h, w = a.shape[:2]
    raw = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">")))
    if end in ("pgm", "ppm"):
        return b"P%d\n%d %d\n%d\n" % (6 if color else 5, w, h, 65535 if a.dtype.itemsize == 2 else 255) + raw.tobytes()
    if end != "png":
        raise ValueError(f"unknown image format {end}")
    rows = raw.view(np.uint8).reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * a.dtype.itemsize, 2 if color else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


IMAGE = "path string, width int, height int, channels int, dtype string, data binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                a = decode_image(c)
                rows.append((p, a.shape[1], a.shape[0], 3 if a.ndim == 3 else 1, str(a.dtype), a.tobytes()))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in IMAGE.split(", ")])

    return files.mapInPandas(run, IMAGE)


def write_images(images: DataFrame, folder: str, end: str = "png") -> DataFrame:
    """Images as files in a shared folder, named as those they came from; the (lazy) table of paths written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                path = f"{base}/{r['path'].rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{end}"
                with fs.open_output_stream(path) as f:
                    f.write(encode_image(image_array(r), end))
                out.append(path)
            yield pd.DataFrame({"path": out})

    return images.mapInPandas(run, "path string")


def image_array(row) -> np.ndarray:
    a = np.frombuffer(row["data"], row["dtype"])
    return a.reshape(row["height"], row["width"], 3) if row["channels"] == 3 else a.reshape(row["height"], row["width"])


def transform_image(image: np.ndarray, at: np.ndarray, fill: float = 0.0, nearest: bool = False) -> np.ndarray:
    """Pixels of ``image`` at the (x, y) of a map (H, W, 2), bilinear or nearest; ``fill`` outside."""
    h, w = image.shape[:2]
    x, y = at[..., 0].astype(float), at[..., 1].astype(float)
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x, y = np.where(inside, x, 0), np.where(inside, y, 0)
    if nearest:
        out = image[np.rint(y).astype(int), np.rint(x).astype(int)].astype(float)
    else:
        x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        fx, fy = x - x0, y - y0
        if image.ndim == 3:
            fx, fy = fx[..., None], fy[..., None]
        out = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy
    out = np.where(inside[..., None] if image.ndim == 3 else inside, out, fill)
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out.astype(image.dtype)


# -- point clouds ------------------------------------------------------------------------------
def ply_bytes(points: np.ndarray, color: np.ndarray | None = None, binary: bool = True) -> bytes:
    """A PLY file of (N, 3) points; colour grey (N) or BGR (N, 3)."""
    n = len(points)
    head = f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\n"
    if color is not None:
        color = np.repeat(color[:, None], 3, 1) if color.ndim == 1 else color[:, ::-1]
        head += "property uchar red\nproperty uchar green\nproperty uchar blue\n"
    head += "end_header\n"
    if not binary:
        rows = [" ".join([f"{v:.9g}" for v in p] + ([str(int(v)) for v in color[i]] if color is not None else [])) for i, p in enumerate(points)]
        return (head + "\n".join(rows) + "\n").encode()
    kind = [("p", "<f4", 3)] + ([("c", "u1", 3)] if color is not None else [])
    a = np.zeros(n, kind)
    a["p"] = points
    if color is not None:
        a["c"] = color
    return head.encode() + a.tobytes()


def write_ply(points: DataFrame, folder: str, binary: bool = True) -> DataFrame:
    """One PLY file a partition of (x, y, z[, gray]) rows in a shared folder; the (lazy) table of (path, points)."""
    gray = "gray" in points.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pdf = pd.concat([pd.DataFrame(columns=["x", "y", "z", "gray"]), *batches], ignore_index=True)
        if len(pdf):
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            path = f"{base}/part-{TaskContext.get().partitionId():06d}.ply"
            with fs.open_output_stream(path + ".tmp") as f:
                f.write(ply_bytes(pdf[["x", "y", "z"]].to_numpy(), pdf["gray"].to_numpy() if gray else None, binary))
            fs.move(path + ".tmp", path)
            yield pd.DataFrame({"path": [path], "points": [len(pdf)]})

    return points.mapInPandas(run, "path string, points long")
