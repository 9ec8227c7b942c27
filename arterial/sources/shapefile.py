"""Shapefiles: polylines and their attributes, read through Spark's binary file source.

A layer is two files with one stem, .shp and .dbf. Every layer is decoded by one task, as
the format is read from front to back; a folder of layers is read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "layer string, fid long, attributes map<string,string>, parts array<array<struct<x:double,y:double>>>"
_POLYLINES = (3, 13, 23)


def decode_shapes(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """Parts of each record; None for a null shape. Other shape types raise."""
    out: list[list[list[tuple[float, float]]] | None] = []
    at = 100
    while at + 8 <= len(data):
        _, words = struct.unpack_from(">ii", data, at)
        body, at = at + 8, at + 8 + 2 * words
        (kind,) = struct.unpack_from("<i", data, body)
        if kind == 0:
            out.append(None)
            continue
        if kind not in _POLYLINES:
            raise ValueError(f"shape type {kind} is not a polyline")
        n_parts, n_points = struct.unpack_from("<ii", data, body + 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", data, body + 44), n_points]
        flat = struct.unpack_from(f"<{2 * n_points}d", data, body + 44 + 4 * n_parts)
        points = list(zip(flat[::2], flat[1::2], strict=True))
        out.append([points[a:b] for a, b in zip(starts, starts[1:], strict=False)])
    return out


def decode_attributes(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Fields of each record that isn't deleted, as text without blanks at its ends."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode(encoding, "replace")
        fields.append((name, data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        record = data[head + k * width : head + (k + 1) * width]
        row, p = {}, 1
        for name, size in fields:
            row[name] = record[p : p + size].decode(encoding, "replace").strip().strip("\0")
            p += size
        out.append(row)
    return out


def read_shapefiles(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(layer, fid, attributes, parts) of all layers under a path; fid counts from 0 in a layer."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(shp|dbf)$"))
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    layers = files.groupBy(stem.alias("layer")).agg(F.max(F.when(F.lower("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.lower("path").endswith(".dbf"), F.col("content"))).alias("dbf"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for layer, shp, dbf in f[["layer", "shp", "dbf"]].itertuples(index=False):
                shapes = decode_shapes(bytes(shp)) if shp is not None else []
                rows = decode_attributes(bytes(dbf), encoding) if dbf is not None else [{}] * len(shapes)
                for lo in range(0, len(shapes), 5000):
                    part = shapes[lo : lo + 5000]
                    yield pd.DataFrame({
                        "layer": layer, "fid": range(lo, lo + len(part)), "attributes": rows[lo : lo + len(part)],
                        "parts": [None if s is None else [[{"x": x, "y": y} for x, y in p] for p in s] for s in part],
                    })

    return layers.where("shp IS NOT NULL").mapInPandas(decode, SCHEMA)


def encode_shapes(records: list[list[list[tuple[float, float]]]]) -> bytes:
    """The .shp bytes of polylines."""
    body: list[bytes] = []
    for k, parts in enumerate(records, 1):
        points = [p for part in parts for p in part]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        starts, n = [], 0
        for part in parts:
            starts.append(n)
            n += len(part)
        shape = struct.pack("<i4dii", 3, min(xs), min(ys), max(xs), max(ys), len(parts), n) + struct.pack(f"<{len(parts)}i", *starts)
        shape += b"".join(struct.pack("<2d", *p) for p in points)
        body.append(struct.pack(">ii", k, len(shape) // 2) + shape)
    every = [p for r in records for part in r for p in part] or [(0.0, 0.0)]
    box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))
    size = 100 + sum(map(len, body))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 3, *box, 0, 0, 0, 0) + b"".join(body)


def encode_index(shapes: bytes) -> bytes:
    """The .shx bytes of .shp bytes: where each record begins, and its size."""
    out, at = [], 100
    while at + 8 <= len(shapes):
        (words,) = struct.unpack_from(">i", shapes, at + 4)
        out.append(struct.pack(">2i", at // 2, words))
        at += 8 + 2 * words
    return shapes[:24] + struct.pack(">i", 50 + 4 * len(out)) + shapes[28:100] + b"".join(out)


def encode_attributes(rows: list[dict[str, str]], encoding: str = "utf-8") -> bytes:
    """The .dbf bytes of text fields."""
    names = list(rows[0]) if rows else []
    width = {n: max([1, *(len(r[n].encode(encoding)) for r in rows)]) for n in names}
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(width.values()))
    for n in names:
        head += n.encode(encoding)[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width[n], 0]) + bytes(14)
    return head + b"\r" + b"".join(b" " + b"".join(r[n].encode(encoding).ljust(width[n]) for n in names) for r in rows) + b"\x1a"


def write_shapefiles(roads: DataFrame, path: str, settings: Sequence[str] = ("method", "ratio", "alpha", "noise"), prj: str | None = None, encoding: str = "utf-8") -> list[str]:
    """One layer for each setting of ``roads`` (settings..., fid, fields..., parts), named by its
    settings joined by underscores; returns their names.

    A layer is encoded by one task, as its files are one each, and its bytes pass the driver one
    layer at a time on their way to the folder, which may be in any store that Spark writes.
    Fields become text; roads without points are left out; ``prj`` is written beside every layer."""
    spark, fields = roads.sparkSession, [c for c in roads.columns if c not in (*settings, "parts")]
    name = F.concat_ws("_", *(F.col(c).cast("string") for c in settings)).alias("name")
    rows = roads.where(F.size(F.flatten("parts")) > 0).select(name, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields), "parts")

    def encode(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.iloc[f["fid"].map(lambda v: (len(v), v)).argsort(kind="stable")] if "fid" in fields else f
        shp = encode_shapes([[[(p["x"], p["y"]) for p in part] for part in parts if len(part)] for parts in f["parts"]])
        return pd.DataFrame({"name": [key[0]], "shp": [shp], "shx": [encode_index(shp)], "dbf": [encode_attributes(f[fields].to_dict("records"), encoding)]})

    sc, names = spark.sparkContext, []
    for r in rows.groupBy("name").applyInPandas(encode, "name string, shp binary, shx binary, dbf binary").toLocalIterator():
        sidecars = {"cpg": encoding.upper().encode(), **({} if prj is None else {"prj": prj.encode()})}
        for suffix, data in {"shp": r["shp"], "shx": r["shx"], "dbf": r["dbf"], **sidecars}.items():
            to = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}.{suffix}")
            out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
            out.write(bytes(data))
            out.close()
        names.append(r["name"])
    return sorted(names)
