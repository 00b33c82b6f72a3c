"""Shapefiles and DBF tables from binary files, decoded inside tasks.

Spark lists and reads the files (``binaryFile``, any store). Zip members become rows first.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def members(spark: SparkSession, path: str, suffixes: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """(member, content) of zip archives: members with these suffixes, within ``folder`` if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        plain = name.replace("\\", "/").lower()
                        if plain.endswith(suffixes) and (folder is None or folder.lower() in plain):
                            yield pd.DataFrame({"member": [plain], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, content binary")


def dbf_rows(data: bytes) -> Iterator[dict[str, str | None]]:
    """Records of a DBF table as trimmed texts by upper-case column name."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at, start = [], 32, 1
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1").upper()
        fields.append((name, start, data[at + 16]))
        start += data[at + 16]
        at += 32
    for i in range(count):
        r = data[head + i * size : head + (i + 1) * size]
        if r[:1] != b"*":
            yield {n: r[a : a + w].decode("utf-8", "replace").strip(" \0") or None for n, a, w in fields}


def shp_shapes(data: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """Parts of each shape of a shapefile: points, lines and rings alike."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">I", data, at + 4)
        (kind,) = struct.unpack_from("<I", data, at + 8)
        body = at + 12
        if kind % 10 == 1:
            yield [[struct.unpack_from("<2d", data, body)]]
        elif kind % 10 in (3, 5):
            parts, points = struct.unpack_from("<2I", data, body + 32)
            first = [*struct.unpack_from(f"<{parts}I", data, body + 40), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, body + 40 + 4 * parts)
            flat = list(zip(xy[0::2], xy[1::2], strict=True))
            yield [flat[a:b] for a, b in zip(first, first[1:], strict=False)]
        else:
            yield []
        at += 8 + 2 * words


def shapes(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(layer, row, parts, attributes) of all shapefiles in zip archives: geometry by record number."""
    schema = f"layer string, row int, parts array<{LINE}>, attributes map<string,string>"

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        by = {m.rsplit(".", 1)[1]: c for m, c in zip(group["member"], group["content"], strict=True)}
        if not {"shp", "dbf"} <= by.keys():
            return pd.DataFrame({"layer": [], "row": [], "parts": [], "attributes": []})
        out = [(key[0], i, [[{"x": x, "y": y} for x, y in p] for p in s], a) for i, (s, a) in enumerate(zip(shp_shapes(by["shp"]), dbf_rows(by["dbf"]), strict=False))]
        return pd.DataFrame(out, columns=["layer", "row", "parts", "attributes"])

    files = members(spark, path, (".shp", ".dbf"), folder)
    return files.groupBy(F.regexp_replace("member", r"\.\w+$", "").alias("layer")).applyInPandas(run, schema)


def id_of(attributes: str, *names: str):
    """The first attribute that is there among these names."""
    return F.coalesce(*[F.try_element_at(F.col(attributes), F.lit(n)) for n in names])


def measurement_places(spark: SparkSession, path: str) -> DataFrame:
    rows = shapes(spark, path)
    return rows.select(id_of("attributes", "DGL_LOC", "MEETLOC", "LOC_ID", "ID").alias("id"), F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(F.flatten("parts")).alias("line"), "attributes").where("id is not null")


def chain_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Points, lines and areas of the location chain from the WGS84 folder."""
    rows = shapes(spark, path, "wgs84")
    return rows.select("layer", id_of("attributes", "LOC_NR", "ID").try_cast("int").alias("id"), "parts", "attributes")


def longest_part(rows: DataFrame) -> DataFrame:
    """Each id's parts as one line where they touch end to end, else the longest part."""
    from ..functions import geo

    p = rows.select("id", F.posexplode("parts").alias("part", "line"))
    best = p.withColumn("_len", geo.line_length("line")).groupBy("id").agg(F.max_by("line", F.struct(F.col("_len"), -F.col("part"))).alias("longest"), F.array_sort(F.collect_list(F.struct("part", "line"))).alias("all"))
    chained = F.forall(F.sequence(F.lit(1), F.size("all")), lambda i: (i == 1) | (F.element_at(F.get("all", i - 2)["line"], -1) == F.element_at(F.get("all", i - 1)["line"], 1)))
    whole = F.aggregate("all", F.array().cast(LINE), lambda acc, x: F.concat(acc, F.when(F.size(acc) == 0, x["line"]).otherwise(F.slice(x["line"], 2, F.size(x["line"])))))
    return best.select("id", F.when(chained, whole).otherwise(F.col("longest")).alias("line"))


def chain_table(spark: SparkSession, path: str) -> DataFrame:
    """The location table at the archive's root, with the whole record as ``raw``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for member, content in zip(b["member"], b["content"], strict=True):
                base = member.rsplit("/", 1)[-1]
                if base.startswith("vild") and not base.startswith("vild_"):
                    yield pd.DataFrame({"raw": list(dbf_rows(content))})

    raw = members(spark, path, (".dbf",)).mapInPandas(run, "raw map<string,string>")
    whole = lambda k: F.try_element_at("raw", F.lit(k)).try_cast("double").cast("int")
    rows = raw.select(whole("LOC_NR").alias("loc_nr"), whole("LIN_REF").alias("lin_ref"), whole("POS_OFF").alias("pos_off"), whole("NEG_OFF").alias("neg_off"), F.try_element_at("raw", F.lit("ROADNUMBER")).alias("road_number"), whole("HECTO_DIR").alias("hecto_dir"), "raw")
    return rows.where("loc_nr > 0")


def sign_shapes(spark: SparkSession, path: str) -> DataFrame:
    rows = shapes(spark, path)
    at = F.get(F.get("parts", F.lit(0)), F.lit(0))
    return rows.select(id_of("attributes", "UUID").alias("uuid"), at["x"].alias("x"), at["y"].alias("y"), id_of("attributes", "BEARING", "BERING").try_cast("double").alias("bearing")).where("uuid is not null")
