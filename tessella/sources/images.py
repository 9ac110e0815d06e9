"""Image files to pixels: formats are recognised by content, sizes and orientation are read from headers.

Files are accepted or refused by their headers; only accepted ones are given to the JVM's decoder (BMP,
JPEG, PNG), so a small file that claims a huge image is never decoded. :func:`refused_images` tells why a file
is left out, a body that turns out broken included. WEBP has no decoder here and is refused. The eight EXIF
orientations are applied as a map of pixel positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"bmp": "bmp", "jpg": "jpeg", "jpeg": "jpeg", "png": "png"}


def jpeg_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the first start-of-frame segment of a JPEG file."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # fill bytes and marks without a length
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


def exif_orientation(data: bytes) -> int:
    """The orientation (1 to 8) that a JPEG file's EXIF segment gives; 1 if none or no valid one."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            if order is None:
                return 1
            number = lambda start, n: int.from_bytes(tiff[start : start + n], order)  # noqa: E731, B023
            table = number(4, 4)
            for k in range(number(table, 2)):
                entry = table + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    found = number(entry + 8, 2)
                    return found if 1 <= found <= 8 else 1
            return 1
        at += 2 + size
    return 1


def _jpeg_headers(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*jpeg_size(c), exif_orientation(c)) if c is not None else (None, None, None) for c in content], columns=["width", "height", "orientation"]).astype("Int64")


def sniffed_format(content: Column) -> Column:
    """The format that the first bytes show; null if none is known."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("424D"), "bmp").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & head.endswith("57454250"), "webp")


def _number(content: Column, at: int, size: int, little: bool) -> Column:
    bytes_ = F.substring(content, at + 1, size)
    return F.conv(F.hex(F.reverse(bytes_) if little else bytes_), 16, 10).cast("long")


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, format, named, width, height, orientation)`` from the files' first segments; null where there is none to read."""
    files = spark.read.format("binaryFile").load(path).withColumn("format", sniffed_format(F.col("content")))
    files = files.withColumn("jpeg", F.pandas_udf(_jpeg_headers, "width long, height long, orientation long")(F.when(F.col("format") == "jpeg", F.col("content"))))
    named = F.lower(F.element_at(F.split("path", r"\."), -1))
    little = lambda at: F.conv(F.concat(*(F.hex(F.substring("content", at + i, 1)) for i in (4, 3, 2, 1))), 16, 10).cast("long")
    width = F.when(F.col("format") == "png", _number(F.col("content"), 16, 4, False)).when(F.col("format") == "bmp", little(18)).otherwise(F.col("jpeg.width"))
    height = F.when(F.col("format") == "png", _number(F.col("content"), 20, 4, False)).when(F.col("format") == "bmp", F.when(little(22) >= 1 << 31, (1 << 32) - little(22)).otherwise(little(22))).otherwise(F.col("jpeg.height"))  # negative: top row first
    return files.select("path", "format", F.create_map(*(F.lit(v) for kv in FORMATS.items() for v in kv))[named].alias("named"), width.alias("width"), height.alias("height"), F.coalesce("jpeg.orientation", F.lit(1)).alias("orientation"))


def acceptance(images: DataFrame, most_pixels: int = 50_000_000, most_width: int = 20_000, most_height: int = 20_000) -> DataFrame:
    """``images(width, height)`` with ``refusal``: why an image is not accepted, null if it is."""
    if min(most_pixels, most_width, most_height) < 1:
        raise ValueError("limits must be at least 1")
    w, h = F.col("width"), F.col("height")
    return images.withColumn("refusal", F.when((w < 1) | (h < 1), "empty").when(w > most_width, "width").when(h > most_height, "height").when(w * h > most_pixels, "pixels"))


def checked_images(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """Headers with ``refusal``: ``format`` (none that is accepted), ``name`` (another than the content's), ``header`` (no size) or a limit; null if accepted."""
    own = F.when(F.col("format").isNull() | ~F.col("format").isin(*FORMATS.values()), "format").when(~F.coalesce(F.col("format") == F.col("named"), F.lit(False)), "name").when(F.col("width").isNull() | F.col("height").isNull(), "header")
    return acceptance(image_headers(spark, path), **limits).withColumn("refusal", F.coalesce(own, "refusal"))


#: Paths that one reader gets; Spark lists a reader's files on the driver, as it does for any folder.
PATHS = 10_000


def decode_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spark's image columns of these files, and no others; a broken body gives an empty image."""
    literal = lambda p: "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in p)  # noqa: E731  a path is no pattern
    frames = [spark.read.format("image").option("dropInvalid", False).load([literal(p) for p in paths[at : at + PATHS]]).select("image.*") for at in range(0, len(paths), PATHS)]
    if not frames:
        return spark.createDataFrame([], "origin string, height int, width int, nChannels int, mode int, data binary")
    images = frames[0]
    for more in frames[1:]:
        images = images.unionByName(more)
    return images


def decoded_images(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """``(path, orientation, height, width, nChannels, data)`` of the accepted files under ``path``; ``data`` is null where the body is broken."""
    accepted = checked_images(spark, path, **limits).filter("refusal is null").select("path", "orientation")
    images = decode_files(spark, sorted(r["path"] for r in accepted.select("path").toLocalIterator()))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    images = images.withColumn("at", plain(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))))).join(accepted.withColumn("at", plain("path")), "at")
    broken = F.coalesce(F.col("height") < 1, F.lit(True)) | (F.length("data") == 0)
    return images.select("path", "orientation", "height", "width", "nChannels", F.when(~broken, F.col("data")).alias("data"))


def refused_images(spark: SparkSession, path: str, decode: bool = False, **limits: int) -> DataFrame:
    """``(path, refusal)`` of every file under ``path`` that :func:`load_images` leaves out. ``decode``: also accepted files whose ``body`` is broken."""
    refused = checked_images(spark, path, **limits).filter("refusal is not null").select("path", "refusal")
    if not decode:
        return refused
    return refused.unionByName(decoded_images(spark, path, **limits).filter("data is null").select("path", F.lit("body").alias("refusal")))


def oriented(pixels: DataFrame) -> DataFrame:
    """``pixels(image_id, x, y, rgb, width, height, orientation)`` turned upright: ``(image_id, pos, x, y, rgb)``."""
    x, y, o = F.col("x"), F.col("y"), F.col("orientation")
    right, low = F.col("width") - 1 - x, F.col("height") - 1 - y
    turned = o >= 5  # rows become columns
    u = F.when(o.isin(2, 3), right).when(o.isin(5, 8), y).when(o.isin(6, 7), low).otherwise(x)
    v = F.when(o.isin(3, 4), low).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    across = F.when(turned, F.col("height")).otherwise(F.col("width"))
    return pixels.select("image_id", (v * across + u).alias("pos"), u.alias("x"), v.alias("y"), "rgb")


def load_images(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """``pixels`` of all accepted images under ``path``, numbered by path; :func:`refused_images` names the others."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                raw = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(np.int64)
                raw = raw[..., [0, 0, 0]] if row.nChannels == 1 else raw[..., :3]  # the decoder gives blue, green, red
                y, x = np.mgrid[: row.height, : row.width]
                yield pd.DataFrame({"image_id": row.image_id, "x": x.ravel(), "y": y.ravel(), "rgb": (raw[..., 2] << 16 | raw[..., 1] << 8 | raw[..., 0]).ravel(), "width": row.width, "height": row.height, "orientation": row.orientation})

    decoded = acceptance(decoded_images(spark, path, **limits).filter("data is not null"), **limits).filter("refusal is null")
    rows = decoded.select(F.xxhash64("path").alias("image_id"), "orientation", "height", "width", "nChannels", "data")
    return oriented(rows.mapInPandas(explode, "image_id long, x long, y long, rgb long, width long, height long, orientation long"))


def bmp_bytes(x: np.ndarray, y: np.ndarray, rgb: np.ndarray) -> bytes:
    """A 24-bit BMP, top row first; missing pixels are white."""
    height, width = int(y.max()) + 1, int(x.max()) + 1
    stride = (width * 3 + 3) // 4 * 4
    rows = np.full((height, stride), 255, np.uint8)
    rows[:, width * 3 :] = 0
    for channel, shift in enumerate((0, 8, 16)):
        rows[y, x * 3 + channel] = rgb >> shift & 255
    data = rows.tobytes()
    number = lambda v, n: int(v).to_bytes(n, "little", signed=v < 0)
    return b"BM" + number(54 + len(data), 4) + number(0, 4) + number(54, 4) + number(40, 4) + number(width, 4) + number(-height, 4) + number(1, 2) + number(24, 2) + number(0, 4) + number(len(data), 4) + number(2835, 4) * 2 + number(0, 8) + data


def to_bmp(pixels: DataFrame) -> DataFrame:
    """``(image_id, width, height, bmp)`` of ``pixels(image_id, x, y, rgb)``, one image a task."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].to_numpy(), part["y"].to_numpy()
        return pd.DataFrame([(int(part["image_id"].iloc[0]), int(x.max()) + 1, int(y.max()) + 1, bmp_bytes(x, y, part["rgb"].to_numpy()))], columns=["image_id", "width", "height", "bmp"])

    return pixels.select("image_id", "x", "y", "rgb").groupBy("image_id").applyInPandas(pack, "image_id long, width long, height long, bmp binary")


def overlay(pixels: DataFrame, marked: DataFrame, colour: int = 0xFF0000) -> DataFrame:
    """``pixels`` with those in ``marked(image_id, x, y)`` in one colour."""
    hits = marked.select("image_id", "x", "y").distinct().withColumn("hit", F.lit(True))
    return pixels.join(hits, ["image_id", "x", "y"], "left").withColumn("rgb", F.when(F.col("hit"), F.lit(colour).cast("long")).otherwise(F.col("rgb"))).drop("hit")
