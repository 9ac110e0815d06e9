"""Palette documents: JSON files of a strict form, found and checked by DataFrame operations.

``{"metadata": {"id", "manufacturer", "display_name", "version"}, "colors": [{"number", "name", "rgb":
{"red", "green", "blue"}}]}`` in a file named ``<id>-v<version>.json``. A catalogue leaves out what
breaks a rule; :func:`palette_problems` says which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_NAME = r"^([A-Za-z0-9]{1,64})-v([1-9][0-9]{0,3})\.json$"
MOST_BYTES, MOST_COLOURS, MOST_TEXT = 1 << 20, 256, 128
SCHEMA = "metadata struct<id:string,manufacturer:string,display_name:string,version:string>, colors array<struct<number:string,name:string,rgb:struct<red:string,green:string,blue:string>>>"
KEYS = {"$": {"metadata", "colors"}, "$.metadata": {"id", "manufacturer", "display_name", "version"}}
#: What the page encoding can show: printable Latin-1, and these.
EXTRA_LETTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


class PaletteNotFoundError(LookupError):
    """No palette of this identity and version."""


def parse_file_name(name: Column) -> tuple[Column, Column]:
    """Identity and version in a file name; null where it is no palette's name."""
    fits = name.rlike(FILE_NAME)
    return F.when(fits, F.regexp_extract(name, FILE_NAME, 1)), F.when(fits, F.regexp_extract(name, FILE_NAME, 2).cast("long"))


def file_name(identity: Column, version: Column) -> Column:
    return F.concat(identity, F.lit("-v"), version.cast("string"), F.lit(".json"))


def unsupported_code_points(text: Column) -> Column:
    """Characters that the page encoding cannot show, in order of first appearance, as ``U+XXXX``."""
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: (c != "") & ~c.rlike(rf"^[\x20-\x7E\xA0-\xFF{EXTRA_LETTERS}]$"))
    return F.transform(chars, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, bytes, raw, doc)`` of the JSON files in a folder; ``doc`` is null where the text is no JSON object."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    raw = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("content").cast("string").alias("raw"))
    return raw.withColumn("doc", F.from_json("raw", SCHEMA))


def _text_problem(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (F.length(text) > MOST_TEXT) | (F.size(unsupported_code_points(text)) > 0)


def _whole(path: Column, low: int, high: int) -> Column:
    """Not a whole number in the range; JSON true, false and fractions are none."""
    number = path.try_cast("long") if hasattr(path, "try_cast") else path.cast("long")
    return F.coalesce(~path.rlike(r"^[0-9]+$") | (number < low) | (number > high), F.lit(True))


def palette_problems(documents: DataFrame) -> DataFrame:
    """``documents`` with ``problems``: the rules each breaks, in order."""
    d = documents
    identity, version = parse_file_name(F.col("name"))
    d = d.withColumns({"file_id": identity, "file_version": version})
    keys = lambda path: F.sort_array(F.json_object_keys(F.get_json_object("raw", path)))
    colour_keys = F.from_json(F.get_json_object("raw", "$.colors"), "array<map<string,string>>")
    rules = [
        ("file name", F.col("file_id").isNull()),
        ("size", F.col("bytes") > MOST_BYTES),
        ("not an object", F.col("doc").isNull() | F.json_object_keys("raw").isNull()),
        *((f"keys of {path}", ~F.coalesce(keys(path) == F.array(*map(F.lit, sorted(names))), F.lit(False))) for path, names in KEYS.items()),
        ("keys of a colour", F.exists(colour_keys, lambda c: ~(F.sort_array(F.map_keys(c)) == F.array(F.lit("name"), F.lit("number"), F.lit("rgb"))))),
        ("text", _text_problem(F.col("doc.metadata.manufacturer")) | _text_problem(F.col("doc.metadata.display_name"))),
        ("identity", ~F.coalesce((F.col("doc.metadata.id") == F.col("file_id")) & (F.col("doc.metadata.version") == F.col("file_version").cast("string")), F.lit(False))),
        ("number of colours", F.coalesce((F.size("doc.colors") < 1) | (F.size("doc.colors") > MOST_COLOURS), F.lit(True))),
        ("colour name", F.exists("doc.colors", lambda c: _text_problem(c["name"]))),
        ("colour number", F.exists("doc.colors", lambda c: _whole(c["number"], 1, (1 << 31) - 1))),
        ("colour channel", F.exists("doc.colors", lambda c: _whole(c["rgb"]["red"], 0, 255) | _whole(c["rgb"]["green"], 0, 255) | _whole(c["rgb"]["blue"], 0, 255))),
        ("repeated number", F.size(F.array_distinct("doc.colors.number")) < F.size("doc.colors.number")),
    ]
    return d.withColumn("problems", F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules)), lambda x: x.isNotNull()))


def catalogue(documents: DataFrame) -> DataFrame:
    """``(palette_id, version, manufacturer, display_name, colours)`` of all documents without a problem, in order."""
    good = palette_problems(documents).filter(F.size("problems") == 0)
    return good.select(F.col("file_id").alias("palette_id"), F.col("file_version").alias("version"), "doc.metadata.manufacturer", "doc.metadata.display_name", F.col("doc.colors").alias("colours")).orderBy("palette_id", "version")


def palette_rows(found: DataFrame) -> DataFrame:
    """``(palette_id, version, idx, number, name, rgb)``."""
    rows = found.select("palette_id", "version", F.posexplode("colours").alias("idx", "c"))
    channel = lambda n: F.col(f"c.rgb.{n}").cast("long")
    return rows.select("palette_id", "version", F.col("idx").cast("long").alias("idx"), F.col("c.number").cast("long").alias("number"), "c.name", (channel("red") * 65536 + channel("green") * 256 + channel("blue")).alias("rgb"))


def load_palette(spark: SparkSession, folder: str, identity: str, version: int) -> DataFrame:
    """The palette of one identity and version, or :class:`PaletteNotFoundError`."""
    rows = palette_rows(catalogue(read_documents(spark, folder))).filter((F.col("palette_id") == identity) & (F.col("version") == version))
    if not rows.head(1):
        raise PaletteNotFoundError(f"no palette {identity!r} of version {version}")
    return rows
