"""Source trees: scan, language by extension, lossy decoding, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar


def scan(spark: SparkSession, path: str, language: str | None = None, recurse: bool = True, forced: bool = False) -> DataFrame:
    """path, language, content. With a language only files whose extension says exactly that (forced: all files, as that language).

    The names are filtered while they are listed, so other files are not opened.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recurse)
    if not forced:
        found = found.option("pathGlobFilter", name_pattern([x for x, of in scalar.EXTENSIONS.items() if language in (None, of)]))
    found = found.load(path)
    rows = found.select("path", (F.lit(language) if forced and language else scalar.language_of(F.col("path"))).alias("language"), "content")
    return rows.where(F.col("language") == language) if language else rows.where(F.col("language") != "unknown")


def name_pattern(extensions: list[str]) -> str:
    """Glob of the file names with one of these extensions, in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions or ["-"]) + "}"


def decode(content: bytes) -> str:
    """UTF-8 text of the same byte length: each invalid byte is a question mark."""
    out, at = [], 0
    while at < len(content):
        try:
            out.append(content[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as bad:
            out.append(content[at : at + bad.start].decode("utf-8"))
            out.append("?" * (bad.end - bad.start))
            at += bad.end
    return "".join(out)


def fnv1a(text: str) -> str:
    """64-bit FNV-1a of the text's bytes, 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def dominant_language(files: DataFrame) -> DataFrame:
    """The language, other than Rust, of most files; ties by name."""
    counted = files.select(scalar.language_of(F.col("path")).alias("language")).where(~F.col("language").isin("rust", "unknown"))
    return counted.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(1)
