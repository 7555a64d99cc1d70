"""Folder scans: photogrammetry datasets, model files with their materials, resources and files by range. Only listings and small texts are read."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadrille.functions import text as T

#: Missing entries named in a report; of more, the number is given.
NAMED = 20
#: Commands of a material library that name textures, and options with one, two or up to three values.
MAP_COMMANDS = ("map_ka", "map_kd", "map_ks", "map_ke", "map_ns", "map_d", "map_bump", "bump", "norm", "disp", "decal", "refl")
ONE_VALUE = ("-blendu", "-blendv", "-cc", "-clamp", "-imfchan", "-type", "-texres", "-bm", "-boost", "-colorspace")
UP_TO_THREE = ("-o", "-s", "-t")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and modificationTime of the files below a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def dataset_root(path: Column) -> Column:
    """The dataset's root where its Data folder was chosen."""
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/(?i:data)$", "")


def tile_folders(listing: DataFrame) -> DataFrame:
    """Per folder under Data: files and bytes of kind osgb, whether the entry file is there, and whether the name is standard. listing: path, length."""
    parts = listing.select(F.regexp_extract("path", r"/Data/([^/]+)/[^/]+$", 1).alias("tile"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length").filter("tile <> ''")
    osgb = F.lower("file").endswith(".osgb")
    per = parts.groupBy("tile").agg(F.count_if(osgb).alias("n_osgb"), F.coalesce(F.sum(F.when(osgb, F.col("length"))), F.lit(0)).alias("bytes"), F.bool_or(F.col("file") == F.concat("tile", F.lit(".osgb"))).alias("has_entry"))
    return per.withColumn("standard", T.is_tile_folder(F.col("tile"))).filter("standard OR has_entry")


def totals(folders: DataFrame) -> DataFrame:
    """One row: tiles, files, bytes, tiles without entry file."""
    return folders.agg(F.count(F.lit(1)).alias("n_tiles"), F.coalesce(F.sum("n_osgb"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(~F.col("has_entry")).alias("n_missing_entry"))


def scan_issues(folders: DataFrame) -> DataFrame:
    """Messages on missing entries (the first twenty by name, then how many more) and on folders that are not standard."""
    missing = folders.filter("NOT has_entry")
    named = missing.orderBy("tile").limit(NAMED).select(F.lit("error").alias("severity"), F.concat(F.lit("Missing entry OSGB (must match folder name): "), "tile").alias("message"))
    more = missing.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NAMED).select(F.lit("error"), F.concat(F.lit("... and "), (F.col("n") - NAMED).cast("string"), F.lit(" more missing entry files")))
    odd = folders.filter("NOT standard").select(F.lit("warning"), F.concat(F.lit("Non-standard directory under Data/: "), "tile"))
    return named.union(more).union(odd)


def metadata(texts: DataFrame) -> DataFrame:
    """SRS and origin of metadata documents (path, text), and their XML error; no values are taken from a document that is not well formed."""
    checked = texts.withColumn("xml_error", xml_error(F.col("text")))
    good = F.col("xml_error").isNull()
    return checked.select("path", "xml_error", F.when(good, T.tag_value(F.col("text"), "SRS")).alias("srs"), F.when(good, T.tag_value(F.col("text"), "SRSOrigin")).alias("srs_origin"))


@F.pandas_udf(StringType())
def _xml_error(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return "no document"
        parser = expat.ParserCreate()
        try:
            parser.Parse(text.encode("utf-8", "surrogatepass"), True)
        except expat.ExpatError as e:
            return str(e)
        return None

    return texts.map(one, na_action=None).astype(object)


def xml_error(text: Column) -> Column:
    """Why a text is no well-formed XML; null if it is. The parser only checks; entities are not fetched."""
    return _xml_error(text)


def texture_reference(line: str) -> str | None:
    """The file that a line of a material library names; None for other lines and for malformed options. Quotes around the name are taken off."""
    words = line.split("#", 1)[0].split()
    if len(words) < 2 or words[0].lower() not in MAP_COMMANDS:
        return None
    rest = words[1:]
    while rest and rest[0].startswith("-"):
        option = rest.pop(0)
        if option in UP_TO_THREE:
            taken = 0
            while rest and taken < 3 and _is_number(rest[0]):
                rest.pop(0)
                taken += 1
            if not taken:
                return None
        elif option == "-mm" and len(rest) >= 2:
            del rest[:2]
        elif option in ONE_VALUE and rest:
            rest.pop(0)
        else:
            return None
    return " ".join(rest).strip('"') or None


def _is_number(word: str) -> bool:
    try:
        float(word)
    except ValueError:
        return False
    return "_" not in word


def model_references(texts: DataFrame) -> DataFrame:
    """(path, kind, reference) of model and material texts (path, text): libraries an OBJ names, textures a library names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                for line in (text or "").splitlines():
                    if path.lower().endswith(".obj") and line.strip().startswith("mtllib ") and line.strip()[7:].strip():
                        out.append((path, "library", line.strip()[7:].strip()))
                    elif path.lower().endswith(".mtl") and (name := texture_reference(line)):
                        out.append((path, "texture", name))
            yield pd.DataFrame(out, columns=["path", "kind", "reference"])

    return texts.select("path", "text").mapInPandas(run, "path string, kind string, reference string")


def resolved(refs: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Where each reference is found: beside its file, by its last name there, then in the roots, in that order. Adds ``found`` (null: missing)."""
    base = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.regexp_extract(F.replace(F.col("reference"), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    whole = F.replace(F.col("reference"), F.lit("\\"), F.lit("/"))
    places = [F.concat(base, F.lit("/"), whole), F.concat(base, F.lit("/"), name)] + [F.concat(F.lit(r.rstrip("/") + "/"), n) for r in roots for n in (whole, name)]
    absolute = whole.startswith("/")
    candidates = refs.select("path", "kind", "reference", F.posexplode(F.when(absolute, F.array(whole)).otherwise(F.array(*places))).alias("rank", "candidate"))
    there = listing.select(F.col("path").alias("candidate")).distinct()
    best = candidates.join(there, "candidate").groupBy("path", "kind", "reference").agg(F.min_by("candidate", "rank").alias("found"))
    return refs.distinct().join(best, ["path", "kind", "reference"], "left")


def byte_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes from start to end, both inclusive; null where the range is not in the file."""
    return F.when((start >= 0) & (start <= end) & (start < F.octet_length(content)), F.substring(content, (start + 1).cast("int"), (end - start + 1).cast("int")))


def directory_bytes(listing: DataFrame) -> DataFrame:
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def log_tail(text: Column, n_bytes: int = 256 * 1024) -> Column:
    """The lines of a log's last bytes, from a whole code point on."""
    return F.split(T.byte_tail(text, n_bytes), "\n")
