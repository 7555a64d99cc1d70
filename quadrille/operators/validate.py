"""Validation of tile trees as tables of issues: code, path, message, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.sources.fixed import lines

#: Slack of the check that a parent's error is not below its child's.
SLACK = 1e-9
#: Required extensions that a tileset may name, deepest nesting, and most tilesets of one tree.
ALLOWED_REQUIRED = lines("required_extensions")
MAX_NESTING, MAX_TILESETS = 64, 10_000
ISSUE = "code string, path string, message string, severity string"


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def numbers_ok(values: Column, size: int) -> Column:
    """An array of exactly ``size`` finite numbers."""
    return F.coalesce((F.size(values) == size) & F.forall(values, finite), F.lit(False))


def volume_ok(box: Column, region: Column, sphere: Column) -> Column:
    """The lenient rule: the first kind that is there decides."""
    return F.when(box.isNotNull(), numbers_ok(box, 12)).when(region.isNotNull(), numbers_ok(region, 6)).when(sphere.isNotNull(), numbers_ok(sphere, 4)).otherwise(False)


def volume_ok_strict(box: Column, region: Column, sphere: Column) -> Column:
    """The strict rule: exactly one kind, and that valid."""
    kinds = box.isNotNull().cast("int") + region.isNotNull().cast("int") + sphere.isNotNull().cast("int")
    return (kinds == 1) & volume_ok(box, region, sphere)


def error_ok(ge: Column) -> Column:
    return finite(ge) & (ge >= 0)


def refine_ok(refine: Column) -> Column:
    return F.coalesce(F.upper(refine).isin("ADD", "REPLACE"), F.lit(False))


def issue(when: Column, code: str, message: Column | str, severity: str = "error") -> Column:
    """An issue struct where ``when`` holds, else null."""
    said = message if isinstance(message, Column) else F.lit(message)
    return F.when(when, F.struct(F.lit(code).alias("code"), F.col("loc").alias("path"), said.alias("message"), F.lit(severity).alias("severity")))


def tile_issues(tiles: DataFrame, strict: bool = False) -> DataFrame:
    """Issues of each tile by itself and against its parent: one pass and an explode of what was found.

    tiles: loc, ge, parent_ge, is_root, refine, has_refine, has_volume, box, region, sphere, has_transform, transform.
    """
    c = F.col
    volume = volume_ok_strict if strict else volume_ok
    ge_there = c("ge").isNotNull()
    found = [
        issue(ge_there & ~error_ok(c("ge")), "GEOMETRIC_ERROR_INVALID", F.concat(F.lit("geometricError must be finite and >= 0, got "), c("ge").cast("string"))),
        issue(~ge_there & (F.lit(strict) | ~c("is_root")), "GEOMETRIC_ERROR_INVALID", "tile missing geometricError", "error" if strict else "warning"),
        issue(c("parent_ge") + SLACK < c("ge"), "GEOMETRIC_ERROR_MONOTONICITY", F.concat(F.when(F.upper("refine") == "REPLACE", "REPLACE parent").otherwise("parent"), F.lit(" geometricError "), c("parent_ge").cast("string"), F.lit(" < child "), c("ge").cast("string")), "error" if strict else "warning"),
        issue(c("has_refine") & ~refine_ok(c("refine")), "REFINE_INVALID", "refine must be REPLACE or ADD"),
        issue(~c("has_volume"), "BOUNDING_VOLUME_MISSING", "tile missing boundingVolume"),
        issue(c("has_volume") & ~volume(c("box"), c("region"), c("sphere")), "BOUNDING_VOLUME_INVALID", "boundingVolume must contain finite box[12], region[6], or sphere[4]"),
        issue(c("has_transform") & ~numbers_ok(c("transform"), 16), "TRANSFORM_INVALID", "transform must be length-16 array of finite numbers"),
    ]
    return tiles.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")


def content_issues(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Issues of references: those that leave the root, and those without a file (anti join on the path).

    contents: loc, base (folder of the document, relative to the root), uri. files: path, relative to the root.
    """
    placed = contents.filter("uri IS NOT NULL").withColumn("resolved", T.resolve_path(F.col("base"), F.col("uri")))
    escapes = T.escapes_root(F.col("resolved")) | T.is_remote(F.col("uri"))
    out = placed.filter(escapes).select(F.lit("CONTENT_URI_ESCAPE").alias("code"), F.col("base").alias("path"), F.concat(F.lit("content uri `"), "uri", F.lit("` rejected")).alias("message"), F.lit("error").alias("severity"))
    there = files.select(F.col("path").alias("resolved")).distinct()
    gone = placed.filter(~escapes).join(there, "resolved", "left_anti").select(F.lit("CONTENT_MISSING").alias("code"), F.col("resolved").alias("path"), F.concat(F.lit("content file missing (uri=`"), "uri", F.lit("`)")).alias("message"), F.lit("error").alias("severity"))
    return out.union(gone)


def repeated_documents(references: DataFrame) -> DataFrame:
    """Documents that are reached twice, which the validators call a cycle."""
    return references.groupBy("resolved").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("CYCLE_DETECTED").alias("code"), F.col("resolved").alias("path"), F.concat(F.lit("tileset cycle detected at "), "resolved").alias("message"), F.lit("error").alias("severity"))


def too_many(documents: DataFrame, most: int = MAX_TILESETS) -> DataFrame:
    """One issue where a tree has more than ``most`` documents (path): the count is one aggregate."""
    return documents.agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).filter(F.col("n") > most).select(F.lit("TOO_MANY_TILESETS").alias("code"), "path", F.concat(F.col("n").cast("string"), F.lit(f" tilesets, at most {most} are supported")).alias("message"), F.lit("error").alias("severity"))


def unsupported(required: Column, allowed: tuple[str, ...] = ALLOWED_REQUIRED) -> Column:
    """Required extensions that are not allowed, sorted."""
    return F.array_sort(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


def little_endian(content: Column, offset: int, size: int = 4) -> Column:
    """An unsigned little-endian number at a byte offset of a binary column."""
    byte = lambda k: F.conv(F.hex(F.substring(content, offset + 1 + k, 1)), 16, 10).cast("long")
    return reduce(lambda a, k: a + byte(k) * 256**k, range(1, size), byte(0))


def header_issue(content: Column) -> Column:
    """The first fault of a payload's header, null where it is sound: size, magic, version, lengths."""
    n = F.octet_length(content).cast("long")
    magic = F.hex(F.substring(content, 1, 4))
    version, length = little_endian(content, 4), little_endian(content, 8)
    tables = sum((little_endian(content, 16 + 4 * i) for i in range(3)), little_endian(content, 12))
    b3dm = F.when(n < 28, "CONTENT_INVALID: b3dm header is cut short").when(version != 1, "CONTENT_INVALID: b3dm version").when(length > n, "CONTENT_INVALID: b3dm byteLength").when(28 + tables > length, "CONTENT_INVALID: b3dm tables exceed byteLength")
    glb = F.when(version != 2, "CONTENT_INVALID: glb version").when(length > n, "CONTENT_INVALID: glb length").when((n >= 20) & (20 + little_endian(content, 12) > length), "CONTENT_INVALID: glb chunk exceeds length")
    i3dm = F.when(n < 32, "CONTENT_INVALID: i3dm header is cut short")
    known = magic.isin("706E7473", "636D7074")  # pnts, cmpt pass
    return F.when(n < 12, "CONTENT_TOO_SMALL").when(magic == "6233646D", b3dm).when(magic == "676C5446", glb).when(magic == "6933646D", i3dm).when(known, F.lit(None)).otherwise("CONTENT_INVALID: unknown magic")


def summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, whether it passes, and the first error by path and code."""
    first = F.min(F.when(F.col("severity") == "error", F.struct("path", "code", "message")))
    return issues.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), first.alias("f")).select(
        "n_errors", "n_warnings", (F.col("n_errors") == 0).alias("ok"), F.concat(F.col("f.code"), F.lit(": "), F.col("f.message"), F.lit(" ("), F.col("f.path"), F.lit(")")).alias("first_error")
    )
