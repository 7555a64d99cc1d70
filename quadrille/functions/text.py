"""Names, paths, references, options and messages, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Message parts and the code they stand for; the first rule that holds wins. A rule is a list of
#: alternatives; a tuple in it needs all its parts.
ERROR_CODES: tuple[tuple[str, tuple], ...] = (
    ("PATH_INPUT_NOT_FOUND", ("input does not exist",)),
    ("PATH_OUTPUT_EXISTS", ("output already exists",)),
    ("PATH_OUTPUT_NOT_WRITABLE", ("not writable", "cannot create output parent", "cannot write output directory", "access denied", "permission denied", "拒绝访问", "os error 5")),
    ("PATH_OVERLAP", (("must not", "input"),)),
    ("MODEL_CONFIG_INVALID", ("invalid convert-model options", "model config", "model.format")),
    ("MODEL_INPUT_INVALID", ("model input must be a file", "only .fbx and .obj", "requires an explicit model")),
    ("OSGB_GEOREFERENCE_UNSUPPORTED", ("unsupported osgb coordinate override", "unsupported osgb origin override")),
    ("OSGB_METADATA_INVALID", ("invalid osgb",)),
    ("MODEL_GEOREFERENCE_UNSUPPORTED", ("projected model georeference",)),
    ("CONVERTER_EXIT_NONZERO", ("convert exited", "converter")),
    ("OSGB_METADATA_INVALID", ("metadata.xml", "srs")),
    ("REBUILD_FAILED", ("rebuild",)),
    ("TEXTURE_FAILED", ("texture",)),
    ("VALIDATE_FAILED", ("validate", "tileset")),
    ("DISK_FULL", ("disk", "space")),
)
#: Triangle budgets of the first and second proxy level by quality.
PRESETS = {"quality": (8000, 4000), "balanced": (4000, 2000), "speed": (2000, 1000)}
DEFAULT_PRESET = (4000, 2000)
#: Codes of geographic coordinate systems, whose unit is the degree.
DEGREE_CODES = (4326, 4490, 4610, 4214)
ENU = r"(?i)^\s*ENU\s*:\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)\s*$"
EPSG = r"(?i)^\s*EPSG\s*:\s*(\d+)\s*$"


def error_code(message: Column) -> Column:
    """The stable code of a message."""
    low = F.lower(message)
    out = None
    for code, rule in ERROR_CODES:
        any_ = F.lit(False)
        for part in rule:
            all_ = F.lit(True)
            for p in part if isinstance(part, tuple) else (part,):
                all_ = all_ & F.contains(low, F.lit(p))
            any_ = any_ | all_
        out = F.when(any_, code) if out is None else out.when(any_, code)
    return out.otherwise("TASK_FAILED")


def texture_mode(mode: Column) -> Column:
    """The canonical name of a texture mode; unknown ones stay, trimmed and in lower case."""
    m = F.trim(F.lower(F.coalesce(mode, F.lit("keep"))))
    return F.when(m.isin("keep", "none", "", "passthrough"), "keep").when(m.isin("ktx2", "ktx2-etc1s", "etc1s"), "ktx2-etc1s").when(m.isin("ktx2-uastc", "uastc"), "ktx2-uastc").otherwise(m)


def preset_budget(quality: Column, level: int, explicit: Column | None = None) -> Column:
    """Triangle budget of proxy level 1 or 2; an explicit number wins, no quality gives null."""
    q = F.lower(F.coalesce(quality, F.lit("")))
    chosen = F.when(q == "", F.lit(None).cast("int"))
    for name, budgets in PRESETS.items():
        chosen = chosen.when(q == name, budgets[level - 1])
    chosen = chosen.otherwise(DEFAULT_PRESET[level - 1])
    return chosen if explicit is None else F.coalesce(explicit, chosen)


def preset_of(l1: Column, l2: Column) -> Column:
    """The quality whose budgets these are, else ``custom``."""
    out = F.when(F.lit(False), "")
    for name, (a, b) in PRESETS.items():
        out = out.when((l1 == a) & (l2 == b), name)
    return out.otherwise("custom")


def normalise_uri(uri: Column) -> Column:
    """Forward slashes, no leading ``./`` or ``/``."""
    return F.regexp_replace(F.regexp_replace(F.replace(uri, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), "^/+", "")


def tile_x(name: Column) -> Column:
    """Column number in a name such as Tile_+003_-001, wherever it stands."""
    return F.regexp_extract(name, r"(?i)Tile_\+?(-?\d+)_\+?(-?\d+)", 1).try_cast("int")


def tile_y(name: Column) -> Column:
    return F.regexp_extract(name, r"(?i)Tile_\+?(-?\d+)_\+?(-?\d+)", 2).try_cast("int")


def is_tile_folder(name: Column) -> Column:
    """Whether a whole folder name is that of a standard tile."""
    return name.rlike(r"(?i)^Tile_[+-]?\d+_[+-]?\d+$")


def clean_uri(uri: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(uri, "[?#].*$", "")


def is_remote(uri: Column) -> Column:
    return uri.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//|^data:")


def resolve_path(base: Column, uri: Column) -> Column:
    """``base/uri`` with ``.`` and ``..`` taken out; a leading ``..`` stays and shows that the path leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(base, F.lit("")), clean_uri(uri)), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, -1).otherwise(1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).otherwise(step(acc, p))), "/")


def escapes_root(path: Column) -> Column:
    return (path == "..") | path.startswith("../")


def plain_relative(uri: Column) -> Column:
    """A local, relative reference without scheme, query, fragment, backslash or parent steps."""
    return (uri != "") & ~uri.rlike(r"[?#\\:%]") & ~uri.startswith("/") & ~uri.rlike(r"(^|/)\.\.(/|$)")


def is_strict_descendant(path: Column, parent: Column) -> Column:
    return path.startswith(F.concat(F.rtrim(parent, F.lit("/")), F.lit("/"))) & (path != parent)


def is_task_id(value: Column) -> Column:
    """1 to 128 letters, digits, dashes and underscores."""
    return value.rlike(r"^[A-Za-z0-9_-]{1,128}$")


def enu_lat(srs: Column) -> Column:
    """Latitude of an ENU reference; null unless both angles are in range."""
    return _enu(srs, 1)


def enu_lon(srs: Column) -> Column:
    return _enu(srs, 2)


def _enu(srs: Column, group: int) -> Column:
    lat, lon = (F.regexp_extract(srs, ENU, g).try_cast("double") for g in (1, 2))
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), (lat, lon)[group - 1])


def epsg(srs: Column) -> Column:
    return F.regexp_extract(srs, EPSG, 1).try_cast("long")


def crs_class(srs: Column) -> Column:
    """What kind of reference this is, and so its unit."""
    up = F.upper(srs)
    return (
        F.when(srs.isNull(), "missing")
        .when(srs.rlike(ENU), "enu-metres")
        .when(srs.rlike(EPSG), F.when(epsg(srs).isin(*DEGREE_CODES), "epsg-degrees").otherwise("epsg-metres"))
        .when(F.contains(up, F.lit("GEOGCS")) | F.contains(up, F.lit("PROJCS")), "wkt")
        .otherwise("custom")
    )


def origin_xyz(text: Column) -> Column:
    """Three numbers parted by commas, semicolons or white space; else null."""
    parts = F.transform(F.filter(F.split(text, r"[,;\s]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == 3) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), parts)


def effective_crs(override: Column, scanned: Column) -> Column:
    """The override where it says anything, else what the scan found."""
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), F.nullif(F.trim(scanned), F.lit("")))


def material_key(index: Column, colour: Column, texture_hash: Column) -> Column:
    """``mat{i}:r,g,b,a`` or ``default``, with the first 16 letters of the texture's hash where there is one."""
    base = F.when(index.isNull(), "default").otherwise(F.format_string("mat%d:%.3f,%.3f,%.3f,%.3f", index, *(F.get(colour, i) for i in range(4))))
    return F.when(texture_hash.isNull(), base).otherwise(F.concat(base, F.lit("#tex:"), F.substring(texture_hash, 1, 16)))


def material_colour(key: Column) -> Column:
    """The four numbers of a material key; white where it has none."""
    base = F.element_at(F.split(key, "#tex:"), 1)
    parts = F.filter(F.transform(F.split(F.regexp_extract(base, "^[^:]*:(.*)$", 1), ","), lambda p: p.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 4, parts).otherwise(F.array(*[F.lit(1.0)] * 4))


def tag_value(markup: Column, tag: str) -> Column:
    """Trimmed text of the first element of this name; null where absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(markup, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)), F.lit(""))


def percent(completed: Column, total: Column, status: Column | None = None) -> Column:
    """Progress in whole per cent between 0 and 100, 100 for a task that succeeded; null without a total."""
    value = F.when(total > 0, F.least(F.greatest(F.floor(completed * 100.0 / total + 0.5), F.lit(0)), F.lit(100)).cast("int"))
    return value if status is None else F.when(status.isin("completed", "succeeded"), 100).otherwise(value)


def suggest_output(input_path: Column, default_root: Column, suffix: str) -> Column:
    """The input's last name with the suffix (once), under the default root where there is one, else beside the input."""
    trimmed = F.regexp_replace(F.trim(input_path), r"[/\\]+$", "")
    base = F.regexp_extract(trimmed, r"([^/\\]*)$", 1)
    name = F.when(F.lower(base).endswith(suffix.lower()), base).otherwise(F.concat(F.when(base == "", "output").otherwise(base), F.lit(suffix)))
    root = F.regexp_replace(F.trim(F.coalesce(default_root, F.lit(""))), r"[/\\]+$", "")
    parent = F.regexp_replace(trimmed, r"[/\\]?[^/\\]*$", "")
    sep = lambda p: F.when(F.contains(p, F.lit("\\")), "\\").otherwise("/")
    return F.when(trimmed == "", "").when(root != "", F.concat(root, sep(root), name)).when(parent != "", F.concat(parent, sep(trimmed), name)).otherwise(name)


def clone_output(path: Column, stamp: Column) -> Column:
    """The output path of a rerun, marked by a stamp."""
    return F.concat(F.when(path == "", "output").otherwise(F.regexp_replace(path, r"[/\\]$", "")), F.lit("_rerun_"), stamp)


def same_path(a: Column, b: Column) -> Column:
    """Equal but for outer blanks, kind of slash, slashes at the end, and case; an empty path equals none."""
    norm = lambda p: F.lower(F.replace(F.regexp_replace(F.trim(p), r"[/\\]+$", ""), F.lit("\\"), F.lit("/")))
    return (F.trim(a) != "") & (norm(a) == norm(b))


def describe_execution(cpu_asked: Column, cpu: Column, memory_asked: Column, memory: Column, io_asked: Column, io: Column) -> Column:
    """How asked-for resources were resolved; a null was not asked for."""
    workers = F.when(cpu_asked.isNull(), F.format_string("auto → %d", cpu)).when(cpu_asked == cpu, F.format_string("%d (explicit)", cpu)).otherwise(F.format_string("%d (requested) → %d (capped)", cpu_asked, cpu))
    say = lambda asked, got, unit: F.when(asked.isNull(), F.format_string(f"%d{unit} (default)", got)).otherwise(F.format_string(f"%d{unit} (explicit)", asked))
    return F.concat(F.lit("cpu_workers: "), workers, F.lit(", memory_budget: "), say(memory_asked, memory, " MiB"), F.lit(", io_workers: "), say(io_asked, io, ""))


def retry_single_threaded(stderr: Column, exit_code: Column) -> Column:
    """Whether a converter failed in a way that one thread may avoid: its own message, an access violation, or a corrupt heap."""
    return F.coalesce(F.contains(stderr, F.lit("converter returned no JSON for tile:")), F.lit(False)) | F.coalesce(exit_code.isin(-1073741819, -1073740940), F.lit(False))


def byte_tail(text: Column, n: int) -> Column:
    """The last ``n`` bytes of a text, from the next whole code point on."""
    raw = text.cast("binary")
    cut = F.substring(raw, F.greatest(F.octet_length(raw) - n + 1, F.lit(1)), F.lit(n))
    lead = lambda i: F.conv(F.hex(F.substring(cut, i, 1)), 16, 10).cast("int").between(128, 191)
    skip = F.when(F.octet_length(raw) <= n, 0).when(lead(1) & lead(2) & lead(3), 3).when(lead(1) & lead(2), 2).when(lead(1), 1).otherwise(0)
    return F.substring(cut, skip + 1, F.lit(n)).cast("string")
