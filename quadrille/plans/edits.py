"""Clipping and flattening whole tilesets: edited contents, and the documents around them written anew.

Tiles of all documents make one tree: the root of an external document hangs on the tile that refers to it. Boxes and errors
go up this tree by one aggregate over (ancestor, content) rows; each document's text is then edited by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import matrix as M
from quadrille.functions import text as T
from quadrille.operators import contents, features, region, tree, validate
from quadrille.operators.lineage import cut
from quadrille.sources import binary, tileset


def plain(path: Column) -> Column:
    """A path without its file scheme, as sources spell it in different ways."""
    return F.regexp_replace(path, "^file:/+", "/")


def linked(tiles: DataFrame, root_doc: str) -> DataFrame:
    """Tiles of all documents that the root document reaches: id, parent_id (across documents), path, world, and the columns of ``tiles``.

    A document or content that two tiles refer to would need two edits under one name, so it is refused, and so are tiles with
    several contents.
    """
    own = cut(tiles.filter("loc IS NOT NULL").withColumn("uri", F.coalesce("uri", "legacy_url")).withColumn("target", F.when(F.col("uri").isNotNull(), F.concat(F.lit("/"), T.resolve_path(plain(F.col("base")), T.normalise_uri(F.col("uri")))))))
    refs = own.filter(F.lower("target").endswith(".json")).select(plain(F.col("target")).alias("file"), F.col("loc").alias("from"))
    repeated = validate.repeated_documents(own.filter("target IS NOT NULL").select(F.col("target").alias("resolved"))).select("path").take(1)
    if repeated:
        raise ValueError(f"more than one tile refers to {repeated[0].path}")
    several = own.filter("n_contents > 0").select("loc").take(1)
    if several:
        raise ValueError(f"contents[] is unsupported: {several[0].loc}")
    at_root = plain(F.col("doc")) == plain(F.lit(root_doc))
    rows = own.withColumn("file", plain(F.col("doc"))).join(refs, "file", "left").withColumn("parent_id", F.coalesce("parent_loc", F.when(~at_root, F.col("from")))).withColumnRenamed("loc", "id")
    rows = cut(rows.filter(F.col("parent_id").isNotNull() | at_root))
    walk = tree.flatten(rows.select("id", "parent_id"))
    world = tree.with_world(rows.select("id", "parent_id", "transform")).select("id", "world")
    return cut(rows.join(walk.select("id", "path"), "id").join(world, "id"))


def rewritten(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Document texts in which only the kept tiles are left: docs (path, text), kept (doc, id, box, ge, has_content); path, text.

    A kept tile gets its box and error, and loses its content where ``has_content`` is false; all else stays as it was. A
    document without kept tiles is left out. One document's rows meet in one row, which its own text bounds.
    """
    per = kept.groupBy("doc").agg(F.collect_list(F.struct("id", "box", "ge", "has_content")).alias("tiles"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, tiles in zip(batch["path"], batch["text"], batch["tiles"], strict=True):
                doc, known = json.loads(text), {t["id"]: t for t in tiles}
                todo = [(doc["root"], f"{path}#root")]
                while todo:
                    tile, loc = todo.pop()
                    new = known[loc]
                    tile["boundingVolume"], tile["geometricError"] = {"box": [float(v) for v in new["box"]]}, float(new["ge"])
                    if not new["has_content"]:
                        tile.pop("content", None)
                    children = [(c, f"{loc}/children[{i}]") for i, c in enumerate(tile.pop("children", []))]
                    left = [c for c in children if c[1] in known]
                    if left:
                        tile["children"] = [c for c, _ in left]
                    todo += left
                # An error that is no number counts as none.
                own = doc.get("geometricError")
                doc["geometricError"] = max(float(own) if isinstance(own, (int, float)) else 0.0, doc["root"]["geometricError"])
                rows.append((path, json.dumps(doc, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return docs.join(per, docs["path"] == per["doc"]).select("path", "text", "tiles").mapInPandas(run, "path string, text string")


def edit_tileset(spark: SparkSession, folder: str, root_doc: str, where: dict | str, height: float | None = None) -> dict[str, DataFrame]:
    """A whole tileset cut to a region, or (with ``height``) flattened to it inside the region.

    Gives ``documents`` (path, text), ``contents`` (as ``contents.edited`` does), ``files`` (path below the folder, content: the
    documents, the edited contents, and where flattened the contents out of reach as they are), ``counters`` and ``errors``
    (contents that can't be read; their tiles keep content and box, and nothing should be written while there are any).
    Tiles without content below are left out; where nothing is left there are no documents. Boxes are in the tile's frame and
    hold all content below; errors are never below those of contents below. Tiles without a box are always read. Documents with
    features that an edit would break (several contents, implicit tiling, metadata classes, required extensions) are refused.
    """
    area = region.parse(where)
    docs = tileset.documents(spark, folder)
    refused = docs.select("path", features.document_fault(F.col("text"), "tileset").alias("fault"), F.coalesce(F.get_json_object("text", "$.asset.gltfUpAxis"), F.lit("Y")).alias("axis"))
    bad = refused.filter("fault IS NOT NULL OR axis <> 'Y'").agg(F.min(F.struct("path", F.coalesce("fault", F.lit("contents must be Y up")).alias("fault"))).alias("first")).first().first
    if bad:
        raise ValueError(f"unsupported document {bad.path}: {bad.fault}")
    all_ = linked(tileset.tiles(docs), root_doc)
    is_content = F.col("target").isNotNull() & ~F.lower("target").endswith(".json")
    wanted = all_.filter(is_content).select("id", F.col("target").alias("file"), "box", F.col("world").alias("transform"))
    near = contents.in_reach(wanted.filter("box IS NOT NULL"), area).union(wanted.filter("box IS NULL"))
    payloads = binary.binary_files(spark, folder).withColumn("file", plain(F.col("path")))
    done = cut(contents.edited(payloads.join(near.select("file", "transform"), "file"), area, height))
    # Own boxes after the edit: of what was made, or as before where nothing was read or could be read.
    made = done.select(plain(F.col("path")).alias("target"), F.col("box").alias("new_box"), F.col("content").isNotNull().alias("made"), F.col("error").isNotNull().alias("failed"))
    seen = all_.join(made, "target", "left")
    stays = F.when(is_content, F.coalesce(F.col("made") | F.col("failed"), F.lit(height is not None))).otherwise(False)
    own = cut(seen.withColumn("has_content", stays).withColumn("own_box", F.when(F.col("has_content"), F.coalesce("new_box", "box"))))
    hull = M.box_aabb(F.col("own_box"), F.col("world"))
    placed = F.when(F.col("own_box").isNotNull(), M.let(lambda h: M.aabb_box([F.get(h, i) for i in range(3)], [F.get(h, i + 3) for i in range(3)]), hull))
    left = cut(contents.pruned(own.select("id", "path", F.coalesce("ge", F.lit(0.0)).alias("ge"), placed.alias("box"))))
    kept = left.select("id", "ge", F.col("box").alias("world_box")).join(own.drop("ge", "box"), "id")
    inner = kept.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.lit(True).alias("inner")).distinct()
    box = F.when(F.col("inner").isNull() & F.col("own_box").isNotNull(), F.col("own_box")).otherwise(M.box_to_local(F.col("world_box"), F.col("world")))
    refers = F.coalesce(F.lower("target").endswith(".json"), F.lit(False))
    final = kept.join(inner, "id", "left").select("doc", "id", box.alias("box"), "ge", (F.col("has_content") | refers).alias("has_content"))
    new_docs = rewritten(docs, final)
    root = plain(F.lit(folder.rstrip("/") + "/"))
    below = lambda p: F.replace(plain(p), root, F.lit(""))
    files = new_docs.select(below(F.col("path")).alias("path"), F.col("text").cast("binary").alias("content")).union(done.filter("content IS NOT NULL").select(below(F.col("path")), "content"))
    if height is not None:
        untouched = own.filter("has_content AND made IS NULL").select(F.col("target").alias("file"))
        files = files.union(payloads.join(untouched, "file", "left_semi").select(below(F.col("path")), "content"))
    return {"documents": new_docs, "contents": done, "files": files, "counters": contents.counters(done), "errors": done.filter("error IS NOT NULL").select("path", "error")}
