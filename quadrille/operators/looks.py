"""Materials that can be compared and moved between documents: their texture references are replaced by the images themselves."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from quadrille.sources import binary

KTX2, KTX2_EXTENSION = "image/ktx2", "KHR_texture_basisu"


def _textures(value: object, change: Callable[[dict], dict], name: str = "") -> object:
    """A copy of a material in which every texture reference is changed."""
    if isinstance(value, dict):
        if name.endswith("Texture") and "index" in value:
            return change(value)
        return {k: _textures(v, change, k) for k, v in value.items()}
    return [_textures(v, change) for v in value] if isinstance(value, list) else value


def look_of(glb: bytes) -> Callable[[int | None], tuple[dict | None, dict[str, tuple[str, bytes]]]]:
    """For a GLB a function from material number to the material, its textures named by their images' hashes, and those images (mime, bytes)."""
    doc, blob = binary.split_glb(glb)
    doc = binary.readable(doc)
    kept, data = binary.looks(doc, blob)

    def of(index: int | None) -> tuple[dict | None, dict[str, tuple[str, bytes]]]:
        if index is None:
            return None, {}
        found: dict[str, tuple[str, bytes]] = {}

        def change(info: dict) -> dict:
            texture = kept["textures"][info["index"]]
            place = {k: v for k, v in info.items() if k != "index"}
            if "sampler" in texture:
                place["sampler"] = kept["samplers"][texture["sampler"]]
            if "source" in texture:
                image = kept["images"][texture["source"]]
                if (raw := data[texture["source"]]) is not None:
                    place["image"] = sha256(raw).hexdigest()
                    found[place["image"]] = (image.get("mimeType", ""), raw)
                else:
                    place["uri"] = image.get("uri")
            return place

        return _textures(kept["materials"][index], change), found

    return of


def _extensions(value: object) -> set[str]:
    """Names of all extensions within a JSON value."""
    if isinstance(value, dict):
        own = set(value["extensions"]) if isinstance(value.get("extensions"), dict) else set()
        return own.union(*(_extensions(v) for v in value.values()))
    return set().union(*(_extensions(v) for v in value)) if isinstance(value, list) else set()


def packed(primitives: list[dict], images: dict[str, tuple[str, bytes]]) -> bytes:
    """A GLB of primitives whose ``look`` is a material as ``look_of`` gives it; equal materials, textures, samplers and images are there once.

    Images that are missing from ``images`` are left out with their textures.
    """
    look: dict[str, list] = {"materials": [], "textures": [], "samplers": [], "images": []}
    data: list[bytes | None] = []
    numbers: dict[str, int] = {}

    def number(part: str, value: dict, raw: bytes | None = None) -> int:
        if value in look[part] and raw is None:
            return look[part].index(value)
        look[part].append(value)
        if part == "images":
            data.append(raw)
        return len(look[part]) - 1

    def image_number(place: dict) -> int | None:
        if "image" in place:
            if place["image"] not in numbers and place["image"] in images:
                mime, raw = images[place["image"]]
                numbers[place["image"]] = number("images", {"mimeType": mime} if mime else {}, raw)
            return numbers.get(place["image"])
        return number("images", {"uri": place["uri"]}) if place.get("uri") else None

    def change(place: dict) -> dict | None:
        source = image_number(place)
        if source is None:
            return None
        ktx2 = look["images"][source].get("mimeType") == KTX2
        texture = {"extensions": {KTX2_EXTENSION: {"source": source}}} if ktx2 else {"source": source}
        if "sampler" in place:
            texture["sampler"] = number("samplers", place["sampler"])
        return {k: v for k, v in place.items() if k not in ("image", "uri", "sampler")} | {"index": number("textures", texture)}

    def clean(value: object) -> object:
        return {k: clean(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else value

    for p in primitives:
        # Textures named by an image that is gone leave no reference.
        p["material"] = None if p["look"] is None else number("materials", clean(_textures(named(p["look"]), change)))
    used = sorted(_extensions(look["materials"]) | _extensions(look["textures"]))
    document = {k: v for k, v in look.items() if v} | ({"extensionsUsed": used} if used else {}) | ({"extensionsRequired": [KTX2_EXTENSION]} if KTX2_EXTENSION in used else {})
    if "images" in document:
        return binary.write_glb(primitives, (document, data))
    return binary.write_glb(primitives, (document, []))


def named(value: object, name: str = "") -> object:
    """Texture places get an ``index`` again, so that they are found."""
    if isinstance(value, dict):
        out = {k: named(v, k) for k, v in value.items()}
        return out | {"index": -1} if name.endswith("Texture") and ("image" in value or "uri" in value) else out
    return [named(v) for v in value] if isinstance(value, list) else value
