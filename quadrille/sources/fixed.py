"""Lists of fixed values that come as text files beside the code."""

from __future__ import annotations

from importlib import resources


def lines(name: str) -> tuple[str, ...]:
    """The lines of ``data/<name>.txt`` without comments."""
    text = resources.files("quadrille").joinpath(f"data/{name}.txt").read_text("utf-8")
    return tuple(x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#"))
