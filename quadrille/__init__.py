"""Quadrille: analytics over tiled 3D datasets, task logs and text corpora, on Spark."""

__version__ = "0.1.0"
