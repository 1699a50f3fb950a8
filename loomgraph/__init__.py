"""Typed, span-grounded knowledge graphs as ordinary DataFrames: dimension algebra, coordinates, graph search, staleness and text rules."""

__version__ = "0.1.0"
