"""Cutting long texts into overlapping chunks, packed from paragraphs and sentences."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where paragraphs end, and where sentences do.
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。！？])\s+")


def cut_down(text: str, most: int) -> list[str]:
    """Pieces of at most so many characters: each coarser way of cutting is left for a finer one only where it must be."""
    by_pattern = lambda pattern: lambda piece: [x for x in map(str.strip, pattern.split(piece)) if x]
    by_force = lambda piece: re.findall(f"(?s).{{1,{most}}}", piece)
    ways = (by_pattern(PARAGRAPH), by_pattern(SENTENCE), by_force)
    return reduce(lambda pieces, way: [x for p in pieces for x in (way(p) if len(p) > most else [p])], ways, [text])


def chunks(text: str, most: int = 1000, overlap: int = 100) -> list[str]:
    """Chunks of at most so many characters; each begins with the end of the one before, where it fits."""
    if most < 1 or not 0 <= overlap < most:
        raise ValueError("0 <= overlap < most")
    pieces = [x for x in cut_down((text or "").strip(), most) if x]

    def packed(done: list[str], piece: str) -> list[str]:
        # Three ways to go on, the first that fits: in the last chunk, after its end in a new one, alone.
        last = done[-1]
        grown, after = f"{last}\n{piece}", f"{last[-overlap:]} {piece}".strip() if overlap else piece
        if len(grown) <= most:
            done[-1] = grown
        else:
            done.append(after if len(after) <= most else piece)
        return done

    return reduce(packed, pieces[1:], pieces[:1])


def chunk_documents(docs: DataFrame, most: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, text, ...) to one row per chunk: id ``parent#i``, parent_id, chunk, text and the other columns."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks(x, most, overlap) for x in texts], dtype=object)

    rest = [c for c in docs.columns if c not in ("id", "text")]
    exploded = docs.select(F.col("id").cast("string").alias("parent_id"), F.posexplode(cut("text")).alias("chunk", "text"), *rest)
    return exploded.select(F.concat_ws("#", "parent_id", F.col("chunk").cast("string")).alias("id"), "parent_id", "chunk", "text", *rest)
