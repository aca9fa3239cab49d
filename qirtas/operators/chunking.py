"""Chunking articles: leaf spans as arrays, token sums by prefix, chunk borders by binary search. One document is one unit of work."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# What ends a sentence, and what a paragraph is.
PIECE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+$")
PARAGRAPH = re.compile(r"(?s)[^\n](?:(?!\n\n).)*")
ARABIC_FIRST, ARABIC_LAST = 0x600, 0x6FF
#: Characters of a token in text that is mostly Arabic, and in other text.
CHARS_PER_TOKEN = (2, 4)


class Leaves:
    """The smallest spans of a text that chunks are made of, with their tokens."""

    def __init__(self, text: str, target: int):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.arabic = np.concatenate([[0], np.cumsum((codes >= ARABIC_FIRST) & (codes <= ARABIC_LAST))])
        paragraphs = np.array([m.span() for m in PARAGRAPH.finditer(text)], dtype=np.int64).reshape(-1, 2)
        long = self.tokens(paragraphs) > target
        inside = [m.span() for s, e in paragraphs[long].tolist() for m in PIECE.finditer(text, s, e)]
        sentences = np.array(inside, dtype=np.int64).reshape(-1, 2)
        spans = np.concatenate([paragraphs[~long], self._cut(sentences, target)])
        self.spans = spans[np.argsort(spans[:, 0], kind="stable")]

    def tokens(self, spans: np.ndarray) -> np.ndarray:
        arabic = self.arabic[spans[:, 1]] - self.arabic[spans[:, 0]]
        return np.maximum(1, arabic // 2 + (spans[:, 1] - spans[:, 0] - arabic) // 4)

    def _cut(self, spans: np.ndarray, target: int) -> np.ndarray:
        """Spans above ``target`` tokens in steps of so many tokens' characters, by the script of more than half of them."""
        size = spans[:, 1] - spans[:, 0]
        arabic = self.arabic[spans[:, 1]] - self.arabic[spans[:, 0]]
        step = np.where(self.tokens(spans) <= target, np.maximum(size, 1), target * np.where(2 * arabic > size, *CHARS_PER_TOKEN))
        parts = -(-size // step)
        owner = np.repeat(np.arange(len(spans)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = spans[owner, 0] + nth * step[owner]
        return np.stack([start, np.minimum(start + step[owner], spans[owner, 1])], axis=1)


def leaves(text: str, target: int) -> list[tuple[int, int]]:
    """Spans of paragraphs; of their sentences where a paragraph is too long; of fixed steps where a sentence is."""
    return [tuple(x) for x in Leaves(text, target).spans.tolist()]


def pack(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of consecutive leaves of at most ``target`` tokens; each begins with the last leaves of the one before, of at most ``overlap`` tokens.

    A text within the target is one chunk. A chunk may exceed the target by what it
    repeats, since it always takes one new leaf.
    """
    if target <= 0 or overlap < 0:
        raise ValueError("target must be positive, overlap not negative")
    own = Leaves(text, target)
    if own.tokens(np.array([[0, len(text)]]))[0] <= target:
        return [(0, len(text))]
    before = np.concatenate([[0], np.cumsum(own.tokens(own.spans))])
    out, first, fresh, n = [], 0, 0, len(own.spans)
    while fresh < n:
        # One past the last leaf: as many as the target holds, the fresh one at least.
        end = max(fresh + 1, int(np.searchsorted(before, before[first] + target, side="right")) - 1)
        out.append((int(own.spans[first, 0]), int(own.spans[end - 1, 1])))
        first, fresh = max(first, int(np.searchsorted(before, before[end] - overlap, side="left"))), end
    return out


def _rows(articles: DataFrame, key: list[str], text: str, spans, columns: dict[str, str], fields) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], *fields(r[:-1], r[-1], i, s, e)) for r in b.itertuples(index=False, name=None) for i, (s, e) in enumerate(spans(r[-1]))]
            yield pd.DataFrame(rows, columns=[*b.columns[:-1], *columns])

    base = articles.select(*[articles[k] for k in key], articles[text].alias("_text")).where("_text <> ''")
    kinds = [f"{k} {articles.schema[k].dataType.simpleString()}" for k in key]
    return base.mapInPandas(cut, ", ".join([*kinds, *(f"{c} {t}" for c, t in columns.items())]))


def leaf_units(articles: DataFrame, key: list[str], text: str, target: int = 512) -> DataFrame:
    """``key`` columns, ``pos``, ``char_start``, ``char_end`` of the leaves of every text. Null and empty texts have none."""
    return _rows(articles, key, text, lambda t: leaves(t, target), {"pos": "int", "char_start": "int", "char_end": "int"}, lambda k, t, i, s, e: (i, s, e))


def chunk_articles(articles: DataFrame, key: list[str], text: str, target: int = 512, overlap: int = 64, offset: str | None = None) -> DataFrame:
    """``key`` columns, ``chunk_id`` (their values and the number, joined by '_'), ``chunk_idx``, ``char_start``, ``char_end``, ``text``.

    Offsets count from the text's first character, or from the place in its file
    that column ``offset`` names (one of ``key``). Null and empty texts have no
    chunk; a null in a key is written as nothing.
    """
    pack("", target, overlap)
    at = None if offset is None else key.index(offset)
    named = [i for i in range(len(key)) if i != at]

    def fields(k: tuple, t: str, i: int, s: int, e: int) -> tuple:
        base = 0 if at is None or k[at] is None else int(k[at])
        return "_".join([*("" if k[j] is None else str(k[j]) for j in named), str(i)]), i, base + s, base + e, t[s:e]

    columns = {"chunk_id": "string", "chunk_idx": "int", "char_start": "int", "char_end": "int", "text": "string"}
    return _rows(articles, key, text, lambda t: pack(t, target, overlap), columns, fields)
