"""Filling training sequences of a fixed capacity: patterns fitted by non-negative least squares, then residuals."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.plans.lineage import written
from qirtas.plans.skew import numbered

#: Vocabulary file of a public byte-level tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that tokenizer splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
#: Items of at least capacity / LARGE tokens make the patterns, by classes of capacity / CLASSES tokens; smaller ones fill what is left, by exact length.
LARGE, CLASSES = 8, 256
#: Patterns of three documents and more that are enumerated.
PATTERNS = 4000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file of base64 tokens and ranks; one per worker."""
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens``; a null text has none."""

    # The vocabulary file travels to the executors, which needn't have one of their own.
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = Path(tokenizer).name

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        own = encoder(SparkFiles.get(name))
        return pd.Series(np.array([len(own.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in texts], dtype=np.int32))

    return df.select(df[key].cast("bigint").alias("doc_id"), count(df[text]).alias("n_tokens"))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by accelerated projected gradients."""
    x = np.zeros(a.shape[1])
    v = np.random.default_rng(0).random(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-30
    step = 1 / (np.linalg.norm(a.T @ (a @ v)) + 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def _patterns(sizes: list[int], top: int) -> list[tuple[int, ...]]:
    """Few-document patterns of class sizes that fill ``top``: pairs, then triples and quadruples, evenly thinned to a bound."""
    have = set(sizes)
    pairs = [(i, j) for i in sizes for j in range(max(1, top - i - 2), min(i, top - i) + 1) if j in have]
    triples = [(i, j, top - i - j) for i in sizes for j in sizes if j <= i and top - i - j <= j and top - i - j in have]
    quads = [(i, j, k, top - i - j - k) for i in sizes for j in sizes if j <= i for k in sizes if k <= j and top - i - j - k <= k and top - i - j - k in have]
    thin = lambda x, n: x[:: max(1, -(-len(x) // n))]
    return [(i,) for i in sizes] + pairs + thin(triples, PATTERNS // 2) + thin(quads, PATTERNS // 2)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups ``(repeats, {key: items of that key in each container})`` that use up the histogram of item lengths.

    A key is an exact length below capacity / LARGE, else minus the class (its
    upper bound in units). Works on counts per length, so its cost depends on the
    capacity alone, not on the number of documents.
    """
    unit = max(1, capacity // CLASSES)
    top, least = capacity // unit, capacity // LARGE
    big: dict[int, int] = {}
    small: dict[int, int] = {}
    for length, n in histogram.items():
        if length >= least:
            big[-(-length // unit)] = big.get(-(-length // unit), 0) + n
        else:
            small[length] = small.get(length, 0) + n
    # A class may reach beyond the capacity where the unit doesn't divide it; such an item stands alone.
    groups: list[list] = []

    def add(repeats: int, content: dict[int, int], free: int) -> None:
        groups.append([repeats, content, free])

    sizes = sorted(big)
    patterns = [p for p in _patterns(sizes, top) if sum(p) <= top] if sizes else []
    if patterns:
        row = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(patterns)))
        for k, p in enumerate(patterns):
            for s in p:
                a[row[s], k] += 1
        counts = np.array([big[s] for s in sizes], dtype=float)
        # Fuller patterns cost nothing, a document alone is the last resort.
        a_fit = a * np.array([1.0 if len(p) > 1 else 0.3 for p in patterns])
        x = nnls(a_fit / max(1.0, counts.max()), counts / max(1.0, counts.max()))
        for k in sorted(range(len(patterns)), key=lambda k: (-x[k], k)):
            p = patterns[k]
            if len(p) < 2:
                continue
            need = {s: p.count(s) for s in p}
            repeats = min(int(x[k]), *(big[s] // m for s, m in need.items()))
            if repeats > 0:
                for s, m in need.items():
                    big[s] -= m * repeats
                add(repeats, {-s: m for s, m in need.items()}, capacity - unit * sum(p))
    # Residuals: first fit decreasing on counts; every step uses up a class.
    while any(big.values()):
        content: dict[int, int] = {}
        left = top
        for s in sorted((s for s, n in big.items() if n), reverse=True):
            m = min(left // s, big[s]) if content or s <= top else 1
            if m:
                content[s] = m
                left -= m * s
        repeats = min(big[s] // m for s, m in content.items())
        for s, m in content.items():
            big[s] -= m * repeats
        add(repeats, {-s: m for s, m in content.items()}, max(0, capacity - unit * sum(s * m for s, m in content.items())))
    # Short items fill what is left, the longest that fits first; then containers of their own.
    out: list[tuple[int, dict[int, int]]] = []
    queue = sorted(groups, key=lambda g: -g[2])
    while queue or any(small.values()):
        repeats, content, free = queue.pop() if queue else (sum(small.values()), {}, capacity)
        fresh, content, filled = not content, dict(content), False
        for s in sorted((s for s, n in small.items() if n and s <= free), reverse=True):
            m = min(free // s, small[s] // repeats) if not fresh else min(free // s, small[s])
            if m:
                content[s] = m
                free -= m * s
                if fresh:
                    repeats = small[s] // m if not filled else min(repeats, small[s] // m)
                filled = True
        if fresh:
            repeats = max(1, min(small[s] // m for s, m in content.items()))
        elif not filled:
            # Too few of any length for all repeats: serve a part of them, the rest later.
            rest = [s for s, n in small.items() if n and s <= free]
            if rest and repeats > 1:
                part = max(min(small[s], repeats - 1) for s in rest)
                queue.append((repeats - part, content, free))
                queue.append((part, content, free))
                continue
        for s, m in content.items():
            if s > 0:
                small[s] -= m * repeats
        out.append((repeats, content))
    return out


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``token_start``, ``token_end``, ``sequence_id`` for rows of ``doc_id``, ``n_tokens``.

    No sequence holds more than ``capacity`` tokens. Only a document longer than
    that is cut, into full sequences and one remainder that is packed like others.
    A histogram of at most ``capacity`` lengths goes to the driver, whatever the
    number of documents; the plan made of it is bounded by the capacity too.
    Documents take their places by rank within their length, hot lengths
    numbered over many tasks. A document without tokens gets sequence 0, which it
    doesn't fill; a repeated id is another item; a null id too.
    """
    spark = lengths.sparkSession
    pieces = lengths.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.col("n"), (F.col("piece") + 1) * capacity).alias("token_end"))
    pieces = pieces.withColumn("length", F.col("token_end") - F.col("token_start"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram.pop(0, None)
    unit, least = max(1, capacity // CLASSES), capacity // LARGE
    groups = plan(histogram, capacity)
    # For each key: from which rank on which group's containers take its items.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for repeats, content in groups:
        for key, m in content.items():
            slots.setdefault(key, []).append((used.get(key, 0), first, repeats))
            used[key] = used.get(key, 0) + m * repeats
        first += repeats
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for key, at in b.groupby("key").indices.items():
                if key:
                    start, container, repeats = shared.value[key]
                    rank = b["rank"].to_numpy()[at]
                    k = np.searchsorted(start, rank, side="right") - 1
                    out[at] = container[k] + (rank - start[k]) % repeats[k]
            b["sequence_id"] = out
            yield b[["doc_id", "piece", "token_start", "token_end", "sequence_id"]]

    keyed = pieces.withColumn("key", F.when(F.col("length") >= least, -F.ceil(F.col("length") / unit)).otherwise(F.col("length")).cast("int"))
    ranked = numbered(keyed.drop("length"), ["key"], ["doc_id", "piece"], "rank")
    return ranked.mapInPandas(place, "doc_id bigint, piece int, token_start int, token_end int, sequence_id bigint")


def pack_documents(documents: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """:func:`pack` for texts, measured once in tokens of a public tokenizer."""
    return pack(written(with_tokens(documents, key, text, tokenizer), "token-counts"), capacity)
