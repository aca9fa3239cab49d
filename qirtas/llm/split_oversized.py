"""Cutting oversized texts at natural boundaries, in ranges with halos."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qirtas.functions.text import approx_token_count
from qirtas.plans.lineage import written
from qirtas.plans.skew import prefix_sums

#: Characters of one range; a longer text is cut by several workers.
RANGE_CHARS = 1 << 16
#: How far a range looks beyond its end for the boundary where the next one takes over.
HALO_CHARS = 1 << 12

PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
SENTENCE = re.compile(r"""[.!?؟…]+["'”’»)\]]*\s+|[。！？]+["'”’»）」』]*\s*|\n+""")
SPACE = re.compile(r"\s+")


def boundaries(text: str) -> list[np.ndarray]:
    """Ascending cut places after paragraphs, sentences and spaces, best kind first."""
    return [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in (PARAGRAPH, SENTENCE, SPACE)]


class _Measure:
    """Token counts of spans by prefix sums of Arabic and other characters."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        arabic = (codes >= 0x600) & (codes <= 0x6FF)
        self.a = np.concatenate([[0], np.cumsum(arabic)])
        self.b = np.arange(len(codes) + 1) - self.a

    def tokens(self, i: int, j: int) -> int:
        return max(1, int(self.a[j] - self.a[i]) // 2 + int(self.b[j] - self.b[i]) // 4)

    def last_end(self, i: int, limit: int, top: int) -> int:
        """Largest j <= top with at most ``limit`` tokens in [i, j)."""
        low, high = i, top
        while low < high:
            mid = (low + high + 1) // 2
            if self.tokens(i, mid) <= limit:
                low = mid
            else:
                high = mid - 1
        return low

    def last_start(self, j: int, least: int) -> int:
        """Largest i >= 0 with at least ``least`` tokens in [i, j); 0 if there is none."""
        low, high = 0, j
        while low < high:
            mid = (low + high + 1) // 2
            if self.tokens(mid, j) >= least:
                low = mid
            else:
                high = mid - 1
        return low


def cut(text: str, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of ``text`` that cover [begin, end): each of at most ``limit`` tokens and overlapping the one before by ``overlap``.

    A piece ends after the last paragraph in its second half, else after the last
    sentence there, else the last space, else at the limit. The first piece also
    reaches back by the overlap unless it is the text's first.
    """
    measure, kinds = _Measure(text), boundaries(text)
    pieces: list[tuple[int, int]] = []
    done = begin
    while done < end:
        start = measure.last_start(done, overlap) if done and overlap else done
        stop = measure.last_end(start, limit, end)
        if stop < end:
            floor = max(done, start + (stop - start) // 2)
            for at in kinds:
                k = int(np.searchsorted(at, stop, side="right")) - 1
                if k >= 0 and at[k] > floor:
                    stop = int(at[k])
                    break
        stop = max(stop, done + 1)
        pieces.append((start, stop))
        done = stop
    return pieces


def _takeover(text: str, at: int, top: int) -> int:
    """Where the range that begins at ``at`` takes over: the first sentence boundary in its halo, else the last space there, else the halo's end."""
    end = min(at + HALO_CHARS, top)
    window = text[at:end]
    if m := SENTENCE.search(window):
        return at + m.end()
    spaces = [m.end() for m in SPACE.finditer(window)]
    return at + spaces[-1] if spaces else end


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 64, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of every text over ``limit`` tokens: ``id``, ``piece_no``, ``n_pieces``, ``piece_start``, ``piece_end``, ``piece_text``.

    Offsets count code points from 0 within the text, ends exclusive. Consecutive
    pieces overlap by ``overlap`` tokens (see :func:`cut`). A text longer than
    ``range_chars`` is cut by several workers: each sees one range with halos,
    finds by itself the boundaries where it takes over and hands on, and emits
    pieces by offset; prefix sums over the ranges' piece counts number them. The
    task that reads the row holds its text once; texts that should not be held whole
    stay in files, see :func:`split_files`. Null texts and texts within the limit give
    no row; an empty text has one token.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap in [0, limit)")
    left = 8 * overlap + 8

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"], strict=True):
                for k in range((len(t) - 1) // range_chars + 1):
                    at = max(0, k * range_chars - left)
                    out.append((i, k, at, len(t), t[at : (k + 1) * range_chars + HALO_CHARS]))
            yield pd.DataFrame(out, columns=["id", "range_no", "at", "length", "text"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, k, at, length, t in b.itertuples(index=False):
                begin = _takeover(t, k * range_chars - at, len(t)) if k else 0
                end = len(t) if (k + 1) * range_chars >= length else _takeover(t, (k + 1) * range_chars - at, len(t))
                for n, (x, y) in enumerate(cut(t, begin, end, limit, overlap)):
                    out.append((i, k, n, at + x, at + y, t[x:y]))
            yield pd.DataFrame(out, columns=["id", "range_no", "n", "piece_start", "piece_end", "piece_text"])

    kind = df.schema[id_col].dataType.simpleString()
    over = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(approx_token_count(F.col("text")) > limit)
    short = over.where(F.length("text") <= range_chars)
    long = over.where(F.length("text") > range_chars)
    schema = f"id {kind}, range_no int, at int, length int, text string"
    parts = short.select("id", F.lit(0).alias("range_no"), F.lit(0).alias("at"), F.length("text").alias("length"), "text")
    parts = parts.unionByName(long.mapInPandas(ranges, schema).repartition("id", "range_no"))
    found = written(parts.mapInPandas(pieces, f"id {kind}, range_no int, n int, piece_start int, piece_end int, piece_text string"), "pieces")
    return _numbered(found)


def _numbered(found: DataFrame) -> DataFrame:
    """Pieces of ranges (``id, range_no, n, ...``) numbered over their text by prefix sums of how many each range has."""
    counts = found.groupBy("id", "range_no").agg(F.count(F.lit(1)).alias("n_here"))
    whole = Window.partitionBy("id")
    before = counts.select("id", "range_no", (F.sum("n_here").over(whole.orderBy("range_no")) - F.col("n_here")).alias("before"), F.sum("n_here").over(whole).alias("n_pieces"))
    numbered = found.join(before, ["id", "range_no"])
    return numbered.select("id", (F.col("before") + F.col("n")).cast("int").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), "piece_start", "piece_end", "piece_text")


#: Bytes of a range of a file. A character has at most four bytes.
RANGE_BYTES, WIDEST = 1 << 25, 4


def _read(path: str, start: int, end: int) -> bytes:
    """Bytes [start, end) of a file on any file system that pyarrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(end - start)


def _leads(data: bytes) -> np.ndarray:
    """Places of the bytes that begin a character of UTF-8."""
    codes = np.frombuffer(data, np.uint8)
    return np.flatnonzero((codes & 0xC0) != 0x80)


def split_files(spark: SparkSession, path: str, limit: int = 512, overlap: int = 64, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of UTF-8 text files of any size: ``id`` (the path), ``piece_no``, ``n_pieces``, ``piece_start``, ``piece_end``, ``piece_text``.

    No file is read whole. Workers read ranges of bytes: a first pass tells how many
    characters begin in each range and, from a halo behind its start, where it takes
    over from the one before; these boundary tables, a row per range, are stitched by
    prefix sums, which turn places in a range into offsets in the file. A second pass
    reads each range with its halos and emits the pieces between its own boundary and
    the next one's. Offsets count characters. A file within the limit is one piece,
    an empty one none. Bytes that are no UTF-8 are an error.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap in [0, limit)")
    if range_bytes < WIDEST * HALO_CHARS:
        raise ValueError(f"a range must have at least {WIDEST * HALO_CHARS} bytes")
    halo = WIDEST * (HALO_CHARS + 1)
    back = WIDEST * (8 * overlap + 9)
    # Only names and lengths of the files are looked at here.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select(F.col("path").alias("id"), "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / range_bytes))).alias("range_no")).repartition("id", "range_no")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, length, k in b[["id", "length", "range_no"]].itertuples(index=False):
                start = k * range_bytes
                data = _read(i, start, min(start + range_bytes + halo, length))
                leads = _leads(data)
                first, n = int(leads[0]) if len(leads) else 0, int((leads < range_bytes).sum())
                # The halo's end may cut a character in two.
                window = data[first : int(leads[min(HALO_CHARS, len(leads) - 1)])] if len(leads) > HALO_CHARS else data[first:]
                text = window.decode("utf-8")
                out.append((i, k, length, n, _takeover(text, 0, len(text)) if k else 0))
            yield pd.DataFrame(out, columns=["id", "range_no", "length", "n_chars", "takes_over"])

    found = written(ranges.mapInPandas(tables, "id string, range_no bigint, length bigint, n_chars bigint, takes_over bigint"), "boundaries")
    order = Window.partitionBy("id").orderBy("range_no")
    stitched = found.select("id", "range_no", "length", "takes_over", (F.sum("n_chars").over(order) - F.col("n_chars")).alias("at"), F.lead("takes_over").over(order).alias("next"), "n_chars")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, k, length, own, at, after, n in b[["id", "range_no", "length", "takes_over", "at", "next", "n_chars"]].itertuples(index=False):
                start = max(0, k * range_bytes - back)
                data = _read(i, start, min((k + 1) * range_bytes + halo, length))
                leads = _leads(data)
                origin = int((leads < k * range_bytes - start).sum())
                last = origin + n + (HALO_CHARS if after == after else 0)
                text = data[int(leads[0]) : int(leads[last]) if last < len(leads) else len(data)].decode("utf-8")
                end = origin + n + int(after) if after == after else len(text)
                for m, (x, y) in enumerate(cut(text, origin + own, end, limit, overlap)):
                    out.append((i, k, m, at - origin + x, at - origin + y, text[x:y]))
            yield pd.DataFrame(out, columns=["id", "range_no", "n", "piece_start", "piece_end", "piece_text"])

    spread = written(stitched, "stitched").repartition("id", "range_no")
    return _numbered(written(spread.mapInPandas(pieces, "id string, range_no bigint, n int, piece_start bigint, piece_end bigint, piece_text string"), "file-pieces"))


def rechunk(chunks: DataFrame, limit: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks with the oversized ones replaced by their pieces.

    Takes ``chunk_id, text, law_slug, article, lang, chunk_idx, char_start`` and
    returns these columns with ``char_end``, ``source_chunk_id`` and ``was_split``.
    Pieces get the offsets of their article; ``chunk_idx`` is renumbered over each
    (law_slug, article, lang), null a value like any other, in the old order. A
    split chunk's pieces are called chunk_id, '#' and their number. A chunk with a
    null text stays as it is.
    """
    keys = ["law_slug", "article", "lang"]
    pieces = split_oversized(chunks, "chunk_id", "text", limit, overlap)
    base = chunks.select("chunk_id", "text", *keys, "chunk_idx", "char_start", "char_end")
    joined = base.join(pieces.withColumnRenamed("id", "chunk_id"), "chunk_id", "left")
    # New numbers: the old place plus the pieces added before it, by prefix sums over chunks that split hot articles.
    sizes = joined.groupBy("chunk_id", *keys, "chunk_idx", "char_start").agg(F.max(F.coalesce("n_pieces", F.lit(1))).alias("_size"))
    last = F.lit((1 << 31) - 1)
    placed = sizes.select("chunk_id", *keys, F.coalesce("chunk_idx", last).alias("_i"), F.coalesce("char_start", last).alias("_s"), "_size")
    first = prefix_sums(placed, keys, ["_i", "_s", "chunk_id"], F.col("_size"), "_first").select("chunk_id", "_first")
    split = F.col("piece_no").isNotNull()
    return joined.join(first, "chunk_id").select(
        F.when(split, F.concat_ws("#", "chunk_id", "piece_no")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.col("chunk_id").alias("source_chunk_id"),
        F.when(split, F.col("piece_text")).otherwise(F.col("text")).alias("text"),
        *keys,
        (F.col("_first") + F.coalesce("piece_no", F.lit(0))).cast("int").alias("chunk_idx"),
        F.when(split, F.col("char_start") + F.col("piece_start")).otherwise(F.col("char_start")).alias("char_start"),
        F.when(split, F.col("char_start") + F.col("piece_end")).otherwise(F.col("char_end")).alias("char_end"),
        split.alias("was_split"),
    )
