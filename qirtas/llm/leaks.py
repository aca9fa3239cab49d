"""Held-out passages that appear in training documents: n-gram seeds, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qirtas.llm.shingles import finish, word_hashes
from qirtas.plans.lineage import written
from qirtas.plans.skew import join_groups

#: Words of a seed, and of a run that counts as found.
SEED_WORDS = 8
RUN_WORDS = 15
#: Bits of the seed bitmap that every worker holds, whatever the number of test items.
BITMAP_BITS = 1 << 22
#: Words kept on either side of the seeds of a document passage.
MARGIN = 40
#: Rows looked at together, and pairs aligned together.
BLOCK, PAIRS = 512, 256

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word's place in its row, hash) of all n-word sequences, and where rows begin among all words."""
    rows, place, grams, _, starts = _grams_and_words(texts, n)
    return rows, place, grams, starts


def _grams_and_words(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, starts = word_hashes(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(starts))
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), h, starts
    acc = np.zeros(size, np.uint64)
    for k in range(n):
        acc = (acc ^ (acc >> np.uint64(31))) * _MUL + h[k : k + size]
    inside = np.flatnonzero(rows[:size] == rows[n - 1 :])
    return rows[inside], inside - starts[rows[inside]], finish(acc[inside]).view(np.int64), h, starts


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) % np.uint64(BITMAP_BITS)).astype(np.int64)


def longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest common run of words."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(b):
        at.setdefault(w, []).append(i)
    best, row = 0, {}
    for w in a:
        row = {j: row.get(j - 1, 0) + 1 for j in at.get(w, ())}
        if row:
            best = max(best, max(row.values()))
    return best


def smith_waterman(a: list[str], b: list[str], match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> float:
    """Score of the best local alignment of two word sequences."""
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a])
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    if not len(x) or not len(y):
        return 0.0
    row, best, steps = np.zeros(len(y) + 1), 0.0, gap * np.arange(len(y) + 1)
    for w in x:
        diagonal = row[:-1] + np.where(y == w, match, mismatch)
        new = np.concatenate([[0.0], np.maximum(0.0, np.maximum(diagonal, row[1:] + gap))])
        # Gaps along the row: a running maximum of the scores without the gap's slope.
        row = np.maximum(new, np.maximum.accumulate(new - steps) + steps)
        best = max(best, float(row.max()))
    return best


def align_pairs(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`longest_run` and :func:`smith_waterman` of many pairs of word sequences (hashes, none negative), step by step for all of a block."""
    runs, scores = np.zeros(len(passages), np.int32), np.zeros(len(passages))
    # Both are symmetric, so the shorter side of each pair is stepped through.
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(passages, items, strict=True)]
    order = sorted(range(len(sides)), key=lambda i: (len(sides[i][0]) // 16, len(sides[i][1])))
    for at in range(0, len(order), PAIRS):
        own = order[at : at + PAIRS]
        high, wide = (max(len(sides[i][k]) for i in own) for k in (0, 1))
        # Whole numbers of the smallest kind that holds every score; a pair is a column.
        kind = np.int16 if 2 * (high + wide) < np.iinfo(np.int16).max else np.int32
        x, y = np.full((len(own), high), -1, np.int32), np.full((len(own), wide), -2, np.int32)
        for k, i in enumerate(own):
            for m, words in zip((x, y), sides[i], strict=True):
                m[k, : len(words)] = words
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        row, new, run, best, longest = (np.zeros((wide + 1, len(own)), kind) for _ in range(5))
        steps = np.arange(wide + 1, dtype=kind)[:, None]
        same, step = np.zeros(y.shape, bool), np.zeros(y.shape, kind)
        for k in range(high):
            np.equal(y, x[k], out=same)
            np.add(run[:-1], kind(1), out=step)
            np.multiply(step, same, out=run[1:])
            np.maximum(longest, run, out=longest)
            # As in smith_waterman: match 2, mismatch and gap -1.
            np.multiply(same, kind(3), out=step)
            step += row[:-1]
            np.maximum(step, row[1:], out=step)
            step -= kind(1)
            np.maximum(step, 0, out=new[1:])
            new[1:] += steps[1:]
            np.maximum.accumulate(new, axis=0, out=row)
            row -= steps
            np.maximum(best, row, out=best)
        runs[own], scores[own] = longest.max(0), best.max(0)
    return runs, scores


def _short(h: np.ndarray) -> np.ndarray:
    """Word hashes as whole numbers of 31 bits, none negative, which is how passages travel."""
    return (h >> np.uint64(33)).astype(np.int32)


def leaks(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, least_run: int = SEED_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``run_words``, ``score`` of every document passage seeded by a test item.

    ``run_words`` is the longest unbroken run of words that passage and item
    share, ``score`` their Smith-Waterman alignment as a share of the item's best
    possible one, ``matched`` what it is worth in matching words (half of it).
    Documents are scanned once: word 8-grams pass a fixed-size bitmap of the items'
    8-grams, and only the passages around hits move on, as hashed words. Every
    document that shares an unbroken run of ``least_run`` words with an item has a
    row for it: among the 8-grams of each window of so many item words, the one
    that is rarest over all documents is a seed. At 8, the least, and in items of
    fewer than ``least_run`` words, every 8-gram is one, so edited and partial
    copies are aligned whatever else holds their words; an edit nearer than eight
    words to the next on all sides leaves no seed. Seeds join by their hash, the
    most frequent ones through a bounded broadcast.
    Nulls and texts of fewer than 8 words give no row. Repeated documents each
    give theirs; a repeated key merges.
    """
    if least_run < SEED_WORDS:
        raise ValueError(f"least_run must be at least {SEED_WORDS}")
    spark = documents.sparkSession
    item_rows = items.select(items[item_key].cast("bigint").alias("item_id"), items[item_text].alias("item_text")).where("item_id is not null and item_text is not null")

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, place, h, _ = _grams(b["item_text"].tolist(), SEED_WORDS)
            yield pd.DataFrame({"item_id": b["item_id"].to_numpy()[rows], "place": place.astype(np.int32), "gram": h})

    def item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, starts = word_hashes(b["item_text"].tolist())
            yield pd.DataFrame({"item_id": b["item_id"], "item": [_short(h[s:e]).tobytes() for s, e in zip(starts, starts[1:], strict=False)]})

    grams = written(item_rows.mapInPandas(item_grams, "item_id bigint, place int, gram bigint"), "item-grams")
    slots = grams.select(F.col("gram")).distinct().mapInPandas(lambda it: (pd.DataFrame({"slot": _slot(b["gram"].to_numpy())}) for b in it), "slot bigint").distinct().toArrow()["slot"].to_numpy()
    bitmap = np.zeros(BITMAP_BITS, bool)
    bitmap[slots] = True
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(shared.value).astype(bool)
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                b = whole.iloc[at : at + BLOCK]
                texts = b["text"].tolist()
                rows, place, h, words, starts = _grams_and_words(texts, SEED_WORDS)
                hit = np.flatnonzero(known[_slot(h)])
                out = []
                if len(hit):
                    rows, place, h = rows[hit], place[hit], h[hit]
                    # A new passage begins where the document changes or hits lie far apart.
                    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (place[1:] - place[:-1] > MARGIN)]))
                    for s, e in zip(new, [*new[1:], len(rows)], strict=True):
                        r = int(rows[s])
                        first, last = max(0, int(place[s]) - MARGIN), int(place[e - 1]) + SEED_WORDS + MARGIN
                        own = words[starts[r] + first : min(starts[r + 1], starts[r] + last)]
                        out.append((b["doc_id"].iloc[r], first, _short(own).tobytes(), h[s:e], (place[s:e] - first).astype(np.int32)))
                yield pd.DataFrame(out, columns=["doc_id", "first_word", "passage", "grams", "places"])

    docs = documents.select(documents[doc_key].cast("bigint").alias("doc_id"), documents[text].alias("text")).where("doc_id is not null and text is not null")
    found = written(docs.mapInPandas(passages, "doc_id bigint, first_word int, passage binary, grams array<bigint>, places array<int>"), "passages")
    hits = found.select("doc_id", "first_word", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("doc_id", "first_word", F.col("h.grams").alias("gram"), F.col("h.places").alias("place"))
    # How many passages hold each 8-gram: a row per 8-gram of the items (or of a bitmap collision), counted over all documents.
    frequency = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = grams.join(frequency, "gram")
    if least_run == SEED_WORDS:
        seeds = counted.select("item_id", "gram", "n")
    else:
        # Windows slide over the 8-grams that occur; one that lacks some of its 8-grams is no unbroken run.
        width = least_run - SEED_WORDS + 1
        window = Window.partitionBy("item_id").orderBy("place").rowsBetween(0, width - 1)
        rarest = counted.select("item_id", F.min(F.struct("n", "gram")).over(window).alias("r"), (F.max("place").over(window) - F.col("place") + 1).alias("_span"), F.count(F.lit(1)).over(window).alias("_n"))
        size = grams.groupBy("item_id").agg(F.count(F.lit(1)).alias("_size")).where(f"_size < {width}")
        small = counted.join(size, "item_id", "left_semi").select("item_id", "gram", "n")
        seeds = rarest.where(f"_span = {width} and _n = {width}").select("item_id", F.col("r.gram").alias("gram"), F.col("r.n").alias("n")).unionByName(small)
    groups = seeds.groupBy("gram").agg(F.collect_set("item_id").alias("_items"), F.max("n").alias("n"))
    met = join_groups(hits, groups, "gram", "n").select("doc_id", "first_word", "place", F.explode("_items").alias("item_id"))
    pairs = met.groupBy("doc_id", "first_word", "item_id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    texts = item_rows.mapInPandas(item_words, "item_id bigint, item binary")
    joined = pairs.join(found.select("doc_id", "first_word", "passage"), ["doc_id", "first_word"]).join(texts, "item_id")

    @F.pandas_udf("run_words int, matched double, score double")
    def aligned(passage: pd.Series, item: pd.Series, places: pd.Series) -> pd.DataFrame:
        a, b, owner = [], [], []
        for k, (p, w, at) in enumerate(zip(passage, item, places, strict=True)):
            words, own = np.frombuffer(p, np.int32), np.frombuffer(w, np.int32)
            # Seeds that lie far apart are aligned one by one.
            ends = [*(np.flatnonzero(np.diff(at) > 2 * MARGIN) + 1), len(at)]
            for s, e in zip([0, *ends], ends, strict=False):
                a.append(words[max(0, at[s] - MARGIN) : at[e - 1] + SEED_WORDS + MARGIN])
                b.append(own)
                owner.append(k)
        runs, scores = np.zeros(len(passage), np.int32), np.zeros(len(passage))
        for best, found in zip((runs, scores), align_pairs(a, b), strict=True):
            np.maximum.at(best, owner, found)
        lengths = np.array([max(1, len(w) // 4) for w in item], float)
        return pd.DataFrame({"run_words": runs, "matched": scores / 2.0, "score": scores / (2.0 * lengths)})

    scored = joined.select("doc_id", "item_id", aligned("passage", "item", "places").alias("s"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("s.run_words").alias("run_words"), F.max("s.matched").alias("matched"), F.max("s.score").alias("score"))
