from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from qirtas.llm import format_duplicates, near_duplicates, split_oversized
from qirtas.llm.shingles import WORD


def shingles(t: str) -> frozenset:
    w = WORD.findall(t.lower())
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)])


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b)


def near_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(140):
        if rows and rng.random() < 0.5:
            _, s, t = rng.choice(rows)
            s, t = (s or "").split(), (t or "").split()
            for side in (s, t):
                for _ in range(rng.randint(0, 3)):
                    if side:
                        side[rng.randrange(len(side))] = rng.choice(words)
            rows.append((i, " ".join(s), " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 40))), " ".join(rng.choices(words, k=rng.randint(1, 30)))))
    return [*rows, (900, None, "a b c"), (901, "a b c", None), (None, "a b c", "a b c"), (902, "", ""), (903, "", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "id bigint, s string, t string").withColumn("token", F.lit(1)).withColumn("class_id", F.lit("x"))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "id", "s", "t").collect()}
    full = [r for r in rows if None not in r]
    sets = {i: (shingles(s), shingles(t)) for i, s, t in full}
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a][0], sets[b][0]) >= 0.5 and jaccard(sets[a][1], sets[b][1]) >= 0.5}
    assert got == want and len(want) > 20


def test_near_duplicates_of_hot_sequences(spark, monkeypatch):
    """Sequences above the block are dealt out over a grid, with the same result."""
    monkeypatch.setattr(near_duplicates, "GRID_BLOCK", 3)
    test_near_duplicates_against_brute_force(spark, 3)


def test_near_duplicates_of_hot_copies_and_empty(spark):
    df = spark.createDataFrame([(i, "one two three four", "five six seven") for i in range(60)], "id bigint, s string, t string")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "id", "s", "t").collect()}
    assert got == {(0, i) for i in range(1, 60)}
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "id", "s", "t").count() == 0


def test_near_duplicates_of_hot_variants(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CLASS_BLOCK", 16)
    variants = [(i, "one two three four" + "." * i, "five six seven") for i in range(60)]
    others = [(100 + i, "one two three four five", "five six seven") for i in range(3)]
    df = spark.createDataFrame(variants + others, "id bigint, s string, t string")
    got = near_duplicates.near_duplicate_pairs(df, "id", "s", "t").collect()
    ids = [r[0] for r in variants + others]
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, b) for a in ids for b in ids if a < b}
    copies = [(200 + i, "One two three four", "five six seven") for i in range(55)]
    df = df.unionByName(spark.createDataFrame(copies, df.schema))
    ids += [r[0] for r in copies]
    want = {(a, b) for a in ids for b in ids if a < b}
    got = near_duplicates.near_duplicate_pairs(df, "id", "s", "t").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, b) for a, b in want if a <= 200}
    got = near_duplicates.near_duplicate_pairs(df, "id", "s", "t", expand_limit=None).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_format_duplicates(spark):
    rows = [(1, "A b", None), (2, "a-B ", None), (3, "a b", ""), (4, "ab.", "!"), (5, "ba", None), (6, None, None), (7, None, None), (8, "x", "y"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "k bigint, member_id string, b string")
    got = sorted(tuple(r) for r in format_duplicates.format_duplicate_groups(df, "k", ["member_id", "b"]).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (6, 6, 2), (7, 6, 2)]
    kept = {r.k: r.n_copies for r in format_duplicates.collapse_format_duplicates(df.where("k is not null"), "k", ["member_id", "b"]).collect()}
    assert kept == {1: 2, 3: 2, 5: 1, 6: 2, 8: 1}
    assert format_duplicates.format_duplicate_groups(df.limit(0), "k", ["b"]).count() == 0


def check_pieces(text: str, pieces: list[tuple[int, int]], limit: int, overlap: int) -> None:
    def tokens(i, j):
        a = len(re.findall("[؀-ۿ]", text[i:j]))
        return max(1, a // 2 + (j - i - a) // 4)

    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(tokens(*p) <= limit for p in pieces)
    assert all(tokens(b[0], a[1]) == overlap for a, b in zip(pieces, pieces[1:], strict=False))


@pytest.mark.parametrize("range_chars", [1 << 16, 9000])
def test_split_oversized(spark, range_chars):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["word", "كلمة", "end.", "نهاية؟", "\n\n", "汉字。"], k=12000)), "x" * 30000, "short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    rows = split_oversized.split_oversized(df, "n", "body", range_chars=range_chars).collect()
    assert {r.id for r in rows} == {0, 1}
    for i in (0, 1):
        own = sorted((r.piece_no, r.piece_start, r.piece_end, r.piece_text, r.n_pieces) for r in rows if r.id == i)
        assert [o[0] for o in own] == list(range(len(own))) and {o[4] for o in own} == {len(own)}
        assert all(texts[i][s:e] == t for _, s, e, t, _ in own)
        check_pieces(texts[i], [o[1:3] for o in own], 512, 64)
    with pytest.raises(ValueError):
        split_oversized.split_oversized(df, "n", "body", limit=0)


def test_split_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_oversized, "HALO_CHARS", 200)
    rng = random.Random(5)
    texts = {"a": " ".join(rng.choices(["word", "كلمة", "end.", "نهاية؟", "\n\n", "汉字。", "😀"], k=9000)), "b": "x" * 9000, "c": "short", "d": "", "e": "ก" * 300 + " " + "ข" * 4000}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, encoding="utf-8", newline="")
    rows = split_oversized.split_files(spark, str(tmp_path), range_bytes=3000).collect()
    for name, t in texts.items():
        own = sorted((r.piece_no, r.piece_start, r.piece_end, r.piece_text, r.n_pieces) for r in rows if r.id.endswith("/" + name))
        assert [o[0] for o in own] == list(range(len(own))) and bool(own) == bool(t)
        assert all(t[s:e] == piece and n == len(own) for _, s, e, piece, n in own)
        if t:
            check_pieces(t, [o[1:3] for o in own], 512, 64)
    with pytest.raises(ValueError):
        split_oversized.split_files(spark, str(tmp_path), range_bytes=5)


def test_rechunk_offsets(spark):
    text = ("Sentence number one is here. " * 200).strip()
    rows = [("a_0", "short", "l", None, "en", 0, 0, 5), ("a_1", text, "l", None, "en", 1, 6, 6 + len(text)), ("a_2", None, "l", None, "en", 2, 9000, 9001)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, law_slug string, article string, lang string, chunk_idx int, char_start int, char_end int")
    out = sorted(split_oversized.rechunk(df).collect(), key=lambda r: r.chunk_idx)
    assert [r.chunk_idx for r in out] == list(range(len(out))) and len(out) > 3
    assert all(text[r.char_start - 6 : r.char_end - 6] == r.text for r in out if r.was_split)
