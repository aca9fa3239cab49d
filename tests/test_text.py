from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.functions import text as T
from qirtas.functions.protect import protect_one, restore_one
from qirtas.operators.chunking import leaves, pack


def tokens(text):
    arabic = sum("\u0600" <= c <= "\u06ff" for c in text)
    return max(1, arabic // 2 + (len(text) - arabic) // 4)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalize(spark):
    cases = [("العَقْد", "العقد"), ("العـــقد", "العقد"), ("محامى", "محامي"), ("أإآ", "ااا")]
    for given_, wanted in cases:
        assert one(spark, T.normalize_arabic(F.lit(given_))) == wanted
    for given_ in ("contract   of\t sale", "Contract of Sale", "contract of sale."):
        assert one(spark, T.normalize_english(F.lit(given_))) == "contract of sale"
    assert one(spark, T.normalize_english(F.lit(None).cast("string"))) is None


def test_token_count_and_direction(spark):
    for given_, wanted in (("A" * 100, 25), ("ع" * 100, 50), ("ع" * 40 + "A" * 80, 40), ("", 1)):
        assert one(spark, T.approx_token_count(F.lit(given_))) == wanted
        assert tokens(given_) == wanted
    for given_, wanted in (("عقد", "ar-en"), ("sale", "en-ar"), ("", "ar-en"), ("123", "ar-en"), ("ab عق", "ar-en"), (None, "ar-en")):
        assert one(spark, T.detect_direction(F.lit(given_).cast("string"))) == wanted


def test_trigrams(spark):
    assert one(spark, T.trigrams(F.lit(""))) == []
    assert one(spark, T.trigrams(F.lit("Ab"))) == ["ab"]
    assert one(spark, T.trigrams(F.lit(" abc "))) == [" ab", "abc", "bc "]


def test_script_warning(spark):
    assert one(spark, T.script_warning(F.lit("عقد بيع here"), F.lit("ar-en"))) is True
    assert one(spark, T.script_warning(F.lit("sale contract"), F.lit("en-ar"))) is True
    assert one(spark, T.script_warning(F.lit("عقد"), F.lit("en-ar"))) is False
    assert one(spark, T.script_warning(F.lit(" "), F.lit("en-ar"))) is False
    assert one(spark, T.script_warning(F.lit("sale contract"), F.lit("fr-ar"))) is False


def test_predicates(spark):
    assert one(spark, T.safe_zip_entry(F.lit("a/b.xml"))) is True
    for bad in ("", "/a", "a\\b", "a/../b"):
        assert one(spark, T.safe_zip_entry(F.lit(bad))) is False
    assert one(spark, T.host_allowed(F.lit("https://a.b/c"), ["a.b"])) is True
    assert one(spark, T.host_allowed(F.lit("no url"), ["a.b"])) is False
    assert one(spark, T.xml_escape(F.lit("a<b&c>"))) == "a&lt;b&amp;c&gt;"


def test_protection():
    masked, kept = protect_one("{x} and {x} and 148 and 148")
    assert len(kept) == 2 and masked.count("\x00T0\x00") == 2 and restore_one(masked, kept) == "{x} and {x} and 148 and 148"
    cases = {"a < b and c > d": [], "{}": [], "12a a12 -3,000.5 1/2": ["-3,000.5"], "<b.x> &A &&": ["<b.x>", "&A", "&&"], "a@b.c-d": ["a@b.c-d"], "%x1%": ["%x1%"], "٣٤ ع٣": ["٣٤"]}
    for text, want in cases.items():
        assert protect_one(text)[1] == want and restore_one(*protect_one(text)) == text
    assert restore_one("a \x00T7\x00", []) == "a "


@given(st.text(max_size=80).filter(lambda t: "\x00" not in t))
@settings(max_examples=100, deadline=None)
def test_protection_round_trip(text):
    assert restore_one(*protect_one(text)) == text


def greedy(text, target, overlap):
    """Chunks by adding leaf after leaf."""
    if tokens(text) <= target:
        return [(0, len(text))]
    own = [(s, e, tokens(text[s:e])) for s, e in leaves(text, target)]
    out, k, first = [], 0, 0
    while k < len(own):
        end = k + 1
        while end < len(own) and sum(x[2] for x in own[first : end + 1]) <= target:
            end += 1
        out.append((own[first][0], own[end - 1][1]))
        back = end
        while back > first and sum(x[2] for x in own[back - 1 : end]) <= overlap:
            back -= 1
        k, first = end, back
    return out


@given(st.lists(st.sampled_from(["word ", "stop. ", "عقد ", "\n", "\n\n", "why?! ", "x" * 30]), max_size=120), st.integers(3, 40), st.integers(0, 12))
@settings(max_examples=150, deadline=None)
def test_packing_against_greedy(parts, target, overlap):
    text = "".join(parts)
    assert pack(text, target, overlap) == greedy(text, target, overlap)


def test_leaves():
    assert leaves("\na b\n\n\nc\n", 100) == [(1, 4), (7, 9)]
    # As many Arabic characters as others: steps of four characters a token.
    assert leaves("عع" * 8 + "aa" * 8, 2) == [(0, 8), (8, 16), (16, 24), (24, 32)]
    assert leaves("ع" * 9, 2) == [(0, 4), (4, 8), (8, 9)] and leaves("", 5) == []


def test_packing_of_chunks():
    text = ("x" * 62 + ". ") * 75
    pieces = pack(text, 512, 64)
    assert len(pieces) == 3
    assert [tokens(text[b[0] : a[1]]) for a, b in zip(pieces, pieces[1:], strict=False)] == [64, 64]
    assert pack("", 512, 64) == [(0, 0)]
