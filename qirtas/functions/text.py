"""Column builders for text scalars; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Arabic block, fixed value.
ARABIC_BLOCK = r"[\u0600-\u06FF]"


def count_matching(text: Column, char_class: str) -> Column:
    """How many characters of ``text`` are in ``char_class``; null for null."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def approx_token_count(text: Column) -> Column:
    """max(1, arabic // 2 + other // 4), two separate floors; null for null."""
    arabic = count_matching(text, ARABIC_BLOCK)
    return F.greatest(F.lit(1), F.floor(arabic / 2) + F.floor((F.length(text) - arabic) / 4)).cast("int")

#: Vowel marks and tatweel that Arabic normalisation deletes, and letters it folds. Fixed values.
ARABIC_NOISE = r"[ً-ْـ]"
ARABIC_FOLD = ("أإآى", "اااي")
TRAILING_MARKS = r"""[.,;:!?)\]}"']+$"""


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_arabic(text: Column) -> Column:
    """Vowel marks and tatweel deleted, alef and ya variants folded."""
    return F.translate(F.regexp_replace(text, ARABIC_NOISE, ""), *ARABIC_FOLD)


def normalize_english(text: Column) -> Column:
    """Lower case, collapsed spaces, trailing marks removed."""
    return F.trim(F.regexp_replace(collapse_spaces(F.lower(text)), TRAILING_MARKS, ""))


def normalize(text: Column, lang: Column) -> Column:
    """By language; an unknown language is an error, a null text or language gives null."""
    unknown = F.raise_error(F.concat(F.lit("no normaliser for language "), lang)).cast("string")
    return F.when(lang == "ar", normalize_arabic(text)).when(lang == "en", normalize_english(text)).when(lang.isNull(), F.lit(None).cast("string")).otherwise(unknown)


def article_number(text: Column) -> Column:
    return F.lower(collapse_spaces(text))


def detect_direction(text: Column) -> Column:
    """'ar-en' if the Arabic block has at least as many characters as ASCII letters, else 'en-ar'; ties and empty texts are 'ar-en'."""
    return F.when(is_arabic_dominant(text), "ar-en").otherwise("en-ar")


def is_arabic_dominant(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return count_matching(text, ARABIC_BLOCK) >= count_matching(text, "[A-Za-z]")


def languages(direction: Column) -> tuple[Column, Column]:
    parts = F.split(direction, "-")
    return parts[0], parts[1]


def script_warning(text: Column, direction: Column) -> Column:
    """Whether a translation is in the wrong script: into English with over 20 % Arabic words, or into Arabic with over 80 % Latin and no Arabic words. Other directions are not checked."""
    words = F.filter(F.split(collapse_spaces(text), " "), lambda w: w != "")
    arabic = F.size(F.filter(words, lambda w: w.rlike(ARABIC_BLOCK)))
    latin = F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]") & ~w.rlike(ARABIC_BLOCK)))
    n = F.size(words)
    bad = F.when(direction == "ar-en", arabic / n > 0.2).when(direction == "en-ar", (latin / n > 0.8) & (arabic == 0)).otherwise(F.lit(False))
    return F.when(n > 0, bad).otherwise(F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct 3-character windows of the lower-cased text padded with a space; a text of one or two characters is its own, an empty one has none."""
    # Binding the text to a lambda's variable computes it once, not once per window.
    def of(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t, F.lit(" "))
        # Every window starts at an offset below three: three lists of consecutive triples, cut by the regular expression engine.
        windows = F.array_distinct(F.concat(*[F.regexp_extract_all(F.substring(padded, k, F.length(padded)), F.lit("(?s)..."), F.lit(0)) for k in (F.lit(1), F.lit(2), F.lit(3))]))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < 3, F.array(t)).otherwise(windows)

    return F.transform(F.array(F.lower(collapse_spaces(text))), of)[0]


# What must not be translated, in this order: addresses, mail addresses, placeholders, tags, variables, header codes, numbers.
PROTECTED = [
    r"https?://[^\s<>\"']+",
    r"[\w.+-]+@[\w-]+\.[\w.-]+",
    r"\$\{[^}]+\}",
    r"\{[^}]+\}",
    r"<[A-Za-z_][\w.-]*>",
    r"%[A-Za-z_][\w]*%",
    r"&[A-Za-z0-9\"&]",
    r"(?<![\w/])-?\d+(?:,\d{3})*(?:\.\d+)?(?![\w/])",
]


def mask_protected(text: Column) -> Column:
    """Protected tokens replaced by a mark, without numbering; letters and digits of any script are word characters."""
    for pattern in PROTECTED:
        text = F.regexp_replace(text, pattern.replace(r"\w", r"\p{L}\p{N}_").replace(r"\d", r"\p{Nd}"), "⟦⟧")
    return text


def xml_escape(text: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def safe_zip_entry(name: Column) -> Column:
    """Relative names without backslashes or parent segments."""
    return (name != "") & ~name.startswith("/") & ~name.contains("\\") & ~F.array_contains(F.split(name, "/"), "..")


def host_allowed(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))


def is_page_number(block: Column) -> Column:
    return block.rlike(r"^[0-9\s,.\-]+$")


def model_name(name: Column) -> Column:
    """Names without a tag get ':latest'."""
    return F.when(F.instr(name, ":") > 0, name).otherwise(F.concat(name, F.lit(":latest")))


def redact(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("***"))


def sentence_pieces(text: Column) -> Column:
    """Pieces up to and with [.!?] and the space behind; they concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]+\s*|[^.!?]+$"), F.lit(0))
