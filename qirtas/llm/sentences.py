"""Sentence boundaries across languages and scripts by a maximum-entropy model of candidate boundaries."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm.lookalikes import mapping
from qirtas.llm.sampling import smallest_hashes

#: Rows of each table whose texts train the model, and the longest text taken. A bound on the driver's work; all rows are segmented.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 8000

# Fixed values.
TERMINATORS = ".!?؟…"
CJK_TERMINATORS = "。！？"
CLOSERS = "\"'”’»)\\]」』）"
QUOTES = re.compile(r"“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")
BLANK = re.compile(r"\n[^\S\n]*\n")
BOUND = re.compile(
    rf"(?P<blank>\s*\n[^\S\n]*\n\s*)|(?P<term>[{TERMINATORS}]+[{CLOSERS}]*)[\u00ad\u200b-\u200f\u2060\ufeff]*(?=\s|$)|(?P<cjk>[{CJK_TERMINATORS}]+[{CLOSERS}]*)"
    r"|(?P<thai>(?<=[ก-๛])[   -  　]+(?=[^\s\d๐-๙])|(?<=[^\s\d๐-๙])[   -  　]+(?=[ก-๛]))"
)
NEXT = re.compile(r"[\s\u00ad\u200b-\u200f\u2060\ufeff]*([\"'“‘«(\[「『]*)(\S*)")
MARK = re.compile(r"[(\[]?[^\W\d_]{1,2}[)\]]$|[(\[][^\W_]{1,4}[)\]]$")
EDGE = "\"'“”‘’«»()[]{},;:،؛「」『』"
DIGIT = re.compile(r"\d")
TAIL = re.compile(r"\S*\Z")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LOOK = str.maketrans(dict(zip(*mapping(), strict=True)))
THAI = re.compile("[ก-๛]")


def mask_quotes(text: str) -> str:
    """Text of the same length with the inside of quotations blanked out, but for a terminator before the closing mark."""
    if not any(q in text for q in "“«「『\""):
        return text

    def blank(m: re.Match) -> str:
        inner = m[0][1:-1]
        if BLANK.search(inner):
            return m[0]
        end = inner.rstrip()[-1:]
        kept = end if end and end in TERMINATORS + CJK_TERMINATORS else "q"
        return m[0][0] + "q" * (len(inner) - 1) + kept * bool(inner) + m[0][-1]

    return QUOTES.sub(blank, text)


def _plain(token: str) -> str:
    """A token with look-alike letters and widths mapped and invisible characters removed, so that odd spellings meet."""
    return token if token.isascii() else INVISIBLE.sub("", token.translate(_LOOK))


def _before(text: str, at: int) -> str:
    """The token that ends at ``at``, without edge marks, in lower case; numbers as '#'."""
    token = _plain(TAIL.search(text, max(0, at - 40), at)[0]).strip(EDGE)[-24:]
    return "#" if DIGIT.search(token) else token.lower()


def _after(text: str, at: int) -> tuple[str, str]:
    """(kind, token) of what follows ``at``."""
    m = NEXT.match(text, at)
    opener, token = m[1], _plain(m[2][:24])
    full = opener + token
    if not full:
        return "end", ""
    if MARK.match(full.rstrip(",;:")) and opener:
        return "mark", "()"
    if full[0] in ",;:،؛":
        return "comma", ""
    bare = token.strip(EDGE)
    if DIGIT.match(bare):
        return "number", "#"
    letters = bare.rstrip(".")
    if len(letters) == 1 and bare.endswith("."):
        return "initial", letters.lower()
    kind = "upper" if bare[:1].isupper() else "lower" if bare[:1].islower() else "other"
    if opener and opener[0] in "\"“«「『":
        return "quote-" + kind, "q"
    return kind, bare.rstrip(TERMINATORS)


class Model:
    """Weights and token statistics; small, so it travels with the tasks."""

    def __init__(self, dotted: dict[str, float], starts: dict[str, float], weights: dict[str, float]):
        self.dotted, self.starts, self.weights = dotted, starts, weights
        self.cache: dict[tuple, bool] = {}

    def __getstate__(self):
        return {"dotted": self.dotted, "starts": self.starts, "weights": self.weights, "cache": {}}

    def _class(self, token: str) -> str:
        if not token:
            return "none"
        if token == "#":
            return "number"
        if "qq" in token:
            return "quote"
        if "." in token:
            return "dots"
        if len(token) == 1:
            return "initial"
        return "abbreviation" if len(token) <= 7 and self.dotted.get(token, 0.0) > 0.85 else "word"

    def features(self, prev: str, mark: str, kind: str, token: str) -> list[str]:
        """Neighbouring tokens, their case, length, digits and script, and what the statistics say of them."""
        before = self._class(prev)
        start = self.starts.get(token)
        begin = "unseen" if start is None else str(min(5, int(start * 6)))
        sign = "!?" if mark[0] in "!?؟" else "..." if len(mark) > 1 and mark[:2] == ".." or mark[0] == "…" else "."
        closed = "closed" if mark[-1] not in TERMINATORS else "open"
        script = "none" if not prev or not prev[0].isalpha() else "latin" if prev[0] < "ɐ" else "other"
        return [
            "bias", f"b={before}", f"k={kind}", f"s={begin}", f"m={sign}", f"c={closed}", f"p={prev}", f"n={token}", f"l={min(len(prev), 8)}", f"x={script}",
            f"b,k={before},{kind}", f"b,s={before},{begin}", f"m,k={sign},{kind}", f"m,s={sign},{begin}", f"c,k={closed},{kind}", f"c,s={closed},{begin}", f"b,x={before},{script}", f"b,k,s={before},{kind},{begin}",
        ]

    def ends(self, prev: str, mark: str, kind: str, token: str) -> bool:
        if kind in ("end", "comma"):
            return kind == "end"
        key = (prev, mark, kind, token)
        known = self.cache.get(key)
        if known is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            known = self.cache[key] = sum(self.weights.get(f, 0.0) for f in self.features(*key)) > 0
        return known


def reliable_label(model: Model, prev: str, mark: str, kind: str, token: str, paragraph_end: bool) -> int | None:
    """1 and 0 where the surroundings leave no doubt, else None."""
    before, start = model._class(prev), model.starts.get(token, 0.0)
    if paragraph_end:
        return 1
    if kind in ("lower", "comma"):
        return 0
    closed = mark[-1] not in TERMINATORS
    if closed and before == "quote":
        return 1 if kind in ("upper", "mark") or start > 0.5 else 0 if start < 0.1 and kind == "other" else None
    if mark[0] in "!?؟":
        return 1
    if before in ("abbreviation", "initial") and kind in ("number", "initial"):
        return 0
    if before in ("abbreviation", "initial", "dots") and kind in ("upper", "other") and start < 0.1:
        return 0
    if kind == "mark" and before in ("word", "number", "dots"):
        return 1
    if before in ("word", "number") and kind in ("upper", "quote-upper"):
        return 1
    if before in ("word", "number") and kind in ("other", "quote-other") and (start > 0.3 or kind != "other"):
        return 1
    if before in ("abbreviation", "dots") and kind in ("upper", "other") and start > 0.6:
        return 1
    if mark[:2] == ".." or mark[0] == "…":
        return 0 if kind == "other" and start < 0.1 else None
    return None


def _candidates(text: str) -> Iterator[tuple[int, str, str, str, str, bool]]:
    masked = mask_quotes(text)
    for m in BOUND.finditer(masked):
        if m.lastgroup == "term":
            rest = masked[m.end() :]
            gap = rest[: len(rest) - len(rest.lstrip())]
            yield m.end(), _before(masked, m.start()), m["term"], *_after(masked, m.end()), bool(BLANK.search(gap))


def train(texts: Iterable[str], rounds: int = 80) -> Model:
    """Fit token statistics and maximum-entropy weights on the candidates whose label is reliable."""
    texts = list(texts)
    with_dot, without, begins, total = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        masked = mask_quotes(t)
        for paragraph in BLANK.split(masked):
            tokens = paragraph.split()
            fresh, after_comma = True, False
            for w in tokens:
                bare = w.strip(EDGE)
                core = bare.rstrip(".!?؟…")
                low = core.lower()
                joined, after_comma = after_comma, w[-1] in ",;:،؛"
                if DIGIT.search(core):
                    fresh = bare != core and w[-1] in TERMINATORS
                    continue
                if low:
                    # A token behind a comma says nothing on whether it may begin a sentence.
                    total[core] += not joined
                    begins[core] += fresh
                    (with_dot if bare.endswith(".") else without)[low] += 1
                ended = bare != core and w[-1] in TERMINATORS
                # After a long word that is mostly seen without a point, a point ends the sentence.
                fresh = (ended and len(core) >= 4 and "." not in core and without[low] > with_dot[low]) or (fresh and MARK.match(w) is not None)
    dotted = {w: n / (n + without[w]) for w, n in with_dot.items() if n >= 3}
    starts = {w: begins[w] / n for w, n in total.items() if n >= 3}
    model = Model(dotted, starts, {})
    rows, labels = [], []
    for t in texts:
        for _, prev, mark, kind, token, last in _candidates(t):
            if kind != "end" and (label := reliable_label(model, prev, mark, kind, token, last)) is not None:
                rows.append((prev, mark, kind, token))
                labels.append(label)
    # Equal candidates are one row with a weight.
    tally = Counter(zip(rows, labels, strict=True))
    names: dict[str, int] = {}
    ids = np.array([[names.setdefault(f, len(names)) for f in model.features(*r)] for r, _ in tally], dtype=np.int64).reshape(len(tally), -1)
    y = np.array([label for _, label in tally], dtype=float)
    n = np.minimum(np.array(list(tally.values()), dtype=float), 50.0)
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds if len(tally) else 0):
        p = 1 / (1 + np.exp(-w[ids].sum(axis=1)))
        g = np.bincount(ids.ravel(), np.repeat((y - p) * n, ids.shape[1]), minlength=len(names)) - 0.05 * w
        squares += g * g
        w += 0.5 * g / np.sqrt(squares)
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
    return model


def sentence_spans(text: str, model: Model) -> list[tuple[int, int]]:
    """[start, end) of the sentences, from first to last non-space character; every non-space character is in one.

    A blank line always ends a sentence. Points, question and exclamation marks
    are candidates that the model decides, a quotation's closing mark after such a
    mark one too. Full-width stops end a sentence outside quotations, and in Thai
    a space without a numeral beside it.
    """
    masked = mask_quotes(text)
    cuts = []
    for m in BOUND.finditer(masked):
        kind = m.lastgroup
        if kind == "term":
            if model.ends(_before(masked, m.start()), m["term"], *_after(masked, m.end())):
                cuts.append(m.end())
        elif kind == "cjk":
            # After a closed quotation the sentence goes on, unless the text or line breaks off.
            if m[0][-1] in CJK_TERMINATORS or masked[m.end() : m.end() + 1].isspace() or m.end() == len(masked):
                cuts.append(m.end())
        else:
            cuts.append(m.start() if kind == "thai" else m.end())
    out, at = [], 0
    for c in [*cuts, len(text)]:
        piece = text[at:c]
        lead = len(piece) - len(piece.lstrip())
        tail = len(piece.rstrip())
        if lead < tail:
            out.append((at + lead, at + tail))
        at = c
    return out


def sample_texts(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """Up to ``rows`` texts, the same ones on every run: those with the smallest hashed keys."""
    base = df.select(df[key].cast("string").alias("k"), df[text].alias("t")).where((F.length("t") > 0) & (F.length("t") <= SAMPLE_CHARS))
    return [r.t for r in smallest_hashes(base, F.xxhash64("k"), rows).select("t").collect()]


def sentences(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``row_key`` (string), ``char_start``, ``char_end`` of every sentence of every row of ``df``.

    One pass without a shuffle. A null or blank text has no sentence; a repeated
    key gives its sentences once per row. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(b["k"], b["t"], strict=True):
                for s, e in sentence_spans(t, own):
                    keys.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"row_key": keys, "char_start": np.array(starts, np.int32), "char_end": np.array(ends, np.int32)})

    base = df.select(df[key].cast("string").alias("k"), df[text].alias("t")).where("t is not null")
    return base.mapInPandas(cut, "row_key string, char_start int, char_end int")


def accuracy(model: Model, texts: Iterable[str]) -> float:
    """Share of the reliable candidates in ``texts`` that the model labels as the rules do: held-out accuracy."""
    right = n = 0
    for t in texts:
        for _, prev, mark, kind, token, last in _candidates(t):
            if kind != "end" and (label := reliable_label(model, prev, mark, kind, token, last)) is not None:
                n += 1
                right += model.ends(prev, mark, kind, token) == bool(label)
    return right / n if n else math.nan
