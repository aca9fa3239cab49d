"""Abusive, hateful and sexual language: noisy-channel deobfuscation, then a linear classifier over the restored sentences."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm.lookalikes import mapping
from qirtas.plans.lineage import written
from qirtas.plans.skew import keep_members

#: Commonest words of all documents that the character model knows besides the vocabulary.
MODEL_WORDS = 30_000
#: Labelled documents that are fitted together, about; the weights of all blocks are averaged.
LABELLED_BLOCK = 2000
#: Different pieces of text and readings of sentences that a task keeps at a time.
KEPT = 200_000
#: Weight above which a feature outside the prior is kept.
LEAST_WEIGHT = 0.02
#: Score from which a document counts as abusive: the probability of its worst sentence.
THRESHOLD = 0.5

# A general vocabulary by kind, known to the character model and a feature of the classifier. Written from the languages, not from any table.
LEXICON = {
    "insult": "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit dimwits halfwit halfwits nitwit nitwits dunce dolt simpleton blockhead bonehead dumbass jackass asshole assholes arsehole bastard bastards bitch bitches scumbag scumbags scum dirtbag sleazebag douchebag prick pricks dickhead wanker wankers tosser twat cunt cunts motherfucker fucker fuckers whore whores slut sluts skank retard retards faggot degenerate degenerates pervert perverts loser losers swine mongrel "
    "idiote crétin crétins crétine imbécile imbéciles abruti abrutis abrutie con cons conne connard connards connasse salaud salauds salopard salope salopes enculé enculés enfoiré enfoirés fumier raclure pourriture bouffon débile débiles taré tarés minable bâtard bâtards pute putes racaille ordure ordures "
    "غبي غبية اغبياء احمق حمقى حقير حقيرة حقراء نذل انذال وغد اوغاد سافل سفلة تافه تافهين قذر قذرة قذرون وسخ وسخة خسيس لئيم لعين ملعون معتوه متخلف منحط ساقط حثالة عاهرة عاهرات شرموطة قحبة زبالة حقارة",
    "profane": "shit shitty bullshit crap fuck fucks fucked fucking damn piss pissed ass arse merde bordel foutre chier cul couilles gueule niquer nique putain تفو اخرس خراء طيز لعنة",
    "contempt": "stupid dumb brainless worthless useless pathetic disgusting filthy rotten stinking ugly miserable lousy vile despicable contemptible lying crooked lazy gutless spineless shameless ignorant despise hate stupide stupides sale sales pauvre répugnant dégoûtant ignoble misérable نتن مقرف بغيض وقح كاذب كذاب جبان خائن لص لصوص حرامي",
    "beast": "rat rats pig pigs dog dogs snake snakes donkey donkeys monkey monkeys ape apes cow maggot maggots worm worms leech leeches parasite parasites vermin cockroach cockroaches louse lice weasel weasels trash garbage filth dirt fool fools liar liars coward cowards thief thieves crook crooks animals beasts insects plague pest disease cancer subhuman inferior savages barbarians porc porcs chien chiens chienne vermine cafard cafards animaux bêtes peste كلب كلاب حمار حمير خنزير خنازير حيوان حيوانات بهائم قرد قرود حشرة حشرات صراصير جرذان طفيليات وباء",
    "threat": "kill murder strangle choke beat smash burn burned hang hanged shoot stab rot die drown crush slaughter whip whips kick kicked slap slapped punch lynch exterminate exterminated eradicate eradicated cleanse cleansed expel expelled deport deported driven purge hell crever crève tuer brûler chasser exterminer éliminer frapper égorger pendre fouet enfer mourir ابادة طردهم طرد اقتل قتلهم احرق اذبح سحق صفع الصفع جهنم الموت",
    "group": "people peoples race races tribe foreigners foreigner immigrants immigrant migrants migrant refugees refugee women jews muslims christians arabs africans blacks gypsies minorities natives étrangers étranger immigrés migrants réfugiés peuple femmes juifs musulmans arabes noirs gitans الاجانب اجانب اليهود النصارى المسلمين المسلمون اللاجئين اللاجئون المهاجرين المهاجرون الغرباء النساء",
    "sexual": "naked nude nudes sex sexy breasts breast boobs tits nipples penis cock dick pussy vagina clit orgasm orgasms cum erection horny aroused moan moaned moaning moans thrust grope groped groping fondle fondled lick licked sucked blowjob masturbate masturbating porn porno hardcore stripped strip undress undressed thighs lust seduce seduced penetrated intercourse panties lingerie nue nues seins sexe bander jouir orgasme baiser sucer lécher bite chatte érection عارية عاريات عاري جسدك جسدها نهديها ثدييها صدرها ضاجع ضاجعها مضاجعة شهوة اشتهي فخذيها تتاوه قبلها",
    "you": "you your yours yourself u ur ye tu te toi ton ta tes vous votre vos انت انتم انتي يا لك عليك",
}
# The same for scripts without spaces.
RUNS = {
    "insult": "白痴 蠢猪 蠢货 废物 混蛋 王八蛋 笨蛋 畜生 傻逼 傻瓜 傻子 贱人 婊子 杂种 人渣 败类 狗东西 不要脸 โง่ ควาย เหี้ย ระยำ สารเลว ปัญญาอ่อน ชั่ว เลว กระหรี่ ดอกทอง ไอ้ อีดอก สวะ",
    "profane": "狗屎 他妈 妈的 操你 该死 去死 滚出 滚开 闭嘴 หุบปาก ไปตาย ตายซะ เย็ด",
    "beast": "害虫 寄生虫 蛆 垃圾 老鼠 劣等 ขยะ หมา สัตว์",
    "threat": "灭绝 消灭 驱逐 杀光 ฆ่า ขับไล่",
    "group": "外国人 移民 难民 คนต่างด้าว ผู้อพยพ",
    "sexual": "裸照 裸体 性交 做爱 性爱 阴茎 乳房 高潮 呻吟 เปลือย ควย หี เสียว",
    "you": "你 你们 มึง แก",
}
# Insults of several words, behind the word that calls for a look at them.
IDIOMS = {"son": "son of a bitch|sons of bitches", "fils": "fils de pute|fils de chien|fils de chienne", "ابن": "ابن (?:ال)?(?:كلب|حرام|عاهرة|قحبة|زنا)", "اولاد": "اولاد (?:ال)?(?:كلب|حرام|زنا)", "بنت": "بنت (?:ال)?(?:كلب|حرام|زنا)", "piece": "pieces? of (?:shit|crap|filth|garbage)", "tas": "tas de (?:merde|cons|ordures)"}
# What the classifier believes of the kinds before it has seen any mark.
PRIOR = {"bias": -4.0, "insult": 3.2, "profane": 3.0, "sexual": 1.5, "contempt": 0.6, "beast": 0.4, "threat": 0.3, "you": 0.3, "you+insult": 1.0, "you+profane": 1.5, "you+contempt": 1.0, "you+beast": 2.5, "you+sexual": 1.0, "you+threat": 0.8, "beast+group": 2.5, "group+threat": 1.5, "beast+threat": 1.5, "beast+contempt": 1.5, "insult+contempt": 1.0, "contempt+group": 2.0}
# What a sign or digit may stand for.
LEET = {"4": "a", "@": "a", "3": "e", "1": "il", "!": "i", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "(": "c", "€": "e", "2": "z"}

_SIGNS = "4@310!|$57+869(€2*"
# Scripts without spaces have no such spellings, so their letters end a stretch. A bracket stands for a letter only between two.
_PLAIN = "[^\\W\\d_㐀-鿿ก-๛]"
_SIGN = rf"(?:[4@310!|$57+869€2*]|\((?<={_PLAIN}.)(?={_PLAIN}))"
DISGUISED = re.compile(
    rf"(?P<spaced>(?<![\w@$!*])(?:[\w@$!*][ .\-_·*]){{2,}}[\w@$!*](?![\w@$!*]))"
    rf"|(?P<mixed>(?<![^\W_]){_PLAIN}*(?:{_SIGN}+{_PLAIN}+|{_PLAIN}+\*+)(?:{_SIGN}|{_PLAIN})*)"
    rf"|(?P<stretched>{_PLAIN}*({_PLAIN})\4\4{_PLAIN}*)"
)
#: Whether a text can hold anything disguised at all: a cheap look before :data:`DISGUISED`.
HINT = re.compile(rf"[4@310!|$57+869€2*](?:(?<={_PLAIN}.)|(?={_PLAIN}))|\((?<={_PLAIN}.)(?={_PLAIN})|({_PLAIN})\1\1|(?<!\w){_PLAIN}[ .\-_·*](?:[\w@$!*])[ .\-_·*][\w@$!*](?!\w)")
SENTENCE = re.compile(r"(?<=[.!?؟])\s+|(?<=[。！？])|(?<=[ก-๛])\s+(?=[ก-๛])|\n\s*\n")
NUMBER = re.compile(r"\d+")
TOKEN = re.compile(r"[^\W\d_]+|#")
UNSPACED = re.compile("[㐀-鿿ก-๛]+")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿‪-‮⁦-⁩ـً-ْ]")
_FOLD = str.maketrans(dict(zip(*mapping(), strict=True)))
_FOLDED = frozenset(mapping()[0])
_ALEF = tuple(zip("أإآٱى", "ااااي", strict=True))


def fold(text: str) -> str:
    """Lower case with look-alikes mapped and invisible characters, tatweel and vowel marks removed."""
    # A set, not an expression: one of so many letters takes milliseconds a text.
    if not text.isascii() and not _FOLDED.isdisjoint(text):
        text = text.translate(_FOLD)
    for variant, letter in _ALEF:
        text = text.replace(variant, letter)
    return INVISIBLE.sub("", text).lower()


def _spelled(words: str) -> list[str]:
    """Words of the vocabulary as they may stand in a text: Arabic ones also behind the article and 'and'."""
    out = []
    for w in map(fold, words.split()):
        out += [w, "ال" + w, "و" + w, "وال" + w] if "ء" <= w[0] <= "ي" else [w]
    return out


KINDS: dict[str, frozenset[str]] = {k: frozenset(_spelled(v)) for k, v in LEXICON.items()}
_KIND_OF: dict[str, list[str]] = defaultdict(list)
for _k, _ws in KINDS.items():
    for _w in _ws:
        _KIND_OF[_w].append(_k)
_IDIOM = {w: re.compile(p) for w, p in IDIOMS.items()}
for _w in _IDIOM:
    _KIND_OF.setdefault(_w, [])
_LISTED = frozenset(_KIND_OF)
_RUN_OF = {k: re.compile("|".join(map(re.escape, v.split()))) for k, v in RUNS.items()}


class CharModel:
    """A character language model: letters after the prefix of a known word, and interpolated 4-grams for words not known."""

    ORDER = 4
    #: Log costs of the channel: a letter written as a sign, a letter starred out, a star slipped in, a letter stretched, a gap inside a word, a word not known; and what a word of the vocabulary gains.
    SIGN, STARRED, SLIPPED, STRETCHED, GAP, UNKNOWN, DISGUISES = 0.5, 1.0, 1.5, 0.3, 0.2, 9.0, 6.0

    def __init__(self, words: Counter, lexicon: Iterable[str]):
        counts = Counter({w: float(n) for w, n in words.items()})
        self.listed = set(lexicon)
        floor = max(1.0, sum(counts.values()) / 50_000)
        for w in self.listed:
            counts[w] = max(counts[w], floor)
        self.children: list[dict[str, int]] = [{}]
        self.through, self.ends, self.offensive = [0.0], [0.0], [False]
        self.grams: dict[str, Counter] = defaultdict(Counter)
        for w, n in counts.items():
            node = 0
            self.through[0] += n
            for c in w:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.through.append(0.0)
                    self.ends.append(0.0)
                    self.offensive.append(False)
                node = nxt
                self.through[node] += n
            self.ends[node] += n
            self.offensive[node] = w in self.listed
            padded = "^" * (self.ORDER - 1) + w + "$"
            for i in range(self.ORDER - 1, len(padded)):
                for k in range(self.ORDER):
                    self.grams[padded[i - k : i]][padded[i]] += n
        self.totals = {h: sum(c.values()) for h, c in self.grams.items()}

    def log_p(self, history: str, c: str) -> float:
        """Log probability of ``c`` after the last letters of ``history``, by 4-grams."""
        p = 1e-6
        for k in range(self.ORDER):
            h = history[len(history) - k :] if k else ""
            total = self.totals.get(h)
            if not total:
                break
            p = 0.2 * p + 0.8 * self.grams[h].get(c, 0.0) / total
        return math.log(p)

    def _step(self, states: dict, options: list[tuple[str, float]], free: float | None) -> dict:
        """One place of the lattice: letters at a cost, none for '', and any letter of a known word where ``free`` is a cost."""
        new: dict = {}

        def offer(key, score: float, text: str) -> None:
            if key not in new or new[key][0] < score:
                new[key] = (score, text)

        for (node, history), (score, text) in states.items():
            for c, cost in options:
                if c == "":
                    offer((node, history), score - cost, text)
                elif c == " ":
                    end = self._end(node, history)
                    if end > -math.inf:
                        self._begin(offer, score - cost + end, text + " ")
                elif node >= 0:
                    nxt = self.children[node].get(c)
                    if nxt is not None:
                        offer((nxt, ""), score - cost + math.log(self.through[nxt] / self.through[node]), text + c)
                else:
                    offer((-1, (history + c)[-3:]), score - cost + self.log_p(history, c), text + c)
            if free is not None and node >= 0:
                for c, nxt in self.children[node].items():
                    offer((nxt, ""), score - free + math.log(self.through[nxt] / self.through[node]), text + c)
        return new

    def _begin(self, offer, score: float, text: str) -> None:
        offer((0, ""), score, text)
        offer((-1, "^^^"), score - self.UNKNOWN, text)

    def _end(self, node: int, history: str) -> float:
        if node < 0:
            return self.log_p(history, "$")
        return math.log(self.ends[node] / self.through[node]) + self.DISGUISES * self.offensive[node] if self.ends[node] else -math.inf

    def decode(self, seen: str) -> str:
        """The likeliest reading of a disguised stretch: Viterbi search of the whole lattice, no state dropped.

        A state is the place in a known word, or the last three letters of one not
        known; states that agree keep the better text. Starred letters are
        restored to known words only.
        """
        states: dict = {}
        self._begin(lambda k, s, t: states.__setitem__(k, (s, t)), 0.0, "")
        gapped = len(seen) > 4 and all(c in " .-_·*" for c in seen[1::2])
        i = 0
        while i < len(seen):
            c, n = seen[i], 1
            while i + n < len(seen) and seen[i + n] == c and c not in " .-_·":
                n += 1
            if c in " .-_·" or (gapped and i % 2 and c == "*"):
                states = self._step(states, [("", self.GAP), (" ", self.GAP + 1.0)] if i % 2 or not gapped else [("", self.GAP)], None)
            elif c == "*":
                for _ in range(n):
                    states = self._step(states, [("", self.SLIPPED), ("*", 0.0)], self.STARRED)
                    states = self._step(states, [("", 0.0)], self.STARRED + 1.5)
            elif c.isalpha():
                states = self._step(states, [(c, 0.0)], None)
                if n > 1:
                    states = self._step(states, [("", self.STRETCHED * (n > 2)), (c, 0.0 if n == 2 else self.STRETCHED)], None)
            else:
                for _ in range(n):
                    states = self._step(states, [(x, self.SIGN) for x in LEET.get(c, "")] + [(c, 0.0)], None)
            i += n
        best = max(((s + self._end(*k), t) for k, (s, t) in states.items()), default=(-math.inf, seen))
        return best[1] if best[0] > -math.inf else seen


def _restored(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """``text`` (folded) with every disguised stretch read by the character model."""
    if not HINT.search(text):
        return text

    def read(m: re.Match) -> str:
        seen = m[0]
        core = seen.rstrip("!|+(") if m.lastgroup != "spaced" else seen
        if m.lastgroup == "mixed" and not any(c in _SIGNS for c in core.strip("!|+(")):
            return seen
        out = cache.get(core)
        if out is None:
            if len(cache) > 200_000:
                cache.clear()
            out = cache[core] = model.decode(core)
        return out + seen[len(core) :]

    return DISGUISED.sub(read, text)


def sentences_of(text: str) -> list[str]:
    """Sentences of a restored text, numbers as '#'."""
    return [x for x in SENTENCE.split(NUMBER.sub("#", text)) if x and not x.isspace()]


def features(sentence: str) -> tuple[list[str], list[str]]:
    """Words; and word pairs, 2- to 4-grams of unspaced scripts, kinds and pairs of kinds. Words also bring the 3- and 4-grams inside them."""
    runs = UNSPACED.findall(sentence)
    words = TOKEN.findall(UNSPACED.sub(" ", sentence) if runs else sentence)
    out = ["bias", *(f"b={a} {b}" for a, b in zip(words, words[1:], strict=False)), *(f"u={g}" for run in runs for g in _run_grams(run))]
    return words, out + _kind_features(_kinds(sentence, words, bool(runs)))


def _kinds(sentence: str, words: list[str], unspaced: bool) -> set[str]:
    listed = _LISTED.intersection(words)
    kinds = {k for w in listed for k in _KIND_OF[w]}
    if any(w in _IDIOM and _IDIOM[w].search(sentence) for w in listed):
        kinds.add("insult")
    return kinds | {k for k, p in _RUN_OF.items() if p.search(sentence)} if unspaced else kinds


def _inner(word: str) -> list[str]:
    padded = f"^{word}$"
    return [f"c={padded[i : i + n]}" for n in (3, 4) for i in range(len(padded) - n + 1)] if len(word) > 2 else []


def _run_grams(run: str) -> list[str]:
    return [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]


def _kind_features(kinds: set[str]) -> list[str]:
    own = sorted(kinds)
    order = list(LEXICON)
    pairs = ["+".join(p) for i, a in enumerate(own) for b in own[i + 1 :] for p in ((a, b), (b, a)) if "+".join(p) in PRIOR]
    return [k for k in order if k in kinds] + pairs


class _WordWeights(dict):
    """The weight of a word and of the character sequences inside it; words repeat, so it is kept."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        get = self.weights.get
        self[word] = total = get(f"w={word}", 0.0) + sum(get(g, 0.0) for g in _inner(word))
        return total


class _Kept(dict):
    """Results of a function of a sentence; sentences repeat, so they are kept."""

    def __init__(self, function: Callable[[str], float]):
        super().__init__()
        self.function = function

    def __missing__(self, sentence: str) -> float:
        if len(self) > KEPT:
            self.clear()
        self[sentence] = out = self.function(sentence)
        return out


class Scorer:
    """Restores sentences and scores them; weights and models are bounded, so they travel with the tasks."""

    def __init__(self, model: CharModel, weights: dict[str, float]):
        self.model, self.weights = model, weights
        self._prepare()

    def __getstate__(self):
        return {"model": self.model, "weights": self.weights}

    def __setstate__(self, state):
        self.model, self.weights = state["model"], state["weights"]
        self._prepare()

    def _prepare(self) -> None:
        w = self.weights
        self.readings: dict[str, str] = {}
        self.bias = w.get("bias", PRIOR["bias"])
        self.pairs = {tuple(k[2:].split(" ", 1)): v for k, v in w.items() if k.startswith("b=")}
        self.runs = {k[2:]: v for k, v in w.items() if k.startswith("u=")}
        self.words = _WordWeights(w)
        self.odds = _Kept(self.log_odds)

    def log_odds(self, sentence: str) -> float:
        """Log odds that a restored sentence is abusive."""
        runs = UNSPACED.findall(sentence)
        words = TOKEN.findall(UNSPACED.sub(" ", sentence) if runs else sentence)
        total = self.bias + sum(map(self.words.__getitem__, words)) + sum(filter(None, map(self.pairs.get, zip(words, words[1:], strict=False))))
        if runs:
            total += sum(filter(None, (self.runs.get(g) for run in runs for g in _run_grams(run))))
        kinds = _kinds(sentence, words, bool(runs))
        return total + sum(self.weights.get(f, 0.0) for f in _kind_features(kinds)) if kinds else total

    def restored(self, text: str) -> str:
        return _restored(fold(text), self.model, self.readings)

    def score(self, text: str) -> float:
        """The probability of the worst sentence of the restored text."""
        top = max(map(self.odds.__getitem__, sentences_of(self.restored(text))), default=-math.inf)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, top))))


class _Design:
    """The sentences of labelled documents as sparse features: words, character sequences through words, and others."""

    def __init__(self, texts: list[str], model: CharModel):
        cache: dict[str, str] = {}
        sentences: dict[str, int] = {}
        self.docs = [np.array(sorted({sentences.setdefault(s, len(sentences)) for s in sentences_of(_restored(fold(t), model, cache))}), dtype=np.int64) for t in texts]
        words: dict[str, int] = {}
        others: dict[str, int] = {}
        own = [features(s) for s in sentences]
        self.size = len(own)
        self.word_row, self.word = self._pairs([[words.setdefault(w, len(words)) for w in a] for a, _ in own])
        # A pair or sequence of one sentence only can't be told from its other words.
        spread = Counter(f for _, b in own for f in set(b))
        self.other_row, self.other = self._pairs([[others.setdefault(f, len(others)) for f in b if spread[f] > 1 or f in PRIOR] for _, b in own])
        for f in PRIOR:
            others.setdefault(f, len(others))
        grams: dict[str, int] = {}
        self.gram_word, self.gram = self._pairs([[grams.setdefault(g, len(grams)) for g in _inner(w)] for w in words])
        self.names = [*(f"w={w}" for w in words), *others, *grams]
        self.n_words, self.n_others = len(words), len(others)
        self.prior = np.array([PRIOR.get(f, 0.0) for f in self.names])

    @staticmethod
    def _pairs(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.int64)

    def log_odds(self, w: np.ndarray) -> np.ndarray:
        a, b = self.n_words, self.n_words + self.n_others
        inner = w[:a] + np.bincount(self.gram_word, w[b:][self.gram], minlength=a)
        return np.bincount(self.word_row, inner[self.word], minlength=self.size) + np.bincount(self.other_row, w[a:b][self.other], minlength=self.size)

    def learn(self, target: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
        """Weights pulled towards the prior, by adaptive gradients."""
        # What the vocabulary says weighs less than what the marks say; single words and sequences are held to little.
        pull = np.where(self.prior != 0, 0.05, 0.3)
        w, squares = self.prior.copy(), np.full(len(self.prior), 1e-2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.log_odds(w), -30, 30)))
            r = (target - p) * weight
            words = np.bincount(self.word, r[self.word_row], minlength=self.n_words)
            g = np.concatenate([words, np.bincount(self.other, r[self.other_row], minlength=self.n_others), np.bincount(self.gram, words[self.gram_word], minlength=len(w) - self.n_words - self.n_others)])
            g -= pull * (w - self.prior)
            squares += g * g
            w += 0.2 * g / np.sqrt(squares)
        return w


def fit(model: CharModel, texts: list[str], marks: list[int], steps: int = 50) -> Scorer:
    """A scorer with the weights of :func:`fit_weights` that count."""
    return Scorer(model, _counting(fit_weights(model, texts, marks, steps)))


def _counting(weights: dict[str, float]) -> dict[str, float]:
    return {f: v for f, v in weights.items() if abs(v) > LEAST_WEIGHT or f in PRIOR}


def fit_weights(model: CharModel, texts: list[str], marks: list[int], steps: int = 50) -> dict[str, float]:
    """A linear classifier of sentences learned from marks of whole documents.

    A document marked 0 has no abusive sentence, one marked 1 at least one: which,
    is settled in turns, beginning from the prior. Two halves of the documents
    judge each other's marks; those strongly contradicted are taken for wrong.
    """
    x = _Design(texts, model)
    if not x.size:
        return dict(PRIOR)
    y = np.asarray(marks, dtype=bool)
    half = np.arange(len(texts)) % 2 == 0

    def chosen(z: np.ndarray, docs: np.ndarray, judged: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Targets and weights of sentences: what documents without abuse hold, and the worst ones of those with."""
        target, clean = np.zeros(x.size), np.zeros(x.size)
        for d in docs[~y[docs]]:
            own = x.docs[d]
            clean[own if judged is None else own[judged[own] < 1.5]] += 1.0
        worst = np.zeros(x.size)
        for d in docs[y[docs]]:
            own = x.docs[d][clean[x.docs[d]] < 2]
            # Where nothing stands out, any choice would teach chance words.
            if not len(own) or (judged is not None and judged[own].max() < -2.5) or z[own].max() < PRIOR["bias"] + 1.0:
                continue
            worst[own[np.argmax(z[own])]] += 1.0
            worst[own[z[own] > 0.5]] += 1.0
        target[worst > 0] = 1.0
        total = np.where(worst > 0, np.minimum(worst, 2.0), np.minimum(clean, 2.0))
        balance = max(1.0, min(8.0, 0.25 * total[target == 0].sum() / max(1.0, total[target > 0].sum())))
        return target, np.where(target > 0, total * balance, total)

    z = x.log_odds(x.prior)
    both = np.arange(len(texts))
    judged = np.zeros(x.size)
    by_half = [x.log_odds(x.learn(*chosen(z, both[side], None), steps)) for side in (half, ~half)]
    for side, other in ((half, 1), (~half, 0)):
        for d in both[side]:
            judged[x.docs[d]] = by_half[other][x.docs[d]]
    w = x.learn(*chosen((by_half[0] + by_half[1]) / 2, both, judged), steps)
    return dict(zip(x.names, w.tolist(), strict=True))


def _model_words(text: str) -> list[str]:
    return [w for w in TOKEN.findall(UNSPACED.sub(" ", fold(text))) if w != "#" and not re.search(r"(.)\1\1", w)]


def _character_model(common: list[tuple[str, int]]) -> CharModel:
    return CharModel(Counter({w: n for w, n in common if n > 1}), (w for k, ws in KINDS.items() if k not in ("you", "group") for w in ws))


def character_model(texts: Iterable[str]) -> CharModel:
    """The character model of the vocabulary and of the words of texts."""
    return _character_model(Counter(w for t in texts for w in _model_words(t)).most_common(MODEL_WORDS))


def document_model(documents: DataFrame, text: str) -> CharModel:
    """:func:`character_model` of the words of all documents, counted by the tasks that read them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Folding works letter by letter within words, so pieces between spaces are folded once each.
        pieces: Counter = Counter()

        def words() -> pd.DataFrame:
            out: Counter = Counter()
            for piece, n in pieces.items():
                for w in _model_words(piece):
                    out[w] += n
            pieces.clear()
            return pd.DataFrame({"w": list(out), "n": list(out.values())}).astype({"w": object, "n": "int64"})

        for b in batches:
            for t in b["_t"]:
                pieces.update(t.split())
                if len(pieces) > KEPT:
                    yield words()
        yield words()

    counts = documents.select(documents[text].alias("_t")).where("length(_t) > 0").mapInPandas(counted, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return _character_model([(r.w, r.n) for r in counts.where("n > 1").orderBy(F.desc("n"), "w").limit(MODEL_WORDS).collect()])


def marked_texts(documents: DataFrame, key: str, text: str, labels: DataFrame, mark: str = "abusive") -> DataFrame:
    """``_id``, ``_t``, ``_y`` of every labelled document that holds text: the mark of the reviewers' majority; ties and null marks are left out."""
    votes = labels.where(F.col(mark).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg((2 * F.sum(mark) - F.count(F.lit(1))).alias("_v")).where("_v <> 0")
    votes = written(votes.select("_id", (F.col("_v") > 0).cast("int").alias("_y")), "votes")
    texts = documents.select(documents[key].alias("_id"), documents[text].alias("_t")).where("length(_t) > 0")
    return keep_members(texts, "_id", votes, "_id").join(votes, "_id").select("_id", "_t", "_y")


def marked_weights(marked: DataFrame, model: CharModel) -> dict[str, float]:
    """The classifier's weights from all of :func:`marked_texts`.

    Documents fall into blocks of about LABELLED_BLOCK by their hashed ids, tasks
    fit a block each by :func:`fit_weights`, and the weights are averaged over all
    documents: a feature that a block doesn't hold counts with its prior there.
    """
    marked = written(marked, "marked")
    n = marked.count()
    shared = marked.sparkSession.sparkContext.broadcast(model)

    def block(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_id")
        own = fit_weights(shared.value, g["_t"].tolist(), g["_y"].tolist())
        return pd.DataFrame({"f": list(own), "v": np.array(list(own.values())) * len(g)})

    parts = marked.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(max(1, round(n / LABELLED_BLOCK))))).groupBy("_b").applyInPandas(block, "f string, v double")
    total = parts.groupBy("f").agg((F.sum("v") / max(1, n)).alias("v"))
    return dict(PRIOR) | {r.f: r.v for r in total.where((F.abs("v") > LEAST_WEIGHT) | F.col("f").isin(list(PRIOR))).collect()}


def train_scorer(documents: DataFrame, key: str, text: str, labels: DataFrame) -> Scorer:
    """A scorer whose character model knows the vocabulary and the words of all documents, and whose classifier is fitted on all labelled ones."""
    model = document_model(documents, text)
    return Scorer(model, marked_weights(marked_texts(documents, key, text, labels), model))


def scored(documents: DataFrame, key: str, text: str, scorer: Scorer, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, columns ``keep`` and ``score`` of every document, whole texts read, without a shuffle.

    A null or empty text scores 0; every row gives one row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def points(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(np.array([own.score(t) if t else 0.0 for t in texts], dtype=float))

    return documents.select(documents[key].alias("doc_id"), *[documents[c] for c in keep or []], points(documents[text]).alias("score"))


def rates(documents: DataFrame, key: str, text: str, source: str, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: ``n_docs``, ``n_abusive``, ``rate``. A null source is a source of its own."""
    marked = scored(documents, key, text, scorer, [source])
    per = marked.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_abusive"))
    return per.withColumn("rate", F.col("n_abusive") / F.col("n_docs"))
