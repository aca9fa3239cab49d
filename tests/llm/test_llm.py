from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qirtas.llm import abuse, bitext, leaks, lookalikes, packing, queries, sentences
from qirtas.llm.sampling import smallest_hashes
from tests.conftest import DATA

BASE = [
    "The court met on 5 May 1960. Dr. A. B. Stone spoke for Ms. L. Reed. The claim was dismissed.",
    "See p. 12 of vol. 3. The seller, e.g. a firm such as Stone Inc. of London, pays 3.5 per cent. Who holds it now? The buyer does.",
    "He asked: “Where is it? Who has it?” and left. The file was closed.\n\nHeading\n\nThe end came at 5 p.m. The rest left.",
    "The parties, etc. and others, agreed. Nobody came. The judge left.",
]


@pytest.fixture(scope="module")
def model():
    return sentences.train(BASE * 30)


def cut(text, model):
    return [text[s:e] for s, e in sentences.sentence_spans(text, model)]


def test_sentences(model):
    assert cut(BASE[0], model) == ["The court met on 5 May 1960.", "Dr. A. B. Stone spoke for Ms. L. Reed.", "The claim was dismissed."]
    assert cut(BASE[2], model) == ["He asked: “Where is it? Who has it?” and left.", "The file was closed.", "Heading", "The end came at 5 p.m.", "The rest left."]
    assert cut("买受人说：“请归还。马上！”然后离开。法院认定。", model) == ["买受人说：“请归还。马上！”然后离开。", "法院认定。"]
    assert cut("ผู้ซื้อรอ ลูกหนี้ซ่อม 7408 ดีนาร์ ผู้ขาย", model) == ["ผู้ซื้อรอ", "ลูกหนี้ซ่อม 7408 ดีนาร์", "ผู้ขาย"]
    assert cut("", model) == cut(" \n ", model) == []


def test_sentences_cover_everything(spark, model):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aB. ?!\n“”«»()1ก 。“ x", k=rng.randint(0, 200))) for _ in range(100)] + [None, "x. " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("row_key", F.lit(0))
    spans = defaultdict(list)
    for r in sentences.sentences(df, "k", "t", model).collect():
        spans[int(r.row_key)].append((r.char_start, r.char_end))
    for k, t in enumerate(texts):
        own = sorted(spans[k])
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
        assert "".join("".join(t[s:e].split()) for s, e in own) == "".join((t or "").split()) if t else not own


def test_sentence_model_on_held_out_texts(spark):
    df = spark.read.parquet(str(DATA / "tm_entries.parquet"))
    texts = sentences.sample_texts(df, "id", "source_sentence")
    assert sentences.accuracy(sentences.train(texts[::2]), texts[1::2]) > 0.97


def test_alignment():
    pairs = [("en", "xx", f"the {n}u gives the {n}v to {n}w", f"la {n}x da {n}y {n}z") for n in ("kap", "lor", "mib", "ned", "ost", "pru", "qal", "rem")] * 6
    tables = bitext.learn_tables(pairs)
    source = [p[2] for p in pairs[:6]] + ["unrelated 77"]
    target = [pairs[1][3], pairs[0][3], pairs[2][3] + " " + pairs[3][3], pairs[5][3]]
    assert bitext.align(source, target, tables["en", "xx"], tables["xx", "en"]) == [(0, 1), (1, 0), (2, 2), (3, 2), (5, 3)]
    assert bitext.align([], target, {}, {}) == []


def test_alignment_of_tables(spark):
    got = queries.p3_found(spark, str(DATA))
    rows = got.collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)
    entries, articles = spark.read.parquet(str(DATA / "tm_entries.parquet")), spark.read.parquet(str(DATA / "bitext_articles.parquet"))
    assert bitext.align_articles(entries, articles.limit(0), {}).count() == 0
    assert bitext.align_articles(entries.limit(0), articles, {}).count() == 0


def test_alignment_of_long_articles(spark, monkeypatch):
    monkeypatch.setattr(bitext, "BLOCK", 10)
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    sentences_ = [rng.sample(words, 6) for _ in range(70)]
    there = {w: {"x" + w: 1.0} for w in words}
    tables = {("en", "xx"): there, ("xx", "en"): {"x" + w: {w: 1.0} for w in words}}
    # The target version leaves the first 40 sentences out, two are merged, and one moves to the end.
    kept = sentences_[40:50] + [sentences_[50] + sentences_[51]] + sentences_[53:] + [sentences_[52]]
    source, target = [" ".join(w) for w in sentences_], [" ".join("x" + v for v in w) for w in kept]
    rows = [(100 + n, "law", "1", "en", "xx", source[n], target[n] if n < len(target) else None) for n in range(len(source))]
    rows += [(900 + n, "law", "2", "en", "xx", source[n], " ".join("x" + w for w in sentences_[n])) for n in range(5)]
    df = spark.createDataFrame(rows, "id bigint, law_slug string, article string, source_lang string, target_lang string, source_sentence string, target_sentence string")
    articles = df.select("law_slug", "article").distinct()
    got = [tuple(r) for r in bitext.align_articles(df, articles, tables).collect()]
    want = {(100 + i, 100 + j) for i, j in bitext.align(source, target, there, tables["xx", "en"])}
    assert len(got) == len(set(got)) and set(got) == want | {(900 + n, 900 + n) for n in range(5)}
    assert {(150, 110), (151, 110), (152, 100 + len(target) - 1), (140, 100)} <= want


def test_translation_tables_count_every_pair(spark):
    """More pairs than a sample of 6,000 would hold, long ones among them; matrices and joins give what the list gives."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aei" for c in "lmn"]
    rows = []
    for n in range(7000):
        own = [words[min(len(words) - 1, int(rng.expovariate(0.1)))] for _ in range(rng.randint(1, 7))] + [f"{n}"] * (n % 2)
        rows.append(("xx", "en", " ".join("x" + w for w in own), " ".join(own)) if n % 3 else ("en", "xx", " ".join(own), " ".join("x" + w for w in own)))
    rows += [("en", "yy", f"Only{'abcd'[n]} rare", f"yonly{'abcd'[n]} yrare") for n in range(4)]
    rows += [("en", "zz", "long " * 2000, "zlong 1") for _ in range(4)] + [("en", "en", "same", "same"), ("en", "xx", None, "x"), (None, "xx", "a", "b")]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id bigint, source_lang string, target_lang string, source_sentence string, target_sentence string")
    want = bitext.learn_tables([r for r in rows if None not in r and r[0] != r[1]])
    assert want["en", "zz"] == {"long": {"zlong": 1.0}} and want["en", "yy"] == {"rare": {"yrare": 1.0}}
    for cells in (bitext.MATRIX_CELLS, 10, 0):
        got = bitext.learn(df, cells)
        assert {k: {w for w, v in t.items() if v} for k, t in got.items()} == {k: {w for w, v in t.items() if v} for k, t in want.items()}
        for k, table in want.items():
            for w, known in table.items():
                assert got[k].get(w, {}) == pytest.approx(known, abs=1e-4)
    assert bitext.learn(df.limit(0)) == {}
    for text in ("Straße №12 ２０号 Ｅ-mail ١٢ عقد", "依照第3561条，1941年", "x²y ①一二三"):
        assert bitext._words(text) == {w for w in bitext.bag(text) if not w[0].isdigit()}


def canon(t: str) -> str:
    source, target = lookalikes.mapping()
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    for a, b in lookalikes.LIGATURES.items():
        t = t.replace(a, b)
    return unicodedata.normalize("NFC", t.translate(str.maketrans(source, target)))


def test_lookalikes(spark):
    texts = ["Élan vital", "Élan vital", "Elan vital", "élan vital", "Élan vital", "Élan  vital", "Éla​n vitаl", "٤ عقد", "4 عقد", "ﻋقد لا", "عقد ﻻ", "عقد لا", None, "", "Ｅ", "E", "E", "أ", "أ"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string").withColumn("class_key", F.lit("x"))
    got = {tuple(r) for r in lookalikes.look_pairs(df, "k", "t").collect()}
    want = {(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if a is not None and b is not None and a != b and canon(a) == canon(b)}
    assert got == want and (0, 1) in got and (0, 2) not in got and (7, 8) not in got
    forms = {r.row_key: r.canonical for r in lookalikes.unify(df, "k", "t").collect()}
    assert all((forms[i] == forms[j]) == (canon(texts[i]) == canon(texts[j])) for i in forms for j in forms if texts[i] and texts[j] and texts[i] != texts[j])
    assert forms[12] is None and lookalikes.look_pairs(df.limit(0), "k", "t").count() == 0
    hot = spark.createDataFrame([(i, "Ｅ" if i % 2 else "E") for i in range(300)], "k bigint, t string")
    assert {tuple(r) for r in lookalikes.look_pairs(hot, "k", "t").collect()} == {(0, 1)}


def histogram_after(groups, unit):
    used = Counter()
    for repeats, content in groups:
        for key, m in content.items():
            used[key] += m * repeats
    return used


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    h = Counter(min(512, max(1, int(rng.lognormvariate(4.5, 1)))) for _ in range(3000))
    groups = packing.plan(dict(h), 512)
    want = Counter()
    for length, n in h.items():
        want[-(-(-length // 2)) if length >= 64 else length] += n
    assert histogram_after(groups, 2) == want
    assert sum(k * n for k, n in h.items()) / 512 / sum(r for r, _ in groups) > 0.97


def test_packing(spark):
    lengths = [3000, 0, None, 512, 511, 1, 200, 200, 112, 64, 63, 7] + [50] * 100
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(None, 5)], "doc_id bigint, n_tokens int").withColumn("rank", F.lit(0))
    rows = packing.pack(df, 512).collect()
    per, seen = Counter(), defaultdict(list)
    for r in rows:
        per[r.sequence_id] += r.token_end - r.token_start
        seen[r.doc_id].append((r.token_start, r.token_end))
    assert max(per.values()) <= 512 and len(seen) == len(lengths) + 1
    assert sorted(seen[0]) == [(i * 512, min(3000, (i + 1) * 512)) for i in range(6)]
    assert all(len(v) == 1 for k, v in seen.items() if k != 0) and len(per) <= 20
    assert packing.pack(df.limit(0), 512).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(12)] + [None, ""]
    docs = []
    for i in range(80):
        w = rng.choices(words, k=rng.randint(0, 300))
        if i % 2:
            src = rng.choice([x for x in items if x]).split()
            n = rng.randint(10, 22)
            at = rng.randint(0, max(0, len(src) - n))
            w[len(w) // 2 : len(w) // 2] = src[at : at + n]
        docs.append((i, ", ".join(w).upper()))
    docs += [(200, None), (201, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("gram", F.lit(1))
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.run_words for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}
    for i, t in docs:
        for j, x in enumerate(items):
            run = leaks.longest_run(re.findall(r"\w+", (t or "").lower()), (x or "").split())
            if run >= 15:
                assert got[i, j] == run
            else:
                assert got.get((i, j), 0) < 15
    assert any(v >= 15 for v in got.values()) and leaks.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0


def brute_alignment(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b):
            new.append(max(0.0, row[j] + (2.0 if x == y else -1.0), row[j + 1] - 1.0, new[j] - 1.0))
        row, best = new, max(best, *new)
    return best


def test_smith_waterman():
    rng = random.Random(2)
    for _ in range(30):
        a, b = (rng.choices("abcd", k=rng.randint(1, 20)) for _ in range(2))
        assert leaks.smith_waterman(a, b) == brute_alignment(a, b)


def test_alignment_of_many_pairs():
    rng = random.Random(3)
    pairs = [tuple(rng.choices("abcd", k=rng.randint(0, 20)) for _ in range(2)) for _ in range(200)]
    runs, scores = leaks.align_pairs(*([np.array([ord(c) for c in x], np.int32) for x in side] for side in zip(*pairs, strict=True)))
    assert runs.tolist() == [leaks.longest_run(a, b) for a, b in pairs]
    assert scores.tolist() == [leaks.smith_waterman(a, b) for a, b in pairs]
    assert [len(x) for x in leaks.align_pairs([], [])] == [0, 0]


def test_leaks_of_edited_and_partial_copies(spark):
    item, short = [f"w{i}" for i in range(60)], [f"s{i}" for i in range(10)]
    docs = []
    for step in range(10, 15):
        docs.append((step, ["x"] * 5 + [f"e{i}" if i % step == step - 1 else w for i, w in enumerate(item)] + ["y"] * 5))
    docs += [(100, [*"abc", *item[20:29], *"def"]), (101, [*"abc", *item[19:27], *"def"]), (102, ["a", *short, "b"]), (103, item[:7] + ["x"] + item[8:15])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    e = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.run_words, r.score) for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}
    words = [item, short]
    want = {(i, j): (leaks.longest_run(w, words[j]), leaks.smith_waterman(w, words[j]) / (2 * len(words[j]))) for i, w in docs for j in (0, 1)}
    assert got == {k: v for k, v in want.items() if v[0] >= leaks.SEED_WORDS} and len(got) == 8
    d = d.unionByName(spark.createDataFrame([(200, " ".join(["a", *item[9:24], "b"]))], d.schema))
    runs = leaks.leaks(d, "doc_id", "text", e, "item_id", "text", leaks.RUN_WORDS)
    assert [tuple(r) for r in runs.where("run_words >= 15").select("doc_id", "item_id", "run_words").collect()] == [(200, 0, 15)]


def test_leaks_recall_of_edited_copies(spark):
    """Copies with changed, inserted and dropped words, one in every 10 to 14, amid other documents that hold parts of the items."""
    rng = random.Random(8)
    items = [[f"i{n}w{k}" for k in range(40)] for n in range(20)]
    docs = []
    for n, item in enumerate(items):
        for kind in ("change", "insert", "drop"):
            step, out = rng.randint(10, 14), []
            for k, w in enumerate(item):
                if k % step == step - 1:
                    out += {"change": ["other"], "insert": [w, "other"], "drop": []}[kind]
                else:
                    out.append(w)
            docs.append((len(docs), " ".join(["before"] * 30 + out + ["after"] * 30), n))
        docs.append((len(docs), " ".join(item[:16]), None))
        docs.append((len(docs), " ".join(item), n))
    short = [[f"s{n}w{k}" for k in range(12)] for n in range(5)]
    docs += [(1000 + n, " ".join(["x"] * 9 + w + ["y"] * 9), 20 + n) for n, w in enumerate(short)]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")
    e = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items + short)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").where("matched >= 15 or score >= 0.75").collect()}
    assert {(i, n) for i, _, n in docs if n is not None} <= got and all(n == i // 5 for i, n in got if i < 1000)
    runs = {(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text", leaks.RUN_WORDS).where("run_words >= 15").collect()}
    assert runs == {(5 * n + k, n) for n in range(20) for k in (3, 4)}


LEGAL = ["The tenant keeps the goods.", "The court met on 5 May 1960 at p. 12.", "The owner of the dog pays for the pig farm.", "The heir owes the rent of the mill.", "Le vendeur garde la facture.", "L'acheteur doit le loyer.", "يلتزم صاحب الكلب بتعويض الضرر.", "يبقى الإيجار في حيازة الوارث.", "买受人可以保留货物。", "Murder is punished by imprisonment.", "The forensic report describes the breast and the thigh."]
RUDE = ["You are a filthy moron.", "Shut up, you worthless pig!", "Those foreigners are vermin and should be exterminated.", "She moaned, naked, and begged for sex.", "Espèce de connard, va crever !", "اخرس يا كلب يا حقير!", "你这个白痴，去死吧！"]


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(7)
    texts, marks = [], []
    for i in range(200):
        own = rng.choices(LEGAL, k=rng.randint(2, 6))
        if i % 4 == 0:
            own.insert(rng.randint(0, len(own)), rng.choice(RUDE))
        texts.append(" ".join(own))
        # Some marks are wrong.
        marks.append(int(i % 4 == 0) ^ int(i % 37 == 5))
    return abuse.fit(abuse.character_model(texts), texts, marks)


def test_restoring(scorer):
    for token, word in {"5cumb@g": "scumbag", "cr3t!n": "cretin", "imbeeeecile": "imbecile", "m**ot": "maggot", "b****rd": "bastard", "ح*ار": "حمار", "$@l4ud": "salaud", "r*at": "rat", "*diot": "idiot", "wh0re": "whore", "a p a r a s i t e": "a parasite", "m-o-r-o-n": "moron", "s t u p i d": "stupid"}.items():
        assert scorer.restored(f"the {token} then") == f"the {abuse.fold(word)} then"
    assert scorer.restored("c0urt") == "court"
    for text in ("7552", "p. 12", "12/3/1990", "the court", "no. 5, item 3", "u.n. (see p.5)", "ok!", "依照第3561条，1941年"):
        assert scorer.restored(text) == abuse.fold(text)


def test_decoding_is_exact():
    model = abuse.CharModel(Counter({"cat": 5, "cot": 3, "coat": 2, "act": 4}), ["coat"])

    def cost(seen: str, word: str) -> float:
        """The best reading of ``seen`` as ``word`` by brute force over its places."""
        if not seen:
            return 0.0 if not word else -1e9
        best = -1e9
        if word and (seen[0] == word[0] or word[0] in abuse.LEET.get(seen[0], "")):
            best = cost(seen[1:], word[1:]) - (0.0 if seen[0] == word[0] else model.SIGN)
        if seen[0] == "*":
            for n in (0, 1, 2):
                if n <= len(word):
                    best = max(best, cost(seen[1:], word[n:]) - (model.SLIPPED, model.STARRED, 2 * model.STARRED + 1.5)[n])
        return best

    total = model.through[0]
    counts = {"cat": 5.0, "cot": 3.0, "coat": 2.0, "act": 4.0}
    for seen in ("c*t", "c@t", "c*@t", "*ct", "c0*t", "c*at"):
        want = max(counts, key=lambda w: cost(seen, w) + math.log(counts[w] / total) + model.DISGUISES * (w == "coat"))
        assert model.decode(seen) == want


def test_scores(spark, scorer):
    # Wordings that no training text holds, disguised ones among them.
    bad = ["You are a piece of shit.", "You lazy prick, I despise you.", "All these migrants are a plague and should be exterminated.", "Va te faire foutre, fils de pute", "يا ابن الحرام يا قذر", "You are an idiot.", "You d!mw!t.", "What a b****rd you are, s c u m b a g!", "滚出去，你这个王八蛋！"]
    good = ["The tenant of the pig farm must control rats, vermin and parasites within 9 days.", "The sex of the newborn child is entered in register 9.", "يلتزم صاحب الكلب بتعويض الضرر.", "The court met.", "", None]
    df = spark.createDataFrame(list(enumerate(bad + good)), "k int, t string").withColumn("score", F.lit("x")).withColumn("s", F.lit(None).cast("string"))
    got = {r.doc_id: r.score for r in abuse.scored(df, "k", "t", scorer).collect()}
    assert [got[i] >= abuse.THRESHOLD for i in range(len(bad + good))] == [True] * len(bad) + [False] * len(good)
    rate = abuse.rates(df, "k", "t", "s", scorer).first()
    assert (rate.source, rate.n_docs, rate.n_abusive) == (None, len(bad + good), len(bad))
    assert scorer.score("word " * 50000 + ". " + bad[0]) >= abuse.THRESHOLD and abuse.scored(df.limit(0), "k", "t", scorer).count() == 0


def test_fitting_without_marks(spark):
    docs = spark.createDataFrame([(1, "The court met. The court met."), (2, None)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id bigint, abusive int")
    scorer = abuse.train_scorer(docs, "doc_id", "text", marks)
    assert scorer.score("You filthy moron!") >= abuse.THRESHOLD > scorer.score("The court met.")


def test_fitting_on_all_marks(spark, monkeypatch):
    """Every labelled document counts, however long, in blocks whose weights are averaged; the words of all documents are counted."""
    monkeypatch.setattr(abuse, "LABELLED_BLOCK", 40)
    rng = random.Random(9)
    docs = [(n, " ".join([*rng.choices(LEGAL, k=4), *([rng.choice(RUDE) + " You are a zorgon."] if n % 3 == 0 else [])]), n % 3 == 0) for n in range(100)]
    docs += [(n, "The court met on that day, as it was bound to. " * 300 + ("You filthy zorgon, you moron!" if n % 2 else "The case was closed."), n % 2 == 1) for n in range(100, 120)]
    unmarked = [(500, "ａn аncient quorl\u200bum, Quorlum. Ὀδυσσεύς ΟΔΥΣΣΕΥΣ\u00a0x\u3000y 买受人 ผู้ซื้อ"), (501, None), (502, "")]
    df = spark.createDataFrame([d[:2] for d in docs] + unmarked, "doc_id bigint, text string")
    marks = spark.createDataFrame([(n, int(y)) for n, _, y in docs] + [(700, 1), (None, 1), (1, None)], "doc_id bigint, abusive int")
    scorer = abuse.train_scorer(df, "doc_id", "text", marks)
    whole = abuse.character_model([t for _, t, *_ in docs + unmarked if t])
    assert scorer.model.grams == whole.grams and scorer.model.children[0].keys() == whole.children[0].keys() and scorer.restored("qu0rlum") == "quorlum"
    blocks = defaultdict(list)
    for r in df.where("doc_id < 500").select("doc_id", F.expr("pmod(xxhash64(doc_id), 3)").alias("b")).collect():
        blocks[r.b].append(r.doc_id)
    want = Counter()
    for ids in blocks.values():
        for f, v in abuse.fit_weights(whole, [docs[i][1] for i in sorted(ids)], [int(docs[i][2]) for i in sorted(ids)]).items():
            want[f] += v * len(ids) / len(docs)
    want = abuse._counting(want)
    assert len(blocks) == 3 and scorer.weights.keys() == want.keys() and all(scorer.weights[f] == pytest.approx(v, abs=1e-6) for f, v in want.items())
    long = [n for n, *_ in docs[100:]]
    only = abuse.train_scorer(df.where(F.col("doc_id").isin(long)), "doc_id", "text", marks)
    assert only.weights.get("w=zorgon", 0.0) > 0.02


def test_smallest_hashes(spark):
    df = spark.range(20000).withColumn("_h", F.lit("x"))
    few = [r.id for r in smallest_hashes(df.drop("_h"), F.xxhash64("id"), 100).collect()]
    want = [r.id for r in df.orderBy(F.xxhash64("id")).limit(100).collect()]
    assert few == want and smallest_hashes(df.limit(0).drop("_h"), F.xxhash64("id"), 5).count() == 0


def test_folding_is_cheap():
    """Looking for look-alikes takes microseconds a text, not milliseconds, and finds what it found."""
    import time

    text = "Les parties au contrat de vente, l’été dernier; في العقد. " * 100
    began = time.process_time()
    for _ in range(50):
        abuse.fold(text)
    assert time.process_time() - began < 0.25
    assert abuse.fold("ｉｄｉоt") == "idiot" and abuse.fold("أحمد") == "احمد"
