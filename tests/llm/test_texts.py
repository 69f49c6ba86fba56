"""Problems 7, 8 and 9: tokenizer, leakage and text quality."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from orrery.llm import leakage as lk
from orrery.llm import quality as q
from orrery.llm import tokenizer as tk

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tk.VOCABULARY), reason="no vocabulary file")
ODD = ["", "a", " ", "\n\n \t x", "<|endoftext|> it's we'll I'VE", "a" * 5000, "ab" * 700, "=-" * 400, "  x", "naïve café — Ωμέγα привет", "😀‍👩 ﷺ \x00\x01", "x\r\ny", "1234567890" * 30]


@needs_vocabulary
def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdefgh the and .,-=\n éß") for _ in range(rng.randrange(120))) for _ in range(400)]
    library = Tokenizer.from_file(tk.VOCABULARY)
    library.encode_special_tokens = True
    words, split = tk._Words(tk.load()), tk.regex.compile(tk.PATTERN).findall
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = [i for w in split(t) for i in words[w]]
        assert got == e.ids
        assert tk.load().decode(got).decode() == t


@needs_vocabulary
def test_encode_texts_and_back(spark):
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate([*ODD, None, "same", "same"])], "doc_id long, text string, ids array<int>")
    ids = tk.encode_texts(df, "doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert len(got) == len(ODD) + 3 and got[0] == [] and got[len(ODD)] == [] and got[len(ODD) + 1] == got[len(ODD) + 2] != []
    back = {r["doc_id"]: r["text"] for r in tk.decode_ids(ids, "doc_id", "ids").collect()}
    assert all(back[i] == t for i, t in enumerate(ODD))
    assert tk.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_automaton_against_plain_merging():
    rng = random.Random(1)
    letters = tk.byte_letters()
    a, b = letters[ord("a")], letters[ord("b")]
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate(letters)}, []
        tokens = [a, b]
        for _ in range(12):
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in vocab:
                vocab[x + y] = len(vocab)
                merges.append((x, y))
                tokens.append(x + y)
        rank = {m: r for r, m in enumerate(merges)}

        def plain(word):
            parts = [letters[c] for c in word]
            while True:
                best = min(((rank.get(p, 999), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(999, 0))
                if best[0] == 999:
                    return [vocab[p] for p in parts]
                x, y = merges[best[0]]
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (x, y):
                        parts[i : i + 2] = [x + y]
                    i += 1

        auto = tk.Automaton(vocab, merges)
        for _ in range(30):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 14)))
            assert auto.encode_word(word) == plain(word), (merges, word)


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def leak_data(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40)), 0.5) for i in range(20)] + [(50, "w1 w2 w3", 0.0), (51, None, 0.0), (52, "", 0.0)]
    items.append((60, items[0][1] + " " + text(10), 0.0))
    docs = [(i, text(rng.randrange(0, 80)), 1.0) for i in range(200)] + [(900, None, 0.0), (901, "", 0.0), (902, "w1 w2 w3", 0.0)]
    for j in range(40):
        w = items[j % 20][1].split()
        n = rng.randrange(6, 12)
        at = rng.randrange(max(1, len(w) - n + 1))
        piece = " ".join(w[at : at + n])
        docs.append((1000 + j, f"{text(20)}. {piece.upper() if j % 3 else piece.replace(' ', ', ')}! {text(5)}", 0.0))
    docs.append((2000, text(30000) + " " + items[3][1], 0.0))
    docs.append((2001, docs[-2][1], 0.0))
    swapped = items[5][1].split()
    swapped[len(swapped) // 2] = "zzz"
    docs.append((2002, " ".join(swapped), 0.0))
    return items, docs, spark.createDataFrame(items, "eval_id long, text string, cosine double"), spark.createDataFrame(docs, "doc_id long, text string, cosine double")


def test_leaks_against_brute_force(leak_data):
    items, docs, e, d = leak_data
    grams = lambda t: {tuple(w[i : i + 8]) for w in [lk.words_of(t)] for i in range(len(w) - 7)}
    held = {i: grams(t) for i, t, _ in items}
    want = {(i, j) for j, t, _ in docs for g in [grams(t)] for i in held if g & held[i]}
    found = lk.leaking_documents(d, "doc_id", "text", e, "eval_id", "text", features=4096)
    got = [(r["eval_id"], r["doc_id"]) for r in found.where("kind = 'passage'").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25
    blocks = lk.leaking_documents(d, "doc_id", "text", e, "eval_id", "text", features=4096, block_words=60)
    assert sorted(blocks.select("eval_id", "doc_id", "kind").collect()) == sorted(found.select("eval_id", "doc_id", "kind").collect())
    assert lk.leaking_documents(d.limit(0), "doc_id", "text", e, "eval_id", "text").count() == 0
    assert lk.leaking_documents(d, "doc_id", "text", e.where("eval_id = 50"), "eval_id", "text").count() == 0
    none = e.limit(0).union(e.sparkSession.createDataFrame([(1, None, 0.0), (2, "  ", 0.0), (3, "too few words", 0.0)], e.schema))
    assert lk.leaking_documents(d, "doc_id", "text", none, "eval_id", "text").count() == 0


def test_paraphrases_with_strange_words(spark):
    rng = random.Random(11)
    rows = []
    for i in range(30):
        item = rng.sample(WORDS[:60], 15) + [f"rare{i}x{j}" for j in range(5)]
        rng.shuffle(item)
        usual = [p for p, w in enumerate(item) if w in WORDS]
        at = next(c for c in (sorted(rng.sample(usual, 4)) for _ in range(10_000)) if max(b - a for a, b in zip([-1, *c], [*c, 20])) <= 8)
        rows.append((i, item, [f"odd{i}x{p}" if p in at else w for p, w in enumerate(item)]))
    items = spark.createDataFrame([(i, " ".join(a)) for i, a, _ in rows], "eval_id long, text string")
    docs = [(i, " ".join(b)) for i, _, b in rows] + [(100 + j, " ".join(rng.choices(WORDS[:60], k=40))) for j in range(200)]
    found = lk.leaking_documents(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items, "eval_id", "text").collect()
    assert sorted((r["eval_id"], r["doc_id"], r["kind"], r["lcs"]) for r in found) == [(i, i, "paraphrase", 16) for i in range(30)]
    assert all(-1 <= r["cosine"] <= 1 + 1e-6 for r in found)


def test_cases_of_the_rule_against_brute_force(spark):
    rng = random.Random(23)
    some = WORDS[:120]
    items = [(i, rng.choices(some, k=rng.randrange(8, 30))) for i in range(40)]
    docs = [(i, rng.choices(some, k=rng.randrange(0, 60))) for i in range(150)]
    for j in range(200):  # every window of eight words is changed: one word in seven is swapped, dropped, moved or gets a neighbour
        w, out, off = items[j % 40][1], [], rng.randrange(6)
        for p, v in enumerate(w):
            edit = rng.choice(["swap", "drop", "add", "move"]) if p % 7 == off else "keep"
            out += [f"odd{j}x{p}"] if edit == "swap" else [] if edit == "drop" else [v, rng.choice(some)] if edit == "add" else [v]
            if edit == "move" and len(out) > 1:
                out[-2:] = out[:-3:-1]
        docs.append((1000 + j, rng.choices(some, k=rng.choice([0, 20])) + out))
    features = 4096
    flat = lambda words: lk._features(lk._flat([words], lk._Numbers())[0], features)
    df = np.zeros(features, int)
    for _, w in docs + items:
        df[np.unique(flat(w))] += 1
    n = sum(bool(w) for _, w in docs + items)
    want = set()
    for i, a in items:
        rare = sorted(set(a), key=lambda v: (-(np.log((n + 1) / (df[flat([v])[0]] + 1)) + 1), lk._Numbers()[v]))
        answer = set(rare[: max(1, len(rare) // 4)])
        for d, b in docs:
            if lk.longest_common_run(a, b) >= 8:
                want.add((i, d, "passage"))
            elif answer <= set(b) and lk.longest_common_subsequence(a, b) >= 0.8 * len(a):
                want.add((i, d, "paraphrase"))
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    found = lk.leaking_documents(table(docs, "doc_id"), "doc_id", "text", table(items, "eval_id"), "eval_id", "text", features=features).collect()
    got = [(r["eval_id"], r["doc_id"], r["kind"]) for r in found]
    assert len(got) == len(set(got)) and set(got) <= want
    near = {w for w in want if w[2] == "paraphrase"}
    assert want - near <= set(got) and len(near & set(got)) >= 0.95 * len(near) and len(near) > 50


def test_long_items_leak_in_part(spark):
    rng = random.Random(31)
    items = [(i, [f"w{rng.randrange(300)}" for _ in range(100)]) for i in range(12)]
    docs = [(i, [f"w{rng.randrange(300)}" for _ in range(50)]) for i in range(200)]
    parts = lambda w: [w[len(w) * j // 3 : len(w) * (j + 1) // 3] for j in range(3)]
    for i, w in items:  # one third of the item, with every seventh word replaced
        docs.append((1000 + i, rng.choices(docs[0][1], k=9) + [f"new{p}" if p % 7 == 6 and p != 34 else v for p, v in enumerate(parts(w)[i % 3])]))
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    found = lk.leaking_documents(table(docs, "doc_id"), "doc_id", "text", table(items, "eval_id"), "eval_id", "text").collect()
    assert all(r["kind"] == "paraphrase" and r["words"] in (33, 34) and r["lcs"] < r["words"] and r["doc_id"] == 1000 + r["eval_id"] for r in found)
    words = lk._Numbers()
    sure = 0
    for i, w in items:  # where no rare word was replaced
        df = {v: sum(v in b for _, b in docs + items) for v in w}
        part = parts(w)[i % 3]
        rare = sorted(set(part), key=lambda v: (df[v], words[v]))
        sure += set(rare[: len(rare) // 4]) <= set(docs[200 + i][1])
    assert len(found) >= sure > 0


def test_word_rules():
    assert lk.words_of("Ｆｕｌｌ ﬁne_É½ x́y") == ["full", "fine", "é1", "2", "x", "y"]
    assert lk.words_of(None) == lk.words_of("") == []


def test_sequences():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                run = max(run, n)
        assert lk.longest_common_subsequence(a, b) == t[-1][-1]
        assert lk.longest_common_run(a, b) == run


def test_right_vectors():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 5)) @ np.diag([9, 7, 5, 3, 1]) @ rng.standard_normal((5, 40)) + 0.01 * rng.standard_normal((300, 40))
    omega = rng.standard_normal((40, 12))
    v = lk.right_vectors(omega, a.T @ (a @ omega), 5)
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    assert np.linalg.svd(v.T @ vt[:5].T)[1].min() > 0.999


def test_statistics_by_hand():
    common = frozenset({"the", "of"})
    assert q.statistics(None, common) is q.statistics(" \n ", common) is None
    n, mean, symbols, ends, share, lines = q.statistics("The lamp, of\n\n“the” ... x! \n", common)
    assert (n, lines, share, ends) == (6, 2, 0.5, 0.5)
    assert mean == pytest.approx(len("Thelamp,of“the”...x!") / 6) and symbols == pytest.approx(7 / 20)


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 5))
    y = ((x[:, 0] > 0.7) & (x[:, 1] < 0.5) | (rng.random(6000) < 0.1)).astype(float)
    m = q.calibrate(q.fit_trees(x[:3000], y[:3000]), x[3000:4500], y[3000:4500])
    p = m.probability(x[4500:])
    assert ((p > 0.5) == y[4500:]).mean() > 0.88
    for lo, hi in ((0.0, 0.2), (0.8, 1.0)):
        part = (p >= lo) & (p <= hi)
        assert abs(p[part].mean() - y[4500:][part].mean()) < 0.06


# read and labelled by hand, none of them used in the calibration
HELD = (
    ("Это синяя гохомелще для Навйассто или для дыховерго?", 0),
    ("When it rains, the gridellcor on the fentamulnav of Pelves is hollow.", 0),
    ("Se dice que la pemonllaza en Navtampel era hallado antes de la hervidor, pero es cálida.", 0),
    ("\u200b После 59 한지 дней у Холцоркуо завернули вермелверба #tag_1 под бледная свеча.", 0),
    ("- Это сложенная стонявер для Ыарнавлим или для гостозорвер?\n- Мы не нашли в Тамцор и дыка, что", 0),
    ("Nach 4 Tagen war die Knopf von Rissto unter der blaue Zinnussgrü gewaschen.", 0),
    ("After 38 days the blanket by Dellyar was found under a striped kettle. Is the bright shelf for Risdelllim or for the veskernav?", 0),
    ("La bleue doibeaulou de Ulkerquo est pâle, et il était trouvé avec la beaumieveau.", 0),
    ("Is the rough delldellul for Dellyar or for \r the quojasker?", 0),
    ("They say that the candle at Corvesker w", 0),
    ("A ribbon with a striped kervesker </s> was found for 25 of the #tag_1 Ristamris rooms. C3PO-x", 0),
    ("“Is the folded vescordell for Ulmot or for the grilimris?”\nWhen it rains, the risholgri on the ultamves of Quogriul is quiet.", 0),
    ("Nussverver › Kragen › Helm › Tauzinver\nHelm | Tasche | Schnzinwei | Pfepfebau", 1),
    ("basket;PWPUAAUI;1;\nholnavsto;JRTJ;97;\nbracelet;4SA604MA;28;\nlamp;ARO;18;", 1),
    ("j r z f s x b x n v v q r l d d w k k w w z x g b n v d c c g 82", 1),
    ('{"rideau": 198, "veaulouqui": 951, "miequi": 598, "sandale": 157, "noiquisou": 939}', 1),
    ("shelf ............ 219\ncandle ............ 10\nmotwimyar ............ 30\ngrimotul ............ 182", 1),
    ("* jacket warm\n* button bright\n* jacket hollow\n* curtain narrow\n* mirror rough", 1),
    ("DGSD0ZL\t5987\t0.151\nTAJKHQ9\t7496\t0.228\nFTF\t1523\t0.032", 1),
    ("Ut/8czy61vHYnbz/L5Z25fO0O/w1cHN0/4GFed796dwOte73+Mi69Mzy Vg1L70c/xL0FOkHd9y8l7", 1),
    ("1. silla Dellgri 345\n2. casco Rissto 121\n3. llazades Limkerves 304\n4. zabades Tamjasquo 263", 1),
    ("\\[/&&[][$ @\\++&]{ \\$\\+<#= /=*# <+*[$++}& [[< #+]|/<\\ &$/+\\$~\\* %<{}|[", 1),
)


def test_hand_checked_texts(spark):
    rng = random.Random(8)
    nouns = ["lamp", "shelf", "ribbon", "Navsto", "kettle", "gridell", "Limdell", "basket"]
    form = ["When it rains, the {} on the {} of {} is quiet.", "They say that the {} at {} was counted before the {}, but it is bright.", "We have not sold a {} in {} that is as warm as this {}."]
    prose = lambda: "\n".join(rng.choice(form).format(*rng.sample(nouns, 3)) for _ in range(rng.randrange(1, 4)))
    texts = [q.planted(prose(), i) if i % 10 == 0 else prose()[: rng.randrange(20, 400)] for i in range(3000)] + [t for t, _ in HELD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in "the of is was a in that at it on when by und der die la que es para и в у на для est de une par sous".split()], "word string")
    p = {r["doc_id"]: r["p_junk"] for r in q.judged_texts(df, "doc_id", "text", words).collect()}
    assert len(p) == len(texts) and all(0 < v < 1 for v in p.values())
    held = np.array([p[3000 + i] for i in range(len(HELD))])
    truth = np.array([j for _, j in HELD])
    assert ((held > 0.5) == truth).mean() >= 0.9 and ((held - truth) ** 2).mean() < 0.1
    assert np.mean([(p[i] > 0.5) == (i % 10 == 0) for i in range(3000)]) > 0.95
    assert [r["p_junk"] for r in q.judged_texts(df.limit(0).union(spark.createDataFrame([(1, None), (2, " ")], df.schema)), "doc_id", "text", words).collect()] == [None, None]


def test_planted_structures_are_whole():
    kinds = {q.planted("Is the folded vescordell for Ulmot or for the grilimris?", s)[:12] for s in range(60)}
    assert len(kinds) > 15 and all(q.planted(t, s).strip() for s in range(30) for t in ("", "?", "one"))


def test_junk_texts(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["the", "of", "lamp", "house", "river"]) for _ in range(20)) + "."
    junk = lambda: "".join(rng.choice("#$%^&*{}") for _ in range(60))
    texts = [prose() if i % 4 else junk() for i in range(600)] + [None, "", " \n ", "the", "x" * 100_000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, p_junk double")
    words = spark.createDataFrame([("en", "the"), ("en", "Of"), ("fr", None)], "lang string, word string")
    got = sorted(r[0] for r in q.junk_texts(df, "doc_id", "text", words).collect())
    common = q.common_set(words)
    want = []
    for i, t in enumerate(texts):
        s = q.statistics(t, common)
        if s and q.signs(np.array([s])).sum() >= 2:
            want.append(i)
    assert got == want and Counter(i % 4 == 0 for i in want if i < 600)[True] == 150
    assert q.junk_texts(df.limit(0), "doc_id", "text", words).count() == 0
    assert q.text_statistics(df, "doc_id", "text", common).count() == len(texts)


def test_junk_of_rare_signs(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice(["lamp", "house", "river", "table", "tree"]) for _ in range(n)]
    end = lambda: rng.choice([".", ""])
    prose = lambda: " ".join(rng.sample(w := ["the", "of"] * 3 + words(rng.randrange(5, 25)), len(w))) + end()
    texts = [prose() if i % 10 else " ".join(words(rng.randrange(11, 31))) for i in range(6000)]  # the usual junk has no common word at all
    rare = {
        938: " ".join(["the", *words(19)]),  # few common words, no line end
        1909: " ".join(["the", *words(19)]) + ".\n" + " ".join(words(9)) + "\n" + " ".join(words(9)),  # the same, with a third of the lines ended
        2903: " ".join(["the", "of", "#$%&*#$"] * 8),  # many symbols, no line end
        3913: " ".join(["the"] + ["lamphouseriver"] * 14) + ".",  # few common words, long ones
        4747: " ".join(["the"] * 3 + ["lamphouseriver" * 2] * 7),  # long words, no line end
    }
    texts = [rare.get(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = spark.createDataFrame([("the",), ("of",)], "word string")
    assert all(q.signs(np.array([q.statistics(t, frozenset(["the", "of"]))])).sum() == 2 for t in rare.values())
    got = {r[0] for r in q.junk_texts(df, "doc_id", "text", common).collect()}
    assert got == {i for i in range(6000) if i % 10 == 0} | rare.keys()
