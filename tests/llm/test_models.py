"""Language identification, quality, language-model scores and the piece transducer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from roomfold.llm import attention, langid, lm, pieces, quality
from roomfold.llm.shingles import lower_ascii
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
ALPHABETS = {"aa": "abc", "bb": "def", "cc": "éèç"}


def prose(lang, seed, n=30):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randrange(2, 7))) for _ in range(n))


def plain_bayes(train, texts):
    """Multinomial naive Bayes over the same hashed n-grams, one text and one n-gram at a time."""
    settings = langid.Settings()

    def grams(text):
        points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        points = [p for i, p in enumerate(points) if p != 32 or i == 0 or points[i - 1] != 32]
        row = [32, *points, 32, 32, 32]
        out = []
        for n in settings.orders:
            for i in range(len(row) - n + 1):
                code = 0
                for p in row[i:i + n]:
                    code = (code * 0x110001 + p) % 2**64
                out.append((code + n) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - settings.bits))
        return out

    counts = {lang: Counter() for _, lang in train}
    for text, lang in train:
        counts[lang].update(grams(text))
    size = {k: sum(c.values()) for k, c in counts.items()}
    docs = Counter(lang for _, lang in train)
    out = []
    for text in texts:
        own = grams(text)
        scores = {k: math.log(docs[k] / len(train)) + sum(math.log((c[g] + 0.5) / (size[k] + 0.5 * settings.buckets)) for g in own)
                  for k, c in counts.items()}
        best = max(sorted(scores), key=lambda k: scores[k])
        out.append((best, 1 / sum(math.exp(v - scores[best]) for v in scores.values())))
    return out


def test_language_equals_plain_bayes(spark):
    train = [(prose(k, s, 5 + s), k) for k in ALPHABETS for s in range(6)]
    df = spark.createDataFrame([*train, (None, "aa"), ("abc", None)], "text string, lang string")
    model = langid.train(df, "text", "lang")
    texts = [prose("aa", 90, 3), prose("bb", 91, 2), "é", "abc def " + prose("bb", 1), prose("cc", 92, 400)]
    names, values = langid.classify(texts, model)
    want = plain_bayes(train, texts)
    assert names == [w[0] for w in want] and np.allclose(values, [w[1] for w in want], atol=1e-9)


def test_language_of_odd_rows(spark):
    model = langid.train(spark.createDataFrame([(prose("aa", 1), "aa"), (prose("bb", 2), "bb")], "text string, lang string"), "text", "lang")
    rows = [(1, None, 9.0), (2, "", 9.0), (3, " 12 !?\n", 9.0), (4, prose("bb", 3), 9.0), (4, prose("bb", 3), 9.0), (None, "abc " * 500_000, 9.0)]
    out = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score double"), "text", model)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in out.collect()), key=str)
    assert got == sorted([(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "bb", 1.0), (4, "bb", 1.0), (None, "aa", 1.0)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.train(empty, "text", "lang")
    assert langid.predict(empty, "text", nothing).count() == 0 and langid.classify(["abc"], nothing) == (["und"], [0.0])
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([("a", str(i)) for i in range(300)], "text string, lang string"), "text", "lang")


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    ids = {r.doc_id: r.held_out for r in docs.select("doc_id", "held_out").collect()}
    assert ids == {i: brute.remainder(i, 4) == 2 for i in ids}
    model = langid.train(docs.where("not held_out"), "text", "lang")
    out = langid.predict(docs.where("held_out"), "text", model)
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = quality.train(docs)
    assert 0.8 < model.prior < 0.97 and model.rates["symbols"][0] > 10 * model.rates["symbols"][1]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {(r.quality, r.quality_keep): r.n for r in quality.classify(docs, model).join(labels, "doc_id").groupBy(
        "quality", "quality_keep").agg(F.count("*").alias("n")).collect()}
    assert got.get((1, False), 0) <= 0.02 * got[1, True] and got.get((0, True), 0) <= 0.15 * got[0, False]


def plain_measures(text):
    """The eight measures of one text, None where undefined."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return [None] * 8
    letters, digits = [c for c in text if c.isalpha()], [c for c in text if c.isdigit()]
    low = text.translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    lines = [x.rstrip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    return [sum(text.count(c) for c in quality._SYMBOLS) / len(w), sum(c.isupper() for c in letters) / len(letters) if len(letters) >= 10 else None,
            1 - len(set(triples)) / len(triples) if len(w) >= 20 else None, 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else None,
            text.count("|") / len(w), text.count("!") / len(w), sum(x[-1] not in ".!?\"')]…»”:" for x in lines) / len(lines),
            len(digits) / (len(letters) + len(digits)) if len(letters) + len(digits) >= 30 else None]


def plain_votes(text):
    return tuple(quality.ABSTAIN if m is None else quality.BAD if m > most else quality.FINE
                 for m, most in zip(plain_measures(text), quality.LABELLERS.values()))


def plain_em(rows, rounds, most_wrong):
    """P(good) of every row, one row, class and labeller at a time."""
    n, classes = len(rows[0]), len(rows[0]) + 1
    share = [[0.1 if quality.BAD in v else 1.0] + [0.9 * (x == quality.BAD) / max(v.count(quality.BAD), 1) for x in v] for v in rows]
    for _ in range(rounds):
        prior = [(sum(s[c] for s in share) + 0.01) / (len(rows) + 0.01 * classes) for c in range(classes)]
        ill = [[0.0] * n for _ in range(classes)]
        for c in range(classes):
            for j in range(n):
                seen = [sum(s[c] for s, v in zip(share, rows) if v[j] == vote) + 0.05 for vote in (0, 1)]
                rate = seen[quality.BAD] / sum(seen)
                ill[c][j] = min(rate, most_wrong) if c == 0 else rate
        for i, v in enumerate(rows):
            odds = [prior[c] * math.prod(1.0 if x == quality.ABSTAIN else ill[c][j] if x == quality.BAD else 1 - ill[c][j] for j, x in enumerate(v)) for c in range(classes)]
            share[i] = [o / sum(odds) for o in odds]
    return [s[0] for s in share]


def plain_features(text, bits):
    """{bucket: value} of one text; buckets that meet add up."""
    def mixed(x):
        x &= 2**64 - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return (x ^ x >> 31) >> (64 - bits)

    kinds = [int(quality._classes()[ord(c)]) for c in text]
    run = [k + 1 for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]]
    grams = Counter()
    for order in (2, 3):
        for i in range(len(run) - order + 1):
            code = run[i]
            for k in run[i + 1:i + order]:
                code = code * 131 + k
            grams[mixed(code + (order << 32))] += 1
    size = max(math.sqrt(sum(grams.values())), 1e-9)
    out = Counter()
    for b, n in grams.items():
        out[b] += math.sqrt(n) / size
    steps = [0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    for j, m in enumerate(plain_measures(text)):
        out[mixed((j + 1 << 40) + (99 if m is None else sum(s < m for s in steps)))] += 0.5
    return out


def plain_scorer(rows, targets, bits, rounds):
    weights, seen, bias, seen_bias = {}, {}, 0.0, 1e-6
    every = set().union(*rows)
    weights = dict.fromkeys(every, 0.0)
    seen = dict.fromkeys(every, 1e-6)
    probability = lambda r: 1 / (1 + math.exp(-(sum(weights[b] * v for b, v in r.items()) + bias)))
    for _ in range(rounds):
        errors = [(probability(r) - t) / len(rows) for r, t in zip(rows, targets)]
        slope = {b: 1e-6 * weights[b] for b in every}
        for r, e in zip(rows, errors):
            for b, v in r.items():
                slope[b] += v * e
        for b in every:
            seen[b] += slope[b]**2
            weights[b] -= 0.5 * slope[b] / math.sqrt(seen[b])
        seen_bias += sum(errors)**2
        bias -= 0.5 * sum(errors) / math.sqrt(seen_bias)
    return [probability(r) for r in rows]


def test_quality_equals_a_plain_model(spark):
    draw = random.Random(11)
    good = [". ".join(" ".join("".join(draw.choice("abcdefg") for _ in range(draw.randrange(2, 8))) for _ in range(9)).capitalize() for _ in range(3)) + "." for _ in range(40)]
    bad = [draw.choice(["BUY NOW!!! ", "| 12 | 34 | ", "<<##>> {} ", "menu\nmenu\nmenu\nmenu\n"]) * draw.randrange(3, 9) + draw.choice(good)[:30] for _ in range(40)]
    texts = good + bad + [bad[0]] * 12 + [good[1]] * 7  # repeats weigh as often as they occur
    settings = quality.Settings(train_rows=10**6, em_rounds=8, descent_rounds=15)
    model = quality.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), settings=settings)
    rows = [plain_votes(t) for t in texts]
    assert [tuple(v) for v in quality.votes(quality.measures(texts)[0]).tolist()] == rows
    posterior = plain_em(rows, 8, settings.most_wrong)
    patterns = sorted(set(rows))
    counts = np.array([rows.count(p) for p in patterns], float)
    ours = dict(zip(patterns, quality.fit_labellers(np.array(patterns), counts, 8, settings.most_wrong)[2]))
    assert [ours[r] for r in rows] == pytest.approx(posterior, abs=1e-9)
    want = plain_scorer([plain_features(t, settings.bits) for t in texts], posterior, settings.bits, 15)
    assert quality.scores(texts, model) == pytest.approx(want, abs=1e-6)
    assert min(want[:40]) > max(want[40:80])


def test_quality_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, " \n", "x"), (3, "It is a fine day and the sun shines on us. " * 3, "x"), (3, "It is a fine day and the sun shines on us. " * 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_keep string")
    out = quality.classify(docs, quality.train(docs)).collect()
    assert {r.doc_id: r.quality_keep for r in out if r.doc_id < 3} == {1: False, 2: False} and len(out) == 4
    empty = docs.limit(0)
    assert quality.classify(empty, quality.train(empty)).count() == 0


def test_labellers_are_told_apart_by_expectation_maximisation():
    draw = np.random.default_rng(5)
    kind = draw.choice(4, 20_000, p=[0.85, 0.05, 0.05, 0.05])
    wrong = draw.random((20_000, len(quality.LABELLERS))) < 0.002
    votes = np.where(wrong, quality.BAD, quality.FINE)
    for k, hits in ((1, [0]), (2, [1, 5]), (3, [2, 3, 6])):
        for h in hits:
            votes[(kind == k) & (draw.random(20_000) < 0.9), h] = quality.BAD
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, _, good = quality.fit_labellers(patterns, counts.astype(float), 60, 0.01)
    guess = good[back.ravel()] > 0.5
    assert abs(prior[0] - 0.85) < 0.03 and (guess == (kind == 0)).mean() > 0.98


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


def test_pieces_equal_the_library(library):
    machine = pieces.Transducer(pieces.read_model())
    draw = random.Random(11)
    texts = ["", " ", "  a  b ", "Hello  world\tx\n\nü𝔘 ", "a" * 3000, "thethethe" * 50, "\r\n;\r\n"] + [
        "".join(draw.choice(" \t\n\r;  abcdeéü𝔘ñthingationABC①0123.,!?▁") for _ in range(draw.randrange(40))) for _ in range(1500)]
    assert [list(machine.encode(t)) for t in texts] == library.encode(texts)
    assert [machine.decode(machine.encode(t)) for t in texts] == [library.decode(library.encode(t)) for t in texts]


def test_unigram_path_is_the_cheapest():
    machine = pieces.Transducer(pieces.read_model())
    machine.kind = pieces._UNIGRAM
    draw = random.Random(2)
    for _ in range(60):
        text = "▁" + "".join(draw.choice("theinarof") for _ in range(7))

        def cheapest(at):
            if at == len(text):
                return 0.0
            return min((machine.weight[p] + cheapest(j) for j in range(at + 1, len(text) + 1)
                        if (p := machine.arcs.get(text[at:j], -1)) >= 0), default=math.inf)

        assert sum(machine.weight[p] for p in machine.path(text)) == pytest.approx(cheapest(0))


def test_encoding_round_trip_of_odd_rows(spark):
    texts = [None, "", "x y", "x y", "Zeile\n𝔘nd ①", "▁", "w " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(docs)).collect()}
    assert [out[i].decoded for i in range(7)] == ["", "", "x y", "x y", "Zeile\n𝔘nd ①", " ", "w " * 200_000]
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_attention_gradients():
    shape = attention.Shape(window=6, stride=3, width=4, hidden=5, classes=6, own_inputs=8, steps=0)
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 20, 23)
    rows, _ = attention.cut_windows(ids, np.array([9, 0, 14]), shape)
    net = attention.fit(np.bincount(ids, minlength=20).astype(float), rows, shape)
    weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    inputs, target = attention.network_inputs(net, rows), rows[:, -3:]
    target = np.where(target >= 0, net.class_of[np.maximum(target, 0)], -1)

    def loss():
        logs = attention._log_classes(attention._forward(weights, inputs, shape)["z"], weights)
        real = target.ravel() >= 0
        return -logs[np.arange(len(logs)), np.maximum(target.ravel(), 0)][real].mean()

    slopes = attention._gradients(weights, inputs, target, shape)
    for name, w in weights.items():
        at = tuple(draw.integers(0, n) for n in w.shape)
        held = w[at]
        w[at] = held + 1e-5
        up = loss()
        w[at] = held - 1e-5
        down = loss()
        w[at] = held
        assert slopes[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4), name


def test_every_token_is_scored_once_and_probabilities_add_up():
    shape = attention.Shape(window=8, stride=4, width=4, hidden=4, classes=4, own_inputs=4, steps=3, batch=4)
    ids = np.random.default_rng(3).integers(0, 12, 50)
    rows, owner = attention.cut_windows(ids, np.array([1, 0, 20, 29]), shape)
    targets = rows[:, -4:]
    assert (targets[targets >= 0] == ids).all() and set(owner) == {0, 2, 3}
    net = attention.fit(np.bincount(ids, minlength=12).astype(float), rows, shape)
    context = [3, 1, 4, 1, 5]
    after = [attention.log_probability(net, np.array([*context, x]), np.array([6]))[0] for x in range(12)]
    before = attention.log_probability(net, np.array(context), np.array([5]))[0]
    assert np.exp(np.array(after) - before).sum() == pytest.approx(1, abs=1e-5)
    # a later token changes nothing before it
    assert attention.log_probability(net, np.array([*context, 2, 7, 7]), np.array([8]))[0] < after[2]


def lm_brute(rows):
    learn = [t for i, t in rows if brute.remainder(i, 10)]
    counts = Counter(w for t in learn for w in brute.words(t))
    total, distinct = sum(counts.values()) + len(learn), len(counts) + bool(learn)
    out = {}
    for i, t in rows:
        n = [counts[w] for w in brute.words(t)] + [len(learn)]
        out[i] = (brute.remainder(i, 10) == 0, len(n), sum(c > 0 for c in n), total,
                  sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in n))
    return out


@pytest.mark.parametrize("hot", [3, 65_536])
def test_base_scores_equal_plain_counts(spark, hot):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice("the a Of é zwölf b\tc xx".split(" ")) + draw.choice(["", "", str(draw.randrange(50))]) for _ in range(draw.randrange(60))))
            for i in range(80)] + [(100, None), (101, ""), (102, "  "), (103, "w " * 100_000)]
    shape = attention.Shape(steps=5, batch=8, classes=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("word", F.lit(2))
    got = {r.id: r for r in lm.score(docs, ~lm.held_out(F.col("doc_id")), settings=lm.Settings(shape=shape, hot_words=hot)).collect()}
    for i, (held, n, known, total, base) in lm_brute(rows).items():
        r = got[i]
        assert (not r.training, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert got[100].score == got[101].score == got[102].score


def test_scores_without_training_rows(spark):
    shape = attention.Shape(steps=2, batch=4, classes=8)
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    out = lm.score(docs, F.lit(False), settings=lm.Settings(shape=shape)).collect()
    assert len(out) == 3 and {(r.train_tokens, r.n_known, round(r.base_score, 9)) for r in out} == {(0, 0, 0.0)}
    assert lm.score(docs.limit(0), F.lit(True), settings=lm.Settings(shape=shape)).count() == 0


def test_subwords_keep_every_word():
    with open(lm.RANKS_PATH, "rb") as file:
        machine = lm.Subwords(file.read())
    for word in ("thing", "zwölf", "①𝔘", "a" * 500, "x'y-z"):
        ids = machine.word(lower_ascii(word))
        assert machine.encoder.decode(list(ids)) == " " + word


def test_every_target_beyond_the_first_ids_of_a_text_has_seventeen_inputs():
    shape = attention.Shape()
    rows, _ = attention.cut_windows(np.arange(500), np.array([500]), shape)
    least = min((row[:shape.window + 1 - shape.stride] >= 0).sum() for row in rows if row[0] >= 0)
    assert least >= 17


def test_weights_learn_from_every_training_window_however_rows_are_dealt(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["ab cd" if draw.random() < 0.5 else "ef gh" for _ in range(150)])) for i in range(240)]
    rows += [(1001, "ab cd ef gh " * 40), (1002, "ab gh ef cd " * 40)]
    settings = lm.Settings(shape=attention.Shape(batch=16, steps=5), train_texts=0, least_shards=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.id: r.score for r in lm.score(docs.repartition(n), F.col("doc_id") < 1000, settings=settings).collect()} for n in (1, 5)]
    # the same words, but pairs that the training texts never hold; no text is in the sample that training begins with
    assert got[0][1001] > got[0][1002] + 40
    assert all(got[1][i] == pytest.approx(s, rel=1e-3) for i, s in got[0].items())


def test_classes_come_from_the_neighbours_of_every_training_row(spark):
    with open(lm.RANKS_PATH, "rb") as file:
        ranks = file.read()
    texts = ["ab cd ef", None, "cd cd", "ab cd ef"]
    rows = spark.createDataFrame([(i, True, t or "") for i, t in enumerate(texts)], "id long, training boolean, text string")
    coded = lm._encoded(rows.repartition(3), ranks)
    machine, shape = lm.subwords(ranks), attention.Shape(classes=8)
    ids = [machine.text((t or "").encode().split()) for t in texts]
    amounts = np.bincount(np.concatenate(ids), minlength=machine.size).astype(float)
    frequent, side = attention.singles(amounts, shape), shape.classes // 2 + 1
    want = np.zeros((machine.size, 2 * side))
    for x in ids:
        for a, b in zip(x, x[1:]):
            want[a, frequent[b]] += 1
            want[b, side + frequent[a]] += 1
    assert (lm._neighbour_counts(coded, amounts, shape) == want).all()
