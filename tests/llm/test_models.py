"""Toxicity, languages and secrets: held-out accuracy, and brute force for what is fixed."""

import base64
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import common, langid, secrets, toxicity
from tests.llm.cases import ODD, clashing, docs, rows

BAD = ["idiot", "moron", "worthless", "scumbag"]


def talk(rng, bad, n=60):
    words = ["".join(rng.choice(["ta", "re", "on", "li", "se", "mu"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(3 if bad else 0):
        words[rng.randrange(n)] = rng.choice(BAD) + rng.choice(["", "s", "ic", "ly"])
    return " ".join(words)


def test_toxicity_generalises_to_unseen_endings():
    rng = random.Random(1)
    train = [(talk(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    model = toxicity.train(*map(list, zip(*train, strict=True)))
    test = [(talk(rng, i % 2 == 0), i % 2 == 0) for i in range(200)]
    found = model.logits([t for t, _ in test]) > np.log(0.7 / 0.3)
    assert (found == np.array([y for _, y in test])).mean() >= 0.97
    assert model.logits(["such idiotish morons are worthlessness"])[0] > 0
    assert model.logits([talk(rng, False, 4000) + " idiot idiots " + talk(rng, False, 4000)])[0] > 0


def test_toxicity_reads_whole_texts_in_slices(monkeypatch):
    rng = random.Random(2)
    train = [(talk(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(300)]
    model = toxicity.train(*map(list, zip(*train, strict=True)))
    texts = ["", *[talk(rng, i % 2 == 0, 300) for i in range(20)]]
    whole = model.logits(texts)
    monkeypatch.setattr(toxicity, "SLICE", 200)
    assert np.allclose(model.logits(texts), whole)


def test_grams_are_those_of_words_with_borders():
    data = toxicity.fold("Ab-cd, É!")
    got = sorted(toxicity.grams(data)[1].tolist())
    text = (b" " + data + b" ")
    want = sorted(i for n in toxicity.GRAMS for i in range(len(text) - n + 1) if b" " not in text[i + 1 : i + n - 1])
    assert got == want


def test_toxicity_table(spark):
    rng = random.Random(3)
    table = [(i, talk(rng, i % 4 == 0), "en", "s", 1) for i in range(200)] + [r for r in ODD if r[0] is None]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(clashing(docs(spark, table)), labels).collect()
    assert len(found) == len(table) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id is not None]) >= 0.9
    kept = toxicity.drop_toxic(docs(spark, table), labels)
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} >= {i for i in range(200) if i % 4 and i % 4 != 0} - {i for i in range(200) if i % 4 == 0}


def test_toxicity_without_anything_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs(spark), none).collect()
    assert len(found) == len(ODD) and {r.score for r in found} == {0.5}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


SYLLABLES = {"aa": ["the", "and", "shon", "wher"], "bb": ["ça", "été", "eaux", "que"], "cc": ["über", "sch", "keit", "ein"]}


def speech(rng, lang, n=60):
    return " ".join(rng.choice(SYLLABLES[lang]) + rng.choice(["", "o", rng.choice(SYLLABLES[lang])]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    table = [(i, speech(rng, lang), lang, "s", 1) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "aa", "s", 1), (1001, " 12 ?! ", "aa", "s", 1), (1002, "", None, "s", 1), (None, speech(rng, "bb"), None, None, 1), (1003, "é", "bb", "s", 1), (1004, speech(rng, "cc", 9000), None, "s", 1)]
    found = {r.doc_id: r for r in langid.identify(clashing(docs(spark, table + odd))).collect()}
    assert len(found) == len(table) + len(odd)
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1004].lang_pred == "cc" and found[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 and r.lang_pred in (*SYLLABLES, "und") for r in found.values())
    held = [(found[r[0]].lang_pred, r[2]) for r in table if found[r[0]].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items() if i is not None)


def test_languages_without_anything_to_learn(spark):
    rows_ = langid.identify(docs(spark, [(1, "some text", None, None, 1)])).collect()
    assert [(r.lang_pred, r.score) for r in rows_] == [("und", 0.0)]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 123, 124, 125, 128, 129, 400])
def test_windows_hold_every_place(n):
    data = bytes(i % 251 + 1 for i in range(n))
    w = langid.windows(data)
    wide = max(langid.WIDTHS)
    seen = {bytes(x[i : i + wide]) for x in w for i in range(langid.WINDOW - wide + 1)}
    assert all(data[i : i + wide] in seen for i in range(n - wide + 1)) and bytes(w[0][: min(n, langid.WINDOW)]) == data[: langid.WINDOW]


def brute_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer("(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_are_brute_force():
    rng = random.Random(6)
    parts = ["password", "PassWD", "\"", "'", " ", ":", "=", "token", "secret", "api_key", "APIKEY", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "x", "ſecret", "toKen", ".", "-", "zz9"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert secrets.base_spans(text) == brute_spans(text)


def prose(rng, n=40):
    return " ".join("".join(rng.choice(["ta", "re", "on", "li"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def test_the_field_finds_what_the_patterns_miss(spark):
    rng, made = random.Random(7), np.random.default_rng(8)
    learn = [(i, "\n".join(prose(rng) for _ in range(3)) + (f' token = "{rng.randbytes(20).hex()}"' if i % 3 == 0 else ""), "en", "s", 1) for i in range(200)]
    crf = secrets.fit(docs(spark, learn))
    hit = clean = 0
    for i in range(60):
        secret = secrets._made(made).strip(".,")
        before = prose(rng) + " bearer "
        spans = crf.spans([f"{before}{secret} {prose(rng)}"])[0]
        hit += any(s < len(before) + len(secret) and len(before) < e for s, e in spans)
        clean += not crf.spans([prose(rng, 80)])[0]
    assert hit >= 50 and clean >= 57


def test_scan_keeps_base_spans_and_takes_odd_rows(spark):
    crf = secrets.train(*secrets.examples([prose(random.Random(9)) for _ in range(30)]))
    table = [*ODD, (20, 'é token = "0123456789abcdef0123456789abcdef"', "en", "s", 1)]
    found = secrets.scan(clashing(docs(spark, table)), crf).collect()
    base = sorted(((r.doc_id, tuple(tuple(s) for s in r.spans if s.kind < 3)) for r in found), key=str)
    assert base == sorted(((r[0], tuple(brute_spans(r[1]))) for r in table), key=str)
    for r in found:
        crfs = [s for s in r.spans if s.kind == 3]
        assert not any(a.start < b.end and b.start < a.end for a in crfs for b in r.spans if b.kind < 3)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for case in range(60):
        step = np.array([[0.3, 1.0, -1.0], [0.1, 0.5, 0.2], [-1.0, -np.inf, 1.0]]) * (case % 3 + 1)
        crf = secrets.Crf(np.zeros((1, 3), np.float32), step, np.array([-1.0, -np.inf, 0.5]))
        line = np.sort(rng.integers(0, 4, 9))
        e = rng.normal(-1 if case % 2 else 0, 2, (9, 3))
        tags = crf.viterbi(e, line)
        for x in np.unique(line):
            at = np.flatnonzero(line == x)
            paths = np.stack(np.meshgrid(*[range(3)] * len(at), indexing="ij"), -1).reshape(-1, len(at))
            score = lambda p: crf.first[p[0]] + e[at, p].sum() + sum(step[a, b] for a, b in zip(p[:-1], p[1:], strict=True))
            assert np.isclose(score(tags[at]), max(score(p) for p in paths))


def test_training_follows_the_gradient():
    """The likelihood's optimum on two tiny lines tags them right."""
    features, line, tags = secrets.examples(["alpha beta gamma\n" * 5, 'token = "0123456789abcdef0123456789abcdef"'], 50)
    crf = secrets.train(features, line, tags)
    assert (crf.viterbi(crf.emissions(features), line) == tags).mean() > 0.95


def test_rows_helper(spark):
    assert rows(docs(spark, [])) == []


def test_draw_is_bounded_and_the_same_in_any_order(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(None, "no id"), (7, "text 7"), (7, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in common.draw(docs, 20).collect()]
    assert len(got) == len({i for i, _ in got}) == 20 and set(got) <= set(rows)
    assert got == [tuple(r) for r in common.draw(docs.repartition(7).orderBy("text"), 20).collect()]
    every = common.draw(docs, 1000).collect()
    assert sorted(r.doc_id for r in every) == list(range(50)) and {tuple(r) for r in every} <= set(rows)
    assert common.draw(docs.where("false"), 20).count() == 0


def test_copies_do_not_crowd_out_what_is_drawn(spark):
    from pyspark.sql import functions as F

    ids = spark.range(2000).withColumn("h", F.xxhash64("id")).orderBy("h")
    least = ids.first().id
    table = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    table = table.unionByName(table.where(table.doc_id == least).crossJoin(spark.range(3000)).select("doc_id", "text"))
    drawn = common.draw(table, 1500).collect()
    assert len(drawn) == len({r.doc_id for r in drawn}) == 1500
    assert {r.doc_id for r in drawn} == {r.id for r in ids.limit(1500).collect()}


def test_toxicity_learns_from_as_many_texts_as_it_says(spark, monkeypatch):
    table = [(5, f"copy {i % 3}", "en", "s", 1) for i in range(300)] + [(i, f"text {i}", "en", "s", 1) for i in range(100, 160)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in [5, 5, *range(100, 160)]], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append(len(texts)))
    toxicity.fit(docs(spark, table), labels, max_rows=40)
    toxicity.fit(docs(spark, table), labels)
    assert seen == [40, 61]


def test_only_letters_make_a_language():
    assert not any(map(langid.has_letter, ["½ ² 12", "Ⅷ ①", "", " _ 9", "١٢", "…"]))
    assert all(map(langid.has_letter, ["½ a", "ª", "数", "é", "ǅ"]))


def small_network(seed=0, names=("aa", "bb", "cc")):
    rng = np.random.default_rng(seed)
    filters, wide = langid.FILTERS * len(langid.WIDTHS), max(langid.WIDTHS)
    emb = rng.normal(0, 0.5, (256, langid.DIM))
    emb[0] = 0
    return langid.Network(list(names), emb, rng.normal(0, 0.3, (wide * langid.DIM, filters)) * langid.live_weights(), rng.normal(0, 0.1, filters), rng.normal(0, 0.5, (filters, len(names))), rng.normal(0, 0.1, len(names)))


def brute_logits(net, window):
    """Each filter at each place of the window, its largest value and what the output makes of them, one number at a time."""
    z = net.bias.astype(float).copy()
    for f in range(net.kernel.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        places = range(len(window) - max(langid.WIDTHS) + 1)
        top = max(sum(net.emb[window[p + k], d] * net.kernel[k * langid.DIM + d, f] for k in range(width) for d in range(langid.DIM)) for p in places)
        z += max(0.0, top + net.shift[f]) * net.out[f]
    return z


def test_network_is_the_sum_of_its_filters():
    net = small_network()
    rng = random.Random(1)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)).decode("latin-1") for n in (7, 300)]
    for text in texts:
        w = langid.windows(text.encode())
        z = np.array([brute_logits(net, x) for x in w])
        assert np.allclose(net.logits(w), z)
        lang, score = net.predict([text])
        p = np.exp(z.mean(0) - z.mean(0).max())
        assert lang == [net.names[int(z.mean(0).argmax())]] and np.isclose(score[0], p.max() / p.sum())


def test_network_gradients_are_differences():
    net, rng = small_network(2), np.random.default_rng(3)
    b, t, weight = rng.integers(1, 256, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1]), np.array([1.0, 0.5, 2.0])

    def loss():
        z = net.logits(b)
        p = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -(weight[t] * p[np.arange(len(b)), t]).mean()

    for param, grad in zip((net.emb, net.kernel, net.shift, net.out, net.bias), langid.gradients(net, b, t, weight), strict=True):
        for at in [np.unravel_index(np.abs(grad).argmax(), grad.shape), *(tuple(rng.integers(0, n) for n in grad.shape) for _ in range(5))]:
            if param is net.emb and at[0] == 0 or param is net.kernel and not langid.live_weights()[at]:
                continue
            was = param[at]
            param[at] = was + 1e-6
            up = loss()
            param[at] = was - 1e-6
            down = loss()
            param[at] = was
            assert np.isclose((up - down) / 2e-6, grad[at], atol=1e-5)


def test_toxicity_score_is_the_weighted_mean_of_all_grams():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.random(toxicity.BUCKETS), rng.normal(0, 3, toxicity.BUCKETS), 0.3)
    for text in ["", "Some words, and\nmore wörds!", "x" * 40]:
        b = b" " + toxicity.fold(text) + b" "
        total = count = 0.0
        for n in toxicity.GRAMS:
            for i in range(len(b) - n + 1):
                if b" " in b[i + 1 : i + n - 1]:
                    continue
                h = n
                for c in b[i : i + n]:
                    h = (h ^ c) * 0x100000001B3 % 2**64
                g = (h ^ h >> 29) % toxicity.BUCKETS
                total, count = total + model.weight[g] * model.value[g], count + model.weight[g]
        assert np.isclose(model.logits([text])[0], total / (count + toxicity.PAD) + 0.3)


def test_toxicity_gradients_are_differences():
    rng = np.random.default_rng(5)
    emb, out, bias = rng.normal(0, 1, (7, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    doc, gram, share = np.repeat(np.arange(4), 5), rng.integers(0, 7, 20), rng.random(20)
    truth = np.eye(2)[[0, 1, 1, 0]]

    def loss():
        z = np.stack([sum(share[i] * emb[gram[i]] for i in range(20) if doc[i] == d) for d in range(4)]) @ out + bias
        return -(truth * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum() / 4

    for param, grad in zip((emb, out, bias), toxicity.gradients(emb, out, bias, doc, gram, share, truth), strict=True):
        for at in np.ndindex(param.shape):
            was = param[at]
            param[at] = was + 1e-6
            up = loss()
            param[at] = was - 1e-6
            down = loss()
            param[at] = was
            assert np.isclose((up - down) / 2e-6, grad[at], atol=1e-6)


def test_every_gram_has_a_weight_and_toxic_ones_a_large_one():
    n = np.array([900, 100])
    present = np.array([[0, 900, 9, 50, 5, 0], [0, 100, 1, 40, 60, 1]])
    w = toxicity.gram_weights(present, n)
    assert (w > 0).all() and w[4] > 0.9 and w[3] > 0.5 and max(w[0], w[1], w[2], w[5]) < 0.05


def misspelt(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + rng.choice("xyz013") + word[i + 1 :]])


def test_toxicity_finds_misspelt_words():
    rng = random.Random(8)
    train = [(talk(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    model = toxicity.train(*map(list, zip(*train, strict=True)))
    texts = [" ".join(misspelt(rng, w) if w.startswith(tuple(BAD)) else w for w in talk(rng, True).split()) for _ in range(100)]
    clean = [talk(rng, False) for _ in range(100)]
    assert (model.logits(texts) > np.log(0.7 / 0.3)).mean() >= 0.7
    assert (model.logits(clean) > np.log(0.7 / 0.3)).mean() <= 0.02


#: Shapes of secrets that no training line has.
UNSEEN = {
    "uuid": lambda r: "-".join(r.randbytes(n).hex() for n in (4, 2, 2, 2, 6)),
    "licence": lambda r: "-".join("".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(5)) for _ in range(5)),
    "base64": lambda r: base64.b64encode(r.randbytes(32)).decode(),
    "dotted": lambda r: "SG." + base64.urlsafe_b64encode(r.randbytes(15)).decode().strip("=") + "." + base64.urlsafe_b64encode(r.randbytes(30)).decode().strip("="),
    "upper hex": lambda r: r.randbytes(16).hex().upper(),
}


def test_the_field_finds_shapes_that_it_has_not_learnt():
    rng = random.Random(12)
    crf = secrets.train(*secrets.examples(["\n".join(prose(rng) for _ in range(3)) for _ in range(200)]))
    for name, make in UNSEEN.items():
        hits = 0
        for i in range(40):
            secret = make(rng)
            before = prose(rng) + (" " if i % 2 else " bearer ")
            hits += any(s <= len(before) and len(before) + len(secret.rstrip("=")) <= e for s, e in crf.spans([f"{before}{secret} {prose(rng)}"])[0])
        assert hits >= 32, (name, hits)
    odd = [f"{prose(rng)} {x} {prose(rng)}" for x in ("192.168.17.4", "jo.78@mail.example.com", "(499) 555-6503", "4929123412341234", "2024-11-03T10:22") for _ in range(20)]
    assert sum(map(bool, crf.spans(odd))) <= 5


def test_long_texts_are_tagged_in_slices(monkeypatch):
    rng = random.Random(13)
    crf = secrets.train(*secrets.examples(["\n".join(prose(rng) for _ in range(3)) for _ in range(100)]))
    secret = rng.randbytes(20).hex().upper()
    text = "\n".join([prose(rng) + " ünï" for _ in range(40)] + [f"{prose(rng)} {secret} {prose(rng)}"] + [prose(rng, 300)])
    whole = crf.spans([text, "", prose(rng)])
    assert any(text[s:e] == secret for s, e in whole[0])
    monkeypatch.setattr(secrets, "SLICE", 600)
    assert crf.spans([text])[0] == whole[0]


def test_file_features_are_those_of_the_whole_text():
    """Lines that are learnt from carry the shares and the length of the text that they come from."""
    texts = ["\n".join(["alpha beta 123 ; gamma"] * 50), "short one"]
    features, line, _ = secrets.examples(texts, planted=0)
    at = list(secrets._SIZES).index("file_length")
    want = {int(np.log2(len(t))) + secrets._AT["file_length"] for t in texts}
    assert set(features[:, at].tolist()) == want
