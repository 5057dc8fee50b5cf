import os

import pytest
from pyspark.sql import functions as F

from lodestar.llm import language as L
from lodestar.llm import mixing as M
from lodestar.llm import tokenize as T

needs_vocabulary = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


def documents(spark):
    rows = [(i, f"document number {i} about subject {i * 7} " * (1 + i % 4), [" Big", "small ", "mid", None, "unlisted"][i % 5] if i % 50 else "small", "x") for i in range(600)]
    rows += [(1000 + i, "the same text under several ids", "small", "x") for i in range(5)] + [(2000, None, "big", "x"), (2001, "", "big", "x"), (2002, "the same text under several ids", "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")


def targets(spark):
    return spark.createDataFrame([("big", 0.2, 1), ("small", 0.5, 2), ("mid", 0.2, 4), ("absent", 0.1, 3)], "source string, weight double, max_repeats int")


@needs_vocabulary
def test_mix_meets_caps_and_targets(spark):
    docs, t = documents(spark), targets(spark)
    rows = M.mix(docs, t, seed=5).collect()
    uses = {}
    for r in rows:
        uses[r.text] = uses.get(r.text, 0) + 1
        assert r.copy <= {"big": 1, "small": 2, "mid": 4}[r.source]
    assert uses.get("the same text under several ids", 0) <= 1
    keys = [(r.order_key, r.doc_id, r.copy) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = [(r.order_key, r.doc_id, r.copy) for r in M.mix(docs.repartition(7), t, seed=5).collect()]
    assert again == keys
    s = {r.source: r for r in M.shares(docs, t, seed=5).collect()}
    assert s["absent"].mix_tokens == 0 and s["absent"].capped
    for r in s.values():
        assert r.mix_tokens == sum(x.n_tokens for x in rows if x.source == r.source)
        if r.capped:
            assert r.mix_tokens == r.available_tokens * r.max_repeats
        else:
            assert abs(r.mix_tokens - r.target_tokens) < 0.05 * r.target_tokens
    assert abs(sum(r.reached_share for r in s.values()) - 1) < 1e-9


@needs_vocabulary
def test_mix_of_nothing(spark):
    docs = documents(spark).limit(0)
    assert M.mix(docs, targets(spark)).count() == 0
    assert {r.mix_tokens for r in M.shares(docs, targets(spark)).collect()} == {0}
    assert M.mix(documents(spark), targets(spark).limit(0)).count() == 0


def test_thresholds_are_the_poisson_distribution():
    import math

    t = M._thresholds(1.5, 4)
    assert t == pytest.approx([sum(math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(j + 1)) for j in range(4)])
    assert M._thresholds(float("inf"), 3) == [0, 0, 0]


EN = ["the quick brown fox jumps over the lazy dog again", "this is what we want to know about the weather today", "she said that they would never come back to this house", "there are many things which people should have done before"]
DE = ["der schnelle braune Fuchs springt über den faulen Hund", "das ist es was wir heute über das Wetter wissen wollen", "sie sagte dass sie nie wieder in dieses Haus kommen würden", "es gibt viele Dinge welche die Leute vorher hätten tun sollen"]


def samples(spark):
    rows = [(i, lang, t) for i, (lang, t) in enumerate([*[("en", t) for t in EN], *[("DE", t) for t in DE], (None, "x y"), ("fr", None), ("en", "123")])]
    return spark.createDataFrame(rows, "sample_id long, lang string, text string")


def test_languages(spark):
    rows = [
        (1, EN[0] + ".", "en"), (2, DE[1] + ". " + DE[2] + "!", "en_GB"), (3, EN[1] + ". " + EN[2] + ".\n" + DE[0] + ".", "eng"), (4, None, None), (5, "", ""), (6, "123 !!! 42", "und"), (7, DE[3] + ".", "Deutsch"), (8, EN[3] + ".", "n/a"),
        (9, "the weather", None), (10, "日本語の文章です " * 4, None), (11, (EN[0] + ". ") * 3000, "de"),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, confidence string")
    c = L.classify(docs, samples(spark)).cache()
    main = {r.doc_id: r.lang for r in c.collect()}
    assert {i: main[i] for i in (1, 2, 3, 7, 8, 11)} == {1: "en", 2: "de", 3: "en", 7: "de", 8: "en", 11: "en"}
    assert main[4] == main[5] == main[6] == "und"
    found = sorted((r.doc_id, r.lang) for r in L.label_faults(c).collect())
    assert found == [(2, "de"), (3, "de"), (3, "en"), (8, "en"), (11, "en")]
    p = [(r.start, r.stop, r.lang) for r in L.passages(c).filter("doc_id = 3").orderBy("start").collect()]
    text = rows[2][1]
    assert [x[2] for x in p] == ["en", "de"] and text[p[1][0] : p[1][1]] == DE[0] + "."
    assert all(0 <= r.confidence <= 1 for r in c.collect())
    assert L.classify(docs.limit(0), samples(spark)).count() == 0
    assert {r.lang for r in L.classify(docs, samples(spark).limit(0)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no samples")
    s = spark.read.parquet(path)
    model = L.fit(s.filter("sample_id % 2 = 0"))
    rows = s.filter("sample_id % 2 = 1").collect()
    lang, _, _ = model.best([r.text for r in rows])
    assert sum(a == r.lang for a, r in zip(lang, rows)) >= 0.98 * len(rows)


def test_labels(spark):
    given = ["en", " EN", "en_GB", "eng", "English", "pt-BR", "Deutsch", "und", "", "-", None, "sv", "??", "dut", "FRE"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, l string").select("i", L.normal_label(F.col("l")).alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == ["en"] * 5 + ["pt", "de"] + [None] * 6 + ["nl", "fr"]


def test_close_languages_in_mixed_texts(spark):
    path = "/root/testdata/sf0.001/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no samples")
    s = spark.read.parquet(path)
    fitted, held = s.filter("sample_id % 2 = 0"), s.filter("sample_id % 2 = 1").collect()
    main = [r.text for r in held if r.lang == "en"]
    rows = [(i, f"{main[i % 20]}\n{main[(i + 1) % 20]}\n{main[(i + 2) % 20]}\n{main[(i + 3) % 20]}\n{t}", "en") for i, t in enumerate(t for r in held if r.lang in ("pt", "es") for t in (r.text, L._unaccented(r.text)))]
    langs = [x for r in held if r.lang in ("pt", "es") for x in (r.lang, r.lang)]
    found = {(r.doc_id, r.lang) for r in L.label_faults(L.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fitted)).collect()}
    missed = [i for i, x in enumerate(langs) if (i, x) not in found and L.prepared([rows[i][1].split("\n")[-1]]).words[0] >= L.LEAST_WORDS]
    assert len(langs) >= 100 and len(missed) <= 0.03 * len(langs)


POLISH = [
    "Wczoraj wieczorem poszliśmy razem do kina na nowy film o wojnie.",
    "Ta gra bardzo mi się podoba, ale jest trochę za trudna dla dzieci.",
    "Nie wiem jeszcze, czy będę miał czas przyjść do was w sobotę.",
    "Moja siostra kupiła sobie nowy samochód i jest z niego zadowolona.",
    "W lesie za domem rosną grzyby, które zbieramy każdej jesieni z dziadkiem.",
    "Proszę zamknąć drzwi, ponieważ na dworze jest dziś bardzo zimno.",
    "Książka, którą mi pożyczyłeś, okazała się ciekawsza, niż myślałem.",
    "Jutro rano muszę wcześnie wstać, żeby zdążyć na pociąg do Krakowa.",
    "Nasz pies nie lubi burzy i zawsze chowa się wtedy pod łóżkiem.",
    "Kiedy byłem mały, chciałem zostać strażakiem albo kierowcą autobusu.",
]


def test_a_language_without_spellings_is_fitted_and_others_are_less_sure(spark):
    extra = spark.createDataFrame([(10_000 + i, " PL", t) for i, t in enumerate(POLISH[:8])], "sample_id long, lang string, text string")
    with_polish = samples(spark).select("sample_id", "lang", "text").unionByName(extra)
    docs = spark.createDataFrame([(i, t, "pl") for i, t in enumerate(POLISH[8:])], "doc_id long, text string, lang string")
    assert [r.lang for r in L.classify(docs, with_polish).collect()] == ["pl", "pl"]
    assert L.label_faults(L.classify(docs, with_polish)).count() == 0
    path = "/root/testdata/sf0.001/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no samples")
    model = L.fit(spark.read.parquet(path))
    ukrainian = "Сьогодні ввечері ми підемо до бабусі, бо вона спекла смачний пиріг із яблуками."
    russian = "Сегодня вечером мы пойдём к бабушке, потому что она испекла вкусный пирог с яблоками."
    (a, b), confidence, _ = model.best([ukrainian, russian])
    assert b == "ru" and confidence[0] < 0.4 and confidence[1] > 1.3 * confidence[0], (a, b, confidence)


def test_prepared_texts():
    p = L.prepared(["Ab1c  d!", "", "\t12 .. ß", "É"])
    texts = ["".join(map(chr, p.codes[p.rows == i])) for i in range(4)]
    assert texts == [" ab c d ", " ", " ß ", " é "] and list(p.words) == [2, 0, 2, 1] and list(p.letters) == [4, 0, 1, 1]
    q = p.only(L.np.array([0, 3]))
    assert "".join(map(chr, q.codes)) == " ab c d  é " and list(q.rows) == [0] * 8 + [1] * 3
