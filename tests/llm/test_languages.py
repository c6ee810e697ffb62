import random

import numpy as np
import pytest

from loomarc.llm import languages as L
from loomarc.llm.crf import STRETCH, Chain, learn, word_features
from loomarc.llm.labels import language_code

SUBJECTS = {
    "en": ["the summary job", "a second account", "this layout", "our old reviewer"], "de": ["die Zusammenfassung", "ein zweites Konto", "dieses Layout", "unser alter Prüfer"],
    "fr": ["la tâche de synthèse", "un second compte", "cette mise en page", "notre vieux relecteur"], "es": ["la tarea de resumen", "una segunda cuenta", "este diseño", "nuestro viejo revisor"],
    "pt": ["a tarefa de resumo", "uma segunda conta", "este arranjo", "nosso velho revisor"], "ru": ["сводная задача", "второй аккаунт", "этот макет", "наш старый рецензент"],
    "zh": ["汇总任务", "第二个账号", "这个版面", "我们的审核人员"], "ja": ["集計ジョブは", "二つ目のアカウントは", "このレイアウトは", "私たちの確認担当者は"],
}
VERBS = {
    "en": ["keeps every blank line", "drops the wide frames"], "de": ["behält jede leere Zeile", "verwirft die breiten Bilder"], "fr": ["garde chaque ligne vide", "rejette les images larges"],
    "es": ["guarda cada línea vacía", "descarta las imágenes anchas"], "pt": ["guarda cada linha em branco", "descarta os quadros largos"], "ru": ["сохраняет каждую пустую строку", "отбрасывает широкие кадры"],
    "zh": ["保留所有空白行", "丢弃宽画面"], "ja": ["空白の行を残します", "広いフレームを捨てます"],
}


def sentence(rng, lang):
    glue, end = ("", "。") if lang in ("zh", "ja") else (" ", ". ")
    return rng.choice(SUBJECTS[lang]) + glue + rng.choice(VERBS[lang]) + end


def paragraph(rng, lang, n=4):
    return "".join(sentence(rng, lang) for _ in range(n)).strip()


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(1)
    langs = list(SUBJECTS)
    docs = [(paragraph(rng, lang), lang if rng.random() > 0.08 else rng.choice(langs)) for lang in langs for _ in range(60)]
    return L.fit_texts(iter(docs))


def test_held_out_accuracy(chain):
    rng = random.Random(2)
    own = L.Labeller(chain)
    for lang in SUBJECTS:
        found = own.fill([L.words_of(paragraph(rng, lang, 2)) for _ in range(20)])
        assert [f[0] for f in found] == [lang] * 20 and min(f[1] for f in found) > 0.8


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    chain = Chain(np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32), ("a", "b", "c"))
    emission = rng.normal(size=(9, 3)).astype(np.float32)
    starts, lengths = np.array([0, 4, 5]), np.array([4, 1, 4])
    got = chain.marginals(emission, starts, lengths, block=2)
    import itertools

    for s, n in zip(starts, lengths):
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            score = np.exp(sum(emission[s + i, k] for i, k in enumerate(path)) + sum(chain.transitions[a, b] for a, b in zip(path, path[1:])))
            total += score
            for i, k in enumerate(path):
                want[i, k] += score
        assert np.allclose(got[s : s + n], want / total, atol=1e-4)


def test_long_sequences_equal_one_recursion():
    rng = np.random.default_rng(1)
    chain = Chain(np.zeros((1, 4), np.float32), rng.normal(size=(4, 4)).astype(np.float32) * 2, tuple("abcd"))
    lengths = np.array([5, STRETCH, STRETCH + 1, 700, 1, 2 * STRETCH, 1500])
    starts = np.cumsum(lengths) - lengths
    emission = rng.normal(size=(lengths.sum(), 4)).astype(np.float32)
    got, move = chain.marginals(emission, starts, lengths), np.exp(chain.transitions.astype(float))
    for s, n in zip(starts, lengths):
        level = np.exp(emission[s : s + n].astype(float))
        alphas, betas = [level[0]], [np.ones(4)]
        for t in range(1, n):
            step = (alphas[-1] @ move) * level[t]
            alphas.append(step / step.sum())
        for t in range(n - 1, 0, -1):
            step = move @ (level[t] * betas[-1])
            betas.append(step / step.sum())
        want = np.array(alphas) * np.array(betas[::-1])
        assert np.allclose(got[s : s + n], want / want.sum(1, keepdims=True), atol=1e-4)


def test_every_feature_counts():
    a, b = "donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtsgesellschoft"
    assert len(word_features(a)) > 40 and word_features(a) != word_features(b)


def test_a_long_run_changes_its_language(spark, chain):
    rng = random.Random(8)
    zh = "".join(sentence(rng, "zh").rstrip("。") for _ in range(12))
    ja = "".join(sentence(rng, "ja").rstrip("。") for _ in range(8))
    df = spark.createDataFrame([(1, zh + ja, "zh")], "doc_id bigint, text string, lang string")
    found = [(r.lang, r.end) for r in L.label_segments(df, chain).orderBy("segment_no").collect()]
    assert [lang for lang, _ in found] == ["zh", "ja"] and abs(found[0][1] - len(zh)) <= 4


def test_learning_prefers_what_it_saw():
    chain = learn([(["the", "dog"], [1, 1]), (["der", "hund"], [0, 0])] * 10, ("de", "en"), steps=20)
    assert chain.emissions(["the"])[0].argmax() == 1 and chain.emissions(["hund"])[0].argmax() == 0 and chain.transitions[0, 0] > chain.transitions[0, 1]


def test_prose():
    text = "# Title\nU: Hello there (~/a/b.py) “quoted words here” ok.\n\n```\ncode = 1\n\nmore()\n```\n\n    x = f(1)\n    return x\n\n[3] Second one."
    assert [" ".join(L.words_of(p)) for _, _, p in L.paragraphs(text) if L.words_of(p)] == ["hello there ok", "second one"]


def test_documents(spark, chain):
    rng = random.Random(3)
    de, zh, fr = paragraph(rng, "de"), paragraph(rng, "zh"), paragraph(rng, "fr")
    rows = [
        (1, de, "de-DE"), (2, de, "en"), (3, de + "\n\n" + zh, "zh"), (4, zh, None), (5, None, "en"), (6, "", "en"), (7, " \n ", None), (8, "x = 1;\ny = 2;", "python"), (9, fr, "French"), (10, de, "java"),
        (11, "\n\n".join([de] * 400), "ger"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labelled = L.label_documents(df, chain)
    assert sorted(tuple(r) for r in L.wrong_labels(labelled).collect()) == [(2, "de"), (3, "de"), (3, "zh"), (4, "zh"), (10, "de")]
    by_id = {r.doc_id: r for r in labelled.collect()}
    assert by_id[5].languages == [] and by_id[5].confidence == 0.0 and by_id[10].languages == ["de"] and by_id[8].code == "python"
    segments = [r for r in L.label_segments(df, chain).collect() if r.doc_id == 3]
    text = rows[2][1]
    assert [(r.lang, text[r.start : r.end].strip()) for r in segments] == [("de", de), ("zh", zh)]
    mixed = spark.createDataFrame([(1, de + " " + fr, None)], "doc_id bigint, text string, lang string")
    assert [r.lang for r in L.label_segments(mixed, chain).collect()] == ["de", "fr"]
    assert L.label_documents(df.limit(0), chain).count() == 0


def test_code_keeps_its_label(spark, chain):
    rows = [(1, "x = 1;\ny = 2;", "Python"), (2, "int x;", "C#"), (3, "", "java"), (4, " \n", "java"), (5, None, "python"), (6, paragraph(random.Random(4), "de"), "en"), (7, "", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labelled = L.label_documents(df, chain)
    found = {r.doc_id: (r.lang, r.languages, round(r.confidence)) for r in L.languages_of_documents(labelled).collect()}
    assert found == {1: ("python", "python", 1), 2: ("csharp", "csharp", 1), 3: ("java", "java", 1), 4: ("java", "java", 1), 5: ("python", "python", 1), 6: ("de", "de", 1), 7: (None, "", 0)}
    segments = {r.doc_id: (r.segment_no, r.start, r.end, r.lang, r.confidence) for r in L.label_segments(df.where("doc_id <> 6"), chain).collect()}
    assert segments == {1: (0, 0, 13, "python", 1.0), 2: (0, 0, 6, "csharp", 1.0)}
    assert [tuple(r) for r in L.wrong_labels(labelled).collect()] == [(6, "de")]


def test_short_stretch_in_a_long_paragraph(spark, chain):
    rng = random.Random(5)
    en, de = paragraph(rng, "en", 80) + " ", paragraph(rng, "de", 6) + " "
    zh = sentence(rng, "zh")
    rows = [(1, en + de + en, "en"), (2, "# Title\n- 'a die' " + en + zh + " " + en, "en"), (3, en.strip(), "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {k: [] for k in (1, 2, 3)}
    for r in L.label_segments(df, chain).orderBy("doc_id", "segment_no").collect():
        found[r.doc_id].append((r.lang, rows[r.doc_id - 1][1][r.start : r.end]))
    assert len(de) < 0.1 * len(rows[0][1])
    assert found == {1: [("en", en), ("de", de), ("en", en)], 2: [("en", "# Title\n- 'a die' " + en), ("zh", zh + " "), ("en", en)], 3: [("en", en.strip())]}


def test_runs():
    words, w = ["the", "values", "zusammenfassung", "are", "exact", "汇总任务第二个"], np.array([3, 6, 15, 3, 5, 21], np.float32)
    p = np.eye(3, dtype=np.float32)[[0, 0, 1, 0, 0, 2]]
    assert L._runs(words, p, w) == [(0, 5, 0), (5, 6, 2)]
    assert L._runs(words[:2], np.eye(3, dtype=np.float32)[[0, 1]], w[:2]) == [(0, 2, 1)]


def test_labels():
    assert [language_code(x) for x in ("zh_CN ", "中文", "English", "pt-BR", "und", "", None, "C#")] == ["zh", "zh", "en", "pt", None, None, None, "csharp"]
