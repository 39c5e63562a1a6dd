import pytest

from lodestone.llm import language as G

PLAIN = {
    "en": ["The server writes the report to the disk every night.", "You can change this value when the service is stopped.", "Most of the teams never look at these settings.", "Why does the page show the same record twice?"],
    "de": ["Der Dienst schreibt den Bericht jede Nacht auf die Platte.", "Man kann diesen Wert ändern, wenn der Dienst nicht läuft.", "Die meisten Gruppen sehen sich diese Einstellungen nie an.", "Warum zeigt die Seite den gleichen Eintrag zweimal?"],
    "fr": ["Le service écrit le rapport sur le disque chaque nuit.", "On peut changer cette valeur quand le service est arrêté.", "La plupart des équipes ne regardent jamais ces réglages.", "Pourquoi la page montre-t-elle deux fois la même entrée ?"],
    "es": ["El servicio escribe el informe en el disco cada noche.", "Se puede cambiar este valor cuando el servicio está parado.", "La mayoría de los equipos nunca mira estos ajustes.", "¿Por qué la página muestra dos veces la misma entrada?"],
    "pt": ["O serviço escreve o relatório no disco todas as noites.", "Pode mudar este valor quando o serviço não está em uso.", "A maioria das equipas nunca olha para estas opções.", "Porque é que a página mostra duas vezes a mesma entrada?"],
    "nl": ["De dienst schrijft het verslag elke nacht naar de schijf.", "U kunt deze waarde wijzigen als de dienst niet draait.", "De meeste ploegen kijken nooit naar deze instellingen.", "Waarom toont de pagina dezelfde regel twee keer?"],
    "ru": ["Служба пишет отчёт на диск каждую ночь.", "Это значение можно изменить, когда служба не работает.", "Почему страница показывает одну запись дважды?"],
    "zh": ["服务每天晚上把报告写入磁盘。", "服务停止时可以更改这个值。", "为什么页面两次显示同一条记录？"],
    "ja": ["サービスは毎晩レポートをディスクに書き込みます。", "この値はサービスが停止しているときに変更できます。", "なぜページは同じ記録を二回表示するのですか？"],
    "ar": ["تكتب الخدمة التقرير على القرص كل ليلة.", "يمكن تغيير هذه القيمة عندما تتوقف الخدمة.", "لماذا تعرض الصفحة نفس السجل مرتين؟"],
    "hi": ["सेवा हर रात रिपोर्ट को डिस्क पर लिखती है।", "जब सेवा रुकी हो तब यह मान बदला जा सकता है।", "पृष्ठ एक ही प्रविष्टि को दो बार क्यों दिखाता है?"],
}


@pytest.fixture(scope="module")
def model():
    """Fitted on the first two sentences of each language, a third of the labels being wrong."""
    wrong = list(G.LANGUAGES)
    sample = []
    for k, (lang, s) in enumerate(PLAIN.items()):
        sample += [(" ".join(s[:2]), lang)] * 2 + [(" ".join(s[:2]), wrong[(k + 3) % len(wrong)])]
    return G.fit(sample)


def test_held_out_sentences(model):
    total = right = 0
    for lang, s in PLAIN.items():
        for x in s[2:]:
            total += 1
            right += G.LANGUAGES[model.scores([x])[0].argmax()] == lang
    assert right == total


def test_without_any_labelled_row():
    m = G.fit([])
    right = [G.LANGUAGES[m.scores([x])[0].argmax()] == lang for lang, s in PLAIN.items() for x in s]
    assert sum(right) >= 0.9 * len(right)


def segments(model, text, prior=None):
    return [(G.LANGUAGES[a], n, total) for a, _, _, n, total in G.judge(model, [text], [prior])[0]]


def test_segments(model):
    en, de, fr = PLAIN["en"], PLAIN["de"], PLAIN["fr"]
    assert segments(model, "# Titel auf Deutsch\n\n" + " ".join(en)) == [("en", 4, 4)]
    assert segments(model, " ".join(en) + "\n\n" + " ".join(de[:3]) + "\n\n" + en[0]) == [("en", 4, 8), ("de", 3, 8), ("en", 1, 8)]
    assert segments(model, "<html><body><p>" + " ".join(fr) + "</p><pre>the and of</pre></body></html>") == [("fr", 4, 4)]
    for conf in (s[1] for s in G.judge(model, [" ".join(en)], [None])[0]):
        assert 0.9 < conf <= 1.0


def test_evidence_decides_doubt(model):
    import numpy as np

    doubtful = "Limits 4.2 TB."
    lean = {x: list(np.log([0.9 if y == x else 0.01 for y in G.LANGUAGES])) for x in ("nl", "pt")}
    p = {x: G.judge(model, [doubtful], [v])[0][0] for x, v in lean.items()}
    assert p["nl"] != p["pt"]


def test_declarations_anywhere():
    named = lambda t: [G.LANGUAGES[d] if d >= 0 else None for _, d in G.declared_sentences(t)]
    assert named("<html lang='pt-BR'><body><p>One two.</p>") == ["pt"] and named("One two.") == [None]
    assert named("<!-- " + "licence text " * 900 + "--><html lang=de><body><p>One two.</p>") == ["de"]
    assert named("<!-- <html lang=de> --><html><body><p>One two.</p>") == [None]
    assert named("```\n<html lang='de'>\n```\n\nOne two.") == [None]
    tex = "\\documentclass{article}\n% " + "x" * 9000 + "\n\\usepackage[english,ngerman]{babel}\n\\begin{document}\nEins zwei.\n\\selectlanguage{french}\nUn deux.\nTrois.\n\n\\selectlanguage{klingon}Four."
    assert named(tex)[-4:] == ["de", "fr", "fr", "fr"]


def test_hosts_without_labels_take_the_prior_of_their_suffix(spark):
    rows = [("https://a.de/x", "de")] * 30 + [("https://b.de/x", None)] + [("https://c.com/x", "en")] * 30 + [("https://d.org/x", "?")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, origin string, lang string")
    prior = {r["host"]: dict(zip(G.LANGUAGES, r["prior"])) for r in G.host_priors(df).collect()}
    assert set(prior) == {"a.de", "b.de", "c.com", "d.org"}
    assert prior["b.de"]["de"] > prior["d.org"]["de"] > prior["c.com"]["de"] and prior["b.de"]["de"] > prior["b.de"]["en"]
    assert abs(prior["d.org"]["de"] - prior["d.org"]["en"]) < 1e-9


def test_nothing(model):
    for text in ("", " \n", "# Only a heading", "```\ncode\n```"):
        assert segments(model, text) == []
    assert len(segments(model, "12 34 56. 78!")) >= 1
    assert segments(model, PLAIN["en"][0] * 2000)[0][0] == "en"


def test_labels(spark):
    names = ["en", "EN-us", " German ", "fra", "zh_CN", "pt-BR", "Hindi", "", None, "?", "xx", "unknown", "english (uk)"]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    assert [r["l"] for r in df.select(G.label_language().alias("l")).collect()] == ["en", "en", "de", "fr", "zh", "pt", "hi", None, None, None, None, None, "en"]


def test_table(spark, monkeypatch):
    rows = []
    for k in range(6):
        for i, (lang, s) in enumerate(PLAIN.items()):
            rows.append((k * 100 + i, " ".join(s), lang if k else None, f"https://{lang}.example/{k}"))
    rows += [(900, " ".join(PLAIN["de"]), "English", None), (901, " ".join(PLAIN["en"] + PLAIN["nl"][:3]), "eng", ""), (902, PLAIN["ru"][0], "en", "/srv/a/b"), (903, None, "en", "o"), (904, " ", None, "o"), (905, PLAIN["en"][0] + " " + PLAIN["fr"][0], "en", "o")]
    df = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, lang string, origin string").selectExpr("*", "1 AS label", "2 AS host", "3 AS prior", "4 AS n")
    segs = G.language_segments(df)
    got = set(map(tuple, G.wrong_labels(segs).collect()))
    assert got == {(i, lang) for i, lang in enumerate(PLAIN)} | {(900, "de"), (901, "nl"), (902, "ru")}
    docs = {r["doc_id"]: r for r in G.document_languages(segs).collect()}
    assert docs[901]["lang"] == "en" and docs[901]["share"] == pytest.approx(4 / 7) and 903 not in docs
    monkeypatch.setattr(G, "BROADCAST_HOSTS", 0)
    assert set(map(tuple, G.wrong_labels(G.language_segments(df)).collect())) == got
    assert G.language_segments(df.limit(0)).count() == 0
