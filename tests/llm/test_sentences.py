import itertools
import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lodestone.llm.sentences import segment, sentences

SENTENCES = {
    "en": ["Dr. Quillon's team measured 9.9 ms under load.", "Use e.g. limits.log or queue.conf here.", "The U.S. mirror holds 3 copies, the E.U. mirror holds 4.1 TB.", "The window closes at 9 p.m.",
           "See Fig. 2 and Sec. 8.4 for the layout.", 'The console prints "Ready. Waiting for the relay." and then closes.', "(The cache ignores server.toml in this case.)", '"Is the relay awake?" is the first thing it asks.',
           "The loader waits ... then it will verify the answer.", "Call Client.Open before the probe sees it.", "npm users reload it through limits.toml instead.", "Why does it happen twice?"],
    "de": ["Das gilt u. a. für die Suchseite, d. h. für jede Datei.", "Am 9. März wird die Verwaltung umgestellt.", "Nr. 8 der Liste betrifft nur die Sicherung.", "Die Konsole meldet „Fertig. Bitte warten.“ und schließt danach.", "Niemals die Übersicht ersetzen!"],
    "fr": ["Voir la fig. 7 et l'art. 3 du guide.", "M. Delvaux a mesuré 379 ms pour une entrée.", "La console affiche « Prêt. Veuillez patienter. » puis ferme la connexion.", "Ne jamais archiver pendant un import !"],
    "es": ["El Sr. Olmedal midió 3 ms con una conexión.", "Véase la pág. 6 y el art. 9 de la guía.", "¡Nunca hay que mover la versión!", "¿Por qué tiene que reiniciar dos veces?"],
    "pt": ["O Sr. Valdoso mediu 284 ms com uma resposta.", "Pode verificar, p. ex. com relay.json, sem parar o serviço.", "Nunca se deve apagar durante uma carga!"],
    "nl": ["Dat geldt o.a. voor de zoekpagina, d.w.z. voor elke aanvraag.", "U kunt bijv. limits.conf bewaren.", 'Het scherm toont "Klaar. Even wachten." en sluit daarna.'],
    "ru": ["После этого он пишет результат в limits.yaml, queue.json и т. д. для отчёта.", "Размер не больше 11,6 МБ, см. рис. 4 и табл. 3.", "В 47 г. служба поиска была перенесена.", "На экране видно «Готово. Подождите немного.» и затем ссылка закрывается."],
    "ar": ["لماذا تظهر الوثيقة المشفرة مرتين في القائمة؟", "لا يجوز أن يتجاوز الحجم 11.6 ميغابايت."],
    "hi": ["आकार 9.9 एमबी से अधिक नहीं होना चाहिए।", "आयात के समय फ़ाइल कभी न जाँचें!"],
}
WIDE = {
    "zh": ["屏幕上显示“准备好了。请稍等。”然后关闭请求。", "（此时队列不会读取ranking.toml。）", "每个加密的请求不得超过36.1 MB。", "为什么要检查两次？"],
    "ja": ["画面に「準備ができました。お待ちください。」と表示され、写しが閉じます。", "v2.2版から別の処理として動きます。", "（この場合、読みません。）"],
}


def cut(text):
    return [text[s:e] for s, e in segment(text)]


@pytest.mark.parametrize("lang", [*SENTENCES, *WIDE])
def test_known_sentences_in_every_order(lang):
    parts = (SENTENCES | WIDE)[lang]
    gap = "" if lang in WIDE else " "
    for order in itertools.islice(itertools.permutations(parts, min(3, len(parts))), 400):
        assert cut(gap.join(order)) == list(order)


def test_lines_and_blank_lines():
    assert cut("One line\nwraps here. And\nanother. \n \n Third without mark\n\nFourth") == ["One line\nwraps here.", "And\nanother.", "Third without mark", "Fourth"]
    assert cut("A b c.\r\n\r\nD e f.") == ["A b c.", "D e f."]


def test_lost_blanks():
    assert cut("It holds 6.0 MB per agent.The stale upload waits.") == ["It holds 6.0 MB per agent.", "The stale upload waits."]
    assert cut("Why twice?The limit is 3.Open relay.yaml now.") == ["Why twice?", "The limit is 3.", "Open relay.yaml now."]
    assert cut("Look at Kimu.nape.foxoqi and server.json first.") == ["Look at Kimu.nape.foxoqi and server.json first."]


@pytest.mark.parametrize("text", [None, "", "  \n\t ", "\n\n"])
def test_nothing(text):
    assert segment(text) == []


def test_odd_texts():
    assert cut("no mark at all") == ["no mark at all"]
    assert cut("...") == ["..."]
    assert cut("x" * 100_000) == ["x" * 100_000]
    long = "This is one sentence. " * 3000
    assert len(cut(long)) == 3000
    assert cut('He said "no. Then he left.') == ['He said "no.', "Then he left."] or len(cut('He said "no. Then he left.')) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("aB .!?\n\"«»“”()「」。1,é中ا।"), max_size=60))
def test_spans_cover_the_text(text):
    spans = segment(text)
    at = 0
    for s, e in spans:
        assert at <= s < e and not text[at:s].strip() and not text[s].isspace() and not text[e - 1].isspace()
        assert "\n\n" not in text[s:e]
        at = e
    assert not text[at:].strip()


def test_table(spark):
    rows = [("a", "One here. Two here."), ("a", "One here. Two here."), ("b", "| x |\nText."), ("c", "Text.\n- item"), ("d", None), ("e", ""), ("f", "~~~\nx\n~~~"), ("g", "all | bob. Cat den.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, text string, start_pos int, spans int")
    got = sorted(map(tuple, sentences(df).collect()))
    assert got == [("a", 0, 9), ("a", 10, 19), ("g", 0, 10), ("g", 11, 19)]
    assert sentences(df.limit(0)).count() == 0
    assert {r["id"] for r in sentences(df, prose_only=False).select("id").collect()} == {"a", "b", "c", "f", "g"}


PARTS = ["Use it ", "(it works. Always so)", "(no! yes it is)", " on Linux vs. Windows", '"Go now! then stop."', " A. ", "B. Smith", "The end is near now.", ". ", "! ", " see it", "e.g. this", "x" * 300]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=2, max_size=10).map("".join))
@example("Use it (it works. Always so) on Linux vs. Windows as you like. The end is near now.")
def test_pruning_is_exact(text):
    assert segment(text) == segment(text, prune=False)


def test_pruning_is_exact_on_many_texts():
    rng = random.Random(3)
    more = PARTS + ["Dr. ", "No. 7 ", "etc. ", "v2.1", "。", "«Oui. Non.» ", " (Da. ", ") ", '" ', "so it ends. ", "Lange Rede. ", "... ", "?! ", "\n", "z" * 600]
    for _ in range(10_000):
        text = "".join(rng.choice(more) for _ in range(rng.randint(2, 9)))
        assert segment(text) == segment(text, prune=False), text


def test_paragraph_that_opens_with_a_weak_end():
    assert cut("Use it (it works. Always so) on Linux vs. Windows as you like. The end is near now.") == ["Use it (it works. Always so) on Linux vs. Windows as you like.", "The end is near now."]


@pytest.mark.parametrize("stray", ["[ « „ ", "[ « [ « „ ", "« [ " * 30])
def test_bracket_opened_below_stray_marks(stray):
    text = f"The list (it {stray} stops. Then it waits) is read again. The end is near now."
    assert cut(text) == [text[:-21], "The end is near now."]
    assert len(cut("([" * 50_000 + "»" * 50_000 + " a. B c.")) <= 2
