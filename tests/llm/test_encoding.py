import pytest

from tallymark.llm.encoding import _lenient, garbled, garbled_keys, restore, restored

FRENCH = "L’entrepôt, situé près d’ici, a été fermé après une inspection très sévère à Noël."
GERMAN = "Größere Schäden gab es nicht, doch die Räume müssen für 82 Tage schließen. „Ja“, sagte er."
RUSSIAN = "Комиссия отклонила проект, однако город продолжил работы и опубликовал договор."
RIGHT = [
    FRENCH, GERMAN, RUSSIAN, "", "plain", "AVISO DA GESTÃO: A AÇÃO FISCAL FOI SUSPENSA.", "СССР» и «США", "Ça coûte 3 € — voilà…", "Þórður á Íslandi, Ørsted, łódź, İstanbul, ñandú, 20 m², 5 °C",
    "日本の港。報告書（第3版）には5件の訂正がある。", "यह साइट कुकीज़ का उपयोग करती है।", "การแก้ไขตัวเลข", "JаvаSсrірt еnаblеd", "The Øresk–Ålmå line", "cut in the midd�", "ligne coupée ét�\nfooter",
]


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_is_no_case(text):
    assert garbled(text) == [] and restore(text) == text


@pytest.mark.parametrize("reading", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", [FRENCH, GERMAN])
def test_utf8_read_as_one_byte_comes_back(text, reading):
    seen = "".join(bytes([b]).decode(reading, "ignore") or chr(b) for b in text.encode())
    assert garbled(seen) and restore(seen) == text
    assert restore(f"Before. {seen} {text}") == f"Before. {text} {text}"


def test_garbled_twice():
    seen = GERMAN
    for _ in range(2):
        seen = seen.encode().decode("latin-1")
    assert restore(seen) == GERMAN


@pytest.mark.parametrize(("written", "reading", "text"), [("cp1252", "cp1251", "Die Brücke für März war geprüft"), ("koi8-r", "cp1251", RUSSIAN), ("cp1251", "koi8-r", RUSSIAN), ("cp1252", "mac_roman", "le réseau a été réparé")])
def test_one_byte_pairs_are_found_and_mostly_restored(written, reading, text):
    seen = text.encode(written).decode(reading)
    assert garbled(seen)
    made = restore(seen).split()
    assert sum(a == b for a, b in zip(made, text.split(), strict=True)) >= 0.7 * len(made)


def test_lost_characters_are_a_case_inside_a_line():
    assert garbled("Im 26. Abschnitt der Pr�fung fehlen Werte.") and garbled("a � b � c")


def test_rows(spark):
    rows = [(1, GERMAN.encode().decode("latin-1"), "x"), (1, GERMAN.encode().decode("latin-1"), "x"), (2, GERMAN, None), (3, None, "y"), (4, "", "z"), (5, ("é" * 100_000).encode().decode("latin-1"), "w")]
    df = spark.createDataFrame(rows, "k bigint, text string, restored string")
    assert sorted(r.k for r in garbled_keys(df, "k", "text").collect()) == [1, 5]
    assert {(r.k, r.complete) for r in restored(df, "k", "text").collect()} == {(1, True), (5, True)}
    assert garbled_keys(df.limit(0), "k", "text").count() == 0


@pytest.mark.parametrize("reading", ["cp1252", "latin-1", "cp437", "mac_roman"])
@pytest.mark.parametrize("c", ["😀", "𠀀", "বাংলা ভাষা", "தமிழ்", "తెలుగు", "ქართული", "አማርኛ", "ខ្មែរ"])
def test_all_blocks_in_utf8(c, reading):
    seen = "".join(_lenient(bytes((b,)), reading) for b in c.encode("utf-8"))
    assert garbled(f"The sign {seen} stood there.")
    if reading != "cp437" or c not in ("ქართული", "አማርኛ"):  # restored in part: some sequences are those of one-byte Cyrillic too
        assert restore(f"The sign {seen} stood there.") == f"The sign {c} stood there."


@pytest.mark.parametrize(
    ("text", "written", "reading"),
    [
        ("قال رئيس الميناء إن العمل سوف يبدأ", "cp1256", "cp1252"),
        ("قال رئيس الميناء إن العمل سوف يبدأ", "iso8859-6", "latin-1"),
        ("การประชุมของท่าเรือเริ่มวันนี้", "cp874", "cp1252"),
        ("Η συνεδρίαση του λιμανιού άρχισε σήμερα", "cp1253", "cp1252"),
        ("ישיבת הנמל התחילה היום בבוקר", "cp1255", "cp1252"),
        ("Заседание совета порта началось сегодня", "cp866", "latin-1"),
        ("Заседание совета порта началось сегодня", "cp1251", "cp437"),
    ],
)
def test_other_one_byte_scripts(text, written, reading):
    seen = "".join(_lenient(bytes((b,)), reading) for b in text.encode(written))
    assert garbled(seen)
    if (written, reading) != ("cp866", "latin-1"):  # found, but taken for UTF-8
        assert restore(seen) == text


def test_correct_text_of_other_scripts_stays():
    for t in ("“Ё-моё…” сказал он. Ёлка и Їжак, надії…", "Đorđe “…” reče", "ação, coração, às “três”", "Η άνοιξη είναι εδώ", "การประชุม", "😀 🇩🇪 fine", "Почему договор\xa0№\xa082 не опубликован?"):
        assert not garbled(t), t

RU = "Комиссия отклонила проект, но город продолжает работы. «Мы проверили всё», — заявил представитель порта."
EL = "Η επιτροπή απέρριψε το σχέδιο, αλλά ο δήμος συνεχίζει τις εργασίες στο λιμάνι."
ZH = "委员会否决了方案；城市仍在继续施工。我们检查过了。没有问题。"
JA = "委員会は案を否決した。故障は予想外だ。原因は分からない。港の倉庫は閉鎖されました。"
DE = "Für die Straße zahlte die Gemeinde viel. Die Räume müssen geschlossen bleiben, erklärte die Behörde."


@pytest.mark.parametrize(
    ("text", "written", "reading"),
    [(RU, "utf-8", "cp1252"), (RU, "cp1251", "cp1252"), (RU[:64].replace("«", ""), "koi8-r", "cp1251"), (EL, "cp1253", "cp1252"), (EL, "utf-8", "cp437"), (ZH, "gbk", "cp1252"), (ZH, "utf-8", "latin-1"), (JA, "cp932", "cp1252"), (JA, "utf-8", "cp1252"), (DE, "utf-8", "cp1250"), (DE, "cp1252", "mac_roman"), (DE, "cp1252", "cp437")],
)
def test_whole_texts_come_back(text, written, reading):
    seen = _lenient(text.encode(written), reading)
    assert garbled(seen) and restore(seen) == text
    # Beside correct lines only the garbled ones change.
    beside = "Ein Café in Zürich öffnet früh.\n"
    assert restore(beside + seen).startswith(beside) and not garbled(beside)


@pytest.mark.parametrize("text", ["a F‰lle b", "the heat reached 41 ░C, the", "⌐ 2017 Post", "Home ∑ News ∑ Jobs", "Am 1. Mai ÷ffnet das Archiv", "Im Jahr 1999 ĂĽberprĂĽft", "その後 縺ｮ2015"])
def test_signs_inside_words(text):
    assert garbled(text)


@pytest.mark.parametrize("text", ["a sum ∑ b", "Foo™ and Bar® at 5 €", "±5 and 90°N", "ISO™bar", "l·l", "Ö och å", "¿Qué? ¡No!", "m² × 3", "Then … after", "A • B • C", "• One\n• Two", "100‰ of it", "Ångström ≈ ten", "naïve façade, œuvre"])
def test_signs_rightly_there(text):
    assert not garbled(text)
