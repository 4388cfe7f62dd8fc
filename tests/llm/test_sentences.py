import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm.sentences import sentence_spans, sentences

CASES = [
    ["Dr. Lim of Port Ltd. left at 5 p.m.", "The U.S. office opened on Jan. 15.", "See No. 8 of the bulletin (vol. 3, pp. 4-9)."],
    ["Is 3.5% enough?", "Yes!", "It is."],
    ['"Is it safe? Yes," Ana Lim told reporters.', "“Stop!” shouted Lim as it moved.", "“We shall see…”"],
    ["(It had been closed before, in 2017.)", "Then … after a pause … they met."],
    ["Die Quote stieg auf 6,2 %, bzw. um ein Drittel.", "Am 1. Mai öffnet das Archiv, am 3. Juni die Bücherei.", "Das kostet 44,5 Mio. Euro.", "„Wir prüfen das. Mehr nicht“, erklärte Lim."],
    ["Le rapport (p. ex. la p. 31) cite 5 cas.", "Quelle surprise !", "« C’est tout. Merci », a dit Lim."],
    ["—No lo sabíamos. Nos avisaron tarde —explicó Lim.", "El Sr. Lim firmó por Port S. A. ayer.", "¿Cuánto costó?"],
    ["А. Б. Карский подписал соглашение.", "По словам проф. Лим, склад на ул. Морской закрыт.", "«Всё. Ошибок нет», — заявил Лим."],
    ["डॉ. नेमोद के अनुसार गोदाम बंद रहा।", "क्या पुल बना है?"],
]


@pytest.mark.parametrize("want", CASES)
def test_spaced_scripts(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want
    two = "\n\n".join(want)
    assert [two[a:b] for a, b in sentences(two)] == want


@pytest.mark.parametrize("want", [["「故障だ。原因は不明。」と述べた。", "報告書（第3版、Ver.2.66）は長い。", "本当か？"], ["“没有问题。”负责人说。", "出口从63.5%升至70%。"]])
def test_scripts_without_spaces(want):
    text = "".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


def test_thai_ends_at_spaces_but_not_beside_figures():
    text = "คลังสินค้าถูกปิดเป็นเวลา 28 วันเพื่อซ่อมแซม ประชาชนใช้เรือทุกวัน"
    assert [text[a:b] for a, b in sentences(text)] == ["คลังสินค้าถูกปิดเป็นเวลา 28 วันเพื่อซ่อมแซม", "ประชาชนใช้เรือทุกวัน"]


def test_edges():
    assert sentences("") == [] and sentences(" \n\t ") == []
    assert sentences("  Read more ") == [(2, 11)]
    assert sentences("One. Tw") == [(0, 4), (5, 7)]
    assert len(sentences("It is so. " * 20_000)) == 20_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1.!? \n\"“”«»()—。！、ж।ก​", max_size=80))
def test_spans_cover_all_that_shows(text):
    spans = sentences(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(i in inside or c.isspace() for i, c in enumerate(text))


def test_rows(spark):
    df = spark.createDataFrame([("p", 1, "One sits. Two run."), ("p", 1, "One sits. Two run."), ("p", 2, None), ("q", 1, " ")], "src string, row_id bigint, text string")
    assert sorted(tuple(r) for r in sentence_spans(df).collect()) == [("p", 1, 0, 9), ("p", 1, 10, 18)]
    assert sentence_spans(df.limit(0)).count() == 0


LONG = " ".join(f"The harbour of town {i} was closed for the winter. Was it sold?" for i in range(14))


@pytest.mark.parametrize(
    "parts",
    [
        (f"“{LONG}” said Ana.", "It was late."),
        (f"\"{LONG}\" said Ana.", "It was late."),
        (f"He left ({LONG} So they said) at noon.", "It was late."),
        (f"(A first remark. (An inner one. It ended.) {LONG})", "It was late."),
        (f"—{LONG} —dijo Ana.", "Era tarde."),
        ("“Stop!” Ana Maria Lim of the long-named regional northern port authority said.", "It was late."),
        ("“Stop!” Dr. Ana Lim said.", "It was late."),
        ("“Stop!”", "The chair of the northern regional port authority left because the mayor said no."),
    ],
)
def test_long_quotations_brackets_and_clauses(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == list(parts)


def test_unclosed_marks_in_linear_time():
    for c in "(“\"„«":
        assert sentences(f"One. {c}Two. Three. " * 20_000)
    assert sentences("(" * 100_000 + "”" * 100_000)
