import pytest
from pyspark.sql import functions as F

from tallymark.llm.boilerplate import article, articles, dropped_lines, furniture_lines, line_hash
from tallymark.llm.residue import residue, residue_rows

BODY = ["The board of the northern harbour met on Monday and approved the new ferry line.", "Prices rose by a tenth during the year, according to the port authority."]
PAGE = ["We use cookies to give you the best experience.", "Home | News | Ports | Contact", "Home > Ports > Harbour votes", "Harbour votes", "By Ana Lim, March 3, 2020", BODY[0], "Advertisement", "A second look", "- One crane was sold.", BODY[1], "Most read", "Old pier closed", "New crane bought", "© 2020 Port Post. All rights reserved."]
WANT = [0, 1, 2, 6, 10, 11, 12, 13]


def test_article_lines_stay():
    assert furniture_lines("\n".join(PAGE)) == WANT
    assert article("\n".join(PAGE)).split("\n") == [x for i, x in enumerate(PAGE) if i not in WANT]


def test_menus_of_single_words_and_teasers_above():
    lines = ["Mehr zum Thema", "Alter Kai gesperrt", "Neuer Kran", "Startseite", "Nachrichten", "Meinung", "Hafen stimmt ab", "Von Ana Lim, 3. März 2020", *BODY]
    assert furniture_lines("\n".join(lines)) == [0, 1, 2, 3, 4, 5]


def test_message_of_an_error_page_stays():
    lines = ["Home | News | Ports | Contact", "Access denied", "You don't have permission to view this resource.", "Incident ID 8b2a0b42fc26", "Back to top"]
    assert furniture_lines("\n".join(lines)) == [0, 4]


def test_edges():
    assert furniture_lines("") == [] and furniture_lines("one line only") == [] and furniture_lines("Home\nNews\nPorts") == [0, 1, 2]
    assert furniture_lines("\n".join(BODY * 20_000)) == []


LONG_NOTICE = (
    "We and our partners use cookies and similar technologies to store information on your device, to measure how this site is used and to show you offers that match. "
    "You can change your cookie settings at any time. By continuing to browse this site you agree to our use of cookies and to our privacy policy, which explains all of this in more detail."
)


def test_notices_of_any_length_between_paragraphs():
    short = "We use cookies to make this site work better for you, and you can change what you accept in the settings here."
    assert len(short) > 105 and len(LONG_NOTICE) > 320
    assert furniture_lines("\n".join(["Harbour votes", BODY[0], short, BODY[1], LONG_NOTICE, BODY[0]])) == [2, 4]
    told = "The regulator said on Monday that the company had stored cookies without asking, and fined it. " + BODY[0] + " " + BODY[1]
    assert furniture_lines("\n".join(["Harbour votes", BODY[0], told, BODY[1]])) == []


def test_every_stretch_that_surges_is_kept():
    lines = ["Harbour votes", *BODY * 3, *["Advertisement"] * 15, *BODY * 2, "Back to top", *["Share"] * 9, "Ok."]
    assert furniture_lines("\n".join(lines)) == [*range(7, 22), *range(26, 37)]


def test_a_sites_own_lines(spark):
    body = lambda k: f"Paragraph number {k} of this article says {k * 7} things about the harbour and its ferries."
    texts = {k: "\n".join(["Acme Harbour Portal welcomes its readers to the second best portal of all.", body(k), body(k + 50), "This portal is printed on old paper."]) for k in range(20)}
    rows = [("s", k, f"http://a.test/{k}", t) for k, t in texts.items()] + [("s", 100 + k, "http://a.test/0", texts[0]) for k in range(300)]
    got = sorted((r.row_id, r.line_no) for r in dropped_lines(spark.createDataFrame(rows, "src string, row_id bigint, url string, text string")).collect())
    assert got == sorted((r[1], n) for r in rows for n in (0, 3))
    # The same page fetched again and again is one page of its site.
    once = spark.createDataFrame(rows[20:], "src string, row_id bigint, url string, text string")
    assert dropped_lines(once).count() == 0


def test_hash_is_sparks(spark):
    for x in ("", "Ünïcode 漢字", "x" * 1000):
        assert spark.range(1).select(F.xxhash64(F.lit(x))).first()[0] == line_hash(x)


def test_pages_as_rows(spark):
    rows = [("s", 1, "http://a.test/", "\n".join(PAGE), 0), ("s", 1, "http://a.test/", "\n".join(PAGE), 0), ("s", 2, None, None, 0), ("s", 3, None, "", 0), ("s", None, None, "x", 0)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, url string, text string, line_no int")
    assert sorted(r.line_no for r in dropped_lines(df).collect()) == WANT
    assert articles(df).count() == 2 and dropped_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"{BODY[0]} Published by {{{{author.name}}}} on {{{{publish_date}}}}.", "placeholder"),
        (f"{BODY[0]} Our {{adjective}} {{noun}} is here.", "placeholder"),
        (f"{BODY[0]} Contact __FULL_NAME__ at __PHONE__ for details.", "placeholder"),
        (f"{BODY[0]} The total for %%COMPANY%% was @@AMOUNT@@.", "placeholder"),
        (f"{BODY[0]} Price per unit: NaN, stock: [object Object].", "value"),
        (f"{BODY[0]} Reading time: null minutes, by null.", "value"),
        (f"{BODY[0]} Lorem ipsum dolor sit amet consectetur.", "filler"),
        ("Blindtext steht hier, bis der Text geliefert wird.", "filler"),
        ("404 Not Found\nThe page you are looking for may have been moved.", "notice"),
        ("Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "notice"),
        ("Страница не найдена", "notice"),
        (f"{BODY[0]} The style guide shows {{{{name}}}} as an example of a variable.", None),
        (f"{BODY[0]} Developers write ${{variable}} in the template.", None),
        (f"{BODY[0]} A study found that links ending in 404 Not Found had doubled.", None),
        (f"{BODY[0]} Designers still set lorem ipsum to test a typeface.", None),
        ("This site works best with JavaScript enabled.\nHarbour votes\n" + "\n".join(BODY), None),
        ("```\n{{name}} and {{value}} are filled in here\n```\n" + BODY[0], None),
        ("Short note.", None),
        ("", None),
    ],
)
def test_residue(text, kind):
    assert residue(text, "\n" in text) == kind


def test_residue_rows(spark):
    df = spark.createDataFrame([(1, "TODO: replace this paragraph.", "text", "a"), (1, "TODO: replace this paragraph.", "text", "a"), (2, None, "html", "b"), (3, "", None, "c"), (4, "x " * 300_000, "text", "d")], "k bigint, text string, kind string, residue string")
    assert [tuple(r) for r in residue_rows(df, "k", "text", "kind").collect()] == [(1, "filler")]
    assert residue_rows(df.limit(0), "k", "text", "kind").count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Our new product lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore", "filler"),
        ("Harbour votes by Ana lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna", "filler"),
        ("Dear {{first_name}}, the reports of this month are ready.", "placeholder"),
        ("The manual of {{product_name}} ships next week.", "placeholder"),
        ("This page shows {{count}} visitors.", "placeholder"),
        ("The manual costs $NaN today.", "value"),
        ("Developers write “{{name}}” here and at {{company}} as well.", "placeholder"),
        ("The manual leaves “{{name}}” for the reader's name.", None),
        ("Developers write {{name}} and {{company}}", None),
    ],
)
def test_residue_beside_other_words(text, kind):
    assert residue(text, False) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Dear {{ customer.name }}, the museum means a lot to us.", "placeholder"),
        ("The museum reopened and the ticket reads {{price}} at the door.", "placeholder"),
        ("Sehr geehrte «first_name», der Bericht liegt bei.", "placeholder"),
        ("Il a dit «oui» puis «non» au maire.", None),
        ("Talks with [NATO] and the port went on for an hour.", None),
        ("The treaty binds [NATO] and [UNESCO] alike.", None),
        ("The treaty with [COMPANY] binds us.", "placeholder"),
        (r"The ratio is \frac{a}{b} for each ferry, as shown.", None),
        ("According to {1} the harbour was built first.", None),
        ("Chapter {0} of {1} follows.", "placeholder"),
        ("Our office in *|CITY|* opens at $opening_time$.", "placeholder"),
        ("Write to {company} for a copy of the report.", "placeholder"),
        ("The price rose from $5 to $7 and then to $9 in May.", None),
        ("Each e-mail of the bank opened with the placeholder {{first_name}}, and nobody had noticed.", None),
        ("The letter began with “Dear {{name}}”, she said.", "placeholder"),  # only the whole quotation is quoted
        ("The letter began with “{{name}}”, she said.", None),
        ("Her book calls the token %%EMAIL%% a relic of the nineties.", None),
        ("Programmers used to type ${user} there by hand.", None),
        ("Entwickler schreiben {{vorname}} und {{nachname}} in die Vorlage.", None),
        ("Printers have set lorem ipsum in their trays for five hundred years, says the curator.", None),
        ("The site's owner left “sample text here” on it for a year, the court heard.", None),
        ("An error occurred in the count of the votes, and the clerk told the council on Monday that it would be repeated by the end of the month, as the law asks. " + BODY[0] + " " + BODY[1] + " " + BODY[0], None),
        ("The page you requested could not be found on this server. " + "It may have been moved, or its address may have been mistyped; please check the address and try the search at the top of the page. " * 1, "notice"),
    ],
)
def test_residue_by_structure(text, kind):
    assert residue(text, False) == kind
