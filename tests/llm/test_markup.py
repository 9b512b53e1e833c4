import pytest
from conftest import rows

from millrace.llm import markup as mk


def kinds(text):
    return [(k, t) for k, t, _ in mk.blocks(text)]


CASES = {
    "html": ("<H2>R&auml;kna &amp; m&auml;t</H2><p>A <b>b</b>&nbsp;<a href='u'>l&ouml;nk</a>.<br>ny<ul><LI>ett<li>två</ul><p>&nbsp;</p><div></div><!-- <p>nej</p> --><style>.x{}</style><script>var a = 1 < 2;</script><img alt='n'>",
             [("heading", "Räkna & mät"), ("para", "A b lönk. ny"), ("item", "ett"), ("item", "två")]),
    "html code and formulas": ("<pre><code>if (a &lt; 2 &amp;&amp; b) { x_y*z; }</code></pre><p><span class='math'>\\(x \\le 2\\)</span></p><p>\\[a\\]</p><script type='math/tex'>1 < x</script>",
                               [("code", "if (a < 2 && b) { x_y*z; }"), ("formula", "x \\le 2"), ("formula", "a"), ("formula", "1 < x")]),
    "escaped html": ("&lt;h3&gt;S&amp;aring;&lt;/h3&gt;&lt;p&gt;a &amp;lt; b&lt;/p&gt;", [("heading", "Så"), ("para", "a < b")]),
    "markdown": ("Om plagget\n----------\n\nEn **fet** *text* med [länk](http://x/a_b) och 5\\*40, 5*40 art\\_nr_1 __två__ ![b](u)\n\n## Mer #\n\n* ett\n+ två `a*b`\n1. tre\n\n```js\nx = a*b_c;\n```\n\n$$\nV = a_b\n$$\n\n***",
                 [("heading", "Om plagget"), ("para", "En fet text med länk och 5*40, 5*40 art_nr_1 två"), ("heading", "Mer"), ("item", "ett"), ("item", "två a*b"), ("item", "tre"), ("code", "x = a*b_c;"), ("formula", "V = a_b")]),
    "wiki": ("[[Fil:b.jpg|thumb]]\n\n== Om & på ==\n\n'''Fet''' [[Sida 2|text]] i [https://x/w ord].\n\n# ett\n# ''två''\n\n<syntaxhighlight lang=\"text\">\na < b;\n</syntaxhighlight>\n\n<math>x < 2</math>",
             [("heading", "Om & på"), ("para", "Fet text i ord."), ("item", "ett"), ("item", "två"), ("code", "a < b;"), ("formula", "x < 2")]),
    "latex": ("\\section*{Mått \\& sånt}\n\nEn \\textbf{\\emph{fet}} \\href{http://x}{länk} 12\\$.\n\n\\begin{itemize}\n\\item ett\n\\item två\n\\end{itemize}\n\nSlut.\n\n\\begin{equation}\nT_{ok} = 2\n\\end{equation}\n\\begin{verbatim}\na \\& b\n\\end{verbatim}",
              [("heading", "Mått & sånt"), ("para", "En fet länk 12$."), ("item", "ett"), ("item", "två"), ("para", "Slut."), ("formula", "T_{ok} = 2"), ("code", "a \\& b")]),
    "plain": ("Ett stycke\nmed rad < 150 cm & plats.\r\n\r\nTvå 5*40 och 3*40 a_b_c.", [("para", "Ett stycke med rad < 150 cm & plats."), ("para", "Två 5*40 och 3*40 a_b_c.")]),
    "mixed": ("<p>Ett.</p>\n\nOm\n--\n\n- *två* & tre\n\n~~~\na > b\n~~~", [("para", "Ett."), ("heading", "Om"), ("item", "två & tre"), ("code", "a > b")]),
    "empty": ("<p> </p><ul></ul>&nbsp;", []),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks(name):
    assert kinds(CASES[name][0]) == CASES[name][1]


@pytest.mark.parametrize("text", [None, "", " ", "\n\n"])
def test_nothing(text):
    assert kinds(text) == []


@pytest.mark.parametrize("text", ["<" * 3000, "*" * 3000, "[" * 3000, "<p" * 3000, "\\begin{itemize}" * 500, "=" * 5000, "&" * 5000, "<!--" * 2000, "$$" * 999, "'''" * 999, "```" * 999, "x" * 300_000])
def test_odd_and_long_bodies_end(text):
    mk.blocks(text)


def test_labels_in_two_passes():
    good = "Det här är en text om hur du och jag tar på oss en jacka som vi har valt för den som är ute på vägen och inte vill bli blöt av det regn som faller."
    menu = "Hem Butik Kontakt Varukorg Logga Konto Nyheter Rea Dam Herr Barn Skor Jackor Byxor Kjolar Mössor"
    found = [("heading", "Rubrik", 0), ("para", good, 0), ("item", "kort", 0), ("para", good, 0), ("para", menu, len(menu)), ("item", "Mer", 3), ("para", menu, len(menu))]
    assert mk.labels(found) == ["content", "content", "content", "content", "boilerplate", "boilerplate", "boilerplate"]
    assert mk.labels([("item", "kort", 0)]) == ["content"] and mk.labels([]) == []


def test_rows(spark):
    df = spark.createDataFrame([("p", "<p>a</p><p>a</p>", "c"), ("p", "<p>a</p><p>a</p>", "c"), ("q", None, "c"), (None, "b", "c"), ("r", "", "c")], "product_id string, body_html string, label string")
    got = mk.clean_blocks(df, "product_id", "body_html")
    assert rows(got.select("product_id", "ordinal", "block_text")) == [(None, 0, "b"), ("p", 0, "a"), ("p", 0, "a"), ("p", 1, "a"), ("p", 1, "a")]
    assert mk.clean_blocks(df.limit(0), "product_id", "body_html").count() == 0


NAVIGATION = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>Sale</a></li></ul><p><a href='/c'>All of our shops, their opening hours and how to find each of them on the map of the town</a></p>"
PROSE = "<p>This is a jacket for wet mornings, and it is as warm as it is light, so you can wear it all day.</p><h2>Care</h2><p>Wash it cold.</p>"


def test_labels_decide_what_content_is(spark, monkeypatch):
    """Link density decides a block, stop words another, and short ones take their neighbours' label."""
    assert mk.labels(mk.blocks(NAVIGATION)) == ["boilerplate"] * 3
    assert mk.labels(mk.blocks(PROSE)) == ["content"] * 3
    df = spark.createDataFrame([(1, NAVIGATION), (2, PROSE), (3, NAVIGATION + PROSE), (4, None)], "product_id long, body string")
    kept = lambda: [(r["product_id"], r["block_text"][:9]) for r in mk.clean_blocks(df, "product_id", "body", content_only=True).orderBy("product_id", "ordinal").collect()]
    assert kept() == [(p, t) for p in (2, 3) for t in ("This is a", "Care", "Wash it c")]
    assert mk.clean_blocks(df, "product_id", "body").count() == 12
