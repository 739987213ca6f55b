from roadcut.llm import site_templates as S

ARTICLE = "<article><h1>T &amp; U</h1><p>one  <b>two</b>\n three<p>four<br>five</p><div class='comments'>c</div></article>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article():
    p = page(f"<nav><ul><li>a</li></ul></nav><div class=ad>ad</div>{ARTICLE}<aside>z</aside><footer>&copy;</footer>")
    assert S.main_text(S.parse(p)) == "T & U\none two three\nfour\nfive"


def test_odd_input():
    assert S.main_text(S.parse("")) == ""
    assert S.main_text(S.parse("plain < text & more <b")) == "plain < text & more"
    assert S.main_text(S.parse("<p>a<p>b</i></div><table><tr><td>c<td>d")) == "a\nb\nc\nd"
    assert S.main_text(S.parse("<div>" * 3000 + "deep")) == "deep"
    assert S.main_text(S.parse("<!-- " + "x" * 1000)) == ""
    assert S.main_text(S.parse("<p>a<script>b")) == "a"


def test_templates_are_counted_per_host(spark):
    rows = [(i, f"http://h.com/{i}", page(f"<div><p>Follow us</p></div><div><p>own text {i}</p></div>")) for i in range(8)]
    rows += [(20 + i, f"https://other.org/{i}", page("<div><p>Follow us</p></div>" if i == 0 else f"<div><p>else {i}</p></div>")) for i in range(8)]
    rows += [(40, None, None), (41, "h.com/q", ""), (0, "http://h.com/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in S.extract(df).collect()}
    assert S.extract(df).count() == len(rows)
    assert got[3].text == "own text 3" and got[3].n_chars == 10
    assert got[20].text == "Follow us" and got[25].text == "else 5"
    assert got[40].text == "" and got[41].text == "" and got[40].url is None
    assert S.extract(df.limit(0)).count() == 0


def test_repeated_paragraph_of_an_article_stays(spark):
    rows = [(i, f"http://h.com/{i}", page(f"<article><div>Share this</div><p>Licence</p><p>text {i}</p></article>")) for i in range(9)]
    got = S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Licence\ntext {i}" for i in range(9)}
