from weftline.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav><div class="ad">Buy this now because it is a very long advert text, longer than most.</div>
<article><h1>Title &amp; more</h1><p><b>First
 line<br>goes on<p>Second &eacute;&#33; <!-- no --></p><div class="ad">Buy</div><aside>side</aside><p>Third.</p><section class="comments"><p>Reader says</p></section></article>
<form><input value="x">Search</form><footer>&copy; me &middot; Some text here.</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst line goes on\n\nSecond é!\n\nThird."


def test_without_marks_the_distribution_decides():
    long = "This paragraph has a good deal of text, as those of articles do, and no links at all in it."
    page = f"<div><a>Home</a></div><div><a>News</a></div><div><a>More</a></div><p>{long}</p><p>{long}</p><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div>"
    assert html_text.main_text(page) == f"{long}\n\n{long}"


def test_body_outside_cards():
    long = "This paragraph has a good deal of text, as those of articles do, and no links at all in it."
    card = "<article><h3>Another story</h3><p>Read what else went on.</p></article>"
    assert html_text.main_text(f"<body><div>{f'<p>{long}</p>' * 4}</div>{card * 3}</body>") == "\n\n".join([long] * 4)


def test_surge_decides_between_articles():
    long = "This paragraph has a good deal of text, as those of articles do, and no links at all in it."
    page = f"<body><article><p>{long}</p><p>{long}</p></article><article><p>More</p></article></body>"
    assert html_text.main_text(page) == f"{long}\n\n{long}"


def test_short_paragraph_after_furniture():
    long = "This paragraph has a good deal of text, as those of articles do, and no links at all in it."
    furniture = '<div class="ad">Buy this</div>' * 4
    assert html_text.main_text(f"<div><p>{long}</p><p>{long}</p>{furniture}<p>It ended well.</p></div>") == f"{long}\n\n{long}\n\nIt ended well."


def test_broken_pages():
    assert html_text.main_text("<article><p>whole</p><p>cut o") == "whole\n\ncut o"
    assert html_text.main_text("<article><p>whole</p><p clas") == "whole"
    assert html_text.main_text("<script>never closed <p>x</p>") == ""
    assert html_text.main_text("plain words only") == "plain words only"


def test_elements_whose_end_may_be_left_out():
    """What an option or a button begins ends with what holds it, not at the next end tag of its name."""
    body = "<p>" + "real words of the article " * 8 + "</p>"
    page = f"<div><datalist><option>one<option>two</datalist></div><article>{body}</article><button>go</button>"
    assert html_text.main_text(page) == ("real words of the article " * 8).strip()
    many = "<title>" * 20_000 + "x"
    assert html_text.main_text(many) == "x"


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>" + "word " * 300_000, "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert {r.page_id: r.text for r in out}[2] == "" and max(r.n_chars for r in out) == 5 * 300_000 - 1
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
