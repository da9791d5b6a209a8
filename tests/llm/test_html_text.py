from loxo.llm.html_text import blocks_of, content_paths, extract, main_text

STORY = "<p>Long text, with marks. And more text; really, a lot of text is here, so it counts.</p><p>Second one, also long. With words and more words, yes.</p><p>Short.</p>"
WANT = "Long text, with marks. And more text; really, a lot of text is here, so it counts.\nSecond one, also long. With words and more words, yes.\nShort."
AROUND = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><header>Site</header>{}<div class='comments'><p>user: I think this, is long. A lot of text, too; yes.</p></div><aside>See also, this. And that.</aside><form>Name <input></form><footer>&copy; us, 2020.</footer>"


def test_marked_article():
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>" + AROUND.format("<!-- x --><div class=ad>Buy, buy. Now!</div><article><h1>A &amp;  b\n c</h1>" + STORY + "</article>")
    assert main_text(page) == "A & b c\n" + WANT


def test_ratios_without_marks():
    page = "<body>" + AROUND.format("<div class=c><h2>Head</h2>" + STORY + "</div><div class=x><a href=1>one</a> <a href=2>two</a></div><div>ok</div>")
    assert main_text(page) == "Head\n" + WANT
    own = [b for b in blocks_of(page) if not b.aside]
    assert content_paths(own) == {"body/div.c/p"}


def test_broken_markup():
    assert main_text("<article><p><b>One, two.<br><p>Three, four.</p><p>Five &amp six &#233; &unknown; &lt;b&gt;") == "One, two.\nThree, four.\nFive & six é &unknown; <b>"
    assert main_text("<article><p>a<br>b  c <i>d</i>e</p></article></div></p>") == "a b c de"
    assert main_text("<article><p>cut off here, <a href='x") == "cut off here,"
    assert main_text("<script>x") == main_text("<!--") == main_text("") == main_text(None) == ""


def test_table(spark):
    rows = [(1, "u", "<article><p>é𝄞, x.</p></article>", "t"), (1, "u", "<article><p>é𝄞, x.</p></article>", "t"), (2, None, None, "t"), (3, "", "<p>" + "Word, word. " * 50000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars) for r in extract(df).collect())
    assert got == [(1, 6), (1, 6), (2, 0), (3, 599999)]
    assert extract(df.limit(0)).collect() == []


def test_elements_left_open():
    article = "<article>" + STORY + "</article>"
    assert main_text("<html><head><title>x</title><body>" + article) == WANT
    assert main_text("<html><head><meta charset=utf-8><link href=a><script>s</script>" + article) == WANT
    assert main_text("<head><title>x</title>One, two.") == "One, two."
    assert main_text("<head><title>x</title></body>One, two.") == "One, two."
    assert main_text("<head><template><p>no</p></template><title>x</title></head><body>" + article) == WANT
    assert main_text("<head><template><p>no</p>") == ""
    assert main_text("<article><svg><g><path d='x'>" + STORY + "</article>") == WANT
    assert main_text("<article><svg><svg><path d='x'>" + STORY + "</article>") == WANT
    assert main_text("<article><svg><text>no</text><foreignObject><p>no</p></foreignObject></svg>" + STORY + "</article>") == WANT
    assert main_text("<article><select><option>no<input>" + STORY + "</article>") == WANT
    assert main_text("<article><table><tr><td><select><option>no<td>One, two.</table></article>") == "One, two."
    assert main_text("<article><p>One, two.</p><select><option>no</article><p>Out") == "One, two."


def test_quotes_in_bare_values_and_split_references():
    assert main_text("<article><p class=it's>Hello, world.</p><p>More text.</p></article>") == "Hello, world.\nMore text."
    assert main_text("<article><p title = 'a > b' class=\"x>y\">One &lt; two.</p></article>") == "One < two."
    assert main_text("<article><p>a&<b>lt;</b>b</p></article>") == "a&lt;b"
