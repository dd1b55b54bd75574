import pytest
from scoreloom.llm import templates

SCHEMA = "page_id long, url string, html string, text string, host string"
CASES = {
    "": "",
    "plain  text &lt;b&gt;\n x": "plain text <b> x",
    "<p>one<p>two <b>bold</b>er<ul><li>x<li>y</ul>": "one\ntwo bolder\nx\ny",
    "<nav>n</nav><header>h</header><article><header><h1>T</h1></header><p>a&nbsp;b<br>c</article><footer>f": "T\na b c",
    "<div class='has-sidebar'><main><p>m<aside>s</aside><div id=comments><p>c</div></main></div><div>late</div>": "m",
    "<article>a</article><article class=comment>no</article>": "a",
    "<body><div class='cookie-notice'>no</div><div>yes<form>f</form></div><div role=navigation>no</div>": "yes",
    "<head><title>t</title></head><script>var x='</p>';</script><style>p{}</style><p>q</p><!-- <p>c</p> -->": "q",
    '<p title="a>b">q</p> 1 < 2 <i>&amp;amp;</i>': "q\n1 < 2 &amp;",
    "<p>" + "<div>" * 20000 + "deep": "deep",
    "<p hidden>no</p><p>yes</p></div></section>": "yes",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
}


@pytest.mark.parametrize("page", CASES)
def test_page(page):
    assert templates.main_text(templates.parse(page)) == CASES[page]


def test_recurring_subtrees_go(rows_of):
    widget = "<div class=w><p>Read more about us</p></div>"
    rows = [(k, f"http://a.org/{k}", f"<div><p>story {k} &amp; more</p>{widget}</div>", "x", "y") for k in range(12)]
    rows += [(100 + k, f"http://b.org/{k}", f"<div><p>tale {k}</p>{widget}</div>", "x", "y") for k in range(4)]  # too few
    rows += [(200 + k, "http://c.org/", f"<article><p>copied</p></article><nav>{k}</nav>", "x", "y") for k in range(30)]  # one article
    rows += [(300, None, None, "x", "y"), (301, "no host", "", "x", "y"), (0, "http://a.org/0", rows[0][2], "x", "y")]
    got = templates.extract(rows_of(rows, SCHEMA), keep=["page_id", "host"]).collect()
    assert len(got) == len(rows)
    assert got[0].asDict().keys() == {"page_id", "host", "text"}
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == f"story {k} & more" for k in range(12))
    assert all(text[100 + k] == f"tale {k}\nRead more about us" for k in range(4))
    assert all(text[200 + k] == "copied" for k in range(30))
    assert text[300] == text[301] == ""


def test_empty_table(rows_of):
    assert templates.extract(rows_of([], SCHEMA)).collect() == []
