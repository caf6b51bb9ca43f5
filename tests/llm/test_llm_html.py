from cohortspark.llm.html_extract import Page, extract, votes, winning_paths

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div class="ad">Buy this</div><article class="post-12"><h1>Head &amp;  line</h1><p>One <b>bold<br>word</b>.<p>Two
 lines<ul><li>item<li>next</ul><form><input value=x>Send</form><script>x()</script>
<section class="comments"><p>I disagree</p></section></article><aside>Others</aside><footer>&copy; foot</footer></body></html>"""


def test_article_without_what_surrounds_it():
    page = Page(PAGE)
    assert page.best()[0] == ">html>body>article.post-#"
    assert page.extract(None) == "Head & line\nOne bold word.\nTwo lines\nitem\nnext"


def test_cut_off_pages():
    for end in range(len(PAGE)):
        Page(PAGE[:end]).extract(None)
    assert Page("<article><p>One &am").extract(None) == "One &am"
    assert Page("<article><p>One <a href=").extract(None) == "One"
    assert Page("<article><p>One <!-- no").extract(None) == "One"


def test_hosts_agree_on_a_path(spark):
    usual = "<body><div class=main><p>" + "words of the text " * 5 + "</p></div><div class=x><p>short</p></div></body>"
    odd = "<body><div class=main><p>little</p></div><div class=x><p>" + "a very long side text " * 20 + "</p></div></body>"
    rows = [(i, f"http://A.net/{i}", usual) for i in range(3)] + [(9, "https://a.net?q", odd), (10, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    paths = {r.host: r.path for r in winning_paths(votes(pages)).collect()}
    assert paths == {"a.net": ">body>div.main"}
    found = {r.page_id: r.text for r in extract(pages).collect()}
    assert found[9] == "little" and found[10] == "" and found[0] == " ".join(["words of the text"] * 5)


def test_pages_of_the_table_have_their_documents(spark, small):
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = extract(spark.read.parquet(f"{small}/pages.parquet")).collect()
    assert rows
    for r in rows:
        lines = [" ".join(x.split()) for x in texts[int(re.search(r"/(\d+)", r.url)[1])].split("\n")]
        assert r.text.split("\n")[1:] == [x for x in lines if x]


def test_names_around_and_on_the_article_lose_nothing():
    text = "<p>" + "words of the text " * 10 + "</p>"
    wanted = " ".join(["words of the text"] * 10)
    for page in (
        f"<div class=content-sidebar-wrap><main>{text}</main></div>",
        f"<div class=sidebar-wrap><div><main>{text}</main></div><div class=ad>Buy</div></div>",
        f"<div id=main class=no-sidebar>{text}</div>",
        f"<article class='post comments-open'>{text}</article>",
        f"<main class=widget>{text}</main>",
        f"<div class='entry ad-free'>{text}</div><div class=ad>Buy</div>",
        f"<article>{text}</article><div class=comments><p>{'I disagree ' * 90}</p></div>",
    ):
        assert Page(f"<body>{page}</body>").extract(None) == wanted, page


def test_pages_without_article_keep_title_and_lead():
    body, lead = "body " * 200, "lead " * 80
    page = Page(f"<body><div id=content><h1>Title</h1><div class=text><p>{body}</p></div></div></body>")
    assert page.extract(None) == "Title\n" + body.strip()
    page = Page(f"<body><div id=c><div class=lead><p>{lead}</p></div><div class=text><p>{body}</p></div></div></body>")
    assert page.extract(None) == lead.strip() + "\n" + body.strip()
    links = "<p><a href='/x'>" + "elsewhere " * 9 + "</a></p>"
    page = Page(f"<body><div id=c><div class=text><p>{body}</p></div><div class=list>{links}</div></div></body>")
    assert page.extract(None) == body.strip()


def test_nothing_of_the_article_goes_with_inline_names_headers_forms_or_self_closed_elements():
    body = "body " * 100
    for page, wanted in (
        (f"<article><svg class='i'/><p>{body}</p></article>", body),
        (f"<article><p>{body}</p><math/><p>more</p></article>", body + "\nmore"),
        (f"<article><svg><p>{body}</p></article>", body),
        (f"<article><p>It costs <span class='share-price'>12 dollars</span>. {body}</p></article>", "It costs 12 dollars. " + body),
        (f"<article><p>An <em class='related-term'>idea</em> {body}</p></article>", "An idea " + body),
        (f"<article><p class='notice-period'>{body}</p></article>", body),
        (f"<main><header><h1>Title</h1></header><p>{body}</p></main>", "Title\n" + body),
        (f"<header>Site</header><main><p>{body}</p></main>", body),
        (f"<form id=all><div class=head>x</div><article><p>{body}</p></article><select><option>a</select></form>", body),
        (f"<form id=all><div><p>{body}</p></div><button>Go</button></form>", body),
        (f"<article><p>{body}</p><form>Send this</form></article>", body),
        (f'<article><p title="open>{body}</p></article>', body),
    ):
        found = Page(f"<body>{page}</body>").extract(None)
        assert found == "\n".join(x.strip() for x in wanted.split("\n")), page


def test_hostile_pages_take_time_in_proportion_to_their_length():
    import time

    size = 1 << 20
    parts = ["<a", "<a '", "<a \"'", "<a '>' ", "<div>", "<div class=ad>x", "<div class=ad>x</div>", "<svg>", "<b>", "</b>", "<!--", "<p><b>"]
    parts += ["<b></div>", "<", "</", "<script", "<a b='", "<form>", "<li><b>x"]
    for part in parts:
        start = time.perf_counter()
        Page("<article><p>One</p>" + part * (size // len(part))).extract(None)
        assert time.perf_counter() - start < 30, part
    start = time.perf_counter()
    Page("<b>" * (size // 8) + "<div></div>" * (size // 16)).extract(None)
    Page("<a " * (size // 4) + "'>").extract(None)
    assert time.perf_counter() - start < 60
