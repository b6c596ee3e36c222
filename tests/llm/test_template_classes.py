"""Templates from equivalence classes: copies, shared headings, layouts, sidebars and hostile markup."""

import time

import numpy as np
import pytest

from chatloom.llm import template


def sentence(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in draw.integers(0, 500, n))


def texts(spark, pages):
    docs = spark.createDataFrame(
        [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)], "page_id long, url string, html string"
    )
    return [r.text for r in template.extracted(docs).orderBy("page_id").collect()]


def test_articles_keep_what_pages_share(spark):
    """Near-copies on a host of two pages, in flat, wrapped and sectioned pages; headings of all articles."""
    pages, want = [], []
    copy = [sentence(s, 12) for s in range(10)]
    other = [*copy[:4], sentence(99, 12), *copy[5:]]
    for host, wrap, each in [
        ("flat", "<body><nav>Menu</nav>{}</body>", "<p>{}</p>"),
        ("wrapped", "<body><div id=t>Home</div><div id=x>{}</div></body>", "<p>{}</p>"),
        ("sections", "<body><div id=x>{}</div></body>", "<div class=s{1}>{0}</div>"),
    ]:
        for lines in (copy, other):
            pages.append((host, wrap.format("".join(each.format(x, k) for k, x in enumerate(lines)))))
            want.append("\n".join(lines))
    for named in ("<article>{}</article>", "<div id=x>{}</div>"):
        for i in range(6):
            body = f"<h2>Introduction</h2><p>{sentence(200 + i, 30)}</p><h2>Conclusion</h2><p>{sentence(300 + i, 9)}</p>"
            pages.append((f"headings{len(named)}.example", "<body><div id=t>Home page</div>" + named.format(body)))
            want.append(f"Introduction\n{sentence(200 + i, 30)}\nConclusion\n{sentence(300 + i, 9)}")
    assert texts(spark, pages) == want


@pytest.mark.parametrize("layouts", [2, 3])
def test_layouts_of_a_host(spark, layouts):
    """Each layout has its own constant texts, in elements of its own or in elements that all share."""
    pages, want = [], []
    for i in range(8 * layouts):
        k, text = i % layouts, sentence(500 + i, 40)
        own = f"<body><div id=t{k}>Top links number {k}</div><div id=x{k}><p>{text}</p></div><div id=n{k}>Fine print {k}</div>"
        shared = f"<body><div id=t>Top links number {k}</div><div id=x{k}><p>{text}</p></div><div id=n>Fine print {k}</div>"
        flat = f"<body><div id=t>Top links number {k}</div><p>{text}</p><p>{text[::-1]}</p><div id=n>Fine print {k}</div>"
        pages += [("own", own), ("shared", shared), ("flat", flat)]
        want += [text, text, f"{text}\n{text[::-1]}"]
    assert texts(spark, pages) == want


def test_unnamed_sidebars(spark):
    """Varying lists of links, teasers that come again on other pages, and one short varying box."""
    pages, want = [], []
    pool = [sentence(s, 6) for s in range(700, 705)]
    for i in range(12):
        text = sentence(600 + i, 60)
        links = "".join(f"<li><a href=/{k}>{sentence(1000 * i + k, 4)}</a>" for k in range(6))
        pages.append(("links", f"<body><div id=q7><ul>{links}</ul></div><div id=x><p>{text}</p><p>{text[:8]}</p></div>"))
        teasers = "".join(f"<p>{pool[(i + k) % 5]}</p>" for k in range(2))
        pages.append(("pool", f"<body><div id=x><p>{text}</p></div><div id=q7>{teasers}</div>"))
        pages.append(("box", f"<body><div id=x><p>{text}</p></div><div id=q7><p>{sentence(800 + i, 4)}</p></div>"))
        want += [f"{text}\n{text[:8].strip()}", text, text]
    assert texts(spark, pages) == want


@pytest.mark.parametrize(
    "html",
    [
        '<a b="' * 170_000,
        '<a ">"' * 170_000 + "'",
        "<a b='>" * 140_000,
        "<div>" * 50_000 + "<h1>deep</h1> text <a>link</a>",
        "<div>" * 50_000 + "x</span>" * 50_000,
        "</script " * 110_000,
        "<script>" + "</script " * 110_000,
        "<" * 1_000_000,
        "<!" * 500_000,
        "<!--" * 250_000,
        "<p>" * 300_000,
    ],
    ids=lambda html: html[:12],
)
def test_hostile_markup_takes_linear_time(html):
    begin = time.perf_counter()
    tokens = [
        dict(zip(("count", "parent", "tag", "named", "chars", "around", "linked"), t, strict=True), role=r, item=i, times=2, pages=2, vector=5)
        for (r, i), t in template.page_tokens(html).items()
    ]
    found = template.Template(tokens, 2, 5)
    assert isinstance(template.main_text(html, found.mains(), found.closed), str)
    assert time.perf_counter() - begin < 20


def test_scanner():
    read = [(k, v) for k, v, _ in template.events("a < b <!-- <p> --><B x='>'>c</B\n><script>1<2</script >d<!-- e")]
    assert read == [
        ("text", "a < b "), ("open", "b"), ("text", "c"), ("close", "b"),
        ("open", "script"), ("close", "script"), ("text", "d"),
    ]
    assert list(template.events('x <a b="<p>y')) == [("text", "x ", None), ("open", "a", ""), ("text", "y", None)]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L page_id, 'http://h/' url, cast(unhex('3C703E61FF623C2F703E') as string) html")
    assert template.extracted(docs).first().text == "a�b"
