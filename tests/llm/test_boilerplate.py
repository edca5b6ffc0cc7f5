import random

import numpy as np

from modelgate.llm.boilerplate import MIN_RUN, blocks, extract, extract_text, repeated

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><div class='ad'>Buy</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld&nbsp;word<br>here.<p>Two &lt;3 &#233;
 lines<form>name <input name=q></form><aside>see also</aside><ul><li>item</li><li>next</li></ul>
<section id="comments"><article class="comment"><p>nice post</p></article></section></article>
<div id="sidebar">links</div><footer>&copy; me</footer></body></html>"""


def test_declared_article():
    text, place, _ = extract([PAGE])[0]
    assert place == "article"
    assert text == "Title & more\nOne bold word here.\nTwo <3 é lines\nitem\nnext"


def test_odd_markup():
    for page, want in [
        ("", ""), (None, ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("a < b and c > d", "a < b and c > d"),
        ("<div>cut <b>off</b> &am", "cut off &am"), ("<p>x</p><di", "x"), ("<p title=\"a > b\">y</p>", "y"),
        ("<script>never closed <p>a", ""), ("</p></div>z", "z"), ("<p hidden>h</p><p>v</p>", "v"), ("<!-- open <p>a", ""),
        ("<main><p>in</p></main><p>out</p>", "in"), ("<p>" + "long " * 50000 + "</p>", ("long " * 50000).strip()),
        ('<div "><p>unbalanced</p>', "unbalanced"),
    ]:
        assert extract([page])[0][0] == want, (page or "")[:40]


def brute_repeated(streams, names):
    n = MIN_RUN
    seen = {}
    for i, s in enumerate(streams):
        for j in range(len(s) - n + 1):
            seen.setdefault(tuple(s[j : j + n]), set()).add(names[i])
    out = []
    for s in streams:
        mask = [False] * len(s)
        for j in range(len(s) - n + 1):
            if len(seen[tuple(s[j : j + n])]) > 1:
                mask[j : j + n] = [True] * n
        out += mask
    return out


def test_repeated_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        passage = [rng.randint(0, 30) for _ in range(12)]
        streams = []
        for _ in range(5):
            s = [rng.randint(0, 2 if rng.random() < 0.3 else 500) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                at = rng.randint(0, len(s))
                s[at:at] = passage[: rng.randint(6, 12)]
            streams.append(s)
        names = np.array([streams.index(s) for s in streams])
        keys = np.array([x for s in streams for x in s], dtype=np.int64)
        pages = np.array([i for i, s in enumerate(streams) for _ in s], dtype=np.int64)
        assert repeated(keys, pages, names).tolist() == brute_repeated(streams, names.tolist())


def test_unmarked_boilerplate_goes_by_repetition(spark):
    menu = "<ul><li>Home of it</li><li>About us all</li><li>Contact and more</li></ul>"
    offer = "<div>Get all the best offers of this week delivered to you today</div>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", f"<body>{menu}<p>p{i} q{i} r{i} s{i}.</p>{offer}</body>", "x") for i in range(8)]
    rows += [(100, None, None, "x"), (101, "http://c.org", "", "x"), (None, "http://d.org/", PAGE, "x"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "text", "text_", "n_chars", "place", "n_boilerplate"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text_"])
        if r["page_id"] is not None and r["page_id"] < 100:
            assert r["text_"] == "p{0} q{0} r{0} s{0}.".format(r["page_id"])
    assert {r["text_"] for r in got if r["page_id"] in (100, 101)} == {""}
    assert [r["text_"] for r in got if r["page_id"] is None] == [extract([PAGE])[0][0]]
    assert extract_text(df.limit(0)).count() == 0


def test_equal_pages_do_not_make_each_other_boilerplate():
    page = "<p>" + " ".join(f"w{i}" for i in range(40)) + "</p>"
    assert [t for t, _, _ in extract([page, page])] == [" ".join(f"w{i}" for i in range(40))] * 2
    assert blocks(page)[1] == "page"


def test_host_is_searched_whole_whatever_its_partitions(spark):
    rare = "<p>{0}a {0}b {0}c</p><p>all rights of this rare passage belong to the owners of it</p>"
    pages = [f"<p>u{i} v{i} w{i} x{i} y{i} z{i} k{i} l{i} m{i}</p>" for i in range(600)]
    pages[3], pages[597] = rare.format("q"), rare.format("r")  # on two pages of 600
    note = "<p>Read more of our stories every day in the morning paper.</p>"
    own = "<p>" + " ".join("{0}w%d" % k for k in range(30)) + "</p>"
    pages += [f"<article>{own.format(f'n{i}')}{note}</article>" for i in range(3)]  # a common block
    pages += [f"<article>{own.format('copied')}<p>c{i}</p></article>" for i in range(3)]  # a copied article
    pages += [f"<article>{own.format(f'two{i}')}<p>one quoted block in two of the articles only here</p></article>" for i in range(2)]
    want = extract(pages)
    assert want[3][0] == "qa qb qc" and want[597][0] == "ra rb rc" and want[0][2] == 0
    assert [w[0] for w in want[600:603]] == [" ".join(f"n{i}w{k}" for k in range(30)) for i in range(3)]
    assert all(t.startswith("copiedw0 ") for t, _, _ in want[603:606]) and all("quoted" in t for t, _, _ in want[606:])
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for n in (1, 7):
        got = {r["page_id"]: (r["text"], r["place"], r["n_boilerplate"]) for r in extract_text(df.repartition(n), keep=["page_id"]).collect()}
        assert got == dict(enumerate(want)), n


def test_classes_do_not_empty_pages():
    long = "a long text of the page that is its whole content"
    for page, want in [
        (f'<html class="no-sidebar"><body class="single-post no-sidebar comments"><p>{long}</p></body></html>', (long, "page")),
        (f'<body><div class="content has-sidebar"><p>{long}</p></div></body>', (long, "page")),
        (f'<body><article class="post comments comments-open"><p>{long}</p></article></body>', (long, "article")),
        (f'<body><div class="widget"><article><p>{long}</p></article></div><p>more</p></body>', (long, "article")),
        (f'<body><form action="x"><div><p>{long}</p></div><div class="menu">Home</div></form></body>', (long, "page")),
        (f'<body><form><main><p>{long}</p></main></form><p>out</p></body>', (long, "main")),
        (f'<main><p>{long}</p><article class="card">teaser</article></main>', (f"{long}\nteaser", "main")),
        (f'<main><p>{long}</p></main><article class="card">teaser</article>', (long, "main")),
        (f'<p>{long}</p><div class="sidebar"><article>teaser</article></div>', (long, "page")),
        (f'<article><p>{long}</p><div class="comments"><article>nice</article></div></article>', (long, "article")),
        (f'<p>{long}</p><div class="cookie-notice">We use</div><div id="ad">Buy</div><form>name</form>', (long, "page")),
    ]:
        assert extract([page])[0][:2] == want, page


def test_copied_bodies_without_marks_stay(spark):
    body = " ".join(f"b{i}" for i in range(300))
    menu = " ".join(f"m{i}" for i in range(12))
    pages = [f"<p>{menu}</p><p>{body} {end}</p>" for end in ("monday", "tuesday again")]
    pages += [f"<p>{menu}</p><p>p{i}a p{i}b p{i}c</p>" for i in range(2)]
    want = extract(pages)
    # the menu before the body is one stretch with it on these two pages
    assert [t for t, _, _ in want] == [
        f"{menu}\n{body} monday", f"{menu}\n{body} tuesday again", "p0a p0b p0c", "p1a p1b p1c"
    ]
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["place"], r["n_boilerplate"]) for r in extract_text(df, keep=["page_id"]).collect()}
    assert got == dict(enumerate(want))
