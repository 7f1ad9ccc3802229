"""op3's boilerplate of a host does not depend on how its pages are dealt into shards."""

import random

NOTICE = "this notice stands on three pages of the host and must go"


def plain(pages, long=8, least=3):
    """Text of each page without the tokens of runs of ``long`` tokens that ``least`` pages hold."""
    held = {}
    for i, words in pages.items():
        for k in range(len(words) - long + 1):
            held.setdefault(tuple(words[k : k + long]), set()).add(i)
    out = {}
    for i, words in pages.items():
        gone = {k + j for k in range(len(words) - long + 1) if len(held[tuple(words[k : k + long])]) >= least for j in range(long)}
        out[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


def test_shards_of_a_host(spark):
    from palisade.llm.html_extract import extract
    from palisade.session import ship

    rnd = random.Random(4)
    pages = {}
    for i in range(60):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 7, 8, 40]))]
        if i in (7, 28, 49):
            words[2:2] = NOTICE.split()
        pages[i] = words + ("menu of the site on every page at the end" if i % 2 else "").split()
    ship(spark)
    table = spark.createDataFrame([(i, "http://big.example/x", f"<p>{' '.join(w)}</p>") for i, w in pages.items()] + [(0, "http://big.example/x", f"<p>{' '.join(pages[0])}</p>")], "page_id long, url string, html string")
    want = plain(pages)
    assert NOTICE not in want[7] and "w" in want[7]
    for shard in (2000, 10, 2):
        rows = extract(table, shard=shard).collect()
        assert len(rows) == 61
        assert {r.page_id: r.text for r in rows} == want, shard


def text_of(page):
    from palisade.llm.html_extract import page_blocks

    found = page_blocks(page)
    return "\n".join([t for inside, t in found if inside] or [t for _, t in found])


# Pages whose end tags are missing or that look like what is dropped, and their text.
LOOSE = {
    "<html><head><meta charset=utf-8><body><article><h1>T</h1><p>x</article>": "T\nx",
    "<head><title>no</title><main>x<p>y</main><footer>f": "x\ny",
    "<article><p class='notice'>x<p>First<p>Second</article>": "First\nSecond",
    "<article><ul><li class='share'>s<li>real item</ul></article>": "real item",
    "<article><dl><dt class=ad>x<dd>kept<dt>too</dl></article>": "kept\ntoo",
    "<article><table><tr><td>a<td class=ad>x<tr><td>b</table></article>": "a\nb",
    "<article><h1>H</h1><form><input><p>First<p>Second</article>": "H\nFirst\nSecond",
    "<article><h1>H</h1><form><p>name</p></form><p>First</article>": "H\nFirst",
    "<form id=page><nav>m</nav><main><p>a</p></main><p>out</p></form>": "a",
    "<article class='post social-impact' id='related-work'><p>body</p></article>": "body",
    "<article><p>body</p><article class='comment'><p>nice</p></article><p>end</p></article>": "body\nend",
    "<article><p>Hello <span class=ad>buy <p>next</article>": "Hello\nnext",
    "<article><p>Hello <span class='ad'>buy</span> world</p></article>": "Hello world",
    "<div><article><p>a</p></div><p>b</p></article></div>": "a\nb",
    "<nav><a>m</a><article><p>t</p></article>": "t",
    "<article><p>a<b>b</b>c<br>d &amp; &#233;<!-- no --></p><script>if (a < b) x('</p>')</script><pre>l1\n  l2</pre></article>": "abc d & é\nl1 l2",
    "<ARTICLE><P>a < b and c > d</P><P ROLE=navigation>n</P><p hidden>h</p><p hidden=until-found>s</p></ARTICLE>": "a < b and c > d\ns",
    "<article><header><h1>H</h1></header><aside>s</aside><div class='share-bar'>x</div><p>t</p><footer>f</footer></article>": "H\nt",
    "<p>only</p><p>loose": "only\nloose",
    "": "",
    "<article></article>": "",
    "<script>never ends": "",
}


def test_loose_markup():
    for page, want in LOOSE.items():
        assert text_of(page) == want, page


def test_deep_pages_are_read_whole():
    n = 20_000
    assert text_of("<article>" + "<b><div>" * n + "deep" + "</hr></x><hr>" * n + "<p>end</article>") == "deep\nend"
    assert text_of("<article>" + "<nav>" * n + "no" + "</nav>" * n + "<p>end</article>") == "end"


def test_article_and_page_of_a_host(spark):
    """Pages with an article keep all of it; the host's pages without one lose what they repeat."""
    from palisade.llm.html_extract import extract
    from palisade.session import ship

    ship(spark)
    notice = "all rights are with the owner of this site and its authors"
    rows = [(i, f"https://h.example/{i}", f"<p>{notice}</p><p>n{i} is the number of this page</p>") for i in range(4)]
    rows += [(10, "https://h.example/a", f"<article><p>{notice}</p></article>"), (11, "https://other.example/", f"<p>{notice}</p>"), (None, None, "<p>x</p>"), (None, None, None)]
    got = sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(-1, "", 0), (-1, "x", 1)] + [(i, f"n{i} is the number of this page", 29) for i in range(4)] + [(10, notice, len(notice)), (11, notice, len(notice))]
    assert got == want
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_that_share_an_id(spark):
    """Null and equal ids on different pages of equal length, copies under other ids, clashing names, one and several shards: only what three different pages hold goes."""
    from palisade.llm.html_extract import extract
    from palisade.session import ship

    ship(spark)
    own = lambda i: " ".join(f"{w}{i}" for w in ("these", "eight", "words", "stand", "on", "one", "page", "alone"))
    bodies = [f"{own(i)} {NOTICE}" if i < 3 else own(i) for i in range(40)]
    rows = [(i, None if i % 3 == 0 else 7, b) for i, b in enumerate(bodies)] + [(100 + i, i, bodies[9]) for i in range(10)]
    table = spark.createDataFrame([(page, "http://one.example/", f"<p>{b}</p>", str(i), "d", "t", "l") for i, page, b in rows], "page_id long, url string, html string, host string, digest string, text string, loose string")
    want = sorted(b.removesuffix(" " + NOTICE) for _, _, b in rows)
    for shard in (2000, 10, 2):
        got = extract(table, shard=shard).collect()
        assert sorted(r.text for r in got) == want and sorted(str(r.page_id) for r in got) == sorted(str(p) for _, p, _ in rows)
