from quillroute.llm import html as H

PAGES = "page_id long, url string, html string, text string, n_chars string"
ARTICLE = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>Head &amp; line</h1><p>One\n  two<b>three</b><p>Four &lt;five&gt;<script>var x='</p>'</script><div class='comments'><p>me too</p></div></article><footer>foot</footer>"


def run(spark, rows, **p):
    return {r["page_id"]: r for r in H.extract(spark.createDataFrame(rows, PAGES), H.HtmlParams(**p)).collect()}


def test_article(spark):
    out = run(spark, [(1, "http://a.b/c", ARTICLE, "x", "y"), (2, None, None, None, None), (3, "u", "", None, None), (4, "http://a.b", "plain &amp; text", None, None)])
    assert out[1]["text"] == "Head & line\nOne twothree\nFour <five>"
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == "" and out[2]["n_chars"] == 0
    assert out[4]["text"] == "plain & text"


def test_recurring_subtrees_go_and_copies_count_once(spark):
    def page(i, body):
        return f"<body><div><p>Welcome to our site, friends</p></div><section><p>{body}</p><p>More about number {body} and its long story of words</p></section></body>"

    rows = [(i, "http://site.org/p", page(i, f"body {i}"), None, None) for i in range(8)]
    rows += [(100 + i, "http://copies.org/p", page(0, "same body"), None, None) for i in range(8)]
    out = run(spark, rows)
    for i in range(8):
        assert out[i]["text"] == f"body {i}\nMore about number body {i} and its long story of words"
        assert out[100 + i]["text"].startswith("Welcome")  # one page, copied: no evidence of a template


def test_brute_force_templates(spark):
    """The counts against a loop over the pages of each host."""
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<div><p>top {i % 3}</p></div><div><p>text {i} {'w ' * 30}</p></div>", None, None) for i in range(24)]
    p = H.HtmlParams(min_pages=3)
    out = run(spark, rows, min_pages=3)
    seen = {}
    parsed = {r[0]: H.parse_page(r[2], p) for r in rows}
    for r in rows:
        for s in parsed[r[0]].subtrees:
            seen.setdefault((r[1][:11], s), set()).add(parsed[r[0]].content)
    for r in rows:
        drop = {s for (h, s), pages in seen.items() if h == r[1][:11] and len(pages) >= 3 and len(pages) >= 0.02 * 12}
        x = parsed[r[0]]

        def around(at):
            return set() if at < 0 else {x.names[at]} | around(x.parents[at])

        assert out[r[0]]["text"] == "\n".join(t for t, at in x.blocks if not drop & around(at))


def test_broken_markup_and_empty_table(spark):
    cases = ["<p>a<p>b", "<a href='x>y'>q</a> 5 < 6", "<!-- unclosed", "<p", "</p></div>k", "<ul><li>a<li>b</ul>", "<a title=5\">z</a>", "<div>" * 3000 + "deep"]
    want = ["a\nb", "q 5 < 6", "", "", "k", "a\nb", "z", "deep"]
    out = run(spark, [(i, "http://x.y", c, None, None) for i, c in enumerate(cases)])
    assert [out[i]["text"] for i in range(len(cases))] == want
    assert run(spark, []) == {}


def test_templates_inside_a_marked_article(spark):
    def page(i):
        own = f"<p>Story {i} begins here and has words of its own, number {i}.</p>"
        return f"<body><{tag}><h1>Title {i}</h1>{own}<p>He said no.</p><div class='x1'><p>Sign up for our list</p></div>{own}</{tag}></body>"

    for tag in ("article", "main"):
        out = run(spark, [(i, "http://site.org/p", page(i), None, None) for i in range(8)])
        for i in range(8):
            own = f"Story {i} begins here and has words of its own, number {i}."
            assert out[i]["text"] == f"Title {i}\n{own}\nHe said no.\n{own}"


def test_names_and_teasers_do_not_drop_the_text(spark):
    body = "<p>The whole story is told here in many words.</p><p>It goes on for a while.</p>"
    want = "The whole story is told here in many words.\nIt goes on for a while."
    pages = [
        f"<article class='post has-comments'>{body}</article>",
        f"<div class='content has-sidebar'>{body}</div>",
        f"<div class='no-sidebar'><div id='related-work'>{body}</div></div>",
        f"<article class='social-story social'>{body}</article>",
        f"<body><div class='widget'>{body}</div></body>",  # most of the page's text
        f"<div>{body}</div><div class='Sidebar x'>side</div><div id='related_posts'>more</div>",
        f"<article>{body}</article><div>unlabelled clutter</div>",
        f"<p><span class='notice'>The whole</span> story is told here in many words.</p><p>It goes on for a while.</p><p class='share'>Share</p>",
    ]
    out = run(spark, [(i, f"http://h{i}.org", x, None, None) for i, x in enumerate(pages)])
    assert [out[i]["text"] for i in range(len(pages))] == [want] * len(pages)
    cards = "".join(f"<article><p>Card {i}</p></article>" for i in range(3))
    assert run(spark, [(1, "http://a.b", f"<div>{body}</div>{cards}", None, None)])[1]["text"] == f"{want}\nCard 0\nCard 1\nCard 2"


def test_templates_are_found_alike_on_hosts_of_every_size(spark):
    def page(i, notice):
        return f"<body>{notice}<div><p>Text {i} of this page is its own, number {i}.</p><table><tr><td>cell {i}</td><td>7</td></tr></table></div></body>"

    notice = "<div class='x1'><p>Closed on Sunday</p></div>"
    rows = [(i, "http://big.org/p", page(i, notice if i < 20 else ""), None, None) for i in range(3000)]
    rows += [(5000 + i, "http://mid.org/p", page(i, notice if i < 20 else ""), None, None) for i in range(200)]
    rows += [(6000 + i, "http://small.org/p", page(i, notice), None, None) for i in range(3)]
    rows += [(7000 + i, "http://two.org/p", page(i, notice), None, None) for i in range(2)]
    out = run(spark, rows)
    own = "Text {0} of this page is its own, number {0}.\ncell {0}".format
    assert all(out[i]["text"].startswith(own(i)) for i in range(3000))
    assert all(out[5000 + i]["text"].startswith(own(i)) for i in range(200))
    assert all(out[6000 + i]["text"].startswith(own(i)) for i in range(3))
    assert out[7000]["text"].startswith("Closed on Sunday")  # two pages are no evidence


def test_short_pieces_need_a_share_of_a_large_host(spark):
    rows = [(i, "http://big.org/p", f"<div><p>Text {i} of this page is its own.</p><table><tr><td>cell {i}</td><td>{i % 100}</td></tr></table></div>", None, None) for i in range(1000)]
    out = run(spark, rows)
    assert all(out[i]["text"] == f"Text {i} of this page is its own.\ncell {i}\n{i % 100}" for i in range(1000))


def test_hostile_markup_takes_linear_time():
    import time

    from quillroute.llm import html as H

    p = H.HtmlParams()
    for make in (lambda n: "<div>x " * n, lambda n: "<a href=\"x " * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<h1>t</h1>" * n, lambda n: "<p title='it" * n + ">"):
        took = []
        for n in (2000, 16000):
            t = time.perf_counter()
            found = H.parse_page(make(n), p)
            took.append(time.perf_counter() - t)
            assert len(found.names) <= n + 1
        assert took[1] < 30 * max(took[0], 0.02)


def test_long_tags_and_comments_are_markup_all_the_same():
    from quillroute.llm import html as H

    p = H.HtmlParams()
    page = f"<div data-x=\"{'y > ' * 5000}\"><p>one</p><!-- {'z > ' * 5000} --><p title='a<b'>two 1 < 2</p></div>"
    assert H.parse_page(page, p).without(set()) == "one\ntwo 1 < 2"
