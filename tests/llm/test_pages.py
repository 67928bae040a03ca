"""Main text and URL filters."""

import re

import numpy as np

from prepkit.llm import main_text, url_filter

HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies to annoy you a lot.</div>
<article><header><h1>The  title</h1><p>By somebody</p></header><p>First &amp; longest paragraph,<br>with a <b>bold</b>
word&nbsp;and more than enough text to be content.<p>Short.</p><ul><li>one<li>two</ul>
<form>Name <input name=a> <button>Send</button></form><aside>Aside</aside><pre>a   b</pre></article>
<section id="comments"><article class="comment"><p>Some reader comment that is rather long, too long even.</p></article></section>
<footer>&copy; Foot</footer></body></html>"""


def test_article():
    assert main_text.extract(HTML).split("\n\n") == [
        "The title", "First & longest paragraph, with a bold word and more than enough text to be content.", "Short.",
        "one", "two", "a b"]


def test_without_article():
    page = ("<body><div id=menu><a href=a>A</a> <a href=b>B</a></div><div class='content with-sidebar'><h1>Head</h1>"
            "<p>A paragraph that is long enough to stand out as content of the page.</p><p>End.</p></div>"
            "<div><a href=c>other page</a></div></body>")
    assert main_text.extract(page).split("\n\n") == [
        "Head", "A paragraph that is long enough to stand out as content of the page.", "End."]


LONG_P = "<p>A paragraph of the body that is long enough to stand out as content of the page, %s in words.</p>"


def test_content_outside_articles_stays():
    """Articles are cards only: the body in a div is the content; a long article and a long div both stay."""
    body = "<div class=body><h1>Head</h1>" + "".join(LONG_P % i for i in range(4)) + "<h2>Short</h2>" + LONG_P % "last" + "</div>"
    cards = "<div><article class=card><a href=a>Card one</a></article><article class=card><p>Card two</p></article></div>"
    for page in (f"<body>{body}{cards}</body>", f"<body>{cards}{body}</body>"):
        got = main_text.extract(page).split("\n\n")
        assert [x[:5] for x in got] == ["Head", *["A par"] * 4, "Short", "A par"]
    both = f"<body><article><h1>Title</h1>{LONG_P % 'x'}{LONG_P % 'y'}</article>{body}</body>"
    assert len(main_text.extract(both).split("\n\n")) == 10


def test_class_words_do_not_drop_the_content():
    inner = "<h1>Head</h1>" + LONG_P % "one" + LONG_P % "two"
    for page in (f"<article class='post category-social'>{inner}</article>", f"<main class='has widget'>{inner}</main>",
                 f"<div class='content-widget'>{inner}</div>", f"<div class='content-widget'><article>{inner}</article></div>"):
        got = main_text.extract(f"<body>{page}<div class=social>Share this</div><div>Foot</div></body>").split("\n\n")
        assert got[0] == "Head" and len(got) == 3, page
    ad = "<div class=ad>" + LONG_P % "of an advert" * 5 + "</div>"
    comments = "<div id=comments>" + LONG_P % "of a reader" * 9 + "</div>"
    assert "advert" not in main_text.extract(f"<body>{ad}<article>{inner}</article></body>")
    assert "reader" not in main_text.extract(f"<body><div class=post>{inner}</div>{comments}</body>")


def test_the_ratio_chooses_the_regions(monkeypatch):
    """Pages that come out wrong if every line counts as content."""
    body = "<div class=body><h1>Head</h1>" + "".join(LONG_P % i for i in range(4)) + "</div>"
    cards = "<div>" + "".join(f"<article class=card><a href=a>Card {i}</a></article>" for i in range(6)) + "</div>"
    foot = "<div><div><span>a</span> <b>b</b> <i>c</i></div><div><u>d</u></div></div>"
    pages = [f"<body>{cards}{body}</body>", f"<body>{body}{foot}</body>"]
    got = [main_text.extract(p) for p in pages]
    assert all("Card" not in t and "Head" in t and not t.endswith("d") for t in got)
    plain = main_text._content
    monkeypatch.setattr(main_text, "_content", lambda lines: (plain(lines)[0], np.ones(len(lines), bool)))
    assert all(main_text.extract(p) != t for p, t in zip(pages, got))


def test_unclosed_and_unopened_elements_take_linear_time():
    import time
    for part in ("<div>x", "<div class=ad>x", "<div class=ad>x</div>", "<div>x</span>", "<section><p>x", "<li><div>x", "<b>x"):
        t0 = time.process_time()
        main_text.extract(part * 20_000)
        once = time.process_time() - t0
        assert once < 6, (part, once)
    assert main_text.extract("<div>x" * 100_000).count("x") > 99_990      # the smoothed ends fall below the threshold
    assert main_text.extract("<span><article>" + "<div>a</span>" * 20_000).count("a") == 20_000


def test_broken_pages():
    assert main_text.extract("") == ""
    assert main_text.extract("<p>never closed") == "never closed"
    assert main_text.extract("plain text &lt;b&gt;") == "plain text <b>"
    assert main_text.extract("<script>only</script>") == ""
    assert main_text.extract("<nav>only</nav>") == ""
    assert main_text.extract("<body></div><article>a<p>b</article></div></body></html>") == "a\n\nb"
    assert main_text.extract("<div>" * 3000 + "deep") == "deep"
    assert len(main_text.extract("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 11 - 2


def test_pages_have_their_article(table):
    pages = table("pages")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = main_text.main_text(pages).collect()
    assert len(rows) == len(html)
    import html as H
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", html[r.page_id], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", b).replace("<br>", "\n")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", None, "c"), (1, "u", None, "c"), (None, None, HTML, "c"), (2, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars > 0) for r in got.collect()) == [("1", False), ("1", False), ("2", False), ("None", True)]
    assert main_text.main_text(df.where("false")).collect() == []


def brute_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["http://www.Example.org/es/1", "https://example.org/en/12#x", "https://notexample.org/en/1", "ftp://org/", "http://a.org",
        "http://x.com/fr/a?b=/de/", "http://x.com/de", "http://x.com/de/", "x.com/de/", None, "", "http://", "://com/de/x", "a://b://c/d",
        "http://ORG?x", "http://É.Com/fr/", "http://com/fr/\n"]


def test_rules(spark, table):
    urls = URLS + [r.url for r in table("pages").collect()]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u, url_filter.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict)
    assert url_filter.filter_urls(df.where("false")).collect() == []


def test_templates_and_purity(spark):
    """A template whose labelled urls are blocked is rejected for its other urls; merged branches judge together."""
    rules = [("block", "shop.test/buy/1"), ("block", "shop.test/order/1"), ("allow", "shop.test/help/")]
    urls = [f"http://shop.test/buy/{i}/now" for i in range(100, 400)] + [f"http://shop.test/order/{i}/now" for i in range(100, 220)]
    urls += [f"http://shop.test/help/{i}" for i in range(200)] + ["http://shop.test/other/5", "http://else.test/buy/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_filter.filter_urls(df, rules).collect()}
    a = got["http://shop.test/buy/300/now"]
    assert (a.rule, a.verdict, a.template) == (None, "block", "shop.test/buy/*/now") and a.purity > 0.9
    b = got["http://shop.test/order/210/now"]
    assert b.verdict == "block" and b.purity == a.purity
    assert got["http://shop.test/help/7"].verdict == "allow"
    assert 0.3 < got["http://shop.test/other/5"].purity < 0.7 and got["http://shop.test/other/5"].verdict == "allow"
    assert got["http://else.test/buy/7"].verdict == "allow"


def test_rare_segments_become_wildcards(spark):
    urls = [f"http://a.test/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(200)] + ["http://a.test/about/x"] * 100
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.template for r in url_filter.filter_urls(df).collect()}
    assert got == {"a.test/*/x", "a.test/about/x"}


def test_small_sections_of_a_large_node_keep_their_own_verdict(spark):
    """A blocked section of 1.9 % stays apart whether its host has 32 sections or many more."""
    for sections in (31, 32, 60):
        rules = [("block", "hot.test/spam/1")] + [("allow", f"hot.test/part-{chr(97 + k // 26)}{chr(97 + k % 26)}/") for k in range(sections)]
        urls = [f"http://hot.test/spam/{i}" for i in [*range(100, 130), *range(200, 208)]]
        urls += [f"http://hot.test/part-{chr(97 + i % sections // 26)}{chr(97 + i % sections % 26)}/{i}" for i in range(1962)]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = {urls[r.page_id]: r for r in url_filter.filter_urls(df, rules).collect()}
        assert {(r.template, r.verdict) for u, r in got.items() if "/spam/" in u} == {("hot.test/spam/*", "block")}, sections
        assert {r.verdict for u, r in got.items() if "/part-" in u} == {"allow"}


def test_deep_paths_are_judged_by_all_their_segments(spark):
    rules = [("block", "deep.test/a/b/c/d/spam/x/1"), ("allow", "deep.test/a/b/c/d/docs/y/1")]
    urls = [f"http://deep.test/a/b/c/d/{s}/{i}/e/f" for s in ("spam/x", "docs/y") for i in range(100, 260)]
    urls += ["http://deep.test/" + "z/" * 500, "http://deep.test/a/b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.filter_urls(df, rules).collect()
    got = {urls[r.page_id]: r for r in rows}
    assert len(got) == len(rows) == len(urls)
    for r in rows:
        if "/spam/" in urls[r.page_id]:
            assert (r.template, r.verdict) == ("deep.test/a/b/c/d/spam/x/*/e/f", "block")
        elif "/docs/" in urls[r.page_id]:
            assert (r.template, r.verdict) == ("deep.test/a/b/c/d/docs/y/*/e/f", "allow")
    assert got["http://deep.test/" + "z/" * 500].template == "deep.test" + "/*" * 500


def brute_tree(rows):
    """[(template, grown)] of rows (host, segments, said), by walking one node at a time."""
    u, out = url_filter, [None] * len(rows)

    def grow(name, at, level):
        def end(members):
            for i in members:
                out[i] = name + "/*" * max(len(rows[i][1]) - level, 0), level

        said = [rows[i][2] for i in at if rows[i][2]]
        if len(at) < u.ENOUGH and len(said) < u.TESTED:
            return end(at)
        end([i for i in at if len(rows[i][1]) <= level])
        at = [i for i in at if len(rows[i][1]) > level]
        segs = {}
        for i in at:
            segs.setdefault(rows[i][1][level], []).append(i)
        count = {x: (len(m), sum(rows[i][2] is not None for i in m), sum(rows[i][2] == "block" for i in m)) for x, m in segs.items()}
        n_all, b_all = sum(c[1] for c in count.values()), sum(c[2] for c in count.values())
        children = {}
        for x, m in segs.items():
            urls, n, b = count[x]
            n0, b0 = n_all - n, b_all - b
            differs = False
            if n >= u.TESTED and n0 > 0:
                pooled, both = (b + b0) / (n + n0), 1 / n + 1 / n0
                differs = abs(b / n - b0 / n0) - both / 2 > u.SIGNIFICANT * (pooled * (1 - pooled) * both) ** 0.5
            own = n >= u.LABELLED or (not re.search(u.ID_LIKE, x) and (urls >= u.ENOUGH or differs))
            children.setdefault(x if own and (n >= u.TESTED or urls >= u.ENOUGH) else "*", []).extend(m)
        for x, m in children.items():
            grow(f"{name}/{x}", m, level + 1)

    hosts = {}
    for i, r in enumerate(rows):
        hosts.setdefault(r[0], []).append(i)
    for host, at in hosts.items():
        grow(host, at, 0)
    return out


def brute_purity(rows, found):
    """template -> purity."""
    u, stats, grown = url_filter, {}, {}
    for (host, _, said), (template, level) in zip(rows, found):
        b, n = stats.get((host, template), (0, 0))
        stats[host, template] = b + (said == "block"), n + (said is not None)
        grown[host, template] = max(level, grown.get((host, template), 0))
    blocked, labelled = (sum(v[k] for v in stats.values()) for k in (0, 1))
    g = blocked / (labelled or 1)

    def nodes(host, template):
        segs = template[len(host) + 1:].split("/")
        return ["/".join(segs[:k]) for k in range(grown[host, template] + 1)] + ["/".join(segs) + "/"]

    here, all_ = {}, {}
    for (host, t), (b, n) in stats.items():
        for x in nodes(host, t):
            for key, table in (((host, x), here), (x, all_)):
                old = table.get(key, (0, 0))
                table[key] = old[0] + b, old[1] + n
    families = {}
    for (host, t), (b, n) in stats.items():
        if n:
            family = host + "|" + re.sub("^/[^/*][^/]*", "/{}", t[len(host):])
            families.setdefault(family, {}).setdefault(int((b + u.PRIOR * g) / (n + u.PRIOR) * u.STEPS), []).append((host, t, b, n))
    merged = {}
    for steps in families.values():
        branch, last = [], None
        for share in sorted(steps):
            b, n = (sum(x[k] for x in steps[share]) for k in (2, 3))
            if last:
                pooled = (b + last[0]) / (n + last[1])
                if abs(b / n - last[0] / last[1]) > u.SIGNIFICANT * (pooled * (1 - pooled) * (1 / n + 1 / last[1])) ** 0.5:
                    branch.append([])
            else:
                branch.append([])
            branch[-1] += steps[share]
            last = b, n
        for members in branch:
            for host, t, _, _ in members:
                merged[host, t] = sum(x[2] for x in members), sum(x[3] for x in members)
    out = {}
    for host, t in stats:
        p, trust = g, 0
        for k, x in enumerate(nodes(host, t)):
            (hb, hn), (eb, en) = here[host, x], all_[x] if x else (blocked, labelled)
            ob, on = eb - hb, en - hn
            weight = min(on, u.TRUST)
            prior = p if trust + weight == 0 else (p * trust + (ob + u.PRIOR * g) / (on + u.PRIOR) * weight) / (trust + weight)
            b, n = merged.get((host, t), (0, 0)) if x.endswith("/") else (hb, hn)
            p, trust = (b + u.PRIOR * prior) / (n + u.PRIOR), min(n, u.TRUST)
        out[host, t] = p
    return out


def test_tree_and_purity_equal_a_walk(spark, table):
    import random
    rnd = random.Random(6)
    words = ["a", "de", "fr", "spam", "news", "tag", "x1", "2024", "p-77", "abcdef12"]
    urls = [r.url for r in table("pages").collect()]
    for host in ("one.com", "www.two.org", "three.net", "four.com", "example.org"):
        for _ in range(300):
            urls.append(f"http://{host}/" + "/".join(rnd.choice(words[: 3 + 2 * k]) if rnd.random() < 0.8 else str(rnd.randrange(500))
                                                     for k in range(rnd.randrange(5))))
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, node string, b string").repartition(3)
    rows = []
    for u in urls:
        host, path, _, verdict = (brute_rule(u, url_filter.RULES) + (None,))[:4] if u else ("", "", None, None)
        rows.append((host, [x for x in path.split("/") if x], verdict))
    found = brute_tree(rows)
    want = brute_purity(rows, found)
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls)
    for i, ((host, _, said), (template, _)) in enumerate(zip(rows, found)):
        assert got[i].template == template, urls[i]
        assert abs(got[i].purity - want[host, template]) < 1e-9, urls[i]
        assert got[i].verdict == (said or ("block" if want[host, template] >= url_filter.REJECT_AT else "allow"))
    assert len({round(got[i].purity, 6) for i in range(len(urls)) if rows[i][2] is None}) > 20


def test_hosts_without_rules_are_judged_by_the_same_path_elsewhere(spark):
    rules = [("block", "com/spam/"), ("allow", "com/news/")]
    urls = [f"http://s{k}.com/{w}/{i}" for k in range(4) for w in ("spam", "news") for i in range(40)]
    urls += [f"http://other.net/{w}/{i}" for w in ("spam", "news") for i in range(40)] + [None, None]
    ids = [*range(len(urls) - 2), None, None]
    got = url_filter.filter_urls(spark.createDataFrame(list(zip(ids, urls)), "page_id long, url string"), rules).collect()
    net = {(r.path.split("/")[1], r.verdict) for r in got if r.host == "other.net"}
    assert net == {("spam", "block"), ("news", "allow")}
    assert len(got) == len(urls) and all(r.purity is not None for r in got)
    none = url_filter.filter_urls(spark.createDataFrame([(1, "http://a/b"), (1, "http://a/b")], "page_id long, url string"), rules).collect()
    assert [(r.page_id, r.verdict, r.purity) for r in none] == [(1, "allow", 0.0)] * 2
