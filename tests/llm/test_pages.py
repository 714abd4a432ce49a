import math
import random
from collections import Counter

from collonade.llm import style_tree

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Links</div><article><h1>Big &amp;  <b>bold</b></h1><p>First<br>line &lt;x&gt; caf&eacute;<p>Second <i>one</i>.</p>
<form><input value="q"><button>Go</button></form><section class="comments"><p>Nice!</p></section><p>Third</p></article><footer>&copy; me</footer></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id bigint, url string, html string, text string")


def test_article_only(spark):
    df = pages(spark, (1, "http://a.example/x", PAGE, "clash"), (2, None, None, None), (3, "u", "", ""), (4, "http://a.example/y", "<p>no article &amp; <b>more", ""), (1, "http://a.example/x", PAGE, "clash"))
    got = sorted(style_tree.digests(style_tree.extract(df)).collect())
    assert [r.text for r in got if r.page_id == 1] == ["Big & bold First line <x> café Second one. Third"] * 2
    assert [(r.text, r.n_chars) for r in got if r.page_id in (2, 3)] == [("", 0), ("", 0)]
    assert [r.text for r in got if r.page_id == 4] == ["no article & more"]
    assert style_tree.extract(df.limit(0)).count() == 0


def test_template_branches_of_a_host_go(spark):
    page = "<body><div class=x><span>Same words on each page</span></div><article><h1>Title {0}</h1><div class=y>Read more about us</div><p>Body {0} of its own</p></article></body>"
    df = pages(spark, *[(i, f"http://h.example/{i}", page.format(i), "") for i in range(12)])
    assert texts_of(style_tree.extract(df)) == {i: f"Title {i} Body {i} of its own" for i in range(12)}


def texts_of(df):
    return {r.page_id: r.text for r in df.collect()}


WORDS = "lake river stone cloud winter summer garden window letter music bread paper silver copper forest island bridge".split()


def site(spark, n, host="t.example"):
    """Pages without any telling tag or name: a menu of varying words, an advert, the text, and a closing line."""
    rng, rows, want = random.Random(3), [], {}
    for i in range(n):
        own = [" ".join(rng.choices(WORDS, k=rng.randrange(4, 90))) + f" n{i}x{j}" for j in range(rng.randrange(1, 12))]
        menu = "".join(f"<li><a href=/>{rng.choice(WORDS)} {i}{j}</a></li>" for j in range(5))
        advert, closing = " ".join(rng.choices(WORDS, k=6)) + str(i), " ".join(rng.choices(WORDS, k=7)) + str(i)
        body = "".join(f"<p>{x}</p>" for x in own[1:])
        rows.append((i, f"http://{host}/{i}", f"<body><div class=a><ul>{menu}</ul></div><div class=b>{advert}</div><div class=c><h2>{own[0]}</h2>{body}<div class=d>Tell your friends</div></div><div class=e>All content by us, {closing}</div></body>", ""))
        want[i] = " ".join(own)
    return pages(spark, *rows), want


def test_the_tree_decides_without_tags_or_names(spark):
    df, want = site(spark, 40)
    assert texts_of(style_tree.extract(df)) == want
    every = texts_of(style_tree.extract(df, low=-1.0))
    assert all(every[i] != want[i] and "Tell your friends" in every[i] for i in want)  # with removal off, nothing goes


def test_names_do_not_remove_what_holds_most_of_a_page(spark):
    df = pages(spark, (1, "u", "<body><div class='social legal'><p>The whole text of this page is here.</p></div><div class=legal>small print</div></body>", ""))
    assert texts_of(style_tree.extract(df)) == {1: "The whole text of this page is here."}


def test_importance_against_brute_force(spark):
    texts = ["a", "a", "b", "c c c c c", "c c c c c", "c c c c c", "d", "e"]
    df = pages(spark, *[(i, "http://k.example/", f"<body><p>{t}</p><i>same</i></body>", "") for i, t in enumerate(texts)])
    tree = style_tree.style_tree(df.selectExpr("html", "'k.example' host"), 8).collect()
    p = next(r for r in tree if r.content and r.content > 0)
    shares = [math.log(texts.count(t)) / math.log(len(texts)) for t in texts]
    assert abs(p.content - (1 - sum(shares) / len(shares))) < 1e-9
    lengths = Counter((len(t.split()).bit_length() + 1) // 2 for t in texts)
    entropy = -sum(n / 8 * math.log(n / 8) for n in lengths.values())
    assert abs(p.presentation - entropy) < 1e-9 and p.importance == 1.0
    assert sorted(round(r.importance, 9) for r in tree) == [0.0, 1.0, 1.0]


def test_very_long_and_broken(spark):
    df = pages(spark, (1, "u", "<article>" + "<div><p>x y" * 2000, ""), (2, "u", "<a title='never closed><p>text", ""), (3, "u", "< b <3 &#x41; &bogus;", ""))
    got = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    assert got[1] == " ".join(["x y"] * 2000) and len(got) == 3


def test_scripts_hold_no_tags(spark):
    raw = ["<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT async>if(a<b){x='</p>'}</Script >", "<style>a<b{c:'\"'}</style>", "<title>1<a</title>", "<script>x='</scripts>'<y</script\n>"]
    df = pages(spark, *[(i, "u", f"<body>{r}<article><p>Told {i}</p></article></body>", "") for i, r in enumerate(raw)], (9, "u", "<article><p>Before</p><script>i<n", ""))
    got = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    assert got == {i: f"Told {i}" for i in range(len(raw))} | {9: "Before"}


def test_recurring_parts_of_an_article_stay(spark):
    """Headings, captions and bylines repeat over a host's pages, as adverts and menus do, but stand in the article."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(40):
        one, two, three = (" ".join(rng.choices(WORDS, k=rng.randrange(5, 60))) + f" n{i}x{j}" for j in range(3))
        who = rng.choice(["By Ann Bell", "By Cy Dee", "By Eve Fox"])
        rows.append((i, f"http://r.example/{i}", f"<body><div class=m><h3>Menu</h3><ul><li>Home<li>News</ul></div><div class=k><p class=byline>{who}</p><h2>Summary</h2><p>{one}</p><div class=z>Buy our things</div>"
            f"<figure><img src=x><figcaption>Photo</figcaption></figure><h2><b>Details</b></h2><p>{two}</p><table><tr><th>Year<td>{2000 + i}</table><p>{three}</p></div><div class=f><h4>About</h4>All rights</div></body>", ""))
        want[i] = f"{who} Summary {one} Photo Details {two} Year {2000 + i} {three}"
    assert texts_of(style_tree.extract(pages(spark, *rows))) == want


def test_headings_of_a_flat_page_stay(spark):
    """Right in the body a list and the first heading may be the site's; section headings are the text's."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(40):
        one, two = (" ".join(rng.choices(WORDS, k=rng.randrange(5, 60))) + f" n{i}x{j}" for j in range(2))
        rows.append((i, f"http://f.example/{i}", f"<body><h1>Our site</h1><ul><li>Home<li>News</ul><h2>Summary</h2><p>{one}</p><h2>Details</h2><p>{two}</p><div>Contact us</div></body>", ""))
        want[i] = f"Summary {one} Details {two}"
    assert texts_of(style_tree.extract(pages(spark, *rows))) == want
