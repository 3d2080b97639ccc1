"""Site template removal: attributes and quotes as HTML reads them, and counts against a plain version."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import templates

PAGES = "page_id long, url string, html string"


def texts_of(spark, rows, **bounds):
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], PAGES)
    return [r["text"] for r in sorted(templates.extract(pages, **bounds).collect())]


def alone(spark, sources):
    return texts_of(spark, [(f"http://h{i}.org/", x) for i, x in enumerate(sources)])


def test_only_the_attribute_hides(spark):
    shown = [
        '<div style="overflow:hidden">Shown</div>', "<body style='overflow-x: hidden'><p>Shown</p></body>", "<p title='a hidden gem'>Shown</p>",
        "<p hidden-note=1>Shown</p>", "<p data-x=hidden>Shown</p>", "<p aria-hidden=false>Shown</p>",
    ]
    gone = ["<p hidden>Gone</p>Shown", "<p HIDDEN=''>Gone</p>Shown", "<div class=x hidden data-y='1'>Gone</div>Shown", "<p aria-hidden='true'>Gone</p>Shown"]
    assert alone(spark, shown + gone) == ["Shown"] * 10


def test_quotes_open_values_only(spark):
    assert alone(spark, [
        "<p>See <a title=it's>Hello world</a> today.</p><p>Second line.</p><p>It's late.</p>",
        "<p><a title=\"a > b\" href='x>y'>Text</a> goes on</p>", "<p 'odd\" >One</p><p>Two</p>", "<p title = \"it's\">One</p><p>Two</p>",
    ]) == ["See Hello world today.\nSecond line.\nIt's late.", "Text goes on", "One\nTwo", "One\nTwo"]


def test_words_are_hints(spark):
    """A telling word on a single page deletes nothing, and parts of a class are no words."""
    sources = [
        "<div class='social-history'>Kept</div>", "<section id='menu-planning'>Kept</section>", "<p id='share'>Kept</p>", "<p class='reply'>Kept</p>",
        "<div class='header-image story'>Kept</div>", "<article><header><h1>Kept</h1></header></article>",
    ]
    assert alone(spark, sources) == ["Kept"] * 6


def test_shells_are_counted(spark):
    """Adverts and comments differ from page to page; their shells recur, on the host or over many hosts."""
    body = "<body><div class='ad top'>Buy {0}</div><article><p>Story {0}</p><div class='comments'><p>Me {0}</p></div></article></body>"
    one_host = [("http://a.b/", body.format(i)) for i in range(6)]
    hosts = [(f"http://h{i}.b/", body.format(i)) for i in range(6)]
    rare = [("http://a.b/", f"<div id='share'>Price of share {i}</div><p>Story {i}</p>" if i == 3 else f"<p>Story {i}</p>") for i in range(40)]
    assert texts_of(spark, one_host) == texts_of(spark, hosts) == [f"Story {i}" for i in range(6)]
    assert texts_of(spark, rare)[3] == "Price of share 3\nStory 3"


def test_repeats_and_clashing_columns(spark):
    row = (1, "http://a.b/", "<p>Text</p>")
    pages = spark.createDataFrame([row, row, (None, None, None)], PAGES)
    pages = pages.withColumns({"host": F.lit(1), "key": F.lit("x"), "template": F.lit(2), "kind": F.lit(3), "tree": F.lit(4), "text": F.lit("z")})
    got = [tuple(r) for r in templates.extract(pages).select("page_id", "text").collect()]
    assert sorted(got, key=str) == [(1, "Text"), (1, "Text"), (None, "")]


def test_very_long_page(spark):
    many = "".join(f"<p>Line {i} &amp; more</p>" for i in range(30_000))
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert alone(spark, [many, deep]) == ["\n".join(f"Line {i} & more" for i in range(30_000)), "deep"]


def random_tree(draw, depth=0):
    kids = []
    for _ in range(draw.randrange(1, 4)):
        kind = draw.random()
        if depth < 3 and kind < 0.35:
            kids.append(("div", "", random_tree(draw, depth + 1)))
        elif kind < 0.75:
            kids.append(("p", "", [f"w{draw.randrange(60)} "]))
        elif kind < 0.9:
            kids.append(("p", "", [f"u{draw.randrange(10 ** 6)}"]))
        else:
            kids.append(("div", "widget", [f"ad{draw.randrange(10 ** 6)}"]))
    return kids


def html_of(tree):
    tag, words, kids = tree
    inner = "".join(x if isinstance(x, str) else html_of(x) for x in kids)
    return f"<{tag} class='{words}'>{inner}</{tag}>" if words else f"<{tag}>{inner}</{tag}>"


def plain_texts(pages, total):
    """The same rules over the trees themselves, counted with dictionaries."""
    count, shells, size = collections.Counter(), collections.Counter(), collections.Counter()
    for host, different in pages.items():
        for tree in {html_of(t): t for t in different}.values():
            size[host] += 1
            seen, todo = set(), [tree]
            while todo:
                node = todo.pop()
                seen.add((host, html_of(node)))
                if node[1]:
                    seen.add((host, "shell", node[:2]))
                todo += [x for x in node[2] if not isinstance(x, str)]
            count.update(x for x in seen if len(x) == 2)
            shells.update(x for x in seen if len(x) == 3)
    over_all = collections.Counter()
    for (_, _, shell), n in shells.items():
        over_all[shell] += n

    def lines(host, node):
        tag, words, kids = node
        if words:
            n, everywhere = shells[host, "shell", node[:2]], over_all[node[:2]]
            if (size[host] >= 4 and n >= 2 and n >= 0.05 * size[host]) or (everywhere >= 4 and everywhere >= 0.05 * total):
                return []
        if tag != "body" and size[host] >= 4 and count[host, html_of(node)] >= max(4, 0.3 * size[host]):
            return []
        found = []
        for kid in kids:
            found += [kid.strip()] if isinstance(kid, str) else lines(host, kid)
        return found

    return {(host, i): "\n".join(lines(host, t)) for host, different in pages.items() for i, t in enumerate(different)}


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_against_plain(spark, seed):
    """Random hosts that share blocks with themselves: what is deleted is what the counts say."""
    draw = random.Random(seed)
    pages = {}
    for h in range(12):
        shared = [("div", "", random_tree(draw, 2)) for _ in range(3)]
        pages[f"h{h}"] = [
            ("body", "", random_tree(draw) + [x for x in shared if draw.random() < 0.5] + random_tree(draw, 1)) for _ in range(draw.randrange(1, 14))
        ]
    total = sum(len({html_of(t) for t in different}) for different in pages.values())
    want = plain_texts(pages, total)
    keys = list(want)
    got = texts_of(spark, [(f"http://{h}/", html_of(pages[h][i])) for h, i in keys])
    assert got == [want[k] for k in keys]
    untouched = ["\n".join(templates.clean(x) for x, _ in templates._blocks(r, templates.subtree_hashes(r)[0], set(), set(), set()))
                 for r in (templates.parse(html_of(pages[h][i])) for h, i in keys)]
    assert sum(a != b for a, b in zip(got, untouched, strict=True)) > 10
