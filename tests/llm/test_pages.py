import html
import os
import random
import re

import pytest

from keyflow.llm import pages

SCHEMA = "page_id long, url string, html string, part int, key string"


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        at = pages.shared_lines(a, b)
        mine = [a[i] for i in sorted(at)]
        assert len(mine) == longest(a, b) == longest(mine, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu-open">
<header><p>Site</p></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x <p>no</p> -->
<article><header class="entry-header"><h1>Head &amp; line</h1></header><p>One<br>two&nbsp; <b>th</b>ree<p>Four &lt;5&gt; caf&eacute;
<form><input value="a>b">Send</form><div class="ad">Buy</div><aside>See also</aside><ul><li>i<li>ii</ul><section id="comments"><p>First!</p></section></article>
<footer>&copy; us</footer></body></html>"""


def test_article_without_boilerplate():
    found = [t for z, t in pages.blocks(PAGE) if z == pages.ARTICLE]
    assert found == ["Head & line", "One two three", "Four <5> café", "i", "ii"]


def test_broken_markup():
    assert pages.blocks(None) == pages.blocks("") == []
    assert pages.blocks("a &amp b &am < c") == [(pages.OUTSIDE, "a & b &am < c")]
    assert pages.blocks("<p>one<p>two<div") == [(pages.OUTSIDE, "one"), (pages.OUTSIDE, "two")]
    assert pages.blocks("</p></div>x<script>never closed") == [(pages.OUTSIDE, "x")]


def template(i, body):
    return f"<html><body><div>Daily Site</div><div>Home | About</div><p>{body}</p><p>unique {i}</p><div>Imprint {i % 2}</div><div>Contact</div></body></html>"


def run(spark, rows):
    return {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [(i, f"https://h.org/a/{i:03d}", template(i, f"text {i}"), 0, "k") for i in range(40)]
    rows += [(100, "https://alone.org/", template(100, "text 100"), 0, "k"), (101, None, "<p>x</p>", 0, "k"), (102, "https://h.org/z", None, 0, "k"), (103, "http://[bad", "<p>y</p>", 0, "k")]
    found = run(spark, rows)
    assert len(found) == len(rows)
    for i in range(1, 39):
        assert found[i].text.split("\n\n")[:2] == [f"text {i}", f"unique {i}"], found[i].text
        assert "Daily Site" not in found[i].text and "Contact" not in found[i].text
    assert found[100].text.startswith("Daily Site\n\n") and found[101].text == "x" and found[102].text == "" and found[103].text == "y"
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, f"https://h{i % 3}.org/{rng.randrange(30)}/{rng.randrange(9)}", template(rng.randrange(12), "same"), 0, "k") for i in range(150)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append({k: r.text for k, r in run(spark, rows).items()})
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 150


def test_articles_of_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/pages.parquet")
    found = {r.page_id: r.text for r in pages.extract(table).collect()}
    for r in table.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert found[r.page_id] == "\n\n".join(x for x in parts if x)


PARSED = [
    # (page, its blocks): end tags that may be left out, drawings, quotes, names taken whole
    ("<html><head><title>x</title><body><article><p>hello", [(pages.ARTICLE, "hello")]),
    ("<head><meta charset=utf-8><title>t</title>text", [(pages.OUTSIDE, "text")]),
    ("<p>a<svg class='i'/>b<svg><path/><text>no</text></svg>c", [(pages.OUTSIDE, "ab"), (pages.OUTSIDE, "c")]),
    ("<svg><g><p>out of it</p>", [(pages.OUTSIDE, "out of it")]),
    ("<div class='content has-sidebar'>yes<main class='no-sidebar'>m</main></div>", [(pages.OUTSIDE, "yes"), (pages.ARTICLE, "m")]),
    ("<div class='related-posts x'>no</div><div class=commentList>no</div>", [(pages.BOILERPLATE, "no"), (pages.BOILERPLATE, "no")]),
    ("<a title=\"abc>x</a> y", [(pages.OUTSIDE, "x y")]),
    ("<p class=it's>it's", [(pages.OUTSIDE, "it's")]),
    ("<!-->seen<!-- no --!> yes", [(pages.OUTSIDE, "seen yes")]),
    ("<p class=notice>no<div>yes</div>", [(pages.BOILERPLATE, "no"), (pages.OUTSIDE, "yes")]),
    ("<ul><li class=ad>no<li>yes</ul>", [(pages.BOILERPLATE, "no"), (pages.OUTSIDE, "yes")]),
    ("<table><tr><td class=ad>no<td>yes<tr><td>two</table>", [(pages.BOILERPLATE, "no"), (pages.OUTSIDE, "yes"), (pages.OUTSIDE, "two")]),
    ("<form><article>kept</article>no</form>", [(pages.ARTICLE, "kept"), (pages.FORM, "no")]),
    ("<b><div class=sidebar></b>x</div>y", [(pages.BOILERPLATE, "x"), (pages.OUTSIDE, "y")]),
    ("<noscript><p>no</p></noscript>y<br/>z<hr/>w", [(pages.OUTSIDE, "y z"), (pages.OUTSIDE, "w")]),
    ("<pre><span class=comment># x</span></pre>", [(pages.OUTSIDE, "# x")]),
    ("<body style='display:none'><p>shown", [(pages.OUTSIDE, "shown")]),
    ("<div/>in<script/>var x='<p>'</script>a<math><mi>b</mi></math>", [(pages.OUTSIDE, "inab")]),
]


@pytest.mark.parametrize("page, expected", PARSED)
def test_markup(page, expected):
    assert pages.blocks(page) == expected


def test_very_long_pages_take_bounded_time():
    assert pages.blocks("<div>" * 100_000 + "x") == [(pages.OUTSIDE, "x")]
    assert pages.blocks("<a href='" * 20_000) == []
    assert len(pages.blocks("<p>one line" * 200_000)) == 200_000


def test_long_alignments_are_halved(monkeypatch):
    monkeypatch.setattr(pages, "_ALIGN_BITS", 20)
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        at = pages.shared_lines(a, b)
        mine = [a[i] for i in sorted(at)]
        assert len(mine) == longest(a, b) == longest(mine, b)


def brute(rows):
    """(text, whether differencing changed it) of pages of plain <p> lines, from the definition: the nearest differing page
    by path, on the other side if that is a copy, and the lines that no longest common subsequence has."""
    split = lambda r: re.findall(r"<p>([^<]*)", r[2])
    host = lambda u: u.split("/")[2]
    path = lambda u: "/" + u.split("/", 3)[3]
    given = sorted(rows, key=lambda r: (host(r[1]), path(r[1]), r[1], str(r[0])))
    common = lambda a, b: len(os.path.commonprefix([a, b]))
    out = {}
    for k, r in enumerate(given):
        sides = [next((x for x in some if split(x) != split(r) or host(x[1]) != host(r[1])), None) for some in (given[:k][::-1], given[k + 1 :])]
        near = sorted((-common(path(r[1]), path(x[1])), i, x) for i, x in enumerate(sides) if x and host(x[1]) == host(r[1]))
        lines, text = split(r), None
        for *_, x in near:
            at = pages.shared_lines(lines, split(x))
            if sum(len(lines[i]) for i in at) <= 0.9 * sum(map(len, lines)):
                text = [t for i, t in enumerate(lines) if i not in at]
                break
        out[r[0]] = ("\n\n".join(lines if text is None else text), text is not None and text != lines)
    return out


def bare(seed=4, n=400):
    """Pages without an article or any name of markup: templates of hosts and sections, texts of their own, and copies."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    rows, bodies = [], []
    for i in range(n):
        host, section = f"h{min(rng.randrange(4), rng.randrange(4))}.org", rng.choice("abc")
        bodies.append([words(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))] if not bodies or rng.random() < 0.8 else rng.choice(bodies))
        lines = [f"Site {host}", "Home News About", f"Section {section}", *bodies[-1], f"Imprint {host}", "All rights kept"]
        rows.append((i, f"https://{host}/{section}/{rng.randrange(60):03d}", "<html><body>" + "".join(f"<p>{x}</p>" for x in lines), 0, "k"))
        if rng.random() < 0.2:
            rows += [(n + 10 * i + j, rows[-1][1] + f"?copy={j}", rows[-1][2], 0, "k") for j in range(rng.randint(1, 5))]
    return rows


def test_differencing_decides_on_pages_without_hints(spark):
    rows = bare()
    expected = brute(rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {k: r.text for k, r in run(spark, rows).items()} == {k: t for k, (t, _) in expected.items()}
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    changed = sum(c for _, c in expected.values())
    assert changed > 0.95 * len(rows)  # differencing changes this share of the pages; markup alone none
    template = re.compile(r"Site h|Home News|Imprint h|All rights")
    assert sum(bool(template.search(t)) for t, _ in expected.values()) < 0.05 * len(rows)


def test_copies_keep_their_text(spark):
    page = "<p>Home</p><p>some words of an article that has no markup</p><p>Imprint</p>"
    rows = [(1, "https://h.org/a", page, 0, "k")] * 3 + [(i, f"https://h.org/a?copy={i}", page, 0, "k") for i in range(2, 40)]
    found = pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(found) == len(rows) and {r.text for r in found} == {"Home\n\nsome words of an article that has no markup\n\nImprint"}
    other = (99, "https://h.org/b", "<p>Home</p><p>what another page says at the same length</p><p>Imprint</p>", 0, "k")
    found = pages.extract(spark.createDataFrame([*rows, other], SCHEMA).repartition(4)).collect()
    assert {r.text for r in found} == {"some words of an article that has no markup", "what another page says at the same length"}


def articled(seed=9):
    """(rows, expected texts) of pages with an article that has lines of its host's template, which no name of markup tells,
    and passages copied from other pages. Hosts of fewer than five pages have no such template."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    rows, expected, passages = [], {}, [words(20)]
    for host, n in (("a.org", 70), ("b.org", 40), ("c.org", 5), ("d.org", 4), ("e.org", 1)):
        for i in range(n):
            body = [words(rng.randint(20, 40)) for _ in range(rng.randint(1, 5))]
            passages += body
            if n > 5 and rng.random() < 0.3:
                body.insert(rng.randrange(len(body) + 1), rng.choice(passages[-8:]))
            if rng.random() < 0.5:
                body.append("A line that half of all articles end with")
            title, top, bottom = words(4), f"From the desk of {host}", ["More on our channels", f"Write to {host}"]
            article = [f"<h1>{title}</h1>", f"<p>{top}</p>", "<h2>What happened</h2>", *(f"<p>{x}</p>" for x in body), f"<ul><li>{bottom[0]}<li>{bottom[1]}</ul>"]
            page = f"<nav>{words(3)}</nav><div>{host}</div><article>{''.join(article)}</article><p>Imprint<footer>{words(2)}</footer>"
            bare_text = n >= 5
            text = "\n\n".join([title, *([] if bare_text else [top]), "What happened", *body, *([] if bare_text else bottom)])
            for copy in range(1 + (n > 5 and rng.random() < 0.1)):
                expected[len(rows)] = text
                rows.append((len(rows), f"https://{host}/{i:03d}{'?copy' * copy}", page, 0, "k"))
    return rows, expected


def test_differencing_takes_template_out_of_articles(spark):
    """Pages with an article go through differencing too; copied passages, headings and frequent endings stay."""
    rows, expected = articled()
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {k: r.text for k, r in run(spark, rows).items()} == expected
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_articles_that_are_template_do_not_replace_the_text(spark):
    """Where each page has the same teasers in article elements, its text is what lies outside."""
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(12)]
    teasers = "<article><h3>Latest</h3><p>Read about the weather</p></article><article><h3>Old</h3><p>Read about the past</p></article>"
    rows = [(i, f"https://h.org/{i:02d}", f"<div>Daily Site</div><div><p>{x}</p></div>{teasers}<p>Imprint", 0, "k") for i, x in enumerate(texts)]
    assert {k: r.text for k, r in run(spark, rows).items()} == dict(enumerate(texts))


def test_guests_are_the_nearest_differing_pages():
    rng = random.Random(5)
    for _ in range(400):
        orders, digest = [], ""
        for i in range(rng.randint(1, 40)):
            host = f"h{i // 15}"
            digest = digest if digest[:2] == host and rng.random() < 0.4 else host + rng.choice("abc") * 22
            orders.append(f"{host}\x00{i:03d}\x00{digest}")
        cuts = sorted({0, *(rng.randrange(len(orders)) for _ in range(rng.randint(0, 12)))})
        parts = [orders[a:b] for a, b in zip(cuts, [*cuts[1:], len(orders)], strict=True)]
        expected = {}
        for p, (part, at) in enumerate(zip(parts, cuts, strict=True)):
            for side, mine in ((orders[:at][::-1], part[0]), (orders[at + len(part) :], part[-1])):
                nearest, seen = [], mine[-24:]
                for x in side:
                    if x[-24:] != seen:
                        nearest.append(x)
                        seen = x[-24:]
                for x in nearest[: pages.REACH]:
                    if x[:2] == mine[:2]:
                        expected.setdefault(x, set()).add(p)
        found = pages._guests([pages._edges(iter(x)) for x in parts])
        assert {k: set(v) for k, v in found.items()} == expected


def test_pages_that_differ_in_headings_are_no_copies():
    a, b = (pages.page_lines(f"<article><{tag}>a</{tag}><p>b</article>") for tag in ("h2", "p"))
    assert [x[:2] for x in a] == [x[:2] for x in b] and pages._digest("http://h.org/", a) != pages._digest("http://h.org/", b)


def test_empty_table(spark):
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0
