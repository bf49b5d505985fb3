"""Archives and page text."""

import base64
import hashlib

import pytest
import zstandard

from lookbook.llm import html_text, warc_store

PAGES = "page_id long, url string, html string, payload string, digest string, rid string"


def table(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in pages], PAGES)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_warc_round_trip(spark, monkeypatch, bound):
    monkeypatch.setattr("lookbook.llm.common.BROADCAST_ROWS", bound)
    pages = [(i, f"http://x/{i}?é", f"<p>page {i % 5} é😀\r\n\r\n</p>" * (i % 5 + 1)) for i in range(20)]
    pages += [(30, None, None), (29, "u", ""), (31, "u\r\nWARC-Type: x", "alone"), (2, "again", pages[2][2]), (None, "n", "alone"), (None, "m", "no id"), (40, "big", "b" * 3_000_000), *[(50, "v", "copied row")] * 3, *[(None, None, "no id at all")] * 2, (51, "v", "copied row"), (50, "a", "copied row")]
    frame = table(spark, pages)
    archives = warc_store.write_archives(frame)
    rows = warc_store.read_archives(archives).collect()
    assert len(rows) == len(pages) == archives.agg({"records": "sum"}).head()[0]
    stored = {r["payload_digest"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    low = {}
    for i, _, h in pages:
        d = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert stored[d] == (h or "").encode()
        if i is not None:
            low[d] = min(low.get(d, i), i)
    ids = [x.rid for x in warc_store.plan_records(frame).select("rid").collect()]
    assert len(set(ids)) == len(ids)
    got = warc_store.round_trip(frame).collect()
    moved = warc_store.round_trip(frame.repartition(5)).collect()  # dealt anew at each run
    assert sorted(map(repr, got)) == sorted(map(repr, moved))
    assert sum(r["record_type"] == "response" for r in got) == len({r["payload_digest"] for r in got})
    for r in got:
        assert r["payload_bytes"] == len(stored[r["payload_digest"]])
        if r["record_type"] == "response":
            assert r["refers_to"] is None and r["page_id"] == low.get(r["payload_digest"])
        else:
            assert r["refers_to"] == low.get(r["payload_digest"])
    assert warc_store.round_trip(frame.limit(0)).collect() == []


def test_warc_reader_rejects_damage(spark):
    path = warc_store.write_archives(table(spark, [(1, "u", "one"), (2, "u", "two")]).coalesce(1)).head()["path"].removeprefix("file:")
    path = "/" + path.lstrip("/")
    good = open(path, "rb").read()
    assert len(list(warc_store.read_archive(path, chunk=7))) == 2
    size = int.from_bytes(good[4:8], "little")
    words = zstandard.ZstdCompressionDict(good[8 : 8 + size])
    packer = zstandard.ZstdCompressor(dict_data=words)
    record = warc_store.render({"record_type": "response", "url": "u", "rid": 1, "page_id": 1, "digest": hashlib.sha1(b"abc").hexdigest()}, b"abc")
    for bad, why in ((b"x" + good, "dictionary"), (good[:-3], "ends inside"), (good[: 8 + size] + packer.compress(record[:-5]), "Content-Length"), (good[: 8 + size] + packer.compress(record.replace(b"abc", b"abd")), "digest"), (good[: 8 + size] + packer.compress(b"WARC/0.9" + record[8:]), "header")):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError, match=why):
            list(warc_store.read_archive(path))


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train_tree(spark)


def test_main_text(tree):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
    <header><h2>Site</h2></header><div class="cookie-notice">We use cookies, do you agree with that or not?</div><!-- <p>no</p> --><article><header><h1>Head &amp; line</h1></header>
    <p>First <b>bold</b>\n\t text<br>goes on &eacute;&#x1F600; and <a href="y">a link</a> in it.<p>Second one.<div class="ad">Buy this now, please, all of you.</div><blockquote>Quoted words</blockquote>
    <section id="comments"><p>Reader says that this is a very long comment with many words in it, indeed.</p></section><form><label>Name</label></form></article><aside>Side</aside><footer>&copy; Us</footer></body></html>"""
    assert html_text.main_text(page, tree) == "Head & line\nFirst bold text goes on é😀 and a link in it.\nSecond one.\nQuoted words"
    long = "Plain words of a page that has no article tag at all, but goes on for a good while and says something. " * 3
    bare = f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><p>{long}</p><p>{long}</p><div class=footer>Imprint</div>"
    assert html_text.main_text(bare, tree) == "\n".join([long.strip()] * 2)
    for odd in (None, "", "<", "<p", "<script>x", "<!-- x", "<a href='", "</div></p>", "<p " + "a" * 1000):
        assert isinstance(html_text.main_text(odd, tree), str)


def test_extract_text_rows(spark, tree):
    long = "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    frame = table(spark, [(1, "u", "<article><p>é x</p></article>"), (1, None, None), (None, "v", ""), (4, "w", long)])
    rows = html_text.extract_text(frame, tree).collect()
    assert [(r["page_id"], r["n_chars"]) for r in rows] == [(1, 3), (1, 0), (None, 0), (4, 20_000 * 16 - 1)]
    assert html_text.extract_text(frame.limit(0)).collect() == []


def test_words_and_links_decide_besides_flags(tree):
    flags, wrong = {}, [row for row in html_text.LABELLED if html_text.decide(tree, row[:-1]) != row[-1]]
    assert len(wrong) <= 0.01 * len(html_text.LABELLED), wrong  # the tree has six levels
    for row in html_text.LABELLED:
        flags.setdefault(row[6:9], set()).add(row[-1])
    assert all(flags[f, a, 1] == {0, 1} for f in (0, 1) for a in (0, 1)) and flags[0, 0, 0] == flags[1, 0, 0] == {0, 1}
    print("misfits", len(wrong), len(html_text.LABELLED), wrong)
    prose = "Plain words of an article that goes on for a good while and says something new."
    long = " ".join([prose] * 12)
    links = "".join(f"<li><a href=/{i}>Read more of {i}</a></li>" for i in range(4))
    article = f"<article><h1>Head</h1><p>{prose}</p><p>{prose}</p><ul>{links}</ul></article>"
    want = f"Head\n{prose}\n{prose}"
    assert html_text.main_text(f'<div class="site has-sidebar">{article}</div>', tree) == want
    assert html_text.main_text(f'<div class="sidebar">{article}</div>', tree) == want
    assert html_text.main_text(f'<div class="research-notice-board"><main>{article}</main></div>', tree) == want
    assert html_text.main_text(f"<aside>{article}</aside>", tree) == ""
    assert html_text.main_text(f"<main><p>{prose}</p><section id=comments><article><p>{prose}</p></article></section></main>", tree) == prose
    assert html_text.main_text(f"<main><p>{prose}</p><div class=site-footer><p>{prose}</p></div></main>", tree) == prose
    assert long in html_text.main_text(f"<div class=notice><p>{long}</p><p>{long}</p><p>{long}</p></div>", tree)


def test_neighbours_decide(tree):
    def used(node):
        return {node[0]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    names = {html_text.FEATURES[i] for i in used(tree)}
    assert {"words_before", "links_before", "words_after", "links_after"} <= names
    prose, links = "Plain words of a text that goes on for a good while and says something new, over and over. " * 3, "<a href=1>one</a> <a href=2>two</a>"
    for head in ("Two words", "A heading of five words"):
        assert html_text.main_text(f"<h2>{head}</h2><p>{prose}</p>", tree) == f"{head}\n{prose.strip()}"
        assert html_text.main_text(f"<p>{links}</p><h2>{head}</h2><p>{links}</p><p>{prose}</p>", tree) == prose.strip()
    item = "<li><a href=x>Read about it</a></li>"
    assert html_text.main_text(f"<article><p>{prose}</p><div>{item}</div><p>{prose}</p></article>", tree).count("Read about it") == 1
    assert "Read" not in html_text.main_text(f"<article><p>{prose}</p><ul>{item * 3}</ul></article>", tree)


def test_hostile_pages_take_linear_time(tree):
    import time

    n = 2_000_000
    for part in ('<p class="', "<a ", "<", "<!--", "<a '\">", "<a \">\"", "<script>", "<p a='>", "</div", "<![CDATA[", "&amp", "<b>x", 'class="'):
        for page in (part * (n // len(part)), part * (n // len(part)) + "'>", part * (n // len(part)) + '">'):
            began = time.time()
            html_text.main_text(page, tree)
            assert time.time() - began < 5, part
    for page in ("<div>" * 200_000 + "</section></p>" * 70_000, "<div>" * 200_000 + "</div>" * 160_000, "<ul><li>" * 200_000):
        began = time.time()
        html_text.main_text(page, tree)
        assert time.time() - began < 10, page[:20]


def test_blocks_and_features_against_brute_force():
    import random

    rng = random.Random(12)
    words = ["alpha", "beta", "été", "\U0001f600", "gamma,", "3.5", "x"]

    def page(depth):
        """Markup and what it holds: None where a block ends, else (words, whether in a link)."""
        markup, holds = "", []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "text", "link", "bold", "comment", "script"] + ["p", "div", "section", "ul"] * (depth < 4))
            some = [rng.choice(words) for _ in range(rng.randint(1, 6))]
            if kind == "text":
                markup, holds = markup + " " + rng.choice([" ", "\n\t", "&#32;"]).join(some) + " ", [*holds, (some, False)]
            elif kind == "link":
                markup, holds = markup + f"<a href='x>y' title=\"<p>\"> {' '.join(some)} </a>", [*holds, (some, True)]
            elif kind == "bold":
                markup, holds = markup + f"<b> {' '.join(some)} </b>", [*holds, (some, False)]
            elif kind in ("comment", "script"):
                markup += "<!-- <p> no -->" if kind == "comment" else "<SCRIPT>if (a<b) '</p>'</Script >"
            else:
                inner, held = page(depth + 1)
                markup, holds = markup + f"<{kind.upper()} id=k{depth}>{inner}</{kind}>", [*holds, None, *held, None]
        return markup, holds

    for _ in range(300):
        markup, holds = page(0)
        want, own = [], []
        for h in [*holds, None]:
            if h is None:
                if own:
                    want.append((" ".join(w for some, _ in own for w in some), sum(len(s) for s, _ in own), sum(len(s) for s, link in own if link)))
                own = []
            else:
                own.append(h)
        got = html_text.blocks(markup)
        assert [(b.text, b.words, b.link_words) for b in got] == want
        shape = [(n, k / n) for _, n, k in want]
        around = [(0.0, 0.0), *shape, (0.0, 0.0)]
        assert [f[:6] for f in html_text.features(got)] == [(*around[i + 1], *around[i], *around[i + 2]) for i in range(len(shape))]
