import random
import textwrap
from collections import Counter, defaultdict
from math import log, sqrt

import pytest
import regex

from graphloom.llm import license_scan
from graphloom.llm.common import table
from graphloom.llm.html_main import extract, main_text
from graphloom.llm.license_scan import TEMPLATES, scan_licences

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<nav><ul><li>Menu</li></ul></nav><header>Head</header><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One  two<br>three<p>Four &lt;x&gt; <b>bold</b>
<ul><li>i<li>ii</ul><form>Name</form><aside>Side</aside></article><section id="comments"><p>Reader</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE, set()).split("\n\n") == ["A & B", "One two three", "Four <x> bold", "i", "ii"]
    assert main_text(None, set()) == main_text("", set()) == ""
    assert main_text("plain <b>text", set()) == "plain text"
    assert main_text("<p>unclosed <i>x<!-- never closed", set()) == "unclosed x"
    assert main_text("<div>" * 300 + "deep", set()) == "deep"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 10_000 + "deep", "deep"),
        ("<font>" * 12_000 + "x</i></b>", "x"),
        ('<article class="post with-sidebar"><p>text</p></article>', "text"),
        ('<article class="post comment-open"><p>text</p></article>', "text"),
        ('<div class="content no-ads"><p>text</p></div>', "text"),
        ('<article><p class="share-price">5</p><h2 id="related-work">R</h2><math>m</math><label>l</label></article>', "5\n\nR\n\nml"),
        ('<article><p>a</p><div class="comment-list"><p>c</p></div><div class="sidebar">s</div><div id="site-footer">f</div></article>', "a"),
        ('<article><p>main</p></article><article class="comment"><p>reader</p></article>', "main"),
        ('<p>a<a href="x>b</p><p>c', "ab\n\nc"),
        ("1 < 2 &amp;lt; 3", "1 < 2 &lt; 3"),
    ],
)
def test_odd_pages_give_their_text(page, text):
    assert main_text(page, set()) == text


def test_templates_equal_counting(spark):
    """Hosts with boxes on more and fewer pages: what goes is what recurs on enough different pages."""
    rng = random.Random(3)
    sizes, boxes = {"a.org": 60, "b.org": 12, "c.org": 400}, [f"<div><p>Box number {i} of the site</p></div>" for i in range(12)]
    pages, holds = [], defaultdict(set)
    for host, size in sizes.items():
        for i in range(size):
            own = [b for b in range(12) if rng.random() < (b + 1) / 40]
            body = f"<div><p>Own words of page {i} of {host}, {rng.random()} of them and more of these</p></div>" + "".join(boxes[b] for b in own)
            pages.append((len(pages), f"https://{host}/{i}", f"<body>{body}</body>", own))
            for b in own:
                holds[host, b].add(body)
    copies = [(len(pages) + i, "https://b.org/copy", "<body>" + boxes[0] + "<div><p>The same page over and over, with its own words</p></div></body>", [0]) for i in range(30)]
    for b in (0,):
        holds["b.org", b].add(copies[0][2])
    different = {h: n + (h == "b.org") for h, n in sizes.items()}
    gone = {k for k, on in holds.items() if len(on) >= 8 and len(on) >= 0.05 * different[k[0]]}
    assert 5 < len(gone) < 30
    rows = {r.page_id: r.text for r in extract(spark.createDataFrame([p[:3] for p in pages + copies], "page_id long, url string, html string")).collect()}
    for i, url, _, own in pages + copies:
        host = url.split("/")[2]
        assert [f"Box number {b} of the site" in rows[i] for b in own] == [(host, b) not in gone for b in own]
        assert "wn words" in rows[i]


def test_templates_of_a_site_go(spark):
    box = "<div><p>Read our house rules before you write</p></div>"
    pages = [(i, f"http://a.org/{i}", f"<body><div><p>Own text number {i}</p></div>{box}</body>") for i in range(12)]
    pages += [(100, "http://b.org/1", f"<body>{box}</body>"), (101, None, None), (102, "no url", ""), (103, "http://a.org/1", pages[1][2])]
    rows = {r.page_id: r for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as text", "array(1L) as templates", "2 as _host").drop("_host")).collect()}
    assert all(rows[i].text == f"Own text number {i}" for i in range(12))
    assert rows[100].text == "Read our house rules before you write"
    assert rows[101].text == rows[102].text == "" and rows[101].n_chars == 0
    assert rows[103].text == rows[1].text and rows[1].n_chars == len(rows[1].text)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_page_has_a_row(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = extract(pages).collect()
    assert len(rows) == pages.count() and sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)
    assert not any("<p>" in r.text for r in rows)


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/code.py", "print(1)\nprint(2)"), (3, "a/b/own.py", "# SPDX-License-Identifier: Apache-2.0\nprint(1)"), (4, "c/code.py", "print(1)"), (5, None, None), (6, "a/b/code.py", "print(1)\nprint(2)"),
        (7, "a/b/NOTICE", "Licensed under the Apache License, Version 2.0"), (8, "a/d/e/f.py", ""), (9, "top.py", "x " * 5000),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "'x' as licence", "1 as depth")
    rows = {r.doc_id: r for r in scan_licences(df).collect()}
    assert len(rows) == len(files)
    assert rows[1].own_licence == "MIT" and rows[3].own_licence == "Apache-2.0" and rows[3].inherited_from is None
    assert (rows[2].licence, rows[2].inherited_from) == ("Apache-2.0", "a/b") == (rows[6].licence, rows[6].inherited_from)
    assert (rows[8].licence, rows[8].inherited_from) == ("MIT", "a")
    assert rows[4].licence is None and rows[5].licence is None and rows[9].licence is None
    assert scan_licences(df.limit(0)).count() == 0
    more = [
        (1, "c/LICENSE", "\n".join(textwrap.wrap(license_scan._BSD_GRANT, 60))), (2, "c/x.py", "print(1)"), (None, "d/a", "Released under the MIT License"), (5, "e/a", "Released under the MIT License"), (5, "e/b", "nothing here"),
        (6, "m/x", " ".join(license_scan._MIT_GRANT.split()[1:])), (7, "f/x.c", "\n".join(textwrap.wrap(license_scan._APACHE_NAMED, 50, initial_indent=" * ", subsequent_indent=" * ")) + "\n\nint main() { return 0; }"),
        (8, "g/LICENSE", "\n\n".join(textwrap.wrap(TEMPLATES[0][1], 70))), (9, "g/y", "a b c"), (None, None, None),
    ]
    rows = {(r.doc_id, r.path): (r.own_licence, r.licence, r.inherited_from) for r in scan_licences(spark.createDataFrame(more, "doc_id long, path string, text string")).collect()}
    assert len(rows) == len(more)
    assert rows[1, "c/LICENSE"][0] == "BSD-3-Clause" and rows[2, "c/x.py"] == (None, "BSD-3-Clause", "c")
    assert rows[None, "d/a"][0] == rows[5, "e/a"][0] == rows[6, "m/x"][0] == rows[8, "g/LICENSE"][0] == "MIT" and rows[5, "e/b"][0] is None
    assert rows[7, "f/x.c"][0] == "Apache-2.0" and rows[9, "g/y"] == (None, "MIT", "g")


def test_cosines_equal_brute_force(spark, words):
    rng = random.Random(4)
    cut = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\.", t.lower()) if w]
    files = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choices(words, k=rng.randint(1, 40))
            if rng.random() < 0.5:
                taken = rng.choice(TEMPLATES)[1].split()
                own = [w for w in taken if rng.random() > 0.15] + own[: rng.randint(0, 8)]
            parts.append("\n".join(textwrap.wrap(" ".join(own), 60)))
        files.append((i, f"d/{i}", "\n\n".join(parts)))
    df = Counter(w for _, _, t in files for w in set(cut(t)))
    idf = lambda w: log((1 + len(files)) / (1 + df[w])) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(cut(t)).items()}
    length = lambda v: sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(t)) for name, t in TEMPLATES]
    want = {}
    for i, _, t in files:
        units = [t, *regex.split(license_scan.WORDLESS, t), *(x for x in t.split("\n") if x)]
        scored = [(sum(x * v.get(w, 0) for w, x in u.items()) / length(u) / length(v), name) for u in map(vector, units) if u for name, v in known]
        want[i] = round(max(scored)[0], 6) if max(scored)[0] >= 0.72 else None
    found = {r.doc_id: r.own_cosine for r in scan_licences(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert found.keys() == want.keys() and 15 < sum(x is not None for x in want.values()) < 60
    for i, x in want.items():
        assert found[i] == pytest.approx(x, abs=2e-6), i


@pytest.mark.parametrize(("name", "share"), [("GPL-3.0", 1.0), ("Apache-2.0", 1.0), ("LGPL-3.0", 1.0), ("MPL-2.0", 1.0), ("CC0-1.0", 1.0), ("GPL-2.0", 0.6), ("Apache-2.0", 0.7)])
def test_whole_licence_texts_are_known_and_inherited(spark, name, share):
    """A licence file with the text alone, cut before its how-to-apply notes where it is not whole."""
    text = dict(t for t in license_scan.TEMPLATES if len(t[1]) > 4000)[name]
    rows = [(1, text[: int(share * len(text))], "a/LICENSE"), (2, "def f():\n    return 1", "a/b/c.py"), (3, "other words", "z/d.py"), (4, "the of and to in a is that for it " * 200, "z/e.txt")]
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got[1] == (name, name, None) and got[2] == (None, name, "a") and got[3] == got[4] == (None, None, None)


def test_inheritance_equals_walking_up(spark):
    """The nearest directory above with a licence file, against a walk in plain Python."""
    rng = random.Random(12)
    texts = {"MIT": "This project is licensed under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", None: "nothing of the kind here"}
    paths = {"/".join(rng.choices("abc", k=rng.randint(0, 4)) + [rng.choice(["LICENSE", "COPYING.txt", "x.py", "y.md"])]) for _ in range(150)}
    rows = [(i, texts[(kind := rng.choice([None, None, "MIT", "Apache-2.0"]) if "x.py" not in p else None)], p, kind) for i, p in enumerate(sorted(paths))]
    own = {p: kind for _, _, p, kind in rows}
    told = {}
    for p in sorted(own):
        directory = p.rpartition("/")[0]
        if own[p] and directory not in told:  # of equal cosines, the first path counts
            told[directory] = own[p]
    got = {r.path: (r.licence, r.inherited_from) for r in scan_licences(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, path string")).collect()}
    for p in own:
        if own[p]:
            assert got[p] == (own[p], None)
            continue
        above = p.rpartition("/")[0]
        while above not in told and above:
            above = above.rpartition("/")[0]
        assert got[p] == ((told[above], above) if above in told else (None, None)), p
