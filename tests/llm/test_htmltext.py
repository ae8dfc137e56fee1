"""Main text of pages, and what hosts repeat."""

from __future__ import annotations

import html
import re

import pyarrow.parquet as pq

from grainwise.llm import htmltext as ht
from tests.llm.conftest import FOLDER


def text(page):
    return [b for b, s in ht.blocks(page) if s == ht.CLEAR]


def test_whole_table(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in ht.query(spark, FOLDER).collect()}
    assert set(got) == {p["page_id"] for p in pages}
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[p["page_id"]].text == want and got[p["page_id"]].n_chars == len(want) and got[p["page_id"]].url == p["url"]


def test_structure():
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header>site</header><nav><ul><li>menu</ul></nav>"
        "<main><article><header><h1>Head &amp; line</h1><span>by line</span></header><p>One\n  two&nbsp;<b>bo</b>ld<br>end<p>Second"
        "<aside>side</aside><div class='ad-box'><p>buy</p></div><ul><li>item</ul><form><p>sign</p></form><table><tr><td>cell</table>"
        "<div class='cookie-notice'>note</div><section id=comments><p>said</p></section></article></main><footer>foot</footer>"
    )
    assert text(page) == ["Head & line", "One two bold end", "Second", "item", "cell"]


def test_broken_markup():
    assert text("<article><p>a <b>c</article>") == ["a c"]
    assert text("<article><p title='x>y'>a</p><p>1 < 2 & 3</p></b></article>") == ["a", "1 < 2 & 3"]
    assert ht.blocks("") == [] and ht.blocks("<script>never closed") == [] and ht.blocks("<!-- open") == []
    assert text("<article><p>&#233;&eacute;&#x2014;&amp;lt;</p></article>") == ["éé—&lt;"]
    assert text("<ARTICLE><P>UP</P></ARTICLE>") == ["UP"]
    assert text("<article>" + "<p>x</p>" * 20_000 + "</article>") == ["x"] * 20_000


def test_hosts_decide_open_text(spark):
    page = (
        "<body><div>Subscribe now</div><div>{}</div><div>All rights of this shop and of all that it ever sold to anyone are reserved"
        " by its owner</div></body>"
    )
    rows = [(i, "http://a.example/x", page.format(f"Story number {i} tells of things unlike {i * 7} others"), "e") for i in range(6)]
    rows += [(100, "http://b.example/x", page.format("Another story on its own host"), "e"), (101, None, None, "e"), (102, "odd", "", "e")]
    rows += [(5, "http://a.example/x", rows[5][2], "e")]
    got = ht.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all("Subscribe" not in by[i] and "reserved" not in by[i] and f"{i * 7} others" in by[i] for i in range(6))
    assert by[100] == (
        "Subscribe now\nAnother story on its own host\nAll rights of this shop and of all that it ever sold to anyone are reserved by its owner"
    )
    assert (by[101], by[102]) == ("", "")


def test_one_page_repeated_is_not_evidence(spark):
    row = (1, "http://a.example/x", "<body><div>Some open text of one page</div></body>")
    got = ht.extract(spark.createDataFrame([row, row], "page_id bigint, url string, html string")).collect()
    assert [r.text for r in got] == ["Some open text of one page"] * 2
    assert ht.extract(spark.createDataFrame([row], "page_id bigint, url string, html string").limit(0)).collect() == []


def test_suffix_names_equal_brute_force():
    tokens = list("abcabdabcabe")
    names = ht.suffix_names(tokens, 3)
    for i in range(len(names)):
        for j in range(len(names)):
            assert (names[i] == names[j]) == (tokens[i : i + 3] == tokens[j : j + 3])
    assert len(ht.suffix_names(["a", "b"], 4)) == 0


def test_unique_runs_survive():
    page = [("kept clear", ht.CLEAR), ("a b c d unique e f", ht.OPEN), ("menu", ht.DROPPED)]
    assert ht.unique_text(page, [(0, 4)]) == "kept clear\nunique e f"
    assert ht.unique_text(page, []) == "kept clear\na b c d unique e f"


def brute_open_text(pages):
    """page_id -> text by plain sets: open words in a repeated window of twelve tokens, or in a short repeated block, go."""
    read = [(i, ht.host_of(u), ht.blocks(h or "")) for i, u, h in pages]
    bodies, outside = {}, {}
    for _, host, found in read:
        body = "\n".join(t for t, s in found if s != ht.DROPPED)
        for t, state in found:
            words = [*t.split(), "\n"]  # a block's end is a token
            keys = [tuple(words[k : k + 12]) for k in range(len(words) - 11)] or [(None, *words)] * (state != ht.CLEAR)
            for key in keys:
                bodies.setdefault((host, key), set()).add(body)
                if state != ht.CLEAR:
                    outside.setdefault((host, key), set()).add(body)
    out = {}
    for i, host, found in read:
        holds = bodies if any(s == ht.CLEAR for _, s in found) else outside
        parts = []
        for t, state in found:
            words = [*t.split(), "\n"]
            gone = [False] * len(words)
            for k in range(max(1, len(words) - 11)):
                key = tuple(words[k : k + 12]) if len(words) >= 12 else (None, *words)
                if state == ht.OPEN and len(holds.get((host, key), ())) > 1:
                    gone[k : k + 12] = [True] * len(words[k : k + 12])
            left = " ".join(w for w, g in zip(words[:-1], gone) if not g)
            if state != ht.DROPPED and left:
                parts.append(left)
        out[i] = "\n".join(parts)
    return out


def test_prose_is_in_the_stream_and_copies_are_one_body(spark):
    import random

    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choices("abcdefghijklmnopqrst", k=n))
    prose = [say(40) for _ in range(5)]
    article = "<body><div>{}</div><article><p>{}</p><p>{}</p></article></body>"
    rows = [(k, "http://a.example/x", article.format(f"{say(3)} {prose[k - 1]}", prose[k], "common " * 15)) for k in range(5)]
    alone = say(40)  # on one page as prose, on another, without an article, as all it has
    rows += [(9, "http://a.example/x", f"<article><p>{alone}</p></article>"), (10, "http://a.example/p", f"<body><div>{alone}</div></body>")]
    rows += [(20, "http://b.example/x", f"<body><div>{say(30)}</div></body>")]
    rows += [(21, "http://b.example/y?copy", rows[-1][2])]  # the same page under two addresses
    rows += [(30 + k, None, f"<body><div>Menu</div><div>{say(14)} one line that all of the pages of this host hold at the end</div></body>") for k in range(3)]
    rows += [(40, "http://c.example/", f"<article><p>{prose[0]}</p></article>"), (41, "http://c.example/2", f"<article><p>{prose[0]}</p><p>x</p></article>")]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == brute_open_text(rows)
    for k in range(5):
        assert prose[k - 1] not in got[k] and got[k].endswith(f"{prose[k]}\n" + " ".join(["common"] * 15))
    assert got[9] == got[10] == alone and got[20] == got[21] != ""
    assert all("Menu" not in got[30 + k] and "one line" not in got[30 + k] and got[30 + k] for k in range(3))
    assert got[40] == prose[0] and got[41] == prose[0] + "\nx"


def test_host_of_a_column(spark):
    urls = ["http://A.b/c", "https://u@h.x:80/", "odd", None, "//x/y", "  ftp://q.r?x", "", "see http://no.host/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.h for r in df.select(ht.host(df.url).alias("h")).collect()] == [ht.host_of(u) for u in urls]


def test_hosts():
    assert [ht.host_of(u) for u in ("http://A.b/c", "https://u@h.x:80/", "odd", None, "//x/y")] == ["a.b", "h.x", "", "", ""]


def brute_repeated(pages):
    """page_id -> how many places of its blocks (words, and an end each) its host repeats, by plain sets."""
    read = [(i, ht.host_of(u), ht.blocks(h or "")) for i, u, h in pages]
    found = {}

    def keys(t, state):
        words = [*t.split(), "\n"]
        if len(words) < 12:
            return [(0, (None, *words))] if state != ht.CLEAR else []
        return [(k, tuple(words[k : k + 12])) for k in range(len(words) - 11)]

    for _, host, blocks in read:
        body = "\n".join(t for t, s in blocks if s != ht.DROPPED)
        for t, state in blocks:
            for _, key in keys(t, state):
                found.setdefault((host, key), []).append((body, state == ht.CLEAR))
    out = {}
    for i, host, blocks in read:
        own = any(s == ht.CLEAR for _, s in blocks)
        n = 0
        for t, state in blocks:
            gone = set()
            for at, key in keys(t, state):
                if len({body for body, prose in found[host, key] if own or not prose}) > 1:
                    gone |= set(range(at, at + len(key) - (key[0] is None)))
            n += len(gone)
        out[i] = n
    return out


def test_hosts_without_open_text_are_searched_too(spark):
    shared = "Every page of this shop carries the very same long sentence about its owner and its terms"
    page = "<body><nav><ul><li>Home</li></ul></nav><article><p>Page {} says {} things</p><p>{}</p></article><footer>foot {}</footer></body>"
    rows = [(i, "http://a.example/x", page.format(i, i * 7, shared, i)) for i in range(4)]
    rows += [(9, "http://b.example/x", page.format(9, 63, shared, 9)), (10, "http://b.example/y", page.format(9, 63, shared, 9))]
    got = {r.page_id: r for r in ht.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    words = len(shared.split()) + 1
    assert {i: r.n_repeated for i, r in got.items()} == {0: words + 2, 1: words + 2, 2: words + 2, 3: words + 2, 9: 0, 10: 0}  # and Home
    assert all(r.text == f"Page {min(i, 9)} says {min(i, 9) * 7} things\n{shared}" for i, r in got.items())


def test_repeats_of_all_pages_equal_brute_force(spark):
    import random

    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choices("abcdefgh", k=n))
    lines = [say(n) for n in (1, 2, 10, 11, 12, 13, 30, 200)]
    rows = []
    for i in range(120):
        parts = [rnd.choice([rnd.choice(lines), say(rnd.randint(1, 40)), "same here"]) for _ in range(rnd.randint(0, 6))]
        kinds = [rnd.choice(["<article><p>{}</p></article>", "<article><p>{}</p></article>", "<div>{}</div>", "<nav>{}</nav>"]) for _ in parts]
        html = "<body>" + "".join(k.format(p) for k, p in zip(kinds, parts)) + "</body>"
        rows.append((i, rnd.choice(["http://a.example/1", "http://a.example/2", "http://b.example/", None]), rnd.choice([html, html, html, None])))
    rows += [(1000 + i, u, h) for i, (_, u, h) in enumerate(rows[::3])]  # whole pages again, some on their own host
    rows += [(2000, "http://a.example/3", "<body>" + "<div>x</div>" * 3000 + f"<p>{say(5000)}</p></body>")]
    want, text = brute_repeated(rows), brute_open_text(rows)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 7):
        got = {r.page_id: (r.text, r.n_repeated) for r in ht.extract(pages.repartition(parts, "page_id")).collect()}
        assert got == {i: (text[i], want[i]) for i in want}


def test_names_of_tokens():
    import numpy as np

    texts = ["a b a", "b", "ü " * 3 + "a", "word " * 300_000 + "a"]
    names, ends = ht.token_names(texts)
    tokens = [w for t in texts for w in (*t.split(), "\n")]
    assert len(names) == len(tokens) and len(set(zip(tokens, names.tolist()))) == len(set(tokens)) == len(set(names.tolist()))
    assert ends.tolist() == [4, 6, 11, len(tokens)]
    for values in ([], [0], [255, 256], [1 << 63, 5]):
        assert ht.unpacked(ht.packed(np.array(values, np.uint64))).tolist() == values
