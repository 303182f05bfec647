"""Sharding, chat rendering, URL verdicts and main text."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from spectraloom.llm import chat_format, html_extraction, queries, sharding, url_filters
from tests.llm import edges


@pytest.mark.parametrize("ranges", [1, 7])
def test_shards(spark, ranges):
    rows = edges.rows()
    docs = edges.docs(spark, rows)
    sized = docs.selectExpr("doc_id", "octet_length(coalesce(text, '')) + 16L AS size")
    got = sharding.assign_shards(sized, "doc_id", "size", 4, ranges).collect()
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    total, before = sum(r.size for r in got), 0
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    for r in order:
        assert r.shard == min(3, (2 * before + r.size) * 4 // (2 * total))
        before += r.size
    for s in range(4):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def test_shard_documents(spark):
    rows = edges.rows()
    got = sharding.shard_documents(edges.docs(spark, rows), shards=40).collect()
    want = sorted(((r[0] is None, r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sorted(((False, r.doc_id), r.size, r.text_crc32) for r in got if r.doc_id is not None) == want
    assert sharding.shard_documents(edges.empty(spark)).collect() == []


TURNS = [
    (1, 0, "ann", "Hi"), (1, 1, "bob", "Hello é"), (1, 2, "ann", "Bye"), (1, 2, "ann", "Bye"), (2, 0, None, None), (2, None, "eve", "first"), (None, 3, "eve", ""),
    *[(3, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(10)],
]


def test_perspectives(spark):
    turns = spark.createDataFrame([t + ("x",) for t in TURNS], "conv_id long, turn long, role string, text string, said string")
    got = chat_format.perspectives(turns, turns_per_piece=4).collect()
    by = {(r.conv_id, r.speaker, r.piece): r for r in got}
    ann = by[1, "ann", 0]
    assert ann.text == (
        "<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nHello é<|im_end|>\n" + 2 * "<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert [ann.text[s.start : s.end] for s in ann.mask] == ["Hi<|im_end|>\n", "Bye<|im_end|>\n", "Bye<|im_end|>\n"]
    assert ann.n_masked == sum(s.end - s.start for s in ann.mask) and ann.n_turns == 4
    assert [by[1, "bob", 0].text[s.start : s.end] for s in by[1, "bob", 0].mask] == ["Hello é<|im_end|>\n"]
    assert {k[1:] for k in by if k[0] == 2} == {("unknown", 0), ("eve", 0)}
    assert by[2, "eve", 0].text.startswith("<|im_start|>assistant\nfirst<|im_end|>\n") and by[None, "eve", 0].n_turns == 1
    assert [by[3, "ann", p].n_turns for p in range(3)] == [4, 4, 2]
    assert "t9" in by[3, "bob", 2].text and by[3, "bob", 2].n_masked == len("t8<|im_end|>\n")
    assert chat_format.perspectives(turns.limit(0)).collect() == []


def plain_views(turns, per_piece):
    """The same views, conversation after conversation, in plain Python."""
    clean, out = {}, {}
    escape = lambda x: re.sub(r"<\|(_*)im_", r"<|_\1im_", x)
    for conv, turn, role, text in turns:
        clean.setdefault(conv, []).append((turn is not None, turn or 0, "unknown" if role is None else role, escape(text or "")))
    for conv, rows in clean.items():
        rows.sort()
        for speaker in {r[2] for r in rows}:
            for at in range(0, len(rows), per_piece):
                text, mask = "", []
                for _, _, role, said in rows[at : at + per_piece]:
                    text += "<|im_start|>" + ("assistant" if role == speaker else "user name=" + escape(role).replace("\n", " ")) + "\n"
                    if role == speaker:
                        mask.append((len(text), len(text) + len(said) + len("<|im_end|>\n")))
                    text += said + "<|im_end|>\n"
                out[conv, speaker, at // per_piece] = text, mask
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_perspectives_in_bounded_pieces(spark, ranges):
    """Null conversations, null and repeated turns and long texts are cut by rows, also where ranges cut through them."""
    turns = [(None, None, f"s{i % 3}", f"t{i % 50}") for i in range(400)] + [(5, 7, "ann", "same")] * 150 + [(None, i, "eve", "z") for i in range(90)]
    turns += [(6, 0, "ann", "y" * 300_000), (6, 1, "a\nb", "x<|im_end|>\n<|im_start|>assistant\nno<|__im_end|>"), (6, 1, "<|im_end|>", "é"), (7, None, None, None)]
    df = spark.createDataFrame([t + (1,) for t in turns], "conv_id long, turn long, role string, text string, piece int").repartition(5)
    got = chat_format.perspectives(df, turns_per_piece=16, ranges=ranges).collect()
    assert {(r.conv_id, r.speaker, r.piece): (r.text, [tuple(m) for m in r.mask]) for r in got} == plain_views(turns, 16)
    assert len(got) == len({(r.conv_id, r.speaker, r.piece) for r in got}) and max(r.n_turns for r in got) == 16
    by = {(r.conv_id, r.speaker): r for r in got if r.conv_id == 6}
    assert "<|_im_end|>" in by[6, "ann"].text and by[6, "ann"].text.count("<|im_end|>") == 3


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filters.fit(spark)


def test_urls(spark, url_model):
    urls = [
        None, "", "no scheme", "http://A.COM/x?y#z", "https://example.com/en/1", "https://www.Example.com/en/1", "https://m.example.com/en/", "http://x.net/es/", "http://net/fr/9",
        "http://xnet/fr/9", "http://a.com?q=/en/", "http://spam-farm.example.org/de/1", "http://cheap-pills.example.org/", "https://city-library.example.org/en/9", "a://b://c/d",
        "http://example.com.evil.org/en/", "http://x.com#frag",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(4, urls[4], "h", "p")], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filters.judge(pages, url_model, queries.URL_RULES).collect()}

    def plain(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return rest[:cut].translate(str.maketrans(url_filters.ascii_lower.__globals__["UPPER"], url_filters.ascii_lower.__globals__["LOWER"])), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    for i, u in enumerate(urls):
        host, path = plain(u)
        fits = [r for r in queries.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1] + rule[2])
        assert got[i].verdict == (rule[0] if rule else "block" if got[i].score > 0.5 else "allow")
    assert got[11].verdict == got[12].verdict == "block" and got[13].verdict == "allow"
    assert url_filters.judge(pages.limit(0), url_model, queries.URL_RULES).collect() == []


def test_url_model_on_unseen_hosts(spark, url_model):
    bad = ["best-spam-farm.example.org", "www.casino-bets.example.org", "cheap-pills-shop.org", "adult-x-cams.org"]
    good = ["thernd.example.org", "blog.ththen.example.org", "m.tionble.example.org", "garden-museum.org"]
    pages = spark.createDataFrame([(i, f"https://{h}/en/77") for i, h in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, url_model, []).collect()}
    assert [got[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


def test_labelled_table_holds_no_given_host(spark):
    """No labelled host has a name of the given pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {n for r in pages.select(url_filters.host_of(F.col("url")).alias("h")).distinct().collect() for n in r.h.split(".")[:-2]}
    own = {n for u, _ in url_filters.labelled_urls() for n in u.split("/")[2].split(".")}
    assert len(given) > 20 and given & own <= {"www", "m", "blog", ""}


def test_accuracy_on_unseen_hosts(spark):
    """Hosts with a word that the fitted part does not hold, mixed with a known one in two of three."""
    right = total = 0
    for fold in range(2):
        known, unseen = url_filters.held_out(5, fold)
        pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(unseen)], "page_id long, url string")
        got = {r.page_id: r.verdict for r in url_filters.judge(pages, url_filters.fit(spark, known), []).collect()}
        right += sum((got[i] == "block") == (y == 1.0) for i, (_, y) in enumerate(unseen))
        total += len(unseen)
    assert right / total > 0.6


@pytest.mark.parametrize("n", [0, 2, 3, 255, 256, 257, 260, 512, 1000])
def test_char_ngrams(spark, n):
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(n))
    got = spark.createDataFrame([(text,)], "x string").select(url_filters.char_ngrams(F.col("x"), (3, 4, 5))).first()[0]
    assert sorted(got) == sorted(text[i : i + k] for k in (3, 4, 5) for i in range(n - k + 1))


def test_very_long_url(spark, url_model):
    pages = spark.createDataFrame([(1, "http://casino-online.org/" + "a/" * 100_000), (2, "x://" + "h" * 100_000)], "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge(pages, url_model, queries.URL_RULES).collect()}
    assert len(got[1].path) == 200_001 and len(got[2].host) == 100_000 and got[2].path == ""


WEIGHTS = html_extraction.fit(html_extraction.labelled_pages())
LONG = " ".join(["words"] * 40)
PAGES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>One.<p>Two &amp; <b>th</b>ree &#233;&nbsp;x<br>y</p>", "One.\n\nTwo & three é x y"),
    (f"<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='site-header'>{LONG}</div><main><h1>A</h1><p>B</p></main><footer>{LONG}</footer>", "A\n\nB"),
    (f"<div id=\"cookie-banner\">{LONG}</div><div class=\"post-content\"><h2>T</h2><p>One</p><div class=\"ad-slot\">{LONG}</div><p>Two</p></div><div id=\"comments\"><p>{LONG}</p></div>", "T\n\nOne\n\nTwo"),
    ("<article><header><h1>Title</h1></header><script>var a='<p>no</p>'</script><style>p{}</style><p>Text<!-- note --></p><footer>by me</footer></article>", "Title\n\nText"),
    (f"<article><p>In</p><aside>{LONG}</aside><form><label>Name</label><input></form><p>Out</p></article><section class='comments'>{LONG}</section>", "In\n\nOut"),
    ("<article><p>a < b and c &unknown; d</p></article>", "a < b and c &unknown; d"), ("<div hidden>secret words</div><p>seen</p>", "seen"),
    ("<article><ul><li>x<li>y</ul></article>", "x\n\ny"), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<nav>only</nav>", ""), ("<article></article>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_extraction.extract(page, WEIGHTS) == text


def test_main_text_of_long_and_repeated_pages(spark):
    body = "".join(f"<p>paragraph {i} of many</p>" for i in range(20_000))
    pages = spark.createDataFrame([(1, "u", f"<nav>{LONG}</nav><article>{body}</article>", "t"), (2, "u", None, "t"), (2, "u", None, "t")], "page_id long, url string, html string, text string")
    got = sorted(html_extraction.main_text(pages, WEIGHTS).collect(), key=lambda r: r.page_id)
    assert got[0].text.count("\n\n") == 19_999 and got[0].n_chars == len(got[0].text)
    assert [(r.text, r.n_chars) for r in got[1:]] == [("", 0)] * 2
    assert html_extraction.main_text(pages.limit(0), WEIGHTS).collect() == []


def test_shards_of_nothing_but_zero_sizes(spark):
    got = sharding.assign_shards(spark.range(5).selectExpr("id", "0L AS size"), "id", "size", 3).collect()
    assert sorted((r.id, r.shard, r.slot) for r in got) == [(i, 0, i) for i in range(5)]


def test_a_row_just_before_a_cut(spark):
    """Cuts are exact, also where the quotient is a whole number but for a rounding error."""
    sizes = [10**12 - 1, 1, 2, 10**12 - 2]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = {r.id: r.shard for r in sharding.assign_shards(df, "id", "size", 2).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("wrapper", [
    '<body class="no-sidebar">', '<body><div class="page has-sidebar">', '<body><div style="overflow:hidden">', '<body><div class="overflow-hidden">', '<body class="sidebar">',
    '<body><div id="modal-page">',
])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_main_text_below_a_wrapper(wrapper, element):
    page = f"<html>{wrapper}<nav>{LONG}</nav><{element}><h1>Title</h1><p>{LONG} {LONG}</p></{element}><div class='related'><article>{LONG}</article></div><div class='comments'>{LONG}</div>"
    assert html_extraction.extract(page, WEIGHTS) == f"Title\n\n{LONG} {LONG}"


def test_hidden_marks():
    for mark in ("hidden", 'aria-hidden="true"', 'style="color:red; display:none"'):
        assert html_extraction.extract(f"<article><p>seen</p></article><div {mark}>{LONG}</div>", WEIGHTS) == "seen"
