"""Main text on pages with known articles; archives by round trip; the index against a plain sort."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from doubtscope.llm import html, warc

PAGES = "page_id long, url string, html string, text string, payload_bytes string"


@pytest.fixture(scope="module")
def pages(make):
    return lambda rows: make([(*r, "mine", "mine") for r in rows], PAGES)


def text_of(page):
    """The text of a page alone on its host."""
    blocks, _, named = html.parse(page)
    return html.chosen(blocks, html.uncovered(len(blocks), named))


def test_blocks_of_an_article():
    page = """<html><head><title>no</title><script>var t="</p><article>x";</script></head><body><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">cookies!</div><article><h1>A &amp;\n B</h1><p><b>first<br>line<p>sec<i>o</i>nd &lt;b&gt; &#x41;</p>
    <aside>aside</aside><form>name <input value=">"> </form><ul><li>one<li>two</ul><!-- <p>hidden --><p>last &copy;
    <div class="comments"><p>reader</div></article><footer>f</footer></body>"""
    assert text_of(page) == "A & B first line second <b> A one two last ©"
    assert html.parse(None) == html.parse("") == ([], [], [])
    assert text_of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 2999) == "deep"
    assert [t for t, _ in html.parse("a < b <p>c")[0]] == ["a < b", "c"]
    assert text_of("<article>own <span class=share>not <span>nor</span> this</span> tail<p>more</article>") == "own tail more"


def test_deep_nesting_takes_linear_time():
    start = time.perf_counter()
    assert text_of("<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text_of("<article>" + "<div>x" * 20_000) == "x " * 19_999 + "x"
    assert text_of("<div>" * 20_000 + "</p>" * 20_000 + "<li>deep") == "deep"
    assert time.perf_counter() - start < 3.0


def test_template_subtrees_go_and_articles_stay(pages):
    rows = []
    for k in range(40):
        banner = "<div><p>Subscribe now to everything we write about</p><p>Second banner line</p></div>"
        rows.append((k, "http://Plain.example/a%d" % k, f"<body>{banner}<div><p>own text of page {k} " + f"which is long {k} " * 30 + "</p></div></body>"))
    rows += [(100 + k, "http://art.example/%d" % k, f"<body><div>{'x' * 9}</div><article>{'<p>in several</p>' * (k % 3 == 0)}<p>own {k}</p></article></body>") for k in range(20)]
    rows += [(200, None, None), (201, None, ""), (202, "http://plain.example/z", "<p>short"), (5, *rows[5][1:])]
    got = {}
    for r in html.main_text(pages(rows)).collect():
        got.setdefault(r.page_id, []).append(r)
    for k in range(40):
        assert got[k][0].text == (f"own text of page {k} " + f"which is long {k} " * 30).strip() and got[k][0].n_removed > 0
    assert all(got[100 + k][0].text == "in several " * (k % 3 == 0) + f"own {k}" for k in range(20))
    assert [got[k][0].text for k in (200, 201, 202)] == ["", "", "short"] and len(got[5]) == 2
    assert all(r.n_chars == len(r.text) for rs in got.values() for r in rs)
    assert html.main_text(pages([])).count() == 0


def test_hints_are_whole_names_on_real_attributes():
    for page in (
        "<body class='no-sidebar'><article class='post has-header'><p>own",
        "<article><div class='elementor-widget'><p>own</p></div>",
        "<article><p data-id='comment-policy' data-title='The hidden valley'>own</p></article>",
        "<article><p data-href='?id=notice'>own</p></article>",
        "<body class=sidebar><main id=share><p>own",
        "<article><div class=widget><p>own</p></div></article>",  # holds all of the text
    ):
        assert text_of(page) == "own", page
    for mark in ("class='x comment-list'", "id=cookie_notice", "role=navigation", "hidden", "style='display: none'", "aria-hidden=true"):
        assert text_of(f"<article><p>own words</p><div {mark}>not</div></article>") == "own words", mark


def test_copies_of_a_page_are_no_template(pages):
    page = "<body><div>" + "".join(f"<p>paragraph {k} of the copied page</p>" for k in range(3)) + "</div></body>"
    rows = [(k, "http://copies.example/%d" % k, page) for k in range(5)] + [(9, "http://copies.example/9", "<p>other</p>")]
    got = {r.page_id: r.text for r in html.main_text(pages(rows)).collect()}
    assert got == dict.fromkeys(range(5), " ".join(f"paragraph {k} of the copied page" for k in range(3))) | {9: "other"}


def articles_of(table):
    """page_id → text of the given pages' article elements, by regular expressions."""
    import html as entities

    out = {}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        out[r.page_id] = " ".join(b for b in blocks if b)
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_all_articles_of_the_given_pages(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = articles_of(table)
    for parts in (None, 1, 7):
        got = html.main_text(table if parts is None else table.repartition(parts)).collect()
        assert len(got) == len(want) and {r.page_id: r.text for r in got} == want


def recounted(rows):
    """page_id → text, with each host's subtrees counted in plain Python."""
    parsed = {}
    for k, (i, url, page) in enumerate(rows):
        blocks, subtrees, named = html.parse(page)
        host = re.sub(r"^\w+://([^/]*).*", r"\1", url).lower()
        parsed[k] = (i, host, blocks, subtrees, named)
    distinct = {}
    for _, host, blocks, subtrees, named in parsed.values():
        left = tuple(t for (t, _), keep in zip(blocks, html.uncovered(len(blocks), named)) if keep)
        distinct[host, left] = {h for h, _, _ in subtrees}
    pages, counts = Counter(host for host, _ in distinct), defaultdict(Counter)
    for (host, _), hashes in distinct.items():
        counts[host].update(hashes)
    out = {}
    for i, host, blocks, subtrees, named in parsed.values():
        gone = list(named)
        for h, first, last in subtrees:
            least, share = html.TEMPLATE[h & 3]
            n = counts[host][h]
            if n >= least and n >= share * pages[host]:
                gone.append((first, last))
        out.setdefault(i, []).append(html.chosen(blocks, html.uncovered(len(blocks), gone)))
    return out


def test_counts_per_host_decide_with_and_without_the_tag(pages):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        words = lambda n: " ".join(rng.choice("sun moon river stone paper glass iron".split()) + str(rng.randrange(50)) for _ in range(n))
        shared = "<p>a passage that several pages of this host quote in full</p>" if k % 3 == 0 else ""
        notice = "<div><p>Please accept our terms</p></div>"
        listed = "<ul>" + "".join(f"<li><a href=/{j}>place {j}</a>" for j in range(6)) + "</ul>"
        body = f"<h1>title {k}</h1><p>{words(40)}</p>{shared}<p>{words(30)}</p>"
        rows.append((k, f"http://tagged.example/{k}", f"<body><div>Top of all pages</div><article>{body}{notice}</article>{listed}</body>"))
        rows.append((1000 + k, f"http://plain.example/{k}", f"<body><div>Top of all pages</div><div>{body}{notice}</div>{listed}</body>"))
        rows.append((2000 + k, f"http://cards.example/{k}", f"<body><div>{body}</div><article class='card'><p>Teaser of page {k + 1}</p></article><div>Top of all pages</div></body>"))
        rows.append((3000 + k, f"http://mixed.example/{k}", f"<body><div>{body}</div><article><p>Teaser {k}</p></article></body>"))
    got = {r.page_id: r.text for r in html.main_text(pages(rows)).collect()}
    assert {i: [t] for i, t in got.items()} == recounted(rows)
    for i, url, page in rows:
        for gone in ("Please accept", "Top of all", "place 3", "Teaser"):
            assert gone not in got[i], (url, gone)
        assert f"title {i % 1000}" in got[i] and got[i].count(" ") > 60
        assert ("several pages of this host" in got[i]) == (i % 1000 % 3 == 0)


def test_a_small_article_beside_a_long_advert():
    assert text_of("<body><div class=ad>" + "buy this now " * 90 + "</div><article><p>short</p></article></body>") == "short"
    assert text_of("<body><div class=widget>" + "the page itself " * 90 + "</div></body>").startswith("the page itself")


def nasty():
    body = "<p>" + "körper 😀 " * 20
    return [
        (1, "http://a.example/x", body),
        (2, "http://a.example/y", body),
        (3, "http://b.example/x", "short"),
        (4, "http://b.example/x", "short"),
        (5, None, None),
        (6, "http://c.example/\r\nX-Page-ID: 9", ""),
        (7, "http://c.example/sep", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n" * 9),
        (8, "http://c.example/sep", "\r\n\r\n\r\r\n\r\n\n\r\n\r\n"),
        (9, "http://A.example/x#frag", "z" * 300_000),
        (None, "http://d.example/", body),
        (2, "http://a.example/y", body),
        (11, "http://d.example/", "y" * 100),
        (10, "http://d.example/", "y" * 100),
        (12, "http://d.example/", "y" * 99),
        (13, "http://d.example/", "y" * 99),
    ]


def test_round_trip(pages, root):
    rows = nasty()
    got = warc.archive_pages(pages(rows), path=root).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            least[h] = min(least.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h)
        again = first is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_damaged_archive_is_noticed(pages, spark, root):
    warc.write_archives(warc.classified(pages(nasty()).selectExpr("page_id", "url", "coalesce(html, '') AS payload")), root)
    damaged = spark.read.option("lineSep", warc.GAP).text(root).selectExpr("replace(value, 'z', 'q') AS value")
    damaged.coalesce(1).write.options(lineSep=warc.GAP, compression="gzip").text(root + "-bad")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, root + "-bad").collect()


def test_index_is_in_global_order(pages, spark, root):
    rng = random.Random(8)
    rows = [(k, "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.randint(0, 9)}.example/{rng.randint(0, 50)}", f"p{k}") for k in range(700)]
    got = warc.merged_index(warc.archive_pages(pages(rows), path=root).drop("urlkey", "index_part", "index_pos"), rows_per_range=60).collect()
    assert len({r.index_part for r in got}) > 5
    ordered = sorted(got, key=lambda r: (r.index_part, r.index_pos))
    keys = [(r.urlkey, r.captured, r.page_id) for r in ordered]
    assert keys == sorted(keys) and len(keys) == 700


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 40):
        runs = [sorted((rng.randint(0, 30), n) for n in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(x for r in runs for x in r)


def test_empty(pages):
    assert warc.archive_pages(pages([])).count() == 0
