"""URL filters, mixing, WARC, HTML extraction and the pipeline on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import pytest

from cladeflow.llm import decontaminate, html_extract, mixing, url_filter, warc
from cladeflow.llm.spark_util import fresh_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAGES = "page_id long, url string, html string, host string, path string, rule string, text string"


def pages_frame(spark, rows):
    """Pages with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, u, h, "x", "y", "z", "w") for i, u, h in rows], PAGES)


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(-len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = min(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("parts", [1, 4])
def test_urls_against_brute_force(spark, parts):
    rng = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "Example.ORG", "com", "x.com", "notexample.org", "example.org.", "", "..", "é.org", "example.org:80"]
    ends = ["", "/", "/es/", "/es/1", "/es", "/en/1", "/en/12?q=/de/", "/en/", "/fr/#x", "/de/a/b", "?a/fr/", "#", "/ES/", "/fr/é\n1"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(ends)}" for _ in range(300)] + [None, "", "example.org/es/", "a://b://c.org/es/"]
    urls += ["http://hot.example.org/es/1"] * 200
    urls += [f"http://{'a.' * 30_000}example.org/es/", f"http://{'.' * 30_000}com/fr/", f"http://x.com/fr/{'y/' * 50_000}"]
    rules = [*url_filter.RULES, ("example.org/", "allow"), ("example.org/es/1", "allow"), ("a.example.org/en/", "block")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = url_filter.judged(pages_frame(spark, [(k, u, None) for k, u in enumerate(urls)]), url_filter.rule_table(spark, rules)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(urls[r["page_id"]], rules)


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    assert url_filter.judged(pages_frame(spark, [(1, "http://a.org/", None)]), none).first()["verdict"] == "allow"
    assert url_filter.judged(pages_frame(spark, []), url_filter.rule_table(spark)).count() == 0


def test_url_plan_is_native(spark):
    plan = url_filter.judged(pages_frame(spark, [(1, "http://a.org/", None)]), url_filter.rule_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


DOCS = "doc_id long, text string, source string, replica string, mix_rate string"


def test_mixing_rates_and_counts(spark):
    rows = [(k, "x" * 10, "big", "r", "m") for k in range(3000)] + [(k, "x" * 10, "small", "r", "m") for k in range(3000, 4000)] + [(4000 + k, "x" * 10, None, "r", "m") for k in range(500)]
    docs = spark.createDataFrame([*rows, (9000, None, "empty", "r", "m"), (9001, "", "empty", "r", "m"), (None, "x" * 10, "small", "r", "m")], DOCS)
    weights = {"big": 0.3}
    rates = {r["mix_source"]: r["mix_rate"] for r in mixing.rates(docs, weights).collect()}
    assert rates["big"] == pytest.approx(0.3 * 4501 / 3000) and rates["small"] == pytest.approx(rates[None]) and rates["empty"] == 1.0
    out = mixing.mixed(docs, weights)
    assert out.columns == ["doc_id", "text", "source", "mix_rate", "replica"]
    got = out.collect()
    sizes = Counter(r["source"] for r in got)
    for name, rate, n in (("big", rates["big"], 3000), ("small", rates["small"], 1001), (None, rates[None], 500)):
        assert abs(sizes[name] - rate * n) < 5 * (rate * n) ** 0.5
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(7), weights).collect()), key=str)
    assert [r["doc_id"] for r in got] != sorted(r["doc_id"] or 0 for r in got)


def test_poisson_inverts_the_distribution_also_for_large_means(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000)
    for mean in (0.0, 0.4, 3.0, 1300.0):
        row = df.select(mixing.poisson(F.lit(mean), "s", F.col("id")).alias("n")).agg(F.avg("n"), F.variance("n")).first()
        assert row[0] == pytest.approx(mean, abs=5 * (mean / 2000) ** 0.5 + 1e-9) and row[1] == pytest.approx(mean, rel=0.2, abs=0.05 * (mean > 0) + 1e-9)


def test_mixing_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS), {"big": 0.3}).count() == 0


def test_warc_round_trip(spark):
    long, other = "é" * 600, "y" * 1000
    rows = [(1, "http://a", long), (2, "http://b", long), (5, "http://c", long), (3, None, other), (4, "http://x\r\ny", "short"), (6, "http://d", "short"), (7, "http://e", None), (8, "http://f", ""), (None, "http://g", long), (5, "http://c", long), (9, "u", "z" * 3_000_000)]
    out = warc.archived(pages_frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r, (page_id, _, html) in zip(sorted(out, key=lambda r: (r["page_id"] or 0, r["url"] or "")), sorted(rows, key=lambda x: (x[0] or 0, x[1] or "")), strict=True):
        payload = (html or "").encode()
        assert (r["page_id"], r["payload_bytes"], r["payload_digest"]) == (page_id, len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if html == long and page_id != 5 else ("response", None))
    assert warc.archived(pages_frame(spark, [])).count() == 0


def test_warc_reads_selected_ranges(spark):
    rows = [(k, f"http://h/{k}", f"page {k} " * 300) for k in range(200)]
    index = warc.write_archives(pages_frame(spark, rows), fresh_path(spark, "warc"))
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(index.filter("page_id % 50 = 3")).collect()}
    assert got == {k: f"page {k} " * 300 for k in (3, 53, 103, 153)}
    assert list(warc.ranges(iter([("a", 0, 10), ("a", 10, 5), ("a", 200_000, 5), ("b", 0, 1)]))) == [("a", 0, 15, 2), ("a", 200_000, 200_005, 1), ("b", 0, 1, 1)]


ARTICLE = "<h1>Head &amp; line</h1><p>First  para <a href=x>link</a> text<br>more<p>Second<ul><li>one<li>two</ul>"
WANT = "Head & line\n\nFirst para link text more\n\nSecond\n\none\n\ntwo"


def page(k, body):
    return f'<!DOCTYPE html><html><head><title>T{k}</title><script>var x="</p>";</script></head><body class="home"><header>Site</header><nav><a href=/>Home {k}</a></nav><div class="cookie-notice">We use</div>{body}<aside>side {k}</aside><footer>&copy; us</footer></body></html>'


def test_html_extraction(spark):
    bodies = {
        "article": f"<article>{ARTICLE}<div class='comments'><p>I like</p></div></article>",
        "div": f"<div id='content-1'>{ARTICLE}<form><input> sub</form><div class=ad-box>buy</div></div><div class='other'>All pages say this.</div>",
        "cut": f"<article>{ARTICLE}",
    }
    rows, want = [], {}
    for host, body in bodies.items():
        for k in range(5):
            own = lambda x, k=k, host=host: re.sub("Head|Second|one|First", rf"\\g<0>{k} {host}", x)
            want[len(rows)] = own(WANT)
            rows.append((len(rows), f"http://{host}.org/{k}", page(k, own(body))))
    for k in range(4):  # copies
        want[len(rows)] = WANT
        rows.append((len(rows), f"http://copies.org/{k}", page(0, bodies["div"].partition("<div class='other'")[0])))
    odd = [(100, None, None), (101, "x", ""), (102, "http://one.org", page(0, bodies["article"])), (103, "http://t.org", "just text"), (104, "http://t.org", "<div " * 1000), (105, "http://t.org", "<p>a</p>" * 20000)]
    want |= {100: "", 101: "", 102: WANT, 103: "just text", 104: "", 105: "\n\n".join("a" * 20000)}
    out = html_extract.extracted(pages_frame(spark, rows + odd)).collect()
    assert len(out) == len(want)
    for r in out:
        assert r["text"] == want[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])
    assert html_extract.extracted(pages_frame(spark, [])).count() == 0


def test_html_layouts_keep_the_whole_article(spark):
    layouts = {
        "container": ("<div id=content class='has-sidebar'><h1>Head {k}</h1><p>Body {k} of the text</p></div>", "Head {k}\n\nBody {k} of the text"),
        "title": ("<div class='entry-header'><h1>Head {k}</h1></div><div class=text><p>Body {k} of a rather longer text, so that it weighs more than the headline</p></div>", "Head {k}\n\nBody {k} of a rather longer text, so that it weighs more than the headline"),
        "leaf": ("<article><p>First {k}<p class=notice>Note {k} <span class=tags>inline</span></article>", "First {k}\n\nNote {k} inline"),
        "parts": ("<article class=one><p>Part {k} one, long enough</p></article><div class=links><a href=/>Link {k}</a></div><article class=two><p>Two {k}</p></article>", "Part {k} one, long enough\n\nTwo {k}"),
        "main": ("<main><p>Lead {k}</p><article><p>Text {k}</p></article></main>", "Lead {k}\n\nText {k}"),
        "lead": ("<div class=lead>Lead {k}</div><div class=story><p>" + "Long text {k}. " * 20 + "</p></div><div class=more><a href=/>Link {k}</a></div>", "Lead {k}\n\n" + ("Long text {k}. " * 20).strip()),
    }
    rows, want = [], {}
    for name, (body, text) in layouts.items():
        for k in range(4):
            want[len(rows)] = text.replace("{k}", str(k))
            rows.append((len(rows), f"http://{name}.org/{k}", page(k, body.replace("{k}", str(k)))))
    for r in html_extract.extracted(pages_frame(spark, rows)).collect():
        assert r["text"] == want[r["page_id"]], rows[r["page_id"]][1]


def test_html_truth_of_the_pages(spark):
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extracted(pages).collect():
        body = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in blocks if x)


def test_html_zones_and_odd_pages(spark):
    """Names count as whole words; nothing is cut by depth or by the length of a name; comments aren't the article."""
    deep = "<div>" * 300
    cases = {
        "flag": ('<div class="page has-sidebar"><article><p>Hello {k}</p></article></div>', "Hello {k}"),
        "nocomments": ('<div id="content" class="no-comments"><p>Body {k}</p></div>', "Body {k}"),
        "heading": ('<article><header class="entry-header"><h1>Title {k}</h1></header><p>Text {k}</p></article>', "Title {k}\n\nText {k}"),
        "warning": ('<article><p>One {k}</p><p class="warning">Two {k}</p></article>', "One {k}\n\nTwo {k}"),
        "comments": ('<main><article>story {k}</article><article class="comment">a much longer comment about it {k}, and on and on</article></main>', "story {k}"),
        "elements": ("<article><p>Sum <math><mi>x{k}</mi></math></p><canvas>drawn {k}</canvas><object>held {k}</object><form><select><option>no</select></form></article>", "Sum x{k}\n\ndrawn {k}\n\nheld {k}"),
        "deep": (f'{deep}<div class="zone{{k}}"><p>Deep {{k}}</p></div><div class="comments"><p>reader {{k}}</p></div>', "Deep {k}"),
        "names": (f'<div class="{"x" * 60}one"><p>Kept {{k}} of some length</p></div><div class="{"x" * 60}two"><a href=/>gone {{k}}</a></div>', "Kept {k} of some length"),
    }
    rows, want = [], {}
    for name, (body, text) in cases.items():
        for k in range(4):
            want[len(rows)] = text.replace("{k}", str(k))
            rows.append((len(rows), f"http://{name}.org/{k}", f"<html><body><nav><a href=/>Home</a></nav>{body.replace('{k}', str(k))}</body></html>"))
    rows += [(900, "http://deep.org/x", "<div class=ad>" * 20_000 + "ad" + "</b>" * 20_000), (901, "http://long.org/", "<p>" + "word " * 200_000)]
    want |= {900: "ad", 901: ("word " * 200_000).strip()}
    for r in html_extract.extracted(pages_frame(spark, rows)).collect():
        assert r["text"] == want[r["page_id"]], rows[min(r["page_id"], 31)][2][:200]


def brute_fixed(pages):
    """The texts of a host's template by its definition, from whole count vectors; places are tuples of elements."""
    parsed = [html_extract.Page(x) for x in pages]
    around = {place: tag[0] for p in parsed for place, tag in p.tags.items()}
    tags = {place: tuple(p.tags[place][1] if place in p.tags else 0 for p in parsed) for place in around}
    texts = {}
    for k, p in enumerate(parsed):
        for place, text, *_ in p.blocks:
            texts.setdefault((place, text), [0] * len(parsed))[k] += 1

    def chain(place):
        while place in tags:
            yield place
            place = around[place]

    slots, region = {}, Counter()
    for (place, text), vector in texts.items():
        if sum(map(bool, vector)) >= 3:
            slot = next((x for x in chain(place) if tags[x] == tuple(vector)), None)
            if slot is not None:
                slots.setdefault(slot, []).append((place, text, len(text) * sum(vector)))
    for slot in slots:
        for (place, text), vector in texts.items():
            if next((x for x in chain(place) if tags[x] == tags[slot]), None) == slot:
                region[slot] += len(text) * sum(vector)
    return {(place, text) for slot, own in slots.items() if 2 * sum(n for *_, n in own) >= region[slot] for place, text, _ in own}


def template_pages():
    """A host without any article element or telling name: only the vectors tell its frame from its text."""
    rng = random.Random(3)
    words = "lorem ipsum dolor sit amet elit sed do tempor".split()
    out = []
    for k in range(6):
        text = "".join(f"<p>{' '.join(rng.choice(words) for _ in range(20))} {k}</p>" for _ in range(rng.randint(1, 4)))
        promo = "<section><div>Sale this week only</div></section>" if k % 2 else ""
        desk = "Filed by the news desk" if k < 3 else f"By {k}"  # often the same, but not wherever its element stands
        out.append(f"<html><body><div>The daily paper</div><div><span>Est. 1900</span></div>{promo}<div><h2>Story {k}</h2><div class=desk>{desk}</div>{text}</div><div>Printed on recycled pixels</div></body></html>")
    return out


def test_html_template_against_brute_force(spark):
    pages = template_pages()
    rows = [(k, f"http://frame.org/{k}", x) for k, x in enumerate(pages)]
    model = html_extract.templates(pages_frame(spark, rows)).first()
    want = brute_fixed(pages)
    assert set(model["fixed"]) == {html_extract.hashed(text, place) for place, text in want}
    assert {"The daily paper", "Est. 1900"} <= {text for _, text in want} and not any("Story" in text for _, text in want)
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages_frame(spark, rows)).collect()}
    for k, html in enumerate(pages):
        assert got[k].startswith(f"Story {k}\n\n{'Filed by the news desk' if k < 3 else f'By {k}'}\n\n") and "Est." not in got[k] and "daily" not in got[k]
    # The vectors decide: with all of them equal, other texts remain.
    same = [dict(t, low=0, high=0) for t in tokens_of(spark, rows)]
    assert set(html_extract.deduced(same)[0]) != set(model["fixed"])


def tokens_of(spark, rows):
    return [r.asDict() for r in html_extract.token_table(pages_frame(spark, rows)).filter("pages >= 3 or kind <= 1").collect()]


def test_html_classes_nest(spark):
    rows = [(k, f"http://h.org/{k}", page(k, f"<article><h1>H{k}</h1>" + "<p>x</p>" * k + "</article>")) for k in range(1, 6)]
    place = lambda *elements: __import__("functools").reduce(lambda seed, x: html_extract.hashed(x, seed), elements, 0)
    model = html_extract.templates(pages_frame(spark, rows)).first()
    article = place("html[1]", "body.home", "article[1]")
    once = next(c for c in model["classes"] if article in c)
    assert place("html[1]", "body.home", "footer[1]") in once and html_extract.hashed("h1", article) in once
    assert html_extract.hashed("p", article) not in once and any(c == [html_extract.hashed("p", article)] for c in model["classes"])
    # A class whose outermost tags lie in different classes doesn't nest.
    tag = lambda token, around, v: {"token": token, "around": around, "kind": html_extract.TAG, "pages": 5, "low": v, "high": v, "contents": 31, "chars": 9, "linked": 0}
    whole = {"token": 0, "around": 0, "pages": 5, "low": 1, "high": 1, "contents": 31, "chars": 90, "linked": 0}
    tokens = [whole | {"kind": 0}, whole | {"token": 1, "kind": 1, "chars": 0}, tag(10, 0, 1), tag(11, 10, 2), tag(12, 10, 3), tag(13, 11, 3)]
    assert html_extract.deduced(tokens)[4] == [[10], [11]]


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns, name
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontaminate.contamination(after, bench).filter("contaminated").count() == 0
        before = after.cache()
    rows = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert len(rows) == before.count() and sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, empty and long texts, and empty tables: every stage gives the columns, and no clean text is lost."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, text(k), "en", "src1", 1) for k in range(30)]
    rows += [(None, text(100), None, None, None), (5, text(101), "en", "src0", 1), (6, text(6), "en", "src1", 1), (40, None, "en", "src1", None), (41, "", "en", None, 0), (42, "long " * 50_000, "de", "src0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels, bench = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, docs in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, text(3))], bench).write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:3]:
            now = stage(spark, now, folder)
            assert now.columns == schema.replace(" long", "").replace(" string", "").split(", "), stage_name
        kept = now.collect()
        if docs:
            # Null and empty texts are copies of each other; the passage of the test item goes; a repeated row goes; a repeated id doesn't.
            assert sorted(r["text"] or "" for r in kept) == sorted([text(k) for k in range(30) if k != 3] + [text(100), text(101), "", "long " * 50_000])
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and (out.count() > 0) == bool(docs)
