"""HTML extraction and the quality classifier."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from anchorage.llm import html, quality


def kept(source):
    return "\n\n".join(html.Page(source).kept())


@pytest.mark.parametrize("source,text", [
    ("", ""), ("plain  text", "plain text"), ("<p>a&amp;amp;b &lt;i&gt;</p>", "a&amp;b <i>"),
    ("<script>var t='</p>';</script><p>x<p>y<br>z", "x\n\ny z"), ("<style>p{}</style><!-- <p>no</p> --><div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
    ("<nav>menu</nav><header>top</header><article><header><h1>T</h1></header><p>b <b>c<p>d</article><footer>f</footer>", "T\n\nb c\n\nd"),
    ("<div class='ad'>buy</div><div class='bread'>x</div><div id=cookieNotice>ok</div><form>f</form><section class='comments'><p>hi</p></section>", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"), ("<p title='a>b'>t</p><p hidden>no</p></div></p>u", "t\n\nu"),
    ("<p>unclosed <b>bold", "unclosed bold"), ("a < b and <3 > c", "a < b and <3 > c"), ("<article><p>in</p></article><p>out</p>", "in"), ("<script>never ends <p>x", ""),
    ("<P CLASS=Sidebar>no</P><aside>n</aside>\n<pre> a\n b </pre>", "a b"),
])
def test_pages(source, text):
    assert kept(source) == text


def test_site_templates_go(spark):
    rows = [(i, f"https://u:p@A.example.com:80/{i}", f"<div><p>Read our daily letter</p><p>Own text number {i}</p></div>") for i in range(20)]
    # Copies of one article are no template, however many there are.
    rows += [(100 + i, "http://b.example.com/x", "<p>Same article</p><p>in many copies</p>") for i in range(30)] + [(200 + i, "http://b.example.com/y", f"<p>Other {i}</p>") for i in range(12)]
    rows += [(300, None, None), (301, "nonsense", "<p>Read our daily letter</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    got = html.main_text(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[7] == "Own text number 7" and by[105] == "Same article\n\nin many copies" and by[300] == "" and by[301] == "Read our daily letter"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(df.limit(0)).count() == 0


def site(seed, n=60):
    """Pages of nested div and p alone, with no class, role or article: menus, notices and a footer that recur, and own text. Also what is own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    menu, foot = [" ".join(word() for _ in range(2)) for _ in range(6)], "imprint " + word()
    notices = [" ".join(word() for _ in range(9)) for _ in range(3)]
    pages, own = [], []
    for i in range(n):
        text = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 5))]
        aside = notices[i % 3] if i % 2 else None  # each on a sixth of the pages
        parts = ["<div><div>" + "".join(f"<div>{m}</div>" for m in menu) + "</div>", *[f"<p>{t}</p>" for t in text], f"<div><p>{aside}</p></div>" if aside else "", f"<div>{foot}</div></div>"]
        pages.append("<html><body>" + "".join(parts) + "</body></html>")
        own.append(text)
    return pages, own


def brute_templates(pages, least, share):
    """Subtrees, as their texts in order with the elements round them, that stand on enough pages; by an XML parser."""
    from xml.etree import ElementTree

    def tree(e):
        return (e.tag, e.text or "", tuple(tree(x) for x in e))

    held = [{tree(x) for x in ElementTree.fromstring(p).iter() if x.tag not in ("html", "body")} for p in pages]
    return {t for h in held for t in h if sum(t in x for x in held) >= max(least, share * len(pages))}


def test_recurrence_alone_removes_boilerplate(spark):
    """No list of elements or classes can see these; the count over the host removes just what a brute-force count does."""
    from xml.etree import ElementTree

    sites = [site(1), site(2, 30), site(3, 6)]
    rows = [(100 * h + i, f"https://host{h}.example.com/{i}", p) for h, (pages, _) in enumerate(sites) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h, (pages, own) in enumerate(sites):
        gone = brute_templates(pages, 8, 0.05)
        assert bool(gone) == (len(pages) >= 8)  # a host of six pages has no template yet

        def left(e):
            sub = (lambda f: f(f, e))(lambda f, x: (x.tag, x.text or "", tuple(f(f, y) for y in x)))
            return [] if sub in gone else ([e.text] if e.text else []) + [t for x in e for t in left(x)]

        for i, p in enumerate(pages):
            assert got[100 * h + i] == "\n\n".join(left(ElementTree.fromstring(p)))
            if h == 0:
                assert got[i] == "\n\n".join(own[i])


def test_article_text_is_not_judged_by_class(spark):
    page = "<article><p class='share alert'>Kept words</p><div class='share'>Tweet</div><h2 id='related-work'>Related work</h2><p>More</p></article>"
    assert kept(page) == "Kept words\n\nRelated work\n\nMore"
    # A phrase that recurs in articles of a host on a tenth of its pages stays, on half of them it goes.
    rows = [(i, "http://a.example.com/", f"<article><p>Text {i}</p>{'<p>Once in a while</p>' if i % 10 == 0 else ''}{'<p>Sign up below</p>' if i % 2 else ''}</article>") for i in range(100)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == "Text 10\n\nOnce in a while" and got[11] == "Text 11"


def test_broken_pages_take_linear_time():
    for piece in ("<b>x</i>", "<p><b>", "</div>", "<li><b>x", "<td></span>", "<div>", "&amp;<br>"):
        before = time.perf_counter()
        html.Page(piece * 20000).kept()
        assert time.perf_counter() - before < 5, piece
    assert len(kept("<p>" + "long text " * 200000 + "</p>")) == 1999999


def test_site_templates_by_join(spark, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_ROWS", -1)
    df = spark.createDataFrame([(i, "https://a.example.com/", f"<div><p>Read our daily letter</p><p>Own {i}</p></div>") for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in html.main_text(df).collect()} == {f"Own {i}" for i in range(20)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out")
    acc, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and acc >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in quality.score(docs.limit(50), labels).collect())


def test_quality_odd_rows(spark, docs):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x y", "a"), (3, "word " * 50000, "b"), (4, "é \U0001f600 ###", "c")]
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 1), (None, 1, 1), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs(rows), labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.score(docs(rows), labels.limit(0)).collect())
    assert quality.score(docs([]), labels).count() == 0
    assert quality.keep_good(docs(rows), labels.limit(0)).count() == 6


def test_fit_separates():
    good, bad = [f"plain words number {i} here" for i in range(60)], [f"plain*** words### number%%% {i}" for i in range(60)]
    m = quality.fit([quality.features(x) for p in zip(good, bad, strict=True) for x in p], [1, 0] * 60)
    assert m.score("other words") > 0.6 > 0.4 > m.score("other*** words###")


def test_training_reads_whole_texts(spark, docs):
    """Documents of a kind differ only beyond their first 30 000 characters."""
    start = "the same opening words " * 1400
    rows = [(i, start + ("fine prose at last " if i % 2 else "junk!! ### $$$ ") * 1400, "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs(rows), labels).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if i % 2 == 0)


def test_repeated_documents_stay_within_the_sample(spark, docs):
    rows = [(1, "good words", "a")] * 30 + [(2, "bad### words", "a")] * 30
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs(rows), labels, max_rows=40).weights.shape == (1 << quality.BITS,)


def test_ftrl_against_the_formulas():
    """The fit against follow-the-regularised-leader written out weight by weight in plain Python."""
    from math import exp, sqrt

    rng = random.Random(0)
    texts = [" ".join(rng.choice(["good", "fine", "prose"] if i % 2 else ["bad!!", "junk##", "prose"]) + str(rng.randrange(5)) for _ in range(6)) for i in range(24)]
    rows, labels, alpha, beta, l1, l2 = [quality.features(t) for t in texts], [i % 2 for i in range(24)], 0.7, 1.3, 0.05, 0.2
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((beta + sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for (idx, x), y in zip(rows, labels):
            feats = [*zip(idx.tolist(), x.tolist()), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in feats}
            p = 1 / (1 + exp(-sum(w[i] * v for i, v in feats)))
            for i, v in feats:
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    m = quality.fit(rows, labels, 3, alpha, beta, l1, l2)
    assert abs(m.bias - weight("bias")) < 1e-9
    assert all(abs(m.weights[i] - weight(i)) < 1e-5 for i in z if i != "bias") and (m.weights != 0).sum() <= len(z)
    for t in texts:
        idx, x = quality.features(t)
        want = 1 / (1 + exp(-sum(weight(i) * v for i, v in zip(idx.tolist(), x.tolist())) - weight("bias")))
        assert abs(m.score(t) - want) < 1e-5
