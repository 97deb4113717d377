"""Main text of pages, periodic runs and spelling variants: small cases and whole tables against plain Python."""

import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelmill.llm import content, labelled_pages, runs, spelling
from tests.harness import compare
from tests.llm.test_corpus import TEXTS, empty_documents, odd_documents

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


# ---- 11 ----

@pytest.fixture(scope="module")
def model(spark):
    return content.default_model(spark)


def article_text(page):
    """The text of the given tables' pages: the blocks of the article element."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_table(spark, sf):
    got = {r["page_id"]: r for r in QUERIES["op11_html_content"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]]["text"] == article_text(r["html"]) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_held_out_layout_fillings():
    fitted = content.fit_pages(labelled_pages.labelled_pages())
    rng = random.Random(5)
    fresh = [labelled_pages.fill(layout, rng) for layout in labelled_pages.LAYOUTS for _ in range(5)]
    got = content._texts([content.Page(h) for h, _ in fresh], fitted, 0.5)
    assert sum(g == t for g, (_, t) in zip(got, fresh)) > 0.95 * len(fresh)


def test_marginals_sum_over_all_labellings():
    """Sum-product messages against the sum over every labelling of a small tree."""
    import itertools

    import numpy as np

    page = content.Page("<div class='ad'><p>one two.</p>loose<ul><li>a<li>b</ul></div><h1>x</h1>")
    field, rng = content.Field([page]), np.random.default_rng(3)
    weights, bonds = rng.normal(size=content.WIDTH), rng.normal(size=(content.EDGES, 2, 2))
    own = np.bincount(field.owner, weights[field.feature], field.n)
    total, each, pairs = 0.0, np.zeros(field.n), np.zeros((field.n, 2, 2))
    for y in itertools.product((0, 1), repeat=field.n):
        p = np.exp(sum(own[i] * y[i] for i in range(field.n)) + sum(
            bonds[field.edge[i], y[field.parent[i]], y[i]] for i in range(1, field.n)))
        total += p
        for i in range(field.n):
            each[i] += p * y[i]
            if i:
                pairs[i, y[field.parent[i]], y[i]] += p
    got, got_pairs = field.marginals(weights, bonds)
    assert np.allclose(got[:, 1], each / total) and np.allclose(got_pairs, pairs / total)


def test_page_elements():
    page = content.Page("<p>a <b>b<br>c<p>d&amp;e &lt;p&gt;<script>var t='</p>'</script><ul><li>x<li>y</ul>loose<div>z</div>tail")
    assert [t for t in page.text if t] == ["a b c", "d&e <p>", "x", "y", "loose", "z", "tail"]
    assert all(p < i for i, p in enumerate(page.parent))
    assert [t for t in content.Page("<table><tr><td>1<td>2<tr><td>3</table><p title='a>b'>4</p><!-- <p>no --><p>5 < 6").text if t] == [
        "1", "2", "3", "4", "5 < 6"]
    for broken in ("", "<", "<p", "<p class=\"", "</p></div>", "<!-- x", "<script>", "&am", "<a><a><a>", "<p \"'>t"):
        content.Page(broken)


def test_pages_of_any_shape(spark, model):
    article = "<nav><a href='/'>home</a></nav><article><h1>Title</h1><p>" + "A sentence of words. " * 5 + "</p></article>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", article, "t"), (3, "u", article, "t"), (None, "u", "<p></p>", "t"),
            (4, "u", "<article><p>" + "long words here. " * 40_000 + "</p></article>", "t"), (5, "u", "<div>" * 3000 + "x", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string").repartition(2)
    got = content.digest(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[None] == "" and by[3].startswith("Title\nA sentence") and "home" not in by[3]
    assert len(by[4]) == 17 * 40_000 - 1
    assert content.digest(pages.where("page_id = -1")).count() == 0
    out = content.extract_main_text(pages, "main", model)
    assert out.columns == [*pages.columns, "main"]


def test_unlike_layouts(model):
    """Comments, notices and forms inside the article, in an arrangement that no labelled page has."""
    text = "The council met on Monday and agreed on the plan, which had been under way for years. "
    page = f"""<body><div class="gdpr-banner"><p>We use cookies. You may say no to them at any time.</p></div>
      <header><p>Daily paper, since 1900.</p></header><main><article><h1>Council agrees</h1><p>{text}</p>
      <div class="advertisement"><p>Buy a car now, it is a good car. Really.</p></div><p>{text * 3}</p>
      <form class="subscribe"><p>Get our letter every day. Type in your mail.</p></form><p>{text}</p>
      <section id="reader-comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all. Never did.</p></div></section>
      </article></main><footer><p>All rights reserved. No part may be copied.</p></footer>"""
    got = content._texts([content.Page(page)], model, 0.5)[0]
    assert got == "\n".join(["Council agrees", text.strip(), (text * 3).strip(), text.strip()])


# ---- 12 ----

def plain_runs(w, least=24, copies=3):
    out = []
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, copies * q):
                part = w[i:i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if key is not None and w and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    milli = None if not found else 1000 * best[1] // best[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_runs_of_the_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = {i for i, t in docs if t is None or len(t) < 12_000}
    got = QUERIES["op12_periodic_runs"](spark, sf).select(COLUMNS).collect()
    assert len(got) == len(docs)
    assert ordered(r for r in got if r["doc_id"] in short) == ordered(plain_digest(i, t) for i, t in docs if i in short)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 6)):
                unit = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
                words += (unit * rng.randint(1, 9))[:rng.randint(1, 120)] + [rng.choice("abz")] * rng.randint(0, 3)
            texts.append([w.encode() for w in words])
        assert runs.find_runs(texts) == [plain_runs(t) for t in texts]
        assert runs.find_runs(texts, 10, 4) == [plain_runs(t, 10, 4) for t in texts]


def test_runs_in_odd_rows(spark):
    got = runs.digest(odd_documents(spark)).select(COLUMNS).collect()
    assert ordered(got) == ordered(plain_digest(i, t) for i, t in TEXTS if i not in (6, 7)) or len(got) == len(TEXTS)
    small = [(i, t) for i, t in TEXTS if i not in (6, 7)]
    assert ordered(r for r in got if r["doc_id"] not in (6, 7)) == ordered(plain_digest(i, t) for i, t in small)
    assert runs.digest(empty_documents(spark)).count() == 0
    long = spark.createDataFrame([(1, "w " * 400_000), (2, " ".join(f"x{i % 1000}" for i in range(10_000)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in long.select("doc_id", runs.periodic_runs(F.col("text")).alias("r")).collect()}
    assert [tuple(x) for x in got[1]["r"]["runs"]] == [(0, 400_000, 1)] and got[1]["r"]["collapsed"] == "w"
    assert [tuple(x) for x in got[2]["r"]["runs"]] == [(0, 10_000, 1000)]


def test_collapsing_keeps_other_columns_and_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\n", "x"), (2, "no " * 30 + "end", "y"), (3, None, "z")], "id int, text string, _runs string")
    got = {r["id"]: r for r in runs.collapse_runs(docs).collect()}
    assert got[1]["text"] == "a  b\n" and got[2]["text"] == "no end" and got[3]["text"] is None and got[2]["_runs"] == "y"


# ---- 13 ----

def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_variants_of_the_table(spark, sf, duck):
    same, note = compare(QUERIES["op13_spelling_variants"](spark, sf), duck, ORACLES["op13_spelling_variants"])
    assert same, note
    assert "types" not in note, note


@pytest.mark.parametrize("part_words", [spelling.PART_WORDS, 7])
def test_variants_of_random_words(spark, part_words, monkeypatch):
    """Also with parts dealt into many pieces; letters beyond a-z; chains of forms; ties."""
    monkeypatch.setattr(spelling, "LEAF_WORDS", 3)
    rng = random.Random(4)
    counts = {}
    for _ in range(400):
        word = "".join(rng.choice("aetéÐ") for _ in range(rng.randint(1, 6)))
        counts[word] = rng.choice((3, 3, 6, 12, 24, 50))
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(table, part_words).collect()}
    want = plain_variants(counts)
    assert {w: n for w, (n, _) in near.items()} == {r[0]: r[4] for r in want if r[4]}
    if part_words == spelling.PART_WORDS:
        got = spelling.group_variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(tuple, got)) == want


def test_words_of_odd_rows(spark):
    got = {r["word"]: r["n"] for r in spelling.count_words(odd_documents(spark), "text", "doc_id").collect()}
    want = Counter()
    for key, text in TEXTS:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.digest(empty_documents(spark)).count() == 0
    long = spark.createDataFrame([("x" * 50_000, 9), ("x" * 49_999, 3), ("y" * 5, 1), (None, 4), ("", 2)], "word string, n long")
    out = {r["word"]: r["root"] for r in spelling.group_variants(long).collect()}
    assert out["x" * 49_999] == "x" * 50_000 and len(out) == 3
