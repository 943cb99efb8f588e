"""Main texts, quality scores and quality rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.llm import html_text, quality, rules

FOLDER = "/root/testdata/sf0.01"


def test_labelled_pages_are_learnt():
    for page, marks in html_text.labelled_pages():
        found = html_text.main_texts([page])[0].split("\n")
        assert found == [b.text for b, m in zip(html_text.blocks(page), marks) if m == "+"]


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<!-- open", ""), ("<script>var a = '</p>';", ""), ("<p>a &lt; b&nbsp;&amp; c <b>d</b>e</p>", None),
    ("<article><p>one<br>two</p><p> three\n four </p>&copy five&am</article>", "one two\nthree four\n© five&am"),
    ("<article><h1>T</h1><p>a<p>b<ul><li>c<li>d</ul><footer>f</footer></article>", "T\na\nb\nc\nd"),
    ("<article><p>x < y and y > z</p><a href='>'>link</a></article>", "x < y and y > z\nlink"),
    ("<article><p>" + "<b>" * 20_000 + "deep" + "</i>" * 20_000, "deep"),
    ("<div hidden><p>" + "word " * 40 + "</p></div><article><p>kept</p></article>", "kept"),
    ("<article><p>kept</p><div class='user-comments'><p>" + "word " * 40 + "</p></div></article>", "kept"),
])
def test_pages(page, text):
    found = html_text.main_texts([page])[0]
    assert text is None or found == text


@pytest.mark.parametrize("page, text", [
    ('<svg class="i"/><p>a</p><p>b</p>', "a\nb"),
    ('<p>a</p><svg class="i"/><p>b</p><svg><path/><title/><style/>s</svg><p>c</p>', "a\nb\nc"),
    ("<p>a</p><math/><p>b</p>", "a\nb"),
    ("<p>a <button><div>Share</div></button> b <svg><a><title>x</title></a></svg>c</p>", "a b c"),
    ("<p>a</p><video><p>none</p></video><object><p>none</p><canvas>none</object><p>b</p>", "a\nb"),
    *((f"<p>a</p><div><{name}>none</div><p>b</p><p>c</p>", "a\nb\nc")
      for name in "select object video audio canvas button svg".split()),
    ("<p>a</p><button>Share<p>b</p><script>if (x<y) '<p>s'</script><p>c</p>", "a\nb\nc"),
    ("<p>a</p><select><option>none<option>none</select><p>b</p><script>'<p>c'", "a\nb"),
    ("<p>a</p><noscript><p>none</p></noscript><p>b</p><noscript><p>c</p>", "a\nb\nc"),
    ("<p>a</p><template><div><template>none</template>none</div></template><p>b</p>", "a\nb"),
])
def test_silent_elements(page, text):
    assert html_text.main_texts([f"<article><h1>T</h1>{page}</article><footer>f</footer>"]) == [
        f"T\n{text}"]


@pytest.mark.parametrize("page, text", [
    ("<body><h1>T</h1><p>" + "some words " * 15 + "</p><ul><li>first step</li><li>second step</li></ul><p>" + "then more " * 12
     + "</p></body>", "T\n" + "some words " * 14 + "some words\nfirst step\nsecond step\n" + "then more " * 11 + "then more"),
    ("<article><p>By the formula <math><mi>a</mi><mo>=</mo><mi>b</mi></math> it holds.</p><p>x <math>y</p><p>z</article>",
     "By the formula a=b it holds.\nx y\nz"),
    ("<article><p>Write to</p><address>1 Main Street</address></article><address>us</address>", "Write to\n1 Main Street"),
    ("<article><p>a</p><!-- b > c", "a"), ("<article><p>a > b<!-- c", "a > b"), ("<article><p>a <b", "a <b"),
    ("<article><p>a</p><p title='x>b</p><p>c</p></article>d", None),
])
def test_nothing_else_goes(page, text):
    found = html_text.main_texts([page])[0]
    assert text is None or found == text


@pytest.mark.parametrize("part", ['<a t="', "<p x ", "<svg t='", '<b ">"', "<!-", "<", "<a t='>", "</", "<math ", "<li>"])
def test_a_million_characters_of_open_tags(part):
    import time
    at = time.process_time()
    for end in ("", ">", "x"):
        html_text.main_texts(["<article><p>start</p>" + part * (300_000 // len(part)) + end])
    assert time.process_time() - at < 6


BODY = "<h1>A title</h1><p>" + "one two " * 20 + "</p><p>" + "some more " * 20 + "</p>"


@pytest.mark.parametrize("page, kept", [
    *((f"{wrapper}<{name}>BODY</{name}>{'<p>word</p>' * 50}", True) for name in ("article", "main") for wrapper in (
        "<div class='content-sidebar-wrap'>", "<div class=has-sidebar>", "<div class='site header-fixed'>", "<form>", "<header>")),
    *((f"{wrapper}<div>BODY</div>", True) for wrapper in (
        "<div class='content-sidebar-wrap'>", "<div class=has-sidebar>", "<div class='site header-fixed'>", "<form action=x>", "<div class=has-comments>")),
    *((f"{wrapper}<article>BODY</article>", False) for wrapper in (
        "<nav>", "<aside>", "<footer>", "<ol class=comment-list>", "<div hidden>", "<div role=complementary>")),
    *((f"<article>{BODY * 2}{wrapper}BODY", False) for wrapper in ("<div class=sidebar>", "<form>", "<div class=comments><article>")),
    (f"<article>{BODY * 2}</article><div class=related><article>BODY</article></div>", False),
    ("<nav>menu</nav><div>BODY<p>here it is at the end</p></div>", True),
])
def test_wrappers(page, kept):
    other = html_text.main_texts([page.replace("BODY", "")])[0]
    found = html_text.main_texts([page.replace("BODY", BODY.replace("one two", "here it is"))])[0]
    assert (found.count("here it is") == 20 + page.count("here it is") and "A title" in found) if kept else found == other


def test_page_table(spark, small_batches):
    rows = [(i, None if i % 3 == 0 else f"<article><p>page {i}</p></article><nav>n</nav>", "u", 5) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int").repartition(4)
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect())) == [
        (i, "u", "" if i % 3 == 0 else f"page {i}", 0 if i % 3 == 0 else len(f"page {i}")) for i in range(30)]
    assert html_text.extract(pages.filter("false")).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, labels)
    assert set(docs.columns) < set(found.columns)
    rows = found.join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98
    kept = quality.survivors(docs, labels)
    assert kept.columns == docs.columns and kept.count() == found.filter("score >= 0.5").count()


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 1), (7, None, 0), (None, 1, 0), (9, 1, 1), (10, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality.score(awkward, labels).collect()
    assert len(found) == awkward.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert {r.score for r in quality.score(awkward, labels.filter("false")).collect()} == {0.5}
    assert quality.score(nothing, labels).count() == 0
    kept = quality.survivors(awkward, labels)
    assert kept.columns == awkward.columns
    rows = [tuple(r) for r in awkward.collect()]
    assert all(tuple(r) in rows for r in kept.collect())


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_rule_figures(spark, awkward, nothing):
    for frame in (awkward, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want = sorted((str(r.doc_id), *figures(r.text or "")) for r in frame.collect())
        found = rules.verdicts(frame).collect()
        assert sorted((str(r.doc_id), *r[1:6]) for r in found) == want
        for r in found:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.content_share >= 0.5)
    assert rules.verdicts(nothing).count() == 0


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(2)
    field = rules.Field(rng.normal(size=len(rules.FEATURES)), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        rows = rng.integers(0, 2, (n, len(rules.FEATURES))).astype(float)

        def score(labels, rows=rows):
            return sum(rows[i] @ field.weights for i, x in enumerate(labels) if x) + sum(
                field.pairs[a, b] for a, b in zip(labels, labels[1:]))

        every = [[m >> i & 1 for i in range(n)] for m in range(1 << n)]
        assert score(field.decode(rows)) == pytest.approx(max(map(score, every)))


def test_gradient_matches_differences():
    rows, labels = rules.lines_of("One line here.\nCopyright 2020\nshort\nAnother line of text, longer.")[0], np.array([1, 0, 0, 1])
    rng = np.random.default_rng(5)
    field = rules.Field(rng.normal(size=rows.shape[1]), rng.normal(size=(2, 2)))

    def likelihood(f):
        def score(y):
            return sum(rows[i] @ f.weights for i, x in enumerate(y) if x) + sum(f.pairs[a, b] for a, b in zip(y, y[1:]))
        return score(labels) - np.logaddexp.reduce([score([m >> i & 1 for i in range(4)]) for m in range(16)])

    weights, pairs = field.slope(rows, labels)
    for i in range(len(weights)):
        step = np.eye(len(weights))[i] * 1e-5
        up, down = (likelihood(field._replace(weights=field.weights + s * step)) for s in (1, -1))
        assert weights[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)
    step = np.array([[0, 1e-5], [0, 0]])
    up, down = (likelihood(field._replace(pairs=field.pairs + s * step)) for s in (1, -1))
    assert pairs[0, 1] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_labelled_lines_are_learnt():
    right = total = 0
    for lines, marks in rules.labelled_texts():
        found = rules.field().decode(rules.lines_of("\n".join(lines))[0])
        right += sum(a == (m == "+") for a, m in zip(found, marks))
        total += len(marks)
    assert right / total > 0.97
