"""Edges of bins, work done once, and where rows are dealt, as larger tables showed them."""

from pyspark.sql import functions as F

from factloom import more_queries
from factloom.functions.patterns import held, once
from factloom.operators import evaluation as V
from factloom.operators import features as T
from factloom.plans import verdict
from factloom.sources import payloads


def test_scores_on_an_edge_open_the_next_bin(spark):
    scores = spark.createDataFrame([(0.35 + 0.25, 1), (0.5 * 0.7 + 0.25, 0), (0.1 + 0.2, 1), (0.0, 0), (1.0, 1), (0.59, 0)], "p double, y int")
    assert {r.bin: r.n for r in V.calibration(scores).collect()} == {0: 1, 3: 1, 5: 1, 6: 2, 9: 1}


def test_tokens_are_counted_without_a_shuffle_of_tokens(spark):
    docs = spark.createDataFrame([(1, "The bank, the BANK raised"), (2, None), (3, " "), (4, "a b"), (4, "b a b")], "doc_id long, text string")
    counted = T.term_counts(docs)
    got = {(r.doc_id, r.token): (r["count"], r.total) for r in counted.collect()}
    assert got == {
        (1, "the"): (2, 9), (1, "bank"): (2, 9), (1, "raised"): (1, 9), (1, "the bank"): (2, 9), (1, "bank the"): (1, 9), (1, "bank raised"): (1, 9),
        (4, "a"): (2, 8), (4, "b"): (3, 8), (4, "a b"): (2, 8), (4, "b a"): (1, 8),
    }
    assert {r.token[1:]: r["count"] for r in T.term_counts(docs.filter("doc_id = 4"), None, (3, 4)).collect()} == {" a ": 2, " b ": 3}
    # One exchange, of texts; it was one of every token of every document.
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Generate" not in plan


def test_equal_texts_are_worked_on_once_and_dealt_evenly(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 4 else f"text {i % 5}") for i in range(40)], "id int, text string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(text):
        seen.add(1)
        return -1 if text is None else len(text)

    got = once(rows, {"text": F.col("text")}, lambda t: held(t, "n", length("text")))
    assert got.rdd.map(lambda r: (r.id, r.text, r.n)).collect() and seen.value == 5
    assert {(r.id, r.text, r.n) for r in got.collect()} == {(i, None if i % 5 == 4 else f"text {i % 5}", -1 if i % 5 == 4 else 6) for i in range(40)}


def test_claims_are_not_written_out_for_each_use(spark):
    claims = spark.createDataFrame([(1, "Breaking: The mayor resigned today", None)], "claim_id int, statement string, mode string")
    prepared = verdict.prepare(claims)
    # One of the patterns of normalising: each use of a claim had them all in it.
    assert prepared._jdf.queryExecution().optimizedPlan().toString().count(r"\bvia\s+@") == 1
    r = prepared.first()
    assert (r.claim, r.time.marker, r.time.anchor, r.route) == ("The mayor resigned today", "today", "recent", "search")


def test_search_pages_are_parsed_by_all_parts(spark):
    """Few bytes of equal texts were shuffled, so that one task parsed all the pages."""
    got = more_queries.search_page_payloads(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    shuffled = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "<div>" not in shuffled


def parsed(page):
    parser = payloads._Links()
    parser.feed(page)
    return parser.rows


def test_plain_search_pages_need_no_parser(monkeypatch):
    link, about = '<a class="x result__a" href="//d.com/l/?uddg=https%3A%2F%2Fa.com%2F%C3%A9&amp;rut=1">', '<td CLASS="result__snippet" title="a>b<c">'
    plain = [
        f"<!DOCTYPE html><!-- x -->A{link}A &amp; <b>b</b></a> c{about}d<br>e</td>f", f"{about}no link yet</td>{link}t<div>u</div>v", f"{link}t<script>var a = 1</script>u</A\n>v",
        '<a class="result__a">no target</a><a class="y" class="result__a" href="u" href="v">last</a>', '<a class="&#114;esult__a" href="q?a=1">named by a reference', f"{link}one{link}two", "<aA class=\"result__a\" href=\"n\">no link</aA>",
    ]
    odd = [
        f"{link}cut off &am", f"{link}a<br/>b</a>", f"{link}a<script>if (a<b) c</script>d</a>", "<a class=result__a href=u>t</a>", '<a class="result__a"href="u">t', f"{link}a </a x='>'> b", f"{link}<?x?>b<!--->c--></a>", f"{link}5 < 6",
        f"{link}<style>a&amp;b</style>", "no tag", "", "<", '<a class="result__a" href="u', '<a class="a\xa0result__a" href="//d.com/?x=1&uddg=a+b#uddg=c">t</a>',
    ]
    want = [parsed(page) for page in plain]
    assert [payloads.page_links(page) for page in plain + odd] == want + [parsed(page) for page in odd]
    assert want[0] == [["https://a.com/é", "A & b", "de"]]
    monkeypatch.setattr(payloads._Links, "feed", None)
    assert [payloads.page_links(page) for page in plain] == want


def test_short_redirects_are_read_as_urls():
    from urllib.parse import parse_qs, urlsplit

    for link in ("//d.com/l/?uddg=%C3%A9%FF%zz", "https://d.com/l/?uddg=a&uddg=b", "//d.com/?uddg=&uddg=b", "//d.com/?uddg=a+b", "//d.com/?uddg=a#&uddg=b", "/l/?uddg=a", "//d.com/?x=1", "//d.com:80/?uddg=é", "HTTP://D.com/L?uddg=A%20b"):
        assert payloads.unwrap(link) == parse_qs(urlsplit("https:" + link if link.startswith("//") else link).query).get("uddg", [link])[0]


def test_search_page_rows_keep_order_and_limit(spark):
    links = lambda places: "".join(f'<a class="result__a" href="u{i}"> t  {i} </a><a class="result__snippet">s {i}</a>' for i in places)
    pages = spark.createDataFrame([(1, links([3, 1, 3, *range(20)])), (2, None), (3, "<p>none</p>"), (4, '<a class="result__a" href="u"> </a>' + links([7]))], "page int, payload string")
    got = [(r.page, r.ord, r.url, r.title, r.snippet) for r in payloads.search_page_items(pages).orderBy("page", "ord").collect()]
    assert got == [(1, n, f"u{i}", f"t {i}", f"s {i}") for n, i in enumerate([3, 1, 0, 2, 4, 5, 6, 7, 8, 9])] + [(4, 0, "u7", "t 7", "s 7")]


def test_vectors_shuffle_no_tokens_of_documents(spark, tmp_path, monkeypatch):
    """TF-IDF over chunks equals that by joins, with a document of several rows, and what is written for it is less than a row for each token of a document."""
    from factloom import queries
    from factloom.operators import features as T

    rows = [(i % 57 if i % 9 else None, " ".join(f"w{(i * k * k) % (40 + i)}" for k in range(i % 50))) for i in range(120)] + [(900, None), (901, "!?"), (902, "lonelyword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(T, "CHUNK", 2000)
    terms = T.term_counts(docs)
    for smooth, sublinear, normalise, least in ((True, True, True, 2), (False, False, False, 1)):
        want = {(r.doc_id, r.token): r.value for r in T.tfidf(terms, T.vocabulary(terms, 123, least, smooth), sublinear, normalise).collect()}
        got = {(r.doc_id, t): v for r in T.vectors(docs, 123, min_df=least, smooth=smooth, sublinear=sublinear, normalise=normalise).collect() for t, v in zip(r.tokens, r["values"], strict=True)}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert T.vectors(docs.limit(0), 0).count() == 0
    monkeypatch.undo()
    spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(200))) for i in range(200)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.QUERIES["document_tfidf_vectors"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert queries.QUERIES["document_sparse_product"](spark, str(tmp_path)).count() == 200


def test_character_grams_are_counted_as_arrays(spark, monkeypatch):
    """Runs of characters, with and without runs of words, equal those counted word by word, which aren't used for them; longer ones are."""
    from factloom.operators import features as T

    rows = [(i % 70, " ".join(f"x{(i * k) % 13}y{'ab' * (k % 4)}" for k in range(i % 21))) for i in range(150)] + [(900, None), (901, "?"), (902, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {}
    for doc, text in rows:
        for grams, chars in ((None, (3, 5)), ((1, 2), (1, 3)), (None, (9, 10))):
            counts = want.setdefault((grams, chars), {})
            for token, n in T.grams_of((text or "").replace("?", "").split(), grams, chars).items():
                counts[doc, token] = counts.get((doc, token), 0) + n
    for (grams, chars), counts in want.items():
        total = {d: sum(n for (e, _), n in counts.items() if e == d) for d, _ in counts}
        got = {(r.doc_id, r.token): (r["count"], r.total) for r in T.term_counts(docs, grams, chars).collect()}
        assert got == {k: (n, total[k[0]]) for k, n in counts.items()}
    d, t, n = T.char_counts([[["ab"], ["ab", "c"]], []], 3, 5)
    assert dict(zip(zip(d.tolist(), t.to_pylist(), strict=True), n.tolist(), strict=True)) == {(0, "\x01 ab"): 2, (0, "\x01ab "): 2, (0, "\x01 ab "): 2, (0, "\x01 c "): 1}
