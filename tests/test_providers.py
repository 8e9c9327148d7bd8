"""The provider source over a stub server and over files of answers."""

import json
import os
import threading
import time
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote_plus, urlsplit

import pytest
from pyspark.sql import functions as F

from factloom.sources import payloads, providers

NAMES = list(providers.READERS)


def answer(provider, query):
    k = len(query)
    if provider in providers.NEWS:
        return json.dumps({"articles": [{"url": f"https://a.com/{i}" if i != 2 else "", "title": f"Story {i} {query}", "description": f"about {i} [+{k} chars]", "content": "a longer body …" if i % 2 else None, "publishedAt": f"2024-0{i + 1}-05T10:00:00Z" if i else "soon", "source": {"name": "Desk"}} for i in range(8)]})
    if provider == "guardian":
        return json.dumps({"response": {"results": [{"webUrl": f"https://g.com/{i}", "webTitle": f"Web {i}", "webPublicationDate": f"2024-0{i + 1}-05T10:00:00Z", "fields": {"trailText": "<p>Trail  of</p>", "bodyText": "Body", **({"headline": f"Head {i}"} if i % 2 else {})}} for i in range(6)]}})
    if provider == "wikipedia":
        return json.dumps({"query": {"search": [{"title": f"Page of {i}", "snippet": "<b>some</b>  text"} for i in range(5)]}})
    if provider == "google_news":
        ends = [" - BBC News", " - The Times", " - what the bank said, and why it matters now!", "", " - A - B"]
        return "<rss><channel>" + "".join(f"<item><title>Rates {i}{ends[i % 5]}</title><link>https://www.Site{i}.com/x</link><pubDate>Fri, 0{i + 1} Mar 2024 00:00:00 GMT</pubDate><description>&lt;b&gt;So&lt;/b&gt; it  is</description>{'<source>BBC News</source>' if i == 0 else ''}</item>" for i in range(7)) + "</channel></rss>"
    return "<html>" + "".join(f'<a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fa.com%2F{i // 2}">A <b>story</b> {i}</a><a class="result__snippet">about  {i}</a>' for i in range(6)) + "</html>"


class Stub(BaseHTTPRequestHandler):
    seen: list = []
    failures: dict = {}

    def do_GET(self):
        parts = urlsplit(self.path)
        provider, asked = parts.path.strip("/"), {k: v[0] for k, v in parse_qs(parts.query).items()}
        Stub.seen.append((provider, asked))
        if asked["q"].startswith("hang"):
            time.sleep(3)
        left = Stub.failures.get((provider, asked["q"]), 0)
        Stub.failures[provider, asked["q"]] = left - 1
        body = ('{"status":"error","message":"refused"}' if asked["q"] == "refused" else '{"articles":[]}' if asked["q"] == "nothing" else answer(provider, asked["q"])).encode()
        self.send_response(500 if left > 0 else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def scan(spark, base, queries, **options):
    providers.register(spark)
    return spark.read.format("provider").options(base=base, queries=json.dumps(queries), **{k: str(v) for k, v in options.items()}).load()


def rows(frame):
    return sorted((r.provider, r.query, r.ord, r.url, r.title, r.snippet, r.text, r.source or "", str(r.published)) for r in frame.collect())


def test_rows_are_those_of_the_payloads(spark, tmp_path):
    """Answers kept as files give the rows that the payload parsers give."""
    queries = ["rates rise", "bank & co / more"]
    for p in NAMES:
        os.makedirs(tmp_path / p)
        for q in queries:
            (tmp_path / p / quote_plus(q)).write_text(answer(p, q))
    got = scan(spark, f"file://{tmp_path}", queries, keys="gnews,newsapi,guardian")
    pages = spark.createDataFrame([(q, p, answer(p, q)) for p in NAMES for q in queries], "query string, of string, payload string")
    parsed = [payloads.news_items(pages.filter(F.col("of") == n), n) for n in providers.NEWS]
    parsed += [payloads.full_text_items(pages.filter("of = 'guardian'")), payloads.feed_items(pages.filter("of = 'google_news'")), payloads.encyclopaedia_items(pages.filter("of = 'wikipedia'")), payloads.search_page_items(pages.filter("of = 'duckduckgo'"), 3)]
    want = [r for frame in parsed for r in rows(frame)]
    assert rows(got) == sorted(want) and len(want) > 40
    assert got.rdd.getNumPartitions() == len(NAMES) * len(queries)


def test_filters_reach_the_requests(spark, base):
    Stub.seen.clear()
    limit = datetime(2024, 4, 1, tzinfo=UTC)
    table = scan(spark, base, ["one", "two"], keys="gnews,newsapi,guardian").filter((F.col("published") >= F.lit(limit)) & F.col("provider").isin("gnews", "guardian", "wikipedia") & (F.col("query") == "two"))
    plan = table._jdf.queryExecution().explainString(table.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "published" in plan.split("PushedFilters")[1][:200] and "Filter (" not in plan
    got = table.collect()
    assert {(p, a["q"]) for p, a in Stub.seen} == {("gnews", "two"), ("guardian", "two"), ("wikipedia", "two")}
    asked = dict(Stub.seen)
    assert asked["gnews"]["from"] == "2024-04-01T00:00:00Z" and asked["guardian"]["from"] == "2024-04-01" and "from" not in asked["wikipedia"]
    assert sorted((r.provider, r.ord) for r in got) == [("gnews", i) for i in range(3, 8)] + [("guardian", i) for i in (3, 4, 5)]


def test_attempts_statuses_and_budget(spark, base):
    Stub.failures.update({("gnews", "late"): 2, ("gnews", "down"): 9})
    table = scan(spark, base, ["late", "down", "refused", "nothing"], keys="gnews", providers="gnews,newsapi", attempts=3)
    got = {(r.provider, r.query): r for r in table.collect()}
    assert (got["gnews", "late"].status, got["gnews", "late"].attempts) == ("success", 3)
    assert (got["gnews", "down"].status, got["gnews", "down"].attempts) == ("failed", 3) and "500" in got["gnews", "down"].error
    assert got["gnews", "refused"].error == "refused" and got["gnews", "nothing"].status == "no_results"
    assert {r.status for (p, _), r in got.items() if p == "newsapi"} == {"disabled"}
    began = time.time()
    late = scan(spark, base, [f"hang {i}" for i in range(3)] + ["quick"], providers="wikipedia,duckduckgo", budget=1).collect()
    assert time.time() - began < 20 and {r.status for r in late if r.query.startswith("hang")} == {"timeout"}
    assert all(r.error == providers.EXHAUSTED and r.url is None for r in late if r.status == "timeout")
    assert {r.status for r in scan(spark, base, ["q"], budget=0.000001).filter("enabled").collect()} == {"timeout"}


def test_recent_days_and_jobs_of_a_table(spark, base):
    Stub.seen.clear()
    recent = scan(spark, base, ["new"], providers="google_news,wikipedia", recent_days=7).collect()
    assert {(r.provider, r.status) for r in recent} == {("google_news", "success"), ("wikipedia", "disabled")} and Stub.seen[0][1]["q"] == "new when:7d"
    jobs = spark.createDataFrame([(i, p, f"q{i}", p != "gnews") for i in range(4) for p in ("gnews", "wikipedia")], "claim_id long, provider string, query string, enabled boolean").repartition(3)
    found = providers.fetch_results(jobs, base, budget=30).groupBy("claim_id", "provider", "status").count().collect()
    assert sorted((r.claim_id, r.provider, r.status, r["count"]) for r in found) == sorted([(i, "gnews", "disabled", 1) for i in range(4)] + [(i, "wikipedia", "success", 3) for i in range(4)])
    with pytest.raises(Exception, match="no such provider"):
        scan(spark, base, ["q"], providers="other").collect()


def test_pages_are_read_a_piece_at_a_time():
    """A batch of many pages comes in runs of bounded bytes, every row once; a longer page is a run of its own."""
    import pyarrow as pa

    from factloom.sources import payloads

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(9)), "html": ["x" * 40, None, "", "y" * 500, "z" * 30, None, "é" * 60, "q" * 90, ""]})
    found = list(payloads.pieces(batch, "html", 100))
    assert [i for p in found for i in p.column("page_id").to_pylist()] == list(range(9)) and len(found) > 3
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("html").to_pylist()[1:]) <= 100 for p in found)
    assert list(payloads.pieces(batch.slice(0, 0), "html")) == []
