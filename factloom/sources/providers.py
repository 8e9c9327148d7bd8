"""Search providers as a Spark data source, and as a step over a table of jobs.

``spark.read.format("provider")`` has a partition for each query with each
provider. Filters on provider and query choose the jobs; a lower bound of
``published`` becomes the date limit of the requests, and holds for the rows
that come back. A job has a few attempts; a job that the budget of time ends is a row with
status ``timeout``, as one without results is a row with its status alone.

Tables of jobs too many to be listed go through ``fetch_results``.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from email.utils import parsedate_to_datetime
from urllib.parse import quote, quote_plus, urlencode, urlsplit
from urllib.request import Request, urlopen
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull

from factloom.operators.search import PROVIDERS
from factloom.sources.payloads import page_links, unwrap

SCHEMA = (
    "provider string, query string, enabled boolean, status string, attempts int, error string, raw_result_count int, "
    "ord int, url string, title string, snippet string, text string, source string, published timestamp"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
RESULT = COLUMNS[7:]
EXHAUSTED = "search budget exhausted"
#: Seconds that one request may take, and the first pause before another attempt.
REQUEST_S, PAUSE_S = 10.0, 0.2
NEWS = ("gnews", "newsapi")


def flat(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text or "")).strip()


def moment(text: str | None) -> datetime | None:
    """A date of a feed or of JSON, in UTC; none if it is neither."""
    for parse in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            found = parse((text or "").strip())
        except (TypeError, ValueError):
            continue
        return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)
    return None


def news(payload: str) -> list[dict]:
    page = json.loads(payload)
    if page.get("status") == "error" or page.get("errors"):
        raise ValueError(str(page.get("message") or page.get("errors") or "error"))
    clean = lambda t: re.sub(r"\s*(?:\[\+\d+ chars\]|\[…\]|…)\s*$", "", t or "").strip()
    return [
        {"url": a.get("url"), "title": a.get("title"), "snippet": max(clean(a.get("description")), clean(a.get("content")), key=len), "source": (a.get("source") or {}).get("name"), "published": moment(a.get("publishedAt"))}
        for a in page.get("articles") or []
    ]


def full_text(payload: str) -> list[dict]:
    out = []
    for a in json.loads(payload).get("response", {}).get("results") or []:
        fields = a.get("fields") or {}
        title = fields["headline"] if fields.get("headline") is not None else a.get("webTitle")
        out.append({"url": a.get("webUrl"), "title": title, "snippet": flat(fields.get("trailText")), "text": fields.get("bodyText") or "", "source": "The Guardian", "published": moment(a.get("webPublicationDate"))})
    return out


def encyclopaedia(payload: str) -> list[dict]:
    found = json.loads(payload).get("query", {}).get("search") or []
    return [{"url": "https://en.wikipedia.org/wiki/" + a["title"].replace(" ", "_"), "title": a["title"], "snippet": flat(a.get("snippet")), "source": "Wikipedia"} for a in found]


def masthead(text: str) -> bool:
    return len(text) <= 40 and len(text.split()) <= 5 and bool(re.match("[A-Z0-9]", text)) and not re.search("[.!?:;]$", text)


def feed(payload: str) -> list[dict]:
    out = []
    for item in ElementTree.fromstring(payload).iterfind("channel/item"):
        title, link, named = item.findtext("title") or "", item.findtext("link") or "", item.findtext("source") or ""
        tail = m[1] if (m := re.search(r"\s+-\s+([^-]+)$", title)) else ""
        host = (urlsplit(link).netloc or "").lower()
        named = named or (tail if masthead(tail) and tail else host.removeprefix("www."))
        out.append({"url": link, "title": title[: m.start()] if m and title.endswith(f" - {named}") else title, "snippet": flat(item.findtext("description")), "source": named, "published": moment(item.findtext("pubDate"))})
    return out


def search_page(payload: str) -> list[dict]:
    seen = {}
    for url, title, snippet in page_links(payload):
        if url and title.strip():
            seen.setdefault(unwrap(url), {"url": unwrap(url), "title": " ".join(title.split()), "snippet": " ".join(snippet.split()), "source": ""})
    return list(seen.values())


READERS = {"gnews": news, "newsapi": news, "guardian": full_text, "google_news": feed, "wikipedia": encyclopaedia, "duckduckgo": search_page}
DATED = {name for name, _, dated, _ in PROVIDERS if dated}
MOST = {name: most for name, most, _, _ in PROVIDERS}


@dataclass(frozen=True)
class Settings:
    """Where and how jobs are asked. ``until`` is the end of the budget, in seconds since 1970; ``since`` the date limit; ``dated`` whether rows without a date go, those with a job's status alone too."""

    base: str
    until: float | None = None
    attempts: int = 3
    since: datetime | None = None
    after: bool = False
    dated: bool = False

    def left(self) -> float:
        return REQUEST_S if self.until is None else self.until - time.time()

    def address(self, provider: str, query: str) -> str:
        """Of a folder of answers, by provider and query; of a server, with the parameters of the provider."""
        if self.base.startswith("file:"):
            return f"{self.base}/{provider}/{quote(quote_plus(query))}"
        asked, more = query.strip(), {}
        if self.since is not None and provider == "google_news":
            days = max(1, -(-(datetime.now(UTC) - self.since - timedelta(hours=1)) // timedelta(days=1)))
            asked = f"{asked} when:{days}d"
        elif self.since is not None and provider in DATED:
            # This vendor takes a time, the others a day.
            more["from"] = self.since.strftime("%Y-%m-%dT%H:%M:%SZ" if provider == "gnews" else "%Y-%m-%d")
        if provider in NEWS:
            more["sortby" if provider == "gnews" else "sortBy"] = "publishedAt" if self.since is not None else "relevance" if provider == "gnews" else "relevancy"
        return f"{self.base}/{provider}?{urlencode({'q': asked, **more})}"

    def fits(self, published: datetime | None) -> bool:
        if published is None or self.since is None:
            return published is not None or not (self.dated or self.since)
        return published > self.since if self.after else published >= self.since


def ask(provider: str, query: str, enabled: bool, settings: Settings) -> Iterator[tuple]:
    """The rows of one job: its results, or one row with its status."""
    status, error, tries, found = "disabled" if not enabled else "timeout", None, 0, []
    while enabled and tries < max(1, settings.attempts):
        left = settings.left()
        if left <= 0:
            status, error = "timeout", EXHAUSTED
            break
        tries += 1
        try:
            with urlopen(Request(settings.address(provider, query), headers={"User-Agent": "factloom"}), timeout=min(REQUEST_S, left)) as answer:
                found = READERS[provider](answer.read().decode("utf-8", "replace"))
            status, error = "success" if found else "no_results", None
            break
        except Exception as e:  # noqa: BLE001  whatever a provider does, its job is a row
            status, error = "failed", str(e) or type(e).__name__
            if tries < settings.attempts:
                time.sleep(max(0.0, min(PAUSE_S * 2 ** (tries - 1), settings.left())))
    if status == "failed" and settings.left() <= 0:
        status, error = "timeout", EXHAUSTED
    rows = [(i, x) for i, x in enumerate(found[: MOST[provider]] if provider not in NEWS and provider != "guardian" else found) if x.get("url") and x.get("title")]
    rows = [(i, x) for i, x in rows if settings.fits(x.get("published"))]
    head = (provider, query, enabled, status, tries, error, len(found))
    for i, x in rows:
        yield (*head, i, x["url"], x["title"], x.get("snippet", ""), x.get("text", ""), x.get("source"), x.get("published"))
    if not rows and not settings.dated:
        yield (*head, *[None] * len(RESULT))


@dataclass
class Job(InputPartition):
    provider: str
    query: str
    enabled: bool
    until: float | None


class ProviderReader(DataSourceReader):
    def __init__(self, options):
        names = options.get("providers", ",".join(READERS)).split(",")
        self.providers, self.queries = [n.strip() for n in names], json.loads(options["queries"])
        keys = {k.strip() for k in options.get("keys", "").split(",")}
        self.enabled = {name: not needs or name in keys for name, _, _, needs in PROVIDERS}
        if unknown := set(self.providers) - set(READERS):
            raise ValueError(f"no such provider: {', '.join(sorted(unknown))}")
        budget = options.get("budget")
        self.budget, self.attempts = float(budget) if budget else None, int(options.get("attempts", 3))
        days = options.get("recent_days")
        self.base, self.since, self.after, self.dated = options["base"].rstrip("/"), datetime.now(UTC) - timedelta(days=int(days)) if days else None, False, False
        if days and "wikipedia" in self.enabled:
            self.enabled["wikipedia"] = False  # an undated reference is off for recent claims

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("provider",), ("query",)):
                wanted = set(f.value if isinstance(f, In) else (f.value,))
                if f.attribute == ("provider",):
                    self.providers = [p for p in self.providers if p in wanted]
                else:
                    self.queries = [q for q in self.queries if q in wanted]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("published",):
                bound = f.value.replace(tzinfo=UTC) if f.value.tzinfo is None else f.value.astimezone(UTC)
                if self.since is None or bound >= self.since:
                    self.since, self.after = bound, isinstance(f, GreaterThan) or (self.after and bound == self.since)
                self.dated = True  # a row without a date doesn't pass such a filter
            elif isinstance(f, IsNotNull) and f.attribute in (("provider",), ("query",), ("published",)):
                self.dated = self.dated or f.attribute == ("published",)
            else:
                yield f

    def partitions(self) -> list[Job]:
        until = None if self.budget is None else time.time() + self.budget  # it begins when the scan does
        return [Job(p, q, self.enabled[p], until) for q in self.queries for p in self.providers]

    def read(self, partition: Job) -> Iterator[tuple]:
        settings = Settings(self.base, partition.until, self.attempts, self.since, self.after, self.dated)
        yield from ask(partition.provider, partition.query, partition.enabled, settings)


class ProviderSource(DataSource):
    """Options: base (a server, or file: and a folder of answers), queries (a JSON list), providers, keys (names with a key), budget (seconds), attempts, recent_days."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSource)


def fetch_results(jobs: DataFrame, base: str, budget: float | None = None, attempts: int = 3, since: datetime | None = None) -> DataFrame:
    """The rows of ``jobs`` (claim_id, provider, query, enabled), with claim_id: asked where the jobs are, each partition one after the other."""
    settings = Settings(base.rstrip("/"), None if budget is None else time.time() + budget, attempts, since)

    def run(batches):
        for batch in batches:
            for job in batch.itertuples(index=False):
                rows = list(ask(job.provider, job.query, bool(job.enabled), settings))
                yield pd.DataFrame([(job.claim_id, *r) for r in rows], columns=["claim_id", *COLUMNS])

    return jobs.select("claim_id", "provider", "query", "enabled").mapInPandas(run, f"claim_id {dict(jobs.dtypes)['claim_id']}, {SCHEMA}")
