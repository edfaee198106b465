"""Remote sources. Listings and searches are read by the data source of listing.py, a partition a package or query, pages
landed one by one; bodies are asked for row by row and landed in waves. DataFrame stages parse what is landed. With `folder`
a later run takes up one that died: neither a landed page nor a landed body is asked for again.

transport(url, params, headers) -> (status, headers, body bytes), and goes to the executors. Only status 429 is tried
again; other failures by status skip the row. A failed connection loses its row, which the next run with the folder asks for;
in a listing it ends the task, and Spark's next attempt goes on from the page."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from . import files
from .landing import answers, fresh, landed
from .listing import Walk, listing

Transport = Callable[[str, dict | None, dict], tuple[int, dict, bytes]]

#: Public service addresses, and the default acts (type, year, number).
CODE_API, CODE_CONTENT = "https://api.govinfo.gov", "https://www.govinfo.gov/content/pkg"
JUDGMENT_API = "https://www.courtlistener.com/api/rest/v4"
ACT_SITE = records.ACT_SITE
DEFAULT_ACTS = (
    ("ukpga", 2006, 35), ("ukpga", 1968, 60), ("ukpga", 1971, 38), ("ukpga", 1971, 48), ("ukpga", 1861, 100),
    ("ukpga", 1986, 64), ("ukpga", 2003, 42), ("ukpga", 2015, 30), ("ukpga", 2010, 23),
)
DEFAULT_QUERY = "bank robbery OR fraud OR theft OR burglary OR assault OR murder OR forgery"
AGENT = {"User-Agent": "loomline/0.1"}


def http(url: str, params: dict | None, headers: dict) -> tuple[int, dict, bytes]:
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url + ("?" + urlencode(params) if params else ""), headers=headers), timeout=60) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()


def get(transport: Transport, url: str, params: dict | None = None, headers: dict | None = None, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes]:
    for attempt in range(retries + 1):
        status, back, body = transport(url, params, AGENT | (headers or {}))
        if status != 429 or attempt == retries:
            break
        sleep(float(back.get("Retry-After") or 2**attempt))
    return status, body


def fetch(
    rows: DataFrame, url: str = "url", transport: Transport = http, params: dict | None = None, headers: dict | None = None, pause: float = 0.0, at_once: int = 4, folder: str | None = None,
) -> DataFrame:
    """The rows with status, body and error, one request a url: no body is landed of a failed connection. The connections at
    once are bounded by `at_once` tasks."""

    def start() -> Callable[[tuple], tuple]:
        return lambda values: get(transport, values[0], params, headers)

    return answers(rows, [url], start, "status int, body binary", f"{folder.rstrip('/')}/bodies" if folder else fresh(rows.sparkSession, "bodies"), tasks=at_once, pause=pause)


def _ok(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").between(200, 299))


def _json(transport: Transport) -> Callable[[str, dict | None, dict], dict]:
    def ask(url: str, params: dict | None, headers: dict) -> dict:
        status, body = get(transport, url, params, headers)
        if not 200 <= status < 300:
            raise OSError(f"{url}: status {status}")
        return json.loads(body)

    return ask


@dataclass
class Granules(Walk):
    """The leaves of a package, page after page, up to `most`."""

    key: str = field(repr=False)
    most: int | None = None
    size: int = 100

    def name(self, job):
        return super().name(job) | {"most": self.most, "size": self.size}

    def first(self, job):
        return None if self.most == 0 else {"url": f"{CODE_API}/packages/{job['package']}/granules", "params": {"pageSize": self.size, "offsetMark": "*"}, "left": self.most}

    def request(self, cursor):
        return cursor["url"], cursor["params"] | {"api_key": self.key}, {}

    def page(self, cursor, data):
        leaves = [g for g in data.get("granules", []) if g.get("granuleClass") == "LEAF"][: cursor["left"]]
        left = None if cursor["left"] is None else cursor["left"] - len(leaves)
        onward = data.get("nextPage")
        return leaves, {"url": onward, "params": {}, "left": left} if onward and left != 0 else None


def _granule_records(rows: DataFrame) -> DataFrame:
    """granule_id, title, year, fallback, status, body -> records; no heading in the page: the listing's title."""
    pages = _ok(rows).select("granule_id", "title", "year", "fallback", F.decode("body", "utf-8").alias("html"))
    out = files.html_sections(pages, "granule_id", "html", keep=("title", "year", "fallback")).withColumnRenamed("id", "granule_id")
    return records.code_granules(out.withColumn("heading", F.coalesce(F.nullif("heading", F.lit("")), "fallback", F.lit(""))))


def code_sections(spark: SparkSession, granule_ids: list[str], year: int = 2023, title: str = "18", transport: Transport = http, folder: str | None = None) -> DataFrame:
    """Hand-picked sections by their content addresses; no key."""
    base = f"{CODE_CONTENT}/USCODE-{year}-title{title}/html/"
    rows = spark.createDataFrame([(g, title, year, None, f"{base}{g}.htm") for g in granule_ids], "granule_id string, title string, year int, fallback string, url string")
    return _granule_records(fetch(rows, transport=transport, folder=folder))


def code(
    spark: SparkSession, titles: tuple[str, ...] = ("18",), year: int = 2023, key: str | None = None, max_sections: int | None = None, xml: str | None = None, transport: Transport = http, folder: str | None = None,
) -> DataFrame:
    """All sections of some titles: from local XML, or by listing and fetching. max_sections bounds what is fetched of
    each title by what earlier ones have written, so a failed fetch isn't made up for; then titles come one after the other."""
    if xml is not None:
        return records.code_sections(files.code_xml(spark, xml))
    from .settings import setting

    key = key or setting("GOVINFO_API_KEY", "DEMO_KEY")
    out = spark.createDataFrame([], records.SCHEMA)

    def part(some: tuple[str, ...], most: int | None) -> DataFrame:
        jobs = [{"title": t, "package": f"USCODE-{year}-title{t}"} for t in some]
        listed = listing(spark, jobs, "title string, package string", Granules(key, most), _json(transport), f"{folder.rstrip('/')}/listings" if folder else None)
        g = F.from_json("raw", "granuleId string, title string")
        url = F.concat(F.lit(f"{CODE_API}/packages/"), "package", F.lit("/granules/"), g["granuleId"], F.lit("/htm"))
        rows = listed.select(g["granuleId"].alias("granule_id"), "title", F.lit(year).alias("year"), F.coalesce(g["title"], F.lit("")).alias("fallback"), url.alias("url"))
        return _granule_records(fetch(rows, transport=transport, params={"api_key": key}, folder=folder))

    if max_sections is None:
        return part(tuple(titles), None) if titles else out
    left = max_sections
    for title in titles:
        if left <= 0:
            break
        got = landed(part((title,), left), "records")
        left -= got.count()
        out = out.unionByName(got)
    return out


HIT = """opinions array<struct<id:string,snippet:string>>, caseName string, caseNameFull string, citation string, court string, court_id string,
 court_citation_string string, dateFiled string, docketNumber string, cluster_id string, absolute_url string"""
OPINION = "id string, plain_text string, html_with_citations string, html string, author_str string, page_count string"


@dataclass
class Hits(Walk):
    """Hits of a query, page after page, until `most` of them have a snippet: those are sure to become records."""

    most: int
    token: str | None = field(default=None, repr=False)
    size: int = 20
    order: str = "score desc"

    def name(self, job):
        return super().name(job) | {"most": self.most, "size": self.size, "order": self.order}

    def first(self, job):
        asked = {"type": "o", "q": job["query"], "page_size": self.size, "order_by": self.order} | ({"court": job["court"]} if job.get("court") else {})
        return {"url": f"{JUDGMENT_API}/search/", "params": asked, "sure": 0} if self.most > 0 else None

    def request(self, cursor):
        return cursor["url"], cursor["params"], {"Authorization": f"Token {self.token}"} if self.token else {}

    def page(self, cursor, data):
        out, sure = [], cursor["sure"]
        for hit in data.get("results", []):
            if sure >= self.most:
                break
            sure += bool(((hit.get("opinions") or [{}])[0].get("snippet") or "").strip())
            cites = hit.get("citation")
            out.append(hit | {"citation": json.dumps(cites) if isinstance(cites, list) else cites})
        return out, {"url": data["next"], "params": None, "sure": sure} if data.get("next") and sure < self.most else None


def judgments(
    spark: SparkSession, query: str = DEFAULT_QUERY, court: str | None = None, max_docs: int = 50, token: str | None = None, page_size: int = 20,
    order_by: str = "score desc", full_bodies: bool = True, max_chars: int = 8000, pause: float = 0.4, transport: Transport = http, folder: str | None = None,
) -> DataFrame:
    """Search, then bodies if there is a token. A hit counts if it has a snippet, or a body is to be fetched for it."""
    from .settings import setting

    token = token or setting("COURTLISTENER_API_TOKEN")
    jobs = [{"query": query, "court": court}]
    listed = listing(spark, jobs, "query string, court string", Hits(max_docs, token, page_size, order_by), _json(transport), f"{folder.rstrip('/')}/listings" if folder else None)
    table = listed.select("position", F.from_json("raw", HIT).alias("h")).select("position", "h.*")
    if not (full_bodies and token):
        return records.judgments(table, None, max_chars, max_docs)
    ids = table.select(F.try_element_at("opinions", F.lit(1))["id"].alias("id")).where("id is not null").distinct()
    got = _ok(fetch(ids.withColumn("url", F.concat(F.lit(f"{JUDGMENT_API}/opinions/"), "id", F.lit("/"))), transport=transport, headers={"Authorization": f"Token {token}"}, pause=pause, folder=folder))
    opinions = got.select("id", F.from_json(F.decode("body", "utf-8"), OPINION).alias("o")).select("id", *(f"o.{c}" for c in ("plain_text", "html_with_citations", "html", "author_str", "page_count")))
    return records.judgments(table, opinions, max_chars, max_docs)


def acts(spark: SparkSession, statutes: tuple = DEFAULT_ACTS, max_sections: int | None = None, transport: Transport = http, folder: str | None = None) -> DataFrame:
    """One request an act; acts that fail by status are left out."""
    rows = spark.createDataFrame([(t, y, n, f"{ACT_SITE}/{t}/{y}/{n}/data.xml") for t, y, n in statutes], "act_type string, year int, number int, url string")
    return records.act_sections(files.acts_xml(_ok(fetch(rows, transport=transport, folder=folder)), max_sections))


def bailii(*_: object, **__: object) -> DataFrame:
    raise NotImplementedError("there is no ingestion for this source")
