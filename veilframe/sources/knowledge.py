"""Literature connectors: guarded queries, injected fetching, replies parsed as columns."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_quote
from ..operators.egress import assert_safe

Fetch = Callable[[str, dict], str]
# The services' addresses.
PUBMED = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&retmax={limit}&term={query}"
PUBMED_PAGE = "https://pubmed.ncbi.nlm.nih.gov/{id}/"
SEMANTIC_SCHOLAR = "https://api.semanticscholar.org/graph/v1/paper/search?limit={limit}&fields=title,url,year&query={query}"
AWMF = "https://register.awmf.org/de/suche?search="


def pubmed(query: str, fetch: Fetch, limit: int = 5) -> list[dict]:
    assert_safe(query)
    key = os.environ.get("NCBI_API_KEY")
    url = PUBMED.format(limit=limit, query=quote_plus(query)) + (f"&api_key={quote_plus(key)}" if key else "")
    ids = json.loads(fetch(url, {})).get("esearchresult", {}).get("idlist", [])
    return [{"title": f"PubMed PMID {i}", "source": "pubmed", "url": PUBMED_PAGE.format(id=i), "year": None} for i in ids[:limit]]


def semantic_scholar(query: str, fetch: Fetch, limit: int = 5) -> list[dict]:
    assert_safe(query)
    key = os.environ.get("S2_API_KEY")
    found = json.loads(fetch(SEMANTIC_SCHOLAR.format(limit=limit, query=quote_plus(query)), {"x-api-key": key} if key else {})).get("data", [])
    return [{"title": x.get("title") or "Untitled paper", "source": "semanticscholar", "url": x.get("url") or "", "year": x.get("year")} for x in found[:limit]]


def guideline_link(query: Column) -> Column:
    """A link to the guideline register's search, as (title, source, url)."""
    return F.struct(F.concat(F.lit("AWMF guideline search: "), query).alias("title"), F.lit("guidelines:awmf").alias("source"), F.concat(F.lit(AWMF), url_quote(query)).alias("url"))


def parsed_pubmed(replies: DataFrame, limit: int = 5) -> DataFrame:
    """replies(query, body) -> (query, title, source, url, year), for bulk replies."""
    ids = F.slice(F.coalesce(F.from_json("body", "struct<esearchresult:struct<idlist:array<string>>>")["esearchresult"]["idlist"], F.array().cast("array<string>")), 1, limit)
    rows = replies.select("query", F.explode(ids).alias("id"))
    return rows.select("query", F.concat(F.lit("PubMed PMID "), "id").alias("title"), F.lit("pubmed").alias("source"), F.format_string(PUBMED_PAGE.replace("{id}", "%s"), "id").alias("url"), F.lit(None).cast("int").alias("year"))


def parsed_semantic_scholar(replies: DataFrame, limit: int = 5) -> DataFrame:
    listed = F.from_json("body", "struct<data:array<struct<title:string,url:string,year:int>>>")["data"]
    rows = replies.select("query", F.explode(F.slice(F.coalesce(listed, F.array().cast("array<struct<title:string,url:string,year:int>>")), 1, limit)).alias("p"))
    return rows.select("query", F.coalesce(F.nullif("p.title", F.lit("")), F.lit("Untitled paper")).alias("title"), F.lit("semanticscholar").alias("source"), F.coalesce("p.url", F.lit("")).alias("url"), "p.year")
