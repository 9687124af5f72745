"""URL rules as columns: normal form, document ids, validity, resolution of links."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import BANNED_EXTENSIONS
from docloom.functions.text import bind, col, strip


def normalize_url(url: Column | str) -> Column:
    """Without fragment and parameters, scheme and host in lower case, "/" for no path, no slash at the end."""

    def build(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        host = F.lower(F.regexp_extract(u, r"^[^:/?]+://([^/?]*)", 1))
        path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?]+://[^/?]*([^?]*)", 1), r";[^/]*$", "")
        query = F.regexp_extract(u, r"\?(.*)$", 1)
        path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/$", ""))
        return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))

    return bind(F.element_at(F.split(strip(url), "#", 2), 1), build)


def document_id(source: Column | str, url: Column | str) -> Column:
    return F.concat(F.regexp_replace(F.lower(col(source)), " ", "_"), F.lit("_"), F.substring(F.sha1(col(url).cast("binary")), 1, 12))


def chunk_id(doc: Column | str, position: Column | str) -> Column:
    return F.format_string("%s_chunk_%03d", col(doc), col(position))


def is_valid_url(url: Column | str, netloc: Column | str, patterns: Column | str) -> Column:
    """http(s), host containing `netloc`, no banned extension, and any of `patterns` in the URL."""
    u = col(url)
    host = F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)
    path = F.lower(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    banned = path.rlike("(" + "|".join(map(re.escape, BANNED_EXTENSIONS)) + ")$")
    return u.rlike("^https?://") & F.contains(host, col(netloc)) & ~banned & F.exists(col(patterns), lambda p: F.rlike(u, p))


def resolve_link(base: Column | str, link: Column | str) -> Column:
    """A link of a page against the URL of the page; null where it is no URL."""

    def one(b, x):
        try:
            return urljoin(b or "", (x or "").strip())
        except ValueError:
            return None

    @F.pandas_udf("string")
    def resolve(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([one(b, x) for b, x in zip(bases, links)], dtype=object)

    return resolve(col(base), col(link))
