"""Column expressions over URLs and paths. All of them give null for null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
# Names of generated listings hold one of these words.
LISTING_WORDS = ("index", "latest", "toc", "genindex")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_url(url: Column | str, trailing_slash: bool = False) -> Column:
    """Scheme (lower case), host and path; no query, fragment or parameters of the last segment.

    Without a scheme or host the value stays as it is. trailing_slash adds one where it is missing."""
    url = _col(url)
    bare = F.regexp_replace(url, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^([^:]+://[^/]+/(?:[^/]*/)*[^/;]*);[^/]*$", "$1")
    scheme = F.lower(F.regexp_extract(bare, r"^([^:]+):", 1))
    whole = F.concat(scheme, F.regexp_extract(bare, r"^[^:]+(:.*)$", 1))
    if trailing_slash:
        whole = F.when(whole.endswith("/"), whole).otherwise(F.concat(whole, F.lit("/")))
    return F.when(F.rlike(url, F.lit(_ABSOLUTE)), whole).otherwise(url)


def is_target_url(url: Column | str, base_prefix: Column | str, exclusions: Sequence[str] | Column = ()) -> Column:
    """Does the URL begin with the base (a closing slash of it doesn't count) and with none of the exclusions?

    The test is textual. exclusions: literal prefixes, or an array column."""
    url = _col(url)
    base = F.lit(base_prefix) if isinstance(base_prefix, str) else base_prefix
    wanted = url.startswith(F.rtrim(base, F.lit("/")))
    if isinstance(exclusions, Column):
        return wanted & ~F.exists(exclusions, lambda x: url.startswith(x))
    for x in exclusions:
        wanted = wanted & ~url.startswith(x)
    return wanted


def url_path(url: Column | str) -> Column:
    """The path of a URL or of a reference without a scheme; empty if there is none."""
    bare = F.regexp_replace(_col(url), r"[?#].*$", "")
    return F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")


def file_path(url: Column | str, extension: str = ".html", strip_prefix: str = "", seed_url: str = "") -> Column:
    """Relative path under which a page is stored: the segments of its path without the prefix; ``_root_`` for the
    seed or an empty path; .html is swapped for .md, other endings get the extension added."""
    url, path = _col(url), url_path(url)
    if strip_prefix:
        cut = F.substring(path, F.lit(len(strip_prefix) + 1), F.length(path))
        path = F.when(path.startswith(strip_prefix), F.ltrim(cut, F.lit("/"))).otherwise(path)
    name = F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/")
    full = F.when(name.endswith(extension), name)
    if extension == ".md":
        full = full.when(name.endswith(".html") & ~path.endswith("/"), F.regexp_replace(name, r"\.html$", ".md"))
    full = full.otherwise(F.concat(name, F.lit(extension)))
    return F.when(url.isNull(), None).when((url == seed_url) | (name == ""), F.lit("_root_" + extension)).otherwise(full)


def path_url(path: Column | str, base_prefix: str) -> Column:
    """URL of a stored page that doesn't name its own: its path under the base, ``_root_.html`` taken out."""
    clean = F.regexp_replace(F.translate(_col(path), "\\", "/"), r"_root_\.html", "")
    return F.concat(F.lit(base_prefix.rsplit("/", 1)[0] + "/"), clean)


def with_source_meta(html: Column | str, source_url: Column | str) -> Column:
    """The page with its URL in a meta tag, first in its head or else in front of everything."""
    html, source_url = _col(html), _col(source_url)
    quoted = F.replace(F.replace(source_url, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    tag = F.concat(F.lit('<meta content="'), quoted, F.lit('" name="source-url"/>'))
    at = F.regexp_extract(html, r"(?is)^(.*?<head(?:\s[^>]*)?>)", 1)
    rest = F.substring(html, F.length(at) + F.lit(1), F.length(html))
    return F.concat(at, tag, rest)


def source_meta(html: Column | str) -> Column:
    """The URL in the page's source-url meta tag, null where there is none."""
    tag = F.regexp_extract(_col(html), r"(?is)(<meta\b[^>]*\bname\s*=\s*[\"']source-url[\"'][^>]*>)", 1)
    found = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.nullif(F.replace(F.replace(found, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit(""))


def recovered_url(html: Column | str, path: Column | str, base_prefix: str) -> Column:
    return F.coalesce(source_meta(html), path_url(path, base_prefix))


def doc_path_url(path: Column | str, base_url: str) -> Column:
    """URL of a documentation source file: slashes forward, no .txt, one slash at the end."""
    clean = F.regexp_replace(F.translate(_col(path), "\\", "/"), r"\.txt$", "")
    clean = F.when(clean.endswith("/"), clean).otherwise(F.concat(clean, F.lit("/")))
    return F.concat(F.lit(base_url.rstrip("/") + "/"), clean)


def is_listing(path: Column | str, words: Sequence[str] = LISTING_WORDS) -> Column:
    """Is it a table of contents by its file name? A substring test, so indexes.md and protocol.md are, too."""
    name = F.lower(F.regexp_extract(_col(path), r"([^/\\]*)$", 1))
    return F.rlike(name, F.lit("|".join(words)))


def is_html_page(content_type: Column | str, html: Column | str) -> Column:
    return F.contains(_col(content_type), F.lit("text/html")) & (F.length(_col(html)) > 0)
