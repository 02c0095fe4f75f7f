"""Jobs over tables of pages: body, title, links, Markdown. One vectorised pass per page."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.html import body_of, links_of, parse, title_of, to_markdown
from inkwell.functions.urls import normalize_url

#: Pages of a batch that are Python strings at a time; the others stay as Arrow holds them.
PAGES = 64


@F.pandas_udf(T.ArrayType(T.StringType()))
def _links(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([links_of(h or "", u or "") for h, u in zip(html, url, strict=True)], dtype=object)


def convert_pages(pages: DataFrame, selectors: Sequence[str] = (), html: str = "html", url: str = "url") -> DataFrame:
    """Adds title, markdown and error, in place of columns of these names. The body is the first element of the first selector that matches (default: main
    content, then body, then everything), its links are made absolute against the URL. A page that can't be converted,
    such as one without html, has its error and no text."""
    chosen = tuple(selectors)

    def made(page: str | None, at: str | None) -> dict:
        try:
            if page is None:
                raise ValueError("no html")
            body = body_of(parse(page), chosen)
            return {"title": title_of(body), "markdown": to_markdown(body, at or ""), "error": None}
        except Exception as e:  # noqa: BLE001  one bad page must not end the job
            return {"title": None, "markdown": None, "error": f"{type(e).__name__}: {e}"}

    @F.arrow_udf("title string, markdown string, error string")
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        kind = pa.struct([(c, pa.string()) for c in ("title", "markdown", "error")])
        parts = [pa.array([made(*p) for p in zip(pages.slice(at, PAGES).to_pylist(), urls.slice(at, PAGES).to_pylist(), strict=True)], kind) for at in range(0, len(pages), PAGES)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    made_here = ("title", "markdown", "error")
    # else a filter on error is pushed below, and every page converted twice, in two workers for each core
    once = run.asNondeterministic()
    return pages.withColumn("__made", once(F.col(html), F.col(url))).select(*(F.col(f"`{c}`") for c in pages.columns if c not in made_here), "__made.*")


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per link: src, dst. Targets are absolute and normalised; repeated links stay."""
    found = pages.select(F.col(url).alias("src"), F.explode(_links(F.col(html), F.col(url))).alias("dst"))
    return found.select("src", normalize_url("dst").alias("dst"))


def conversion_stats(converted: DataFrame, by: str = "source") -> DataFrame:
    """Pages, and how many of them were converted or failed, for each source."""
    return converted.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNull()).alias("converted"), F.count_if(F.col("error").isNotNull()).alias("failed"))

