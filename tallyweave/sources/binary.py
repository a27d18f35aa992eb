"""Pages of binary documents through a provider, a callable that a cluster supplies; nothing is called over a network here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.text import garbled

#: From this likeness of a text and its back translation on, the translation is sound.
SIMILAR_FROM = 0.60
HEADING = "????"


def pages(files: DataFrame, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """files: path, content. A row per page: page_num, text, rows (title_ne, budget)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = parse(bytes(content))
                yield pd.DataFrame({"path": [path] * len(found), "page_num": [p["page_num"] for p in found], "text": [p.get("text") for p in found], "rows": [p.get("rows", []) for p in found]})

    return files.select("path", "content").mapInPandas(run, "path string, page_num int, text string, rows array<struct<title_ne:string,budget:string>>")


def page_counts(files: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """path, n_pages: what the provider counts; 0 for a file that it cannot read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    out.append(int(count(bytes(content))))
                except Exception:  # noqa: BLE001
                    out.append(0)
            yield pd.DataFrame({"path": batch["path"], "n_pages": out})

    return files.select("path", "content").mapInPandas(run, "path string, n_pages int")


def page_images(files: DataFrame, wanted: DataFrame, render: Callable[[bytes, int, float], bytes], zoom: float = 2.0) -> DataFrame:
    """path, page_num, image of the wanted pages, as the provider draws them at that zoom; a file goes to one task with all its pages."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        content = bytes(rows["content"].iloc[0])
        pages_ = sorted(set(rows["page_num"]))
        return pd.DataFrame({"path": [key[0]] * len(pages_), "page_num": pages_, "image": [render(content, p, zoom) for p in pages_]})

    return files.select("path", "content").join(wanted.select("path", "page_num"), "path").groupBy("path").applyInPandas(run, "path string, page_num int, image binary")


def first_of(*providers: Callable[[str, int], list[dict]]) -> Callable[[str, int], list[dict]]:
    """A provider that asks these in turn until one has rows; one that fails counts as having none."""

    def rows_of(path: str, page: int) -> list[dict]:
        for ask in providers:
            try:
                found = ask(path, page)
            except Exception:  # noqa: BLE001
                continue
            if found:
                return found
        return []

    return rows_of


def table_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of readable pages, and the pages to be read by sight."""
    odd = garbled(F.col("text"))
    rows = parsed.filter(~odd).select("path", "page_num", F.explode("rows").alias("r")).select("path", "page_num", "r.*").filter(~F.contains("title_ne", F.lit(HEADING)))
    return rows.withColumn("budget_source", F.lit("deterministic")), parsed.filter(odd).select("path", "page_num")


def seen(rows_of: Callable[[str, int], list[dict]], wanted: DataFrame, most_empty: int = 3) -> DataFrame:
    """Rows that a provider reads from pages; a path's pages in order, until so many in a row give nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, empty = [], 0
        for path, page in pdf.sort_values("page_num")[["path", "page_num"]].itertuples(index=False):
            found = rows_of(path, page)
            empty = 0 if found else empty + 1
            out += [(path, page, r.get("title_ne"), r.get("budget"), "vision") for r in found]
            if empty >= most_empty:
                break
        return pd.DataFrame(out, columns=["path", "page_num", "title_ne", "budget", "budget_source"])

    return wanted.groupBy("path").applyInPandas(run, "path string, page_num int, title_ne string, budget string, budget_source string")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x.strip(), y.strip()).ratio() if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""))])


def similarity(a: Column, b: Column) -> Column:
    """The share of two texts that matching blocks cover; Spark has no like function."""
    return _ratio(a, b)


def translation_flag(original: Column, back: Column) -> Column:
    return F.when(similarity(original, back) >= SIMILAR_FROM, "ok").otherwise("uncertain")
