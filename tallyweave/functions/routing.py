"""Source types, scopes and strategies from paths and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import strip

#: Marks of a manifesto in a path, and those of a scanned one.
MANIFESTO = ("manifesto", "वाचा", "वाचा पत्र", "वाचापत्र", "बाचा", "बाचा पत्र", "बाचापत्र", "bacha patra", "bacha_patra", "vacha patra", "vacha_patra")
SCANNED = ("बाचा", "बाचा पत्र", "bacha patra", "bacha_patra", "vacha patra", "vacha_patra", "वाचा पत्र", "वाचापत्र", "बाचापत्र")
BUDGET_BOOKS = ("lalkitab", "redbook")
#: Fixed value: what marks a party's own files in their paths, unless another mark is passed.
PARTY_MARK = "rsp"
DETERMINISTIC = ("agenda_json", "manifesto_csv")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def suffix(path: Column) -> Column:
    """The extension with its point, lower case; empty where the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def source_type(path: Column, party_mark: str = PARTY_MARK) -> Column:
    """The first rule that holds."""
    lower, ext = F.lower(path), suffix(path)
    return (
        F.when(_any(lower, BUDGET_BOOKS), "lal_kitab")
        .when(_any(lower, MANIFESTO) | (F.contains(lower, F.lit(party_mark)) & (ext == ".csv")), "manifesto")
        .when(F.contains(lower, F.lit("agenda")) & (ext == ".json"), "manifesto")
        .when(F.contains(lower, F.lit("citizen")), "citizen")
        .when(_any(lower, ("media", "news")), "media")
        .otherwise("other")
    )


def source_subtype(path: Column, document: Column, kind: Column, party_mark: str = PARTY_MARK) -> Column:
    lower = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(document, F.lit(""))))
    ext = suffix(F.when(F.coalesce(path, F.lit("")) != "", path).otherwise(document))
    return (
        F.when((F.contains(lower, F.lit("agenda")) & (ext == ".json")) | ((ext == ".json") & (kind == "manifesto")), "agenda_json")
        .when(F.contains(lower, F.lit(party_mark)) & (ext == ".csv"), "manifesto_csv")
        .when((ext == ".pdf") & (kind == "manifesto"), F.when(_any(lower, SCANNED), "scanned_manifesto_pdf").otherwise("manifesto_pdf"))
        .otherwise(F.coalesce(kind, F.lit("other")))
    )


def scope(path: Column) -> Column:
    """STRUCT<level, province>: by whole segments of the path; the province is the file's folder."""
    parts = F.split(F.lower(path), "/")
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    make = lambda level, province: F.struct(F.lit(level).alias("level"), province.alias("province"))
    return F.when(F.array_contains(parts, "federal"), make("federal", F.lit(""))).when(F.arrays_overlap(parts, F.array(F.lit("provincial"), F.lit("province"))), make("provincial", folder)).otherwise(make("unknown", F.lit("")))


def fiscal_year(name: Column) -> Column:
    year = F.regexp_extract(F.coalesce(name, F.lit("")), r"(\d{4})[_-](\d{2})", 1)
    return F.when(year == "", "unknown").otherwise(F.concat(year, F.lit("/"), F.regexp_extract(name, r"(\d{4})[_-](\d{2})", 2)))


def strategy(subtype: Column, kind: Column, pages: Column, sample_rows: Column, sample_garbled: Column) -> Column:
    """STRUCT<strategy, confidence, requires_ocr, requires_vision, reason> of a document's plan; a budget book's by a sample of its pages."""

    def plan(name: str | Column, confidence: float, ocr: Column | bool, vision: Column | bool, reason: str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(name).alias("strategy"), F.lit(confidence).alias("confidence"), lit(ocr).alias("requires_ocr"), lit(vision).alias("requires_vision"), F.lit(reason).alias("reason"))

    sampled = F.greatest(F.lit(1), F.least(F.lit(5), F.when(pages > 0, pages).otherwise(5)))
    garbled, rows = sample_garbled / sampled, sample_rows / sampled
    book = F.when((sample_rows == 0) | (rows < 1.0) | (garbled >= 0.4), "vision").when((rows < 3.0) | ((pages > 80) & (garbled > 0.1)), "hybrid").otherwise("deterministic")
    return (
        F.when(subtype.isin(*DETERMINISTIC), plan("deterministic", 0.98, False, False, "structured source"))
        .when(subtype == "scanned_manifesto_pdf", plan("hybrid", 0.45, True, False, "scanned manifesto: provenance only, held for review"))
        .when(subtype == "manifesto_pdf", plan("hybrid", 0.72, True, False, "manifesto text and parsing"))
        .when(kind == "lal_kitab", plan(book, 0.62, book.isin("ocr", "hybrid"), book.isin("vision", "hybrid"), "by a sample of pages"))
        .otherwise(plan("hybrid", 0.55, True, False, "no budget source"))
    )


def ids_of(parameter: Column) -> Column:
    """A comma-separated parameter: trimmed, without blanks, distinct in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(parameter, F.lit("")), ","), strip), lambda x: x != ""))


def one_of(value: Column, allowed: tuple[str, ...], otherwise: str | Column) -> Column:
    """A manifest's choice, or the default for one that is blank or unknown."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    cleaned = strip(F.coalesce(value, F.lit("")))
    return F.when(cleaned.isin(*allowed), cleaned).otherwise(other)
