"""Text normalisation, tokens and language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning, and words that many policy texts share.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "with",
    "will", "would", "can", "could", "should", "our", "we", "your", "within", "across", "all", "every", "through", "about",
)
WEAK_SIGNALS = (
    "access", "accountability", "agency", "agencies", "based", "better", "citizen", "citizens", "clear", "commission", "country",
    "delivery", "development", "driven", "effective", "ensure", "good", "government", "governance", "implementation", "improve",
    "improved", "independent", "institution", "institutions", "management", "modern", "modernize", "national", "nepal", "nepali",
    "nepalis", "office", "online", "performance", "policy", "process", "program", "programs", "public", "quality", "reform",
    "reforms", "service", "services", "state", "strategic", "strengthening", "support", "system", "systems", "targeted", "transparent",
    "transparency", "universal", "while",
)
CATEGORY_ALIASES = {"technology": "governance", "housing urban development": "infrastructure"}
#: Characters of a token at least, and the language heuristic's bounds.
MIN_TOKEN = 3
NATIVE_LEAST, LATIN_SHARE = 6, 0.85


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become a space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal(text: Column) -> Column:
    """Null is empty; lower case; white space collapsed."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def plain(text: Column) -> Column:
    """Lower case words of a-z and 0-9; an ampersand is the word "and"."""
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def category_key(text: Column) -> Column:
    """The category as the scorer compares it."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    out = words
    for name, other in CATEGORY_ALIASES.items():
        out = F.when(words == name, F.lit(other)).otherwise(out)
    return out


def tokens(*texts: Column) -> Column:
    """Distinct words in order of their first place: of some length, no stop words, not digits alone. One expression finds them, so no lambda runs."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    found = F.regexp_extract_all(joined, F.lit(f"(?=[0-9]*[a-z])[a-z0-9]{{{MIN_TOKEN},}}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def signals(words: Column) -> Column:
    """Tokens without the weak ones."""
    return F.array_except(words, F.array(*[F.lit(w) for w in WEAK_SIGNALS]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 if one side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_any(haystack: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: (n != "") & F.contains(haystack, n))


def clean_cid(text: Column) -> Column:
    """Without the marks that a failed font mapping leaves."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"\(cid:\d+\)", ""))


def garbled(text: Column) -> Column:
    """No text, a font mark, or over 0.3 of characters that are neither words, white space, comma nor point."""
    odd = F.length(F.regexp_replace(text, r"(?U)[\w\s,.]", ""))
    return F.coalesce(text, F.lit("")).eqNullSafe("") | F.contains(text, F.lit("(cid:")) | (odd > 0.3 * F.length(text))


def language(text: Column) -> Column:
    """STRUCT<code, confidence>: ne by script, en by its share of Latin letters, or unknown."""
    t = F.coalesce(text, F.lit(""))
    native = F.regexp_count(t, F.lit(r"[\x{0900}-\x{097F}]"))
    latin = F.regexp_count(t, F.lit("[A-Za-z]"))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    pair = lambda code, c: F.struct(F.lit(code).alias("code"), F.lit(c).alias("confidence"))
    return (
        F.when(strip(t) == "", pair("en", 1.0))
        .when((native >= NATIVE_LEAST) & (native > latin), pair("ne", 0.98))
        .when(letters == 0, pair("unknown", 0.2))
        .when(latin / letters >= LATIN_SHARE, pair("en", 0.85))
        .otherwise(pair("unknown", 0.4))
    )


def translation_outcome(residual_native: Column) -> Column:
    """STRUCT<confidence, ok> of a translated text: native characters that remain lower it below the bound of 0.70."""
    confidence = F.when(residual_native > 0, 0.55).otherwise(0.88)
    return F.struct(confidence.alias("confidence"), (confidence >= 0.70).alias("ok"))


def numbered_lines(response: Column, originals: Column) -> Column:
    """A numbered answer's texts, one for each original; the original where a line is missing."""
    lines = F.filter(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.contains(x, F.lit(".")))
    texts = F.transform(lines, lambda x: strip(F.substring(x, F.instr(x, ".") + 1, F.length(x))))
    return F.transform(originals, lambda o, i: F.coalesce(F.when(F.get(texts, i) != "", F.get(texts, i)), o))


def strip_fences(text: Column, how: str = "ends") -> Column:
    """Without a Markdown fence: around it ("ends"), wherever one stands ("all"), or without any backtick ("ticks")."""
    t = F.coalesce(text, F.lit(""))
    if how == "all":
        return strip(F.regexp_replace(t, r"```json|```", ""))
    if how == "ticks":
        return strip(F.regexp_replace(t, r"`json|`", ""))
    return strip(F.regexp_replace(F.regexp_replace(strip(t), r"^(?:```json)?(?:```)?", ""), r"```$", ""))


def payload_text(column: Column, kind: str = "string") -> Column:
    """The text of a value: a string that is JSON counts by its values in document order, keys left out, zero, false and null as well; another string
    as it is; structs, maps and arrays by their values. Parts are parted by a space, white space collapsed."""
    json = F.coalesce(strip(column), F.lit("")) if kind == "string" else F.coalesce(F.to_json(column), F.lit(""))
    # strings are taken whole, so what follows one tells a key from a value
    parts = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?|[^\s\[\]{},:"]+'), F.lit(0))
    values = F.filter(parts, lambda p: ~p.rlike(r'^"(?s:.*)"\s*:$') & ~p.isin("null", "false", "0", "0.0", "-0"))
    texts = F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")
    cleaned = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: collapse(F.when(x == "true", "True").otherwise(x))), lambda x: x != "")
    joined = F.array_join(cleaned, " ")
    if kind != "string":
        return joined
    return F.when(F.try_parse_json(json).isNotNull(), joined).otherwise(collapse(json))


def valid_email(text: Column) -> Column:
    return F.lower(strip(text)).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


#: What a failure says that another try may mend.
TRANSIENT = (
    "timeout", "temporarily unavailable", "connection reset", "connection aborted", "connection refused", "rate limit",
    "too many requests", "service unavailable", "429", "502", "503", "504",
)


def transient_error(message: Column) -> Column:
    """Whether a failure is worth another try."""
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(TRANSIENT))
