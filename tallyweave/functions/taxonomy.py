"""Classification of policy texts into a fixed taxonomy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import plain, strip

#: Categories in their order with display name, aliases and keywords. The order breaks ties.
CATEGORIES = (
    ("education", "Education", ("school", "schools", "higher education", "learning"), ("education", "school", "teacher", "student", "university", "scholarship", "curriculum", "literacy")),
    ("finance", "Finance", ("fiscal", "budget", "economy", "economic policy", "public finance"), ("budget", "tax", "fiscal", "revenue", "bank", "banking", "treasury", "monetary", "inflation", "public spending")),
    ("governance", "Governance", ("good governance", "public administration", "anti corruption", "transparency", "accountability"), ("governance", "transparency", "accountability", "procurement", "anti corruption", "civil service", "public service delivery")),
    ("health", "Health", ("healthcare", "public health", "medical"), ("health", "hospital", "clinic", "doctor", "nurse", "medicine", "vaccination", "insurance")),
    ("infrastructure", "Infrastructure", ("public infrastructure", "basic infrastructure"), ("infrastructure", "drinking water", "water supply", "sanitation", "sewer", "construction", "public works")),
    ("agriculture", "Agriculture", ("farming", "farmers", "agri", "agro"), ("agriculture", "farmer", "farming", "irrigation", "crop", "livestock", "seed", "fertilizer", "dairy", "fisheries")),
    ("employment", "Employment", ("jobs", "job creation", "labor", "labour", "livelihood"), ("employment", "job", "jobs", "job creation", "unemployment", "skills training", "vocational", "labor", "labour")),
    ("social_protection", "Social Protection", ("social welfare", "welfare", "social security"), ("social protection", "social security", "welfare", "pension", "disability", "elderly", "child protection", "safety net")),
    ("environment", "Environment", ("environmental", "climate", "conservation"), ("environment", "climate", "pollution", "biodiversity", "conservation", "forest", "waste management", "emissions")),
    ("technology", "Technology", ("digital", "ict", "innovation"), ("technology", "digital", "internet", "broadband", "innovation", "ai", "data governance", "cybersecurity", "e governance")),
    ("justice", "Justice", ("judiciary", "legal", "law and justice"), ("justice", "court", "judiciary", "legal aid", "prosecution", "prison", "human rights")),
    ("federalism_local_governance", "Federalism & Local Governance", ("federalism", "local governance", "federalism local governance", "decentralization"), ("federalism", "local government", "municipality", "province", "provincial", "ward", "decentralization", "intergovernmental")),
    ("energy", "Energy", ("power", "electricity", "hydropower"), ("energy", "electricity", "power", "hydropower", "solar", "grid", "transmission")),
    ("transport", "Transport", ("transportation", "transit", "mobility"), ("transport", "transit", "mobility", "road", "highway", "rail", "railway", "bus", "airport", "aviation", "logistics")),
    ("tourism", "Tourism", ("tourist", "hospitality"), ("tourism", "tourist", "hospitality", "trekking", "destination", "heritage site")),
    ("housing_urban_development", "Housing & Urban Development", ("housing", "urban development", "urban planning", "city development", "settlement"), ("housing", "urban", "city planning", "affordable housing", "land use", "zoning", "urban development")),
    ("security", "Security", ("public safety", "defense", "defence"), ("security", "police", "policing", "defense", "defence", "military", "border security", "national security")),
    ("other", "Other", ("misc", "miscellaneous", "general"), ()),
)
PHRASE_SCORE, WORD_SCORE = 3, 1


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower().replace("&", " and ")).strip()


def aliases() -> dict[str, str]:
    """Slug by normalised alias; slugs and display names are aliases too, the first category wins."""
    found: dict[str, str] = {}
    for slug, display, names, _ in CATEGORIES:
        for name in (slug, display, *names):
            found.setdefault(_plain(name), slug)
    return found


def _score(text: Column, keywords: tuple[str, ...]) -> Column:
    """Phrases count anywhere in the text, words as whole words with a plural's s or es."""
    total = F.lit(0)
    for k in keywords:
        total = total + (F.when(F.contains(text, F.lit(k)), PHRASE_SCORE) if " " in k else F.when(text.rlike(rf"\b{k}(?:s|es)?\b"), WORD_SCORE)).otherwise(0)
    return total


def classify(raw_category: Column, *texts: Column) -> Column:
    """STRUCT<slug, display_name, source>: normalized by alias, inferred by keywords (the first of equal scores), or fallback."""
    known = F.create_map(*[F.lit(x) for pair in aliases().items() for x in pair])
    displays = F.create_map(*[F.lit(x) for s, d, _, _ in CATEGORIES for x in (s, d)])
    filled = [F.when(strip(t) != "", strip(t)) for t in (raw_category, *texts)]

    def best(text: Column) -> Column:
        # the highest score, and of equal scores the first in order
        ranked = [F.struct(_score(text, words).alias("score"), F.lit(-i).alias("order"), F.lit(slug).alias("slug")) for i, (slug, _, _, words) in enumerate(CATEGORIES)]
        return F.array_max(F.array(*ranked))

    def named(alias: Column, inferred: Column) -> Column:
        guess = F.when(inferred["score"] > 0, inferred["slug"])
        slug = F.coalesce(alias, guess, F.lit("other"))
        source = F.when(alias.isNotNull(), "normalized").when(guess.isNotNull(), "inferred").otherwise("fallback")
        return F.struct(slug.alias("slug"), F.element_at(displays, slug).alias("display_name"), source.alias("source"))

    # one-element arrays bind the normalised text and the best category, so that neither is evaluated for each keyword
    scored = F.transform(F.array(plain(F.concat_ws(" ", *filled))), best)
    return F.transform(scored, lambda b: named(F.element_at(known, plain(raw_category)), b))[0]
