"""Product cards of list pages that have been fetched already: (page_id, url, html)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CardRules:
    """Regular expressions: a whole card, and within a card name, price and image (one group each)."""

    card: str
    name: str
    price: str
    image: str


def extract_cards(pages: DataFrame, rules: CardRules) -> DataFrame:
    """(page_id, position, name, price, image); what a card lacks is null, a missing price is N/A."""
    cards = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(rules.card), F.lit(0))).alias("position", "card"))
    part = lambda rule: F.nullif(F.trim(F.regexp_extract("card", rule, 1)), F.lit(""))
    return cards.select("page_id", "position", part(rules.name).alias("name"), F.coalesce(part(rules.price), F.lit("N/A")).alias("price"), part(rules.image).alias("image"))
