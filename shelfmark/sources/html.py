"""Listing cards in saved HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X, url as U

CARD_CLASS, HREF_MARKER = "goods-item", "/products?productLink="
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Where a card's image address may be, best place first.
_IMAGE_ATTRIBUTES = ("src", "data-src", "data-original", "data-lazy-src")
CARD = "pos int, href string, text string, title string, price string, num string, image string"


class _Cards(HTMLParser):
    """Collects link cards and the texts of their ``title``, ``price`` and ``num`` parts."""

    def __init__(self, card_class: str | None, marker: str):
        super().__init__(convert_charrefs=True)
        self.card_class, self.marker = card_class, marker
        self.cards: list[dict] = []
        self.card: dict | None = None
        self.open: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == "a":
            self._close()
            wanted = self.card_class is None or self.card_class in classes
            if wanted and "href" in a and self.marker in a["href"]:
                self.card = {"href": a["href"], "text": [], "title": None, "price": None, "num": None,
                             "image": "", "style": ""}
                self.open = [("a", None)]
            return
        if self.card is None:
            return
        if tag == "img":
            self._image(a)
        elif not self.card["style"] and any("img" in c for c in classes):
            self.card["style"] = a.get("style", "")
        if tag not in _VOID:
            part = next((p for p in ("title", "price", "num") if p in classes and self.card[p] is None), None)
            if part:
                self.card[part] = []
            self.open.append((tag, part))

    def _image(self, a: dict) -> None:
        if self.card["image"]:
            return
        found = next((a[n] for n in _IMAGE_ATTRIBUTES if a.get(n)), "")
        if not found:
            entries = (a.get("srcset") or a.get("data-srcset") or "").split(",")
            found = next((e.split()[0] for e in entries if e.split()), "")
        self.card["image"] = found

    def handle_endtag(self, tag):
        if self.card is None:
            return
        if tag == "a":
            self._close()
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data):
        if self.card is None or not data.strip():
            return
        self.card["text"].append(data.strip())
        for _, part in self.open:
            if part:
                self.card[part].append(data.strip())

    def _close(self):
        if self.card is not None:
            self.cards.append(self.card)
        self.card, self.open = None, []


def _background(style: str) -> str:
    _, _, rest = style.partition("url(")
    return rest.partition(")")[0].strip("\"' ")


def _read_cards(card_class: str | None, marker: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for key, html in zip(pages["_key"], pages["_html"]):
                parser = _Cards(card_class, marker)
                parser.feed(html or "")
                parser.close()
                parser._close()
                for pos, card in enumerate(parser.cards, 1):
                    parts = {p: " ".join(card[p]) if card[p] is not None else None for p in ("title", "price", "num")}
                    rows.append((key, pos, card["href"], " ".join(card["text"]), *parts.values(),
                                 card["image"] or _background(card["style"])))
            yield pd.DataFrame(rows, columns=["page_key", "pos", "href", "text", "title", "price", "num", "image"])

    return read


def extract_cards(pages: DataFrame, html: str = "html", key: str = "page_id", card_class: str | None = CARD_CLASS,
                  marker: str = HREF_MARKER, site: U.AgentSite = U.DEFAULT_AGENT, profile: str = "saved_page") -> DataFrame:
    """Listing cards of a table of pages: ``page_key, pos`` and the listing columns.

    Only finding the cards runs in Python; URLs, ids and file names are derived in the JVM.
    ``card_class=None`` with an empty ``marker`` takes every link.
    """
    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")).mapInPandas(
        _read_cards(card_class, marker), f"page_key {kind}, {CARD}"
    )
    source = U.product_link("href")
    staged = found.select(
        "page_key",
        "pos",
        F.col("href").alias(f"{site.name}_url"),
        source.alias("source_url"),
        X.clean_text(F.coalesce("title", "text")).alias("title"),
        X.clean_text("price").alias("price"),
        X.clean_text("num").alias("sales"),
        X.or_empty("image").alias("image_url"),
    )
    staged = staged.withColumn("offer_id", U.offer_id(f"{site.name}_url", "source_url", profile=profile))
    return staged.withColumns(
        {
            "source_1688_url": F.col("source_url"),
            "image_file": U.image_file("offer_id", "title", "image_url", profile),
        }
    )
