"""Stored HTML pages to plain text, links, images and scripts in one Arrow stage."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K

PAGE_SCHEMA = "page_id long, title string, text string, links array<struct<url:string,title:string>>, images array<string>, scripts array<string>"


def _page_reader():
    """The reader class, built inside so that it travels with the job as a value."""
    dropped = {"script", "style", "nav", "footer", "header", "noscript", "iframe"}
    void = {"br", "img", "meta", "link", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.parts, self.main = [], [], []
            self.title, self.links, self.images, self.scripts = [], [], [], []
            self.open_link = None

        def handle_starttag(self, tag, attrs):
            attrs = dict(attrs)
            if tag == "img" and attrs.get("src") and not self.hidden():
                self.images.append(attrs["src"])
            if tag in void:
                return
            kind = "content" if "content" in (attrs.get("class") or "").lower() else tag
            self.stack.append((tag, kind))
            if tag == "a" and attrs.get("href"):
                self.open_link = [attrs["href"], []]

        def handle_endtag(self, tag):
            if tag == "a" and self.open_link:
                self.links.append((self.open_link[0], " ".join("".join(self.open_link[1]).split())))
                self.open_link = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

        def hidden(self):
            return any(t in dropped for t, _ in self.stack)

        def handle_data(self, data):
            tags = [t for t, _ in self.stack]
            if tags and tags[-1] == "script":
                self.scripts.append(data)
            if self.open_link is not None:
                self.open_link[1].append(data)
            if tags and tags[-1] == "title":
                self.title.append(data)
            text = data.strip()
            if text and not self.hidden():
                self.parts.append(text)
                if any(t in ("main", "article") or k == "content" for t, k in self.stack):
                    self.main.append(text)

    return Reader


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id, html`` to title, main text, links, images and scripts, whole pages."""
    make = _page_reader

    def parse(batches):
        reader = make()
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                r = reader()
                r.feed(html or "")
                r.close()
                body = "\n".join(r.main or r.parts)
                text = re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", body))
                links = [{"url": u, "title": t} for u, t in r.links]
                out.append((page_id, "".join(r.title).strip(), text, links, r.images, r.scripts))
            yield pd.DataFrame(out, columns=["page_id", "title", "text", "links", "images", "scripts"])

    return pages.select("page_id", "html").mapInPandas(parse, PAGE_SCHEMA)


def page_digest(parsed: DataFrame, max_chars: int | None = None, images: int | None = None) -> DataFrame:
    """Title, text, image and document lines of a page as one text; whole unless ``max_chars`` is given."""
    shown = F.filter("images", lambda s: ~F.lower(s).rlike("|".join(K.DECORATIVE_IMAGE_WORDS)))
    docs = F.filter("links", lambda a: F.lower(a["url"]).contains(".pdf") | F.lower(a["title"]).rlike("cahier|pv|document|télécharger"))
    whole = F.concat_ws(
        "\n",
        F.when(F.col("title") != "", F.concat(F.lit("TITRE: "), F.col("title"))), F.col("text"),
        F.when(F.size(shown) > 0, F.concat(F.lit("\nIMAGES: "), F.array_join(shown if images is None else F.slice(shown, 1, images), ", "))),
        F.when(F.size(docs) > 0, F.concat(F.lit("\nDOCUMENTS: "), F.array_join(
            F.transform(docs, lambda d: F.concat(d["title"], F.lit(": "), d["url"])), ", "))))
    return parsed.withColumn("digest", F.left(whole, F.lit(max_chars)) if max_chars else whole)
