"""Ingestion: HTML to text, chunking, processing by content type, URL deduplication."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.gates import looks_like_html
from ..functions.text import cut_bytes, format_json, strip_fragment

BODY_BYTES = 10 << 20
#: The bytes of a chunk, and of a response's body.
CHUNK_BYTES, BODY_BYTES = 4000, 10 << 20


class _Markdown(HTMLParser):
    """Headings, paragraphs, links, lists, emphasis and code; scripts and styles are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[int | None] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote", "header", "footer", "tr"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n")
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = f"{self.lists[-1]}. " if self.lists and self.lists[-1] else "- "
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("p", "div", "tr") or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.skip:
            return
        if not self.pre:
            data = re.sub(r"\s+", " ", data)
            if self.out and self.out[-1][-1:] in (" ", "\n"):
                data = data.lstrip(" ")
        self.out.append(data)


def markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    lines = [line.rstrip() for line in "".join(parser.out).split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line if line.startswith("  ") else line.strip())
    return "\n".join(out).strip()


#: By rows, as ``chunks_of``: Arrow batches would hold ten thousand whole texts at a time in a worker.
html_to_markdown = F.udf(lambda x: None if x is None else markdown(x), T.StringType(), useArrow=False)


def _pieces(text: str, limit: int) -> list[str]:
    """At most ``limit`` bytes each, cut between characters; linear in the text."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        end = min(at + limit, len(raw))
        while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode("utf-8", "replace"))
        at = end
    return out


def chunk(text: str, limit: int = CHUNK_BYTES) -> list[str]:
    """Paragraphs packed greedily up to the limit; oversized ones are split; blank text is one chunk as it is."""
    out: list[str] = []
    current, size = [], 0
    for part in text.split("\n\n"):
        part = part.strip()
        if not part:
            continue
        n = len(part.encode("utf-8", "surrogatepass"))
        if n > limit or (current and size + n + 2 > limit):
            if current:
                out.append("\n\n".join(current))
            current, size = [], 0
        if n > limit:
            out += _pieces(part, limit)
            continue
        size += n + (2 if current else 0)
        current.append(part)
    if current:
        out.append("\n\n".join(current))
    return out or [text]


chunks_of = F.udf(lambda x: None if x is None else chunk(x), T.ArrayType(T.StringType()), useArrow=False)


def chunk_documents(docs: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(document, chunk_no, content), chunks from 0; null texts have none."""
    return docs.select(F.col(path_col).alias("document"), F.posexplode(chunks_of(F.col(text_col))).alias("chunk_no", "content"))


def processed(body: Column, content_type: Column) -> Column:
    """Indented JSON, Markdown of HTML (by type or by look), or the text itself."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    is_html = kind.contains("text/html") | kind.contains("application/xhtml") | ((kind == "") & looks_like_html(body))
    is_json = kind.contains("json")
    return F.when(is_json, format_json(F.when(is_json, body))).when(is_html, html_to_markdown(F.when(is_html & ~is_json, body))).otherwise(body)


def bare_content_type(header: Column) -> Column:
    """A content type without its parameters."""
    return F.when(F.instr(header, ";") > 1, F.trim(F.substring_index(header, ";", 1))).otherwise(header)


def response_texts(responses: DataFrame, max_bytes: int = BODY_BYTES) -> DataFrame:
    """Stored responses (url, status, content_type, body, format) as documents: url, content_type, content, truncated, error.

    A status outside of 200 to 299 is an error without content. A body is cut at ``max_bytes``, before a character that would be split. The
    format decides (markdown, html or json), and where it is empty or null the content type: HTML becomes Markdown, JSON is indented, and JSON that was cut is an
    error; all else is kept as it is. Other columns are carried along; null bodies count as empty.
    """
    body, status = F.coalesce(F.col("body"), F.lit("")), F.col("status")
    good = F.coalesce(status.between(200, 299), F.lit(False))
    read = responses.withColumn("_ok", good).withColumn("content_type", bare_content_type(F.coalesce(F.col("content_type"), F.lit(""))))
    read = read.withColumn("_body", cut_bytes(max_bytes)(body)).withColumn("truncated", good & (F.octet_length(body) > max_bytes))
    kind, want = F.lower(F.trim("content_type")), F.coalesce(F.col("format"), F.lit(""))
    html = kind.startswith("text/html") | kind.startswith("application/xhtml+xml")
    json = (want == "json") | ((want == "") & kind.contains("application/json"))
    to_markdown = ((want == "markdown") & (html | looks_like_html(F.col("_body")))) | ((want == "") & html)
    error = (
        F.when(~F.col("_ok"), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("?"))))
        .when(~want.isin("", "markdown", "html", "json"), F.concat(F.lit("unknown format: "), want))
        .when(json & F.col("truncated"), F.lit("JSON was cut at the size limit"))
    )
    with_error = read.withColumn("error", error).withColumn("_json", json & F.col("error").isNull()).withColumn("_html", to_markdown & F.col("error").isNull())
    content = F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("_json"), format_json(F.when(F.col("_json"), F.col("_body")))).when(F.col("_html"), html_to_markdown(F.when(F.col("_html"), F.col("_body")))).otherwise(F.col("_body"))
    return with_error.withColumn("content", content).drop("_ok", "_body", "_json", "_html", "body", "status", "format")


def distinct_urls(urls: DataFrame, order: str, url_col: str = "url") -> DataFrame:
    """URLs without fragments, each once, at its first place."""
    bare = urls.select(strip_fragment(F.col(url_col)).alias("url"), F.col(order).alias("pos"))
    return bare.groupBy("url").agg(F.min("pos").alias("pos"))
