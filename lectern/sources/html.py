"""Web pages to text with a section map, and fetching behind an interface.

The tree is that of a lenient parser which closes no paragraph by itself: an end tag closes up to the
nearest open tag of its name, and one without such a tag is ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions.text import normalize_url
from lectern.providers import Fetcher

#: Tags of headings, paragraphs, what makes a paragraph an outer one, noise, tags without content.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "li", "td", "div", "blockquote", "pre"}
INNER = {"p", "li", "td", "div", "blockquote"}
NOISE = {"script", "style", "nav", "footer", "header", "aside", "noscript", "form", "button", "iframe"}
UNREAD = {"template", "rt", "rp"}  # what stands right in these is no text of the page
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"}
TOO_SHORT = "Page fetched but no usable text extracted. The site may require JavaScript. Try Paste Text instead."
NO_URL = "Please enter a URL."
TIMEOUT_SECONDS = 15
UNREACHABLE = {"timeout": "Request timed out (15s). Try Paste Text instead.", "connection": "Could not connect. Check the URL and try again."}


def fetch_error(kind: str, detail: str = "") -> str:
    """The message for a failed fetch: timeout, connection, http (detail: the status code), or another."""
    if kind == "http":
        return f"HTTP {detail}: page may require login or does not exist."
    return UNREACHABLE.get(kind) or f"Unexpected fetch error: {detail}"


class _Node:
    __slots__ = ("name", "texts", "inner", "noisy", "parent")

    def __init__(self, name: str, parent: _Node | None) -> None:
        self.name, self.parent, self.texts, self.inner = name, parent, [], False
        self.noisy = name in NOISE or (parent is not None and parent.noisy)


class _Reader(HTMLParser):
    """Tags in order of their start, with what they hold, and all text outside noise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.tags: list[_Node] = []
        self.texts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, self.open[-1] if self.open else None)
        self.tags.append(node)
        if tag in INNER:
            for above in self.open:
                above.inner = True
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text:
            return
        for node in self.open:
            if node.name in HEADINGS:
                node.texts.append(text)
        if not (self.open and (self.open[-1].noisy or self.open[-1].name in UNREAD)):
            self.texts.append(text)


def read_page(html: str | None, least: int = 100) -> tuple[str, dict[int, str], str]:
    """Text, section map and error of a page. Paragraphs are counted before noise is left out."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    sections: dict[int, str] = {}
    heading, at = "", 0
    for node in reader.tags:
        if node.name in HEADINGS:
            heading = "".join(node.texts)
        elif node.name in PARAGRAPHS and not node.inner:
            if heading:
                sections[at] = heading
            at += 1
    text = "\n".join(reader.texts).strip()
    return ("", {}, TOO_SHORT) if len(text) < least else (text, sections, "")


_DDL = "text string, section_map map<int,string>, err string"


def _rows(found: list[tuple[str, dict[int, str], str]]) -> list[pa.Array]:
    texts, maps, errors = zip(*found, strict=True) if found else ((), (), ())
    return [pa.array(texts, pa.string()), pa.array([list(m.items()) for m in maps], pa.map_(pa.int32(), pa.string())), pa.array(errors, pa.string())]


def load_pages(pages: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """page_id, url, text, section_map, err of stored pages (page_id, url, html)."""
    least = cfg.page_min_chars

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = _rows([read_page(h.as_py(), least) for h in part.column("html")])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], names=["page_id", "url", "text", "section_map", "err"])

    return pages.select("page_id", normalize_url("url").alias("url"), "html").mapInArrow(work, f"page_id long, url string, {_DDL}")


def load_urls(urls: DataFrame, fetcher: Callable[[], Fetcher], cfg: Settings = DEFAULT) -> DataFrame:
    """url, text, section_map, err of addresses (url), through a fetcher that is made once per worker."""
    least = cfg.page_min_chars

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = fetcher()
        for batch in batches:
            found = []
            for url in batch.column("url").to_pylist():
                html, err = client.fetch(url) if url else ("", NO_URL)
                found.append(("", {}, err) if err else read_page(html, least))
            yield pa.RecordBatch.from_arrays([batch.column("url"), *_rows(found)], names=["url", "text", "section_map", "err"])

    return urls.select(normalize_url("url").alias("url")).mapInArrow(work, f"url string, {_DDL}")


class HttpFetcher:
    """One GET per address with the standard library; errors are values, and so is a reply of over `max_bytes`, which isn't read to its end."""

    def __init__(self, timeout: float = TIMEOUT_SECONDS, agent: str = "Mozilla/5.0 (X11; Linux x86_64) lectern", max_bytes: int = 64 << 20) -> None:
        self.timeout, self.agent, self.max_bytes = timeout, agent, max_bytes

    def fetch(self, url: str) -> tuple[str, str]:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as reply:  # noqa: S310
                body = reply.read(self.max_bytes + 1)
                if len(body) > self.max_bytes:
                    return "", fetch_error("other", f"over {self.max_bytes} bytes")
                return body.decode(reply.headers.get_content_charset() or "utf-8", "replace"), ""
        except HTTPError as e:
            return "", fetch_error("http", str(e.code))
        except TimeoutError:
            return "", fetch_error("timeout")
        except URLError as e:
            return "", fetch_error("timeout" if isinstance(e.reason, TimeoutError) else "connection")
        except Exception as e:  # noqa: BLE001
            return "", fetch_error("other", str(e))


def sections(loaded: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each entry of the section maps."""
    return loaded.select(key, F.explode("section_map").alias("para_idx", "section"))
