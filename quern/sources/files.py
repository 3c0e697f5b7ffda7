"""Files as pages: PDF folders, JSON indexes, HTML, addresses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.ingest import dedup_lines

PAGE = "pdf string, title string, page int, text string"


def pdf_files(spark: SparkSession, folder: str, exclude: Iterable[str] = ()) -> DataFrame:
    """(path, pdf, title): the PDF files of a folder, without those whose lower-cased name is excluded; ordered by name.

    Only names are read here, no contents.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder).select("path")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    out = found.select("path", name.alias("pdf"), F.regexp_replace(name, r"(?i)\.pdf$", "").alias("title"))
    return out.where(~F.lower("pdf").isin(*[e.lower() for e in exclude] or [""])).orderBy("pdf")


def expected_files(files: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with an expected title, and the expected titles (title) without a file, both ordered by name."""
    want = titles.select("title").where("title is not null").distinct()
    have = files.join(want, "title", "left_semi").orderBy(F.lower("pdf"), "pdf")
    return have, want.join(files, "title", "left_anti").orderBy(F.lower("title"), "title")


def pdf_pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]], exclude: Iterable[str] = (), keep_pattern: str | None = None) -> DataFrame:
    """Pages (pdf, title, page, text) of a folder's PDF files.

    ``extract`` gives a file's page texts in order; pages count from 1, blank ones included, but
    blank pages, and with ``keep_pattern`` those without a match, are not emitted.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = extract(content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=["path", "page", "text"])

    pages = files.mapInArrow(run, "path string, page int, text string")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    clean = T.strip(F.replace("text", F.lit("\x00"), F.lit(" ")))
    out = pages.select(name.alias("pdf"), F.regexp_replace(name, r"(?i)\.pdf$", "").alias("title"), "page", clean.alias("text")).where("text != ''")
    out = out.where(~F.lower("pdf").isin(*[e.lower() for e in exclude] or [""]))
    return out if keep_pattern is None else out.where(F.col("text").rlike(keep_pattern))


def page_stats(pages: DataFrame) -> DataFrame:
    """One row: n_pages, n_arabic_pages, n_chars, n_arabic_chars of pages."""
    return pages.agg(
        F.count("*").alias("n_pages"),
        F.count_if(T.has_arabic(F.col("text"))).alias("n_arabic_pages"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit(T.ARABIC))), F.lit(0)).cast("long").alias("n_arabic_chars"),
    )


class _Tree(HTMLParser):
    """Text of a page by element: enough of a tree to choose the root of its content."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    SKIP = frozenset("script style nav footer noscript".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, list[str]]] = []
        self.found: dict[str, list[str]] = {}
        self.all: list[str] = []
        self.skipping = 0
        self.headings: list[tuple[str, list[str]]] = []

    def _roots(self, tag: str, attrs: dict) -> list[str]:
        classes = (attrs.get("class") or "").split()
        names = [tag] if tag in ("article", "main", "body") else []
        if attrs.get("role") == "main":
            names.append("role")
        return names + [c for c in ("post-content", "entry-content") if c in classes]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        held = dict(attrs)
        keep: list[str] = []
        for name in self._roots(tag, held):
            self.found.setdefault(name, keep)
        if tag in ("h1", "title"):
            self.headings.append((tag, []))
        self.skipping += tag in self.SKIP
        self.stack.append((tag, held, keep))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _, _ in self.stack]:
            return
        while self.stack:
            t, _, _ = self.stack.pop()
            self.skipping -= t in self.SKIP
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        open_tags = {t for t, _, _ in self.stack}
        for tag, parts in self.headings:
            if tag in open_tags and (tag, parts) == self._last(tag):
                parts.append(data)
        if self.skipping:
            return
        self.all.append(data)
        for _, _, keep in self.stack:
            keep.append(data)

    def _last(self, tag: str) -> tuple[str, list[str]]:
        return [h for h in self.headings if h[0] == tag][-1]


#: Content roots in order of preference.
ROOTS = ("article", "main", "role", "post-content", "entry-content", "body")


def read_html(html: str) -> tuple[str | None, str]:
    """Title (first non-empty h1, else title, else null) and text of the content root, one piece per line."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    title = None
    for tag in ("h1", "title"):
        texts = [" ".join("".join(parts).split()) for t, parts in tree.headings if t == tag]
        if texts and texts[0]:
            title = texts[0]
            break
    parts = next((tree.found[name] for name in ROOTS if name in tree.found), tree.all)
    return title, "\n".join(p.strip() for p in parts)


def html_pages(rows: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, title, text) of HTML rows: boilerplate elements gone, every line once; pages without text are dropped.

    The title falls back to the address. Null HTML has no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_html(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in read], pa.string()), pa.array([x for _, x in read], pa.string())], names=["url", "title", "text"])

    out = rows.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "url string, title string, text string")
    return out.select("url", F.coalesce("title", "url").alias("title"), dedup_lines(F.col("text")).alias("text")).where("text != ''")


def url_list(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """(url): the given addresses, normalised, empty ones dropped, each once."""
    return spark.createDataFrame([(u,) for u in urls], "url string").select(T.normalize_url(F.col("url")).alias("url")).where("url != ''").distinct()


def fetch(urls: DataFrame, timeout: float = 30.0, agent: str = "quern/1", opener: Callable[[str, float, str], str] | None = None, attempts: int = 1, pause: float = 0.0) -> DataFrame:
    """(url, html, error): pages fetched by the tasks; a failed address has its error and no page.

    Addresses of one host are fetched one after the other by one task, ``pause`` seconds apart, and
    each up to ``attempts`` times.
    """

    def default(url: str, seconds: float, name: str) -> str:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": name}), timeout=seconds) as r:  # noqa: S310
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    get = opener or default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                html, error = None, None
                for _ in range(max(1, attempts)):
                    if pause and out:
                        time.sleep(pause)
                    try:
                        html, error = get(url, timeout, agent), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((url, html, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["url", "html", "error"])

    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://([^/?#]+)", 1)
    return urls.select("url").repartition(host).mapInArrow(run, "url string, html string, error string")


def json_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, name_ar, aliases_ar, source_title, page_start, page_end, preview) of an index file; malformed files give no rows.

    The file holds one object with the records in ``saints``; records without a visible name are dropped.
    """
    record = "id string, name_ar string, aliases_ar array<string>, source_title string, page_start int, page_end int, preview string"
    schema = f"source_title string, generated_by string, saints array<struct<{', '.join(f.replace(' ', ': ', 1) for f in record.split(', '))}>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.explode("saints").alias("s")).select("s.*").where(T.strip(F.coalesce("name_ar", F.lit(""))) != "")


def write_json_index(records: DataFrame, source_title: str, path: str) -> None:
    """One object with statistics and records, as ``json_index`` reads it (the size of an index, not of a corpus)."""
    rec = F.struct(*[F.col(c) for c in ("id", "name_ar", "aliases_ar", "source_title", "page_start", "page_end", "preview")])
    one = records.agg(F.sort_array(F.collect_list(rec)).alias("saints")).select(F.lit(source_title).alias("source_title"), F.lit("quern").alias("generated_by"), F.struct(F.size("saints").alias("n_records")).alias("stats"), "saints")
    one.coalesce(1).write.mode("overwrite").json(path)
