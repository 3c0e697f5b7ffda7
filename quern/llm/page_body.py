"""Problem 2: the main body of a page, by composite text density.

A page comes as one line per text block, so its tree is rebuilt first: the page
has a section before its first voice ("so-and-so says:") and one from each voice
on; a section's children are its lines. Lines the site repeats on many pages,
lines with separators, teasers and the entries of a list of links are link
characters; every line is a tag, a line with separators one for each part.

Composite text density is characters per tag, times a logarithm that falls with
the share of link characters; it is computed for every line, every section and
the page. The section with the largest sum of its lines' densities is the body;
the subtree also takes in what stands before it and sections with a large share
of all sums. Within it, lines as dense as the least dense node on the path up to
the page stay, and headings that introduce one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import site_lines
from quern.llm.scratch import materialize

#: A line is part of a site's frame if it is on this share of its pages, and on this many.
FRAME_SHARE = 0.10
FRAME_PAGES = 5
#: Share of the sites, and number of them, whose frame a line is in, from which it is furniture on any site.
COMMON_FRAME_SHARE, COMMON_FRAME_SITES = 0.02, 2
#: Share of a page's density sums from which a voice's section of several paragraphs belongs to the body beside the largest.
ARTICLE_SHARE = 0.25
#: Share of the least density on the path to the page that a line within the body has at least: list entries of two
#: words are less dense than a page with few links (at 1, 24 of 30902 body lines are lost on sf0.1, up to 0.5 none).
PATH_SHARE = 0.25
#: Characters from which a line without closing punctuation still reads as text.
PARAGRAPH_CHARS = 80

_SEPARATED = re.compile(r"\s[|·»>/]\s|\s{3,}|^[«»‹›]|[«»‹›]$")
_END = re.compile(r"[.!?؟。:；;][\"'”’»)\]]*$")
_QUOTED = re.compile(r"[”»\"]$")
_QUESTION = re.compile(r"[?؟]$")
_TEASER = re.compile(r"(…|\.\.\.)$")
_ITEM = re.compile(r"^([•‣▪*–—-]|\(?\d{1,3}[.)])\s+\S")
_DATE = re.compile(r"^\W*(\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}\.? \w{3,12}\.? \d{4})\W*$")
_LETTER = re.compile(r"[^\W\d_]")
# Words that open a by-line in the languages of the pages.
_BYLINE = re.compile(r"^(by|written by|published by|posted by|from the|par|publié par|écrit par|de la rédaction|von|por|publicado por|escrito por|بقلم|إعداد|كتبه|كتبها|نشره|نشرها)\s+\S", re.I)
# How prompts begin in the languages of the pages.
_PROMPT = re.compile(r"^(subscribe|sign up|abonnez-vous|inscrivez-vous|suscr[ií]b|abonnieren|اشترك|read more|lire la suite|leer más|weiterlesen|اقرأ المزيد)(?!\w)", re.I)
_ROLE = re.compile(r"^[^\W\d_]+([ '-][^\W\d_]+)?\s*[,،]\s*[^\W\d_]+$")


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


def _headlines(title: str | None, crumbs: list[str]) -> set[str]:
    """What the page may be called: the title, its parts without the site's name, the last breadcrumb."""
    out = {_letters(c) for c in crumbs}
    if title:
        out.add(_letters(title))
        out |= {_letters(part) for part in re.split(r"\s(?:[|–—»«:·-]|::)\s", title)}
    return out - {""}


class Line:
    """A line of the page: its kind and its characters."""

    __slots__ = ("kind", "chars", "parts")

    def __init__(self, text: str, framed: bool, headlines: set[str]) -> None:
        t = text.strip()
        self.chars = len(t)
        self.parts = 1
        n_words = len(t.split())
        if not _LETTER.search(t):
            self.kind = "blank" if not t else "date"
        elif framed or _SEPARATED.search(t) or (_PROMPT.match(t) and n_words <= 12 and not _END.search(t)):
            self.kind = "link"
            self.parts += len(_SEPARATED.findall(t))
        elif _DATE.match(t):
            self.kind = "date"
        elif _letters(t) in headlines:
            self.kind = "headline"
        elif _TEASER.search(t):
            self.kind = "teaser"
        elif t.endswith(":") and n_words <= 4:
            self.kind = "voice"
        elif _ITEM.match(t):
            self.kind = "item"
        elif _QUESTION.search(t) and n_words <= 12:
            self.kind = "heading"
        elif (_END.search(t) or _QUOTED.search(t)) and n_words >= 3 or self.chars >= PARAGRAPH_CHARS:
            self.kind = "text"
        elif _BYLINE.match(t) and self.chars < 60 or (_ROLE.match(t) and n_words <= 3):
            self.kind = "byline"
        else:
            self.kind = "heading"

    @property
    def is_text(self) -> bool:
        return self.kind in ("text", "item")


class Node:
    """Characters, link characters, tags and link tags of a subtree."""

    __slots__ = ("chars", "link_chars", "tags", "link_tags")

    def __init__(self) -> None:
        self.chars = self.link_chars = self.tags = self.link_tags = 0

    def add(self, line: Line) -> None:
        if line.kind == "blank":
            return
        self.chars += line.chars
        self.tags += line.parts
        if line.kind in ("link", "teaser"):
            self.link_chars += line.chars
            self.link_tags += line.parts

    def density(self, page: Node) -> float:
        """Composite text density; a node of links only has none.

        Every tag counts as one link character and link tag more than it has, so that a node
        without links is as dense as its lines are on average, however many they are.
        """
        if not self.chars:
            return 0.0
        plain = max(self.chars - self.link_chars, 1)
        base = math.log(self.chars * self.link_chars / plain + page.link_chars * self.chars / max(page.chars, 1) + math.e + 1)
        free = 2 * self.chars * self.tags / ((self.link_chars + self.tags) * (self.link_tags + self.tags))
        return self.chars / self.tags * math.log(max(free, 1.0)) / math.log(base)


def _node(lines: list[Line]) -> Node:
    out = Node()
    for x in lines:
        out.add(x)
    return out


def densest(lines: list[Line]) -> tuple[int, float]:
    """End of the subtree with the largest sum of densities, and the least density a line within it has.

    The subtree begins with the page and ends where the first section begins that is neither the
    one with the largest sum, nor before it, nor has a large share of all sums, nor goes on from a
    paragraph. There are no sections but the page where no voice is followed by text.
    """
    n, page = len(lines), _node(lines)
    voices = [i for i in range(n - 1) if lines[i].kind == "voice" and lines[i + 1].kind == "text"]
    sections = [*zip([0, *voices], [*voices, n])]
    leaves = [[_node([x]).density(page) for x in lines[a:z] if x.is_text] for a, z in sections]
    sums = [sum(d) for d in leaves]
    # one paragraph is a leaf and has no sum; the page's own section is always there to choose
    total, best = sum(sums), max((i for i in range(len(sums)) if i == 0 or len(leaves[i]) > 1), key=lambda i: sums[i])
    path = [_node(lines[a:z]).density(page) for a, z in (sections[best], (0, n))]
    least = PATH_SHARE * min([p for p in path if p > 0], default=0.0)
    end = n
    for i in range(len(sections) - 1, 0, -1):
        if i == best or (len(leaves[i]) > 1 and sums[i] >= ARTICLE_SHARE * total):
            break
        before = next((x.kind for x in reversed(lines[: sections[i][0]]) if x.kind != "blank"), "")
        # the voices after the first one follow the text of the voice before
        if before not in ("text", "item"):
            end = sections[i][0]
    return end, least


def body_lines(text: str, title: str | None, frame: set[int] | None = None, keys: list[int | None] | None = None) -> list[int]:
    """Numbers, from 1, of the lines of a page's body; none if the page has no body.

    ``keys`` are the lines' keys and ``frame`` those of the site's frame.
    """
    raw = text.split("\n")
    frame = frame or set()
    framed = [keys is not None and k is not None and k in frame for k in keys] if keys is not None else [False] * len(raw)
    crumbs = [re.split(r"\s[>»›/]\s", t)[-1] for t in raw if re.search(r"\S\s[>›]\s\S", t)]
    lines = [Line(t, f, _headlines(title, crumbs)) for t, f in zip(raw, framed)]
    n = len(lines)
    talk, least = densest(lines)
    for x in lines[:talk]:
        if x.kind == "voice":
            x.kind = "heading"
    kind = [x.kind for x in lines]
    page = _node(lines)
    dense = [x.is_text and _node([x]).density(page) >= least for x in lines]

    def after(i: int) -> str:
        return kind[i + 1] if i + 1 < n else "end"

    lo, hi = 0, talk
    if not any(dense[lo:hi]):
        return []
    # sections of links: runs of headings, teasers and links that are more than a paragraph's own heading
    answers = any(kind[i] == "heading" and _QUESTION.search(raw[i].strip()) and after(i) == "text" for i in range(lo, hi))
    listed, verse = [False] * n, [False] * n
    i = lo
    while i < hi:
        j = i
        while j < hi and kind[j] in ("heading", "teaser", "blank", "link"):
            j += 1
        titles = [k for k in range(i, j) if kind[k] == "heading"]
        if not any(kind[k] in ("teaser", "link") for k in range(i, titles[-1] if titles else i)) and i > lo and kind[i - 1] in ("text", "item", "headline", "byline", "date"):
            # lines without punctuation and without any link among them, within the article: verses
            if len(titles) > 2 or (len(titles) == 2 and kind[i - 1] in ("text", "item")):
                for k in titles:
                    verse[k] = True
                i = max(j, i + 1)
                continue
        parted = len(titles) > 1 and any(kind[k] == "link" for k in range(titles[0], titles[-1]))
        opened = bool(titles) and any(kind[k] == "link" for k in range(i, titles[0])) and len(titles) > 1
        if any(kind[k] == "teaser" for k in range(i, j)) or len(titles) > 2 or parted or opened:
            last = titles[-1] if titles else -1
            asks = answers and j < hi and last >= 0 and bool(_QUESTION.search(raw[last].strip()))
            first = titles[0] if titles else -1
            # a heading that stands before the list's own heading belongs to the paragraph after the list
            own = first if first == i and i > lo and kind[i - 1] in ("text", "item") and first + 1 < j and kind[first + 1] == "link" and after(first + 1) == "heading" else -1
            for k in range(i, j):
                listed[k] = k != own and not (asks and k == last)
        i = max(j, i + 1)
    first_text = next((i for i in range(lo, hi) if dense[i]), hi)
    known = any(k == "headline" for k in kind) or bool(_headlines(title, crumbs))
    keep = []
    for i in range(lo, hi):
        x = lines[i]
        if dense[i] or verse[i]:
            keep.append(i + 1)
        elif x.kind == "heading" and not listed[i]:
            # what stands between a heading and its paragraph may be furniture once the article has begun
            begun = i > first_text or any(kind[k] in ("headline", "byline", "date") for k in range(lo, i))
            between = ("blank", "link") if begun else ("blank",)
            j = i + 1
            while j < hi and (kind[j] in between or listed[j]):
                j += 1
            if j < hi and dense[j] and (i > first_text or known or _QUESTION.search(raw[i].strip())):
                keep.append(i + 1)
    return keep


def _site_frames(pages: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """(site, key) of the frames of all sites, and the lines that are in the frames of many."""
    hashes = materialize(
        site_lines.line_hashes(pages.select(F.col("page_id").alias("doc_id"), "url", F.lit("").alias("source"), "text")), "page-lines"
    )
    frames = materialize(site_lines.repeated(hashes, FRAME_PAGES, FRAME_SHARE).select("site", "key"), "frames")
    sites = frames.select("site").distinct().count()
    per_key = frames.groupBy("key").agg(F.count("*").alias("n"))
    # at most the frame lines of 1 / COMMON_FRAME_SHARE average sites
    common = per_key.where(F.col("n") >= max(COMMON_FRAME_SITES, COMMON_FRAME_SHARE * sites))
    return frames, frozenset(r.key for r in common.select("key").collect())


def page_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, line_no): the lines of every page's body.

    ``pages`` has page_id, url, title, text. A page given twice under one page_id gives its lines
    once; null and empty texts have no body. A site's frame is bounded by FRAME_SHARE (at most ten
    times an average page's lines).
    """
    frames, common = _site_frames(pages)
    lines = F.transform(F.split("text", "\n", -1), site_lines.line_key)
    rows = pages.where("text is not null and page_id is not null").select(
        "page_id", "title", "text", F.coalesce(site_lines.site_of(F.col("url"), F.lit("")), F.lit("")).alias("site"), lines.alias("keys")
    )
    rows = site_lines.with_site_lines(rows, frames, "frame").select("page_id", "title", "text", "keys", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = [], []
            for page, title, text, keys, frame in zip(*(c.to_pylist() for c in batch.columns)):
                for no in body_lines(text, title, common.union(frame or ()), keys):
                    ids.append(page)
                    nos.append(no)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["page_id", "line_no"])

    return rows.mapInArrow(run, "page_id long, line_no int").distinct()


def clean_pages(pages: DataFrame) -> DataFrame:
    """(page_id, body): every page's main text, null where it has none."""
    found = page_bodies(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("nos"))
    lines = F.filter(F.split("text", "\n", -1), lambda _, i: F.array_contains(F.col("nos"), i + 1))
    return pages.select("page_id", "text").dropDuplicates(["page_id"]).join(found, "page_id", "left").select("page_id", F.when(F.col("nos").isNotNull(), F.array_join(lines, "\n")).alias("body"))
