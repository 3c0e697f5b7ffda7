"""Problem 7: readable paragraphs out of scanned pages.

Running heads, feet and stamps are lines whose fuzzy form (letters only, with
characters that scanners confuse folded together) comes again on other pages;
page numbers are edge lines whose number keeps its distance to the page. What
is left is joined with rules learned from the corpus's own vocabulary: a word
cut at a line end is joined if the corpus writes it in one piece, and a rare
word that becomes a frequent one when a usual confusion is undone was misread.

Pages are read line by line in three passes: for what may be furniture, for
words (counted within the task) and cuts, and for the places of misread words.
Counting is by (pdf, line) or by word, so a book of any size is spread out, and
the corpus's words are never shuffled: Bloom filters of bounded size thin what
has to meet the vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bloom
from quern.llm.scratch import materialize

# Fixed values: "read stood" pairs, what scanners read and what stood there.
CONFUSIONS = [
    tuple(pair.split(":"))
    for pair in (
        "0:o 0:O 1:l 1:i 1:I 5:s 5:S 6:b 6:G 8:B 3:e 9:g 7:t @:a !:i !:l |:l |:I $:s "
        "c:e c:o e:c b:h h:b q:g g:q l:I l:i I:l i:l O:Q t:f f:t u:n n:u v:y "
        "rn:m m:rn m:in m:ni m:nn cl:d d:cl ii:u u:ii vv:w w:vv VV:W li:h h:li ri:n n:ri lc:k fi:h "
        "١:ا ٥:ه ٧:ع ٮ:ن ٮ:ب ٮ:ت ٮ:ي ش:س س:ش ث:ت ت:ث ز:ر ر:ز غ:ع ع:غ خ:ح ح:خ ح:ج ج:ح ض:ص ص:ض ظ:ط ط:ظ ذ:د د:ذ ق:ف ف:ق ه:ة ة:ه ى:ي ي:ى ب:ن ن:ب ب:ت ت:ن"
    ).split()
]
#: How much more frequent than the word itself the word that stood there must be; of words seen less often than
#: KNOWN_COUNT nothing can be said, whatever the size of the corpus.
MISREAD_RATIO = 8
KNOWN_COUNT = 5
#: Lines of a page's top and bottom that can be heads and feet.
EDGE = 4
#: Characters of a head, of a stamp and of a line with the page's number at most.
HEAD_CHARS, STAMP_CHARS, NUMBER_CHARS = 70, 45, 60
#: Share of the page's width that a heading within the text has at most.
HEADING_WIDTH = 0.8
#: Pages in one block when the page after a page is looked for.
PAGE_BLOCK = 256
#: Distinct words a task counts before it passes the counts on.
VOCABULARY_FLUSH = 500_000

HYPHENS = "-­‐‑¬"
#: Marks that stand for nothing but a cut.
CUT_ONLY = "­¬"
_ROMAN_NUMBER = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_NUMBERS = re.compile(r"^\s*[0-9oilsb|!٠-٩]{1,4}\s{2,}|\s{2,}[0-9oilsb|!٠-٩]{1,4}\s*$|(^|\s)[\[(]?[0-9٠-٩][0-9oilsb٠-٩]*[\])]?(?=\s|$)", re.A)
_FOLDS = (str.maketrans("0@!|156$q8", "oalllsbsgb"), str.maketrans("cebhiftjnv", "ooggllllub"), str.maketrans("شثزغخجضظذقٮنىة١٥", "سترعححصطدفببيهاه"))
_STAMP = re.compile(r"^[^!?؟،,]{3,38}[\s№#:][0-9OoIlSB٠-٩]{3,6}$", re.A)
_NO_END = re.compile(rf"[.!?؟:;,،؛][\"”’»]?$|[{HYPHENS}]$")


def fuzzy(line: str) -> str:
    """A line's letters in lower case, with characters that are read for each other folded together; numbers go."""
    low = _NUMBERS.sub(" ", line.lower()).translate(_FOLDS[0])
    for read, stood in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w")):
        low = low.replace(read, stood)
    return "".join(c for c in low.translate(_FOLDS[1]).translate(_FOLDS[2]) if c.isalpha())


def _roman(text: str) -> int:
    total, last = 0, 0
    for c in reversed(text):
        v = _ROMAN[c]
        total += v if v >= last else -v
        last = max(last, v)
    return total


def page_number(line: str) -> int | None:
    """The number a line consists of, but for its decoration ("Page 3", "[ lO ]", "— iv —", "٣"); else null."""
    t = unicodedata.normalize("NFKC", line).strip().lower()
    t = re.sub(r"^(?:page|p\.|seite|página|pagina|صفحة)\s*", "", t)
    t = re.sub(r"^[\s\[\](){}<>«»—–\-‐.·•*|~=_]+|[\s\[\](){}<>«»—–\-‐.·•*|~=_]+$", "", t)
    if not t or len(t) > 8 or " " in t:
        return None
    if t.isdigit():
        return int(t)
    as_digits = t.translate(str.maketrans("oliszb", "011526"))
    if as_digits.isdigit() and any(c.isdigit() for c in t):
        return int(as_digits)
    if set(t) <= set("lo"):  # a misread 1 or 10 rather than fifty
        return int(as_digits) if len(t) <= 3 else None
    if _ROMAN_NUMBER.match(t):
        return _roman(t)
    return int(as_digits) if as_digits.isdigit() and len(t) <= 3 else None


def page_table(pages: DataFrame) -> DataFrame:
    """(pdf, page, lines): every page once; of two texts the smaller stands."""
    once = pages.where("pdf is not null and page is not null and text is not null").groupBy("pdf", "page").agg(F.min("text").alias("text"))
    return once.select("pdf", "page", F.split("text", "\n", -1).alias("lines"))


def page_lines(once: DataFrame) -> DataFrame:
    """(pdf, page, line_no, line, from_top, from_bottom, key, number, edge, stamp, short): lines that may be furniture.

    Places count filled lines from 1. Lines are edges, stamps (letters and a number) or short ones that
    end no sentence; key is the fuzzy form, number what an edge line of figures says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pdf, page, lines in zip(*(c.to_pylist() for c in batch.columns)):
                filled = [i for i, t in enumerate(lines) if t.strip()]
                width, n = max(map(len, lines)), len(filled)
                for k, i in enumerate(filled):
                    line, edge = lines[i], k < EDGE or n - k <= EDGE
                    t = line.strip(" ")
                    short = (edge or len(t) <= HEADING_WIDTH * width) and len(t) <= HEAD_CHARS and not _NO_END.search(t)
                    stamp = len(t) <= STAMP_CHARS and _STAMP.match(t) is not None
                    if not (edge or short or stamp):
                        continue
                    key = fuzzy(line)
                    number = page_number(line) if edge and len(line) <= NUMBER_CHARS and len(key) <= 12 else None
                    rows.append((pdf, page, i + 1, line, k + 1, n - k, key, number, edge, stamp, short))
            cols = list(zip(*rows)) if rows else [[]] * len(_EDGE_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _EDGE_TYPES.values())], names=list(_EDGE_TYPES))

    return once.select("pdf", "page", "lines").mapInArrow(run, "pdf string, page int, line_no int, line string, from_top int, from_bottom int, key string, number int, edge boolean, stamp boolean, short boolean")


_EDGE_TYPES = {
    "pdf": pa.string(), "page": pa.int32(), "line_no": pa.int32(), "line": pa.string(), "from_top": pa.int32(), "from_bottom": pa.int32(),
    "key": pa.string(), "number": pa.int32(), "edge": pa.bool_(), "stamp": pa.bool_(), "short": pa.bool_(),
}


def furniture(cand: DataFrame) -> DataFrame:
    """(pdf, page, line_no): running heads and feet, page numbers and stamps among ``page_lines``.

    Every rule is a count by book or key that is joined back to the lines as a flag.
    """
    keys = ["pdf", "page", "line_no"]
    # page numbers: the distance to the page is shared by other pages of the book
    number = F.col("number").isNotNull() & ((F.col("from_top") <= 2) | (F.col("from_bottom") <= 2))
    cand = cand.withColumn("shift", F.when(number, F.col("number") - F.col("page")))
    shifts = cand.where("shift is not null").groupBy("pdf", "shift").agg(F.count("*").alias("n_shift")).where("n_shift >= 2")
    # stamps: letters found with changing numbers on many pages of any books
    stamp = F.col("stamp") & (F.length("key") >= 4)
    known = cand.where(stamp).groupBy("key").agg(F.countDistinct("pdf", "page").alias("pages"), F.approx_count_distinct("line").alias("forms"))
    known = known.where("pages >= 3 and forms >= 2").select("key", F.lit(True).alias("stamped"))
    marked = cand.join(shifts, ["pdf", "shift"], "left").join(known, "key", "left")
    decorated = F.col("shift").isNotNull() & (F.col("line").rlike(r"[\[\]—–|]|^\s{6,}\S") | (F.col("shift") == 0))
    stamped = stamp & F.col("stamped").isNotNull() & ~F.col("line").rlike(r"^\S*\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+")
    marked = marked.withColumn("taken", F.col("n_shift").isNotNull() | decorated | stamped)
    marked = materialize(marked.withColumn("head", (F.length("key") >= 3) & F.col("short") & ~F.col("taken")).drop("edge", "stamp", "short", "number", "shift", "n_shift", "stamped"), "page-edges")

    # running heads: a short line at the top whose fuzzy form comes again in the book
    again = marked.where("head").groupBy("pdf", "key").agg(
        F.countDistinct("page").alias("pages"), F.countDistinct(F.when(F.col("from_top") <= 3, F.col("page"))).alias("top"), F.countDistinct(F.when(F.col("from_bottom") <= 2, F.col("page"))).alias("bottom")
    )
    lines = marked.where("taken or head").join(again.where("pages >= 2"), ["pdf", "key"], "left")
    comes_again = F.col("head") & F.col("pages").isNotNull()
    starts_low = F.trim("line").rlike(r"^\p{Ll}") & ~F.trim("line").rlike(r"^\p{Ll}+\s*$")
    top = comes_again & (F.col("from_top") <= 3) & ((F.col("top") >= 3) | ((F.col("top") >= 1) & ~starts_low))
    bottom = comes_again & (F.col("from_bottom") <= 2) & (F.col("bottom") >= 3) & (F.col("bottom") >= 0.6 * F.col("pages"))
    lines = lines.select(*keys, "from_top", "taken", top.alias("is_head"), bottom.alias("is_foot"))
    # heads stand one below the other from the first line on; a page's own heading below them may repeat a head
    above = F.col("is_head") | (F.col("taken") & (F.col("from_top") <= 2))
    nth = F.sum(above.cast("int")).over(Window.partitionBy("pdf", "page").orderBy("from_top"))
    lines = materialize(lines.withColumn("stacked", above & (nth == F.col("from_top"))), "page-heads")
    deepest = lines.where("is_head and stacked").groupBy("pdf", "page").agg(F.max("from_top").alias("depth"))
    usual = deepest.groupBy("pdf", "depth").agg(F.count("*").alias("n")).groupBy("pdf").agg(F.max(F.struct("n", "depth")).alias("m")).select("pdf", F.col("m.depth").alias("usual"))
    lines = lines.join(usual, "pdf", "left")
    return lines.where("taken or is_foot or (is_head and stacked and from_top <= usual)").select(*keys).distinct()


WORD = r"[\p{L}\p{M}\p{N}_@!|$]+"
_ENDING = rf"({WORD})[{HYPHENS}]\s*$"
_BEGINNING = rf"^\s*({WORD})"
_SENTENCE_END = r"[.!?؟…][\"'”’»)\]]*$"


def body_pages(once: DataFrame, running: DataFrame) -> DataFrame:
    """(pdf, page, body): each page's filled lines without furniture, as structs of page, line_no and line."""
    out = once.join(running.groupBy("pdf", "page").agg(F.collect_set("line_no").alias("run")), ["pdf", "page"], "left")
    structs = F.transform("lines", lambda line, i: F.struct(F.col("page").alias("page"), (i + 1).alias("line_no"), line.alias("line")))
    kept = F.filter(structs, lambda s: s["line"].rlike(r"[^\s\p{Z}]") & ~F.coalesce(F.array_contains(F.col("run"), s["line_no"]), F.lit(False)))
    return out.select("pdf", "page", kept.alias("body")).where("size(body) > 0")


def page_neighbours(pages: DataFrame, column: str, backwards: bool = False) -> DataFrame:
    """(pdf, page, near): ``column`` of the page that follows in the book (or stands before it).

    Page numbers have gaps; the search goes by blocks of pages, so no book is ordered in one task.
    """
    move, end = (F.lag, F.max) if backwards else (F.lead, F.min)
    rows = pages.select("pdf", "page", F.struct("page", F.col(column).alias("v")).alias("v"), F.floor(F.col("page") / PAGE_BLOCK).alias("block"))
    near = rows.withColumn("near", move("v").over(Window.partitionBy("pdf", "block").orderBy("page")))
    ends = rows.groupBy("pdf", "block").agg(end("v").alias("v"))
    far = ends.select("pdf", "block", move("v").over(Window.partitionBy("pdf").orderBy("block")).alias("far"))
    return near.join(far, ["pdf", "block"]).select("pdf", "page", F.coalesce("near", "far")["v"].alias("near"))


_W = r"[\w\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed@!|$]"
_WORDS, _END_PIECE, _FIRST_PIECE = re.compile(f"{_W}+"), re.compile(rf"({_W}+)([{HYPHENS}])\s*$"), re.compile(rf"^\s*({_W}+)")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")


def _end_piece(line: str) -> re.Match | None:
    """What a line ends in if that is a cut word; the pattern is tried only where the last character is a hyphen."""
    t = line.rstrip(" ")
    return _END_PIECE.search(t) if t and t[-1] in HYPHENS else None


def words_of(line: str) -> list[str]:
    """Words with what scanners put into them; a mark at a word's end belongs to the sentence."""
    found = (w.rstrip("!|_") for w in _WORDS.findall(line))
    return [w for w in found if any(c.isalpha() for c in w)]


def page_pieces(body: list[dict], after: dict | None, before: dict | None) -> Iterator[tuple[dict, str, tuple | None]]:
    """Every line of a page's body with inner, the line without pieces of cut words, and its cut (left, hyphen, right, next line)."""
    cut = _end_piece(before["line"]) if before else None
    for i, s in enumerate(body):
        inner, nxt = s["line"], body[i + 1] if i + 1 < len(body) else after
        if cut is not None:
            inner = _FIRST_PIECE.sub(" ", inner)
        cut = _end_piece(s["line"])
        right = _FIRST_PIECE.match(nxt["line"]) if cut is not None and nxt is not None else None
        if right is None:
            yield s, inner, None
            continue
        end = _end_piece(inner)
        yield s, inner[: end.start()] + " " if end is not None else inner, (cut[1], cut[2], right[1], nxt)


def neighboured(body: DataFrame) -> DataFrame:
    """(pdf, page, body, after, before): pages with the first body line of the page that follows in the book and the last of the one before."""
    edges = body.select("pdf", "page", F.col("body")[0].alias("first"), F.element_at("body", -1).alias("last"))
    around = page_neighbours(edges, "first").withColumnRenamed("near", "after").join(page_neighbours(edges, "last", True).withColumnRenamed("near", "before"), ["pdf", "page"])
    return body.join(around, ["pdf", "page"]).select("pdf", "page", "body", "after", "before")


def text_lines(pages: DataFrame) -> DataFrame:
    """(pdf, page, line_no, line, nxt): body lines of ``neighboured`` pages, each with the line that follows in the book."""
    rows = pages.select("pdf", "page", "body", "after", F.posexplode("body").alias("i", "s"))
    return rows.select("pdf", "page", "s.line_no", "s.line", F.coalesce(F.get(F.col("body"), F.col("i") + 1), F.col("after")).alias("nxt"))


def words_and_cuts(pages: DataFrame) -> DataFrame:
    """Rows (word, n) of the words a task counts, whole ones and, in lower case, compounds with their hyphen; and rows of cuts
    (pdf, page, line_no, nxt_page, nxt_no, left, hyphen, right), with word null."""
    schema = {"word": pa.string(), "n": pa.int64(), "pdf": pa.string(), "page": pa.int32(), "line_no": pa.int32(), "nxt_page": pa.int32(), "nxt_no": pa.int32(), "left": pa.string(), "hyphen": pa.string(), "right": pa.string()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values())], names=list(schema))

    def counted(counts: Counter) -> pa.RecordBatch:
        return batch_of([(w, n, *[None] * 8) for w, n in counts.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            rows = []
            for pdf, page, body, after, before in zip(*(c.to_pylist() for c in batch.columns)):
                for s, inner, cut in page_pieces(body, after, before):
                    counts.update(words_of(inner))
                    if "-" in inner:
                        counts.update(_COMPOUND.findall(inner.lower()))
                    if cut is not None:
                        left, hyphen, right, nxt = cut
                        rows.append((None, None, pdf, page, s["line_no"], nxt["page"], nxt["line_no"], left, hyphen, right))
            yield batch_of(rows)
            if len(counts) > VOCABULARY_FLUSH:
                yield counted(counts)
                counts.clear()
        yield counted(counts)

    return pages.mapInArrow(run, "word string, n long, pdf string, page int, line_no int, nxt_page int, nxt_no int, left string, hyphen string, right string")


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def word_filter(words: DataFrame) -> np.ndarray:
    """Bloom filter over the words of the only column of ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["h"])

    return bloom.build(words.mapInArrow(run, "h long"))


def places(pages: DataFrame, words: np.ndarray) -> DataFrame:
    """(pdf, page, line_no, word): where words that may be in the filter ``words`` stand in whole."""
    shared = pages.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for pdf, page, body, after, before in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [(s["line_no"], set(words_of(inner))) for s, inner, _ in page_pieces(body, after, before)]
                new = list({w for _, ws in lines for w in ws if w not in seen})
                if len(seen) > VOCABULARY_FLUSH:
                    seen, new = {}, list({w for _, ws in lines for w in ws})
                if new:
                    seen.update(zip(new, bloom.contains(shared.value, _hashes(new)).tolist()))
                rows += [(pdf, page, no, w) for no, ws in lines for w in ws if seen[w]]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["pdf", "page", "line_no", "word"])

    return pages.mapInArrow(run, "pdf string, page int, line_no int, word string")


def odd(word: Column) -> Column:
    """Letters mixed with digits or signs, as no word is written (ordinals are)."""
    return word.rlike(r"\p{L}") & word.rlike(r"[\p{N}@!|$ٮ]") & ~word.rlike(r"^\p{N}+(st|nd|rd|th|e|er|re|ère|ème|º|ª)$")


def corrections(word: str) -> set[str]:
    """Words that may have stood where ``word`` was read: one kind of confusion undone, at one place or at all."""
    out = set()
    for read, stood in CONFUSIONS:
        at = word.find(read)
        if at >= 0:
            out.add(word.replace(read, stood))
        while at >= 0:
            out.add(word[:at] + stood + word[at + len(read) :])
            at = word.find(read, at + 1)
    out.discard(word)
    return out


def originals(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """(word, stood): the frequent word of ``known`` (word, n) that stood where a rare ``word`` of ``candidates`` (word, n) was read.

    A filter of the known words leaves few of a candidate's possible originals; these meet the known
    words by equality, and the most frequent wins.
    """
    shared = known.sparkSession.sparkContext.broadcast(word_filter(known.select("word")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ns, options = [], [], []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tries = corrections(w)
                if any(c.isdigit() or c in "@!|$ٮ" for c in w):
                    tries |= {v for t in list(tries) if any(c.isdigit() or c in "@!|$ٮ" for c in t) for v in corrections(t)}
                words += [w] * len(tries)
                ns += [n] * len(tries)
                options += tries
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(options, pa.string())], names=["word", "own", "stood"])
            yield out.filter(pa.array(bloom.contains(shared.value, _hashes(options)))) if options else out

    options = candidates.select("word", "n").mapInArrow(expand, "word string, own long, stood string")
    found = options.join(known.select(F.col("word").alias("stood"), "n"), "stood").where(F.col("n") >= MISREAD_RATIO * F.col("own"))
    return found.groupBy("word").agg(F.max(F.struct("n", "stood")).alias("b")).select("word", F.col("b.stood").alias("stood"))


def joins_and_misreads(pages: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cuts to be joined (pdf, page, line_no, word, nxt), and misread words by line (pdf, page, line_no, word, stood)."""
    vocab = materialize(pieces.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    pairs = pieces.where("word is null").select(
        "pdf", "page", "line_no", F.struct(F.col("nxt_page").alias("page"), F.col("nxt_no").alias("line_no")).alias("nxt"),
        "left", "hyphen", "right", F.concat("left", "right").alias("joined"), F.lower(F.concat("left", F.lit("-"), "right")).alias("compound"),
    )
    # every word of the vocabulary or made by joining, with its counts there and the word it stands for
    seen = vocab.select("word", "n", F.lit(0).cast("long").alias("made")).unionByName(pairs.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("made")).select("word", F.lit(0).cast("long").alias("n"), "made"))
    seen = materialize(seen.groupBy("word").agg(F.sum("n").alias("n"), F.sum("made").alias("made")), "words")
    known = seen.where((F.col("n") >= KNOWN_COUNT) & ~odd(F.col("word"))).select("word", "n")
    own = seen.where(odd(F.col("word")) | ~F.col("word").contains("-")).select("word", (F.col("n") + F.col("made")).alias("n"))
    stood = materialize(originals(known, own), "originals")
    lexicon = materialize(seen.select("word", "n").join(stood, "word", "left"), "lexicon")

    parts = ("joined", "compound", "left", "right")
    asked = pairs.select("pdf", "page", "line_no", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("word")) for p in parts])).alias("a")).select("pdf", "page", "line_no", "a.*")
    told = asked.join(lexicon, "word").groupBy("pdf", "page", "line_no").agg(
        *[F.max(F.when(F.col("part") == p, F.col("n"))).alias(f"n_{p}") for p in parts], *[F.max(F.when(F.col("part") == p, F.col("stood"))).alias(f"s_{p}") for p in ("joined", "left")]
    )
    pairs = pairs.join(told, ["pdf", "page", "line_no"], "left").fillna(0, [f"n_{p}" for p in parts])
    whole = (
        F.when(F.col("hyphen").rlike(f"[{CUT_ONLY}]"), True)
        .when((F.col("n_joined") > 0) & (F.col("n_joined") >= F.col("n_compound")), True)
        .when(F.col("n_compound") > 0, False)
        .when(F.col("s_joined").isNotNull(), True)
        .when((F.col("n_right") >= KNOWN_COUNT) & ((F.col("n_left") >= KNOWN_COUNT) | F.col("s_left").isNotNull()), False)
        .otherwise(~F.col("right").rlike(r"^\p{Lu}\p{Ll}"))
    )
    pairs = materialize(pairs.withColumn("whole", whole), "cuts")

    bad = materialize(lexicon.where(F.col("stood").isNotNull() | odd(F.col("word"))).select("word", "stood"), "misread-words")
    kept = pairs.where("not whole")
    spots = places(pages, word_filter(bad.select("word")))
    spots = spots.unionByName(kept.select("pdf", "page", "line_no", F.col("left").alias("word"))).unionByName(kept.select("pdf", F.col("nxt.page").alias("page"), F.col("nxt.line_no").alias("line_no"), F.col("right").alias("word")))
    misread = spots.join(bad, "word").select("pdf", "page", "line_no", "word", "stood")
    # a misread character of a joined word is on the line that holds it
    wrong = pairs.where("whole").join(bad.withColumnRenamed("word", "joined"), "joined")
    same = F.length(F.regexp_extract(F.concat_ws("\u0001", "joined", F.coalesce("stood", F.regexp_replace("joined", r"[\p{N}@!|$ٮ].*$", ""))), r"^(.*)[^\x{01}]*\x{01}\1", 1))
    on_left = same < F.length("left")
    place = F.when(on_left, F.struct(F.col("page").alias("page"), F.col("line_no").alias("line_no"))).otherwise(F.struct(F.col("nxt.page").alias("page"), F.col("nxt.line_no").alias("line_no")))
    wrong = wrong.select("pdf", place.alias("p"), F.col("joined").alias("word"), "stood").select("pdf", "p.page", "p.line_no", "word", "stood")
    joins = pairs.where("whole").select("pdf", "page", "line_no", F.col("joined").alias("word"), "nxt")
    return joins, misread.unionByName(wrong)


def repair(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Page table, furniture, text lines, joins and misreads of ``pages`` (pdf, page, text).

    A page given twice counts once (of two texts the smaller stands). Rows without pdf, page or text
    are left out; blank lines belong to nothing.
    """
    once = materialize(page_table(pages), "pages")
    running = materialize(furniture(materialize(page_lines(once), "edges")), "furniture")
    body = materialize(neighboured(materialize(body_pages(once, running), "bodies")), "neighboured")
    joins, misread = joins_and_misreads(body, materialize(words_and_cuts(body), "pieces"))
    return once, running, text_lines(body), materialize(joins, "joins"), materialize(misread, "misread")


def found(pages: DataFrame) -> DataFrame:
    """(pdf, page, line_no, kind): kind running, join or misread."""
    _, running, _, joins, misread = repair(pages)
    keys = ["pdf", "page", "line_no"]
    out = running.select(*keys, F.lit("running").alias("kind"))
    out = out.unionByName(joins.select(*keys, F.lit("join").alias("kind"))).unionByName(misread.select(*keys, F.lit("misread").alias("kind")))
    return out.distinct()


def _page_tops(once: DataFrame, cuts: DataFrame) -> DataFrame:
    """(pdf, page, line_no, parted): first body lines, and whether a paragraph ended on the page before."""
    tops = cuts.where("nxt.page != page").select("pdf", F.col("page").alias("from_page"), F.col("line_no").alias("from_no"), F.col("nxt.page").alias("page"), F.col("nxt.line_no").alias("line_no"), F.trim("line").rlike(_SENTENCE_END).alias("ended"))
    above = once.select("pdf", "page", F.col("lines").alias("own"))
    left = once.select("pdf", F.col("page").alias("from_page"), F.col("lines").alias("others"))
    tops = tops.join(above, ["pdf", "page"]).join(left, ["pdf", "from_page"])
    between = F.concat(F.slice("others", F.col("from_no") + 1, F.size("others") - F.col("from_no")), F.slice("own", F.lit(1), F.col("line_no") - 1))
    return tops.select("pdf", "page", "line_no", (F.col("ended") & F.exists(between, lambda v: ~v.rlike(r"[^\s\p{Z}]"))).alias("parted"))


def _begun_before(counts: DataFrame) -> DataFrame:
    """(pdf, page, begun): the sum of n of all earlier pages of the book in (pdf, page, n), by blocks of pages."""
    rows = counts.withColumn("block", F.floor(F.col("page") / PAGE_BLOCK))
    earlier = Window.partitionBy("pdf", "block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("pdf", "page", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("near"))
    blocks = rows.groupBy("pdf", "block").agg(F.sum("n").alias("n"))
    far = blocks.select("pdf", "block", F.coalesce(F.sum("n").over(Window.partitionBy("pdf").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("far"))
    return near.join(far, ["pdf", "block"]).select("pdf", "page", (F.col("near") + F.col("far")).alias("begun"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(pdf, page, line_no, text): every paragraph, repaired, at the place where it begins.

    A paragraph begins after a blank line or with an indented one; pages go on where the one before
    ended, over any number of pages. Blank lines around heads and feet say little: between the last
    line of a page and the first of the next they count only if that last line ends a sentence. A
    word cut in two stands whole on the line where it begins.
    """
    once, _, cuts, joins, misread = repair(pages)
    keys = ["pdf", "page", "line_no"]
    fixes = misread.where("stood is not null").groupBy(*keys).agg(F.collect_set(F.struct("word", "stood")).alias("fixes"))
    right = joins.select("pdf", F.col("nxt.page").alias("page"), F.col("nxt.line_no").alias("line_no"), F.lit(True).alias("took"))
    whole = joins.select(*keys, F.col("word").alias("whole"))
    text = cuts.select(*keys, "line").join(fixes, keys, "left").join(right, keys, "left").join(whole, keys, "left")
    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<word:string,stood:string>>")), F.col("line"), lambda acc, f: F.replace(acc, f["word"], f["stood"]))
    fixed = F.when(F.col("took"), F.regexp_replace(fixed, _BEGINNING, "")).otherwise(fixed)
    fixed = F.when(F.col("whole").isNotNull(), F.concat(F.regexp_replace(fixed, _ENDING, ""), "whole")).otherwise(fixed)
    blanks = once.select("pdf", "page", F.posexplode("lines").alias("i", "line")).where(~F.col("line").rlike(r"[^\s\p{Z}]"))
    blank_before = blanks.select("pdf", "page", (F.col("i") + 2).alias("line_no"), F.lit(True).alias("gap"))
    text = text.join(blank_before, keys, "left").join(_page_tops(once, cuts), keys, "left")
    gap = F.coalesce("parted", F.col("gap").isNotNull())
    text = text.select(*keys, F.trim(fixed).alias("part"), (gap | F.col("line").rlike(r"^\s{2,}")).alias("begins"))
    text = text.withColumn("n", F.sum(F.when(F.col("begins"), 1).otherwise(0)).over(Window.partitionBy("pdf", "page").orderBy("line_no")))
    pieces = text.groupBy("pdf", "page", "n").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "part"))), lambda p: p["part"]), " ").alias("text"))
    # a piece without a beginning of its own goes on from the last piece before it in the book
    pieces = pieces.join(_begun_before(pieces.groupBy("pdf", "page").agg(F.max("n").alias("n"))), ["pdf", "page"])
    return (
        pieces.withColumn("nth", F.col("begun") + F.col("n"))
        .groupBy("pdf", "nth")
        .agg(F.min(F.struct("page", "line_no")).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))), lambda p: p["text"]), " ").alias("text"))
        .select("pdf", "at.page", "at.line_no", "text")
    )
