"""Main text of web pages, with template lines found by nearest-URL page differencing.

Pages are paired by URL path within each host: sorted by host, path and page_id, neighbours with
the same lines form a run, and each page of it is compared with the nearest page before and the
nearest page after the run, which differ from it. Both pages' lines are aligned by their longest
common subsequence, and the shared lines, the template's, are deleted. Lines inside the page's
article or main element are its content by its own markup, and stay even where another page
shares them; pages without such an element rely on the differencing. Markup, scripts,
styles, forms, menus, headers, footers, sidebars, notices, adverts and comments go first.

Pages are dealt by sampled splitters of the sort order, so a hot host fills several ranges. A first
pass parses the pages for the digests of their lines alone and finds what each range needs from beyond
its borders, however far away; the result is thus the same for any splitters. Lines are compared by
64-bit digests. Null html is empty and gives an empty text; a null url is of the host "";
repeated rows are pages of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements whose whole content is dropped, elements without end, and inline elements.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "menu", "dialog", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
#: Elements that leave an open head open.
HEAD = {"head", "base", "link", "meta", "title", "noscript", "script", "style", "template"}
#: A class, id or role that is made of such words alone marks boilerplate.
_WORD = r"(?:ads?|adverts?|advertisement|banner|promo|sponsor(?:ed)?|cookies?|consent|notice|popup|modal|newsletter|subscribe|nav|navbar|menu|breadcrumbs?|sidebar|footer|header|masthead|share|social|related|comments?|list|disqus|replies|widget)"
BOILER = re.compile(rf"(?!list$){_WORD}(?:[_-]+{_WORD})*", re.I)
SPACES = re.compile(r"\s+")
#: Sampled pages per range, and pages returned in one frame.
SAMPLED, ROWS = 50, 1000


class _Blocks(HTMLParser):
    """Blocks of text. What a class, id or role or a form tag would drop is dropped in the end only,
    as the element stays when it turns out to hold the article or main element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.skip = self.main = self.articles = self.marked = 0
        self.doubtful: tuple[int, ...] = ()
        self.kept: set[int] = set()
        self.text: list[tuple[str, tuple]] = []
        self.raw: list[tuple[list, bool]] = []

    def flush(self):
        if self.text:
            self.raw.append((self.text, self.main > 0))
            self.text = []

    def blocks(self) -> list[tuple[str, bool]]:
        out = []
        for parts, main in self.raw:
            line = SPACES.sub(" ", "".join(x for x, marks in parts if not marks or self.kept.issuperset(marks))).strip()
            if line:
                out.append((line, main))
        return out

    def _pop(self):
        tag, boiler, mark = self.open.pop()
        self.skip -= boiler
        self.main -= tag in MAIN
        self.articles -= tag == "article"
        if mark:
            self.doubtful = self.doubtful[:-1]
        return tag

    def _leave_head(self, tag):
        tags = [t for t, _, _ in self.open]
        if "head" in tags and (tag == "body" or not {"noscript", "template"}.intersection(tags)):
            while self._pop() != "head":
                pass

    def _marked(self, tag, attrs) -> bool:
        if tag == "form":
            return True
        tokens = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.split()]
        # A header of the article is the article's.
        return tag not in ("html", "body", *MAIN) and any(BOILER.fullmatch(w) and not (self.main and w.lower() == "header") for w in tokens)

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag not in HEAD and self.skip:
            self._leave_head(tag)
        if tag in VOID:
            return
        if tag == "main" or (tag == "article" and not self.articles):
            self.kept.update(self.doubtful)
        boiler = (tag in DROPPED and tag != "form") or (tag == "header" and not self.main)
        mark = 0
        if not boiler and self._marked(tag, attrs):
            self.marked += 1
            mark = self.marked
            self.doubtful = (*self.doubtful, mark)
        self.open.append((tag, boiler, mark))
        self.skip += boiler
        self.main += tag in MAIN
        self.articles += tag == "article"

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if not any(t == tag for t, _, _ in self.open):
            return
        # An inline end tag never closes a block that was left open around it.
        if tag in INLINE:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    break
                if self.open[k][0] not in INLINE:
                    return
        while self._pop() != tag:
            pass

    def handle_data(self, data):
        if self.skip and self.open[-1][0] == "head" and data.strip():
            self._leave_head("")
        if not self.skip:
            self.text.append((data, self.doubtful))


def lines_of(html: str) -> list[tuple[str, bool]]:
    """(line, inside article or main) of every block that is not boilerplate by its markup."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks()


def shared_lines(a: list, b: list) -> set[int]:
    """Positions of a on a longest common subsequence with b (bit-parallel, one row per line)."""
    masks: dict = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full, v, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = set(), len(b)
    for i in range(len(a) - 1, -1, -1):
        before = rows[i - 1] if i else full
        here = j - (rows[i] & ((1 << j) - 1)).bit_count()
        if here == j - (before & ((1 << j) - 1)).bit_count():
            continue
        while j and j - 1 - (rows[i] & ((1 << (j - 1)) - 1)).bit_count() == here:
            j -= 1
        out.add(i)
        j -= 1
    return out


def _digest(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def subtract(lines: list[str], main: tuple, keys: list[int], others: list) -> str:
    """A page's text without the lines it shares with its neighbours; ``others`` are their digests."""
    gone: set[int] = set()
    for theirs in others:
        if theirs is not None:
            gone |= shared_lines(keys, theirs)
    return "\n".join(x for i, (x, own) in enumerate(zip(lines, main)) if own or i not in gone)


def _splitters(spark: SparkSession, order: DataFrame, n: int) -> list:
    """At most n - 1 rows that cut the sort order evenly, of a sample on the driver."""
    wanted = SAMPLED * n
    sample = order.sample(min(1.0, wanted / max(1, order.count())), seed=7)
    found = sample.orderBy(*order.columns).limit(2 * wanted).collect()
    return [found[k * len(found) // n] for k in range(1, n)] if found else []


def _borders(runs: dict[int, tuple[list, list]]) -> dict[int, tuple]:
    """Per range the digests of the nearest different page before its first run and after its last.

    ``runs`` has the (host, digests) of the first two and of the last two runs of each range."""

    def nearest(parts, host, keys, side):
        for part in parts:
            for other, theirs in runs[part][side]:
                if other != host:
                    return None
                if theirs != keys:
                    return theirs
        return None

    parts = sorted(runs)
    return {
        part: (nearest(parts[:k][::-1], *runs[part][0][0], 1), nearest(parts[k + 1 :], *runs[part][1][0], 0))
        for k, part in enumerate(parts)
    }


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [[_digest(x) for x, _ in lines_of(html)] for html in batch["html"]]
            yield batch.drop(columns="html").assign(keys=keys)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first, last = None, [], []

        def summary():
            rows = [(held, 0, k, *run) for k, run in enumerate(first)] + [(held, 1, k, *run) for k, run in enumerate(last[::-1])]
            return pd.DataFrame(rows, columns=["range", "side", "place", "host", "keys"])

        for batch in batches:
            for part, host, keys in zip(batch["range"], batch["host"], batch["keys"]):
                if part != held:
                    if last:
                        yield summary()
                    held, first, last = part, [], []
                run = (host, list(keys))
                if not last or last[-1] != run:
                    last = [*last[-1:], run]
                    if len(first) < 2:
                        first.append(run)
        if last:
            yield summary()

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        borders = shipped.value
        part = host = before = keys = lines = None
        rows, known = [], {}

        def done(after):
            texts = {main: subtract(lines, main, keys, [before, after]) for main in known}
            return [(page_id, url, texts[main]) for page_id, url, main in rows]

        def frames(found):
            for a in range(0, len(found), ROWS):
                out = pd.DataFrame(found[a : a + ROWS], columns=["page_id", "url", "text"]).astype({"page_id": "Int64"})
                yield out.assign(n_chars=out["text"].str.len().astype("int64"))

        for batch in batches:
            found = []
            for new_part, new_host, page_id, url, html in zip(*(batch[c] for c in ("range", "host", "page_id", "url", "html"))):
                blocks = lines_of(html)
                new = [_digest(x) for x, _ in blocks]
                if new_part != part or new_host != host or new != keys:
                    if rows:
                        found += done(borders[part][1] if new_part != part else new if new_host == host else None)
                        if len(found) >= ROWS:
                            yield from frames(found)
                            found = []
                    before = borders[new_part][0] if new_part != part else keys if new_host == host else None
                    part, host, keys, lines, rows, known = new_part, new_host, new, [x for x, _ in blocks], [], {}
                main = tuple(own for _, own in blocks)
                rows.append((None if pd.isna(page_id) else int(page_id), url, known.setdefault(main, main)))
            yield from frames(found)
        if rows:
            yield from frames(done(borders[part][1]))

    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:www\.|m\.)?([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z]+://[^/?#]*", ""), r"[?#].*$", "")
    source = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"),
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
    ).withColumn("tie", F.xxhash64("url", "html"))
    order = ["host", "path", "page_id", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _splitters(spark, source.select(*order), n)
    types = dict(source.dtypes)
    marks = F.array(*(F.struct(*(F.lit(row[c]).cast(types[c]).alias(c) for c in order)) for row in cuts))
    here = F.size(F.filter(marks, lambda m: m <= F.struct(*order))) if cuts else F.lit(0)
    dealt = source.withColumn("range", here)

    small = dealt.select("range", *order, "html").mapInPandas(digests, "range int, host string, path string, page_id long, tie long, keys array<long>")
    small = small.repartitionById(n, "range").sortWithinPartitions("range", *order)
    runs: dict[int, tuple[list, list]] = {}
    # At most four rows a range, without texts.
    for r in sorted(small.mapInPandas(ends, "range int, side int, place int, host string, keys array<long>").collect(), key=lambda r: r.place):
        runs.setdefault(r["range"], ([], []))[r.side].append((r.host, r["keys"]))
    shipped = spark.sparkContext.broadcast(_borders(runs))

    near = dealt.repartitionById(n, "range").sortWithinPartitions("range", *order)
    return near.mapInPandas(difference, "page_id long, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
