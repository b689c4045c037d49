"""Main text of web pages: site template removal by subtree hashes counted per host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements without an end tag, those whose content is no markup, and those that stand as blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul "
    "script style noscript iframe textarea select button svg object canvas audio video map math".split()
)
#: Blocks that end an open paragraph, and open elements that one of the same kind ends.
ENDS_P = BLOCK - {"button", "select", "option", "optgroup", "script", "style", "template", "noscript", "iframe", "textarea", "svg", "object", "canvas", "audio", "video", "map", "math", "td", "th", "tr", "caption", "legend"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements that are no part of an article, whatever they hold.
APART = set("nav aside form script style noscript template iframe textarea select button option svg object canvas audio video map math head title dialog menu search".split())
#: Words of a class or id, and roles, by which sites mark what is not the article.
MARKED = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal "
    "overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus "
    "respond reply replies share sharing social related recommended recommendations widget pagination pager toolbar skip alert disclaimer".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Elements too large to be a part that is marked: their class speaks of the page.
WHOLE = {"html", "body", "main", "article"}
#: Parts of running text: in an article no class or id makes them boilerplate, only their recurrence does.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


def _apart(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element with this start tag is boilerplate by what it is or says; inside: within an article or main."""
    if name in APART or (name in ("header", "footer") and not (inside and name == "header")):
        return True
    if not attrs or name in WHOLE and name != "article":
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            if not (inside and name in PROSE) and MARKED & set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())):
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Page:
    """The blocks of a page in order and the subtrees they stand in, boilerplate included.

    blocks: (text, subtree); parent, hash: of each subtree; core: whether the subtree lies in an article or main; gone:
    whether it is boilerplate, or in some, by what an element is or says.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int]] = []
        self.parent: list[int] = [-1]
        self.name: list[str] = [""]
        self.core: list[bool] = [False]
        self.gone: list[bool] = [False]
        self.content: list[list] = [[]]
        self.open: list[tuple[str, int]] = [("", 0)]  # inline elements stand in their block's subtree
        self.count: Counter = Counter()  # of open elements by name
        self.run: list[str] = []
        self._read(source)
        self._flush()
        self.hash, self.full = [0] * len(self.parent), [False] * len(self.parent)
        for i in range(len(self.parent) - 1, -1, -1):  # children come after their parents
            parts = [x if isinstance(x, str) else str(self.hash[x]) for x in self.content[i] if isinstance(x, str) or self.full[x]]
            self.full[i] = bool(parts)
            # A subtree counts by itself where it stands in an article or is a heading: there more has to be shown.
            where = self.name[i] + "!" * (self.core[i] or self.name[i] in HEADINGS)
            self.hash[i] = (xxhash.xxh64_intdigest("\x1f".join([where, *parts]), 0) >> 1 << 1 | where.endswith("!")) - (1 << 63)

    def _flush(self) -> None:
        if self.run:
            text = SPACE.sub(" ", entities.unescape("".join(self.run))).strip()
            self.run.clear()
            at = self.open[-1][1]
            if text:
                self.blocks.append((text, at))
                self.content[at].append(text)

    def _close(self, depth: int) -> None:
        shut = [n for n, _ in self.open[depth:]]
        if any(n in BLOCK for n in shut):
            self._flush()
        self.count.subtract(shut)
        del self.open[depth:]

    def _end(self, name: str) -> None:
        if not self.count[name]:  # without this, many stray end tags would each search all that is open
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == name:
                self._close(depth)
                return

    def _start(self, name: str, attrs: str) -> None:
        if name in ENDS_P and self.count["p"]:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] == "p":
                    self._close(depth)
                    break
                if self.open[depth][0] in BLOCK:
                    break
        if name in ENDS and any(self.count[x] for x in ENDS[name]):
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in SCOPE[name]:
                    break
                if self.open[depth][0] in ENDS[name]:
                    self._close(depth)
                    break
        at = self.open[-1][1]
        apart = _apart(name, attrs, self.core[at])
        if name in BLOCK or apart:
            self._flush()
            new = len(self.parent)
            self.parent.append(at)
            self.name.append(name)
            self.core.append(self.core[at] or name in ("article", "main") or 'role="main"' in attrs)
            self.gone.append(self.gone[at] or apart)
            self.content.append([])
            self.content[at].append(new)
            at = new
        self.open.append((name, at))
        self.count[name] += 1

    def _read(self, source: str) -> None:
        at = 0
        while m := TAG.search(source, at):
            self.run.append(source[at : m.start()])
            at = m.end()
            name, shut, attrs = m[2] or m[5], m[1] or m[4], m[3] or m[6] or ""
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.run.append(entities.unescape(m[0][9:].removesuffix("]]>")).replace("&", "&amp;"))
                continue
            name = name.lower()
            if shut:
                inline = name not in BLOCK
                depth = len(self.open)
                self._end(name)
                if not inline and depth == len(self.open):
                    self._flush()
            elif name == "br":
                self.run.append(" ")
            elif name in VOID:
                if name in BLOCK:
                    self._flush()
            else:
                self._start(name, attrs)
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(source, at)
                    at = end.start() if end else len(source)
                elif attrs.endswith("/") and name in ("svg", "math", "object", "iframe"):
                    self._end(name)
        self.run.append(source[at:])

    def kept(self, templates: frozenset | set = frozenset()) -> list[str]:
        """Blocks of the article: outside all subtrees in templates and boilerplate elements, and within article or main where a page has one with text."""
        cut = [self.gone[0]]
        for i in range(1, len(self.parent)):
            cut.append(cut[self.parent[i]] or self.gone[i] or self.hash[i] in templates)
        core = any(self.core[at] and not self.gone[at] for _, at in self.blocks)
        return [t for t, at in self.blocks if not cut[at] and (self.core[at] or not core)]

    def subtrees(self) -> set[int]:
        """Hashes of all subtrees that hold text and are no whole page or article; odd ones are of an article or a heading."""
        return {self.hash[i] for i in range(1, len(self.parent)) if self.full[i] and self.name[i] not in WHOLE}


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; "" for null or none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(scratch: Scratch, pages: DataFrame, share: float = 0.4, margin: float = 0.05, least: int = 8) -> DataFrame:
    """(host, subtree): subtrees that stand in many of the host's pages of different main text.

    Many is `least` pages and a share of the host's: `margin` for what stands outside articles, where menus, footers and
    notices are; `share` for headings and for what stands within an article, which can recur without being the site's.
    All subtrees are counted, whatever their elements are called. Pages with the same main text count once, so that an
    article which a host holds in many copies is no template.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, source in zip(b["host"], b["html"], strict=True):
                page = Page(source or "")
                body = xxhash.xxh64_intdigest("\n\n".join(page.kept())) - (1 << 63)
                rows += [(host, body, x) for x in page.subtrees()] + [(host, body, None)]
            # A float column, as the nulls would make it, cannot hold the hashes.
            yield pd.DataFrame({"host": [r[0] for r in rows], "body": [r[1] for r in rows], "subtree": pd.array([r[2] for r in rows], dtype="Int64")})

    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, body long, subtree long").distinct()
    counts = scratch.put(found.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.isnull("subtree") | (F.col("n") >= least)))
    total = scratch.put(counts.where("subtree is null").select("host", F.col("n").alias("pages")))
    need = F.when(F.col("subtree") % 2 == 0, F.lit(margin)).otherwise(share)
    return counts.where("subtree is not null").join(total, "host").where(F.col("n") >= need * F.col("pages")).select("host", "subtree")


#: Rows of templates up to which they are sent to every executor; beyond it they meet their pages in a join.
BROADCAST_ROWS = 200_000


def main_text(pages: DataFrame, share: float = 0.4, margin: float = 0.05, least: int = 8) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), one row for each row of pages.

    A first pass hashes each page's subtrees, bottom up from their text, and counts them per host; a second deletes the
    subtrees that recur (see templates()) as well as those that are no article by their element, role, class or id (within
    an article paragraphs and headings are not judged by class or id), and joins the blocks that remain by two line feeds. Within a block white space is one space; character references are
    decoded once. Where a page has article or main elements with text, only they count. Null, empty and textless pages
    give "". Broken markup is read like browsers read it: raw elements run to their end tag, paragraphs end where a block
    begins, end tags without a start are passed over. A null url is a host of its own. Repeated rows come back each.
    """
    scratch = Scratch(pages.sparkSession)
    hits = scratch.put(templates(scratch, pages, share, margin, least))
    rows = pages.select("page_id", "url", "html")
    if (n := hits.count()) <= BROADCAST_ROWS:
        by_host: dict[str, set[int]] = {}
        for r in hits.toLocalIterator() if n else ():
            by_host.setdefault(r["host"], set()).add(r["subtree"])
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        @F.pandas_udf("string")
        def text(hosts: pd.Series, sources: pd.Series) -> pd.Series:
            known = shared.value
            return pd.Series(["\n\n".join(Page(s or "").kept(known.get(h, frozenset()))) for h, s in zip(hosts, sources, strict=True)], dtype=object)

        out = rows.withColumn("text", text(host_of(F.col("url")), "html"))
    else:

        @F.pandas_udf("string")
        def text(found: pd.Series, sources: pd.Series) -> pd.Series:
            return pd.Series(["\n\n".join(Page(s or "").kept(set() if f is None else set(f))) for f, s in zip(found, sources, strict=True)], dtype=object)

        # One row for each host, whose list is bounded by 1 / margin times the subtrees of its mean page.
        lists = hits.groupBy("host").agg(F.collect_set("subtree").alias("found")).withColumnRenamed("host", "__host")
        out = rows.join(lists, host_of(F.col("url")) == F.col("__host"), "left").withColumn("text", text("found", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
