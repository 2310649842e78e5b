"""Main text of web pages by container paths that the pages of a host agree on."""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.texts import by_bytes
from auditloom.operators.small import checked
from auditloom.session import materialise
from auditloom.shipping import map_arrow

LASTING = 0.1        # paths of a host that are kept, as a share of all its votes
FITTING = 0.3        # a host's path is used on a page if it scores this share of the page's own best
INNER = 0.1          # what a container gains for each container around it
PATH_CHARS = 2000    # longer paths are named by their hash

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg canvas object video audio select datalist".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CELL = frozenset("td th caption table".split())
CONTAINER = frozenset("article center div main section td".split())
CLOSED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSED_BY.items()}
# What authors call the parts that are not the article, and the part that is.
APART_TAGS = frozenset("nav footer aside form button dialog menu search fieldset label".split())
APART_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer foot copyright sidebar aside rail widget widgets related recommended recommendations notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup login search form share sharing social pagination pager toolbar skip comment comments commentlist disqus respond reply replies".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies ad ads advert sponsored promo related".split())
HEADER_WORDS = frozenset("header masthead topbar banner".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CONTENT_WORDS = frozenset("article content post entry story main text body".split())
LAYOUT_WORDS = frozenset("has with no without".split())

TOKEN = re.compile(r"<(?:(!--)|([!?])|/([a-zA-Z][^\s/>]*+)|([a-zA-Z][^\s/>]*+)|(/))")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
COMMENT_END = re.compile(r"--!?>")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Elements of a page in order: parent, tag, label and role, and its runs of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.prior, self.apart = [-1], ["body"], [""], [0.9], [0]
        self.runs: list[tuple[int, int, str, bool]] = []    # element, block, raw text, inside a link
        self._block, self._open, self._count = 0, [0], {}
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            token = TOKEN.search(source, at)
            if not token:
                self._text(source[at:])
                return
            self._text(source[at:token.start()])
            comment, _, end, start, _ = token.groups()
            at = token.end()
            if comment:
                # "<!-->" and "<!--->" are whole comments
                stop = re.compile("-?>").match(source, at) or COMMENT_END.search(source, at)
                at = stop.end() if stop else size
            elif start:
                at = self._start(source, start.lower(), at)
            else:
                stop = source.find(">", at)
                at = size if stop < 0 else stop + 1
                if end and stop >= 0:
                    self._end(end.lower())

    def _text(self, raw: str) -> None:
        if raw:
            self.runs.append((self._open[-1], self._block, raw, bool(self._count.get("a"))))

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        names = attributes.get("class", "").split()
        label = ".".join([tag, *sorted({DIGITS.sub("#", n) for n in names})])
        words = [w.lower() for n in [*names, attributes.get("id", "")] for w in WORDS.findall(n)]
        role = attributes.get("role", "").strip().lower()
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.label.append(label)
        self.prior.append(
            1.5 if tag in ("article", "main") or role == "main" or attributes.get("itemprop") == "articleBody"
            else 1.25 if CONTENT_WORDS & set(words) else 1.0)
        self.apart.append(self._kind(tag, words, role, attributes))
        self._open.append(len(self.tag) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1

    @staticmethod
    def _kind(tag: str, words: list[str], role: str, attributes: dict[str, str]) -> int:
        """0 part of the text, 1 apart from it, 2 a header, 3 apart unless it holds the article."""
        if tag in SKIPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
            return 1
        if tag == "header":
            return 2
        named = {w for before, w in zip(["", *words], words, strict=False) if before not in LAYOUT_WORDS}
        if tag in ("article", "main"):
            return 1 if named & COMMENT_WORDS else 0
        if tag in APART_TAGS or role in APART_ROLES or named & APART_WORDS:
            return 3
        return 2 if named & HEADER_WORDS and tag not in HEADING else 0

    def _pop(self, length: int) -> None:
        for node in self._open[length:]:
            self._count[self.tag[node]] -= 1
        del self._open[length:]

    def _close(self, tags: frozenset | set, until: frozenset) -> None:
        """Close the nearest open element of ``tags`` above any of ``until``."""
        if not any(self._count.get(t) for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[k]]
            if name in tags:
                return self._pop(k)
            if name in until:
                return

    def _start(self, source: str, tag: str, at: int) -> int:
        attributes: dict[str, str] = {}
        while found := ATTRIBUTE.match(source, at):
            name, value = found.group(1).lower(), found.group(2) or ""
            if value[:1] in ("'", '"') and value[-1:] == value[:1]:
                value = value[1:-1]
            attributes.setdefault(name, html.unescape(value) if "&" in value else value)
            at = found.end()
        stop = source.find(">", at)
        if stop < 0:
            return len(source)
        at = stop + 1
        if tag in BLOCK:
            self._block += 1
            self._close({"p"}, CELL | {"button", "object"})
            if tag in HEADING and self.tag[self._open[-1]] in HEADING:
                self._pop(len(self._open) - 1)
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        if tag == "br":
            self._text(" ")
        if tag in VOID or tag in ("html", "head", "body"):
            return at
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            if not stop:
                return len(source)
            stop = source.find(">", stop.end())
            return len(source) if stop < 0 else stop + 1
        self._push(tag, attributes)
        return at

    def _end(self, tag: str) -> None:
        if tag in BLOCK and (tag == "p" or any(self._count.get(t) for t in (HEADING if tag in HEADING else (tag,)))):
            self._block += 1
        if tag == "br":
            self._text(" ")
        if tag in HEADING:
            self._close(HEADING, CELL)
        elif tag in BLOCK:
            self._close({tag}, frozenset() if tag in CELL or tag in ("tr", "tbody", "thead", "tfoot") else CELL)
        else:
            self._close({tag}, BLOCK)

    def _judge(self) -> None:
        """Regions, text amounts and scores, in one pass up and one down."""
        n = len(self.tag)
        article = [t in ("article", "main") and a == 0 for t, a in zip(self.tag, self.apart, strict=True)]
        for node in range(n - 1, 0, -1):
            if article[node]:
                article[self.parent[node]] = True
        own = [False] * n
        self.region = [0] * n
        for node in range(1, n):
            above, kind = self.region[self.parent[node]], self.apart[node]
            own[node] = own[self.parent[node]] or self.tag[node] in ("article", "main")
            if kind == 3 or kind == 2 and not own[node]:
                kind = 0 if article[node] else 1
            if above == 1 or kind == 1:
                self.region[node] = 1
            elif above == 2 or kind == 2:
                # a header inside the article keeps its headings
                self.region[node] = 0 if self.tag[node] in HEADING else 2
        good, every = [0] * n, [0] * n
        for node, _, raw, linked in self.runs:
            size = len(raw.strip())
            every[node] += size
            if self.region[node] == 0 and not linked:
                good[node] += size
        for node in range(n - 1, 0, -1):
            good[self.parent[node]] += good[node]
            every[self.parent[node]] += every[node]
        self.path = [""] * n
        self.score: dict[int, float] = {}
        depth = [0] * n
        for node in range(n):
            if node:
                path = f"{self.path[self.parent[node]]}>{self.label[node]}"
                self.path[node] = path if len(path) <= PATH_CHARS else hashlib.md5(path.encode()).hexdigest()
                depth[node] = depth[self.parent[node]] + (self.tag[node] in CONTAINER)
            if good[node] and self.region[node] == 0 and (node == 0 or self.tag[node] in CONTAINER):
                # an inner container may lose a little of the prose
                self.score[node] = good[node] / good[0] * (good[node] / every[node]) * self.prior[node] * (1 + INNER * depth[node])

    def best(self) -> int | None:
        """The container with the best score, the innermost among equals."""
        return max(self.score, key=lambda node: (self.score[node], node), default=None)

    def best_path(self) -> str | None:
        best = self.best()
        return None if best is None else self.path[best]

    def chosen(self, paths: list[str]) -> list[int]:
        """Containers at the first of the host's paths that fits the page, else the page's own best."""
        own = self.best()
        if own is None:
            return [0]
        for path in paths:
            held = [node for node, score in self.score.items() if self.path[node] == path]
            if held and max(self.score[node] for node in held) >= FITTING * self.score[own]:
                return held
        return [own]

    def text(self, containers: list[int]) -> str:
        """Blocks of text inside the containers, without the regions apart."""
        inside = [False] * len(self.tag)
        for node in range(len(inside)):
            inside[node] = node in containers or node > 0 and inside[self.parent[node]]
        blocks: list[list] = []
        for node, block, raw, _ in self.runs:
            if inside[node] and self.region[node] == 0:
                if not blocks or blocks[-1][0] != block:
                    blocks.append([block, []])
                blocks[-1][1].append(raw)
        lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in blocks)
        return "\n".join(line for line in lines if line)


def host_of(url: str) -> F.Column:
    """Host of a URL in lower case, without user and port; blank where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: how many pages of a host have their best container at a generalised path.

    A path lists tags and classes from the body inward; digits in classes are
    generalised. Votes are added up in the tasks before they are shuffled, so a
    host with a third of all pages sends a row for each path and task.
    """
    def voted(batches):
        for batch in by_bytes(batches, "html"):
            paths = [Page(source).best_path() for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    rows = pages.select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return map_arrow(rows, voted, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """``host, paths``: a host's paths with at least a tenth of all its votes, best first; so ten at most.

    A host whose pages have each a path of their own has none.
    """
    totals = votes.groupBy(F.col("host").alias("_host")).agg(F.sum("votes").alias("total"))
    kept = votes.join(totals, F.col("host") == F.col("_host")).where(F.col("votes") >= LASTING * F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return kept.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the article of every page.

    Every container of a page is scored by the share of the page's prose that it
    holds, by how little else it holds, and by its tag and class. The pages of a
    host vote for the generalised path of their best container; each page is then
    read again at the first of its host's winning paths that fits it, or at its
    own best container. Menus, headers, footers, asides, notices, adverts, forms,
    comments and hidden parts are left out wherever they stand; of a header inside
    an article the headings stay. Blocks follow block-level tags, a line break is
    white space.

    Null and blank html gives an empty text; pages without a host vote together;
    repeated rows and ids are read one by one and vote one by one; equal votes
    rank by path; broken markup is closed as browsers do; other columns are
    ignored; an empty table gives no rows.
    """
    votes = materialise(host_votes(pages), "host-votes")
    winners, small = checked(winning_paths(votes).withColumnRenamed("host", "_host"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    joined = rows.join(F.broadcast(winners) if small else winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "paths")

    def read(batches):
        for batch in by_bytes(batches, "html"):
            texts = []
            for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                page = Page(source)
                texts.append(page.text(page.chosen(paths or [])))
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(joined, read, f"page_id {kind}, url string, text string, n_chars long")
