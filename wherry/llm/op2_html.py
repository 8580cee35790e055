"""HTML extraction by equivalence-class template deduction.

A page is cut into tokens: tags, and the blocks of words between them. A token's role is the path of open
block elements it stands in. For each host the occurrence vector of every token over all of the host's
pages is folded into an order-free sum of hashes of (page, count), so vectors are compared without being
gathered: partial sums meet in one aggregation on (host, token). Tokens with equal vectors form an
equivalence class. A class is valid if it occurs once in each page that has it and its tokens nest: each
element's end tag, written or implied by HTML's rules, lies in the class too. The valid classes are nested
by containment of their paths into the host's template, whose slots are what lies between neighbouring
tokens. A block of words in a valid class is the same on all pages of that class, so its slot does not vary
and is template, whatever its element is called.

A slot belongs to the main text by the template elements around it: menus, headers, footers, sidebars,
notices, adverts, forms and comments are refused by element name or by a word of class, id or role;
among the accepted ones all outermost ``article`` slots win, with the ``h1`` of the ``main`` around them,
before ``main`` and ``body``. Ids refuse nothing inside the main slot and no heading anywhere, as they are
anchors there; an article keeps its own header; a form that holds the article, the page's ``h1`` or all of
its text is no form to fill in and refuses nothing. Text in a page whose host
offers no valid class (one page, or broken markup) is judged by the page's own elements in the same way.
Words within an accepted article are never taken for template, so equal articles on one host lose nothing;
nor are they on a page that would lose all its text, as on a host whose pages are all the same.

Within a slot, character references are decoded, white space of a block becomes one blank, blocks are
trimmed and joined in page order by one blank; nothing else is dropped.

Defined cases: null or empty html gives the empty text; null urls are one host; tags that are never closed
close with their parent; repeated page rows give repeated rows and count once more in the vectors; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import materialize, pieces, table

#: Templates are sent to every executor up to this size and joined by host beyond it.
MAX_BROADCAST_BYTES = 8 << 20

# HTML element names.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
#: Elements that hold no text of the page if they are closed; without an end tag they swallow nothing.
CLOSED_RAW = ("svg", "canvas", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
REFUSED = frozenset("nav header footer aside form menu button dialog fieldset head".split())
#: Words of a class, id or role that name what is not the article.
REFUSED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer footer form header menu nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
#: Those of them that refuse an article or main element too: a reader's comment or a teaser may be marked up as an article.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement comment comments commentlist promo promoted related replies reply sponsor sponsored teaser".split())
#: Elements that close an open one of the same group when they start.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Starting one of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("br button caption option td th tr tbody thead tfoot body html head title legend summary figcaption".split())

#: Elements whose end tag HTML lets out: their parent's end, or the page's, ends them too.
ENDS_LEFT_OUT = frozenset("html head body p li dt dd tr td th thead tbody tfoot option".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<part>" + "|".join(CLOSED_RAW) + r")\b[^>]*>.*?</(?P=part)\s*>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@lru_cache(maxsize=65536)
def _element(name: str, attrs: str, inside: bool = False) -> tuple[str, bool]:
    """(name with class, id and role, whether it is refused); ``inside``: below the root of the main text."""
    named = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attrs)] if attrs else []
    if not named:
        return name, name in REFUSED
    words = {w.lower() for k, v in named if k != "id" or not (inside or name in HEADINGS) for w in _WORD.findall(v)}
    against = frozenset() if name in ("html", "body") else ASIDE_WORDS if name in ("main", "article") else REFUSED_WORDS
    refused = name in REFUSED or bool(words & against)
    return name + "".join(f"[{k}={' '.join(v.split())}]" for k, v in named if k != "id" or refused), refused


class Tokens:
    """One pass over a page: structural events and text pieces with their element path."""

    def __init__(self, page: str):
        self.events: list[tuple[str, str]] = []
        #: (text, path of open elements, whether a block boundary stands before it)
        self.pieces: list[tuple[str, tuple[str, ...], bool]] = []
        stack: list[tuple[str, str]] = []
        path: tuple[str, ...] = ()
        boundary, at = True, 0

        def close(n: int, written: bool = False) -> None:
            nonlocal path
            while len(stack) > n:
                name, _ = stack.pop()
                # An element that its parent's end or the page's cuts off has no end tag.
                if name in ENDS_LEFT_OUT or written and len(stack) == n:
                    self.events.append(("/", "/".join(path)))
                path = path[:-1]

        for m in _MARKUP.finditer(page):
            if m.start() > at:
                self.pieces.append((page[at : m.start()], path, boundary))
                boundary = False
            at = m.end()
            name = m["name"]
            if name is None:
                boundary = boundary or m["raw"] is not None or m["part"] is not None
                continue
            name = name.lower()
            if name not in BLOCKS:
                continue
            boundary = True
            if name in VOID:
                continue
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k, written=True)
                        break
                continue
            if name in ENDS_P and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            elif name in SELF_CLOSING and stack and stack[-1][0] in SELF_CLOSING[name].split():
                close(len(stack) - 1)
            label, _ = _element(name, m["attrs"] or "")
            stack.append((name, label))
            path = (*path, label)
            self.events.append(("", "/".join(path)))
        if at < len(page):
            self.pieces.append((page[at:], path, boundary))
        close(0)

    def blocks(self) -> Iterator[tuple[tuple[str, ...], str]]:
        """(path, text) of each block that has text, in page order."""
        joined: list[list] = []
        for text, path, boundary in self.pieces:
            if boundary or not joined:
                joined.append([path, text])
            else:
                joined[-1][1] += text
        for path, text in joined:
            text = " ".join(html_lib.unescape(text).split())
            if text:
                yield path, text

    def counts(self) -> Counter:
        """Occurrences of each token: (end mark, path) of tags, (WORDS, number) of blocks that may be kept outside articles."""
        found = Counter(self.events)
        roots = set(_main_roots(self.paths(), ("article",)))
        for path, text in self.blocks():
            if not _path_refused(path, forms=True) and not any(path[:i] in roots for i in range(1, len(path) + 1)):
                found[WORDS, block_number(path, text)] += 1
        return found

    def paths(self) -> set[tuple[str, ...]]:
        """Paths of all elements that have text."""
        return {p[:i] for p in {p for _, p, _ in self.pieces} for i in range(1, len(p) + 1)}


#: Mark of a block of words among a host's tokens.
WORDS = "w"


def block_number(path: tuple[str, ...], text: str) -> str:
    """A block's role and words as 16 digits."""
    return xxhash.xxh64_hexdigest("/".join(path) + "\n" + text)


def _label_refused(label: str, inside: bool = False) -> bool:
    name, _, rest = label.partition("[")
    return _element(name, " ".join(f'{x.partition("=")[0]}="{x.partition("=")[2]}"' for x in rest.rstrip("]").split("][")) if rest else "", inside)[1]


@lru_cache(maxsize=65536)
def _path_refused(path: tuple[str, ...], inside: bool = False, forms: bool = False) -> bool:
    """Whether an element of the path is refused; ``forms``: forms refuse nothing."""
    return any(_label_refused(x, inside) for x in path if not (forms and _name(x) == "form"))


def _name(label: str) -> str:
    return label.partition("[")[0]


def _slot_refused(path: tuple[str, ...], article: bool) -> bool:
    """Whether a path below the root is refused; an article's header is its own unless it stands in another element's."""
    at = next((i for i, x in enumerate(path) if _name(x) in ("header", "article", "section")), None) if article else None
    if at is not None and _name(path[at]) == "header":
        path = path[:at] + path[at + 1 :]
    return _path_refused(path, True)


def _main_roots(paths: set[tuple[str, ...]], kinds: tuple[str, ...] = ("article", "main")) -> list[tuple[str, ...]]:
    """The elements whose slots are the main text: articles before mains before the body, the outermost of their kind."""
    for kind in kinds:
        found = {p[: i + 1] for p in paths for i, x in enumerate(p) if _name(x) == kind and not _path_refused(p[: i + 1], forms=True)}
        if found:
            return sorted((p for p in found if not any(p[:i] in found for i in range(1, len(p)))), key=lambda p: (len(p), p))
    return []


def _title_of(path: tuple[str, ...]) -> bool:
    """Whether a path is an h1 in a main, refused by nothing but by a header that stands in that main."""
    at = next((i for i, x in enumerate(path) if _name(x) == "main"), None)
    return at is not None and _name(path[-1]) == "h1" and not _path_refused(path[: at + 1], forms=True) and not _slot_refused(path[at + 1 :], True)


def _classes(tokens: list[tuple[str, str, int, int, int]], pages: int) -> Iterator[tuple[set[str], list[str]]]:
    """(element paths, block numbers) of each valid class; see ``nest``."""
    classes: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for mark, path, vector, with_it, most in tokens:
        if most == 1:
            classes.setdefault((vector, with_it), []).append((mark, path))
    for (_, with_it), members in classes.items():
        # An element whose end tag has another vector is broken markup somewhere: it belongs to no template.
        starts = {p for e, p in members if not e} & {p for e, p in members if e == "/"}
        if (with_it >= 2 or pages <= 1) and starts:
            yield starts, [p for e, p in members if e == WORDS]


def nest(tokens: list[tuple[str, str, int, int, int]], pages: int) -> list[tuple[str, ...]]:
    """Paths of a host's template elements, outermost first.

    ``tokens``: (mark, path or block number, vector sum, pages with it, largest count). Tokens are grouped by
    vector; a class is valid if its tokens occur once in a page and its elements are closed within it.
    """
    have = {tuple(p.split("/")) for starts, _ in _classes(tokens, pages) for p in starts}
    # Nested: every ancestor is a template element too, or a host-wide one is missing and the class hangs loose.
    return sorted((p for p in have if all(p[:i] in have for i in range(1, len(p)))), key=lambda p: (len(p), p))


def fixed_blocks(tokens: list[tuple[str, str, int, int, int]], pages: int) -> list[str]:
    """Numbers of the blocks of words that stand on all pages of a valid class of several pages."""
    return sorted(b for _, blocks in _classes(tokens, pages) for b in blocks) if pages > 1 else []


def extract(page: str | None, template: frozenset[tuple[str, ...]] = frozenset(), fixed: frozenset[str] = frozenset()) -> str:
    """Main text of a page under a host's template and fixed blocks (empty: the page's own elements)."""
    if not page:
        return ""
    tokens = Tokens(page)
    inside = tokens.paths()
    roots = _main_roots(inside, ("article",))
    blocks = list(tokens.blocks())
    if roots:
        # All accepted articles of the page, those that its host has only here too; no words of theirs are template.
        tops, mains = set(roots), {r[:i] for r in roots for i in range(1, len(r)) if _name(r[i - 1]) == "main"}

        def wanted(path: tuple[str, ...]) -> bool:
            at = next((i for i in range(1, len(path) + 1) if path[:i] in tops), None)
            if at is None:
                return any(path[: len(m)] == m for m in mains) and _title_of(path)
            return not _slot_refused(path[at:], True)

        return " ".join(text for path, text in blocks if wanted(path))
    root = next(iter(_main_roots({p for p in template if p in inside}, ("main",)) or _main_roots(inside, ("main",))), ())
    slots = [(path, text) for path, text in blocks if path[: len(root)] == root]
    holding = any(_name(p[-1]) == "h1" and any(_name(x) == "form" for x in p[len(root) :]) and not _path_refused(p[len(root) :], bool(root), True) for p, _ in slots if p)
    kept = [(path, text) for path, text in slots if not _path_refused(path[len(root) :], bool(root), holding)]
    if not kept and not holding:
        kept = [(path, text) for path, text in slots if not _path_refused(path[len(root) :], bool(root), True)]
    if fixed:
        kept = [(path, text) for path, text in kept if block_number(path, text) not in fixed] or kept
    return " ".join(text for _, text in kept)


def host_key():
    return F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, fixed): paths of each host's template elements and numbers of its fixed blocks, one to a line."""
    number = F.monotonically_increasing_id()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, str], list[int]] = {}
        seen: Counter = Counter()

        def out():
            keys = [*found, *((h, "#", "") for h in seen)]
            values = [*found.values(), *([0, n, 0] for n in seen.values())]
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays(cols, names=["host", "mark", "path", "vector", "n", "most"])

        for batch in pieces(batches):
            for host, page_no, page in zip(*(c.to_pylist() for c in batch.columns)):
                seen[host] += 1
                for (end, path), c in Tokens(page or "").counts().items():
                    v = found.setdefault((host, end, path), [0, 0, 0])
                    # A sum modulo 2^40: sums of sums stay exact in a long for 2^23 partial rows.
                    v[0] = (v[0] + xxhash.xxh64_intdigest(f"{page_no}:{c}")) % (1 << 40)
                    v[1] += 1
                    v[2] = max(v[2], c)
            if len(found) > 200_000:
                yield out()
                found.clear()
                seen.clear()
        yield out()

    parts = pages.select(host_key().alias("host"), number.alias("no"), "html").mapInArrow(count, "host string, mark string, path string, vector long, n long, most long")
    vectors = parts.groupBy("host", "mark", "path").agg((F.sum("vector") % (1 << 40)).alias("vector"), F.sum("n").alias("n"), F.max("most").alias("most"))
    # Only tokens that occur once in a page can be in a valid class: what is left for a host is its skeleton.
    skeleton = vectors.filter("mark = '#' OR most = 1 AND n > 1").groupBy("host").agg(F.collect_list(F.struct("mark", "path", "vector", "n", "most")).alias("tokens"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, fixed = [], []
            for tokens in batch.column(1).to_pylist():
                total = next((t["n"] for t in tokens if t["mark"] == "#"), 0)
                rows = [(t["mark"], t["path"], t["vector"], t["n"], t["most"]) for t in tokens if t["mark"] != "#"]
                made.append("\n".join("/".join(p) for p in nest(rows, total)))
                fixed.append("\n".join(fixed_blocks(rows, total)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), pa.array(fixed, pa.string())], names=["host", "template", "fixed"])

    return skeleton.mapInArrow(build, "host string, template string, fixed string")


@lru_cache(maxsize=4096)
def _template(lines: str | None) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(x.split("/")) for x in lines.split("\n")) if lines else frozenset()


@lru_cache(maxsize=4096)
def _fixed(lines: str | None) -> frozenset[str]:
    return frozenset(lines.split("\n")) if lines else frozenset()


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    learned = materialize(templates(pages))
    size = learned.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("fixed") + F.octet_length("host") + 32), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host_key().alias("host"))
    rows = rows.join(F.broadcast(learned) if size <= MAX_BROADCAST_BYTES else learned, "host", "left").select("page_id", "url", "html", "template", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [extract(page, _template(t), _fixed(f)) for page, t, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
