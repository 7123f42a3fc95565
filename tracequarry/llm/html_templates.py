"""HTML extraction by templates deduced from equivalence classes of tokens.

A page is read as a sequence of tokens, tags and pieces of text, each told apart by the
elements around it. For each host, tokens with the same occurrence vector over the host's
pages form an equivalence class; a vector is known by its sum of page hashes times counts,
so that classes are found by one grouped sum whatever the number of pages. Classes of two
and more tokens on enough pages are valid; they nest by their paths into the host's
template. The template says which element holds the article, where a page that leaves
elements open goes on, and which text is fixed: that of a class with tags in it. What
remains in the article's slots is the text. Names of elements and words of their classes
say besides which slots are menus, adverts and the like, whose text differs by page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .text import chunks

SUPPORT = 0.2  # share of a host's pages that a class must be on
BROADCAST_BYTES = 32_000_000
MOST_HELD = 200_000  # tokens that a task counts before it hands them on
FEWEST_PAGES = 5  # on which text recurs before it counts as fixed
COPIES = 0.5  # where fixed text is more than this share of a host's, its pages are copies and nothing is fixed
NEARLY_ALL = 0.9  # share of a host's text outside menus that its article's element must hold

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# fixed values: elements by what they are for
RAW = frozenset("script style noscript textarea title iframe template xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object canvas".split())
MAIN = ("article", "main")
#: Words of class, id and role that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies notice notices consent gdpr sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer contentinfo complementary comment comments reply replies disqus share sharing social related recommended newsletter"
    " subscribe signup popup modal alert search form toolbar pagination".split()
)
#: Open elements that an opening tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div nav aside footer header main body html form".split())


def marked(rest: str) -> tuple[str, bool]:
    """(class, id and role as written in a token, whether one of their words marks what isn't the article)."""
    words = []
    for m in MARK.finditer(rest):
        value = (m[2] or m[3] or m[4] or "").lower()
        words += re.split(r"[\s_-]+", re.sub(r"\d+", "0", value))
    words = [w for w in words if w]
    return ("." + ".".join(words) if words else ""), any(w in MARKS for w in words)


class Page:
    """One pass over a page: tag tokens with paths, and text with the element it stands in."""

    def __init__(self, source: str, known: frozenset[str] = frozenset(), sole: bool = False):
        self.known = known
        self.sole = sole  # marks of what stands around an article don't count
        self.articles = [0, 0]  # outermost articles and the like; those that only marks around them take away
        self.stack: list[tuple[str, str, bool]] = []  # element, path, whether it isn't article text
        self.tokens: list[str] = []
        self.texts: list[tuple[str, str, bool, bool]] = []  # text, path, not text, starts a block
        self.held: dict[str, int] = {}  # characters of article text in each open element, "" for all
        self.fresh = True
        at = 0
        while True:
            m = TOKEN.search(source, at)
            self._text(source[at : m.start() if m else len(source)])
            if m is None:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["end"]:
                self._close(name)
            else:
                self._open(name, m["rest"])
                if name in RAW and not m["rest"].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
                    at = end.start() if end else len(source)

    def _text(self, text: str) -> None:
        if text:
            path, off = (self.stack[-1][1], self.stack[-1][2]) if self.stack else ("", False)
            self.texts.append((text, path, off, self.fresh))
            self.fresh = False
            size = 0 if off else len(text.strip())
            if size:
                for at in ("", *(x[1] for x in self.stack)):
                    self.held[at] = self.held.get(at, 0) + size

    def _open(self, name: str, rest: str) -> None:
        if name == "br":
            self._text(" ")
            return
        if name in BLOCK:
            self.fresh = True
            if any(x[0] == "p" for x in self.stack):
                self._pop("p")
            if name in CLOSES:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] in CLOSES[name]:
                        del self.stack[k:]
                        break
                    if self.stack[k][0] in SCOPE:
                        break
        if name == "body":
            self.stack = [x for x in self.stack if x[0] == "html"]
        sign, off = marked(rest)
        step = f"/{name}{sign}"
        if name in SCOPE and self.known and self._path() + step not in self.known:
            # the template has this token farther out: what is open in between was left open
            for k in range(len(self.stack) - 1, -1, -1):
                if (self.stack[k - 1][1] if k else "") + step in self.known:
                    del self.stack[k:]
                    break
        path = self._path() + step
        self.tokens.append(path)
        if name not in VOID:
            above = bool(self.stack) and self.stack[-1][2]
            inside = any(x[0] in MAIN for x in self.stack)
            if name in MAIN and not inside:
                only_marked = above and not any(x[0] in NOT_TEXT for x in self.stack)
                self.articles[0] += 1
                self.articles[1] += only_marked
                above = above and not (only_marked and self.sole)
            off = name in NOT_TEXT or (off and name not in MAIN and name not in ("html", "body")) or (name == "header" and not inside)
            self.stack.append((name, path, above or off))

    def _path(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.fresh = True
        if any(x[0] == name for x in self.stack):
            self.tokens.append(f"{next(x[1] for x in reversed(self.stack) if x[0] == name)}$")
            self._pop(name)

    def _pop(self, name: str) -> None:
        k = max(k for k, x in enumerate(self.stack) if x[0] == name)
        del self.stack[k:]


def read_page(source: str, known: frozenset[str] = frozenset()) -> Page:
    """The page; if it has one article, marks of what stands around that don't count."""
    page = Page(source, known)
    return Page(source, known, sole=True) if page.articles == [1, 1] else page


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url) if isinstance(url, str) else None
    return m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if m else ""


def text_token(path: str, text: str) -> str:
    """The token of a piece of text in the element ``path``; empty for white space."""
    own = " ".join(text.split())
    return f"#{xxhash.xxh3_64_hexdigest(f'{path}#{own}')}" if own else ""


def template_of(tokens: list[str], pages: list[int], prints: list, times: list[int], chars: list[int], all_pages: int, all_chars: int) -> tuple[str, list[str]]:
    """(path of the article's element or "", tokens of valid classes) of one host.

    Tokens on the same pages as often are one class; it is valid if it has two tokens
    and is on enough pages. Of text tokens only the fixed ones are returned: those of a
    class with a tag, on ``FEWEST_PAGES`` at least. The article's element is the outermost ``article`` or
    ``main`` of the template, else the innermost element that no page repeats and that
    holds nearly all text outside menus and the like; ``chars`` has what each element
    holds on all pages, the tokens left out included.
    """
    classes: dict[tuple, list[int]] = {}
    for k, token in enumerate(tokens):
        classes.setdefault((pages[k], prints[k]), []).append(k)
    valid = {k for (n, _), ks in classes.items() if len(ks) > 1 and n >= max(1, SUPPORT * all_pages) for k in ks}
    tagged = {key for key, ks in classes.items() if any(tokens[k][0] != "#" for k in ks)}
    fixed = [k for k in valid if tokens[k][0] == "#" and pages[k] >= FEWEST_PAGES and (pages[k], prints[k]) in tagged]
    if sum(chars[k] for k in fixed) > COPIES * all_chars:
        fixed = []
    template = sorted([tokens[k] for k in valid if tokens[k][0] != "#"] + [tokens[k] for k in fixed])
    opened = [t for t in template if not t.endswith("$") and t[0] != "#"]
    for name in MAIN:
        found = [t for t in opened if re.search(rf"/{name}(\.[^/]*)?\Z", t) and not _off(t)]
        if found:
            return min(found, key=lambda t: (t.count("/"), t)), template
    once = {t for t, n, k in zip(tokens, pages, times) if n == k}
    held = {t: n for t, n in zip(tokens, chars) if n and n >= NEARLY_ALL * all_chars}
    deep = [t for t in opened if t in once and t in held and not _off(t)]
    return (max(deep, key=lambda t: (t.count("/"), held[t], t)) if deep else ""), template


def _off(path: str) -> bool:
    for step in path.split("/")[1:]:
        name, *words = step.split(".")
        if name in NOT_TEXT or any(w in MARKS for w in words) and name not in (*MAIN, "html", "body"):
            return True
    return False


def main_text(source: str | None, main: str = "", known: frozenset[str] = frozenset()) -> str:
    """The text in ``main``'s slots, or outside menus and the like if the page has no such element; blocks joined by line feeds.

    The page's own ``article`` or ``main`` goes before a ``main`` that is neither. Text
    tokens among ``known`` are fixed text, which is left out unless there is no other.
    """
    if not isinstance(source, str) or not source:
        return ""
    fixed = {t for t in known if t[0] == "#"}
    page = read_page(source, known)
    inside = [x for x in page.texts if main and (x[1] == main or x[1].startswith(f"{main}/"))]
    if not inside or not re.search(r"/(article|main)(\.|/|\Z)", main):
        own = [x for x in page.texts if re.search(r"/(article|main)(\.|/|\Z)", x[1])]
        inside = own if any(x[0].strip() and not x[2] for x in own) else inside or page.texts
    slots = [(x, x[2]) for x in inside]
    if fixed:
        varying = [(x, off or text_token(x[1], x[0]) in fixed) for x, off in slots]
        if any(x[0].strip() and not off for x, off in varying):
            slots = varying
    blocks: list[list[str]] = []
    start = True
    for (text, _, _, fresh), off in slots:
        start = start or fresh or off
        if off:
            continue
        if start:
            blocks.append([])
            start = False
        blocks[-1].append(text)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def templates(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(``host``, ``main``, ``known``): each host's template, from all its pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, str], list] = {}
            for k, u, h in zip(batch["id"], batch["url"], batch["html"]):
                if len(found) > MOST_HELD:
                    yield told(found)
                    found = {}
                host = host_of(u)
                page = read_page(h if isinstance(h, str) else "")
                mark = xxhash.xxh3_64_intdigest(f"{k}|{u}") >> 24
                counts: dict[str, int] = {}
                for t in page.tokens:
                    counts[t] = counts.get(t, 0) + 1
                whole = found.setdefault((host, ""), [0, 0, 0, 0])
                whole[0] += 1
                whole[2] += page.held.get("", 0)
                held = dict(page.held)
                for t, path, off, _ in page.texts:
                    if token := text_token(path, t):
                        counts[token] = counts.get(token, 0) + 1
                        held[token] = held.get(token, 0) + (0 if off else len(t.strip()))
                for t, n in counts.items():
                    row = found.setdefault((host, t), [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += mark * n
                    row[2] += held.get(t, 0)
                    row[3] += n
            yield told(found)

    def told(found: dict[tuple[str, str], list]) -> pd.DataFrame:
        out = [(h, t, n, str(p), c, k) for (h, t), (n, p, c, k) in found.items()]
        return pd.DataFrame(out, columns=["host", "token", "pages", "print", "chars", "times"])

    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"))
    seen = rows.mapInPandas(read, "host string, token string, pages bigint, print string, chars bigint, times bigint")
    seen = seen.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum(F.col("print").cast("decimal(38,0)")).cast("string").alias("print"), F.sum("chars").alias("chars"),
        F.sum("times").alias("times"),
    )
    seen = materialize(seen.where(f"token = '' or pages >= {FEWEST_PAGES} or not startswith(token, '#')"))
    whole = seen.where("token = ''").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    often = seen.where("token <> ''").join(whole, "host").where(F.col("pages") >= F.lit(SUPPORT) * F.col("all_pages"))

    def deduce(rows: pd.DataFrame) -> pd.DataFrame:
        own = (list(rows[c]) for c in ("token", "pages", "print", "times", "chars"))
        main, known = template_of(*own, int(rows["all_pages"].iloc[0]), int(rows["all_chars"].iloc[0]))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "main": [main], "known": ["\n".join(known)]})

    return materialize(often.groupBy("host").applyInPandas(deduce, "host string, main string, known string"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, ``text``, ``n_chars``.

    Null and empty pages have an empty text; very long ones are read whole. Pages whose
    url is null or has no host share one template. Pages of a host that has a single
    page are read by that page's own template. Repeated rows count as pages of their own
    and give repeated results, an empty table none; other columns aren't looked at,
    whatever their names.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    found = templates(pages, key, url, source)
    if (found.agg(F.sum(F.octet_length("known") + F.octet_length("host") + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:(?!://)[\s\S])*://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"), host.alias("host"))
    rows = rows.join(found, "host", "left").drop("host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, frozenset[str]] = {}
        for batch in batches:
            for lo, hi in chunks(batch["html"]):
                part = batch.iloc[lo:hi]
                texts = []
                for h, main, known in zip(part["html"], part["main"], part["known"]):
                    known = known if isinstance(known, str) else ""
                    if known not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[known] = frozenset(known.split("\n")) - {""}
                    texts.append(main_text(h, main if isinstance(main, str) else "", sets[known]))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    out = rows.mapInPandas(run, f"id {kinds[key]}, url {kinds[url]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": key, "url": url})
