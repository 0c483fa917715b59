"""Operator 10, main text by consensus host paths.

Pass 1 scores each page's containers by their own text without links and emits (host, generalised tag-class path, score); Spark
sums the votes, in whole numbers, and each host's best path wins, ties going to the lesser path. Pass 2 lifts the winner to the
article or main around it, else to the lowest container with all of the page's text but link lists, and extracts the text below,
with the headline above it if it has none of its own; the page's own best container takes its place where that is under half of
the page's text. Furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) is left out by tag, role and
class; an article's own header is not furniture.

Null and empty html give empty text, null urls share one host, repeated rows are extracted alike, an empty table gives an empty
result and other columns are not read. Unclosed tags are closed by their ancestors' ends, an unclosed comment or script reaches to
the page's end, and a tag that never ends is text. A page is scanned once, in time proportional to its length: containers below
DEEP levels count as part of the one above, and after ODD tags with an unclosed quote, quotes no longer hide a tag's end.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import join_small, materialize

DEEP, ODD, NEAR = 64, 100, 32
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
AWAY = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
BOX = {"article", "main", "section", "div", "body", "td"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
FURNITURE = re.compile(r"(?:^|[\s_-])(ad|ads|advert\w*|adv|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|foot|sidebar|side|aside|widget\w*|related|share|sharing|social|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe\w*|signup|login|search|form|comments?|commentlist|commentform|disqus|replies|reply|pagination|pager|toolbar|skip|copyright|legal|tags)(?=$|[\s_-])", re.I)
OWN_HEAD = re.compile(r"(?:^|(?<=[\s_-]))(?:entry|article|post|story|content|news|blog)[_-]*header(?=$|[\s_-])", re.I)
HEAD = re.compile(r"(?:^|(?<=\s))header(?=$|\s)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


@lru_cache(maxsize=10_000)
def generalise(tag: str, first: str) -> str:
    """Tag and first class, digits generalised; a long class is told by its hash."""
    name = re.sub(r"\d+", "#", first.lower())
    return tag + ("." + (name if len(name) <= 64 else name[:32] + xxhash.xxh64_hexdigest(name)).replace("/", "_") if name else "")


@lru_cache(maxsize=10_000)
def is_furniture(tag: str, names: str, ident: str, own: bool) -> bool:
    """By tag and class; own: inside an article or main, whose header is its own."""
    if tag in AWAY and not (tag == "header" and own):
        return True
    for x in (names, ident):
        x = OWN_HEAD.sub(" ", x)
        if FURNITURE.search(HEAD.sub(" ", x) if own else x):
            return True
    return False


def walk(page: str):
    """Blocks of text in page order: (path, text, characters in links, in a headline), furniture left out. path: the containers around it."""
    stack: list[tuple[str, bool, str]] = []  # tag, furniture, path outside
    open_: dict[str, int] = {}
    path, level, away, linked, odd = "", 0, 0, 0, 0
    text: list[str] = []
    final = page.rfind(">")
    pos = at = 0

    def cut() -> str:
        block = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        return block

    def pop() -> str:
        nonlocal path, level, away
        tag, gone, outside = stack.pop()
        open_[tag] -= 1
        away -= gone
        if outside is not None:
            path, level = outside
        return tag

    while True:
        i = page.find("<", at)
        if i > final:
            i = -1
        kind = page[i + 1 : i + 2] if i >= 0 else ""
        if i >= 0 and not (kind in "!?/" or kind.isascii() and kind.isalpha()):
            at = i + 1
            continue
        piece = page[pos:i] if i >= 0 else page[pos:]
        if piece and not away:
            text.append(piece)
            linked += len(piece) if open_.get("a") else 0
        if i < 0:
            break
        if kind in "!?" or kind == "/" and not NAME.match(page, i):
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4) + 3
            elif page.startswith("<![CDATA[", i):
                end = page.find("]]>", i) + 3
                if not away:
                    text.append(entities.escape(page[i + 9 : end - 3] if end > 2 else page[i + 9 :]))
            else:
                end = page.find(">", i) + 1
            pos = at = end if end > 2 else len(page)
            continue
        m = TAG.match(page, i) if odd < ODD else None
        if m:
            name, rest, pos = m[1], m[2], m.end()
        else:
            odd += 1
            name = NAME.match(page, i)[1]
            pos = page.find(">", i) + 1
            rest = page[i + 1 + len(name) + (kind == "/") : pos - 1]
        at = pos
        tag, closing = name.lower(), kind == "/"
        if tag not in INLINE and text:
            headline = bool(open_.get("h1"))
            if block := cut():
                yield path, block, linked, headline
            linked = 0
        if closing:
            if tag in INLINE:  # it may not close a container
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAR), -1):
                    if stack[k][0] == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in BOX:
                        break
            elif open_.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in VOID or rest.endswith("/") and tag in {"svg", "path"}:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        if tag in ENDS_P and open_.get("p"):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAR), -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in SAME and stack and stack[-1][0] == tag:
            pop()
        found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(rest)} if rest else {}
        names = found.get("class", "")
        gone = tag not in ("main", "body", "html", "article") and is_furniture(tag, names[:4096], found.get("id", "")[:4096], bool(open_.get("article") or open_.get("main"))) or bool(found) and (
            "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or bool(re.search(r"display\s*+:\s*+none", found.get("style", ""))))
        outside = None
        if tag in BOX and level < DEEP:
            first = names.split(None, 1)[:1]
            outside = path, level
            path, level = (path + "/" if path else "") + generalise(tag, first[0] if first else ""), level + 1
        stack.append((tag, gone, outside))
        open_[tag] = open_.get(tag, 0) + 1
        away += gone
    headline = bool(open_.get("h1"))
    if block := cut():
        yield path, block, linked, headline


WEIGHT = {"article": 3, "main": 2}


def votes(blocks) -> dict[str, int]:
    """Score of each container path: its own blocks without links; half goes to each step up."""
    own: dict[str, int] = {}
    for path, text, linked, _ in blocks:
        if path:
            own[path] = own.get(path, 0) + (max(0, len(text) - 2 * linked) << 10)
    out: dict[str, int] = {}
    for path, score in own.items():
        steps = path.split("/")
        for i in range(len(steps), 0, -1):
            here = "/".join(steps[:i])
            out[here] = out.get(here, 0) + score * WEIGHT.get(steps[i - 1].split(".")[0], 1)
            score >>= 1
            if not score:
                break
    return out


def lifted(path: str, blocks: list[tuple]) -> tuple[str, float]:
    """The nearest article or main around ``path``, else the lowest container around it with all text but link lists; and its share of that text."""
    weights: dict[str, int] = {}
    for p, t, linked, _ in blocks:
        weights[p + "/"] = weights.get(p + "/", 0) + max(0, len(t) - 2 * linked)
    total = sum(weights.values())
    steps = path.split("/")
    held = lambda k: sum(n for p, n in weights.items() if p.startswith("/".join(steps[:k]) + "/"))
    for k in range(len(steps), 0, -1):
        if steps[k - 1].split(".")[0] in ("article", "main"):
            return "/".join(steps[:k]), held(k) / total if total else 1.0
    for k in range(len(steps), 0, -1):
        if held(k) == total:
            return "/".join(steps[:k]), 1.0
    return "", 1.0


def extract(page: str, winner: str | None, small: float = 0.5) -> str:
    blocks = list(walk(page))
    below = lambda path: [i for i, b in enumerate(blocks) if not path or b[0] == path or b[0].startswith(path + "/")]
    inside: list[int] = []
    if winner and below(winner):
        path, part = lifted(winner, blocks)
        inside = below(path) if part >= small else []
    if not inside and blocks:
        own = votes(blocks)
        best = max(sorted(own), key=own.get, default="")
        inside = below(lifted(best, blocks)[0]) if best else below("")
    if inside and not any(blocks[i][3] for i in inside):
        inside = [i for i in range(inside[0]) if blocks[i][3]][-1:] + inside
    return " ".join(blocks[i][1] for i in inside)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    keyed = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")

    def vote(batches):
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                for p, s in votes(walk(page.as_py() or "")).items():
                    found[h, p] = found.get((h, p), 0) + s
            rows = [(h, p, s) for (h, p), s in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "path", "score"])

    ballots = keyed.select("host", "html").mapInArrow(vote, "host string, path string, score long").groupBy("host", "path").agg(F.sum("score").alias("score"))
    winners = materialize(ballots.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path")))

    def take(batches):
        for b in batches:
            texts = [extract(h or "", w) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return join_small(keyed, winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(take, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op10(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
