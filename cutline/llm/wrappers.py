"""Main text of pages, by wrappers learnt from pages of the same host (operator 10).

A wrapper is a union-free regular expression over tags: fixed tags and texts, text slots, optional groups and repeated
groups. It is inferred from all pages of a host: repeats within a page are folded, and each task aligns its pages one
after the other, each mismatch becoming a slot (other text), an optional group (tags only one side has) or a repeated group. The tasks'
wrappers of a host are then aligned in the same way, and counts of texts are summed over all pages.
Texts that the pages share are fixed and thus boilerplate; the slots' places in the wrapper say which others are the article.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import bounded_batches, stored

#: Fixed texts must be on this many pages of a host at least.
SHARED = 3
#: Hosts and texts that a task holds before it passes on what it has of them.
HOSTS, TEXTS = 500, 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never main text.
SKIP = frozenset("aside button datalist dialog footer form head header iframe input label legend menu nav noscript object option script select style svg template textarea title".split())
#: Words of class, id or role that mark such content. Matched as whole parts of a name, split at - _ and case.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus discussion footer gdpr header "
    "masthead menu nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget".split()
)
MAIN = ("article", "main")
#: Marks that inside an article mean its own heading; elements that hold a page or article and are never hidden by a mark.
HEADINGS = frozenset(("header", "masthead"))
WHOLE = frozenset(("html", "body", "article", "main"))
#: Elements that cannot hold another of their kind directly.
ALONE = frozenset(("a", "li", "option", "dd", "dt"))
#: Elements that an article's text is cut into.
INNER = frozenset("p li ul ol br blockquote pre h1 h2 h3 h4 h5 h6".split())
DEPTH = 64  # elements of a path that are kept
#: Elements that close an open p.
ENDS_P = BLOCK - frozenset("br body html head option".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[\s ]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page in order: open, close, text. Comments and the content of raw elements are left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        attrs = m[3] or ""
        yield "open", name, attrs
        if name in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n


def _labelled(name: str, attrs: str) -> str:
    """The element with its first class, or else its id; numbers in it are taken for counters."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if "=" in attrs and name not in WHOLE else {}
    words = (found.get("class") or found.get("id") or "").split()
    return f"{name}.{re.sub(r'[0-9]+', '0', words[0])}".replace("/", "") if words else name


def _marked(attrs: str, in_main: bool) -> bool:
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role"):
            words = {w.lower() for part in value.strip("\"'").split() for w in _PARTS.findall(part)}
            if words & MARKS and not (in_main and words & MARKS <= HEADINGS):
                return True
        elif name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, int, str]]:
    """(path, skipped, link characters, text) of the page's text blocks. The path names the open block elements."""
    out: list[tuple[str, bool, int, str]] = []
    stack: list[tuple[str, bool, str]] = []  # open blocks, links and hidden elements; other elements change nothing
    count = {"a": 0, "main": 0, "hidden": 0}
    buffer: list[str] = []
    links, path, skip = 0, "", False

    def flush() -> None:
        nonlocal buffer, links
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                out.append((path, skip, links, text))
        buffer, links = [], 0

    def note(name: str, hidden: bool, by: int) -> None:
        count["a"] += by * (name == "a")
        count["main"] += by * (name in MAIN)
        count["hidden"] += by * hidden

    def cut(i: int) -> None:
        for name, hidden, _ in stack[i:]:
            note(name, hidden, -1)
        del stack[i:]

    def close(name: str, walls: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                if any(h for _, h, _ in stack[i:]):
                    flush()
                cut(i)
                return
            if stack[i][0] in walls:
                return

    for kind, name, attrs in tokens(page):
        if kind == "text":
            if not buffer:
                path, skip = "/".join(x for n, _, x in stack[:DEPTH] if n in BLOCK), count["hidden"] > 0
            buffer.append(name)
            if count["a"]:
                links += len(name.strip())
            continue
        if name in BLOCK:
            flush()
        if kind == "close":
            close(name, frozenset() if name in BLOCK else BLOCK - {"p"})
            continue
        if name in ENDS_P:
            close("p", BLOCK - {"p"})
        if name in ALONE:
            close(name, BLOCK - {name})
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        inside = count["main"] > 0
        hidden = name in SKIP and not (name == "header" and inside) or name not in WHOLE and _marked(attrs, inside)
        if hidden:
            flush()
        if hidden or name in BLOCK or name == "a":
            stack.append((name, hidden, _labelled(name, attrs)))
            note(name, hidden, 1)
    flush()
    return out


# Wrappers. A node is ["tag", name], ["text", string or None for a slot], ["opt", nodes] or ["rep", nodes].


def _shape(node: list) -> str:
    return node[1] if node[0] == "tag" else "#" if node[0] == "text" else node[0] + "(" + " ".join(map(_shape, node[1])) + ")"


def _folded(nodes: list[list]) -> list[list]:
    """Adjacent equal runs of up to twelve nodes become repeated groups, shortest runs first."""
    for width in range(1, 13):
        shapes, out, i = [_shape(n) for n in nodes], [], 0
        while i < len(nodes):
            j = i + width
            if j <= len(nodes) and any(n[0] == "tag" for n in nodes[i:j]) and shapes[i:j] == shapes[j : j + width]:
                group = nodes[i:j]
                while shapes[j : j + width] == shapes[i : i + width]:
                    group = [_joined(a, b) for a, b in zip(group, nodes[j : j + width], strict=True)]
                    j += width
                out.append(["rep", group])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _joined(a: list, b: list) -> list:
    """Two nodes of one shape as one."""
    if a[0] == "text":
        return ["text", a[1] if a[1] == b[1] else None]
    if a[0] == "tag":
        return a
    return [a[0], [_joined(x, y) for x, y in zip(a[1], b[1], strict=True)] if len(a[1]) == len(b[1]) else a[1]]


def page_nodes(page: str) -> list[list]:
    out: list[list] = []
    for kind, name, attrs in tokens(page):
        if kind == "text":
            text = _SPACE.sub(" ", entities.unescape(name)).strip()
            if text:
                out.append(["text", text])
        else:
            out.append(["tag", f"/{name}" if kind == "close" else _labelled(name, attrs)])
    return _folded(out)


def aligned(wrapper: list[list], page: list[list]) -> list[list]:
    """The wrapper generalised to the page, or to another wrapper: equal shapes are joined; what only one side has becomes optional, or, where it
    repeats its neighbour's shape, that neighbour a repeated group."""
    bare, plain = ([n[1][0] if n[0] == "opt" and len(n[1]) == 1 else n for n in side] for side in (wrapper, page))
    key = lambda n: "rep:" + _shape(n[1][0]) if n[0] == "rep" else _shape(n)
    a, b = [key(n) for n in bare], [key(n) for n in plain]
    out: list[list] = []

    def extra(nodes: list[list]) -> None:
        for n in nodes:
            inner = n if n[0] in ("opt", "rep") else None
            if out and out[-1][0] == "rep" and len(out[-1][1]) == 1 and _shape(out[-1][1][0]) == _shape(n):
                out[-1][1][0] = _joined(out[-1][1][0], n)
            elif out and out[-1][0] not in ("opt", "rep") and n[0] == "tag" and _shape(out[-1]) == _shape(n):
                out[-1] = ["rep", [n]]
            else:
                out.append(inner if inner and inner[0] == "opt" else ["opt", [n]])

    for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y, w, v in zip(bare[i1:i2], plain[j1:j2], wrapper[i1:i2], page[j1:j2], strict=True):
                node = _joined(x, y)
                out.append(["opt", [node]] if "opt" in (w[0], v[0]) else node)
        else:
            extra(wrapper[i1:i2])
            extra(page[j1:j2])
    return out


def infer(pages: list[str]) -> list[list]:
    wrapper: list[list] = []
    for i, page in enumerate(pages):
        nodes = page_nodes(page)
        wrapper = nodes if i == 0 else aligned(wrapper, nodes)
    return wrapper


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression over tags and slots, for people."""
    out = []
    for kind, value in wrapper:
        if kind == "tag":
            out.append(f"<{value}>")
        elif kind == "text":
            out.append("#TEXT" if value is None else re.escape(value))
        else:
            out.append(f"({expression(value)})" + ("?" if kind == "opt" else "+"))
    return "".join(out)


def _texts(wrapper: list[list]) -> set[str]:
    """The fixed texts of a wrapper."""
    out: set[str] = set()
    for kind, value in wrapper:
        if kind == "text" and value is not None:
            out.add(value)
        elif kind in ("opt", "rep"):
            out |= _texts(value)
    return out


def _hash(text: str) -> int:
    """Fixed texts are counted and known by 64 bits of a hash, so that articles are not shuffled."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def _counts(page: str) -> dict[tuple[int, str], list[int]]:
    """(text, container): [1 where the page first has the text, characters that may be main text]."""
    out: dict[tuple[int, str], list[int]] = {}
    seen: set[int] = set()
    for path, skipped, links, text in blocks(page):
        h = _hash(text)
        n = out.setdefault((h, _container(path)), [0, 0])
        n[0] += h not in seen
        seen.add(h)
        if not skipped and 2 * links <= len(text):
            n[1] += len(text)
    return out


def learn(pages: list[str]) -> dict:
    """What a host's wrapper says: its expression, the fixed texts (hashes), and where the slots with the article's text are."""
    wrapper = infer(pages)
    inside = {_hash(t) for t in _texts(wrapper)}
    every = [item for page in pages for item in _counts(page).items()]
    on: dict[int, int] = {}
    for (h, _), (n, _) in every:
        on[h] = on.get(h, 0) + n
    # A repeated group has slots only, so a text that nearly all pages share counts as fixed wherever it stands.
    fixed = {h for h, n in on.items() if n >= max(SHARED, len(pages) // 2) and (h in inside or 10 * n >= 9 * len(pages))}
    mass: dict[str, int] = {}
    for (h, top), (_, size) in every:
        if size and h not in fixed:
            mass[top] = mass.get(top, 0) + size
    return {"wrapper": expression(wrapper), "fixed": sorted(fixed), "main": max(sorted(mass), key=mass.get) if mass else ""}


def _container(path: str) -> str:
    """The place of a text's surroundings: down to the innermost article or main, or else the path without its last element."""
    parts = path.split("/")
    for i in range(len(parts) - 1, -1, -1):
        if parts[i] in MAIN:
            return "/".join(parts[: i + 1])
    return "/".join(p for p in parts if p.split(".")[0] not in INNER)


def main_text(page: str | None, rules: dict | None) -> str:
    """The article of a page under its host's rules. A page without anything at the wrapper's main place falls back on its
    own: the article or main element, or the surroundings with most text outside links."""
    found = [(path, text, links) for path, skipped, links, text in blocks(page or "") if not skipped]
    fixed = set((rules or {}).get("fixed", ()))
    found = [(p, t, k) for p, t, k in found if not fixed or _hash(t) not in fixed or any(x in MAIN for x in p.split("/"))]
    main = (rules or {}).get("main")
    inside = lambda p, top: p == top or p.startswith(top + "/") if top else True
    if main and any(inside(p, main) for p, _, _ in found):
        return " ".join(t for p, t, _ in found if inside(p, main))
    mass: dict[str, int] = {}
    for p, t, links in found:
        if 2 * links <= len(t):
            mass[_container(p)] = mass.get(_container(p), 0) + len(t)
    if not mass:
        return ""
    named = {p: n for p, n in mass.items() if p.split("/")[-1] in MAIN}
    pool = named or mass
    top = max(sorted(pool), key=pool.get)
    return " ".join(t for p, t, _ in found if inside(p, top))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_PART = "host string, first long, pages long, wrapper string, text long, top string, n long, mass long"


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a task's pages say of their hosts: rows with a wrapper and the number of its pages, and rows with counts of texts."""
    hosts: dict[str, list] = {}
    texts: dict[tuple[str, int, str], list[int]] = {}
    columns = [c.split()[0] for c in _PART.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("first", "pages", "text", "n", "mass")})

    def flushed(some: bool) -> Iterator[pd.DataFrame]:
        if len(hosts) >= (HOSTS if some else 1):
            yield frame([(h, first, n, json.dumps(w), None, None, None, None) for h, (first, n, w) in hosts.items()])
            hosts.clear()
        if len(texts) >= (TEXTS if some else 1):
            yield frame([(h, None, None, None, t, top, n, mass) for (h, t, top), (n, mass) in texts.items()])
            texts.clear()

    for pdf in batches:
        for page_id, h, html in zip(pdf["page_id"].tolist(), pdf["host"], pdf["html"], strict=True):
            nodes = page_nodes(html)
            first, n, wrapper = hosts.get(h, (page_id, 0, None))
            hosts[h] = [min(first, page_id), n + 1, nodes if wrapper is None else aligned(wrapper, nodes)]
            for (t, top), (n, mass) in _counts(html).items():
                own = texts.setdefault((h, t, top), [0, 0])
                own[0] += n
                own[1] += mass
            yield from flushed(True)
    yield from flushed(False)


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """host and rules (JSON), from all rows with a page_id; of repeated rows each counts.

    Pages are not shuffled: of a host, the wrapper of each task's pages is, and the counts of its texts by hash, summed with map-side combining. So
    no host's pages meet in one task; a group holds one small wrapper for each task.
    """
    thin = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    bounded_batches(pages.sparkSession)
    parts = stored(thin.mapInPandas(_parts, _PART), "wrapper-parts")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = reduce(aligned, map(json.loads, pdf.sort_values(["first", "wrapper"])["wrapper"]))
        inside = sorted({_hash(t) for t in _texts(wrapper)})
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "pages": [int(pdf["pages"].sum())], "wrapper": [expression(wrapper)], "inside": [inside]})

    hosts = parts.where("wrapper is not null").select("host", "first", "pages", "wrapper")
    hosts = stored(hosts.groupBy("host").applyInPandas(merged, "host string, pages long, wrapper string, inside array<long>"), "wrappers")
    texts = parts.where("text is not null")
    on = texts.groupBy("host", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED)
    half = F.col("n") >= F.floor(F.col("pages") / 2)
    fixed = on.join(hosts.select("host", "pages", "inside"), "host").where(half & (F.array_contains("inside", F.col("text")) | (10 * F.col("n") >= 9 * F.col("pages"))))
    fixed = stored(fixed.select("host", "text"), "fixed")
    mass = texts.where("mass > 0").join(fixed, ["host", "text"], "left_anti").groupBy("host", "top").agg(F.sum("mass").alias("mass"))
    main = mass.groupBy("host").agg(F.min_by("top", F.struct((-F.col("mass")).alias("m"), "top")).alias("main"))
    rules = hosts.select("host", "wrapper").join(fixed.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("fixed")), "host", "left").join(main, "host", "left")
    filled = F.struct("wrapper", F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"), F.coalesce("main", F.lit("")).alias("main"))
    return stored(rules.select("host", F.to_json(filled).alias("rules")), "rules")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty html give an empty text; a null or odd url belongs to the host "", whose pages share a wrapper. Rows with
    a null page_id are extracted but never learnt from; repeated rows keep a row each; an empty table gives no rows; other columns are
    ignored. Whole pages are read, by the alignment too.
    """
    rules = learn_wrappers(pages).select(F.col("host").alias("_host"), F.col("rules").alias("_rules"))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("_host"))
    joined = page.join(rules, "_host", "left")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict] = {}
        for html, rule in batches:
            out = []
            for h, r in zip(html, rule, strict=True):
                if r is not None and r not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[r] = json.loads(r)
                out.append(main_text(h, known.get(r) if r is not None else None))
            yield pd.Series(out, dtype=object)

    return joined.select("page_id", "url", text("html", "_rules").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
