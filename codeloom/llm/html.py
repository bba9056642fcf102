"""Main text of web pages by equivalence-class template deduction (operator 4).

Pages of one host come from one template. Every page is read into structural tokens (an element's path of block tags with
their class or id) and text slots (the text under a path). For each host and token, the occurrence vector over the
host's pages is kept as its support, its sum and a 64-bit fingerprint, all of which add up across tasks, so a host of any
size needs no single task to see its pages. Tokens of one host with equal vectors form an equivalence class; a class that
is large and frequent enough, with all of its tokens nested in order, is valid. Valid classes nest by path into the host's
template. The slots between template tokens hold the data. Extraction keeps the slots of the template's main region (an
``article`` or ``main`` node, else the node that holds most of the text) and leaves out slots of page furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments) and slots whose text is the same on all pages of the host.
A container that is furniture by its name only, or a form, is a layout wrapper and no furniture when it holds the host's
main region, the page's article, its heading or nearly all of its text (``wrappers``).
A page that does not have its host's main region is read by its own structure, as is the page of a host without others.

Text is kept block by block: character references are decoded, white space inside a block becomes one space, blocks are
joined by line feeds in page order, empty blocks are dropped. Null or empty html, or a page without main text, gives the
empty string. A null url is a host of its own (''). Repeated rows count as further pages and are extracted row by row.
Extra columns are ignored. Cut-off pages are read as far as they go.
"""

from __future__ import annotations

import hashlib
import html as _html
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class TemplateRules:
    min_class: int = 2  #: tokens of a valid class
    min_share: float = 0.3  #: of a host's pages that a valid class occurs on
    min_pages: int = 4  #: of a host before any text counts as template text
    template_share: float = 0.9  #: of a host's pages that template text is on
    few_pages: int = 16  #: of a host before a slot that reads one of few texts counts as template text:
    few: int = 4  #: on average, each of them is on so many pages
    region_share: float = 0.6  #: of a region's text that makes a child the better region
    broadcast_hosts: int = 100_000  #: page counts of so many counted hosts, at most, are broadcast
    broadcast_bytes: int = 8 << 20  #: templates are broadcast when they have been measured and are no larger


# Element names of HTML and common names of page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas"])
FURNITURE = frozenset("head nav header footer aside form button select menu dialog script style textarea title noscript iframe template svg math object canvas".split())
_FURNITURE_NAME = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|masthead|banner|topbar|header|footer|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|notice|consent|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|discussion|disqus|respond|repl(?:y|ies)|form|search|login|signup|widget|toolbar|pager|pagination|copyright|legal)(?:$|[-_\s])",
    re.IGNORECASE,
)
_FURNITURE_WORD = re.compile(re.search(r"\(\?:nav.*\|legal\)", _FURNITURE_NAME.pattern)[0], re.IGNORECASE)
SOFT = frozenset(["form"])  # elements that are judged like names
MAIN = frozenset(["article", "main"])
_MAIN_NAME = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story|body-text|text)(?:$|[-_\s])", re.IGNORECASE)
#: An opening tag ends these open elements: HTML leaves their end tags out.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "body": ("head",)}
LIST_OF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

#: Quotes count only behind an equals sign: an unquoted value may hold them.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^<>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_NAMED = re.compile("class|id|role", re.IGNORECASE)


def names_of(attributes: str) -> dict[str, str]:
    """Class, id and role of an element."""
    if not _NAMED.search(attributes):
        return {}
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes) if _NAMED.fullmatch(k)}


@dataclass
class Soft:
    """An element that is furniture by its name, or a form: perhaps a wrapper of the page's text."""

    above: int  #: the next such element around it, -1 for none
    path: str
    exact: bool  #: one of its names is a furniture word by itself


def wrappers(soft: list[Soft], mains: list[tuple[int, int]], blocks: list[tuple], region: str) -> list[bool]:
    """Which of ``soft`` are layout wrappers: not furniture by themselves.

    Those around the host's ``region``; else, from the outside in, one that holds

    * an article or main element with more text than there is outside of all furniture (four times as much when a main
      element has text there, or when the container's name is a furniture word by itself), or
    * the page's only h1 and more text than is outside, or
    * most of the page's text and four times what is outside (twenty times when a main element has text there, or for such a
      name).

    ``mains`` gives the soft and the main element around each main element, ``blocks`` are (path, text, furniture by tag, soft element
    around, main element around, in h1).
    """
    open_ = [bool(region) and nested(region, x.path) for x in soft]
    total, held = 0, [0] * len(soft)
    main_of: list[dict[int, int]] = [{} for _ in soft]  # per soft element: text of main elements with that element around
    heads = [False] * len(soft)
    for _, text, hard, i, main, h1 in blocks:
        total += len(text)
        if hard:
            continue
        chain = []
        while i >= 0:
            chain.append(i)
            i = soft[i].above
        while main >= 0:
            at = mains[main][0]
            for c in chain:
                if at == c or at in chain[: chain.index(c)]:
                    main_of[c][main] = main_of[c].get(main, 0) + len(text)
            main = mains[main][1]
        for c in chain:
            held[c] += len(text)
            heads[c] = heads[c] or h1
    while True:
        closed: list[bool] = []
        for x, o in zip(soft, open_, strict=True):
            closed.append(not o or (x.above >= 0 and closed[x.above]))
        free = free_main = 0
        free_head = False
        for _, text, hard, i, main, h1 in blocks:
            if not hard and (i < 0 or not closed[i]):
                free += len(text)
                free_main += len(text) * (main >= 0)
                free_head = free_head or h1
        outer = [i for i, x in enumerate(soft) if not open_[i] and held[i] and (x.above < 0 or not closed[x.above])]
        for i in sorted(outer, key=lambda i: -held[i]):
            doubt = free_main > 0 or soft[i].exact
            if (
                max(main_of[i].values(), default=0) > free * (4 if doubt else 1)
                or (heads[i] and not free_head and held[i] > free)
                or (2 * held[i] > total and held[i] > free * (20 if doubt else 4))
            ):
                open_[i] = True
                break
        else:
            return open_


def page_parts(page: str, region: str = "") -> tuple[list[str], list[tuple[str, str, bool]]]:
    """Structural tokens and text blocks of a page: paths of opened elements, and (path, text, in page furniture). What holds
    the host's main ``region`` is not furniture."""
    tokens: list[str] = []
    blocks: list[tuple[str, str, bool, int, int, bool]] = []
    soft: list[Soft] = []
    mains: list[tuple[int, int]] = []  # soft element around, main element around
    stack: list[tuple[str, str, bool, int, int, bool]] = [("", "", False, -1, -1, False)]  # tag, path, furniture by tag, soft and main element, in h1
    text: list[str] = []

    def flush():
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if s:
                blocks.append((stack[-1][1], s, *stack[-1][2:]))

    def pop_to(tags, stop=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                del stack[i:]
                return True
            if stack[i][0] in stop:
                return False
        return False

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
            continue
        if m[1]:
            if tag in INLINE and not any(s[0] == tag for s in stack[1:]):
                continue
            pop_to((tag,))
            continue
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            tokens.append(f"{stack[-1][1]}/{tag}")
            at = end.end() if end else n
            continue
        names = names_of(m[3])
        hard = tag in FURNITURE and tag not in SOFT
        named = tag not in MAIN and tag not in ("body", "html") and any(_FURNITURE_NAME.search(v or "") for v in names.values())
        if tag in INLINE and not (hard or named or tag in SOFT):
            continue
        flush()
        if tag in VOID:
            tokens.append(f"{stack[-1][1]}/{tag}")
            continue
        if tag in CLOSES:
            while pop_to(CLOSES[tag], LIST_OF.get(tag, ())):
                pass
        if stack[-1][0] == "p" and tag not in INLINE:
            stack.pop()
        name = names.get("id") or names.get("class") or ""
        path = f"{stack[-1][1]}/{tag}" + (f".{'.'.join(name.replace('#', '').split()[:2])}" if name else "")
        tokens.append(path)
        if not m[3].endswith("/"):
            _, _, inside, around, main, h1 = stack[-1]
            if named or tag in SOFT:
                soft.append(Soft(around, path, any(_FURNITURE_WORD.fullmatch(w) for v in names.values() for w in (v or "").split())))
                around = len(soft) - 1
            if tag in MAIN and not inside and not hard and not any(_FURNITURE_NAME.search(v or "") for v in names.values()):
                mains.append((around, main))
                main = len(mains) - 1
            stack.append((tag, path, inside or hard, around, main, h1 or tag == "h1"))
    flush()
    if not any(i >= 0 and not hard for _, _, hard, i, _, _ in blocks):
        return tokens, [(p, s, hard) for p, s, hard, *_ in blocks]
    open_ = wrappers(soft, mains, blocks, region)
    closed: list[bool] = []
    for x, o in zip(soft, open_, strict=True):
        closed.append(not o or (x.above >= 0 and closed[x.above]))
    return tokens, [(p, s, hard or (i >= 0 and closed[i])) for p, s, hard, i, *_ in blocks]


def host_of(url: str | None) -> str:
    """Lower-cased host of ``url``, without scheme, user and port; as ``host_column``."""
    s = re.sub(r"^[a-z+.-]*://", "", (url or "").strip(" ").lower())
    return re.sub(r"^[^/@]*@", "", re.sub(r"[/?#].*$", "", s, flags=re.DOTALL)).split(":")[0]


def host_column(url: str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z+.-]*://", "")
    return F.split_part(F.regexp_replace(F.regexp_replace(s, r"(?s)[/?#].*$", ""), r"^[^/@]*@", ""), F.lit(":"), F.lit(1))


def mix(x: int) -> int:
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 29)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 32)


def text_hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def text_token(path: str, text: str) -> str:
    """The token of a block that reads ``text``."""
    return f"{path}#={text_hash(text):x}"


TOKENS = "host string, token string, pages long, sum long, vector long, chars long, furniture long, least long, most long, bits long"


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: pages that have it, occurrences, fingerprint of the vector; for slots and block texts their sizes and
    whether they are furniture on most of their pages; for slots the least and greatest hash of what they read, and a bitmap of
    these hashes, which tells constant slots and those that read one of a few texts.

    The empty token of a host stands for its pages. Sums are taken in every task before the shuffle.
    """

    def run(batches):
        seen: dict[tuple[str, str], list] = {}

        def signed(x):
            return x - (1 << 64) if x is not None and x >> 63 else x

        def batch():
            flat = [[h, t, *map(signed, v)] for (h, t), v in seen.items()]
            seen.clear()
            types = [pa.string(), pa.string(), *[pa.int64()] * 8]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], type=t) for i, t in enumerate(types)], names=["host", "token", "pages", "sum", "vector", "chars", "furniture", "least", "most", "bits"])

        for b in batches:
            for i, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens, blocks = page_parts(page or "")
                host, key = host_of(url), mix(text_hash(f"{i} {url}"))
                count: dict[str, list] = defaultdict(lambda: [0, 0, False, None])
                count[""][0] = 1
                for t in tokens:
                    count[t][0] += 1
                joined: dict[str, list[str]] = defaultdict(list)
                for path, text, furniture in blocks:
                    for t in (path + "#", text_token(path, text)):
                        c = count[t]
                        c[0] += 1
                        c[1] += len(text)
                        c[2] = c[2] or furniture
                    joined[path + "#"].append(text)
                for t, parts in joined.items():
                    count[t][3] = text_hash("\n".join(parts))
                for t, (k, chars, furniture, reads) in count.items():
                    v = seen.get((host, t))
                    if v is None:
                        v = seen[host, t] = [0, 0, 0, 0, 0, reads, reads, None if reads is None else 0]
                    v[0] += 1
                    v[1] += k
                    v[2] ^= mix(key + k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    v[3] += chars
                    v[4] += furniture
                    if reads is not None:
                        v[5], v[6], v[7] = min(v[5], reads), max(v[6], reads), v[7] | 1 << (reads & 63)
                if len(seen) > 50_000:
                    yield batch()
        if seen:
            yield batch()

    rows = pages.select("page_id", "url", "html").mapInArrow(run, TOKENS)
    sums = [F.sum(c).alias(c) for c in ("pages", "sum", "chars")]
    return rows.groupBy("host", "token").agg(*sums, F.bit_xor("vector").alias("vector"), (2 * F.sum("furniture") > F.sum("pages")).alias("furniture"), F.min("least").alias("least"), F.max("most").alias("most"), F.bit_or("bits").alias("bits"))


def nested(path: str, parent: str) -> bool:
    return path == parent or path.startswith(parent + "/") or path.startswith(parent + "#")


def deduce(n: int, rows: list[dict], rules: TemplateRules) -> tuple[list[dict], str, list[str]]:
    """Valid classes of a host, its main region's path ('' for none), and the slots and block texts that are template text."""
    groups: dict[tuple, list[dict]] = defaultdict(list)
    texts, rows = [r for r in rows if "#=" in r["token"]], [r for r in rows if "#=" not in r["token"]]
    for r in rows:
        if r["token"] and r["pages"] >= rules.min_share * n:
            groups[r["pages"], r["sum"], r["vector"]].append(r)
    classes = []
    for (pages, total, vector), members in groups.items():
        paths = sorted(m["token"] for m in members if not m["token"].endswith("#"))
        # Nested in order: each token's path is another's, extended, or starts below the same node.
        top = paths[0].rsplit("/", 1)[0] if paths else ""
        if len(paths) >= rules.min_class or (paths and total > pages):
            classes.append({"pages": pages, "sum": total, "vector": vector, "tokens": [p for p in paths if nested(p, top) or not top]})
    classes.sort(key=lambda c: (-c["pages"], c["sum"], c["tokens"]))

    slots = [r for r in rows if r["token"].endswith("#") and not r["furniture"]]
    template = {t for c in classes for t in c["tokens"]}
    once = [r["token"] for r in rows if r["token"] in template and r["sum"] == r["pages"]]
    held = lambda p: sum(s["chars"] for s in slots if nested(s["token"], p))
    total = sum(s["chars"] for s in slots)
    region = ""
    if total:
        tag = lambda p: p.rsplit("/", 1)[-1].split(".")[0].rstrip("#")
        named = [p for p in once if tag(p) in MAIN and held(p) >= 0.1 * total]
        if named:
            # The innermost of the named nodes that still has most of its text.
            region = max(named, key=lambda p: (held(p) >= rules.region_share * max(map(held, named)), tag(p) == "article", len(p)))
        else:
            at, size = "", total
            while True:
                below = [(held(p), p) for p in once if nested(p, at) and p != at and p.count("/") > at.count("/")]
                best = max(below, default=(0, ""), key=lambda x: (x[0], -len(x[1])))
                if best[0] < rules.region_share * size:
                    break
                at, size = best[1], best[0]
            region = at
    if n < rules.min_pages:
        return classes, region, []
    # Template text: slots that read the same, or one of few texts, on their pages; and block texts that share the vector of a
    # valid class, or come once on nearly all pages. Where most of the region would go, the pages are copies of one another.
    largest = max(slots, key=lambda s: s["chars"], default=None)
    inside = lambda rs: [r for r in rs if nested(r["token"], region) and not r["furniture"] and r["pages"] >= rules.template_share * n]
    vectors = {(c["pages"], c["sum"], c["vector"]) for c in classes}
    fixed = [s for s in inside(slots) if s is not largest and (s["least"] == s["most"] or (n >= rules.few_pages and distinct(s["bits"]) * rules.few <= s["pages"]))]
    known = {s["token"] for s in fixed}
    fixed += [t for t in inside(texts) if t["token"].split("#=")[0] + "#" not in known and (t["sum"] == t["pages"] or (t["pages"], t["sum"], t["vector"]) in vectors)]
    if 2 * sum(t["chars"] for t in fixed) > held(region):
        return classes, region, []
    return classes, region, sorted(t["token"] for t in fixed)


def distinct(bits: int) -> float:
    """About how many hashes a bitmap of 64 has seen; infinite when it is nearly full."""
    empty = 64 - (bits & (1 << 64) - 1).bit_count()
    return 64 * math.log(64 / empty) if empty > 8 else math.inf


TEMPLATES = "host string, n_pages long, region string, fixed array<string>, classes array<struct<pages:long,sum:long,vector:long,tokens:array<string>>>"


def templates(pages: DataFrame, rules: TemplateRules | None = None) -> DataFrame:
    """One row per host: its pages, main region, constant slots and valid classes."""
    rules = rules or TemplateRules()
    vectors = materialize(occurrence_vectors(pages), "html-vectors")
    counts = materialize(vectors.where(F.col("token") == "").select(F.col("host").alias("_h"), F.col("pages").alias("n_pages")), "html-hosts")
    few = counts.count() <= rules.broadcast_hosts
    # Tokens on few of a host's pages belong to no template; the rest are at most 1 / min_share times a page's tokens. They are told
    # before they meet by host: a host has as many different texts as it likes.
    is_text = F.contains("token", F.lit("#="))
    possible = vectors.where(~is_text | (F.col("pages") >= rules.template_share * rules.min_pages))
    enough = F.when(is_text, (F.col("n_pages") >= rules.min_pages) & (F.col("pages") >= rules.template_share * F.col("n_pages"))).otherwise(F.col("pages") >= rules.min_share * F.col("n_pages"))
    frequent = possible.join(F.broadcast(counts) if few else counts, F.col("host") == F.col("_h")).where(enough)
    frequent = frequent if few else materialize(frequent, "html-frequent")  # an exchange of its own, so that a skewed join can split hosts
    fields = ["token", "pages", "sum", "vector", "chars", "furniture", "least", "most", "bits"]
    grouped = frequent.groupBy("host", "n_pages").agg(F.collect_list(F.struct(*fields)).alias("rows"))

    def run(batches):
        kind = pa.list_(pa.struct([("pages", pa.int64()), ("sum", pa.int64()), ("vector", pa.int64()), ("tokens", pa.list_(pa.string()))]))
        for b in batches:
            out = [[], [], [], [], []]
            for host, n, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                classes, region, fixed = deduce(n, rows, rules)
                for c, v in zip(out, (host, n, region, fixed, classes), strict=True):
                    c.append(v)
            types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=["host", "n_pages", "region", "fixed", "classes"])

    return grouped.mapInArrow(run, TEMPLATES)


def main_text(page: str | None, region: str, fixed: frozenset[str]) -> str:
    tokens, blocks = page_parts(page or "", region)
    if not region or region not in tokens:
        tag = lambda p: p.rsplit("/", 1)[-1].split(".")[0]
        mains = [t for t in tokens if tag(t) in MAIN]
        region = next((t for t in mains if tag(t) == "article"), mains[0] if mains else "")
        if not any(nested(p, region) and not f for p, _, f in blocks):
            region = ""
    own = any("#=" in f for f in fixed)
    return "\n".join(t for p, t, furniture in blocks if not furniture and nested(p, region) and p + "#" not in fixed and not (own and text_token(p, t) in fixed))


def extract_main_text(pages: DataFrame, rules: TemplateRules | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    rules = rules or TemplateRules()
    pages = pages.select("page_id", "url", "html")
    found = materialize(templates(pages, rules).select("host", "region", "fixed"), "html-templates")
    size = found.agg(F.sum(F.length("host") + F.length("region") + F.length(F.concat_ws("", "fixed")) + 48)).first()[0] or 0
    keyed = pages.withColumn("_host", host_column("url"))
    joined = keyed.join(F.broadcast(found) if size <= rules.broadcast_bytes else found, keyed._host == found.host, "left").select("page_id", "url", "html", "region", "fixed")

    def run(batches):
        for b in batches:
            ids, urls, bodies, regions, fixed = (c.to_pylist() for c in b.columns)
            texts = [main_text(x, r or "", frozenset(f or ())) for x, r, f in zip(bodies, regions, fixed, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
