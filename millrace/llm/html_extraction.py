"""Main text of web pages by equivalence classes of template tokens.

A page is read as tokens: elements by their path, and blocks of text by path and content. Tokens of a host whose
occurrence vectors (how often in which page) are equal form a class. A class is valid if it is in most pages of the host
and has several tokens, an element among them, that every page has equally often. The elements of valid classes that a
page has once are the host's template; they nest by their paths, and what they hold differs from page to page: slots.

Slots are judged by what the whole host has in them. Text that is a template token itself, the same on most pages, is
furniture wherever it stands. The core is the innermost slot with most of the host's other text outside links. Slots
beside it are furniture if most of their text is in links, and at page level also if they are small next to the core;
headings and slots in one wrapper with the core belong to it. Names of elements, roles and classes only break ties: within
the core, in heavy slots beside it, in parts that are not in the template, and on pages of hosts with too few pages for
classes. An article decides only where the template leaves it no text of its own: if it is longer than what is left of the
page, it is a copied article and stays.

Vectors are compared by a sum of hashes, in one aggregation by (host, token) with partial sums, so a host with a third of
all pages costs no task more than its tokens. A template is as long as its host's pages are, and hosts' templates are
broadcast only while Spark finds them small. The time to read a page is in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shown_id, whole_id

#: Share of a host's pages, and pages at least, that have a template's tokens.
SHARE = 0.8
LEAST = 5
#: Share of a host's own text that the core has; of text in links that makes a slot furniture; of the core's share of text
#: that no other page of any host has, below which a slot at page level is.
CORE, LINKED, SINGLE = 0.6, 0.5, 0.5
#: Characters a page has in a slot at page level, on average, below which it is a label ("Written by ...") and no sentence.
LABEL = 20
#: Open elements, and steps of a path, that are told apart; deeper ones count as their parents.
DEEP, STEPS = 256, 40

# fixed values: element names of HTML, and words of class names, ids and roles
RAW = frozenset("script style title textarea".split())
SKIPPED = frozenset("noscript template iframe object svg select datalist button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3".split())
#: What an article's text stands in, without an element of its own around it.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements that come in numbers, so that their places among each other say nothing.
SERIAL = frozenset("p li tr td th dt dd hr".split())
#: Elements whose classes and ids often name the page.
WHOLE = frozenset("html body article main".split())
FURNITURE = frozenset("head nav footer aside form menu dialog fieldset label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar "
    "pagination pager skip skiplink hidden".split()
)

# an attribute's value ends at its quote; a quote without a second one is part of a name, as one before a name is. Nothing
# is given back, so a tag is read once; one without an end takes the rest of the page
_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+"
_TOKEN = re.compile(rf"<!--(?:-?>)?+|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[\s/]++|{_ATTRIBUTE})*+)(?P<close>>|\Z)|<[!?][^>]*+(?:>|\Z)", re.I)
_SIMPLE = re.compile(r"<!--(?:-?>)?+|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>[^>]*+)(?P<close>>)|<[!?][^>]*+>", re.I)
_ATTRIBUTES = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PLAIN = re.compile(r"[a-z_-]+", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A start tag of the first closes an open one of the second, if nothing of the third is between.
_CLOSES = {name: frozenset(["p"]) for name in BLOCK} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
_WALLS = frozenset("ul ol dl table tbody thead tfoot div section article main body nav footer header aside form blockquote td th".split())


class Block(NamedTuple):
    key: str  # path and content
    text: str
    furniture: bool
    place: str  # "article", "main" or ""


class Element(NamedTuple):
    path: str
    chars: int
    linked: int  # of these, in links
    hinted: bool


class Template(NamedTuple):
    """Of a host: texts that most pages have, elements that are furniture, and the core with what is around it."""

    texts: frozenset[str] = frozenset()
    furniture: frozenset[str] = frozenset()
    core: frozenset[str] = frozenset()


class _Open(NamedTuple):
    name: str
    path: str
    furniture: bool
    place: str
    hints: tuple[int, ...]  # hinted elements around
    hinted: bool
    element: bool  # a token of its own
    quiet: bool  # part of a block, and furniture
    chars: int  # before it
    linked: int
    labels: Counter


class _Said(NamedTuple):
    """What the attributes of an element say."""

    furniture: bool
    hinted: bool
    label: str


def _said(name: str, rest: str, known: dict[tuple[str, str], _Said]) -> _Said:
    if (found := known.get((name, rest))) is not None:
        return found
    given: dict[str, str] = {}
    for m in _ATTRIBUTES.finditer(rest):
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    whole = name in WHOLE
    hidden = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or bool(_NONE.search(given.get("style", "")))
    names = entities.unescape(f"{given.get('class', '')} {given.get('id', '')}").split()
    # a hint says furniture with all its words: cookie-notice does, with-sidebar and no-comments don't
    hinted = any(words and all(w.lower() in HINTS for w in words) for words in map(_WORDS.findall, names))
    label = ".".join([name, *sorted({n for n in given.get("class", "").split() if _PLAIN.fullmatch(n)})[:4]])
    found = _Said(not whole and (hidden or given.get("role", "").strip().lower() in ROLES), not whole and hinted, name if whole else label[:80])
    if len(known) < 10_000:
        known[name, rest] = found
    return found


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of each tag; without a name what is not to be shown."""
    token, at, limit = _TOKEN, 0, len(page)
    ends: dict[str, list[int]] = {}
    while m := token.search(page, at, limit):
        start, at = m.span()
        name = m["name"]
        if name is None:
            if page.startswith("<!--", start) and m[0] == "<!--":
                at = page.find("-->", at)
                at = limit if at < 0 else at + 3
            yield start, at, "", False, ""
            continue
        if not m["close"]:
            # never closed: from here on a tag ends at the next >, and what has none is text
            token, at, limit = _SIMPLE, start, page.rfind(">") + 1
            if at >= limit:
                return
            continue
        name, end = name.lower(), bool(m["end"])
        if not end and (name in RAW or name in SKIPPED and not m["rest"].endswith("/")):
            if name not in ends:
                ends[name] = [e.start() for e in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)]
            k = bisect_left(ends[name], at)
            if k < len(ends[name]):
                at = page.find(">", ends[name][k])
                at = limit if at < 0 else at + 1
            elif name in RAW:
                at = limit
            yield start, at, "", False, ""
            continue
        yield start, at, name, end, m["rest"]


def parse(page: str, template: Template = Template(), known: dict | None = None) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, and the elements of the page."""
    known = {} if known is None else known
    blocks: list[Block] = []
    found: list[Element] = []
    stack = [_Open("", "", False, "", (), False, False, False, 0, 0, Counter())]
    open_: Counter[str] = Counter()
    hinted: list[tuple[int, ...]] = []  # of each block
    mains: set[int] = set()  # hinted elements around a main element
    numbers = chars = linked = 0
    parts: list[str] = []
    links: list[str] = []  # of the parts, those in links

    def flush() -> None:
        nonlocal chars, linked
        if not parts:
            return
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            top = stack[-1]
            blocks.append(Block(f"{top.path}#{text}", text, top.furniture, top.place))
            hinted.append(top.hints)
            chars += len(text)
            linked += min(len(text), len("".join("".join(links).split())))
        links.clear()

    def close(k: int) -> None:
        for e in stack[k:]:
            open_[e.name] -= 1
            if e.element:
                found.append(Element(e.path, chars - e.chars, linked - e.linked, e.hinted))
        del stack[k:]

    def show(text: str) -> None:
        if stack[-1].quiet:
            return
        parts.append(text)
        if open_["a"]:
            links.append(text)

    done = 0
    for start, at, name, end, rest in _tags(page):
        if start > done:
            show(page[done:start])
        done = at
        if not name:
            continue
        block = name in BLOCK
        if block:
            flush()
        elif name == "br":
            parts.append(" ")
        if end:
            if open_[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if (closes := _CLOSES.get(name)) and any(open_[c] for c in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    close(k)
                    break
                if stack[k].name in _WALLS:
                    break
        if name in VOID or rest.endswith("/") and not block:
            continue
        top = stack[-1]
        said = _said(name, rest, known) if rest else _Said(False, False, name)
        # other elements matter only for what they say of what is in them, and where one like them is open
        plain = name in FURNITURE or name == "header" and not top.place or said.furniture
        if len(stack) > DEEP or not (block or name == "a" or plain or said.hinted or open_[name]):
            continue
        element = block and top.path.count("/") < STEPS
        path = top.path
        if element:
            label = said.label
            if name not in SERIAL:
                top.labels[label] += 1
                if top.labels[label] > 1:
                    label = f"{label}~{top.labels[label]}"
            path = f"{path}/{label}"
        hints = top.hints
        if element and path in template.core:
            inside = top.furniture
        else:
            inside = top.furniture or plain or element and path in template.furniture
            if name == "main":
                mains.update(hints)
            if said.hinted:
                numbers += 1
                hints = (*hints, numbers)
        place = "article" if name == "article" or top.place == "article" else "main" if name == "main" else top.place
        stack.append(_Open(name, path, inside, place, hints, plain or said.hinted, element, not block and (top.quiet or plain or said.hinted), chars, linked, Counter()))
        open_[name] += 1
    show(page[done:])
    flush()
    close(1)
    return _without(blocks, hinted, mains), found


def _without(blocks: list[Block], hinted: list[tuple[int, ...]], mains: set[int]) -> list[Block]:
    """The blocks, those in hinted elements being furniture.

    A hint doesn't count on an element that holds the main element, or the page's only articles and over half of its
    text; no hint does where nothing else is left.
    """
    if not any(hinted):
        return blocks
    void = set(mains)
    if not any(b.place == "article" and not b.furniture and not h for b, h in zip(blocks, hinted)):
        size = Counter[int]()
        for b, h in zip(blocks, hinted):
            size.update(dict.fromkeys(h, len(b.text)))
        held = {k for b, h in zip(blocks, hinted) if b.place == "article" and not b.furniture for k in h}
        void |= {k for k in held if 2 * size[k] > sum(len(b.text) for b in blocks)}
    out = [b._replace(furniture=b.furniture or not void.issuperset(h)) for b, h in zip(blocks, hinted)]
    return blocks if all(b.furniture for b in out) else out


def key_of(block: Block) -> str:
    """The token of a block: its path, and a hash of path and content."""
    import xxhash

    return block.key[: len(block.key) - len(block.text)] + xxhash.xxh64_hexdigest(block.key.encode("utf-8", "surrogatepass"))


def marks(host: str, text: str) -> tuple[int, int]:
    """Hashes, not 0, of a text alone, and of its first three words on its host."""
    import xxhash

    one = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 or 1
    return one(text), one("\n".join([host or "", *text.split(" ", 3)[:3]]))


def extract(page: str, template: Template = Template(), known: dict | None = None) -> str:
    """The main text of a page, given its host's template: all that is neither furniture nor template."""
    blocks = [b for b in parse(page, template, known)[0] if not b.furniture]
    if template.texts:
        own = _flowing(blocks, [key_of(b) not in template.texts for b in blocks], template)
        place = next((p for p in ("article", "main") if any(b.place == p for b in blocks)), None)
        inside = [b.place == place for b in blocks]
        if not any(x and y for x, y in zip(own, inside)):
            left = sum(len(b.text) for b, x in zip(blocks, own) if x)
            if sum(len(b.text) for b, y in zip(blocks, inside) if y) > left:
                own = [x or y for x, y in zip(own, inside)]
        blocks = [b for b, x in zip(blocks, own) if x]
    return "\n".join(b.text for b in blocks)


def _flowing(blocks: list[Block], own: list[bool], template: Template) -> list[bool]:
    """own, with the repeated paragraphs and headings that are part of the core's flow.

    Those stand in the core itself, between blocks of the page's own in it, and either have no class or share it with one of
    these. What a host repeats in an element that holds nothing else, or around the article, is furniture.
    """
    core = max(template.core, key=lambda p: p.count("/"), default=None)
    if core is None or all(own):
        return own
    paths = [b.key[: len(b.key) - len(b.text) - 1] for b in blocks]
    mine = [k for k, (p, o) in enumerate(zip(paths, own)) if o and (p == core or _within(p, core))]
    if not mine:
        return own
    shared = {paths[k] for k in mine}

    def flows(k: int) -> bool:
        around, _, leaf = paths[k].rpartition("/")
        return mine[0] < k < mine[-1] and around == core and leaf.split("~")[0].split(".")[0] in FLOW and ("." not in leaf or paths[k] in shared)

    return [o or flows(k) for k, o in enumerate(own)]


def _within(path: str, around: str) -> bool:
    return path.startswith(around) and path[len(around) : len(around) + 1] in ("/", "#")


def judged(tokens: pd.DataFrame) -> Template:
    """The template of a host from the tokens of its valid classes: (token, pages, n, chars, linked, hinted), sums of pages.

    n: how often; hinted: of these, where names say furniture. Tokens that begin with # are paths, with the characters of
    texts right in them that several pages have.
    """
    repeats = tokens["token"].str.startswith("#")
    again, tokens = tokens[repeats], tokens[~repeats]
    again = list(zip(again["token"].str[1:], again["chars"]))
    is_text = tokens["token"].str.contains("#", regex=False)
    texts = tokens[is_text]
    once = tokens[~is_text & (tokens["n"] == tokens["pages"])].set_index("token")
    own = {}
    for path, e in once.iterrows():
        repeated = sum(c for t, c in zip(texts["token"], texts["chars"]) if _within(t, path))
        own[path] = max(0, e["chars"] - e["linked"] - repeated)
    most = max(own.values(), default=0)
    if not most:
        return Template(frozenset(texts["token"]))
    core = max((p for p in own if own[p] >= CORE * most), key=lambda p: (p.count("/"), own[p], p))
    chain = [p for p in own if p == core or _within(core, p)]
    copied = lambda path: sum(c for p, c in again if p == path or _within(p, path)) / max(1, once.at[path, "chars"])
    usual = copied(core)
    furniture = []
    for path, e in once.iterrows():
        beside = path != core and path not in chain and not any(p not in chain and _within(path, p) for p in own)
        if not beside or not e["chars"]:
            continue
        around, name = path.rpartition("/")[0], path.rpartition("/")[2].split("~")[0].split(".")[0]
        if e["linked"] >= LINKED * e["chars"]:
            furniture.append(path)
        elif name in HEADINGS or _within(path, core):
            continue
        elif 2 * e["hinted"] >= e["n"]:
            furniture.append(path)
        elif around.rpartition("/")[2] in ("", "html", "body") and (e["chars"] < LABEL * e["n"] or 1 - copied(path) < SINGLE * (1 - usual)):
            furniture.append(path)
    return Template(frozenset(texts["token"]), frozenset(furniture), frozenset(chain))


def valid_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, pages, n, chars, linked, hinted) of the tokens of each host's valid classes. pages: (host, id, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            rows = []
            for host, key, body in zip(b["host"], b["id"], b["body"]):
                blocks, elements = parse(body, known=known)
                seen: dict[str, list[int]] = {}
                for e in elements:
                    s = seen.setdefault(e.path, [0, 0, 0, 0])
                    s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + e.chars, s[2] + e.linked, s[3] + e.hinted
                for x in blocks:
                    s = seen.setdefault(key_of(x), [0, 0, 0, 0])
                    s[0], s[1] = s[0] + 1, s[1] + len(x.text)
                bodies = {key_of(x): marks(host, x.text) for x in blocks}
                rows.append((host, "", key, 1, 0, 0, 0, 0, 0))
                rows += [(host, token, key, *s, *bodies.get(token, (0, 0))) for token, s in seen.items()]
            yield pd.DataFrame(rows, columns=["host", "token", "id", "n", "chars", "linked", "hinted", "body", "lead"])

    seen = pages.mapInPandas(run, "host string, token string, id long, n long, chars long, linked long, hinted long, body long, lead long")
    h = F.xxhash64("id", "n")
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "linked", "hinted")] + [F.max(c).alias(c) for c in ("body", "lead")]
    vectors = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), *sums)
    vectors = saved(vectors, "vectors")  # written, as it is used four times
    of_host = vectors.where("token = ''").select(F.col("host").alias("of"), F.col("pages").alias("all"))
    often = vectors.where("token <> ''").join(of_host, F.col("host") == F.col("of")).where((F.col("pages") >= LEAST) & (F.col("pages") >= SHARE * F.col("all")))
    cols = ["token", "n", "chars", "linked", "hinted"]
    classes = often.groupBy("host", "pages", "low", "high").agg(
        F.count("*").alias("size"), F.max(~F.col("token").contains("#")).alias("tagged"), F.collect_list(F.struct(*cols)).alias("tokens")
    )  # no more tokens than SHARE allows a page to have
    valid = classes.where("size >= 2 and tagged").select("host", "pages", F.explode("tokens").alias("t")).select("host", "pages", "t.*")
    return valid.select("host", "token", "pages", "n", "chars", "linked", "hinted").unionByName(_repeats(vectors))


def _repeats(vectors: DataFrame) -> DataFrame:
    """Of each path of a host what stands right in it that isn't a page's own, as tokens that begin with #: texts that several
    pages have, of this host or others, and texts whose first words LEAST pages of the host have. There are as many as paths."""
    texts = vectors.where("body <> 0").select("host", F.concat(F.lit("#"), F.substring_index("token", "#", 1)).alias("token"), "pages", "n", "chars", "linked", "hinted", "low", "body", "lead")
    pages, apart = F.sum("pages"), F.min("low") != F.max("low")  # the same text twice on a page doesn't count
    bodies = texts.groupBy("body").agg((apart | (F.max("pages") > 1)).alias("more")).where("more").select(F.col("body").alias("b"))
    leads = texts.groupBy("lead").agg(((pages >= LEAST) & (apart | (F.max("pages") > 1))).alias("more")).where("more").select(F.col("lead").alias("l"))
    bodies, leads = saved(bodies, "several"), saved(leads, "several")
    found = texts.join(bodies, F.col("body") == F.col("b"), "left").join(leads, F.col("lead") == F.col("l"), "left").where("b IS NOT NULL OR l IS NOT NULL")
    cols = [F.sum(c).alias(c) for c in ("n", "chars", "linked", "hinted")]
    return found.groupBy("host", "token").agg(F.lit(0).cast("long").alias("pages"), *cols).select("host", "token", "pages", "n", "chars", "linked", "hinted")


def templates(pages: DataFrame) -> DataFrame:
    """(host, texts, furniture, core): each host's template. pages: (host, id, body)."""

    def run(tokens: pd.DataFrame) -> pd.DataFrame:
        t = judged(tokens)
        return pd.DataFrame([(tokens["host"].iloc[0], *(sorted(x) for x in t))], columns=["host", "texts", "furniture", "core"])

    return valid_tokens(pages).groupBy("host").applyInPandas(run, "host string, texts array<string>, furniture array<string>, core array<string>")


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row. A null body is empty and gives an empty text; a null URL is a host of its own.

    Pages of hosts with few pages have no template, and are read by their elements alone. Repeated rows are pages like
    others; an empty table gives no rows.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    pages = df.select(whole_id(F.col(id_col)).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    # written: Spark then knows how small it is, and where it isn't can split a large host's pages in the join
    found = saved(templates(pages.select("host", "id", "body")).withColumnRenamed("host", "of"), "templates")
    joined = pages.join(found, F.col("host") == F.col("of"), "left").select("id", "url", "body", "texts", "furniture", "core")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            texts = []
            for body, *template in zip(b["body"], b["texts"], b["furniture"], b["core"]):
                texts.append(extract(body, Template() if template[2] is None else Template(*map(frozenset, template)), known))
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = joined.mapInPandas(run, "id long, url string, text string, n_chars long")
    return out.select(shown_id(F.col("id")).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def query(spark, sf_dir):
    """op5: main text of all pages."""
    from .common import table

    return extract_text(table(spark, sf_dir, "pages"))
