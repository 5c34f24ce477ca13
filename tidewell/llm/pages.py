"""Main text of web pages with wrappers inferred per host.

A wrapper is a union-free regular expression over a page's block elements: elements in order, text that all pages of
the host share, text *slots*, *optional* groups and *repeated* groups. It is inferred by aligning the element streams of
the host's pages, two wrappers at a time. Where both agree the wrapper stays; two different texts become a slot; an
element that comes again right after itself becomes a repeated group; any other mismatch is resolved by looking for the
next place at which the streams agree again and making what was skipped optional.

The wrapper says where a host keeps the text that differs from page to page: the innermost container that holds most of
the slot text is the main region of every page. What a page says itself is a check after that: a region around its
``article`` or ``main`` is narrowed to it, and one that misses most of the marked text gives way to it. Inside a region
only what an element, a role or a whole class name marks as menu, header, footer, side bar, notice, advert, form, script,
style or reader comment is left out; text that pages share stays, headings above all. Where no region is found and the page
stands for it, and in learning, parts of class names count too, and text that the host's pages share goes.

A host's wrapper is learnt from all its pages: each task merges those it reads, and what the tasks made is merged by
salted hosts, then by hosts, one after the other. Wrappers hold hashes of texts, and a level of over ``WIDTH`` items
becomes one item for each signature (rare ones share an item), so they stay small. The order of merging follows the
partitions of the table, which can matter for what becomes optional.

Defined results: null and empty html give empty text; null, odd or unparseable urls share the empty host; broken markup
is read as far as it goes (unclosed elements end with their parent, nesting beyond ``DEPTH`` is flattened, but what is
left out stays so at any depth); repeated
rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_columns, materialize

DEPTH, MAJORITY, WIDTH, SALTS, HOSTS = 80, 0.6, 64, 64, 4096
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names of HTML by role.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg canvas textarea select title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split())
_LEFT_OUT = frozenset("nav footer aside form head dialog menu button label search".split())
_ENDS_ITSELF = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_PART = re.compile(r"(?:^|[-_])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|newsletter|subscribe|popup|modal|sidebar|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|navbar|navigation|menu)(?:$|[-_])", re.I)
_WHOLE = frozenset("header site-header page-header footer site-footer page-footer nav notice banner masthead topbar toolbar widget widgets aside side login signup skip-link".split())
_CONTAINERS = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd dl ul ol pre blockquote address tr td th tbody table figure figcaption".split())
_NUMBER = re.compile(r"\d+")
#: Whole class names and ids that leave a part out anywhere.
_NAMED = _WHOLE | frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr newsletter newsletter-signup subscribe popup modal sidebar comment comments comment-list comments-area commentlist disqus disqus_thread replies respond share sharing share-buttons social social-share social-links related related-posts related-articles recommended breadcrumb breadcrumbs pagination pager navbar navigation menu".split())
_PREFIX = re.compile(r"^(?:has|with|no|without|is)[-_]", re.I)


class Node:
    """An element with its children: nodes and texts in page order.

    ``left_out`` by element, role or whole name; ``doubtful`` by a part of a class name, which counts outside regions only.
    """

    __slots__ = ("children", "doubtful", "left_out", "name", "sig")

    def __init__(self, name: str, sig: str, left_out: bool, doubtful: bool = False):
        self.name, self.sig, self.left_out, self.doubtful, self.children = name, sig, left_out, doubtful, []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _is_left_out(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in _LEFT_OUT or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main", "h1"):
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes:
        return True
    return any(label in _NAMED and not (in_article and "header" in label) for label in _labels(attributes))


def _labels(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()


def _is_doubtful(name: str, attributes: dict[str, str]) -> bool:
    return name not in ("html", "body", "main", "h1") and any(not _PREFIX.match(x) and _PART.search(x) for x in _labels(attributes))


def parse(html: str) -> Node:
    """Block elements and texts; inline elements are transparent unless they are left out."""
    root = Node("", "", False)
    stack, at = [root], 0

    def text(until: int) -> None:
        if until > at:
            stack[-1].children.append(html[at:until])

    pos = 0
    while True:
        m = _TAG.search(html, pos)
        if m is None:
            break
        text(m.start())
        at = pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "br":
            stack[-1].children.append(" ")
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            else:
                if name in _BLOCK:
                    stack[-1].children.append(Node(name, name, False))
            continue
        if name in _RAW:
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
                at = pos = end.end() if end else len(html)
            stack[-1].children.append(" ")
            continue
        attributes = _attributes(m[3] or m[6] or "")
        if name in ("article", "main"):
            while any(n.left_out for n in stack) and not _is_left_out(name, attributes, True):
                stack.pop()  # an unclosed menu doesn't swallow the article
        while len(stack) > 1 and name in _ENDS_ITSELF.get(stack[-1].name, ()):
            stack.pop()
        left_out = _is_left_out(name, attributes, any(n.name == "article" for n in stack))
        doubtful = not left_out and _is_doubtful(name, attributes)
        if name in _VOID or not (left_out or doubtful or name in _BLOCK):
            if name == "hr":
                stack[-1].children.append(Node("hr", "hr", False))
            continue
        label = (attributes.get("id") or attributes.get("class") or "").split()
        node = Node(name, f"{name}.{_NUMBER.sub('0', label[0])}" if label else name, left_out, doubtful)
        stack[-1].children.append(node)
        if len(stack) < DEPTH or left_out:
            stack.append(node)
    text(len(html))
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def blocks(node: Node, sure: bool = True) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without what is left out; unless ``sure``, nor what is doubtful."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if done := _clean(line):
                out.append(done)
            line.clear()

    work: list = [(iter(node.children), True)]
    while work:
        child = next(work[-1][0], None)
        if child is None:
            if work.pop()[1]:
                flush()
        elif isinstance(child, str):
            line.append(child)
        elif child.left_out or (child.doubtful and not sure):
            if child.name in _BLOCK:
                flush()
            else:
                line.append(" ")
        else:
            if child.name in _BLOCK or child.name == "hr":
                flush()
            work.append((iter(child.children), child.name in _BLOCK))
    flush()
    return out


# --- wrappers ---------------------------------------------------------------------------------------------------------


class Item:
    """A wrapper's element (``sig``) or text (sig ''): text is its hash, None for a slot; chars: letters seen in it."""

    __slots__ = ("chars", "items", "optional", "pages", "repeated", "sig", "text")

    def __init__(self, sig: str, text: str | None = None):
        self.sig, self.items, self.optional, self.repeated, self.pages = sig, [], False, False, 1
        self.text = None if text is None else xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
        self.chars = len(text or "")


def to_list(items: list[Item]) -> list:
    return [[i.sig, i.text, i.chars, i.pages, i.optional, i.repeated, to_list(i.items)] for i in items]


def from_list(rows: list) -> list[Item]:
    out = []
    for sig, text, chars, pages, optional, repeated, items in rows:
        item = Item(sig)
        item.text, item.chars, item.pages, item.optional, item.repeated, item.items = text, chars, pages, optional, repeated, from_list(items)
        out.append(item)
    return out


def _one_page(item: Item) -> None:
    item.pages = 1
    for below in item.items:
        _one_page(below)


def generalise(node: Node) -> list[Item]:
    """The page's own wrapper: left-out parts dropped, equal neighbours folded into repeated groups."""
    out: list[Item] = []
    line: list[str] = []

    def flush() -> None:
        if done := _clean(line):
            out.append(Item("", done))
        line.clear()

    for child in node.children:
        if isinstance(child, str):
            line.append(child)
            continue
        if child.left_out or child.doubtful:
            line.append(" ")
            continue
        flush()
        item = Item(child.sig)
        item.items = generalise(child)
        if out and out[-1].sig == item.sig:
            out[-1] = merge(out[-1], item)
            out[-1].repeated = True
            _one_page(out[-1])
        else:
            out.append(item)
    flush()
    return out


def merge(a: Item, b: Item) -> Item:
    out = Item(a.sig)
    out.optional, out.repeated, out.pages = a.optional or b.optional, a.repeated or b.repeated, a.pages + b.pages
    if a.sig == "":
        out.text = a.text if a.text == b.text else None
        out.chars = a.chars + b.chars
    else:
        out.items = align(a.items, b.items)
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """Matches equal items in order; what has to be skipped to match again becomes optional."""
    out: list[Item] = []

    def skip(item: Item) -> None:
        item.optional = True
        out.append(item)

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].sig == b[j].sig:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        ahead_a = next((k for k in range(i + 1, len(a)) if a[k].sig == b[j].sig), None)
        ahead_b = next((k for k in range(j + 1, len(b)) if b[k].sig == a[i].sig), None)
        if ahead_b is not None and (ahead_a is None or ahead_b - j <= ahead_a - i):
            while j < ahead_b:
                skip(b[j])
                j += 1
        elif ahead_a is not None:
            while i < ahead_a:
                skip(a[i])
                i += 1
        else:
            skip(a[i])
            skip(b[j])
            i, j = i + 1, j + 1
    for rest in (*a[i:], *b[j:]):
        skip(rest)
    return out if len(out) <= WIDTH else by_signature(out)


def by_signature(items: list[Item]) -> list[Item]:
    """One item for each signature, repeated if there were several; the rarest share an item that has no signature of
    its own (``*``) if there are too many, so that no text is lost from the sums."""
    out: dict[str, Item] = {}
    for item in items:
        if item.sig in out:
            pages = max(out[item.sig].pages, item.pages)
            out[item.sig] = merge(out[item.sig], item)
            out[item.sig].repeated, out[item.sig].pages = True, pages
        else:
            out[item.sig] = item
    if len(out) <= WIDTH // 2:
        return list(out.values())
    kept = set(sorted((k for k in out if k not in ("", "*")), key=lambda k: (-out[k].pages, -_slot_chars(out[k]), k))[: WIDTH // 2]) | {""}
    rest = Item("*")
    rest.optional = rest.repeated = True
    slot = Item("")
    slot.chars = sum(_slot_chars(i) for k, i in out.items() if k not in kept)
    rest.items = [slot]
    return [i for k, i in out.items() if k in kept] + [rest]


def _slot_chars(item: Item) -> int:
    return item.chars if item.sig == "" and item.text is None else sum(map(_slot_chars, item.items))


def _constants(items: list[Item], least: float) -> list[int]:
    out = []
    for item in items:
        if item.sig == "" and item.text is not None and item.pages >= least:
            out.append(item.text)
        out += _constants(item.items, least)
    return out


def finish(wrapper: list[Item], pages: int) -> dict:
    """{"main": path of element signatures, "shared": hashes of boilerplate texts} of a host of that many pages."""
    total = sum(map(_slot_chars, wrapper))
    path, level = [], wrapper
    while total:
        sums: dict[str, int] = {}
        for item in level:
            if item.sig.partition(".")[0] in _CONTAINERS:
                sums[item.sig] = sums.get(item.sig, 0) + _slot_chars(item)
        best = max(sorted(sums), key=sums.get, default=None)
        if any(_slot_chars(i) for i in level if i.sig.partition(".")[0] in ("h1", "h2")):
            break  # the story's own title stands here
        if best is None or sums[best] < MAJORITY * total or any(i.repeated for i in level if i.sig == best):
            break
        path.append(best)
        if best.partition(".")[0] in ("article", "main"):
            break
        level = [below for i in level if i.sig == best for below in i.items]
    return {"main": path, "shared": _constants(wrapper, max(3, MAJORITY * pages)) if total else []}


def infer(pages: list[str]) -> dict:
    """The finished wrapper of a host with these pages."""
    wrapper: list[Item] = []
    distinct = sorted(set(pages))
    for k, page in enumerate(distinct):
        own = generalise(parse(page))
        wrapper = own if k == 0 else align(wrapper, own)
    return finish(wrapper, len(distinct))


def _outermost(node: Node, name: str) -> list[Node]:
    found, work = [], [node]
    while work:
        n = work.pop()
        for child in reversed([c for c in n.children if isinstance(c, Node)]):
            if not child.left_out:
                work.append(child)
        if n.name == name and not n.left_out:
            found.append(n)
            while work and work[-1] in n.children:
                work.pop()
    return found


def _at(root: Node, path: list[str]) -> list[Node]:
    level = [root]
    for sig in path:
        level = [c for n in level for c in n.children if isinstance(c, Node) and c.sig == sig and not c.left_out]
    return level


def _below(nodes: list[Node]) -> set[int]:
    found, work = set(), list(nodes)
    while work:
        n = work.pop()
        found.add(id(n))
        work += [c for c in n.children if isinstance(c, Node)]
    return found


def locate(root: Node, path: list[str]) -> tuple[list[Node], str]:
    """The main region, and what decided: the ``wrapper``, the page's ``mark`` as the check after it, or neither."""
    region = _at(root, path) if path else []
    if not any(blocks(n) for n in region):
        region = []
    marked = _outermost(root, "article") or _outermost(root, "main")
    size = sum(len(t) for n in marked for t in blocks(n))
    if not size:
        return (region, "wrapper") if region else ([root], "page")
    if {id(n) for n in region} == {id(n) for n in marked}:
        return region, "wrapper"
    inside, allowed = _below(region), _below(marked)
    if all(id(n) in inside for n in marked):
        return marked, "mark"
    if sum(len(t) for n in region if id(n) in allowed for t in blocks(n)) < MAJORITY * size:
        return marked, "mark"
    return region, "wrapper"


def extract(html: str | None, wrapper: dict | None) -> str:
    """Main text of a page: blocks joined by an empty line."""
    if not html:
        return ""
    region, how = locate(parse(html), (wrapper or {}).get("main", []))
    if how != "page":
        return "\n\n".join(t for n in region for t in blocks(n))
    shared = set((wrapper or {}).get("shared", ()))
    texts = [t for n in region for t in blocks(n, sure=False)] or [t for n in region for t in blocks(n)]
    own = [t for t in texts if not shared or xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) not in shared]
    return "\n\n".join(own or texts)  # copies of one page share all their text


def host_of(column: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper json) from all pages of each host."""
    schema = "host string, n long, wrapper string"

    def learn(batches):
        held: dict[str, tuple[int, list[Item]]] = {}
        for b in batches:
            for host, page in zip(b["host"], b["html"]):
                own = generalise(parse(page))
                n, before = held.get(host, (0, None))
                held[host] = n + 1, own if before is None else align(before, own)
            if len(held) > HOSTS:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held):
        return {"host": list(held), "n": [n for n, _ in held.values()], "wrapper": [json.dumps(to_list(w)) for _, w in held.values()]}

    def combine(batches):
        """Merges neighbouring rows of a host."""
        host, n, wrapper = None, 0, None
        for b in batches:
            done: list[tuple] = []
            for h, m, w in zip(b["host"], b["n"], b["wrapper"]):
                if h == host:
                    n, wrapper = n + m, align(wrapper if isinstance(wrapper, list) else from_list(json.loads(wrapper)), from_list(json.loads(w)))
                    continue
                if host is not None:
                    done.append((host, n, wrapper))
                host, n, wrapper = h, m, w
            yield packed(done)
        if host is not None:
            yield packed([(host, n, wrapper)])

    def packed(done):
        return {"host": [h for h, _, _ in done], "n": [n for _, n, _ in done], "wrapper": [json.dumps(to_list(w)) if isinstance(w, list) else w for _, _, w in done]}

    def close(batches):
        for b in batches:
            yield {"host": b["host"], "wrapper": [json.dumps(finish(from_list(json.loads(w)), n)) for n, w in zip(b["n"], b["wrapper"])]}

    parts = map_columns(pages.where("html <> ''").select(host_of().alias("host"), "html"), schema, learn)
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    parts = parts.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper", "n").select("host", "n", "wrapper")
    parts = map_columns(parts, schema, combine).repartition("host").sortWithinPartitions("host", "wrapper", "n")
    return map_columns(map_columns(parts, schema, combine), "host string, wrapper string", close)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    learnt = materialize(wrappers(pages), "wrappers")
    joined = pages.select("page_id", "url", "html", host_of().alias("host")).join(learnt, "host", "left")

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, wrapper in zip(b["html"], b["wrapper"]):
                if wrapper is not None and wrapper not in known:
                    known = {} if len(known) > 256 else known
                    known[wrapper] = json.loads(wrapper)
                texts.append(extract(page, known.get(wrapper)))
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(joined.select("page_id", "url", "html", "wrapper"), "page_id long, url string, text string, n_chars long", run)


def op9_pages(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
