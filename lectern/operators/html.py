"""Cleaning of HTML pages into ordered sections, metadata and images.

Parsing has no built-in expression: pages go through an Arrow batch function
one by one; everything after it is built-in.  Trees are walked with explicit
stacks, so depth is bounded by memory alone, and a page that cannot be read
gives a row with its error instead of ending the job.

The parser follows the standard's rules for implied end tags of paragraphs,
list items, table cells and headings, and opens unclosed formatting elements
again in the next block; it has no foster parenting.

Cases: a null or empty page has one section without content.  Repeated rows
are parsed each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import IMAGE_ID, IMAGE_TAG, MARKER_PATTERN, SPACE, image_marker
from .images import MAX_IMAGES, TYPES, asset, attach_captured, data_image, image_extension, marker_id
from .urls import cut16, href, length16, resolve, safe_url

# Element and attribute lists, limits and patterns.
REMOVED = frozenset("script style noscript template iframe object embed portal input textarea select option button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote caption colgroup dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table tbody td tfoot th thead tr ul".split()
)
KEPT = frozenset(
    "a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i ins kbd li main mark math menu menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover nav none ol p pre q rp rt ruby s samp search section semantics small span strong sub summary sup table tbody td tfoot th thead time tr u ul var wbr".split()
)
VERBATIM = frozenset("pre code textarea samp kbd".split())
GLOBAL = frozenset("aria-label dir id lang role".split())
ATTRIBUTES = {
    "a": frozenset(("href", "title")),
    "blockquote": frozenset(("cite",)),
    "code": frozenset(("class",)),
    "col": frozenset(("span",)),
    "colgroup": frozenset(("span",)),
    "data": frozenset(("value",)),
    "del": frozenset(("cite", "datetime")),
    "details": frozenset(("open",)),
    "ins": frozenset(("cite", "datetime")),
    "li": frozenset(("value",)),
    "ol": frozenset(("reversed", "start", "type")),
    "pre": frozenset(("class",)),
    "q": frozenset(("cite",)),
    "td": frozenset(("colspan", "headers", "rowspan")),
    "th": frozenset(("abbr", "colspan", "headers", "rowspan", "scope")),
    "time": frozenset(("datetime",)),
}
META = re.compile(r"(?i)(?:^|:)(?:title|description|author|byl|date|published(?:_time)?|modified(?:_time)?|section|language|locale|site_name|keywords)\Z")
LANGUAGE_CLASS = re.compile(r"language-[\w+-]+", re.A)
BLANK = re.compile(r"[ \t\r\n\f\v]+")
META_VALUE, META_TOTAL, LABEL, ALT, ATTRIBUTE = 2_000, 20_000, 160, 1_000, 1_000

#: Bytes of input, and pages, whose results are held at once; a larger page is held alone.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 256

# Fixed values of the HTML standard: what closes an open paragraph, what is opened again, what a head may hold.
ENDS_P = BLOCKS - frozenset("caption colgroup dd dt li tbody td tfoot th thead tr".split()) | frozenset(("fieldset", "dialog", "center"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IN_HEAD = frozenset("title meta link base style script noscript template".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag closes these, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ol", "ul", "menu"))),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
}

_SPACES = re.compile(SPACE + "+")
_ENDS = re.compile(f"^{SPACE}+|{SPACE}+$")
_MARKER = re.compile(MARKER_PATTERN)
_ID = re.compile(IMAGE_ID)


def only_references(html: str, names) -> str:
    """``html`` in which no character references but these, closed by a semicolon, are read; the others are text."""
    return re.sub(f"&(?!(?:{'|'.join(map(re.escape, names))});)", "&amp;", html) if "&" in html else html


def trim(s: str) -> str:
    return _ENDS.sub("", s)


def compact(s: str | None) -> str:
    return trim(_SPACES.sub(" ", s or ""))


class Node:
    """An element; children are nodes and text.  own: an image of ours, that is kept as it is."""

    __slots__ = ("tag", "attrs", "kids", "up", "own")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None, own: bool = False):
        self.tag, self.attrs, self.kids, self.up, self.own = tag, attrs, [], up, own

    def walk(self):
        """Descendant elements in document order."""
        left = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while left:
            node = left.pop()
            yield node
            left.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def first(self, tags) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        out, left = [], list(reversed(self.kids))
        while left:
            x = left.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                left.extend(reversed(x.kids))
        return "".join(out)

    def closest(self, tag: str) -> Node | None:
        node = self
        while node is not None and node.tag != tag:
            node = node.up
        return node

    def markup(self) -> str:
        out, left = [], [self]
        while left:
            x = left.pop()
            if isinstance(x, bytes):
                out.append(x.decode())
            elif isinstance(x, str):
                out.append(x.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
            else:
                quoted = ((k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in x.attrs.items())
                out.append(f"<{x.tag}" + "".join(f' {k}="{v}"' for k, v in quoted) + ">")
                if x.tag not in VOID:
                    left.append(f"</{x.tag}>".encode())
                    left.extend(reversed(x.kids))
        return "".join(out)


class Page(HTMLParser):
    """body: the tree; title, language, canonical and meta as they stand in the page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.body = Node("body", {})
        self.open, self.again, self.count = [self.body], [], {}
        self.head, self.heading, self.title, self.inert = True, None, None, 0
        self.language, self.canonical, self.meta = None, None, []
        self.feed(html)
        self.close()

    def shut(self, at: int) -> None:
        """Close the open elements from number ``at`` on; formatting ones are opened again later."""
        for n in self.open[at:]:
            if n.tag in FORMATTING:
                # At most three of a kind are opened again, as the standard has it.
                same = [k for k, x in enumerate(self.again) if x.tag == n.tag and x.attrs == n.attrs]
                if len(same) > 2:
                    del self.again[same[0]]
                self.again.append(n)
        while len(self.open) > at:
            self.pop()

    def pop(self) -> None:
        self.count[self.open.pop().tag] -= 1

    def shut_nearest(self, tags, limit) -> None:
        if not any(self.count.get(t) for t in tags):  # else deep pages would be searched whole at every tag
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                self.shut(at)
                return
            if self.open[at].tag in limit:
                return

    def resume(self) -> None:
        again, self.again = self.again, []
        for n in again:
            self.push(n.tag, dict(n.attrs))

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        if self.head and (self.inert or tag == "template"):
            # What a template before the body holds is none of the page.
            self.inert += tag == "template"
            return
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "meta":
            self.meta.append((a.get("name") or a.get("property") or "", a.get("content", "")))
        elif tag == "link" and "canonical" in a.get("rel", "").split() and self.canonical is None:
            self.canonical = a.get("href", "")
        if tag == "html":
            self.language = a.get("lang") if self.language is None else self.language
        if tag in ("html", "head"):
            return
        if self.head and tag in IN_HEAD:
            if tag not in ("meta", "link", "base"):
                self.heading = Node(tag, a)
            return
        self.head, self.heading = False, None
        if tag == "body":
            return
        if tag in ENDS_P:
            self.shut_nearest(("p",), ("button", "table", "td", "th", "caption", "object", "template"))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.shut(len(self.open) - 1)
        if tag in IMPLIED:
            self.shut_nearest(*IMPLIED[tag])
        if tag not in BLOCKS and tag not in ("meta", "link", "base", "script", "style"):
            self.resume()
        if tag == "a":
            self.shut_nearest(("a",), ("td", "th", "table"))
            self.again = [n for n in self.again if n.tag != "a"]
        self.push(tag, a)

    def handle_startendtag(self, tag, attrs):
        before = self.open[-1]
        self.handle_starttag(tag, attrs)
        last = self.open[-1]
        # Only foreign elements close themselves.
        if last is not before and last.tag == tag and any(self.count.get(t) for t in ("svg", "math")):
            self.pop()

    def handle_endtag(self, tag):
        if self.head and self.inert:
            self.inert -= tag == "template"
            return
        if self.head:
            if self.heading is not None and self.heading.tag == tag:
                self.heading = None
            elif tag == "head":
                self.heading = None
            return
        if tag in FORMATTING:
            at = next((k for k in range(len(self.again) - 1, -1, -1) if self.again[k].tag == tag), None)
            if at is not None and not self.count.get(tag):
                del self.again[at]
                return
        same = HEADINGS if tag in HEADINGS else (tag,)
        if tag != "p" and not any(self.count.get(t) for t in same):
            return
        for at in range(len(self.open) - 1, 0, -1) if any(self.count.get(t) for t in same) else ():
            if self.open[at].tag in same:
                self.shut(at + 1)
                self.pop()
                return
            if tag not in BLOCKS and tag not in FORMATTING and self.open[at].tag in BLOCKS and tag != "body":
                return
            if tag in FORMATTING and self.open[at].tag in ("td", "th", "table", "caption"):
                return
        if tag == "p":
            self.push("p", {})
            self.pop()

    def handle_data(self, data):
        if self.head and self.inert:
            return
        if self.head:
            if self.heading is not None:
                if self.heading.tag == "title" and self.title is None:
                    self.title = data
                return
            if not BLANK.sub("", data):
                return
            self.head = False
            data = data.lstrip(" \t\r\n\f")
        if BLANK.sub("", data) and self.open[-1].tag not in REMOVED:
            self.resume()
        self.open[-1].kids.append(data)


def prune(body: Node) -> None:
    """Remove elements that are no reading matter, and hidden ones, with all they hold."""

    def gone(x) -> bool:
        return isinstance(x, Node) and (x.tag in REMOVED or "hidden" in x.attrs or x.attrs.get("aria-hidden", "").lower() == "true")

    left = [body]
    while left:
        node = left.pop()
        node.kids = [k for k in node.kids if not gone(k)]
        left.extend(k for k in node.kids if isinstance(k, Node))


def is_image(node: Node) -> bool:
    if node.tag == "img":
        return node.closest("picture") is None
    return node.tag in ("picture", "svg", "canvas") or node.tag == "video" and "poster" in node.attrs


def images(body: Node) -> list[Node]:
    return [n for n in body.walk() if is_image(n)]


def suppressed(node: Node | None) -> bool:
    """Hidden itself or in something hidden, by attribute or inline style."""
    while node is not None:
        style = _SPACES.sub("", node.attrs.get("style", "")).lower()
        if "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|;)(?:display:none|visibility:hidden)(?:;|$)", style):
            return True
        node = node.up
    return False


def number(s: str | None) -> float:
    """A declared size; 0 if it is no number."""
    try:
        return float(trim(s or "") or 0)
    except ValueError:
        return 0.0


def meaningful(node: Node) -> bool:
    """Neither hidden, nor of 1 or 2 declared pixels, nor a presentation without a label."""
    a = node.attrs
    if suppressed(node) or any(0 < number(a.get(x)) <= 2 for x in ("width", "height")):
        return False
    return a.get("role", "").lower() != "presentation" or bool(compact(a.get("alt") or a.get("aria-label")))


def image_label(node: Node) -> str:
    """Its own label, that of an image in it, the figure's caption, or the drawing's title."""

    def own(n: Node | None) -> str:
        return compact(n.attrs.get("alt") or n.attrs.get("aria-label") or n.attrs.get("title")) if n is not None else ""

    def inner(n: Node | None, tag: str) -> str:
        found = n.first((tag,)) if n is not None else None
        return compact(found.text()) if found is not None else ""

    return own(node) or own(node.first(("img",))) or inner(node.closest("figure"), "figcaption") or inner(node, "title")


def first_srcset_url(srcset: str | None) -> str | None:
    found = trim((srcset or "").split(",", 1)[0])
    return _SPACES.split(found, maxsplit=1)[0] or None


def image_source(node: Node) -> str | None:
    if node.tag == "picture":
        img = node.first(("img",))
        return (img.attrs.get("src") or first_srcset_url(img.attrs.get("srcset"))) if img is not None else None
    if node.tag == "video":
        return node.attrs.get("poster") or None
    return node.attrs.get("src") or first_srcset_url(node.attrs.get("srcset"))


def mark_images(body: Node, known: dict[int, str], tag: str, marker) -> None:
    """Replace every image by an element of ours: a marker for known ids, else its label."""
    swapped, parents = {}, {}
    for node in images(body):
        label = cut16(image_label(node), ALT)
        own = Node(tag, {}, node.up, own=True)
        image_id = known.get(id(node)) or node.attrs.get("data-image-id")
        if image_id and _ID.fullmatch(image_id):
            own.attrs["id"] = image_id
            own.kids.append(marker(image_id))
        elif label:
            own.kids.append(f"[Image: {label}]")
        if label:
            own.attrs["alt"] = label
        swapped[id(node)], parents[id(node.up)] = own, node.up
    for parent in parents.values():
        parent.kids = [swapped.get(id(x), x) if isinstance(x, Node) else x for x in parent.kids]


def kept_attributes(tag: str, attrs: dict[str, str], base: str) -> dict[str, str]:
    allowed, out = ATTRIBUTES.get(tag, frozenset()), {}
    for name, value in attrs.items():
        if name not in GLOBAL and name not in allowed:
            continue
        if name in ("href", "cite"):
            value = safe_url(value, base)
            if not value:
                continue
        elif name == "class" and not LANGUAGE_CLASS.fullmatch(value):
            continue
        elif name in ("aria-label", "id", "role") and length16(value) > ATTRIBUTE:
            continue
        out[name] = value
    return out


def unwrap(body: Node, base: str) -> Node:
    """The tree of allowed elements and attributes; other elements leave their children."""
    out = Node("body", {})
    left = [(iter(body.kids), out)]
    while left:
        kids, to = left[-1]
        x = next(kids, None)
        if x is None:
            left.pop()
        elif isinstance(x, str):
            to.kids.append(x)
        elif x.own:
            x.up = to
            to.kids.append(x)
        elif x.tag in KEPT:
            node = Node(x.tag, kept_attributes(x.tag, x.attrs, base), to)
            to.kids.append(node)
            left.append((iter(x.kids), node))
        else:
            left.append((iter(x.kids), to))
    return out


def collapse(body: Node) -> None:
    """Runs of white space become one space; blank text between blocks goes.  Not in preformatted elements."""

    def block(x) -> bool:
        return x is None or isinstance(x, Node) and x.tag in BLOCKS

    left = [body]
    while left:
        node = left.pop()
        if node.tag in VERBATIM:
            continue
        done = []
        for k, x in enumerate(node.kids):
            if isinstance(x, str):
                x = BLANK.sub(" ", x)
                if not trim(x) and block(done[-1] if done else None) and block(node.kids[k + 1] if k + 1 < len(node.kids) else None):
                    continue
            else:
                left.append(x)
            done.append(x)
        node.kids = done


def sanitise(page: Page, base: str, known: dict[int, str] | None = None, tag: str = "", marker=None) -> Node:
    prune(page.body)
    mark_images(page.body, known or {}, tag or IMAGE_TAG, marker or image_marker)
    body = unwrap(page.body, base)
    collapse(body)
    return body


def metadata(page: Page, base: str) -> dict[str, str]:
    """title, language, canonicalUrl, then the relevant meta elements; the first of a key wins, and over the page's own."""
    found, used = {}, 0
    for key, value in page.meta:
        key, value = compact(key), compact(value)
        if not key or not value or not META.search(key) or found.get(key) or used + length16(key) + length16(value) > META_TOTAL:
            continue
        found[key] = cut16(value, META_VALUE)
        used += length16(key) + length16(value)
    canonical = safe_url(page.canonical, base) if page.canonical else None
    own = {"title": compact(page.title), "language": compact(page.language), "canonicalUrl": canonical}
    return {k: v for k, v in own.items() if v} | found


def sections(body: Node, prefix: str) -> list[dict]:
    """id, label, content and asset_ids of the body's children that hold text or a rule."""
    out = []
    for x in body.kids:
        text = compact(x if isinstance(x, str) else x.text())
        content = text if isinstance(x, str) else trim(x.markup())
        if not content or not (text or isinstance(x, Node) and (x.tag == "hr" or x.first(("hr",)) is not None)):
            continue
        at = len(out) + 1
        if isinstance(x, str):
            label = f"Page text {at}"
        else:
            heading = x if x.tag in HEADINGS else x.first(HEADINGS)
            label = cut16(compact(heading.text()), LABEL) if heading is not None else ""
            label = label or f"{'Page section' if x.tag == 'div' else x.tag} {at}"
        out.append({"id": f"{prefix}-{at:03d}", "label": label, "content": content, "asset_ids": list(dict.fromkeys(_MARKER.findall(content)))})
    return out or [{"id": f"{prefix}-001", "label": "Page content", "content": compact(body.text()), "asset_ids": []}]


def capture_local(body: Node, base: str) -> tuple[list[dict], dict[int, str]]:
    """Assets of a local page's first 20 meaningful images: drawings, data urls, and ``file:`` paths (content to be joined)."""
    assets, known = [], {}
    for node in images(body):
        if len(assets) >= MAX_IMAGES or not meaningful(node):
            continue
        source, path, content = image_source(node), None, None
        if node.tag == "svg":
            content, mime, extension = node.markup().encode(), "image/svg+xml", ".svg"
        elif source and source.startswith("data:"):
            found = data_image(source)
            if not found:
                continue
            content, mime, extension = found
        elif source:
            x = resolve(source, base)
            if not x or x[0] != "file":
                continue
            path = href((*x[:3], "", ""))
            mime = TYPES.get(image_extension(x[2], ""), "application/octet-stream")
            if not mime.startswith("image/"):
                continue
            extension = image_extension(x[2], mime)
        else:
            continue
        image_id = marker_id(None, len(assets) + 1)
        known[id(node)] = image_id
        assets.append(asset(image_id, mime, extension, image_label(node), safe_url(source, base) if source else None, path, content))
    return assets, known


def parse(html: str, url: str | None = None, captured: list[dict] | None = None, local_images: bool = False) -> dict:
    """kind, title, metadata, sections and assets of a page, or of an HTML text without url."""
    base = url or "https://captured.invalid/"
    page = Page(html)
    meta = metadata(page, base)
    assets, known = [], {}
    if captured:
        assets, known = attach_captured(images(page.body), captured, base)
    elif local_images:
        assets, known = capture_local(page.body, base)
    body = sanitise(page, base, known)
    found = sections(body, "page-section" if url else "html-section")
    names = {a["id"]: a["filename"] for a in assets}
    for s in found:
        s["attachments"] = [names[i] for i in s["asset_ids"] if i in names]
    return {"kind": "webpage" if url else "html", "title": meta.get("title"), "metadata": list(meta.items()), "sections": found, "assets": assets}


BUNDLE = """kind string, title string, metadata map<string,string>,
 sections array<struct<id: string, label: string, content: string, asset_ids: array<string>, attachments: array<string>>>,
 assets array<struct<id: string, mime: string, filename: string, alt: string, source_url: string, path: string, content: binary>>, error string"""


def bundle_batches(batches, schema, local_images: bool = False, references: tuple[str, ...] | None = None):
    """Record batches of pages to those of their bundles.

    A batch holds up to 10,000 pages: they are read one by one, and results go
    out every BATCH_BYTES of input.
    """
    import pyarrow as pa

    def made(row: dict) -> dict:
        try:
            text = row["html"] or ""
            return parse(only_references(text, references) if references is not None else text, row["url"] or None, row.get("images"), local_images) | {"error": None}
        except Exception as e:  # one page's fault is that page's row
            return {"kind": None, "title": None, "metadata": None, "sections": None, "assets": None, "error": f"{type(e).__name__}: {e}"[:2000]}

    for batch in batches:
        rows, held = [], 0
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            row = one.to_pylist()[0]
            rows.append({"page_id": row["page_id"]} | made(row))
            held += one.nbytes
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS or at == batch.num_rows - 1:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0


def pages_to_bundles(pages: DataFrame, local_images: bool = False, images_column: str | None = None, references: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, kind, title, metadata, sections, assets and error of (page_id, url, html).

    images_column: an array of captured images (id, data_url, label, alt,
    source_url).  local_images: take drawings, data urls and ``file:`` images;
    the last have a path and no content, see ``images.with_files``.
    references: names of the character references that are read, if closed; by
    default all are, as the HTML standard has it, unclosed old ones (``&amp``) too.
    """

    def run(batches):
        yield from bundle_batches(batches, schema, local_images, references)

    columns = [F.col("page_id").cast("long"), (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"), F.col("html").cast("string")]
    if images_column:
        columns.append(F.transform(images_column, lambda x: F.struct(*[x[n].cast("string").alias(n) for n in ("id", "data_url", "label", "alt", "source_url")])).alias("images"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = f"page_id long, {BUNDLE}"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    return pages.select(*columns).mapInArrow(run, kind)


def section_rows(bundles: DataFrame) -> DataFrame:
    """page_id, ordinal (from 0), id, label, content, asset_ids, attachments."""
    return bundles.select("page_id", F.posexplode("sections").alias("ordinal", "s")).select("page_id", "ordinal", "s.*")


def markers(content: Column) -> Column:
    """Distinct image ids of the markers in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(MARKER_PATTERN), 1))
