"""Scalar expressions on text, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it (fixed value).
_SPACES = "\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SPACE = f"[{_SPACES}]"
_SPACES_BUT_ONE = _SPACES.replace(" ", "")
MARKUP_LIMIT, VISIBLE_LIMIT, ATTACHMENT_LIMIT = 120_000, 30_000, 20
#: The smallest budget of a section's part.
LEAST_BUDGET = 4000
#: Query parameters that safe urls lose (fixed value).
TRACKING = "(?i)^(utm_.+|fbclid|gclid|dclid|mc_cid|mc_eid)$"
#: The element and the marker that stand for an image in a section's markup, and the ids they hold.
IMAGE_TAG, IMAGE_ID = "lectern-image", r"image-\d{3,}"
MARKER_PATTERN = rf"\[\[LECTERN_IMAGE:({IMAGE_ID})\]\]"
MAX_IMAGE_BYTES, MAX_PDF_BYTES = 25 * 1024 * 1024, 192 * 1024 * 1024
# Image types by extension and of print.
IMAGE_EXTENSIONS = {".gif": "image/gif", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".png": "image/png", ".webp": "image/webp"}
PRINTABLE = ("image/png", "image/jpeg", "image/webp", "image/gif", "image/svg+xml")
FORMATS, DEFAULT_FORMAT, DEFAULT_MODEL = ("txt", "md", "pdf"), "md", "default"


def image_marker(image_id: str) -> str:
    return f"[[LECTERN_IMAGE:{image_id}]]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def let(value: Column, use) -> Column:
    """use(value), with ``value`` computed once: as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _compacted(c: Column) -> Column:
    # A lone space is left as it is; once all runs are one space, plain trimming is enough.
    ascii_only = F.regexp_replace(c, "[\\t-\\r][\\t-\\r ]*| [\\t-\\r ]+", " ")
    return F.trim(F.when(F.octet_length(c) == F.char_length(c), ascii_only).otherwise(F.regexp_replace(c, f"[{_SPACES_BUT_ONE}]{SPACE}*| {SPACE}+", " ")))


def compact(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, null is empty."""
    return let(F.coalesce(c, F.lit("")), _compacted)


def _units(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.char_length(c), F.char_length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def utf16_length(c: Column) -> Column:
    """Characters, and one more for each beyond the basic plane, which only texts with other than ASCII can hold."""
    return let(c, _units)


def visible_length(markup: Column) -> Column:
    """UTF-16 units left when tags become spaces and white space is compacted."""
    return utf16_length(compact(F.regexp_replace(markup, "<[^>]*>", " ")))


def raw_budget(markup: Column) -> Column:
    """Markup characters that should hold VISIBLE_LIMIT visible ones at this section's density."""
    density = visible_length(markup) / F.greatest(F.lit(1), utf16_length(markup))
    return F.least(F.lit(MARKUP_LIMIT), F.greatest(F.lit(LEAST_BUDGET), F.floor(VISIBLE_LIMIT / F.greatest(density, F.lit(0.01))))).cast("int")


def excess_budget(markup: Column) -> Column:
    """The budget of a section that needs a cut; null for others."""
    over = lambda n: F.when(n > LEAST_BUDGET, let(raw_budget(markup), lambda b: F.when(b < n, b)))
    return let(utf16_length(markup), over)


def renderable(markup: Column) -> Column:
    return F.coalesce(F.regexp_replace(markup, "<[^>]*>", "").rlike(f"[^{_SPACES}]") | markup.rlike(f"(?i)<(hr|img|{IMAGE_TAG})\\b"), F.lit(False))


def normalised_output(raw: Column) -> Column:
    return F.concat(trimmed(F.regexp_replace(raw, "\r\n?", "\n")), F.lit("\n"))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table_cell(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")).otherwise(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def public_url(url: Column) -> Column:
    return F.coalesce(F.lower(trimmed(url)).rlike("^https?://[^/?#]+"), F.lit(False))


def asset_url(url: Column) -> Column:
    """http(s) only, without credentials, query and fragment."""
    return F.when(public_url(url), F.regexp_replace(F.regexp_replace(trimmed(url), "[?#].*$", ""), "^([A-Za-z]+://)[^/]*@", "$1"))


def safe_url(url: Column) -> Column:
    """Absolute urls: no credentials, no tracking parameters, fragment kept, at most 4,096 characters; else null."""
    # Up to the last @ of the host's part: a password may hold others.
    bare = F.regexp_replace(trimmed(url), "^([A-Za-z]+://)[^/?#]*@", "$1")
    head = F.regexp_extract(bare, "^([^?#]*)", 1)
    query = F.regexp_extract(bare, "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING)), "&")
    fragment = F.regexp_extract(bare, "(#.*)$", 1)
    whole = F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), fragment)
    return F.when(F.lower(bare).rlike("^https?://|^(file|mailto):"), F.substring(whole, 1, 4096))


# Letters with marks and their plain forms, for sorting: upper and lower case are folded before (fixed values: Latin-1 and Latin Extended-A).
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def folded(c: Column) -> Column:
    """Without case and accents."""
    return F.translate(F.lower(c), _MARKED, _PLAIN)


def natural_key(name: Column) -> Column:
    """Sorts digits by value and the rest without case and accents: a digit run is preceded by its length."""
    parts = F.regexp_extract_all(folded(name), F.lit("(\\d+|\\D+)"), 1)
    bare = lambda p: F.regexp_replace(p, "^0+(?=\\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 9, "0"), bare(p))).otherwise(p)), "")


def data_url(c: Column) -> Column:
    """struct(mime, content) of a base64 image data url of 1 byte to 25 MiB, or null."""
    mime = F.regexp_extract(c, "^data:(image/(?:png|jpeg|gif|webp|svg\\+xml));base64,", 1)
    body = F.try_to_binary(F.regexp_extract(c, "^data:[^,]*,(.*)$", 1), F.lit("base64"))
    return F.when((mime != "") & F.length(body).between(1, 25 * 1024 * 1024), F.struct(mime.alias("mime"), body.alias("content")))


def image_type(content: Column) -> Column:
    """Mime type by leading bytes, or null."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & F.substring(h, 17, 8).eqNullSafe("57454250"), "image/webp")
    )


def source_kind(content: Column, extension: Column) -> Column:
    """pdf, html, image or null, by the first 512 bytes and the extension; an HTML extension comes before an image's bytes."""
    head = F.substring(content, 1, 512)
    text = F.lower(F.regexp_replace(F.decode(head, "ISO-8859-1"), "^(?:\\s|\\xEF\\xBB\\xBF|\\xA0)+", ""))
    html = F.lower(F.ltrim(extension, F.lit("."))).isin("html", "htm", "xhtml") | text.rlike("^(?:<!doctype\\s+html|<html\\b|<head\\b|<body\\b)")
    return F.when(F.hex(head).startswith("255044462D"), "pdf").when(html, "html").when(image_type(head).isNotNull(), "image")


def kind_error(content: Column, extension: Column) -> Column:
    """Why a file has no kind, or null."""
    shown = F.when(F.coalesce(extension, F.lit("")) == "", "unknown file type").otherwise(F.lower(extension))
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "input file is empty").when(source_kind(content, extension).isNull(), F.concat(F.lit("unsupported input format: "), shown))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def file_extension(path: Column) -> Column:
    """With its dot, in lower case; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(file_name(path), "[^.].*?(\\.[^.]*)$", 1))


def pdf_error(content: Column) -> Column:
    """Why bytes are no readable PDF, or null."""
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "the PDF is empty")
        .when(F.length(content) > MAX_PDF_BYTES, "the PDF exceeds 192 MB")
        .when(F.hex(F.substring(content, 1, 5)) != "255044462D", "the source is not a PDF file")
    )


def pdf_title(embedded: Column, given: Column) -> Column:
    """The document's own title unless it says nothing, else the one given."""
    own = trimmed(embedded)
    return F.when((own != "") & ~F.lower(own).isin("about:blank", "untitled"), own).otherwise(given)


def extension_of(mime: Column) -> Column:
    """The extension images of this type are stored under."""
    m = F.lower(mime)
    return F.when(m == "image/jpeg", ".jpg").when(m == "image/svg+xml", ".svg").when(m.startswith("image/"), F.concat(F.lit("."), F.substring(m, 7, 100))).otherwise(".img")


def ordinal_id(prefix: str, n: Column, digits: int = 3) -> Column:
    return F.format_string(f"{prefix}-%0{digits}d", n)


def valid_marker_id(c: Column) -> Column:
    """Ids that a renderer accepts."""
    return F.coalesce(c.rlike("^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}\\z"), F.lit(False))


def printable(image_id: Column, mime: Column) -> Column:
    return valid_marker_id(image_id) & F.coalesce(F.lower(mime).isin(*PRINTABLE), F.lit(False))


def first_srcset_url(c: Column) -> Column:
    """The url before the first comma and white space; null if there is none."""
    return F.nullif(F.regexp_extract(F.substring_index(c, ",", 1), f"^{SPACE}*(.*?)(?:{SPACE}.*)?$", 1), F.lit(""))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x1F\\x7F]", " ")


def file_slug(c: Column) -> Column:
    """Letters and digits, anything else a hyphen, at most 80 characters; ``extraction`` where nothing is left."""
    # A decomposed letter is itself and a mark, which becomes a hyphen.
    both = _MARKED + _MARKED.upper()
    made = F.translate(F.regexp_replace(c, f"([{both}])", "$1-"), both, _PLAIN + _PLAIN.upper())
    made = F.regexp_replace(F.regexp_replace(made, "[^a-zA-Z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(made, 1, 80), F.lit("")), F.lit("extraction"))


def model_slug(c: Column) -> Column:
    """The trimmed name, the default for null, or null where it is not valid."""
    name = trimmed(F.coalesce(c, F.lit(DEFAULT_MODEL)))
    return F.when((name != "") & (utf16_length(name) <= 200) & ~name.startswith("-") & ~name.rlike(f"{SPACE}|[\\x00-\\x1F\\x7F]"), name)


def output_format(c: Column) -> Column:
    """txt, md or pdf; md for null and empty; null for others."""
    name = F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULT_FORMAT)))
    return F.when(name.isin(*FORMATS), name)


def instructions(c: Column) -> Column:
    """Trimmed; null where longer than 4,000 UTF-16 units."""
    text = trimmed(F.coalesce(c, F.lit("")))
    return F.when(utf16_length(text) <= 4000, text)


def images_on(fmt: Column, wanted: Column) -> Column:
    return (fmt == "pdf") & F.coalesce(wanted, F.lit(True))


def default_pdf_name(sources: Column) -> Column:
    """Where a PDF goes by default, by an array of sources."""
    one = F.get(sources, F.lit(0))
    host = F.regexp_replace(F.lower(F.regexp_extract(one, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), "^www\\.", "")
    folder, name = F.regexp_extract(one, "^(.*?)/*[^/]*/*$", 1), file_name(one)
    stem = F.regexp_replace(name, "^([^.].*?|\\.[^.].*?)\\.[^.]*$", "$1")
    path = F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).when(one.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit("-edition.pdf"))
    return F.when(F.size(sources) > 1, "gallery-edition.pdf").when(one == "-", "stdin-edition.pdf").when(one.rlike("(?i)^https?://"), F.concat(host, F.lit("-edition.pdf"))).otherwise(path)


def clean_number(c: Column) -> Column:
    """Non-negative finite numbers; else null."""
    return F.when(~F.isnan(c) & (c >= 0) & (c < float("inf")), c)


def elapsed(seconds: Column) -> Column:
    """m:ss of whole seconds, from 0."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0))))
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def date_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def clamped(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def progress(stage: Column, current: Column, total: Column) -> Column:
    """Per cent of a job by its stage and the parts done."""
    some = F.coalesce(total, F.lit(0)) != 0
    ratio = F.when(some, clamped(F.coalesce(current, F.lit(0)) / total, 0.0, 1.0)).otherwise(0.0)
    return F.when(stage == "extracting", F.when(some, 24 + ratio * 66).otherwise(28.0)).when(stage == "rendering", 94.0).otherwise(24.0)


def plain_base64(content: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def canonical_base64(c: Column) -> Column:
    """Whether a text is base64 that its own bytes are written as."""
    shape = (F.length(c) % 4 == 0) & c.rlike("^[A-Za-z0-9+/]*={0,2}\\z")
    return F.coalesce(shape & (plain_base64(F.try_to_binary(c, F.lit("base64"))) == c), F.lit(False))


def viewer_source(url: Column) -> Column:
    """The document that a browser's viewer page shows; other urls as they are."""
    inner = F.coalesce(*[F.nullif(F.url_decode(F.regexp_extract(url, f"[?&]{k}=([^&#]*)", 1)), F.lit("")) for k in ("file", "url", "src")], F.lit(""))
    return F.when(F.lower(url).rlike("^(chrome-extension|edge-extension|chrome-untrusted):"), inner).otherwise(url)


def pdf_tab(url: Column, title: Column) -> Column:
    """struct(url, title) of a tab that shows a PDF by its path or title, or null."""
    source, shown = viewer_source(url), trimmed(F.coalesce(title, F.lit("")))
    path = F.url_decode(F.regexp_extract(source, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    hint = path.rlike("(?i)\\.pdf\\z") | shown.rlike(f"(?i)\\.pdf({SPACE}|\\z)")
    name = F.coalesce(F.nullif(trimmed(F.regexp_replace(shown, f"(?i){SPACE}+-{SPACE}+.*PDF Viewer.*$", "")), F.lit("")), F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("PDF document"))
    return F.when(F.lower(source).rlike("^(https?|file)://") & hint, F.struct(F.regexp_replace(source, "#.*$", "").alias("url"), name.alias("title")))
