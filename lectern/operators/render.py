"""Markdown editions as HTML for print.

A subset of Markdown with tables and footnotes: headings, rules, lists, block
quotes, fenced and indented code, tables, paragraphs; code spans, emphasis,
strike-through, links, hard breaks, escapes.  Raw HTML is text, bare urls are
not linked, images are their alternative text, and image markers become the
edition's own images or nothing.  Nothing of it can fetch anything.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_IMAGE_BYTES, html_escaped, image_marker, plain_base64, printable

STYLE = """
:root { color-scheme: light; font-family: Georgia, "Times New Roman", serif; font-size: 11pt; line-height: 1.5; }
body { margin: 0; color: #111; }
main { max-width: 42rem; margin: 0 auto; }
h1, h2, h3, h4, h5, h6 { line-height: 1.2; margin: 1.4em 0 0.5em; }
pre, code { font-family: Menlo, Consolas, monospace; font-size: 0.9em; }
pre { white-space: pre-wrap; border: 1px solid #ccc; padding: 0.6em; }
blockquote { margin: 1em 0; padding-left: 1em; border-left: 3px solid #bbb; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 1px solid #bbb; padding: 0.25em 0.5em; text-align: left; }
img { max-width: 100%; }
.figure { display: block; margin: 1em 0; text-align: center; }
@media print { h1, h2, h3 { break-after: avoid-page; } pre, blockquote, table, .figure { break-inside: avoid-page; } }
"""

_FRONT, _BACK = (re.escape(x) for x in image_marker("|").split("|"))
#: A marker's id may be any that a renderer accepts.
MARKER = re.compile(rf"{_FRONT}([a-zA-Z0-9][a-zA-Z0-9._-]{{0,127}}){_BACK}")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4})(?! )|( +)|$)(.*)$")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
LINK = re.compile(r"""\(\s*(?:<([^<>\n]*)>|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'))?\s*\)""")
UNSAFE = re.compile(r"(?i)\s*(?:javascript|vbscript|file|data):")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Block quotes and lists in one another; deeper ones are text.
DEPTH = 40


def escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


class Renderer:
    """figures: ids to (data url, alternative text)."""

    def __init__(self, figures: dict[str, tuple[str, str]] | None = None):
        self.figures, self.notes, self.used = figures or {}, {}, []

    def render(self, text: str) -> str:
        lines, rest = text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"), []
        k = 0
        fence = None
        while k < len(lines):
            m = FENCE.match(lines[k])
            if m and (fence is None or m[1].startswith(fence)):
                fence = m[1] if fence is None else None
            note = NOTE.match(lines[k]) if fence is None else None
            if note:
                body = [note[2]]
                while k + 1 < len(lines) and (lines[k + 1].startswith("    ") or not lines[k + 1].strip() and k + 2 < len(lines) and lines[k + 2].startswith("    ")):
                    k += 1
                    body.append(lines[k][4:])
                self.notes.setdefault(note[1], body)
            else:
                rest.append(lines[k])
            k += 1
        out = self.blocks(rest, 0)
        if self.used:
            items, at = [], 0
            while at < len(self.used):  # a note may name others
                name = self.used[at]
                at += 1
                body = self.blocks(self.notes[name], 1)
                back = f' <a href="#fnref{at}" class="footnote-backref">↩︎</a>'
                body = f"{body[:-5]}{back}</p>\n" if body.endswith("</p>\n") else f"{body}<p>{back.strip()}</p>\n"
                items.append(f'<li id="fn{at}" class="footnote-item">{body}</li>\n')
            out += f'<hr class="footnotes-sep">\n<section class="footnotes">\n<ol class="footnotes-list">\n{"".join(items)}</ol>\n</section>\n'
        return out

    def blocks(self, lines: list[str], depth: int, tight: bool = False) -> str:
        out, k, n = [], 0, len(lines)
        while k < n:
            line = lines[k]
            if not line.strip():
                k += 1
                continue
            if line.startswith("    "):
                code = []
                while k < n and (lines[k].startswith("    ") or not lines[k].strip()):
                    code.append(lines[k][4:])
                    k += 1
                out.append(f"<pre><code>{escaped(chr(10).join(code).rstrip())}\n</code></pre>\n")
                continue
            if m := FENCE.match(line):
                code, k, indent = [], k + 1, len(line) - len(line.lstrip())
                while k < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[k]):
                    code.append(lines[k][min(indent, len(lines[k]) - len(lines[k].lstrip())) :])
                    k += 1
                k += 1
                kind = f' class="language-{escaped(m[2])}"' if m[2] else ""
                out.append(f"<pre><code{kind}>{escaped(''.join(c + chr(10) for c in code))}</code></pre>\n")
                continue
            if m := HEADING.match(line):
                level = len(m[1])
                out.append(f"<h{level}>{self.inline(m[2] or '')}</h{level}>\n")
                k += 1
                continue
            if RULE.match(line):
                out.append("<hr>\n")
                k += 1
                continue
            if re.match(r" {0,3}>", line) and depth < DEPTH:
                inner = []
                while k < n and lines[k].strip() and (re.match(r" {0,3}>", lines[k]) or inner and not self.begins(lines[k])):
                    inner.append(re.sub(r"^ {0,3}> ?", "", lines[k]))
                    k += 1
                out.append(f"<blockquote>\n{self.blocks(inner, depth + 1)}</blockquote>\n")
                continue
            if ITEM.match(line) and depth < DEPTH:
                made, k = self.list(lines, k, depth)
                out.append(made)
                continue
            if "|" in line and k + 1 < n and TABLE_RULE.match(lines[k + 1]) and len(self.cells(line)) == len(self.cells(lines[k + 1])):
                made, k = self.table(lines, k)
                out.append(made)
                continue
            held = [line.lstrip()]
            k += 1
            level = 0
            while k < n and lines[k].strip():
                if m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[k]):
                    level = 1 if m[1][0] == "=" else 2
                    k += 1
                    break
                if self.begins(lines[k]):
                    break
                held.append(lines[k].lstrip())
                k += 1
            text = self.inline("\n".join(held).rstrip())
            out.append(f"<h{level}>{text}</h{level}>\n" if level else f"{text}\n" if tight else f"<p>{text}</p>\n")
        return "".join(out)

    @staticmethod
    def begins(line: str) -> bool:
        """Whether a line ends the paragraph before it."""
        m = ITEM.match(line)
        return bool(FENCE.match(line) or HEADING.match(line) or RULE.match(line) or re.match(r" {0,3}>", line) or m and m[5].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1"))

    def list(self, lines: list[str], k: int, depth: int) -> tuple[str, int]:
        first = ITEM.match(lines[k])
        mark, items, loose = first[2][-1], [], False
        n = len(lines)
        while k < n and (m := ITEM.match(lines[k])) and m[2][-1] == mark and not RULE.match(lines[k]):
            width = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] else 1)
            body, k = [(" " * (len(m[4]) - 1) if m[4] else "") + m[5]], k + 1
            while k < n:
                line = lines[k]
                if not line.strip():
                    after = next((x for x in lines[k:] if x.strip()), None)
                    if after is None or len(after) - len(after.lstrip()) < width:
                        break
                    body.append("")
                elif len(line) - len(line.lstrip()) >= width:
                    body.append(line[width:])
                elif lines[k - 1].strip() and not self.begins(line) and not ITEM.match(line):
                    body.append(line.lstrip())
                else:
                    break
                k += 1
            blank = k < n and not lines[k].strip()
            while k < n and not lines[k].strip():
                k += 1
            again = k < n and ITEM.match(lines[k]) and ITEM.match(lines[k])[2][-1] == mark
            loose = loose or blank and bool(again) or any(not x.strip() for x in body[:-1])
            items.append(body)
        made = "".join(f"<li>{self.blocks(b, depth + 1, tight=not loose).strip() if not loose else chr(10) + self.blocks(b, depth + 1)}</li>\n" for b in items)
        if first[2][0].isdigit():
            start = int(first[2][:-1])
            return f"<ol{f' start={chr(34)}{start}{chr(34)}' if start != 1 else ''}>\n{made}</ol>\n", k
        return f"<ul>\n{made}</ul>\n", k

    @staticmethod
    def cells(line: str) -> list[str]:
        inner = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
        return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]

    def table(self, lines: list[str], k: int) -> tuple[str, int]:
        head, rules = self.cells(lines[k]), self.cells(lines[k + 1])
        align = [' style="text-align:center"' if r.startswith(":") and r.endswith(":") else ' style="text-align:right"' if r.endswith(":") else ' style="text-align:left"' if r.startswith(":") else "" for r in rules]
        row = lambda cells, tag: "<tr>\n" + "".join(f"<{tag}{a}>{self.inline(c)}</{tag}>\n" for c, a in zip(cells, align)) + "</tr>\n"
        k, body = k + 2, []
        while k < len(lines) and lines[k].strip() and not self.begins(lines[k]):
            body.append(row((self.cells(lines[k]) + [""] * len(head))[: len(head)], "td"))
            k += 1
        made = f"<table>\n<thead>\n{row(head, 'th')}</thead>\n" + (f"<tbody>\n{''.join(body)}</tbody>\n" if body else "") + "</table>\n"
        return made, k

    def inline(self, s: str, depth: int = 0) -> str:
        """Tokens first, then emphasis among them."""
        out, k, n = [], 0, len(s)  # str: done; list: [char, count, may open, may close]
        text = []

        def flush():
            if text:
                out.append(escaped("".join(text)))
                text.clear()

        while k < n:
            c = s[k]
            if c == "\\" and k + 1 < n and s[k + 1] in PUNCTUATION:
                text.append(s[k + 1])
                k += 2
            elif c == "\\" and s[k + 1 : k + 2] == "\n":
                flush()
                out.append("<br>\n")
                k += 2
            elif c == "\n":
                held = "".join(text)
                text[:] = [held.rstrip(" ")]
                flush()
                out.append("<br>\n" if held.endswith("  ") else "\n")
                k += 1
            elif c == "`":
                run = re.match(r"`+", s[k:])[0]
                m = re.search(rf"(?<!`){run}(?!`)", s[k + len(run) :])
                if m:
                    code = s[k + len(run) : k + len(run) + m.start()].replace("\n", " ")
                    if code.startswith(" ") and code.endswith(" ") and code.strip():
                        code = code[1:-1]
                    flush()
                    out.append(f"<code>{escaped(code)}</code>")
                    k += len(run) * 2 + m.start()
                else:
                    text.append(run)
                    k += len(run)
            elif c == "&" and (m := re.match(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", s[k:])):
                text.append(html.unescape(m[0]))
                k += len(m[0])
            elif m := MARKER.match(s, k):
                flush()
                if m[1] in self.figures:
                    url, alt = self.figures[m[1]]
                    out.append(f'<span class="figure"><img src="{url}" alt="{escaped(alt)}"></span>')
                k = m.end()
            elif c == "[" and (m := re.match(r"\[\^([^\]\s]+)\]", s[k:])) and m[1] in self.notes:
                flush()
                if m[1] not in self.used:
                    self.used.append(m[1])
                at = self.used.index(m[1]) + 1
                out.append(f'<sup class="footnote-ref"><a href="#fn{at}" id="fnref{at}">[{at}]</a></sup>')
                k += len(m[0])
            elif (c == "[" or s.startswith("![", k)) and depth < DEPTH and (found := self.link(s, k + (c == "!"))):
                label, url, title, end = found
                flush()
                if c == "!":
                    out.append(escaped(re.sub(r"<[^>]*>", "", html.unescape(self.inline(label, depth + 1)))))
                elif UNSAFE.match(html.unescape(url)) and not re.match(r"(?i)data:image/(?:gif|png|jpeg|webp);", url):
                    out.append(self.inline(s[k:end].replace("[", "\\[").replace("]", "\\]"), depth + 1))
                else:
                    named = f' title="{escaped(title)}"' if title else ""
                    out.append(f'<a href="{escaped(self.address(url))}"{named}>{self.inline(label, depth + 1)}</a>')
                k = end
            elif c == "<" and (m := re.match(r"<((?:https?|ftp|mailto):[^\s<>]*)>", s[k:])):
                flush()
                out.append(f'<a href="{escaped(self.address(m[1]))}">{escaped(m[1])}</a>')
                k += len(m[0])
            elif c in "*_~":
                run = re.match(rf"{re.escape(c)}+", s[k:])[0]
                before, after = s[k - 1 : k] or " ", s[k + len(run) : k + len(run) + 1] or " "
                wide = lambda x: x.isspace()
                mark = lambda x: not x.isalnum() and not x.isspace()
                left = not wide(after) and (not mark(after) or wide(before) or mark(before))
                right = not wide(before) and (not mark(before) or wide(after) or mark(after))
                flush()
                if c == "_":
                    left, right = left and (not right or mark(before)), right and (not left or mark(after))
                out.append([c, len(run), left, right] if c != "~" or len(run) == 2 else run)
                k += len(run)
            else:
                text.append(c)
                k += 1
        flush()
        return self.emphasis(out)

    @staticmethod
    def address(url: str) -> str:
        from urllib.parse import quote

        return quote(html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", url)), safe="%/:?#@!$&'()*+,;=-._~[]")

    @staticmethod
    def link(s: str, k: int) -> tuple[str, str, str, int] | None:
        depth, at = 0, k
        while at < len(s):
            if s[at] == "\\":
                at += 1
            elif s[at] == "[":
                depth += 1
            elif s[at] == "]":
                depth -= 1
                if not depth:
                    break
            at += 1
        if at >= len(s) or not (m := LINK.match(s, at + 1)):
            return None
        return s[k + 1 : at], m[1] if m[1] is not None else m[2], (m[3] or "")[1:-1], m.end()

    @staticmethod
    def emphasis(out: list) -> str:
        opened = []
        for k, x in enumerate(out):
            if not isinstance(x, list):
                continue
            front, back = [], []
            while x[3] and x[1]:
                at = next((j for j in range(len(opened) - 1, -1, -1) if out[opened[j]][0] == x[0] and out[opened[j]][1] and not ((out[opened[j]][3] or x[2]) and x[0] != "~" and (out[opened[j]][4] + x[1]) % 3 == 0 and (out[opened[j]][4] % 3 or x[1] % 3))), None)
                if at is None:
                    break
                o = out[opened[at]]
                use = 2 if min(o[1], x[1]) >= 2 else 1
                tag = "s" if x[0] == "~" else "strong" if use == 2 else "em"
                o[1] -= use
                x[1] -= use
                o[5].insert(0, f"<{tag}>")
                front.append(f"</{tag}>")
                for j in opened[at + 1 :]:
                    out[j][2] = False
                opened[at + 1 :] = []
                if not o[1]:
                    opened.pop(at)
            x += [x[1], back, front]
            if x[2] and x[1]:
                opened.append(k)
        return "".join(x if isinstance(x, str) else "".join(x[6]) + x[0] * x[1] + "".join(x[5]) for x in out)


def render(text: str, figures: dict[str, tuple[str, str]] | None = None) -> str:
    return Renderer(figures).render(text)


def embedded(assets: DataFrame) -> DataFrame:
    """doc_id, id, alt, data_url of the assets (doc_id, id, mime, alt, content) that can be printed."""
    rows = assets.where(printable(F.col("id"), F.col("mime")) & F.col("content").isNotNull() & (F.octet_length("content") <= MAX_IMAGE_BYTES))
    return rows.select("doc_id", "id", F.coalesce("alt", F.lit("")).alias("alt"), F.concat(F.lit("data:"), F.lower("mime"), F.lit(";base64,"), plain_base64(F.col("content"))).alias("data_url"))


def html_document(body: Column, title: Column) -> Column:
    head = '<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'
    return F.concat(F.lit(head), html_escaped(F.coalesce(title, F.lit(""))), F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body><main>"), body, F.lit("</main></body>\n</html>"))


def markers_used(editions: DataFrame) -> DataFrame:
    """doc_id, id of the images that an edition names: others need not travel."""
    return editions.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(MARKER.pattern), 1))).alias("id"))


def print_documents(editions: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """doc_id, html of (doc_id, title, content): the edition as an HTML document for print, with its images within."""
    rows = editions.where(F.col("content").isNotNull()).select("doc_id", "title", "content")
    kind = "map<string,struct<url:string,alt:string>>"
    if assets is None:
        rows = rows.withColumn("figures", F.lit(None).cast(kind))
    else:
        named = embedded(assets).join(markers_used(rows), ["doc_id", "id"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(F.col("data_url").alias("url"), "alt")))).alias("figures"))
        rows = rows.join(named, "doc_id", "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            figures = [dict((i, (f["url"], f["alt"])) for i, f in (x or [])) for x in batch.column(3).to_pylist()]
            made = [render(t, f) for t, f in zip(batch.column(2).to_pylist(), figures)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["doc_id", "title", "body"])

    made = rows.select("doc_id", "title", "content", "figures").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, title string, body string")
    return made.select("doc_id", html_document(F.col("body"), F.col("title")).alias("html"))
