"""Operators against plain versions and the edge cases of their rules."""

import base64
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks, extraction, figures, html, images, prompts, ranks, render, report, urls
from lectern.sources import files
from lectern.streaming import events, uploads

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAoAAAAHCAYAAAAxrNxjAAAAAElFTkSuQmCC")


# --- Pages ------------------------------------------------------------------


def contents(page, url=None, **more):
    return [s["content"] for s in html.parse(page, url, **more)["sections"]]


def test_sections_are_numbered_after_filtering():
    found = html.parse('<script>x</script><p> </p><p>one</p><p hidden>no</p><div><h2> A <i>b</i></h2></div>tail<hr><div>d</div>', "http://h/")["sections"]
    assert [(s["id"], s["label"]) for s in found] == [("page-section-001", "p 1"), ("page-section-002", "A b"), ("page-section-003", "Page text 3"), ("page-section-004", "hr 4"), ("page-section-005", "Page section 5")]
    assert found[2]["content"] == "tail" and found[3]["content"] == "<hr>"


def test_cleaning():
    assert contents('<div><custom>t</custom> <b onclick="x" id="k">u</b><!-- c --></div>') == ['<div>t <b id="k">u</b></div>']
    assert contents("<p>a<b> </b>c</p>") == ["<p>a<b></b>c</p>"]
    assert contents("<pre>a \n  b</pre><p>a \n  b</p>") == ["<pre>a \n  b</pre>", "<p>a b</p>"]
    assert contents("<form><p>x</p></form><math><mi>y</mi></math>") == ["<p>x</p>", "<math><mi>y</mi></math>"]
    assert contents('<div style="display:none">kept<img alt="i" src="x.png"></div>')[0].startswith("<div>kept<lectern-image")
    assert contents('<code class="language-py x">a</code><pre class="language-c++">b</pre>') == ["<code>a</code>", '<pre class="language-c++">b</pre>']
    assert contents(f'<p id="{"i" * 1001}" role="r" title="t">x</p>') == ['<p role="r">x</p>']
    assert contents("<p>a &amp; b &lt; c&nbsp;d</p>") == ["<p>a &amp; b &lt; c&nbsp;d</p>"]
    assert contents('<lectern-image onclick="x">y</lectern-image>z') == ["y", "z"]
    assert contents("") == [""] and html.parse("")["sections"][0]["label"] == "Page content"


def test_unclosed_elements():
    assert contents("<p>one<p>two<ul><li>a<li>b</ul>") == ["<p>one</p>", "<p>two</p>", "<ul><li>a</li><li>b</li></ul>"]
    assert contents("<p><b>a<p>b</p>") == ["<p><b>a</b></p>", "<p><b>b</b></p>"]
    assert contents("<table><tr><td>1<td>2<tr><td>3</table>") == ["<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<b>" * 20_000 + "x", "<i><p>" * 3_000 + "x", "<p>" * 20_000 + "x", "<ul><li>" * 5_000 + "x"])
def test_deep_pages(page):
    assert "x" in contents(page)[-1]


def test_links():
    base = "https://u:p@h.com/a/b?c"
    for given, want in {
        "../r?utm_source=1#f": "https://h.com/r#f",
        "https://u:p@h.com/?utm_source=z&a=b%20c": "https://h.com/?a=b+c",
        "/x?a=b%20c": "https://h.com/x?a=b%20c",
        "HTTP://H.com:80": "http://h.com/",
        "//o.org/./p/../q": "https://o.org/q",
        "?utm_=1": "https://h.com/a/b?utm_=1",
        "mailto:a@b.c": "mailto:a@b.c",
        "javascript:x": None,
        "data:text/html,x": None,
        "http://": None,
    }.items():
        assert urls.safe_url(given, base) == want, given
    assert len(urls.safe_url("http://h/" + "a" * 9000, base)) == 4096
    assert urls.asset_url("https://u:p@h.com/i.png?x#y") == "https://h.com/i.png" and urls.asset_url("file:///x") is None


def test_metadata():
    head = '<html lang=" de "><head><title> A  b </title><link rel="x canonical" href="/c?gclid=1">'
    meta = "".join(f'<meta {k}="{n}" content="{v}">' for k, n, v in [("name", "update-frequency", "no"), ("property", "og:title", "T"), ("property", "og:title", "U"), ("name", "byl", "B"), ("name", "Author", ""), ("name", "language", "fr"), ("name", "description", "d" * 3000), ("name", "a:description", "x" * 18000), ("name", "keywords", "k")])
    found = dict(html.parse(head + meta, "https://h.com/p")["metadata"])
    assert found == {"title": "A b", "language": "fr", "canonicalUrl": "https://h.com/c", "og:title": "T", "byl": "B", "description": "d" * 2000, "keywords": "k"}


def test_images_of_pages():
    url = "data:image/png;base64," + base64.b64encode(PNG).decode()
    page = '<figure><img src="a.png"><figcaption> C  d </figcaption></figure><picture><img alt="in"></picture><svg><title>S</title></svg><img role="presentation"><video poster="p.jpg"></video>'
    assert "[Image: C d]" in contents(page)[0] and "[Image: in]" in "".join(contents(page)) and "[Image: S]" in "".join(contents(page))
    made = html.parse(page, "http://h/", [{"id": "image-007", "data_url": url, "label": "L", "alt": None, "source_url": "http://h/a?utm_a=1"}, {"id": "image-007", "data_url": url, "label": "M"}, {"id": None, "data_url": "data:text/plain;base64,AA"}, {"id": None, "data_url": url, "label": "N"}])
    assert [a["id"] for a in made["assets"]] == ["image-007", "image-002", "image-003"] and made["assets"][0]["source_url"] == "http://h/a"
    assert "[[LECTERN_IMAGE:image-003]]" in "".join(s["content"] for s in made["sections"])
    local = html.parse(f'<img src="{url}"><img src="i/p.jpg" alt="P"><img src="http://h/x.png"><img width="1" src="{url}"><div hidden><img src="{url}"></div><svg></svg>', "file:///d/x.html", local_images=True)
    assert [(a["id"], a["mime"], a["path"]) for a in local["assets"]] == [("image-001", "image/png", None), ("image-002", "image/jpeg", "file:///d/i/p.jpg"), ("image-003", "image/svg+xml", None)]
    assert local["sections"][0]["attachments"] == ["image-001.png"]
    assert html.first_srcset_url(" a.png 2x, b.png") == "a.png" and images.data_image("data:image/png;base64,") is None


def test_bundles(spark):
    d = spark.createDataFrame([(1, "http://h/", "<p>x</p>", 5), (2, None, None, 5), (1, "http://h/", "<p>x</p>", 5)], "page_id long, url string, html string, title int")
    rows = html.pages_to_bundles(d).orderBy("page_id").collect()
    assert [(r["page_id"], r["kind"], r["error"], len(r["sections"])) for r in rows] == [(1, "webpage", None, 1), (1, "webpage", None, 1), (2, "html", None, 1)]
    assert html.section_rows(html.pages_to_bundles(d.limit(0))).count() == 0


# --- Chunks -----------------------------------------------------------------


def test_cut_points():
    text = "a" * 70 + "\n\n" + "b" * 200
    parts = chunks.cut_points(text, 100)
    assert "".join(parts) == text and parts[0] == "a" * 70 + "\n\n" and len(parts[1]) == 100
    line = "a" * 18_000 + "\n" + "b" * 30_000
    assert len(chunks.cut_points(line, 30_001)[0]) == 18_001
    assert chunks.cut_points("x" * 90 + "</b>" + "y" * 50, 100)[0] == "x" * 90 + "</b>"
    assert chunks.cut_points("x" * 98 + "</b>" + "y" * 50, 100)[0] == "x" * 98
    wide = "😀" * 100
    parts = chunks.cut_points(wide, 51)
    assert "".join(parts) == wide and all(len(p) == 25 for p in parts)


def test_cut_points_against_all_places():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "\n", "\n\n", "</p>", "<i>"]) for _ in range(rng.randrange(200)))
        budget, at, want = rng.randrange(5, 60), 0, []
        while at < len(text):
            hard = min(len(text), at + budget)
            end = hard
            if hard < len(text):
                natural = max((k for k in range(hard + 1) if any(text.startswith(m, k) for m in ("\n\n", "</", "\n"))), default=-1)
                if natural >= at + int(budget * 0.6):
                    if text.startswith("\n\n", natural):
                        end = natural + 2
                    elif text.startswith("</", natural):
                        close = text.find(">", natural + 2)
                        end = close + 1 if natural <= close < hard else natural
                    else:
                        end = natural + 1
            if end == at:
                break
            want.append(text[at:end])
            at = end
        else:
            assert chunks.cut_points(text, budget) == want


def test_pack_limits(spark):
    parts = spark.createDataFrame([(1, 1, 1, 100_000, 10, 0), (1, 2, 1, 30_000, 10, 0), (1, 3, 1, 10, 10, 20), (1, 4, 1, 10, 10, 1), (2, 1, 1, 500_000, 1, 0), (2, 2, 1, 1, 1, 0)], "doc_id long, ordinal long, part int, markup int, visible int, attachments int")
    assert [r["chunk"] for r in chunks.pack_sections(parts).orderBy("doc_id", "ordinal").collect()] == [0, 1, 1, 2, 0, 1]
    assert chunks.pack_sections(parts.limit(0)).count() == 0


def test_parts_and_assets(spark):
    paths = [f"f{k}.png" for k in range(45)]
    sections = spark.createDataFrame([(1, 0, "s-001", "L", "text", [*paths, "f0.png"], ["i1", "none", "i44"]), (1, 1, "s-002", "M", "<p> </p>", [], []), (1, 2, "s-003", "N", "x" * 70_000, [], None)], "doc_id long, ordinal long, id string, label string, content string, attachments array<string>, asset_ids array<string>")
    assets = spark.createDataFrame([(1, k, f"i{k}", "image/png", f"i{k}.png", f"f{k}.png", None, None) for k in (44, 1, 7)], "doc_id long, ordinal long, id string, mime string, filename string, path string, alt string, source_url string")
    parts = chunks.normalise_sections(sections, assets)
    rows = parts.orderBy("ordinal", "part").collect()
    assert [(r["id"], r["label"], len(r["attachments"]), r["asset_ids"], len(r["content"])) for r in rows[:3]] == [("s-001-part-1", "L (part 1 of 3)", 20, ["i1"], 4), ("s-001-part-2", "L (part 2 of 3)", 20, [], 0), ("s-001-part-3", "L (part 3 of 3)", 5, ["i44"], 0)]
    assert "".join(r["content"] for r in rows[3:]) == "x" * 70_000 and len(rows) == 6
    made = chunks.assemble_chunks(parts, assets).orderBy("chunk").collect()
    assert [r["chunk"] for r in made] == list(range(len(made))) and {r["total"] for r in made} == {len(made)}
    assert [a["id"] for r in made for a in r["assets"] or []] == ["i1", "i44"] and sum(len(r["attachments"]) for r in made) == 45


# --- The model step ---------------------------------------------------------


def test_prompt(spark):
    section = "array<struct<id:string,label:string,content:string,attachments:array<string>,asset_ids:array<string>>>"
    asset = "array<struct<id:string,mime:string,filename:string,path:string,alt:string,source_url:string>>"
    rows = [("pdf", True, " say \"x\" ", 1, 3, "T", [("s1", "One", "text", ["d/./a.png"], [])], ["d/./a.png", "b.png"], [("image-001", "image/png", "a.png", "d/a.png", None, None)]), ("txt", False, None, 0, 1, None, [], [], [])]
    d = spark.createDataFrame(rows, f"fmt string, img boolean, custom string, chunk long, total long, title string, sections {section}, attachments array<string>, assets {asset}")
    c = F.col
    made = [r[0] for r in d.select(prompts.prompt(c("fmt"), c("img"), c("custom"), c("chunk"), c("total"), F.struct(F.lit("html").alias("kind")), c("title"), F.create_map(F.lit("k"), F.lit("v")), c("sections"), c("attachments"), c("assets"))).collect()]
    assert "part 2 of 3" in made[0] and '"say \\"x\\""' in made[0] and "1. One; usable as [[LECTERN_IMAGE:image-001]]\n2. source visual; evidence only" in made[0]
    assert "d/a.png" not in made[0].split("Usable images:")[1] and "--- SECTION s1: One ---\ntext\n--- END SECTION s1 ---" in made[0] and '{"k":"v"}' in made[0]
    assert "This is the whole document." in made[1] and "Unknown" in made[1] and "There is no text" in made[1] and prompts.RULES["txt"] in made[1]


def test_extraction(spark):
    def extractor(chunk, options):
        import os

        mark = f"{options['dir']}/{chunk['doc_id']}-{chunk['chunk']}"
        first = not os.path.exists(mark)
        open(mark, "a").close()
        if chunk["doc_id"] == 2 and first:
            raise RuntimeError("busy")
        if chunk["doc_id"] == 3:
            raise RuntimeError("Unauthorized")
        return f"\r\n part {chunk['chunk']}\r"

    import tempfile

    d = spark.createDataFrame([(doc, k, 2) for doc in (1, 2, 3) for k in (1, 0)], "doc_id long, chunk long, total long").coalesce(1)
    with tempfile.TemporaryDirectory() as folder:
        out = extraction.extract_chunks(d, extractor, {"dir": folder}).collect()
    assert {(r["doc_id"], r["attempts"]) for r in out} == {(1, 1), (2, 2), (3, 1)}
    rows = spark.createDataFrame(out, "doc_id long, chunk long, total long, output string, error string, attempts int, millis long")
    made = {r["doc_id"]: r for r in extraction.editions(rows).collect()}
    assert made[1]["content"] == made[2]["content"] == "part 0\n\npart 1\n" and made[3]["content"] is None and made[3]["error"] == "Unauthorized"


def test_extraction_that_never_answers(spark):
    def slow(chunk, options):
        import time

        time.sleep(3)
        return "x"

    d = spark.createDataFrame([(1, 0, 1)], "doc_id long, chunk long, total long")
    row = extraction.extract_chunks(d, slow, timeout=0.2).first()
    assert row["attempts"] == 2 and "within 0.2 s" in row["error"]


# --- Uploads and events -----------------------------------------------------


def requests():
    b = lambda i, s, t, **k: {"id": i, "seq": s, "type": t, "totalBytes": None, "index": None, "data": None} | k
    pdf = base64.b64encode(b"%PDF-1").decode()
    return [
        b("a", 0, "extract-begin", totalBytes=9), b("a", 1, "extract-chunk", index=0, data="old"),
        b("a", 2, "extract-begin", totalBytes=5), b("a", 3, "extract-chunk", index=1, data="x"), b("a", 4, "extract-chunk", index=0, data="né"), b("a", 5, "extract-chunk", index=1, data="toolong"), b("a", 6, "extract-chunk", index=1, data="ab"), b("a", 7, "extract-commit"), b("a", 8, "extract-commit"),
        b("p", 0, "extract-pdf-begin", totalBytes=6), b("p", 1, "extract-chunk", index=0, data="x"), b("p", 2, "extract-pdf-chunk", index=0, data="QQ"), b("p", 3, "extract-pdf-chunk", index=0, data=pdf), b("p", 4, "extract-commit"),
        b("s", 0, "extract-begin", totalBytes=3), b("s", 1, "extract-commit"), b("z", 0, "extract-chunk", index=0, data="x"),
    ]


KIND = "id string, seq long, type string, totalBytes long, index long, data string"
WANT = {
    "a": [True, True, True, "out of order", True, "exceeded", True, True, "not begun"],
    "p": [True, "page data", "canonical", True, True],
    "s": [True, "incomplete (0 of 3 bytes)"],
    "z": ["not begun"],
}


def right(rows):
    for key, found in itertools.groupby(sorted(rows, key=lambda r: (r["id"], r["seq"])), key=lambda r: r["id"]):
        found = list(found)
        assert len(found) == len(WANT[key])
        for r, want in zip(found, WANT[key]):
            assert r["accepted"] if want is True else not r["accepted"] and want in r["error"], (r, want)


def test_uploads(spark):
    d = spark.createDataFrame(requests(), KIND)
    made = uploads.outcomes(d)
    right(made.collect())
    assert {r["id"]: bytes(r["content"]) for r in uploads.payloads(d, made).collect()} == {"a": "néab".encode(), "p": b"%PDF-1"}


def test_upload_stream(spark, tmp_path):
    for k, part in enumerate((requests()[:5], requests()[5:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = uploads.outcome_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    right(spark.read.parquet(str(tmp_path / "out")).collect())


def test_frames_and_requests(spark):
    bodies = ['{"id":"1","type":"extract-begin","totalBytes":5}', '{"id":"2","type":"nope"}', "{", '{"id":"3","type":"read-output","path":"x","length":500000}']
    frame = lambda b: len(b.encode()).to_bytes(4, "little") + b.encode()
    whole = b"".join(map(frame, bodies))
    rows = [("c", k, whole[k * 7 : k * 7 + 7]) for k in range(len(whole) // 7 + 1)] + [("d", 0, frame(bodies[0]) + (9 << 20).to_bytes(4, "little")), ("d", 1, frame(bodies[0]))]
    found = uploads.decode_frames(spark.createDataFrame(rows, "connection string, seq long, data binary"))
    assert [r["body"] for r in found.where("connection = 'c'").orderBy("n").collect()] == bodies
    assert [(r["body"], r["error"]) for r in found.where("connection = 'd'").orderBy("n", F.col("error").isNotNull()).collect()] == [(bodies[0], None), (None, "request is too large")]
    checked = {r["n"]: r for r in uploads.requests(found.where("connection = 'c'")).collect()}
    assert [checked[k]["error"] for k in range(4)] == [None, "unknown request type", "no request id", "range out of bounds"] and checked[0]["r"]["options"]["format"] == "md"
    assert bytes(spark.range(1).select(uploads.encode_frame(F.lit("é!"))).first()[0]) == frame("é!")


def test_ranges_and_slices(spark):
    text = "aé😀" * 40
    for n in (1, 2, 3, 5, 64):
        pages = spark.range(1).select(uploads.read_pages(F.encode(F.lit(text), "UTF-8"), n).alias("p")).first()["p"]
        assert "".join(p["data"] for p in pages) == text and pages[-1]["done"] and not any(p["done"] for p in pages[:-1])
    assert "".join(uploads.text_slices(text, 7)) == text and all(urls.length16(s) <= 7 for s in uploads.text_slices(text, 7))


def test_events(spark):
    rows = [("t", 0, "item/started", "i", "agentMessage", "commentary", None, None), ("t", 1, "item/agentMessage/delta", "i", None, None, "no", None), ("t", 2, "item/agentMessage/delta", "j", None, None, "yes", None), ("t", 3, "item/reasoning/summaryTextDelta", "i", None, None, "think", None), ("t", 4, "item/completed", "j", "agentMessage", None, None, "end"), ("t", 5, "item/completed", "k", "agentMessage", "commentary", None, "aside")]
    d = spark.createDataFrame(rows, "thread string, seq long, method string, item string, item_type string, phase string, delta string, text string")
    assert [(r["kind"], r["delta"]) for r in events.visible_deltas(d).orderBy("seq").collect()] == [("output", "yes"), ("reasoning", "think")]
    assert events.final_text(d).first()["text"] == "end"
    names = events.unique_names(spark.createDataFrame([(k, "a") for k in range(4)], "k long, base string"), "k", "base", "k", spark.createDataFrame([("a",), ("a-3",), ("a-x",)], "name string"))
    assert [r["name"] for r in names.orderBy("k").collect()] == ["a-2", "a-4", "a-5", "a-6"]


# --- Figures, files, rendering, reports -------------------------------------


def test_figures(spark):
    box = lambda left, top, right, bottom: [left, top, right, top, left, bottom]
    coordinates = [*box(0.1, 0.1, 0.5, 0.5), *box(0.1, 0.1, 0.5, 0.51), *box(0.0, 0.0, 1.0, 1.0), *box(0.6, 0.6, 0.61, 0.9), *box(0.6, 0.1, float("nan"), 0.4), *box(0.55, 0.6, 1.4, 0.9)]
    d = spark.createDataFrame([(1, 2, [("b ", True), ("c", False)], coordinates, 1000, 1000), (1, 1, [], None, 1000, 1000)], "doc_id long, page int, items array<struct<str:string,eol:boolean>>, coordinates array<double>, width int, height int")
    rows = figures.pdf_sections(d).orderBy("ordinal").collect()
    assert rows[0]["id"] == "pdf-page-0001" and "no text layer" in rows[0]["content"] and rows[0]["asset_ids"] == []
    assert rows[1]["asset_ids"] == ["pdf-image-001", "pdf-image-002"] and "Text layer of the page:\nb\nc" in rows[1]["content"]
    assert "- [[LECTERN_IMAGE:pdf-image-002]] (page 2, horizontal 55%-100%, vertical 60%-90%)" in rows[1]["content"]
    assert tuple(rows[1]["crops"][0]) == (98, 98, 502, 502) and tuple(rows[1]["crops"][1]) == (548, 598, 1000, 902)


def test_files(spark, tmp_path):
    for name, content in {"b10.png": PNG, "B9.png": PNG, "x.html": b"plain", "y": b" <!DOCTYPE  html>", "z.pdf": b"%PDF-1", "e": b"", "bad.png": PNG[:12], "t.txt": b"t"}.items():
        (tmp_path / name).write_bytes(content)
    found = files.files(spark, str(tmp_path))
    got = {r["name"]: (r["kind"], r["error"] is None) for r in found.collect()}
    assert got == {"b10.png": ("image", True), "B9.png": ("image", True), "x.html": ("html", True), "y": ("html", True), "z.pdf": ("pdf", True), "bad.png": ("image", True), "t.txt": (None, False)}
    assert files.inspected(spark.createDataFrame([("/e.html", b"")], "path string, content binary")).first()["error"] == "input file is empty"
    images_found = files.image_rows(files.supported_images(found))
    assert {(r["name"], r["width"], r["height"], r["error"]) for r in images_found.collect()} == {("b10.png", 10, 7, None), ("B9.png", 10, 7, None), ("bad.png", None, None, "could not decode image bad.png")}
    made = files.gallery(images_found.where("error is null").withColumn("doc", F.lit(1)), "doc", [T.natural_key(F.col("name")), "name"])
    assert [r["label"] for r in made.orderBy("ordinal").collect()] == ["Image 1 of 2: B9.png", "Image 2 of 2: b10.png"]
    assert files.html_pages(found).count() == 2
    kinds = files.source_kinds(spark.createDataFrame([(["a", "b"],), (["-"],), (["https://h"],), (["x"],), ([],)], "sources array<string>").withColumn("is_directory", F.lit(False)))
    assert [r["kind"] for r in kinds.collect()] == ["image-gallery", "stdin", "webpage", None, None]
    files.write_editions(spark.createDataFrame([(1, "a\nb\n")], "doc_id long, content string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"] == "a\nb\n"


def test_natural_order(spark):
    names = ["img2", "IMG10", "img1", "Éa", "eb", "img02b"]
    d = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")), "n")
    assert [r["n"] for r in d.collect()] == ["Éa", "eb", "img1", "img2", "img02b", "IMG10"]


@pytest.mark.parametrize("n", [0, 1, 3, 500, 6000])
def test_ranked(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([None, "", *(f"k{rng.randrange(n * 2):05}" for _ in range(20))])) for k in range(n)]
    d = spark.createDataFrame(rows, "id long, k string").withColumn("_range", F.lit(1))
    found = sorted((r["place"], r["k"]) for r in ranks.ranked(d, "k", "place").collect() if r["_range"] == 1 and r["k"] is not None)
    nulls = sum(k is None for _, k in rows)
    assert [p for p, _ in found] == list(range(nulls + 1, n + 1)) and [k for _, k in found] == sorted(k for _, k in rows if k is not None)


def test_render(spark):
    r = render.render
    assert r("# A *b*\n\nc **d** `<e>` [f](http://g/ \"h\") <i>") == '<h1>A <em>b</em></h1>\n<p>c <strong>d</strong> <code>&lt;e&gt;</code> <a href="http://g/" title="h">f</a> &lt;i&gt;</p>\n'
    assert r("![a *b*](http://x/y.png) [j](javascript:k)") == "<p>a b [j](javascript:k)</p>\n"
    assert r("- a\n- b\n\n1. c") == "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n</ol>\n" and r("---") == "<hr>\n" and r("> q") == "<blockquote>\n<p>q</p>\n</blockquote>\n"
    assert '<a href="#fn1"' in r("x[^n]\n\n[^n]: y") and r("[" * 5000).startswith("<p>") and r("> " * 3000 + "x")
    assert r("x [[LECTERN_IMAGE:a]] [[LECTERN_IMAGE:b]]", {"a": ("data:x", '"')}) == '<p>x <span class="figure"><img src="data:x" alt="&quot;"></span> </p>\n'
    editions = spark.createDataFrame([(1, "T<", "[[LECTERN_IMAGE:image-001]] [[LECTERN_IMAGE:image-002]]"), (2, None, None)], "doc_id long, title string, content string")
    assets = spark.createDataFrame([(1, "image-001", "image/PNG", "al", bytearray(PNG)), (1, "image-002", "text/html", None, bytearray(PNG))], "doc_id long, id string, mime string, alt string, content binary")
    rows = render.print_documents(editions, assets).collect()
    assert len(rows) == 1 and "<title>T&lt;</title>" in rows[0]["html"] and rows[0]["html"].count("data:image/png;base64,iVBOR") == 1


def test_report(spark):
    plan = report.plan(spark.createDataFrame([(1, 0), (2, 1)], "article_id long, ordinal long"))
    assert report.plan(spark.createDataFrame([(1, 0), (2, 1)], "article_id long, ordinal long"), ["md", "md"], ["2"]).count() == 2
    assert [r["run_id"] for r in report.plan(spark.createDataFrame([(2, 1), (1, 0)], "article_id long, ordinal long"), limit=4).collect()] == ["1:txt", "1:md", "1:pdf", "2:txt"]
    with pytest.raises(ValueError, match="unknown article"):
        report.plan(plan.select("article_id", "ordinal"), ids=["9"])
    ids = [r["run_id"] for r in plan.collect()]
    runs = spark.createDataFrame([(i, False, False, 0, 10, 1, 1000.0, 1.0, 1.0, 1.0, 1.0, -1.0, None, 1.0) for i in ids], "run_id string, timed_out boolean, spawn_error boolean, exit_code int, file_bytes long, attempts int, total_ms double, capture_ms double, model_ms double, render_ms double, chunk_count double, source_bytes double, output_bytes double, image_count double")
    state = report.completed(runs)
    assert state.first()["source_bytes"] is None and state.first()["output_bytes"] == 10
    score = "run_id string, fidelity double, selection double, format_compliance double, coherence double, reliability double, txt_violation boolean, pdf_defect boolean, notes string"
    good = spark.createDataFrame([(i, 35.0, 25.0, 25.0, 10.0, 5.0, False, None, " n ") for i in ids], score)
    status = lambda s, c: report.acceptance(report.checked_report(plan, s, c)).first()
    assert status(state, good)["status"] == "pass" and status(state.limit(3), good)["status"] == "incomplete"
    low = good.withColumn("fidelity", F.when(F.col("run_id") == "1:md", 1.0).otherwise(F.col("fidelity")))
    assert status(state, low)["status"] == "fail" and status(state, low)["least_score_pass"] is False and status(state, low)["score_medians_pass"] is False
    for bad in (good.withColumn("run_id", F.lit("x")), good.unionByName(good), good.withColumn("fidelity", F.lit(36.0)), good.withColumn("notes", F.lit("n" * 501))):
        with pytest.raises(ValueError):
            report.checked_report(plan, state, bad)
    assert report.pending(plan, state).count() == 0 and report.pending(plan, state, force=True).count() == 6
    again = report.merged_state(state, state.limit(2))
    assert again.where("attempts = 2").count() == 2 and again.count() == 6
    text = report.markdown(report.report(plan, state, good), "b", "now").first()["report"]
    assert "- Status: pass" in text and text.index("| 1 | txt |") < text.index("| 2 | md |") and "| 1000 |" in text
