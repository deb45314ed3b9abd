"""The inventory by joins against the scan within a row."""

from pyspark.sql import functions as F

from lectern.operators import inventories, prompts


def test_equal_to_the_scan(spark):
    """Paths with dots, repeated paths and assets, unknown ones, null arrays."""
    sections = spark.createDataFrame([(1, 0, 1, "one", ["a.png", "x/../b.png", "a.png"]), (1, 0, 2, "two", ["b.png", "a.png", "c.png"]), (1, 1, 3, "three", ["./c.png"]), (2, 0, 1, "other", None), (None, 0, 1, "none", ["a.png"])], "doc_id long, chunk int, ordinal int, label string, attachments array<string>")
    assets = spark.createDataFrame([(1, 1, "i1", "./a.png"), (1, 2, "i2", "a.png"), (1, 3, "i3", "b.png"), (None, 1, "i9", "a.png"), (2, 1, "i4", "c.png")], "doc_id long, ordinal int, id string, path string")
    got = sorted(((r.doc_id or 0, r.chunk, r.place, r.path, r.label, r.asset_id) for r in inventories.inventory(sections, assets).collect()))
    assert got == [(0, 0, 1, "a.png", "none", "i9"), (1, 0, 1, "a.png", "one", "i1"), (1, 0, 2, "x/../b.png", "one", "i3"), (1, 0, 3, "b.png", "two", "i3"), (1, 0, 4, "c.png", "two", None), (1, 1, 1, "./c.png", "three", None)]
    held = F.expr("array(named_struct('label', 'one', 'attachments', array('a.png', 'x/../b.png')), named_struct('label', 'two', 'attachments', array('b.png', 'a.png', 'c.png')))")
    listed = F.expr("array(named_struct('id', 'i1', 'mime', '', 'filename', '', 'path', './a.png', 'alt', '', 'source_url', ''), named_struct('id', 'i3', 'mime', '', 'filename', '', 'path', 'b.png', 'alt', '', 'source_url', ''))")
    text = spark.range(1).select(prompts.attachment_list(F.array(*map(F.lit, ("a.png", "x/../b.png", "b.png", "c.png"))), held, listed).alias("t")).first().t
    for (_, _, place, _, label, asset), line in zip([g for g in got if g[:2] == (1, 0)], text.split("\n"), strict=True):
        assert line.startswith(f"{place}. {label}") and (asset in line if asset else "evidence only" in line)


def test_moved_attachments(spark):
    sections = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (1, 2, []), (None, 1, ["a"]), (2, 1, None)], "doc_id long, ordinal int, attachments array<string>")
    moved = spark.createDataFrame([(1, "a", "z"), (1, "q", "r"), (2, "a", "y")], "doc_id long, path string, new_path string")
    got = sorted(((r.doc_id or 0, r.ordinal, r.attachments) for r in inventories.reattached(sections, moved).collect()), key=str)
    assert got == [(0, 1, ["a"]), (1, 1, ["z", "b", "z"]), (1, 2, []), (2, 1, None)]
