"""A revisit is followed through the archive by its record id, whatever the layout of tasks."""

from tickerloom.llm import warc

ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "same"), (4, "http://d", "x" * 5000), (5, "http://e", "x" * 5000), (6, None, None), (7, "http://g", ""), (8, "h", "own"), (9, "i", "twice"), (9, "i", "twice")]


def test_revisits_resolve(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    found = []
    for n in (1, 4):
        out = str(tmp_path / f"warc{n}")
        warc.write_archive(pages.repartition(n), out, segment=1000)
        records = warc.read_records(spark, out).collect()
        names = [r.name for r in records]
        assert len(set(names)) == len(names)
        responses = {r.name: r for r in records if r.kind == "response"}
        revisits = [r for r in records if r.kind == "revisit"]
        assert len(revisits) == 4
        for r in revisits:
            assert responses[r.refers].digest == r.digest
        found.append(sorted((r.refers for r in revisits)))
        rows = {r.page_id: r for r in warc.payload_rows(warc.reassemble(warc.read_records(spark, out))).collect()}
        assert rows[1].refers_to == rows[2].refers_to == 3 and rows[4].refers_to == 5 and rows[6].refers_to == 7 and rows[8].refers_to is None
        assert all(r.fault is None for r in rows.values())
    assert found[0] == found[1]
