"""WARC archives and URL rules."""

import gzip
import hashlib
from collections import Counter

import duckdb

from gleanframe.llm import warc
from gleanframe.llm.registered import OP4_SQL, RULES
from gleanframe.llm.url_rules import judge

LONG = "<p>" + "w" * 1200 + "</p>"


def pages(spark):
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "x\r\ny", None),
            (7, "u", ""), (None, "n", LONG), (3, None, LONG), (8, "v", "é" * 700), (9, "v", "w" * 300_000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    got = Counter(tuple(r) for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == LONG and i != 3
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_splits_and_pushed_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT", 300)
    df, rows = pages(spark)
    path = f"file://{tmp_path}/archive"
    warc.archive(df.coalesce(1), path)
    reader = warc.WarcReader(path, True)
    assert len(reader.partitions()) > 3
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert [f.attribute for f in kept] == [("payload_length",)]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(found) == 3 and all(r["record_type"] == "revisit" and r["payload"] is None and r["payload_length"] == len(LONG) for r in found)
    records = warc.read(spark, path)
    assert records.filter("record_type = 'response'").count() == len(rows) - 3
    assert records.filter("record_id = 'urn:page:9' AND payload_length > 5").first()["payload"] == b"w" * 300_000
    assert records.filter("record_id IN ('urn:page:4', 'urn:page:5') AND target_uri LIKE 'http://a/4%'").count() == 1
    assert warc.read(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0


def test_foreign_files(spark, tmp_path):
    record = (b"WARC/1.0\r\nWARC-Type: %b\r\nWARC-Record-ID: <urn:uuid:%b>\r\nContent-Type: %b\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbody\r\n\r\nmore"
    parts = [record % (b"warcinfo", b"a", b"application/warc-fields", 5, b"k: v\n"), record % (b"response", b"b", b"application/http; msgtype=response", len(http), http)]
    (tmp_path / "one.warc").write_bytes(b"".join(parts))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "three.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert Counter((r["record_type"], r["payload"]) for r in rows) == {("warcinfo", b"k: v\n"): 3, ("response", b"body\r\n\r\nmore"): 3}
    assert warc.read(spark, f"file://{tmp_path}").filter("record_type = 'response'").count() == 3


def test_rules_and_aliases(spark):
    canonical = '<html><link href="{}" rel="canonical"></html>'
    refresh = '<META HTTP-EQUIV=refresh CONTENT="0; URL={}">'
    rows = {
        1: ("https://www.EXAMPLE.com/en/x?q#f", None, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("http://example.com/en/", "", "example.com", "/en/", "example.com/en/", "block"),
        3: ("http://sub.example.com/de/", "", "sub.example.com", "/de/", "com/", "allow"),
        4: ("http://com", "", "com", "", None, "allow"),
        5: ("http://a.net/fr/x", "", "a.net", "/fr/x", "net/fr/", "block"),
        6: ("no scheme", canonical.format("http://a.net/fr/x"), "", "", None, "allow"),
        7: (None, None, "", "", None, "allow"),
        8: ("http://one.org/p", canonical.format("http://a.net/fr/x"), "one.org", "/p", None, "block"),
        9: ("https://two.org/p/q", refresh.format("../elsewhere"), "two.org", "/p/q", None, "allow"),
        10: ("https://three.org/p/q", refresh.format("//one.org/p#top"), "three.org", "/p/q", None, "block"),
        11: ("http://four.org/a/b", canonical.format("c?x=1&amp;y=2"), "four.org", "/a/b", None, "block"),
        12: ("http://four.org/a/c?x=1&y=2", canonical.format("http://three.org/p/q"), "four.org", "/a/c", None, "block"),
        13: ("http://good.com/x", canonical.format("http://one.org/p"), "good.com", "/x", "com/", "allow"),
        14: ("http://notexample.com/en/", "", "notexample.com", "/en/", "com/", "allow"),
        15: ("http://self.org/", canonical.format("#here"), "self.org", "/", None, "allow"),
        16: ("http://five.org/x", canonical.format("http://good.com/y"), "five.org", "/x", None, "allow"),
        17: ("http://one.org/p#again", "", "one.org", "/p", None, "block"),
    }
    df = spark.createDataFrame([(i, r[0], r[1], "x", "y") for i, r in rows.items()] + [(None, None, "", "x", "y"), (5, rows[5][0], "", "x", "y")],
                               "page_id long, url string, html string, host string, node string").repartition(3)
    got = judge(df, RULES).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["page_id"] is not None:
            assert tuple(r)[1:] == rows[r["page_id"]][2:], r["page_id"]
    assert judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge(df, []).collect()} == {"allow"}


def test_all_links_of_a_page_are_edges(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    bad = "http://a.net/fr/x"
    rows = [(1, "http://one.org/", canonical.format("http://one.org/") + refresh.format(bad)), (2, "http://two.org/", canonical.format("http://one.org/")),
            (3, "http://three.org/", canonical.format("/") + canonical.format(bad)), (4, "http://four.org/", refresh.format("/here") + refresh.format(bad)),
            (5, "http://five.org/", canonical.format("") + canonical.format("http://four.org/here")), (6, "http://six.org/", canonical.format("/") + refresh.format("/x")),
            (7, "http://seven.org/", '<link rel="canonical">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in judge(df, RULES).collect()} == {**dict.fromkeys(range(1, 6), "block"), 6: "allow", 7: "allow"}


def test_spellings_of_one_url(spark, tmp_path):
    """Bare hosts, dot segments, ports, bases, comments, scripts and links to no page: code and SQL agree, and both with the expectation."""
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    bad = refresh.format("http://a.net/fr/x")
    rows = [
        (1, "http://one.org", bad, "block"), (2, "http://two.org/x", canonical.format("http://one.org/"), "block"),
        (3, "http://three.org/a/b/../c/./d", bad, "block"), (4, "http://four.org/", canonical.format("https://three.org/a/c/d"), "block"),
        (5, "http://five.org/a/b", canonical.format("../z"), "block"), (6, "http://five.org/z", bad, "block"),
        (7, "http://six.org:80/p", bad, "block"), (8, "https://seven.org:443/", canonical.format("https://six.org/p"), "block"),
        (9, "http://eight.org/p/q", '<base href="/other/">' + canonical.format("r"), "block"), (10, "http://eight.org/other/r?", "", "allow"),
        (11, "http://eight.org/other/r", bad, "block"), (12, "http://nine.org/", f"<!-- {canonical.format('http://one.org')} --><p>", "allow"),
        (13, "http://ten.org/", f"<script>x = '{canonical.format('http://one.org')}'</script>", "allow"), (14, "http://ten.org/m", canonical.format("mailto:a@one.org"), "allow"),
        (15, "http://el.org/..", canonical.format("http://six.org/./p/"), "allow"), (16, "http://el.org/", "<!-- open " + bad, "allow"),
        (17, "http://el.org:8080/", canonical.format("http://one.org/."), "block"), (18, "http://TW.org/A/..", canonical.format("http://one.org?"), "block"),
        (19, "http://tw.org/", canonical.format("http://one.org#x"), "block"), (20, "http://th.org/x/..", canonical.format("//one.org"), "block"),
        (21, "http://th.org", "", "block"), (22, None, canonical.format("http://one.org"), "allow"), (23, "http://ft.org/", None, "allow"),
    ]
    spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in judge(spark.read.parquet(f"{tmp_path}/pages.parquet"), RULES).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = con.execute(OP4_SQL)
    assert [d[0] for d in sql.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert got == set(sql.fetchall())
    assert {r[0]: r[4] for r in got} == {r[0]: r[3] for r in rows}
