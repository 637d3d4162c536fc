"""From files to records: directory, submissions, documents, return index, archives, store and stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerine.operators import filings, html, ixbrl, store
from ledgerine.plans import report, sec
from ledgerine.plans.service import Service
from ledgerine.sources import fetch, readers
from ledgerine.streaming import landing

FILING = """<html><body><xbrli:context id="a"><xbrli:entity><xbrli:identifier scheme="s">7</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate>
<xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context><p><ix:nonFraction name="us-gaap:NetIncomeLoss" contextRef="a" scale="6" id="f">1,5</ix:nonFraction></p>
<table><tr><td>Name</td><td>Salary</td></tr><tr><td>Ann</td><td>$ 5</td></tr></table></body></html>"""
RETURN = "<Return returnVersion='1'><ReturnHeader><ReturnTypeCd>990</ReturnTypeCd><TaxPeriodBeginDt>2024-01-01</TaxPeriodBeginDt><TaxPeriodEndDt>2024-12-31</TaxPeriodEndDt><Filer><BusinessName><BusinessNameLine1Txt>Good Works</BusinessNameLine1Txt></BusinessName></Filer></ReturnHeader><ReturnData><IRS990><TotalEmployeeCnt>3</TotalEmployeeCnt><CYTotalRevenueAmt>10</CYTotalRevenueAmt><CYTotalExpensesAmt>4</CYTotalExpensesAmt></IRS990></ReturnData></Return>"


@pytest.fixture
def service(spark, tmp_path):
    (tmp_path / "tickers.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "ABC", "title": "Abc Corp"}, "1": {"cik_str": 8, "ticker": "NONE", "title": "None"}}))
    recent = {k: ["x", "x"] for k in ("filingDate", "reportDate", "fileNumber", "primaryDocDescription")} | {"accessionNumber": ["0001-24-1", "0001-24-2"], "form": ["8-K", "10-K"], "isXBRL": [1, 1], "isInlineXBRL": [1, 1], "primaryDocument": ["e.htm", "d.htm"]}
    (tmp_path / "subs").mkdir()
    (tmp_path / "subs" / "CIK0000000007.json").write_text(json.dumps({"cik": "0000000007", "name": "Abc Corp", "tickers": ["ABC"], "exchanges": ["X"], "filings": {"recent": recent}}))
    doc = tmp_path / "docs" / "7" / "0001242"
    doc.mkdir(parents=True)
    (doc / "d.htm").write_text(FILING)
    (tmp_path / "index.csv").write_text("RETURN_ID,FILING_TYPE,EIN,TAXPAYER_NAME,RETURN_TYPE,XML_BATCH_ID,OBJECT_ID\n1,E,55,Other,990T,b1,o0\n2,E,55,Good Works,990,b1,o1\n3,E,66,Lost,990EZ,b1,o9\n")
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "B1.zip", "w") as z:
        z.writestr("B1/o1_public.xml", RETURN)
    return Service(spark, f"{tmp_path}/tickers.json", f"{tmp_path}/subs", f"{tmp_path}/docs", f"{tmp_path}/index.csv", f"{tmp_path}/zips", store.Store(spark, f"{tmp_path}/kept"))


def test_records_by_identifier(service):
    row = service.facts_for_ticker("abc").first()
    assert (row["id"], row["source_type"], row["company_name"], row["ticker"]) == ("7", "SEC", "Abc Corp", "ABC")
    assert row["net_income_loss"][0]["content"] == "1,5" and row["net_income_loss"][0]["context"]["period"]["end_date"] == "2023-12-31"
    assert [f["form"] for f in row["filings"]] == ["10-K"] and len(row["exec_compensation_html"]) == 1
    versions = service.kept.versions("facts")
    assert service.facts_for_cik("0000000007").first()["updated_at"] == row["updated_at"] and service.kept.versions("facts") == versions  # fresh: not made again
    ein = service.facts_for_ein("55").first()
    assert (ein["id"], ein["source_type"], ein["company_name"], ein["employees_count"]) == ("55", "IRS", "Good Works", 3)
    assert service.kept.read("facts").count() == 2 and service.irs_return_xml("55").first()["xml"] == RETURN
    for call, key in ((service.facts_for_ticker, "zzz"), (service.facts_for_cik, "8"), (service.facts_for_ein, "99"), (service.irs_return_xml, "66")):
        with pytest.raises(LookupError):
            call(key)


def test_records_by_batch(service, spark):
    wanted = [("ticker", "ABC"), ("ticker", "abc"), ("cik", "07"), ("ein", "55"), ("ein", "66"), ("ein", "99"), ("cik", "8"), ("ticker", "zzz"), ("other", "1"), ("ein", None), ("ticker", "ABC")]
    rows = spark.createDataFrame(wanted, "kind string, key string")
    noted = {}

    def noting(path):
        with open(f"{path}.read", "a") as f:
            f.write("x")
        return open(path, "rb")

    service.opener = noting
    found, rejects = service.facts_for(rows)
    assert sorted((r["kind"], r["key"], r["id"]) for r in found.collect()) == [("cik", "07", "7"), ("ein", "55", "55"), ("ticker", "ABC", "7"), ("ticker", "abc", "7")]
    reasons = {(r["kind"], r["key"]): r["reason"] for r in rejects.collect()}
    assert len(reasons) == 6 and reasons["ein", "66"] == "no return: no such member" and reasons["ein", "99"] == "no supported return" and reasons["cik", "8"] == "no supported filing" and reasons["ticker", "zzz"] == "no ticker zzz"
    for path in (f"{service.documents}/7/0001242/d.htm", f"{service.submissions}/CIK0000000007.json"):
        assert open(f"{path}.read").read() == "x"  # once, for all identifiers and passes
    again, rejects = service.facts_for(rows)
    assert sorted(r["updated_at"] for r in again.collect()) == sorted(r["updated_at"] for r in found.collect()) and rejects.count() == 6
    assert open(f"{service.documents}/7/0001242/d.htm.read").read() == "x" and len(service.kept.versions("facts")) == 1 and not noted


def test_many_identifiers_at_once(service, spark):
    found, rejects = service.facts_for(spark.range(10_000).select(F.when(F.col("id") % 2 == 0, "cik").otherwise("ein").alias("kind"), F.col("id").cast("string").alias("key")))
    assert sorted(r["id"] for r in found.select("id").collect()) == ["55"] and rejects.count() == 9999  # 7 is odd, and so asked for as an EIN


def test_report_of_a_filing(service):
    found = report.whole_report(service.facts_for_cik("7").withColumns({"employees_count": F.lit(2000), "ceo_pay_ratio": F.struct(F.lit("t").alias("text"), F.lit(300.0).alias("ceo"), F.lit(100.0).alias("median"))}))
    rows = [tuple(r)[1:] for r in found.orderBy("section_ord", "ord").collect()]
    assert [r[0] for r in rows] == ["Heading", "Number of employees", "CEO Pay Ratio", "CEO Pay Ratio", "CEO Pay Ratio", "Net Profit or Loss", "Executive Compensation"]
    assert rows[0][4] == "Abc Corp (ABC)" and rows[1][4] == "2,000" and rows[5][3:5] == ("2023-01-01 thru 2023-12-31", "$15,000,000") and "($7,500/employee)" in rows[5][5]
    assert [r[4:] for r in rows[2:5]] == [("$100", "33%"), ("$300", "100%"), ("3", "")]


def test_requests_keep_to_the_rate(spark):
    now = [0.0]
    bucket = fetch.Bucket(2.0, 3.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    at = []
    for _ in range(7):
        bucket.take()
        at.append(now[0])
    assert at == [0.0, 0.0, 0.0, 0.5, 1.0, 1.5, 2.0]
    now[0] += 100
    for _ in range(4):
        bucket.take()
    assert now[0] == 102.5  # no more than the burst is saved up

    def get(url, timeout):
        if url == "bad":
            raise TimeoutError(f"{timeout}")
        return url.encode()

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("a",)], "u string")
    found = fetch.fetched(rows, F.col("u"), get, rate=1000.0, tasks=2).collect()
    assert sorted((r["url"] or "", bytes(r["content"] or b""), r["error"]) for r in found if r["error"] is None) == [("a", b"a", None)] * 2
    assert {r["url"]: r["error"] for r in found if r["error"]} == {"bad": "TimeoutError: 30.0", None: "ValueError: no url"}
    assert fetch.fetched(rows.limit(0), F.col("u"), get).count() == 0
    with pytest.raises(ValueError, match="rate"):
        fetch.Bucket(0, 1)


def test_return_index_needs_its_columns(spark, tmp_path):
    (tmp_path / "i.csv").write_text("EIN,RETURN_TYPE\n1,990\n")
    with pytest.raises(ValueError, match="RETURN_ID"):
        readers.return_index(spark, f"{tmp_path}/i.csv")


def test_order_of_rows_over_files(spark, tmp_path):
    head = "RETURN_ID,EIN,TAXPAYER_NAME,RETURN_TYPE,XML_BATCH_ID,OBJECT_ID\n"
    (tmp_path / "b.csv").write_text(head + "".join(f"b{i},{i % 50},{'n' * 60},990,x,o\n" for i in range(3000)))
    (tmp_path / "a.csv").write_text(head + "a0,7,n,990T,x,o\na1,7,n,990,x,o\n")  # smaller, so it is dealt out later
    (tmp_path / "c.csv").write_text(head + "c0,7,n,990,x,o\nc1,777,n,990EZ,x,o\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many parts of a file
        index = readers.return_index(spark, str(tmp_path))
        assert index.rdd.getNumPartitions() > 5
        want = ["a0", "a1", *(f"b{i}" for i in range(3000)), "c0", "c1"]
        assert [r["RETURN_ID"] for r in index.orderBy("row_ord").collect()] == want
        assert filings.first_return(index, "7").first()["RETURN_ID"] == "a1" and filings.first_return(index, "777").first()["RETURN_ID"] == "c1"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_facts_of_one_parse_equal_the_relational_ones(spark):
    odd = FILING.replace("</body>", '<xbrli:context id="a"><xbrli:segment><xbrldi:explicitMember dimension="d">m</xbrldi:explicitMember><xbrldi:typedMember dimension="t">u</xbrldi:typedMember></xbrli:segment><xbrli:instant>2020-02-02</xbrli:instant></xbrli:context><ix:nonNumeric contextRef="no" name="n">x<b>y</b>z</ix:nonNumeric><ix:fraction id="q"></ix:fraction></body>')
    docs = spark.createDataFrame([(1, FILING), (2, odd), (3, None), (4, "<p>no facts")], "k int, h string")
    nodes = html.parse_html(docs, ["k"], "h")
    two = ixbrl.with_context(ixbrl.facts(nodes, ["k"]), ixbrl.contexts(nodes, ["k"]), ["k"])
    one = ixbrl.parsed_facts(docs, ["k"], "h")
    assert sorted(one.select(two.columns).collect(), key=lambda r: (r["k"], r["node_id"])) == sorted(two.collect(), key=lambda r: (r["k"], r["node_id"])) and one.count() == 4
    assert sec.metrics(one, ["k"]).count() == 2


def test_units_and_places_of_many_siblings(spark):
    unit = "<xbrli:unit id='u'><xbrli:measure>a</xbrli:measure><xbrli:measure>b</xbrli:measure></xbrli:unit>"
    nodes = html.parse_html(spark.createDataFrame([(1, unit + "<ul>" + "<li>x</li>" * 70 + "</ul>")], "k int, h string"), ["k"], "h")
    assert [r["measures"] for r in ixbrl.units(nodes, ["k"]).collect()] == [["a", "b"]]
    assert [r["sib"] for r in nodes.where("tag = 'li'").orderBy("node_id").collect()] == list(range(70))


def test_filings_replace_one_after_the_other(spark):
    schema = "accession_number string, cik string, form_name string, n int"
    old = spark.createDataFrame([("a9", "k", "1", 0), ("a8", "k", "8", 0)], schema)
    new = spark.createDataFrame([("a1", "k", "1", 1), ("a2", "k", "1", 2), ("a2", "k", "2", 3), ("a2", "k", "2", 3)], schema)
    assert sorted((r["accession_number"], r["n"]) for r in store.filings_upsert(old, new, F.col("n")).collect()) == [("a2", 3), ("a8", 0)]


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    item = lambda t: spark.createDataFrame([(t, "/p", "SEC")], "title string, path string, source_type string")
    with pytest.raises(LookupError):
        s.get("facts", "1")
    for t in "aab":
        s.append("search_cache", item(t))
    assert sorted(r["title"] for r in s.read("search_cache").collect()) == ["a", "a", "b"] and len(s.versions("search_cache")) == 3
    assert s.read("search_cache", s.versions("search_cache")[0]).count() == 1  # a version that readers have is not changed
    s.clear("search_cache")
    assert s.read("search_cache").count() == 0
    base = s.versions("search_cache")[-1]
    s.write("search_cache", item("x"), base)
    with pytest.raises(RuntimeError, match="another writer"):
        s.write("search_cache", item("y"), base)  # made from a version that is no longer the last
    assert [r["title"] for r in s.read("search_cache").collect()] == ["x"]
    f = spark.createDataFrame([("a1", "7", "10-K", "d.htm")], "accession_number string, cik string, form_name string, primary_document string")
    s.store("filings", f)
    assert s.get_filing("7", "10-K").first()["primary_document"] == "d.htm"
    with pytest.raises(LookupError):
        s.get_filing("7", "10-Q")
    assert [r["ein"] for r in store.eins(spark.createDataFrame([("2",), ("1",), ("2",)], "ein string")).collect()] == ["1", "2"]


def cells(s, table, name=None):
    version = s._load(table, name or s.versions(table)[-1])
    return {c: tuple(p) for c, p in version["buckets"].items()}


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), 64)
    rows = lambda ids, v: spark.createDataFrame([(str(i), v) for i in ids], "id string, v int")
    s.store("facts", rows(range(3000), 0))
    before = cells(s, "facts")
    assert len(before) == 64
    s.store("facts", rows([5, 5, 9999], 1))
    after = cells(s, "facts")
    assert sum(after[c] != before[c] for c in before) <= 2
    assert s.read("facts").groupBy("v").count().orderBy("v").collect() == [(0, 2999), (1, 2)] and s.get("facts", "5").first()["v"] == 1
    assert s.read("facts", s.versions("facts")[0]).where("v = 1").count() == 0
    assert sorted(r["id"] for r in s.matching("facts", rows([7, 12345], 0)).collect()) == ["7"]
    assert len(s._lookup("facts", 0, ["5"]).inputFiles()) <= 2 < len(s.read("facts").inputFiles())
    s.rebucket("facts", 8)
    assert len(cells(s, "facts")) == 8 and s.read("facts").count() == 3001 and s.get("facts", "9999").count() == 1
    s.vacuum("facts", 1)
    assert len(s.versions("facts")) == 1 and s.read("facts").count() == 3001 and len(s._list("facts", "data")) == 1
    with pytest.raises(LookupError):
        s.get("facts", "none")


def test_filings_in_a_square_of_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), 8)
    rows = lambda *r: spark.createDataFrame(list(r), "accession_number string, cik string, form_name string, at int")
    s.store("filings", rows(*[(f"a{i}", f"c{i}", "10-K", 0) for i in range(400)]))
    before = cells(s, "filings")
    s.store("filings", rows(("new", "c7", "10-K", 1), ("a9", "other", "10-K", 1)))
    after = cells(s, "filings")
    assert sum(after.get(c) != before[c] for c in before) <= 28 < len(before) == 64
    got = {r["accession_number"]: (r["cik"], r["at"]) for r in s.read("filings").collect()}
    assert len(got) == 400 and got["new"] == ("c7", 1) and "a7" not in got and got["a9"] == ("other", 1)
    assert s.get_filing("c7", "10-K").first()["accession_number"] == "new" and s.get("filings", "a8").count() == 1


def test_tables_with_fixed_columns(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    for table in store.SCHEMAS:
        s.create(table)
        s.create(table)
        assert len(s.versions(table)) == 1 and s.read(table).count() == 0 and set(sum(store.TABLES[table], [])) <= set(s.read(table).columns)
    s.store("irs_returns", spark.createDataFrame([("1", "990", 2024)], "ein string, return_type string, tax_year long"))
    assert [(r["ein"], r["tax_year"], r["xml"]) for r in s.read("irs_returns").collect()] == [("1", 2024, None)]
    s.append("search_cache", spark.createDataFrame([("t", "/p")], "title string, path string"))
    assert s.read("search_cache").first()["source_type"] is None
    s.store("facts", spark.createDataFrame([("9", "SEC", {"text": "t", "ceo": 1.0})], "id string, source_type string, ceo_pay_ratio struct<text:string,ceo:double>"))
    assert s.get("facts", "9").first()["ceo_pay_ratio"]["median"] is None
    with pytest.raises(ValueError, match="no such columns: note"):
        s.append("search_cache", spark.createDataFrame([("t", "x")], "title string, note string"))


def test_batches_that_come_again_add_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    item = lambda t: spark.createDataFrame([(t, "/p", "SEC")], "title string, path string, source_type string")
    for t, number in (("a", 0), ("a", 0), ("b", 1), ("a", 0), ("b", 1)):
        s.append("search_cache", item(t), ("x", number))
    s.append("search_cache", item("c"), ("y", 0))
    assert sorted(r["title"] for r in s.read("search_cache").collect()) == ["a", "b", "c"] and len(s.versions("search_cache")) == 3
    with open(f"{tmp_path}/search_cache/v000000003.json", "w") as f:
        f.write('{"n": 1, "buck')  # a writer that has not finished, or died
    assert s.read("search_cache").count() == 3
    with pytest.raises(RuntimeError, match="another writer"):
        s.append("search_cache", item("d"))


def test_landing_appends_once(spark, tmp_path):
    schema = "title string, path string, source_type string"
    s = store.Store(spark, f"{tmp_path}/kept")
    for t in "abc":
        spark.createDataFrame([(t, "/p", "SEC")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        landing.land(spark, f"{tmp_path}/in", schema, s, "search_cache", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["title"] for r in s.read("search_cache").collect()) == ["a", "b", "c"]
    import os

    for name in [n for n in os.listdir(f"{tmp_path}/cp/commits") if n.lstrip(".").startswith("2")]:  # as if the stream died before it noted the last batch
        os.remove(f"{tmp_path}/cp/commits/{name}")
    landing.land(spark, f"{tmp_path}/in", schema, s, "search_cache", f"{tmp_path}/cp").awaitTermination()
    assert s.read("search_cache").count() == 3


def test_landing(spark, tmp_path):
    schema = "id string, source_type string, updated_at timestamp"
    rows = lambda d: spark.sql(f"select '1' as id, 'SEC' as source_type, timestamp '{d} 00:00:00' as updated_at")
    s = store.Store(spark, f"{tmp_path}/kept")
    for day in ("2024-01-02", "2024-01-01", "2024-01-03"):
        rows(day).write.mode("append").parquet(f"{tmp_path}/in")
        landing.land(spark, f"{tmp_path}/in", schema, s, "facts", f"{tmp_path}/cp").awaitTermination()
    assert [str(r["updated_at"])[:10] for r in s.read("facts").collect()] == ["2024-01-03"]
