import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerine import schemas
from ledgerine.functions import formatting, numbers
from ledgerine.operators import filings, order, search, store
from ledgerine.plans import irs
from ledgerine.sources import catalogue, readers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("content", "scale", "expected"), [("27,163", "3", 27163000.0), ("105,056", "3", 105056000.0), ("—", "3", 0.0), (" 12 ", "", 0.0), ("12d", "", 0.0), ("", "", 0.0), ("5", "-3", 0.005), ("5", "x", 5.0)])
def test_scaled_number(spark, content, scale, expected):
    assert value(spark, numbers.scaled_number(F.lit(content), F.lit(scale))) == pytest.approx(expected)


def test_year_before(spark):
    assert tuple(value(spark, numbers.year_before(F.lit("2025-01-01")))) == ("2024-01-02", "2024-12-31")
    assert tuple(value(spark, numbers.year_before(F.lit("soon")))) == ("", "")


def test_headcount_quirks(spark):
    texts = ["December 31, 2024 we had 5000 employees", "December 31, 2024, we had 5000 employees", "In December we had 2024 employees", "we had 5,000 employees"]
    assert [value(spark, numbers.only_number(numbers.headcount(F.lit(t)))) for t in texts] == [31, 2024, 0, 0]
    assert value(spark, numbers.only_number(numbers.headcount(F.lit(texts[0]), robust=True))) == 0


def test_one_amount_is_no_ratio(spark):
    assert tuple(value(spark, numbers.pay_ratio(F.lit("only $5"))))[1:] == (0.0, 0.0)


def test_first_form_takes_amendments(spark):
    rows = spark.createDataFrame([("1", 0, "10-K/A"), ("1", 1, "10-K")], "cik string, pos int, form string")
    assert filings.first_per_form(rows).first()["form"] == "10-K/A"
    assert filings.first_per_form(rows, exact=True).first()["form"] == "10-K"


def test_staleness_is_strict(spark):
    now = dt.datetime(2024, 6, 1)
    table = spark.createDataFrame([("a", now - dt.timedelta(days=30)), ("b", now - dt.timedelta(days=30, seconds=1)), ("d", None)], "id string, updated_at timestamp")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert {r["id"]: r["stale"] for r in store.stale(ids, table, "id", F.lit(now)).collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_facts_need_an_id(spark):
    rows = spark.createDataFrame([("", "", "x")], "cik string, ein string, company_name string")
    assert store.facts_rows(rows, strict=False).count() == 0
    with pytest.raises(Exception, match="CIK or an EIN"):
        store.facts_rows(rows).collect()


def test_store_replaces_on_both_keys(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "accession_number string, cik string, form_name string, at int")
    s.store("filings", rows(("a1", "1", "10-K", 1), ("a2", "2", "10-K", 1)), F.col("at"))
    s.store("filings", rows(("a3", "1", "10-K", 2), ("a3", "1", "10-K", 3)), F.col("at"))
    assert sorted((r["accession_number"], r["at"]) for r in s.read("filings").collect()) == [("a2", 1), ("a3", 3)]
    assert s.get("filings", "a2").count() == 1


def test_returns(spark):
    body = "<IRS990><TotalEmployeeCnt>250</TotalEmployeeCnt><CYTotalRevenueAmt>5000000</CYTotalRevenueAmt><CYTotalExpensesAmt>4500000</CYTotalExpensesAmt><NetAssetsOrFundBalancesEOYAmt>1200000</NetAssetsOrFundBalancesEOYAmt></IRS990>"
    make = lambda kind, b: f'<Return returnVersion="1"><ReturnHeader><ReturnTypeCd>{kind}</ReturnTypeCd><TaxPeriodBeginDt>2024-01-01</TaxPeriodBeginDt><Filer><BusinessName><BusinessNameLine1Txt>N</BusinessNameLine1Txt></BusinessName></Filer></ReturnHeader><ReturnData>{b}</ReturnData></Return>'
    xml = spark.createDataFrame([("1", make("990", body)), ("2", make("990", "<X/>")), ("3", make("1040", body)), ("4", None), ("5", "no xml")], "ein string, xml string")
    found = irs.facts(xml).collect()
    assert [(r["ein"], r["company_name"], r["employees_count"], r["net_income_loss"][0]["content"]) for r in found] == [("1", "N", 250, "500000")]
    assert len(found[0]["worker_pay"]) == 2
    errors = {r["ein"]: r["error"] for r in readers.parsed_returns(xml).collect()}
    assert errors["2"] == "missing body" and errors["3"] == "unsupported return type" and errors["4"] == "corrupt"
    with pytest.raises(Exception, match="missing body"):
        irs.facts(xml.where("ein = '2'"), strict=True).collect()


def test_fields_of_a_return():
    more = schemas.return_schema(["IRS990ScheduleB.X[].Y.Z bigint", "IRS990ScheduleB.X[].A string", "IRS990.TotalEmployeeCnt bigint"])
    assert "`IRS990ScheduleB`:struct<`X`:array<struct<`Y`:struct<`Z`:bigint>,`A`:string>>>" in more and more.count("TotalEmployeeCnt") == 1
    for wrong in ("IRS990 string", "IRS990.TotalEmployeeCnt string", "IRS990.Form990PartVIISectionAGrp.PersonNm string", "A.B", "A..B string"):
        with pytest.raises(ValueError):
            schemas.return_schema([wrong])


def test_catalogue_of_returns(spark):
    one = '<Return xmlns="urn:x"><ReturnHeader><ReturnTypeCd>990</ReturnTypeCd><Filer><EIN>012</EIN></Filer></ReturnHeader><ReturnData><IRS990><TotalEmployeeCnt>3</TotalEmployeeCnt><A>1</A></IRS990><IRS990ScheduleH documentId="d"><CostPct>1.5</CostPct><P><Nm>x</Nm><Amt>7</Amt></P><P><Nm>y</Nm><Amt>8</Amt></P></IRS990ScheduleH></ReturnData></Return>'
    two = "<Return><ReturnHeader/><ReturnData><IRS990><A>z</A></IRS990><IRS990ScheduleH><CostPct>2</CostPct><P><Amt/></P></IRS990ScheduleH></ReturnData></Return>"
    rows = spark.createDataFrame([(one,), (two,), (None,), ("<no",)], "xml string")
    found = {r["path"]: (r["returns"], r["values"], r["repeated"], r["kind"]) for r in catalogue.catalogue(rows).collect()}
    assert found["ReturnData.IRS990ScheduleH.P.Amt"] == (2, 3, False, "bigint") and found["ReturnData.IRS990ScheduleH.P"] == (2, 3, True, None)
    assert found["ReturnData.IRS990.A"][3] == "string" and found["ReturnHeader.Filer.EIN"][3] == "string" and found["ReturnData.IRS990ScheduleH.CostPct"][3] == "double"
    known = catalogue.Catalogue(catalogue.catalogue(rows).collect())
    assert known.resolve("IRS990ScheduleH.P.*", "IRS990ScheduleH._documentId") == ["IRS990ScheduleH.P[].Amt bigint", "IRS990ScheduleH.P[].Nm string", "IRS990ScheduleH._documentId string"]
    assert known.resolve("**.*Pct", "ReturnHeader.Filer.E*") == ["IRS990ScheduleH.CostPct double", "ReturnHeader.Filer.EIN string"]
    for wrong in ("IRS990ScheduleH.P.Amount", "IRS990ScheduleX.**", "IRS990ScheduleH.P", "ReturnHeader.Nothing"):
        with pytest.raises(ValueError, match="no return has"):
            known.resolve(wrong)
    with pytest.raises(ValueError, match=r"near are .*ScheduleH\.P\.Amt"):
        known.resolve("IRS990ScheduleH.P.Amnt")
    parsed = readers.parsed_returns(rows, "xml", known.schema("IRS990ScheduleH.**")).where("error is null").collect()
    assert [[(p["Nm"], p["Amt"]) for p in r["return"]["ReturnData"]["IRS990ScheduleH"]["P"]] for r in parsed] == [[("x", 7), ("y", 8)]]
    assert catalogue.catalogue(rows.limit(0)).count() == 0


def test_stored_index(spark, tmp_path):
    words = ["york", "yorkshire", "new", "newark", "times", "times", "org", "\u017du\u0165", "\u6f22\u5b57", "a", "ab", "abc"]
    corpus = spark.createDataFrame([(f"{words[i % 12]} {words[i * 7 % 11]} {words[i % 5]}", f"/ein/{i}", "IRS") for i in range(300)], "title string, path string, source_type string")
    index = search.Index(store.Store(spark, str(tmp_path)))
    assert index.search("york").count() == 0
    for lo in (0, 100, 100, 200):
        index.add(corpus.where(F.substring("path", 6, 9).cast("int").between(lo, lo + 99)), ("x", lo))
    rows, size = search.postings(corpus), search.size_of(corpus)
    for q in ("york", "new y", "times newar", "\u017dut", "\u6f22", "a", "ab", "org zzz", "ein 7", "", "y", "IRS t"):
        plain = lambda found: [(r["path"], round(r["score"], 9)) for r in found.collect()]
        assert plain(index.search(q, 50)) == plain(search.search(rows, size, q, 50)), q
    read = index.postings_of(["times", "york"])
    assert {r["t"][:2] for r in read.select(F.col("term").alias("t")).distinct().collect()} == {"ti", "yo"}
    every = {p.rsplit("/", 2)[1] for p in index.store.read("postings").inputFiles()}
    assert len({p.rsplit("/", 2)[1] for p in read.inputFiles()}) == 2 < len(every)
    index.clear()
    assert index.search("york").count() == 0


def test_words_of_a_query(spark):
    texts = ["New York", "Caf\u00e9-Yorkshire 12", "Cafe\u0301 Vi\u1ec7t", "\u0141\u00d3D\u0179", "a.b_c", " \u00a0\u6f22\u5b57 ", "", "\u1f08\u03b8\u1fc6\u03bd\u03b1\u03b9", "x\u00b2 \u0664"]
    found = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(search.tokens(F.col("s")).alias("t")).collect()]
    assert [search.query_words(t) for t in texts] == found


def test_places_of_sorted_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(6)
    assert [r["place"] for r in order.placed(rows.orderBy("v")).orderBy("v").collect()] == list(range(1000))
    assert order.placed(rows.limit(0)).count() == 0


def test_search(spark):
    corpus = spark.createDataFrame([("New York Times", "/ticker/NYT", "SEC"), ("York New", "/ticker/YN", "SEC"), ("Café Yorkshire New", "/ein/1", "IRS"), ("Other", "/ein/2", "IRS")], "title string, path string, source_type string")
    find = lambda q, k=None: [r["path"] for r in search.search(search.postings(corpus), search.size_of(corpus), q, k).collect()]
    assert set(find("new york")) == {"/ticker/NYT", "/ticker/YN", "/ein/1"}
    more = spark.createDataFrame([("Žluťoučký Ἀθῆναι", "/a", "IRS"), ("Cafe\u0301 Việt", "/b", "IRS"), ("ŁÓDŹ", "/c", "SEC")], "title string, path string, source_type string")
    assert [r["t"] for r in more.select(search.tokens(F.col("title")).alias("t")).collect()] == [["zlutoucky", "αθηναι"], ["cafe", "viet"], ["łodz"]]
    assert find("cafe") == ["/ein/1"] and find("  ") == [] and find("york zzz") == []
    assert [search.limit_of(x) for x in (None, "0", "51", "x", "7")] == [10, 10, 10, 10, 7]


def test_large_numbers_keep_all_digits(spark):
    rows = spark.createDataFrame([(9_007_199_254_740_993, 1), (12_345_678_901_234_567, 3), (5, 2)], "a bigint, b int")
    found = rows.select(formatting.count_text(F.col("a")), formatting.quotient(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in found] == [("9,007,199,254,740,993", "9007199254740992"), ("12,345,678,901,234,567", str(round(12_345_678_901_234_567 / 3))), ("5", "2")]


def test_a_return_is_parsed_once(spark):
    from ledgerine.sources.readers import parsed_returns

    plan = parsed_returns(spark.createDataFrame([("<Return/>",)], "xml string")).where("error is null").select("return.ReturnHeader", "return_type")
    assert plan._jdf.queryExecution().executedPlan().toString().count("from_xml(") == 1


def test_unknown_numbers_and_signs_of_zero(spark, tmp_path):
    """What the SQL of the query gives: null stays null unless the divisor is 0, and a quotient has no signed zero."""
    from ledgerine.plans import queries

    rows = [(1, 0, -0.0), (2, None, -0.4), (None, 3, None), (None, 0, -0.6), (-1, 4, 0.5), (0, -5, -1234.5), (1, -2, -0.5), (-7, 2, 0.0), (900_000, 24, 9999.5)]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries.format_currency(spark, str(tmp_path)).collect()
    want = [(1, "$0", "1,000", "N/A"), (2, "$-0", "2,000", None), (None, None, None, None), (None, "$-1", None, "N/A"), (-1, "$0", "-1,000", "0"), (0, "$-1,234", "0", "0"), (1, "$-0", "1,000", "0"), (-7, "$0", "-7,000", "-4"), (900_000, "$10,000", "900,000,000", "37500")]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
