import datetime

import pytest
from pyspark.sql import functions as F

from vulnloom.functions import dates, ids, levels, names, pages, severity, versions

T = U = None


@pytest.fixture(autouse=True)
def columns(spark):
    global T, U
    T, U = F.col("t"), F.col("u")


@pytest.mark.parametrize("text, expected", [
    ("cve-2024-1234 CVE-2024-1234", ["CVE-2024-1234"]), ("CVE-24-1234", []), ("CVE-2024-12", []),
    ("CVE-2024-9999 CVE-2024-1111 CVE-2024-5555", ["CVE-2024-1111", "CVE-2024-5555", "CVE-2024-9999"]),
    ("CVE-2024-1234567", ["CVE-2024-1234567"]), ("CVE-2024-12345678", ["CVE-2024-1234567"])])
def test_sorted_ids(one, text, expected):
    assert one(ids.cve_ids_sorted(T), t=text) == expected


def test_ids_of_null_and_order(one, spark):
    assert one(ids.cve_ids_sorted(F.lit(None).cast("string"))) == []
    assert one(ids.cve_ids_in_order(T), t="CVE-2024-9 CVE-2024-7562  cve-2024-7562 CVE-2024-1111") == ["CVE-2024-7562", "CVE-2024-1111"]
    assert one(ids.is_cve_id(T), t="CVE-2024-1234  CVE-2024-5678") is False


@pytest.mark.parametrize("url, expected", [
    ("x/000227419/dsa-2024-293-security-update", "DSA-2024-293"), ("x/dsa_2025_100", "DSA-2025-100"),
    ("x/000189608", "KB-000189608"), ("x", "")])
def test_advisory_id(one, url, expected):
    assert one(ids.advisory_id_from_url(T), t=url) == expected


@pytest.mark.parametrize("text, expected", [
    ("2024-01-02 03:04:05", (2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05Z", (2024, 1, 2, 3, 4, 5)), ("2024-01-02", (2024, 1, 2)),
    ("15 January 2024", (2024, 1, 15)), ("January 15, 2024", (2024, 1, 15)), ("2024-01-02T03:04:05+09:00", (2024, 1, 2, 3, 4, 5))])
def test_parse_date(one, text, expected):
    assert one(dates.parse_date(T), t=text) == datetime.datetime(*expected)


def test_dates(one):
    assert one(dates.parse_date(T), t="soon") is None
    assert one(dates.parse_vendor_date(T), t="OCT 29 2025") == datetime.datetime(2025, 10, 29)
    assert one(dates.parse_vendor_date(T), t="bad") is None
    days = lambda a, b: one(dates.elapsed_days(dates.as_ntz(a), dates.as_ntz(b)))
    assert days("2026-05-01 00:00:00", "2026-05-13 00:00:00") == 12
    assert days("2024-02-28 23:59:59", "2024-03-01 00:00:00") == 1
    assert days("2024-03-01 00:00:01", "2024-03-01 00:00:00") == -1
    assert one(dates.bucket_30d(dates.as_ntz("2024-03-02"), dates.as_ntz("2024-03-01"))) == -1


@pytest.mark.parametrize("page, expected", [
    ("Revision History\n1.0  06 Nov 2024  Initial Release\n2.0 2025-01-01", (2024, 11, 6)),
    ("Original Release Date: November 6, 2024", (2024, 11, 6)), ("Last Modified: 11/06/2024", (2024, 11, 6)),
    ("text March 5, 2023 more", (2023, 3, 5)), ("nothing", (2022, 1, 1))])
def test_published_date(one, page, expected):
    assert one(dates.published_date(T, U), t=page, u="DSA-2022-5") == datetime.date(*expected)


@pytest.mark.parametrize("title, expected", [
    ("Security Update for Dell PowerScale OneFS Multiple Vulnerabilities", ["Dell PowerScale OneFS"]),
    ("DSA-2024-1: Security Update for Dell iDRAC and BIOS for Multiple Vulnerabilities", ["Dell iDRAC", "BIOS"]), ("Some random text", []),
    ("Dell EMC Unity Improper Access", ["Dell EMC Unity"])])
def test_title_products(one, title, expected):
    assert one(names.products_from_title(T), t=title) == expected


def test_names(one):
    assert one(names.normalize_name(T), t="  Dell  PowerStore  ") == "Dell PowerStore"
    assert one(names.normalize_name(T), t="Dell VxRail,") == "Dell VxRail"
    for bad in ("A", "NA", "Summary: some text", "x" * 151):
        assert one(names.is_invalid_title_name(T), t=bad) is True
    assert one(names.is_invalid_title_name(T), t="PowerEdge R740") is False
    assert one(names.recover_product(T, U), t="an IAM", u="Dell ECS Security Update for an IAM Vulnerability") == "Dell ECS"
    assert one(names.recover_product(T, U), t="an IAM", u="") is None


@pytest.mark.parametrize("name, expected", [
    ("Dell PowerMaxOS 5978.714.714", "Dell PowerMaxOS"), ("* Dell EMC VxRail Appliance 4.0.524", "Dell EMC VxRail Appliance"),
    ("Dell Foo 1.2.3a", "Dell Foo"), ("PowerStore 1000T", "PowerStore 1000T"), ("Foo 1.2.3 4.5.6", "Foo")])
def test_series_name(one, name, expected):
    assert one(names.series_name(T), t=name) == expected


def test_product_lines(one):
    lines = one(names.product_lines(T), t="Dell VNX and ECS Storage, iDRAC 9, SC 5020, ME 4024, Disk Library")
    assert lines == ["VNX/VNXe (主存储)", "SC / Compellent (主存储)", "ME (主存储)", "Centera / DLm (归档)", "OpenManage / iDRAC (管理)"]
    assert one(names.product_lines(T), t="CommUnity") == []
    assert one(names.resolve_line(T, U), t="Dell Wyse 5070", u="").startswith("Client")


@pytest.mark.parametrize("text, expected", [
    ("Impact: Critical", "Critical"), ("a High severity update", "High"), ("CVSS Base Score: 8.8", "High"), ("Impact\nLow", "Low"), ("", "Medium")])
def test_page_severity(one, text, expected):
    assert one(severity.page_severity(T, U), t=text, u='<p data-severity="Medium">' if not text else "") == expected


def test_versions(one):
    assert one(versions.split_entry(T), t="Dell ObjectScale prior to 4.1.0.3").asDict() == {
        "product": "Dell ObjectScale", "version": "4.1.0.3", "qualifier": "<"}
    assert one(versions.models(T), t="PowerEdge r740xd, iDRAC 9, precision, PowerScale F900 R740XD") == ["R740XD", "iDRAC9", "Precision", "F900"]
    got = [tuple(a) for a in one(versions.anchors(T, F.lit("BIOS")), t="1.2.3 to 2.3.4, prior to 3.4.5, 0.1.2 and earlier")]
    assert got == [(">=", "1.2.3"), ("<=", "2.3.4"), ("<", "3.4.5")]
    assert [tuple(a) for a in one(versions.anchors(T, F.lit("BIOS")), t="no version")] == [("", "unversioned")]
    assert one(versions.anchors(T, F.lit("Software")), t="no version") == []
    for kind, ok in (("BIOS", False), ("OS", True)):
        assert one(versions.is_valid_version(T, F.lit(kind)), t="9.5") is ok


@pytest.mark.parametrize("version, written, expected", [
    ("9.8.0.0", "prior to 9.9.0.0", True), ("9.9.0.0", "prior to 9.9.0.0", False), ("9.8", "9.8.0.0 and earlier", True),
    ("9.7.5.0", "9.7.0.0 through 9.8.0.0", True), ("10.0.0.0", "9.7.0.0 through 9.8.0.0", False), ("9.1", "<= 9.1.0", True), ("1.0", "unknown", False)])
def test_in_range(one, version, written, expected):
    assert one(versions.in_range(T, U), t=version, u=written) is expected


def test_remediation_table(one):
    html = ("<table><tr><th>Note</th></tr><tr><td>x</td></tr></table><table><tr><th>CVE</th><th>Product</th><th>Affected Versions</th>"
            "<th>Remediated Versions</th></tr><tr><td>1</td><td>Dell <b>Foo</b></td><td>before 1.2</td><td>1.2 &amp; up</td></tr><tr><td>2</td></tr></table>")
    assert [tuple(r) for r in one(pages.remediation_rows(T), t=html)] == [("Dell Foo", "before 1.2", "1.2 & up")]
    assert one(pages.remediation_rows(T), t="<p>none</p>") is None


def test_levels(one):
    assert [one(levels.score_level(F.lit(float(x)))) for x in (95, 80, 60, 30, 10)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    assert one(levels.normalize_score(F.lit(15.0), 0, 10)) == 100.0
    assert one(levels.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(levels.sparkline(F.array(F.lit(0), F.lit(1), F.lit(4)))) == "▁▂█"
    rate = lambda d: one(levels.at_least_one(F.lit(d / 90.0)))
    assert [round(rate(d), 3) for d in (30, 60, 90)] == [0.283, 0.487, 0.632]
