import datetime as dt
import json
import os
import random
import zipfile
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import HEADER, quote_line, values, write_zip

from quoteflow.operators.align import union_batches
from quoteflow.plans.snapshot import snapshot_bronze, snapshot_silver
from quoteflow.sources import archives, html, listing, nested, quotefiles, tables


def names(df):
    return sorted(r["file_name"] for r in df.collect())


def test_incremental_listing(spark, tmp_path):
    for name in ("q_20260901.zip", "q_20260903.ZIP", "q_20260902.txt", "plain.zip", "q_20261399.Zip"):
        (tmp_path / name).write_bytes(b"x")
    for name in ("plain.zip", "q_20261399.Zip"):
        stamp = dt.datetime(2026, 9, 2, 12, tzinfo=dt.timezone.utc).timestamp()
        os.utime(tmp_path / name, (stamp, stamp))
    found = listing.incremental_files(spark, str(tmp_path))
    assert {r["file_name"]: r["file_date"].day for r in found.collect()} == {
        "q_20260901.zip": 1, "q_20260903.ZIP": 3, "plain.zip": 2, "q_20261399.Zip": 2}
    assert names(listing.incremental_files(spark, str(tmp_path), dt.date(2026, 9, 2))) == ["q_20260903.ZIP"]
    again = listing.incremental_files(spark, str(tmp_path), dt.date(2026, 9, 2), [dt.date(2026, 9, 1)])
    assert names(again) == ["q_20260901.zip", "q_20260903.ZIP"]


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "q_20260901.zip").write_bytes(b"x")
    plan = listing.incremental_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("FileScan"):]


def test_zips_with_differing_headers(spark, tmp_path):
    write_zip(tmp_path / "a_20260901.zip",
              one__csv=HEADER + "\n" + quote_line("I1", "2026-09-01", "A", "EQ", 11, 10) + "\r\n\n",
              two__CSV=HEADER + "\n" + quote_line("I2", "2026-09-01", "B", "SM", 12, 10) + "\n",
              notes__txt="ISIN\nnot a quote\n", empty__csv="", bare__csv="BizDt,ISIN\n")
    write_zip(tmp_path / "b_20260902.zip", x__csv="﻿ISIN,New, BizDt\nI3,n,2026-09-02\n")
    out = quotefiles.read_zips(spark, [str(tmp_path / "a_20260901.zip"), str(tmp_path / "b_20260902.zip")])
    assert values(out, "ISIN", "BizDt", "FinInstrmNm", "New", "_source_file") == [
        ("I1", "2026-09-01", "A, Ltd", None, "a_20260901.zip"),
        ("I2", "2026-09-01", "B, Ltd", None, "a_20260901.zip"),
        ("I3", "2026-09-02", None, "n", "b_20260902.zip")]
    assert all(f.dataType == T.StringType() for f in out.schema)
    assert quotefiles.read_zips(spark, []) is None


def test_zip_with_more_lines_than_a_batch(spark, tmp_path):
    lines = "\n".join(f"I{n},{n}" for n in range(45_000))
    write_zip(tmp_path / "big.zip", q__csv="ISIN,N\n" + lines + "\n")
    out = quotefiles.read_zips(spark, [str(tmp_path / "big.zip")])
    assert out.selectExpr("count(*)", "sum(cast(N as bigint))").first() == (45_000, sum(range(45_000)))


def test_broken_zip_is_an_error(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"no zip")
    with pytest.raises(Exception, match="zip"):
        quotefiles.read_zips(spark, [str(tmp_path / "x.zip")])


def many_members(path, method, count=30):
    with zipfile.ZipFile(path, "w", method) as archive:
        for n in range(count):
            archive.writestr(f"m{n}.csv", "ISIN,N\n" + "".join(f"I{n},{k}\n" for k in range(n)))
        archive.writestr("readme.txt", "x" * 1000)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_members_are_found_by_the_directory_and_dealt_to_tasks(spark, tmp_path, method):
    many_members(tmp_path / "a b%20ü.zip", method)
    paths = listing.listed_files(spark, str(tmp_path)).select("path")
    found = archives.members(paths)
    assert found.count() == 30 and {r["method"] for r in found.collect()} == {method}
    lines = archives.member_lines(found, 30)
    assert lines.rdd.getNumPartitions() == 30
    per_task = lines.groupBy(F.spark_partition_id()).agg(F.countDistinct("member").alias("n")).collect()
    assert len(per_task) > 12
    got = quotefiles.read_zips(spark, paths)
    assert values(got.groupBy("ISIN").agg(F.count("*").alias("n")), "ISIN", "n") == sorted(((f"I{n}", n) for n in range(1, 30)), key=repr)
    assert {r["_source_file"] for r in got.select("_source_file").distinct().collect()} == {"a b%20ü.zip"}
    whole = quotefiles.read_zips(spark, [str(tmp_path / "a b%20ü.zip")], whole=True)
    assert values(whole, *whole.columns) == values(got, *whole.columns)


def test_a_directory_is_read_without_the_members(spark, tmp_path):
    """Members whose bytes are gone are found, and are an error when read."""
    many_members(tmp_path / "a.zip", zipfile.ZIP_DEFLATED)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as archive:
        info = archive.getinfo("m29.csv")
    at = info.header_offset + 30 + len("m29.csv")
    data[at : at + info.compress_size] = bytes(info.compress_size)
    (tmp_path / "a.zip").write_bytes(data)
    found = archives.members(spark.createDataFrame([(str(tmp_path / "a.zip"),)], "path string"))
    assert found.count() == 30
    assert archives.member_lines(found.filter("member != 'm29.csv'"), 3).count() == 29 + sum(range(29))
    with pytest.raises(Exception, match="zlib|damaged"):
        archives.member_lines(found.filter("member = 'm29.csv'"), 1).count()


def test_a_member_is_read_in_blocks_and_checked(spark, tmp_path):
    text = "ISIN,N\n" + "".join(f"I{n % 97},{'x' * 50}{n}\n" for n in range(60_000))
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(tmp_path / f"{method}.zip", "w", method) as archive:
            archive.writestr("one.csv", text)
    found = archives.members(listing.listed_files(spark, str(tmp_path)).select("path"))
    assert {r["size"] for r in found.collect()} == {len(text)}
    lines = archives.member_lines(found, 2).filter("line is not null")
    assert lines.count() == 120_000 and lines.groupBy("line").count().filter("count != 2").count() == 0
    wrong = found.withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="damaged"):
        archives.member_lines(wrong, 2).count()


def test_chosen_files(spark):
    stamp, later = dt.datetime(2026, 9, 1, 8), dt.datetime(2026, 9, 2, 8)
    files = spark.createDataFrame(
        [("a", "a", dt.date(2026, 9, 1), stamp), ("b", "b", dt.date(2026, 9, 1), stamp), ("c", "c", dt.date(2026, 9, 2), stamp), ("d", "d", dt.date(2026, 9, 3), stamp)],
        "path string, file_name string, file_date date, modificationTime timestamp")
    known = spark.createDataFrame([("a", stamp), ("a", stamp), ("b", later)], "path string, modificationTime timestamp")

    def outcomes(*args):
        return {r["path"]: r["outcome"] for r in listing.chosen_files(files, *args).collect()}

    assert set(outcomes(None, (), known).values()) == {"load"}
    assert outcomes(dt.date(2026, 9, 2), (), known) == {"a": "known", "b": "late", "c": "late", "d": "load"}
    assert outcomes(dt.date(2026, 9, 2), [dt.date(2026, 9, 1)], known) == {"a": "load", "b": "load", "c": "late", "d": "load"}
    assert [r["reason"] for r in listing.chosen_files(files, dt.date(2026, 9, 3)).filter("path = 'd'").collect()] == ["dated 2026-09-03, loaded up to 2026-09-03"]


def test_csvs_in_other_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" ISIN ,BizDt\nI1,2026-09-01\n")
    (tmp_path / "b.csv").write_text("BizDt,ISIN,Extra\n2026-09-02,I2,e\n")
    out = quotefiles.read_csvs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert values(out, "ISIN", "BizDt", "Extra", "_source_file") == [
        ("I1", "2026-09-01", None, "a.csv"), ("I2", "2026-09-02", "e", "b.csv")]


def test_csv_headers_behind_blank_lines_and_odd_names(spark, tmp_path):
    (tmp_path / "a b%20+ü.csv").write_text("\ufeffISIN,BizDt\nI1,2026-09-01\nISIN,BizDt\n")
    (tmp_path / "b.csv").write_text("\n  \nISIN,BizDt\nI2,2026-09-02\n")
    (tmp_path / "c.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("a b%20+ü.csv", "b.csv", "c.csv")]
    found = quotefiles._paths_by_header(spark, paths)
    assert [(h, sorted(p.rsplit("/", 1)[1] for p in group)) for h, group in found] == [("ISIN,BizDt", ["a b%20+ü.csv", "b.csv"])]
    out = quotefiles.read_csvs(spark, paths[:1])
    assert values(out, "ISIN", "BizDt") == [("I1", "2026-09-01"), ("ISIN", "BizDt")]


def test_payload_to_clean_snapshot(spark, tmp_path):
    record = {"symbol": "INFY", "lastPrice": 1.5, "change": 2, "series": "EQ", "tags": ["a", "b"],
              "meta": {"companyName": "Infosys", "isin": "IN1", "isFNOSec": True, "isCASec": False,
                       "slb": {"isin": "IN2"}, "quotepreopenstatus": {"equityTime": "x"}}}
    (tmp_path / "p.json").write_text(json.dumps({"name": "index", "data": [record, {**record, "symbol": "TCS"}]}, indent=1))
    raw = snapshot_bronze(nested.read_payloads(spark, str(tmp_path / "p.json")), "SYN")
    assert {"meta_slb_isin", "meta_quotepreopenstatus_equityTime", "tags", "source_system"} <= set(raw.columns)
    row = raw.first()
    assert row["tags"] == ["a", "b"] and row["pipeline_run_id"].endswith("_run01") and row["file_name"].endswith(".json")
    clean = snapshot_silver(raw)
    assert values(clean, "stock_name", "last_traded_price", "company_name", "ISIN", "ISIN_SLB", "is_FNO") == [
        ("INFY", 1.5, "Infosys", "IN1", "IN2", True), ("TCS", 1.5, "Infosys", "IN1", "IN2", True)]
    assert not {"change", "series", "meta_isCASec", "meta_quotepreopenstatus_equityTime"} & set(clean.columns)


def page(spark, html_text):
    return spark.createDataFrame([(1, html_text)], "page_id bigint, html string")


def cells(df):
    return [(r["headers"], r["cells"]) for r in df.orderBy("row_number").collect()]


def test_html_table_with_headers_and_body(spark):
    text = """<table class="other"><tr><td>no</td></tr></table>
      <TABLE id=x class="tb10x wide"><thead><tr><th> Company </th><th>Price</th></tr></thead>
      <tbody class="b"><tr><td> A &amp; <b>B</b>
      </td><td>1</td></tr><tr></tr><tr><td>C</td><td>2</td></tr></tbody></TABLE>
      <table class="tb10"><tr><td>second</td></tr></table>"""
    assert cells(html.html_table(page(spark, text))) == [
        (["Company", "Price"], ["A & B", "1"]), (["Company", "Price"], ["C", "2"])]


def test_html_table_without_headers_or_body(spark):
    text = "<table class='tb10'><tr><td>first</td><td>row</td></tr><tr><td>A</td><td>9</td></tr></table>"
    assert cells(html.html_table(page(spark, text))) == [(["Company", "Market Cap"], ["A", "9"])]
    assert html.html_table(page(spark, "<table class='x'><tr><td>1</td></tr></table>")).count() == 0
    assert html.html_table(page(spark, "<table class='tb10'></table>")).count() == 0


def test_html_items(spark):
    out = html.html_items(page(spark, "<ul><li class='a'> one </li><LI>t<i>w</i>o</LI></ul><link><li>3"))
    assert [(r["position"], r["text"]) for r in out.collect()] == [(0, "one"), (1, "two")]


# --- tables ---


def test_append_aligns_and_adds_columns(spark, database):
    table = f"{database('a')}.t"
    tables.append(spark.createDataFrame([("x", "1")], "d string, n string"), table, ["d"])
    tables.append(spark.createDataFrame([(2, "y", "new")], "n int, d string, extra string"), table, ["d"])
    assert values(spark.table(table), "d", "n", "extra") == [("x", "1", None), ("y", "2", "new")]


def test_ensure_table_keeps_what_is_there(spark, database):
    table = f"{database('e')}.t"
    schema = T.StructType([T.StructField("n", T.LongType())])
    assert not tables.table_exists(spark, table)
    tables.ensure_table(spark, table, schema)
    spark.range(3).toDF("n").write.insertInto(table)
    tables.ensure_table(spark, table, schema)
    assert spark.table(table).count() == 3


def test_overwrite_replaces_schema(spark, database):
    table = f"{database('o')}.t"
    tables.overwrite(spark.range(3), table)
    tables.overwrite(spark.createDataFrame([("x", 1)], "s string, p int"), table, ["p"])
    assert spark.table(table).columns == ["s", "p"] and spark.table(table).count() == 1


def test_publish_may_read_what_it_replaces(spark, database):
    table = f"{database('p')}.t"
    tables.publish(spark.range(3).toDF("n"), table)
    open_reader = spark.table(table)
    tables.publish(union_batches(spark.table(table), spark.range(10, 12).toDF("n")), table)
    assert spark.table(table).count() == 5 and open_reader.count() == 3
    tables.publish(spark.range(1).toDF("n"), table)
    held = [t.name for t in spark.catalog.listTables(table.split(".")[0]) if t.name.startswith("t__")]
    assert len(held) == 2 and spark.table(table).count() == 1


def test_parquet_partition_overwrite_is_dynamic(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet(spark.createDataFrame([("a", 1), ("b", 1)], "d string, n int"), path, ["d"])
    tables.write_parquet(spark.createDataFrame([("b", 2)], "d string, n int"), path, ["d"])
    assert values(spark.read.parquet(path), "d", "n") == [("a", 1), ("b", 2)]


def test_read_since_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(dt.date(2026, 9, d), d) for d in range(1, 5)]
    tables.write_parquet(spark.createDataFrame(rows, "business_date date, n int"), path, ["business_date"])
    recent = tables.read_since(spark.read.parquet(path), "business_date", dt.date(2026, 9, 2))
    assert sorted(r["n"] for r in recent.collect()) == [3, 4]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(business_date" in plan
    assert tables.read_since(spark.read.parquet(path), "business_date", None).count() == 4


# --- tables that nest ---


class PlainTables(HTMLParser):
    """Cells of all tables, by a stack of open ones."""

    def __init__(self, text):
        super().__init__()
        self.cells, self.stack, self.opened = {}, [], 0
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.opened += 1
            self.stack.append({"id": self.opened, "row": 0, "cell": 0, "open": False})
        elif self.stack and tag == "tr":
            self.stack[-1].update(row=self.stack[-1]["row"] + 1, cell=0, open=False)
        elif self.stack and tag in ("td", "th"):
            top = self.stack[-1]
            top.update(cell=top["cell"] + 1, open=True)
            if top["row"]:
                self.cells[(top["id"], len(self.stack), top["row"], top["cell"], tag == "th")] = ""

    def handle_endtag(self, tag):
        if self.stack and tag == "table":
            self.stack.pop()
        elif self.stack and tag in ("td", "th", "tr"):
            self.stack[-1]["open"] = False

    def handle_data(self, data):
        if self.stack and self.stack[-1]["open"] and self.stack[-1]["row"]:
            top = self.stack[-1]
            key = next(k for k in self.cells if k[0] == top["id"] and k[2:4] == (top["row"], top["cell"]))
            self.cells[key] += data


def nested_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["td", "td", "th"])
        inside = nested_page(rng, depth + 1) if depth < 3 and rng.random() < 0.4 else ""
        words = rng.choice(["a", " b &amp; ", "&#233;", "&#x1F600;", "&nosuch;", "<b>c</b>", "", "x &lt; y", "&copy;"])
        cell = f"<{kind} class='q'>{words}{inside}{rng.choice(['', ' z '])}</{kind}>"
        out.append(rng.choice(["<tr>", "</tr><TR >"]) + cell + rng.choice(["", "<td>more", "<td>more</td></tr>"]))
    return "<table>" + "".join(out) + rng.choice(["</table>", "</TABLE >", "</table><!-- </table> -->"])


def test_nested_tables_equal_a_parser_with_a_stack(spark):
    rng = random.Random(4)
    pages = [(i, "lead " + nested_page(rng) + rng.choice(["", " gap <p>", "</td>"]) + nested_page(rng) + rng.choice(["", "</table></table>" + nested_page(rng)])) for i in range(60)]
    pages += [(900, None), (901, ""), (902, "no table <td>x</td>"), (903, "<table><tr><td>open for ever"), (904, "<table>loose<td>no row</td></table>"),
              (905, "<table><script>'<table>'</script><tr><td>s<style><td></style></td></tr></table>"), (7, "<table><tr><td>same id</td></tr></table>")]
    found = html.html_tables(spark.createDataFrame(pages, "page_id bigint, html string"))
    assert found.columns == ["page_id", "table_number", "depth", "row_number", "cell_number", "header", "text"]
    expected = [(i, t, d, r, c, h, text.strip()) for i, page_text in pages[:-2] + pages[-1:] for (t, d, r, c, h), text in PlainTables(page_text or "").cells.items()]
    expected.append((905, 1, 1, 1, 1, False, "s"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def test_character_references(spark):
    texts = ["&#65;&#x42;&amp;&lt;", "&#0;&#xD800;&#99999999;", "&nbsp;|&unknown;&", "&&amp;;", "plain", None, "&#128512;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(html.unescaped(F.col("t"))).collect()]
    assert got == ["AB&<", "&#0;&#xD800;&#99999999;", "\u00a0|&unknown;&", "&&;", "plain", None, "\U0001F600"]
