import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import catalog, catalogue_workloads
from textloom.operators import cards, normalise, search, sync
from textloom.profile import GENERIC, LEGAL_AR
from textloom.schemas import LAW
from textloom.sources import catalogue, records

NAMES = [n for n, f in catalog.queries().items() if f.__module__ == catalogue_workloads.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_against_the_oracle(spark, data, name):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(x[c] for c in cols)) for x in df.collect())
    assert got == sorted(repr(tuple(v)) for v in con.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall())


def test_records_have_all_fields_in_any_script(spark):
    items = spark.createDataFrame([("12", "٣-٤-١٩٧٠", "ملغى", None), ("x", "", "", "Y"), (None, None, None, None)], "lawBookID string, lawDate string, lawFlag string, lawValid string")
    got = normalise.to_records(items, "https://a/", LEGAL_AR, repealed_flag="ملغى", repealed="ملغى").collect()
    assert len(got) == 1 and set(got[0].asDict()) == {f.split()[0] for f in LAW.split(", ")}
    r = got[0]
    assert (r.lawBookID, r.date_iso, r.status_label, r.pdf_url, r.lawNotes, r.full_text_len) == (12, "1970-04-03", "ملغى", None, "", 0)
    pages = spark.createDataFrame([(12, "body")], "lawBookID long, page string")
    assert [x.full_text for x in normalise.with_texts(items.where("lawFlag is not null"), pages, F.upper("page")).orderBy(F.col("lawBookID")).collect()] == ["BODY", ""]


def test_pages_follow_the_stated_total(spark, tmp_path):
    for k, n in enumerate((2, 2, 1)):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"totalCount": 5, "items": [{"lawBookID": 10 * k + i} for i in range(n)]}))
    spark.dataSource.register(catalogue.CatalogSource)
    got = spark.read.format("catalog_pages").option("pageSize", 2).option("template", str(tmp_path / "p{page}.json")).load()
    assert sorted(r.lawBookID for r in got.collect()) == [0, 1, 10, 11, 20]


def test_a_walk_ends_at_an_empty_page_and_an_empty_catalogue_is_none(spark):
    pages = spark.createDataFrame([(1, 10, 100, 10), (2, 10, 100, 0), (3, 10, 100, 10)], "page int, size int, total int, n int")
    assert [r.page for r in sync.walked(pages).orderBy("page").collect()] == [1, 2]
    assert [r.page for r in sync.walked(pages, 3).collect()] == [3] and sync.walked(pages.limit(0)).count() == 0


def test_watermark_never_goes_back(spark):
    rows = spark.createDataFrame([("5", "2001-01-01"), ("x", " "), ("30", None)], "lawBookID string, date_iso string")
    old = spark.createDataFrame([(40, "1999-01-01")], "watermark_id long, watermark_date string")
    assert tuple(sync.advanced(old, sync.watermark(rows)).first()) == (40, "2001-01-01")
    assert tuple(sync.watermark(rows.limit(0)).first()) == (None, None)


def test_state_and_backfill(spark, tmp_path):
    path = str(tmp_path / "state")
    assert records.load_state(spark, path) == {}
    for page in (3, 4):
        records.save_state(spark, {"last_page": page, "notes": "ا"}, path)
    assert records.load_state(spark, path) == {"last_page": 4, "notes": "ا"}
    table = str(tmp_path / "t")
    spark.range(3).write.parquet(table)
    records.backfill(spark, table, "twice", F.col("id") * 2)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(0, 0), (1, 2), (2, 4)]


def test_cards_keep_order_and_name_the_first_fault(spark):
    good = {"scope_summary": " s ", "subject_tags": ["b", "a", "b", " ", None, 3], "likely_questions": "one؟، two; one", "title": "own", "title_en": ""}
    raws = [json.dumps(good), "```\n" + json.dumps(good) + "\n```", json.dumps(good | {"subject_tags": {"a": 1}}), "[1]", "", None]
    rows = spark.createDataFrame([(i + 1, "" if i else "given", r) for i, r in enumerate(raws)] + [(0, "t", raws[0])], "law_book_id long, title string, raw string")
    got = cards.parse_cards(rows).collect()
    assert [r.error for r in got] == [None, None, "subject_tags", "no_object", "no_object", "no_object", "law_book_id"]
    assert (got[0].title, got[1].title, got[0].scope_summary, got[0].title_en) == ("given", "own", "s", None)
    assert got[1].subject_tags == ["b", "a", "3"] and got[1].likely_questions == ["one؟", "two", "one"]


def test_rows_stay_where_no_instrument_is_named(spark):
    rows = spark.createDataFrame([("a", 0, "Law labour"), ("a", 1, "Annex law labour"), ("a", 2, None), ("b", 0, "x"), ("c", 0, "x"), ("d", 0, "Law tax annex")], "qid string, pos int, title string")
    asked = spark.createDataFrame([("a", "what says law labour?"), ("b", "anything"), ("c", "law water?"), ("d", "law tax?")], "qid string, question string")
    keys = lambda hard: sorted((r.qid, r.place, r.pos) for r in search.prefer_titled(rows, asked, GENERIC, hard=hard).collect())
    assert keys(True) == [("a", 0, 0), ("b", 0, 0), ("d", 0, 0)] and keys(False) == [("a", 0, 0), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0)]


def test_marked_rows_and_gap_filling(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("b", 3, False)], "qid string, k int, m boolean")
    keys = lambda hard: sorted(r.k for r in search.prefer_marked(rows, F.col("m"), hard=hard).collect())
    assert keys(True) == [1] and keys(False) == [1, 3]
    have = spark.createDataFrame([("a", 7, 0), ("a", 8, 1)], "qid string, k int, pos int")
    extra = spark.createDataFrame([("a", 8, 0), ("a", 9, 1), ("b", 7, 0)], "qid string, k int, pos int")
    assert sorted((r.qid, r.pos, r.k) for r in search.not_yet(extra, have, ["qid", "k"]).collect()) == [("a", 0, 7), ("a", 1, 8), ("a", 2, 9), ("b", 0, 7)]
