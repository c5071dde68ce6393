import csv

import pytest
from pyspark.sql import functions as F

from tiersmith.functions import dates, nested, text
from tiersmith.operators import clean
from tiersmith.plans import catalogue as cat
from tiersmith.plans import cleaning
from tiersmith.sources import records, tables


def run(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string")
    return [r["r"] for r in df.orderBy("i").select(fn(F.col("a")).alias("r")).collect()]


def test_text(spark):
    assert run(spark, text.clean_text, "<p>a</p>\n b", "a\xa0\xa0b　", "nan", "<br>", None) == ["a b", "a b", None, "", None]
    amounts = run(spark, text.quantity, "Memory: 512 MB RAM", "2,5 gb ram", "memory 1048576 KB", "2 GB VRAM", "memory: 1,024 mb", "Memory:\xa04 GB")
    assert amounts[:4] == [0.5, 2.5, 1.0, None] and amounts[4] == pytest.approx(0.001) and amounts[5] == 4.0
    assert run(spark, text.to_number, "18+", "17.9", " 3 ", "1d", None) == [None, 17.9, 3.0, None, None]
    assert run(spark, clean.int_or_zero, "18+", "17.9", "-2.7", None) == [0, 17, -2, 0]
    assert run(spark, clean.unit_flag, "3", "-1", "1", "x") == [1, 0, 1, 0]
    flags = text.keyword_flags(F.lower("a"), cat.HARDWARE_PATTERNS)
    df = spark.createDataFrame([("AMD Athlon",), ("Ryzen 5",), (None,), ("RTX 3080 i5",)], "a string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in flags.items()]).collect()]
    assert got == [(0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (1, 0, 0, 1)]


def test_nested(spark):
    got = run(spark, nested.parse_dict, "{'windows': True, 'mac': False}", "{\"it's\": 1}", "{'a': 'x: True, y'}", "{broken", "[]", r"{'m': 'a\xa0b \'q\' True'}", None)
    assert got == [{"windows": "true", "mac": "false"}, {"it's": "1"}, {"a": "x: True, y"}, None, None, {"m": "a\xa0b 'q' True"}, None]
    assert run(spark, nested.descriptions, "[{'id': 1, 'description': 'Single player'}, {'id': 2}, 7]", "{}", None) == [["Single_player", ""], [], []]
    assert run(spark, nested.simple_list, "['A B ']", "A, B C,,", "'123'", "123", None, "[]", "1, 2", "007") == [["A_B"], ["A", "B_C"], [], [], [], [], [], ["007"]]
    assert run(spark, lambda c: nested.top_keys(nested.parse_dict(c, "double"), 2), "{'Z':5,'A':9,'M':5}", "[]") == [["A", "Z"], []]
    assert run(spark, nested.list_length, "[1, 2]", "[]", None, "[1,") == [2, 0, 0, 0]
    long = "[" + ", ".join(f"{{'id': {i}, 'description': 'True {i}'}}" for i in range(20000)) + "]"
    assert len(run(spark, nested.descriptions, long)[0]) == 20000


def test_dates(spark):
    got = run(spark, dates.parse_date, "1 Nov, 2000", "Nov 1, 2000", "Nov 2000", "Coming soon", "2019", "Q4 2019", "2020-05-06", None)
    assert [d and d.isoformat() for d in got] == ["2000-11-01", "2000-11-01", "2000-11-01", None, "2019-01-01", None, "2020-05-06", None]
    df = spark.createDataFrame([("2020-01-01",), ("2020-01-02",), ("TBA",)], "a string")
    kept = df.transform(clean.release_filter("a", "2020-01-01")).collect()
    assert [(r["release_year"], r["release_month"]) for r in kept] == [(2020, 1)]


def store_row(**over):
    row = dict.fromkeys(cat.STORE_COLUMNS)
    row |= {
        "type": "game", "name": "Game", "steam_appid": "1", "is_free": "False", "required_age": "18+",
        "detailed_description": "<p>Long</p> text", "short_description": "short", "controller_support": "full",
        "platforms": "{'windows': True, 'mac': False}", "metacritic": "{'score': 80}", "dlc": "[1, 2]",
        "pc_requirements": "{'minimum': '<b>Memory:</b> 512 MB RAM, GeForce'}",
        "mac_requirements": "[]", "categories": "[{'id': 1, 'description': 'Single player'}]", "genres": "[]",
        "developers": "['A B ']", "publishers": "P", "achievements": "{'total': 12}",
        "release_date": "{'coming_soon': False, 'date': '1 Nov, 2000'}",
    }
    return row | over


def usage_row(**over):
    row = dict.fromkeys(cat.USAGE_COLUMNS)
    row |= {
        "appid": "1", "name": "Game", "positive": "3", "negative": "1", "owners": "20,000 .. 50,000",
        "initialprice": "999", "discount": "10", "languages": "English, French", "tags": "{'Indie': 5, 'RPG': 9}",
        "average_forever": "7",
    }
    return row | over


def write_csv(path, columns, rows, extra=()):
    with open(path, "w", newline="", encoding="utf8") as f:
        w = csv.writer(f)
        w.writerow(columns)
        for r in rows:
            w.writerow(["" if r[c] is None else r[c] for c in columns])
        for r in extra:
            w.writerow(r)


def test_cleaning_job_from_csv(spark, tmp_path):
    store = [
        store_row(),
        store_row(steam_appid="2", is_free="True", detailed_description="two\nlines, \"quoted\""),
        store_row(steam_appid="abc"),
        store_row(steam_appid="3", type="dlc"),
        store_row(steam_appid="4", name="Игра"),
        store_row(steam_appid="5", release_date="{'date': 'Coming soon'}"),
        store_row(steam_appid="6", short_description=None),
        store_row(steam_appid="7", short_description="<br>"),
    ]
    usage = [usage_row(appid=str(i)) for i in range(1, 8)] + [usage_row(appid="1", owners="0..20,000"), usage_row(appid="1")]
    n = len(cat.STORE_COLUMNS)
    long = [store_row(steam_appid="8")[c] or "x" for c in cat.STORE_COLUMNS] + ["extra"]
    write_csv(tmp_path / "store.csv", cat.STORE_COLUMNS, store, [long, long + ["more"], ["game", "Short", "9"]])
    write_csv(tmp_path / "usage.csv", cat.USAGE_COLUMNS, usage)
    a = tables.read_tolerant_csv(spark, str(tmp_path / "store.csv"), cat.STORE_COLUMNS)
    b = tables.read_tolerant_csv(spark, str(tmp_path / "usage.csv"), cat.USAGE_COLUMNS)
    assert a.count() == len(store) + 1 and len(a.columns) == n  # the short row stays
    out = cleaning.clean_catalogue(a, b, "2020-01-01").orderBy("steam_appid").collect()
    assert [r["steam_appid"] for r in out] == [1, 1, 2, 7]
    r = out[0].asDict()
    assert r["price"] == 9.99 and r["review_ratio"] == 0.75 and r["target_owners"] == 1
    assert r["tags"] == ["RPG", "Indie"] and r["categories"] == ["Single_player"] and r["developers"] == ["A_B"]
    assert r["min_ram_gb"] == r["rec_ram_gb"] == 0.5 and r["req_dedicated_gpu"] == 1
    assert (r["num_dlc"], r["num_achievements"], r["metacritic_score"]) == (2, 12, 80)
    assert r["detailed_description"] == "Long text" and r["required_age"] == 0 and r["average_2weeks"] == 0
    assert (r["platform_windows"], r["platform_mac"], r["platform_linux"]) == (1, 0, 0)
    assert list(r)[-1] == "target_owners" and "positive" not in r and "is_free" not in r
    assert out[2]["price"] == 0.0 and out[2]["discount"] == 0.0
    assert out[2]["detailed_description"] == 'two lines, "quoted"'
    assert out[3]["short_description"] == ""
    report = {r["step"]: r["row_count"] for r in cleaning.cleaning_report(a, b, "2020-01-01").collect()}
    assert report == {"rows_in": 9, "type": 1, "target": 1, "release": 1, "text": 1, "script": 1, "rows_out": 4}
    clean_df = cleaning.clean_catalogue(a, b, "2020-01-01")
    for fmt in ("parquet", "csv"):
        tables.write_clean_table(clean_df, str(tmp_path / fmt), fmt)
        schema = None if fmt == "parquet" else ", ".join(
            f"{f.name} {'string' if f.name in cat.LIST_COLUMNS else f.dataType.simpleString()}" for f in clean_df.schema
        )
        back = tables.read_clean_table(spark, str(tmp_path / fmt), cat.LIST_COLUMNS, schema)
        assert [x["tags"] for x in back.collect()] == [["RPG", "Indie"]] * 4


def test_rows_with_too_many_fields_go(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,2\n3\n"x, ""y"", z",4\n6,7,,\n8,9,,x\n"two\nlines, here",5\n"p",q,\n')
    got = tables.read_tolerant_csv(spark, str(tmp_path / "t.csv"), ["a", "b"])
    want = [("1", "2"), ("3", None), ('x, "y", z', "4"), ("two\nlines, here", "5")]
    assert [tuple(r) for r in got.collect()] == want and got.count() == 4
    assert [r.b for r in got.select("b").collect()] == ["2", None, "4", "5"]


def test_ids_beyond_a_double(spark):
    from tiersmith.operators.clean import coerce_id

    rows = spark.createDataFrame([(x,) for x in ["9007199254740993", "9007199254740992", " 7 ", "8.0", "1e3", "x", None, str(2**60 + 1)]], "i string")
    assert [r.i for r in coerce_id("i")(rows).collect()] == [9007199254740993, 9007199254740992, 7, 8, 1000, 2**60 + 1]


def test_plan_pushes_filters_below_join(spark, tmp_path):
    spark.createDataFrame([tuple(store_row().values())], ", ".join(f"{c} string" for c in cat.STORE_COLUMNS)).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([tuple(usage_row().values())], ", ".join(f"{c} string" for c in cat.USAGE_COLUMNS)).write.parquet(str(tmp_path / "u"))
    df = cleaning.clean_catalogue(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "u")), "2020-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,game)" in plan
    assert "support_info" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_records_pad_and_guard(spark):
    lines = spark.createDataFrame(
        [("1", '{"name": "ok", "price": null, "extra": 1, "tags": ["a", "b"]}'), ("2", "{oops"), ("3", '{"name": "Игра"}'), ("4", "{}")],
        "id string, value string",
    )
    schema = "name string, price double, tags array<string>, extra int"
    good, bad = records.read_records(lines, schema)
    assert [r["id"] for r in bad.collect()] == ["2"]
    accepted, rejected = clean.guard(good, ["name"], cat.FORBIDDEN_SCRIPTS)
    assert [r["id"] for r in rejected.collect()] == ["3"]
    rows = {r["id"]: r for r in clean.pad(accepted, cat.PAYLOAD).collect()}
    assert rows["1"]["price"] == 0.0 and "price" in rows["1"]["imputed_keys"] and "tags" not in rows["1"]["imputed_keys"]
    assert rows["1"]["extra"] == 1 and rows["4"]["platform_windows"] == 1 and len(rows["4"]["imputed_keys"]) == 34


def test_records_are_parsed_once_whatever_filters_follow(spark):
    lines = spark.createDataFrame([(1, '{"a": "x"}'), (2, "{a"), (3, None), (4, '{"a": "жук"}')], "i int, value string")
    good, bad = records.read_records(lines, "a string")
    kept = good.filter("a LIKE 'x%' OR a LIKE 'y%'").filter("length(a) < 5")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [tuple(r) for r in kept.collect()] == [(1, "x")]
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (4, "жук")}
    assert {tuple(r) for r in bad.collect()} == {(2, "{a"), (3, None)}
