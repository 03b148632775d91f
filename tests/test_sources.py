import csv
import itertools
import random

import pytest
from pyspark.sql import functions as F

from retail_lake import staging
from retail_lake.operators import quality, silver
from retail_lake.plans import medallion
from retail_lake.schema import RAW_COLUMNS, RAW_SCHEMA
from retail_lake.sources import csv_files, documents, tables
from retail_lake.streaming import ingest

HEADER = ",".join(RAW_COLUMNS)
ROW1 = "T001,2023-06-15,C001,Female,28,Beauty,2,50,100"
ROW2 = "T002,2023-06-16,C002,Male,35,Electronics,1,300,300"


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_read_by_header_name(spark, tmp_path):
    order = list(reversed(RAW_COLUMNS))
    values = dict(zip(RAW_COLUMNS, ROW1.split(",")))
    path = put(tmp_path, "a.csv", ",".join(f"**{c}**" for c in order), ",".join(values[c] for c in order))
    row = silver.silver(csv_files.read_raw(spark, path)).first()
    assert (row.transaction_id, row.age, row.product_category) == ("T001", 28, "Beauty")


def test_headers_bind_each_file(spark, tmp_path):
    put(tmp_path, "a.csv", "\ufeff" + HEADER, ROW1, "", HEADER)
    path = put(tmp_path, "b.csv", ",".join(reversed(RAW_COLUMNS)), ",".join(reversed(ROW2.split(","))))
    rows = csv_files.read_raw(spark, path).orderBy("Transaction ID").collect()
    assert [",".join(r[c] for c in RAW_COLUMNS) for r in rows] == [ROW1, ROW2]
    fixed = csv_files.read_with_schema(spark, path).orderBy("Transaction ID").collect()
    assert [(r["Age"], r["Quantity"], r["_corrupt"]) for r in fixed] == [("28", "2", None), ("35", "1", None)]


def test_lines_that_do_not_fit_are_kept(spark, tmp_path):
    bad = [ROW1 + ",tenth", '"T9,2023-01-01', 'T8,"a"b,C1,Male,30,Beauty,1,25,25']
    path = put(tmp_path / "in", "a.csv", HEADER, *bad, ROW2)
    rows = csv_files.read_raw(spark, path).collect()
    assert {r["_corrupt"] for r in rows} == {*bad, None} and len(rows) == 4
    assert silver.silver(csv_files.read_raw(spark, path)).count() == 1
    landed = csv_files.copy_to_bronze(spark, path, str(tmp_path / "out"))
    assert sorted(map(str, csv_files.read_raw(spark, landed).collect())) == sorted(map(str, rows))


def test_blanks_and_further_columns_reach_bronze(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", HEADER + ",Note", ROW1.replace("C001", "  C1  ") + ',"say ""hi"", twice"')
    landed = csv_files.copy_to_bronze(spark, path, str(tmp_path / "out"))
    row = csv_files.read_raw(spark, landed).first()
    assert (row["Customer ID"], row["Note"]) == ("  C1  ", 'say "hi", twice')


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", HEADER, ROW1.replace("C001", '"C\n1"'))
    assert csv_files.read_raw(spark, path, multi_line=True).first()["Customer ID"] == "C\n1"
    assert csv_files.read_raw(spark, path).where("_corrupt IS NULL").count() == 0


def test_uploads_are_judged_one_by_one(spark, tmp_path):
    put(tmp_path, "good.csv", HEADER, ROW1)
    put(tmp_path, "turned.csv", ",".join(reversed(RAW_COLUMNS)), ",".join(reversed(ROW2.split(","))))
    put(tmp_path, "empty.csv", HEADER)
    put(tmp_path, "wrong.csv", "Date,Sales", "2023-01-01,100")
    put(tmp_path, "dates.csv", HEADER, ROW1.replace("2023-06-15", "15/06/2023"))
    put(tmp_path, "odd.csv", HEADER, ROW1.replace("Beauty", "Toys").replace("28", "x"), ROW2)
    put(tmp_path, "broken.csv", HEADER, ROW1, "a,b")
    path = put(tmp_path, "data.txt", "not a table")
    (tmp_path / "nothing.csv").write_text("\n")
    rows, rejected = csv_files.read_uploads(spark, path)
    assert {(r["Transaction ID"], r.file_name) for r in rows.where("file_name in ('good.csv', 'turned.csv')").collect()} == {
        ("T001", "good.csv"), ("T002", "turned.csv")
    }
    assert [(r.file_name, set(r.lacking)) for r in rejected.collect()] == [("wrong.csv", set(RAW_COLUMNS) - {"Date"})]
    told = {r.file_name: r for r in quality.upload_reports(spark, path).collect()}
    assert {f: r.status for f, r in told.items()} == {
        "good.csv": "accepted", "turned.csv": "accepted", "empty.csv": "accepted", "odd.csv": "accepted",
        "wrong.csv": "rejected", "dates.csv": "rejected", "broken.csv": "rejected", "data.txt": "rejected", "nothing.csv": "rejected",
    }
    assert told["dates.csv"].errors == ["unparsable date: 1"] and told["broken.csv"].errors == ["malformed row: 1"]
    assert told["data.txt"].errors == ["not a .csv file"] and told["nothing.csv"].errors == ["no header"]
    assert told["wrong.csv"].errors[0] == "missing column: Age" and len(told["wrong.csv"].errors) == 8
    odd = told["odd.csv"]
    assert odd.warnings == ["non-numeric in Age: 1", "unknown category: 1"] and odd.categories == ["Electronics"]
    assert (odd.rows, str(odd.first_date), str(odd.last_date)) == (2, "2023-06-15", "2023-06-16")
    assert (told["empty.csv"].rows, told["empty.csv"].first_date) == (0, None)


def test_rows_that_do_not_fit_the_schema_are_marked(spark, tmp_path):
    path = put(tmp_path, "a.csv", HEADER, ROW1, "short,row")
    rows = csv_files.read_with_schema(spark, path).collect()
    assert [r["_corrupt"] for r in rows] == [None, "short,row"]


def test_bronze_copy_quotes_everything(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", HEADER, ROW1)
    target = csv_files.copy_to_bronze(spark, path, str(tmp_path / "out"))
    lines = spark.read.text(target).collect()
    assert all(part.startswith('"') and part.endswith('"') for r in lines for part in r.value.split(","))
    assert csv_files.read_raw(spark, target).collect() == csv_files.read_raw(spark, path).collect()


def test_plain_and_all_quoted_lines_are_not_matched_by_field(spark, tmp_path, monkeypatch):
    path = put(tmp_path, "a.csv", "x,y,z", "1,,3", '"1","a, b",""', '"","",""')
    found = csv_files.lines(spark.read, path)
    heads = csv_files.headers(found)
    monkeypatch.setattr(csv_files, "FIELD", "(no field)")
    rows = csv_files.bind(found, heads, ["x", "y", "z"])
    got = {(r.x, r.y, r.z, r["_corrupt"]) for r in rows.collect()}
    assert got == {("1", None, "3", None), ("1", "a, b", None, None), (None, None, None, None)}


def test_lines_are_cut_as_their_fields_match(spark):
    """All texts of up to seven characters of a quote, a comma and a letter."""
    texts = ["".join(t) for n in range(8) for t in itertools.product('",a', repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "line string")
    cut = F.transform(csv_files._values(F.col("line")), lambda v: F.nullif(v, F.lit("")))
    assert rows.where(~cut.eqNullSafe(csv_files.split_line(F.col("line")))).collect() == []


def test_quotes_and_commas_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', "d")], "x string, y string")
    path = csv_files.write_csv(df, str(tmp_path / "t"))
    assert csv_files.read_raw(spark, path).drop("_corrupt").collect() == df.collect()


def test_documents_from_files(spark, tmp_path):
    put(tmp_path, "winter_coats_knowledge.txt", "Coats", "", "Warm.")
    path = put(tmp_path, "store_rules.txt", "Rules")
    rows = documents.read_documents(spark, path).orderBy("source").collect()
    assert [(r.source, r.category, r.text) for r in rows] == [
        ("store_rules.txt", "Store Rules", "Rules\n"),
        ("winter_coats_knowledge.txt", "Winter Coats", "Coats\n\nWarm.\n"),
    ]


def test_medallion_end_to_end(spark, tmp_path):
    source = put(tmp_path / "in", "a.csv", HEADER, ROW1, ROW2, "T003,bad,C3,Male,30,Beauty,1,25,25")
    stored = medallion.run(
        spark, source, str(tmp_path / "bronze"), "t_silver", "t_gold",
        locations=(str(tmp_path / "silver"), str(tmp_path / "gold")), run_info=("run-7", "2024-02-01"),
    )
    assert stored["transactions"].count() == 2 and stored["daily_revenue"].count() == 2
    assert {r.pipeline_run_id for r in stored["transactions"].collect()} == {"run-7"}
    again = medallion.silver_to_gold(spark, spark.table("t_silver.transactions"), "t_gold")
    assert again["monthly_summary"].agg(F.sum("monthly_revenue")).first()[0] == 400.0


def test_silver_can_be_split_by_year(spark, tmp_path):
    source = put(tmp_path / "in", "a.csv", HEADER, ROW1, ROW2.replace("2023", "2024"))
    tables.create_database(spark, "t_by_year", str(tmp_path / "t"))
    stored = medallion.bronze_to_silver(spark, csv_files.read_raw(spark, source), "t_by_year", partition_by=["year"])
    text = stored.where("year = 2024").select("transaction_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text
    assert [r.transaction_id for r in stored.where("year = 2024").collect()] == ["T002"]


def test_serving_tables(spark, tmp_path):
    tables.create_database(spark, "t_serving", str(tmp_path / "serving"))
    tables.create_serving_tables(spark, "t_serving")
    tables.create_serving_tables(spark, "t_serving")
    raw = spark.createDataFrame([tuple(ROW1.split(",")), (None, "x", None, None, "y", None, None, None, None)], RAW_SCHEMA)
    tables.append_table(tables.transactions_rows(raw), "t_serving.sales_transactions")
    tables.append_table(tables.transactions_rows(raw), "t_serving.sales_transactions")
    rows = spark.table("t_serving.sales_transactions").collect()
    assert len(rows) == 4 and all(r.uploaded_at is not None for r in rows)
    # an absent amount is 0, an age that is no number stays null
    bad = [(r.age, r.total_amount) for r in rows if r.transaction_id == ""]
    assert bad == [(None, 0.0)] * 2


def test_stream_keeps_good_rows_and_quarantines_the_rest(spark, tmp_path):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    put(source, "a.csv", HEADER, ROW1, "T3,15/06/2023,C3,Male,30,Beauty,1,25,25", "broken")
    ingest.ingest_stream(spark, str(source), target, progress).awaitTermination()
    counts = {r.status: r.rows for r in ingest.ingest_report(spark, target).collect()}
    assert counts == {"ok": 1, "missing value": 1, "malformed row": 1}
    put(source, "b.csv", HEADER, ROW2, "T5,2023-06-17,C5,Male,30,Beauty,1,25,-5")
    ingest.ingest_stream(spark, str(source), target, progress).awaitTermination()
    ingest.ingest_stream(spark, str(source), target, progress).awaitTermination()
    assert {r.transaction_id for r in ingest.accepted(spark, target).collect()} == {"T001", "T002"}
    bad = {r.status: r.raw_row for r in ingest.quarantined(spark, target).collect()}
    assert bad["malformed row"] == "broken" and "-5" in bad["not positive"]
    assert "gender" in ingest.accepted(spark, target).columns


def test_stream_binds_by_name(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    swapped = [*RAW_COLUMNS]
    swapped[4], swapped[6] = swapped[6], swapped[4]
    put(source, "a.csv", ",".join(swapped), "T1,2023-06-15,C1,Male,2,Beauty,30,50,100")
    put(source, "b.csv", "Date,Sales", "2023-01-01,100")
    ingest.ingest_stream(spark, str(source), target, str(tmp_path / "p")).awaitTermination()
    assert [(r.age, r.quantity) for r in ingest.accepted(spark, target).collect()] == [(30, 2)]
    assert [(r.status, r.file_name) for r in ingest.quarantined(spark, target).collect()] == [("missing column", "b.csv")]


def test_many_small_batches_lose_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for i in range(5):
        put(source, f"{i}.csv", HEADER, ROW1.replace("T001", f"T{i}"))
    ingest.ingest_stream(spark, str(source), target, str(tmp_path / "p"), files_per_batch=2).awaitTermination()
    assert ingest.accepted(spark, target).count() == 5


def test_upload_sent_twice_is_taken_once(spark, tmp_path):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "p")
    put(source, "a.csv", HEADER, ROW1, ROW1)
    put(source, "a_copy.csv", HEADER, ROW1, ROW1)  # in the same batch
    put(source, "once.csv", HEADER, ROW1)  # other content: rows repeated in a file are the file's own matter
    ingest.ingest_stream(spark, str(source), target, progress).awaitTermination()
    put(source, "again.csv", HEADER, ROW1, ROW1)  # in a later batch
    put(source, "b.csv", HEADER, ROW2)
    ingest.ingest_stream(spark, str(source), target, progress).awaitTermination()
    put(source, "b2.csv", HEADER, ROW2)
    ingest.ingest_stream(spark, str(source), target, progress).awaitTermination()
    told = {r.file_name: (r.taken, r.batch_id) for r in ingest.uploads(spark, target).collect()}
    assert told == {
        "a.csv": (True, 0), "a_copy.csv": (False, 0), "once.csv": (True, 0), "again.csv": (False, 1), "b.csv": (True, 1), "b2.csv": (False, 2)
    }
    assert sorted(r.transaction_id for r in ingest.accepted(spark, target).collect()) == ["T001", "T001", "T001", "T002"]


def test_a_batch_run_again_takes_its_files_again(spark):
    digests = spark.createDataFrame([("p1", "f1", "x"), ("p2", "f2", "x"), ("p3", "f3", "y")], "file_path string, file_name string, digest string")
    seen = spark.createDataFrame([("p0", "f0", "y", True)], ingest.UPLOADS)
    taken = lambda s: sorted(r.file_path for r in ingest.judge_uploads(digests, s).where("taken").collect())
    assert taken(seen) == ["p1"] and taken(seen.limit(0)) == ["p1", "p3"]


def test_staged_rows_are_kept(spark):
    df = staging.stage(spark.range(10).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
    assert staging.work_path(spark, "x") != staging.work_path(spark, "x")


def test_multi_line_files_of_two_layouts(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y", '1,"two\nlines"', "3,4,5", "6")
    path = put(tmp_path, "b.csv", "y,x,z", '"a ""q""",7,8')
    rows = csv_files.read_raw(spark, path, multi_line=True).collect()
    fitting = {(r.x, r.y, r.z) for r in rows if r._corrupt is None}
    assert fitting == {("1", "two\nlines", None), ("7", 'a "q"', "8")}
    assert {r._corrupt.strip() for r in rows if r._corrupt is not None} == {"3,4,5", "6"}
    assert all((r.x, r.y, r.z) == (None, None, None) for r in rows if r._corrupt is not None)


def test_inference_binds_by_name_and_loses_nothing(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y,d", "1,2,2024-01-05", "9,9,9,9")
    path = put(tmp_path, "b.csv", "y,x,d", "20,3000000000,2024-02-01", ",4.0,")
    found = csv_files.read_inferred(spark, path)
    assert [t for _, t in found.dtypes] == ["date", "double", "int", "string"] and found.columns == ["d", "x", "y", "_corrupt"]
    rows = {(r.x, r.y, str(r.d)) for r in found.where("_corrupt IS NULL").collect()}
    assert rows == {(1.0, 2, "2024-01-05"), (3e9, 20, "2024-02-01"), (4.0, None, "None")}
    assert [r._corrupt for r in found.where("_corrupt IS NOT NULL").collect()] == ["9,9,9,9"]


def test_repeated_run_replaces_its_own_rows(spark, tmp_path):
    spark.sql(f"CREATE DATABASE t_runs LOCATION '{tmp_path}/runs'")
    tables.create_serving_tables(spark, "t_runs", by_run=True)
    day = spark.createDataFrame([("2024-01-01", "Beauty", 5.0), ("2024-01-02", "Beauty", 6.0)], "date string, product_category string, predicted_revenue double")
    for run, rows in (("a", day), ("b'\\", day.limit(1)), ("c", day), ("a", day), ("b'\\", day), ("c", day.limit(0))):
        tables.append_run(tables.forecast_rows(rows, "v"), "t_runs.daily_forecasts", run)
    counts = {r.run_id: r["count"] for r in spark.table("t_runs.daily_forecasts").groupBy("run_id").count().collect()}
    assert counts == {"a": 2, "b'\\": 2}
    spark.sql("DROP DATABASE t_runs CASCADE")


def test_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE t_swap LOCATION '{tmp_path}/swap'")
    old = tables.overwrite_table(spark.range(5).withColumn("p", F.col("id") % 2), "t_swap.t", partition_by=["p"])
    assert old.count() == 5 and spark.table("t_swap.t").where("p = 1").count() == 2
    broken = spark.range(50).select(F.when(F.col("id") == 49, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        tables.overwrite_table(broken, "t_swap.t")
    assert {r.id for r in spark.table("t_swap.t").collect()} == set(range(5))
    tables.overwrite_table(spark.range(5), "t_swap.t")
    reader = spark.table("t_swap.t")
    new = tables.overwrite_table(spark.range(3).select(F.col("id").cast("string").alias("name")), "t_swap.t")
    assert new.columns == ["name"] and new.count() == 3 and reader.count() == 5
    spark.sql("DROP DATABASE t_swap CASCADE")


def small_blocks(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.mark.parametrize(("size", "sent"), [("150b", 200_000), ("250b", 0), ("1m", 200_000)])
def test_quoted_line_breaks_in_files_of_many_blocks(spark, tmp_path, monkeypatch, size, sent):
    """Every value comes back, whatever block of whatever size its record begins and ends in."""
    monkeypatch.setattr(csv_files, "BLOCKS_SENT", sent)
    rng = random.Random(7)
    wanted = []
    for name, order in (("a", ["x", "y", "z"]), ("b", ["z", "x", "y"])):
        with (tmp_path / f"{name}.csv").open("w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if name == "a" else "\r\n")
            out.writerow(order)
            for k in range(40):
                row = {"x": f"{name}{k}", "y": "".join(rng.choices(['"', "\n", ",", "é", "word", " ", "\r\n"], k=rng.randint(0, 12))), "z": rng.choice(["", "1\n\n2", "long\n" * 150])}
                out.writerow([row[c] for c in order])
                wanted.append(tuple(row[c] or None for c in "xyz"))
    small_blocks(spark, size)
    try:
        rows = csv_files.read_raw(spark, str(tmp_path), multi_line=True).select("x", "y", "z", "_corrupt").collect()
    finally:
        small_blocks(spark, "128m")
    assert [r._corrupt for r in rows if r._corrupt is not None] == []
    assert sorted((r.x, r.y, r.z) for r in rows) == sorted(wanted)


def test_quotes_out_of_place_lose_nothing(spark, tmp_path):
    (tmp_path / "bom.csv").write_text("\N{ZERO WIDTH NO-BREAK SPACE}" '"x","y"\n1,5" pipe\n"a"b,2\n3,4\n\n5,"six\n', encoding="utf-8")
    (tmp_path / "open.csv").write_text('y,x\n"never\nclosed,1\n2,3')
    path = put(tmp_path, "head.csv", '"x","y', 'z"', "1,2")
    rows = csv_files.read_raw(spark, path, multi_line=True).collect()
    assert {(r.x, r.y) for r in rows if r._corrupt is None and r.x == "3"} == {("3", "4")}
    assert {(r.x, r["y\nz"]) for r in rows if r["y\nz"]} == {("1", "2")}
    assert {(r.x, r.y) for r in rows if r.y and "pipe" in r.y} == {("1", '5" pipe')}
    assert {r._corrupt for r in rows if r._corrupt is not None} == {'"a"b,2', '5,"six', '"never\nclosed,1\n2,3'}
