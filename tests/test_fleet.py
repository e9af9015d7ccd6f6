from lodestone.operators import fleet

PRINTER = "name string, brand string, online boolean, state string, progress double, heads array<struct<hex:string>>"


def test_search(spark):
    rows = [
        ("U1 Blue", "Snapmaker", True, "standby", 0.0, [("#FFFFFF",), ("#000000",)]),
        ("U1 Orange", "Snapmaker", True, "printing", 0.5, [("#1E88E5",), ("#8A2BE2",)]),
        ("Off", "B", False, "printing", 0.9, [("#E01B24",)]),
    ]
    table = spark.createDataFrame(rows, PRINTER)
    names = lambda q: sorted(r.name for r in fleet.fleet_search(table, q).collect())
    assert names("blue") == ["U1 Blue", "U1 Orange"] and names("red") == ["Off"] and names("magenta") == []
    assert names("@white,black") == ["U1 Blue"] and names("@white,white") == [] and names("@white,notacolour") == [] and names("@blue,violet") == ["U1 Orange"]
    assert names(">40%") == ["U1 Orange"] and names(">60%") == [] and names("offline") == ["Off"] and names("snapmaker") == ["U1 Blue", "U1 Orange"]


def test_snapshot_flatten_covers_page(spark):
    printers = spark.createDataFrame([("p", "P"), ("q", "Q")], "printer_id string, name string")
    status = spark.createDataFrame([("p", 1, "idle", 0.0), ("p", 2, "printing", 0.1)], "printer_id string, ts int, state string, progress double")
    queues = spark.createDataFrame([("p", 3)], "printer_id string, waiting int")
    assert [tuple(r) for r in fleet.snapshot(printers, status, queues).collect()] == [("p", "P", "printing", 0.1, 3)]
    docs = spark.createDataFrame([(1, '{"a": {"b": "x", "c": 2}, "d": true}'), (2, None)], "id int, doc string")
    assert sorted(tuple(r) for r in fleet.flattened(docs, "id", "doc").collect()) == [(1, "a.b", "x"), (1, "a.c", "2"), (1, "d", "true")]
    found = spark.createDataFrame([(1, "plate", "b"), (1, "image", "a"), (2, "image", "z"), (2, "chosen", "y")], "model_id int, kind string, picture string")
    assert {r.model_id: r.picture for r in fleet.covers(found).collect()} == {1: "b", 2: "y"}
    model = spark.createDataFrame([(1, "m")], "model_id int, name string")
    files = spark.createDataFrame([(1, "b", "sliced", "present"), (1, "a", "source", "present")], "model_id int, rel_path string, role string, state string")
    prints = spark.createDataFrame([(1, 5, "completed"), (1, 9, "failed")], "model_id int, ended_at int, outcome string")
    row = fleet.model_page(model, files, prints, 1).first()
    assert [f.rel_path for f in row["files"]] == ["a", "b"] and [p.ended_at for p in row.prints] == [9]


def test_costly_expressions_run_in_many_tasks_and_once_a_row(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestone.functions import identity
    from lodestone.plans import scalars

    parts = spark.range(1, 400).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").coalesce(1)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    for of in (scalars.family_by_label, scalars.title_rules):
        assert of(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    named = spark.range(1).select(identity.identify_file(F.lit("K1C"), F.lit("x"), F.lit("y"), F.lit("")).alias("x"))
    assert named._jdf.queryExecution().analyzed().toString().count(r"\bsparkx") == 3  # once for each text
