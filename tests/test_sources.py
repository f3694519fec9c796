import json

from pyspark.sql import functions as F

from quillon.operators import callgraph as C
from quillon.sources import items, profiles
from quillon.streaming import sessions


def written(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_items_encoded_twice(spark, tmp_path):
    info = {"a.jpg": {"gps_info": {"Latitude": "1.5", "LatitudeRef": "N"}, "exif_info": {"Flash": "1"}, "label": ["2", "3"]}, "b.jpg": {"gps_info": {}, "exif_info": {}, "label": []}}
    path = written(tmp_path, "x.json", json.dumps(json.dumps([info, {}, []])))
    got = {r.item_id: r for r in items.read_items(spark, path).collect()}
    assert got["a.jpg"].gps["LatitudeRef"] == "N" and (got["a.jpg"].event_id, got["a.jpg"].scene_id) == ("2", "3")
    assert got["b.jpg"].event_id is None and got["b.jpg"].exif == {}


def test_files_and_labels(spark, tmp_path):
    for name in ("u/Event1/Scene_2/a.JPG", "u/Event1/b.jpg", "u/Event1/c.txt"):
        written(tmp_path, name, "x")
    got = {r["name"]: (r.event, r.scene) for r in items.folder_labels(items.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.JPG": ("1", "2"), "b.jpg": ("1", None)}


def test_perf(spark, tmp_path):
    text = "app 1 [0] 1.0: cycles:\n\tffff01 leaf+0x1f (/lib/a.so)\n\tffff02 mid (/lib/a.so)\n\tffff03 main+0x2 (/bin/app)\n\napp 1 [0] 2.0: cycles:\n\tffff02 mid (/lib/a.so)\n\tffff03 main+0x2 (/bin/app)\n"
    got = profiles.read_perf(spark, written(tmp_path, "p.txt", text))
    assert sorted(r.stack for r in got.collect()) == [["leaf", "mid", "main"], ["mid", "main"]]
    total = {r.name: round(r.total, 9) for r in C.propagate(C.stack_nodes(got), C.stack_edges(got)).collect()}
    assert total == {"leaf": 0.5, "mid": 1.0, "main": 1.0}


def test_xperf(spark, tmp_path):
    text = "Process Name, Module, Function, Weight, Count, Stack\napp.exe, m, f, 10, 3, [Root]/a!x/m!f\nIdle (0), m, f, 99, 1, ?\nIdle, m, f, 99, 1, ?\napp.exe, m, g, 5, 2, ?\napp.exe, m, h, 1, 1, [Root]/a!x\n"
    got = profiles.read_xperf(spark, written(tmp_path, "x.csv", text)).collect()
    assert sorted((r.stack, r.cost, r.calls) for r in got) == [(["m!f", "a!x"], 30.0, 3.0), (["m!g"], 10.0, 2.0), (["m!h", "a!x"], 1.0, 1.0)]


def test_json_and_hprof(spark, tmp_path):
    doc = {"version": 0, "functions": [{"name": "f"}, {"name": "g"}], "events": [{"callchain": [0, 1], "cost": [3]}, {"callchain": [1], "cost": [1]}]}
    got = profiles.read_json(spark, written(tmp_path, "j.json", json.dumps(doc))).collect()
    assert sorted((r.stack, r.cost) for r in got) == [(["f", "g"], 3.0), (["g"], 1.0)]
    text = "TRACE 300001:\n\tA.f(A.java:1)\n\tA.main(A.java:9)\nTRACE 300002:\n\tB.g(B.java:2)\nCPU SAMPLES BEGIN (total = 5)\nrank   self  accum   count trace method\n   1 60.00% 60.00%       3 300001 A.f\n   2 40.00% 100.00%       2 300002 B.g\nCPU SAMPLES END\n"
    got = profiles.read_hprof(spark, written(tmp_path, "h.txt", text)).collect()
    assert sorted((r.stack, r.cost) for r in got) == [(["A.f", "A.main"], 3.0), (["B.g"], 2.0)]


def test_sysprof(spark, tmp_path):
    text = '<profile><objects><object id="1"><name>In file /bin/x</name><self>0</self></object><object id="2"><name>f</name><self>7</self></object></objects></profile>'
    got = profiles.read_sysprof(spark, written(tmp_path, "s.xml", text)).orderBy("object").collect()
    assert [(r.object, r.name, r.self) for r in got] == [(1, "/bin/x", 0), (2, "f", 7)]


def test_sysprof_call_tree(spark, tmp_path):
    """A process (object 1, fake) over f, which calls a fake module over g: g's samples are a call from f."""
    objects = "".join(f'<object id="{k}"><name>{n}</name><self>{s}</self></object>' for k, n, s in ((1, "proc", 0), (2, "f", 7), (3, "module", 0), (4, "g", 5)))
    tree = "".join(f'<node id="{k}"><object>{o}</object><self>{s}</self><parent>{p}</parent></node>' for k, o, s, p in ((1, 1, 0, 0), (2, 2, 7, 1), (3, 3, 0, 2), (4, 4, 4, 3), (5, 4, 1, 2)))
    path = written(tmp_path, "t.xml", f"<profile><objects>{objects}</objects><nodes>{tree}</nodes></profile>")
    nodes, edges = profiles.sysprof_graph(profiles.read_sysprof(spark, path), profiles.read_sysprof_nodes(spark, path))
    assert {(r.name, r.self) for r in nodes.collect()} == {("f", 7.0), ("g", 5.0)}
    assert [tuple(r) for r in edges.select("src", "dst", "weight").collect()] == [("f", "g", 5.0)]
    total = {r.name: r.total for r in C.propagate(nodes, edges).collect()}
    assert round(total["f"], 9) == 1.0 and round(total["g"], 9) == round(5 / 12, 9)


def test_pair_tables(spark, tmp_path):
    a = written(tmp_path, "p/a.csv", "x,y,1.5,2,0,0,0,0,1,2,3,1,0.5,0.25,0.1,1,0\nx,z,,oops,0,0,0,0,1,,3,1,0.5,0.25,0.1,,0\n")
    b = written(tmp_path, "p/b.csv", "q,r,1,2,0,0,0,0,1,2,3,1,0.5,0.25,0.1,1,1\n")
    got = {(r.first, r.second): r for r in items.read_pairs(spark, a, b).collect()}
    assert len(got) == 3 and got["x", "y"].distance == 1.5
    r = got["x", "z"]
    assert (r.distance, r.time, r.sensing_method, r.label_e, r.label_s) == (-1.0, -1.0, -1, 0, 0)
    out = str(tmp_path / "again")
    items.write_pairs(items.read_pairs(spark, a, b), out, header=False)
    assert {tuple(r) for r in items.read_pairs(spark, out).collect()} == {tuple(r) for r in got.values()}
    assert items.read_pairs(spark, b, columns=items.TIME_PAIRS).first().label_s == 1


def test_predictions_lookups_and_kept_tables(spark, tmp_path):
    scored = spark.createDataFrame([("b", "c", 1, 0.9), ("a", "c", 0, 0.7)], "first string, second string, predicted_label int, probability double")
    items.write_predictions(scored, str(tmp_path / "s"))
    assert {tuple(r) for r in items.read_predictions(spark, str(tmp_path / "s")).collect()} == {tuple(r) for r in scored.collect()}
    odd = written(tmp_path, "o.csv", "first, second, predicted_label, probability\na, b, 1, x\n")
    assert [tuple(r) for r in items.read_predictions(spark, odd).collect()] == [("a", "b", 1, None)]
    items.write_lookup(spark.createDataFrame([("(1.00, 2.00)", "town")], "k string, v string"), str(tmp_path / "l"))
    assert [tuple(r) for r in items.read_lookup(spark, str(tmp_path / "l"), ["place", "city"]).collect()] == [("(1.00, 2.00)", "town")]
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("n")
    assert [items.kept(spark, str(tmp_path / "k"), make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    assert items.exists(spark, odd) and not items.exists(spark, odd + "x")
    all_items, labels = spark.createDataFrame([("i",), ("j",)], "item_id string"), spark.createDataFrame([("i", "e")], "item_id string, event string")
    good, bad = items.labelled_items(all_items, labels)
    assert [tuple(r) for r in good.collect()] == [("i", "e")] and [tuple(r) for r in bad.collect()] == [("j",)]


def test_large_clusters_are_written_in_parts(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("c"), "id").where("c = 0 or id < 50")
    rows = items.result_json(df, "c", "id", most=100).collect()
    assert sorted(len(json.loads(r.value)["items"]) for r in rows if r.c == 1) == [25] and sum(len(json.loads(r.value)["items"]) for r in rows) == 525
    assert len([r for r in rows if r.c == 0]) == 5


def test_model_is_saved_loaded_and_evaluated(spark, tmp_path):
    from quillon.operators import model as M

    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("k"), (F.col("id") % 20 > 9).cast("double").alias("label"))
    fitted = M.fit(df, ["x"], ["k"], "label")
    M.save(fitted, str(tmp_path / "m"))
    again = M.load(str(tmp_path / "m"))
    assert M.evaluated(again, df, "label").first().accuracy > 0.97
    assert M.predict(again, df).select("predicted_label").collect() == M.predict(fitted, df).select("predicted_label").collect()


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    import pytest

    from quillon import session

    class Fake:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(Fake)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "event long, item string")
    items.write_clusters(df, str(tmp_path / "c"), "event")
    assert spark.read.parquet(str(tmp_path / "c")).where("event = 1").count() == 2
    items.write_pairs(df, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 3
    items.write_lines(items.result_json(df, "event", "item").select("value"), str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"cluster":1,"items":["a","b"]}', '{"cluster":2,"items":["c"]}']


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sessions.event_stream(spark, str(tmp_path / "in"), events.schema)
    sessions.run_once(sessions.sessions(stream, late="60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    spark.sql("select 1").collect()
    tail = events.agg(F.max("ts").alias("t")).first().t
    late = spark.createDataFrame([(10**9, tail.replace(year=tail.year + 1), -1, "x", 0.0, "{}")], events.schema)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    sessions.run_once(sessions.sessions(sessions.event_stream(spark, str(tmp_path / "in"), events.schema), late="60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0")
    batch = events.groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count("*").alias("n"))
    assert got.count() == batch.count() and got.agg({"n": "sum"}).first()[0] == events.count()
