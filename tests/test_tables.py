import pytest
from pyspark.sql import functions as F

from hyplab.operators import contracts as C, joins as J, ordering as O, select as G
from hyplab.sources import index as I, tables as T
from hyplab.streaming import backlog as B


def test_template_alignment(spark):
    template = spark.createDataFrame([("lin_1",), ("sna_2",), ("lug_3",)], "ID string")
    preds = spark.createDataFrame([("sna_2", "Hello"), ("lin_1", "nan")], "ID string, prediction string")
    got = {r["ID"]: r["target"] for r in J.align_to_template(template, preds, "ID", "prediction").collect()}
    assert got == {"lin_1": ".", "sna_2": "hello", "lug_3": "."}
    with pytest.raises(Exception, match="no usable prediction"):
        J.align_to_template(template, preds, "ID", "prediction", strict=True).collect()
    twice = preds.unionByName(preds)
    with pytest.raises(Exception, match="duplicate ID"):
        J.align_to_template(template, twice, "ID", "prediction").collect()


def test_held_out_split_is_refused(spark):
    idx = spark.createDataFrame([("lin_99", "test", "SECRET"), ("lin_1", "train", "a")], "ID string, split string, Target string")
    with pytest.raises(ValueError):
        I.guarded(idx, ["test"])
    assert "Target" not in I.guarded(idx, ["test"], allow_test=True).columns
    assert [r["ID"] for r in I.training_frame(idx).collect()] == ["lin_1"]
    with pytest.raises(ValueError):
        I.labelled_union({("lin", "test"): idx})


def test_partitioned_index_prunes(spark, tmp_path):
    rows = [("a", "s", "x", "lin", "", "train", ""), ("b", "s", "y", "lin", "", "test", ""), ("c", "s", "z", "sna", "", "train", "")]
    idx = spark.createDataFrame(rows, "ID string, speaker_id string, Target string, language string, gender string, split string, hf_config string")
    path = str(tmp_path / "index")
    I.write_index(idx, path)
    I.write_index(idx.limit(0), path)  # kept, not replaced
    back = I.read_index(spark, path, ["test"], allow_test=True)
    assert [r["ID"] for r in back.collect()] == ["b"]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [split" in plan.replace("isnotnull(split", "split") or "split#" in plan.split("PartitionFilters")[1][:120]
    assert "Target" not in plan.split("ReadSchema")[1]
    shard_dir = tmp_path / "shards" / "lin"
    idx.select(F.col("ID").alias("id"), F.col("Target").alias("transcription")).withColumn("audio", F.lit(b"0")).coalesce(1).write.parquet(str(shard_dir))
    (part,) = shard_dir.glob("part-*.parquet")
    part.rename(shard_dir / "lin-train-00000.parquet")
    got = I.split_shards(spark, str(tmp_path / "shards"), "lin", "train")
    assert got.count() == 3 and "audio" not in got.columns


def test_strict_csv_and_ordered_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "NA"), (1, "a", 'say "hi", x'), (3, "c", "null")], "pos int, ID string, Target string")
    path = str(tmp_path / "out")
    T.write_ordered(df, path, "pos")
    back = T.read_strict_csv(spark, path, ["ID", "Target"])
    check = T.round_trip(back, df, "ID", "Target").first()
    assert (check["missing"], check["extra"], check["changed"]) == (0, 0, 0)
    lines = [line for f in sorted((tmp_path / "out").glob("part-*.csv")) for line in f.read_text().splitlines() if not line.startswith('"ID"')]
    assert [line.split(",")[0] for line in lines] == ['"a"', '"b"', '"c"']
    bad = tmp_path / "bad.csv"
    bad.write_text("ID,Text\nx,1\n")
    with pytest.raises(ValueError):
        T.read_strict_csv(spark, str(bad), ["ID", "Target"])
    bad.write_text("ID,Target\nx,\n")
    with pytest.raises(Exception, match="empty Target"):
        T.read_strict_csv(spark, str(bad), ["ID", "Target"]).collect()
    bad.write_text("ID,Target\nx,1\nx,1\n")
    with pytest.raises(Exception, match="duplicate ID"):
        T.read_strict_csv(spark, str(bad), ["ID", "Target"]).collect()


def test_shard_conflict(spark):
    ok = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "id string, v string")
    assert {r["id"]: r["v"] for r in T.union_shards(ok, "id", "v").collect()} == {"a": "1", "b": None}
    with pytest.raises(Exception, match="conflicting"):
        T.union_shards(ok.unionByName(spark.createDataFrame([("a", "2")], "id string, v string")), "id", "v").collect()


def test_global_positions_and_quantiles(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("k"))
    rows = O.row_numbers(df, "k", "p").collect()
    assert [r["p"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(1, 5001))
    import numpy as np

    vals = spark.range(3000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 101 / 10.0).alias("v"))
    want = vals.toPandas().groupby("g")["v"]
    for r in O.quantiles(vals, "v", (0.1, 0.5, 0.975), ["g"]).collect():
        v = want.get_group(r["g"]).to_numpy()
        assert [r["q10"], r["q50"], r["q97_5"]] == pytest.approx(list(np.percentile(v, [10, 50, 97.5])))


def test_margin_pick(spark):
    def pick(rows, t):
        df = spark.createDataFrame([(1, i, s, s[0], c) for i, (s, c) in enumerate(rows)], "id int, pos int, system string, hypothesis string, confidence double")
        r = G.pick_margin(df, t).first()
        return r["system"], r["note"]

    cands = [("ach", -0.030), ("lug", -0.025), ("sog", -0.08)]
    assert pick(cands, 0.01) == ("ach", "primary_fb") and pick(cands, 0.004) == ("lug", "margin_ok") and pick(cands, None) == ("lug", "maxconf")


def test_submission_check(spark):
    t = spark.createDataFrame([("a",), ("b",)], "id string")
    r = C.submission_check(t, spark.createDataFrame([("a", "x"), ("a", "."), ("c", "")], "id string, t string"), "id", "t", strict=True).first()
    assert r["errors"].split(";") == ["row_count", "id_set", "empty", "duplicates", "placeholders"] and not r["ok"]
    assert C.submission_check(t, spark.createDataFrame([("a", "x"), ("b", "y")], "id string, t string"), "id", "t", strict=True).first()["ok"]


def test_stream_backlog(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    write = lambda rows: spark.createDataFrame(rows, "id int, text string").write.mode("append").parquet(src)
    run = lambda: B.run_available(spark, src, "id int, text string", out, ck, "id", lambda d: d.withColumn("text", F.upper("text")))
    write([(1, "a"), (2, "b"), (2, "b")])
    assert run() == 1
    write([(2, "z"), (3, "c")])
    assert run() == 1 and run() == 0
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]
