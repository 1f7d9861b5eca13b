import datetime as dt
import json

import pytest

from lonja.operators import audit
from lonja.plans import scale
from lonja.sources import readers, writers
from lonja.streaming import deltas


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ResponseCode": 1, "Resultado": [{"Valor": "A", "x": 1}, {"Valor": "B", "x": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"ResponseCode": 1, "Resultado": []}))
    assert {r["Valor"] for r in readers.envelopes(spark, str(tmp_path)).collect()} == {"A", "B"}
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"Valor": "D", "y": 3}]}))
    assert {(r["Valor"], r["x"], r["y"]) for r in readers.envelopes(spark, str(tmp_path)).collect()} == {("A", 1, None), ("B", 2, None), ("D", None, 3)}
    with pytest.raises(ValueError):
        readers.envelopes(spark, str(tmp_path), require_unique=True)
    whole = readers.whole_json(spark, str(tmp_path / "a.json"), spark.createDataFrame([], "ResponseCode int").schema)
    assert [r["documento"]["ResponseCode"] for r in whole.collect()] == [1]
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "c.json").write_text(json.dumps([{"Valor": "C", "x": 1}]))
    assert readers.envelopes(spark, str(bare), required=["Valor"]).count() == 1
    with pytest.raises(ValueError):
        readers.envelopes(spark, str(bare))


def test_csv_and_texts(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",PD1\n,descripción\n02Ene97,2.618\n03Ene97,n.d.\n")
    assert readers.series(spark, str(tmp_path / "s.csv")).columns[0] == "_c0"
    (tmp_path / "m.csv").write_text('﻿guid , nombre\n1,"a ""b"", c.PDF"\n', encoding="utf-8")
    m = readers.metadata_csv(spark, str(tmp_path / "m.csv"))
    assert m.columns == ["guid", "nombre"]
    d = tmp_path / "t"
    d.mkdir()
    (d / "uno.txt").write_text("línea 1\nlínea 2\n")
    docs = spark.createDataFrame([("1", "uno.PDF", "z.pdf"), ("2", "dos.pdf", "uno.pdf"), ("3", None, "no.pdf")], "id string, f string, c string")
    got = {r["id"]: (r["origen_texto"], r["texto"]) for r in readers.link_texts(docs, readers.whole_texts(spark, str(d)), "f", "c").collect()}
    assert got == {"1": ("DIRECTO", "línea 1\nlínea 2\n"), "2": ("CANONICO", "línea 1\nlínea 2\n"), "3": ("SIN_TEXTO", None)}


def test_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<s:Envelope xmlns:s='x'><s:Body><Valor><RUC>20</RUC><Nemonico>A1</Nemonico></Valor><Valor><RUC>21</RUC></Valor></s:Body></s:Envelope>")
    from pyspark.sql import types as T

    rows = readers.xml_answers(spark, str(tmp_path), "Valor", T.StructType([T.StructField("RUC", T.StringType()), T.StructField("Nemonico", T.StringType())])).collect()
    assert [(r["RUC"], r["Nemonico"], r["_archivo"]) for r in rows] == [("20", "A1", "r.xml"), ("21", None, "r.xml")]


def test_projection_helpers(spark):
    df = spark.createDataFrame([(" a ", "1.5", "x")], "A string, B string, C string")
    out = readers.with_lineage(readers.typed(readers.renamed(df, {"A": "t", "Z": "q"}), ["t", "nope"], ["B"]), "SMV", "2024-01-02")
    assert [tuple(r) for r in out.collect()] == [("a", 1.5, "SMV", dt.date(2024, 1, 2))]


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1), (2, 2)], "k int, anio int")
    writers.write_table(df, p, ["anio"])
    writers.write_table(spark.createDataFrame([(9, 2)], "k int, anio int"), p, ["anio"], dynamic=True)
    assert {(r["k"], r["anio"]) for r in spark.read.parquet(p).collect()} == {(1, 1), (9, 2)}
    assert readers.partition_of(spark, p, anio=2).collect()[0]["anio"] == 2
    with pytest.raises(Exception):
        writers.write_table(df, p, mode="errorifexists")
    writers.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_ingestion(spark, tmp_path):
    lake = str(tmp_path / "lake")
    ok, bad, empty, head = tmp_path / "ok.json", tmp_path / "bad.json", tmp_path / "e.csv", tmp_path / "h.csv"
    ok.write_text("[1]")
    bad.write_text("{")
    empty.write_text("")
    head.write_text("\n1,2\n")
    (tmp_path / "l.csv").write_bytes(b"a\xff\n")
    go = lambda *p, run="r1", ext=None: [r.estado for r in writers.ingest(spark, lake, [str(x) for x in p], "SMV", "q", ext or p[0].suffix, run, "2024-01-01")]
    assert go(ok, bad, tmp_path / "none.json") == ["SUCCESS", "REJECTED", "REJECTED"]
    assert go(ok, run="r2") == ["SKIPPED_DUPLICATE"]
    assert go(empty, head, tmp_path / "l.csv") == ["REJECTED"] * 3
    assert go(ok, ext="csv") == ["REJECTED"]
    ok.write_text("[2]")
    clash = writers.ingest(spark, lake, [str(ok)], "SMV", "q", "json", "r3", "2024-01-01")
    assert clash[0].estado == "FAILED" and writers.exit_code(clash) == 1
    assert (tmp_path / "lake/quarantine/SMV/q/run_id=r1/bad.json").is_file()
    assert json.loads((tmp_path / "lake/metadata/ingestion/audit/run_id=r3/ok.json.json").read_text())["estado"] == "FAILED"


def test_reload_keeps_the_former_version(spark, tmp_path):
    lake, src = str(tmp_path / "lake"), tmp_path / "src"
    src.mkdir()
    (src / "a.xml").write_text("<a/>")
    (src / "r.json").write_text('[{"k": 1}, {"k": 2}]')
    rows = lambda: spark.read.option("multiLine", True).json(str(src / "r.json"))
    go = lambda v, files, n: writers.reload(spark, lake, str(src), "SMV", "valores", v, files, rows(), n)
    assert go("1", {"xml": 1, "json": 1}, 2)["estado"] == "SUCCESS"
    assert "expected" in go("2", {"xml": 289}, 2)["detalle"] and "rows" in go("2", {"xml": 1}, 1008)["detalle"]
    assert (tmp_path / "lake/bronze/SMV/valores/vigente").read_text() == "1"
    assert go("1", {"xml": 1}, 2)["estado"] == "FAILED"
    (src / "b.xml").write_text("<b/>")
    assert go("2", {"xml": 2, "json": 1}, 2)["archivos"] == 3
    assert (tmp_path / "lake/bronze/SMV/valores/vigente").read_text() == "2" and (tmp_path / "lake/bronze/SMV/valores/version=1/a.xml").is_file()


def test_stream_of_deltas(spark, tmp_path):
    schema = "k int, v string"
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(f"{src}/1")
    stream = lambda: deltas.arriving(spark, f"{src}/*", spark.createDataFrame([], schema).schema)
    run = lambda: deltas.apply_arriving(stream(), table, ["k"], ["v"], str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "B"), (3, "c")], schema).write.parquet(f"{src}/2")
    run()
    assert {(r["k"], r["v"]) for r in deltas.current(spark, table).collect()} == {(1, "a"), (2, "B"), (3, "c")}


def test_sliding_totals(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2024, 1, d), "A", 1.0) for d in range(1, 11)], "t timestamp, e string, a double").write.parquet(src)
    s = deltas.sliding_totals(deltas.arriving(spark, src, spark.read.parquet(src).schema), "t", "e", "a")
    s.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("totals").agg({"monto": "max"}).first()[0] == 7.0


def test_scale_and_layouts(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    q = spark.createDataFrame([("A", day, 1.0, 0.0, 3.0, 1.0, 2.0, 10.0, 2024, 1), ("B", day, 2.0, 1.0, 3.0, 1.0, 0.0, 5.0, 2024, 2)], "valor string, fecha_cotizacion date, cierre_actual double, cierre_anterior double, maxima_actual double, minima_actual double, promedio_actual double, monto_negociado double, anio int, mes int")
    fx = spark.createDataFrame([(day, 3.7)], "fecha date, tipo_cambio double")
    risk = spark.createDataFrame([], "fecha date, embig double")
    part, flat = str(tmp_path / "p"), str(tmp_path / "f")
    r = scale.run_scale(spark, q, fx, risk, 3, part)
    assert (r["filas"], r["replicas"], r["minimo"], r["maximo"]) == (6, 3, 2, 2) and r["bytes"] > 0
    spark.read.parquet(part).write.parquet(flat)
    c = scale.compare_layouts(spark, flat, part, 2024, 1, runs=2)
    assert c["iguales"] and c["poda"]


def test_input_files_flags_and_marks(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(8).repartition(4).write.parquet(str(tmp_path / "f"))
    assert writers.input_file_count(spark.read.parquet(str(tmp_path / "f"))) == 4
    df = spark.createDataFrame([(True, None), (False, True), (None, True), (True, True)], "usar boolean, marca boolean")
    assert audit.flagged(df, "usar").count() == 2 and audit.flagged(df, "otra").count() == 4
    assert [r[0] for r in df.select(audit.accepted(F.col("usar"), F.col("marca"))).collect()] == [False, False, False, True]
    assert [r[0] for r in df.select(audit.accepted(F.col("usar"))).collect()] == [True, False, False, True]


def test_exact_quantile(spark):
    import statistics

    for values in ([3.0, 1.0, 2.0, 2.0, 9.0, None], [5.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        clean = sorted(v for v in values if v is not None)
        want = statistics.quantiles(clean, n=4, method="inclusive")[2] if len(clean) > 1 else clean[0]
        assert tuple(audit.exact_quantile(df, "x", 0.75).first()) == (want, len(clean))
    assert tuple(audit.exact_quantile(df.limit(0), "x", 0.5).first()) == (None, 0)


def test_hot_keys_stay_spread(spark):
    """A business key, and a period, that a third of the filings share."""
    from lonja.operators.delta import with_collisions
    from lonja.plans import gold

    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", "20" if i % 3 == 0 else f"r{i}", 2024, None if i % 3 == 0 else "1er Trimestre") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, clave string, ruc string, ejercicio int, trimestre string")
    flags = with_collisions(df, "clave")
    assert flags.where("colision_clave_negocio").count() == 100
    ok, invalid, many = gold.split_filings(df)
    assert (ok.count(), invalid.count(), many.count()) == (200, 0, 100)
    for d in (flags, many):
        assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_gate_helpers(spark):
    df = spark.createDataFrame([("a", None), ("a", "1"), (None, "x")], "k string, v string")
    assert {r["columna"]: r["nulos"] for r in audit.null_profile(df).collect()} == {"k": 1, "v": 1}
    assert audit.castability(df, {"v": "int"}).first()["no_convertibles"] == 1
    assert tuple(audit.key_uniqueness(df, ["k"]).first()) == (3, 2, 1)
    assert tuple(audit.key_uniqueness(df.limit(0), ["k"]).first()) == (0, 0, 0)
    assert audit.duplicate_groups(df, ["k"]).count() == 1 and audit.many_to_one_violations(df, "k", "v").count() == 0
