import pytest

from lonja.operators import delta

SCHEMA = "k int, anio int, v string, fuente string"
KEYS, PAY = ["k"], ["anio", "v"]


def test_states(spark):
    a = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "x"), (3, 1, None, "x"), (4, 1, "d", "x"), (None, 1, "n", "x")], SCHEMA)
    b = spark.createDataFrame([(1, 1, "a", "other lineage"), (2, 1, None, "x"), (3, 1, "c", "x"), (5, 2, "e", "x"), (5, 2, "e", "y")], SCHEMA)
    assert {r["k"]: r["estado"] for r in delta.classify(a, b, KEYS, PAY).collect()} == {1: "igual", 2: "corregido", 3: "corregido", 4: "ausente", 5: "nuevo"}
    assert delta.merged(a, b, KEYS, PAY).count() == 6
    assert delta.classify(a.limit(0), b.limit(0), KEYS, PAY).count() == 0


def test_protocol(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "x"), (3, 2, "c", "x")], SCHEMA)
    target = str(tmp_path / "table")
    a.write.partitionBy("anio").parquet(target)
    current = spark.read.parquet(target).select(*a.columns)
    assert delta.apply_batch(current, a, KEYS, PAY, ["anio"], str(tmp_path / "s0"))["estado"] == "SIN_CAMBIOS"
    batch = spark.createDataFrame([(2, 1, "B", "x"), (9, 1, "z", "x")], SCHEMA)
    m = delta.apply_batch(current, batch, KEYS, PAY, ["anio"], str(tmp_path / "s1"))
    assert (m["nuevos"], m["corregidos"], m["filas"]) == (1, 1, 3)
    assert not delta.publish(spark, m, target, ["anio"])
    assert delta.publish(spark, m, target, ["anio"], confirm=True)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(target).collect()} == {(1, "a"), (2, "B"), (3, "c"), (9, "z")}
    delta.save_manifest(spark, m, str(tmp_path / "m" / "manifest.json"))


def test_gates(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "a", "x")], SCHEMA)
    for bad in (spark.createDataFrame([(1, 1, "b", "x"), (1, 1, "c", "x")], SCHEMA), spark.createDataFrame([("q", "1", "b", "x")], "k string, anio string, v string, fuente string"), a.drop("v")):
        with pytest.raises(delta.GateError):
            delta.apply_batch(a, bad, KEYS, PAY, ["anio"], str(tmp_path / "never"))
    with pytest.raises(delta.GateError):
        delta.inside("/etc/passwd", [str(tmp_path)])
    assert not (tmp_path / "never").exists()


def _table(spark, path, rows, partitions=("anio",)):
    spark.createDataFrame(rows, SCHEMA).write.partitionBy(*partitions).parquet(path)
    return spark.read.parquet(path).select("k", "anio", "v", "fuente")


def _rows(spark, path):
    return sorted((r["k"], r["anio"] or 0, r["v"]) for r in spark.read.parquet(path).collect())


def test_moved_keys_and_null_partitions(spark, tmp_path):
    """A key that moves leaves its old partition, even if that is then empty; rows of the NULL partition are kept."""
    target, staged, backup = (str(tmp_path / x) for x in ("table", "s", "b"))
    current = _table(spark, target, [(1, 2020, "a", "x"), (2, 2021, "b", "x"), (3, 2022, "c", "x"), (4, None, "d", "x"), (5, None, "e", "x")])
    batch = spark.createDataFrame([(1, 2021, "a", "x"), (9, None, "z", "x"), (4, 2022, "D", "x")], SCHEMA)
    m = delta.apply_batch(current, batch, KEYS, PAY, ["anio"], staged, table_path=target)
    assert (m["nuevos"], m["corregidos"], m["vaciadas"], m["claves_tabla"]) == (1, 2, [{"anio": 2020}], 6)
    assert delta.publish(spark, m, target, ["anio"], confirm=True, keys=KEYS, backup=backup)
    assert _rows(spark, target) == [(1, 2021, "a"), (2, 2021, "b"), (3, 2022, "c"), (4, 2022, "D"), (5, 0, "e"), (9, 0, "z")]
    delta.restore(spark, m, target, ["anio"], backup)
    assert _rows(spark, target) == [(1, 2020, "a"), (2, 2021, "b"), (3, 2022, "c"), (4, 0, "d"), (5, 0, "e")]


def test_untouched_partitions_are_not_read_or_written(spark, tmp_path):
    target = str(tmp_path / "table")
    current = _table(spark, target, [(i, 2000 + i % 5, "a", "x") for i in range(20)])
    parts = spark.createDataFrame([(2001,), (None,)], "anio int")
    plan = delta.of_partitions(current, ["anio"], parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2001" in plan
    m = delta.apply_batch(current, spark.createDataFrame([(1, 2001, "B", "x")], SCHEMA), KEYS, PAY, ["anio"], str(tmp_path / "s"))
    assert (m["filas"], m["particiones"]) == (4, 1)


def test_more_partitions_than_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "LISTED", 1)
    target = str(tmp_path / "table")
    current = _table(spark, target, [(1, 2020, "a", "x"), (2, 2021, "b", "x"), (3, None, "c", "x")])
    m = delta.apply_batch(current, spark.createDataFrame([(1, None, "a", "x"), (2, 2020, "B", "x")], SCHEMA), KEYS, PAY, ["anio"], str(tmp_path / "s"))
    delta.publish(spark, m, target, ["anio"], confirm=True, keys=KEYS)
    assert _rows(spark, target) == [(1, 0, "a"), (2, 2020, "B"), (3, 0, "c")]


def test_publication_is_locked_and_checked(spark, tmp_path):
    target = str(tmp_path / "table")
    current = _table(spark, target, [(1, 2020, "a", "x")])
    m = delta.apply_batch(current, spark.createDataFrame([(2, 2020, "b", "x")], SCHEMA), KEYS, PAY, ["anio"], str(tmp_path / "s"), table_path=target)
    (tmp_path / "table.lock").write_text("other")
    with pytest.raises(delta.GateError, match="another run"):
        delta.publish(spark, m, target, ["anio"], confirm=True)
    (tmp_path / "table.lock").unlink()
    spark.createDataFrame([(7, 2020, "q", "x")], SCHEMA).write.mode("append").partitionBy("anio").parquet(target)
    with pytest.raises(delta.GateError, match="changed since"):
        delta.publish(spark, m, target, ["anio"], confirm=True)
    assert not (tmp_path / "table.lock").exists() and len(_rows(spark, target)) == 2
    with pytest.raises(delta.GateError, match="overlaps"):
        delta.apply_batch(current, current, KEYS, PAY, [], f"{target}/inner", table_path=target, allowed=[str(tmp_path)])


def test_new_ids_of_known_business_keys_block_the_batch(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, None, "x")], SCHEMA)
    b = spark.createDataFrame([(3, 1, "a", "x"), (4, 2, "q", "x"), (5, 2, "q", "x"), (6, 3, None, "x"), (1, 1, "A", "x")], SCHEMA)
    assert {r["k"]: r["causa"] for r in delta.key_conflicts(a, b, ["k"], ["anio", "v"]).collect()} == {3: "EXISTE_EN_TABLA", 4: "REPETIDA_EN_LOTE", 5: "REPETIDA_EN_LOTE"}
    m = delta.apply_batch(a, b, KEYS, PAY, [], str(tmp_path / "s"), business_key=["anio", "v"], conflicts_to=str(tmp_path / "c"))
    assert (m["estado"], m["conflictos"]) == ("CONFLICTO", 3) and spark.read.parquet(str(tmp_path / "c")).count() == 3 and not (tmp_path / "s").exists()
    flags = delta.with_collisions(delta.merged(a, b, KEYS, PAY), "v", "n", "choca")
    assert {r["k"]: (r["n"], r["choca"]) for r in flags.collect()} == {1: (1, False), 2: (None, False), 3: (1, False), 4: (2, True), 5: (2, True), 6: (None, False)}
