import json

from lonja.__main__ import main
from lonja.plans import pipeline


def test_products_and_typed_tables(spark, root, tmp_path):
    for steps in (pipeline.TYPED, pipeline.PRODUCTS):
        reports = pipeline.run(spark, root, steps, str(tmp_path), run=f"r{len(steps)}{steps[0].name}")
        assert [r.error for r in reports] == [""] * len(steps) and all(r.filas for r in reports if r.conjunto != "impacto_hechos_valor")


def test_failure_is_isolated(spark, root, tmp_path):
    bad = pipeline.Step("malo", lambda s, r: s.read.parquet(f"{r}/no-such"), ("x",))
    reports = pipeline.run(spark, root, [bad, pipeline.TYPED[1]], str(tmp_path), run="r")
    assert [bool(r.error) for r in reports] == [True, False]
    assert len(json.loads((tmp_path / "run_id=r/manifest.json").read_text())["conjuntos"]) == 2


def test_profile_and_verify(spark, root):
    a, b = pipeline.profile(spark, root, ["plazas", "nada"])
    assert a["filas"] == 5 and "error" in b
    assert {r["estado"] for r in pipeline.verify(spark, root).collect()} <= {"COINCIDE", "REVISAR"}


def test_command_line(spark, root, tmp_path, capsys):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string").write.parquet(a)
    spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string").write.parquet(b)
    args = ["--keys", "k", "--payload", "v"]
    assert main(["plan", a, b, *args]) == 0
    assert json.loads(capsys.readouterr().out) == {"nuevo": 1, "corregido": 1, "ausente": 1}
    assert main(["apply", a, b, *args, "--out", str(tmp_path / "s")]) == 0
    assert main(["publish", str(tmp_path / "s/manifest.json"), a, "--confirm"]) == 0
    assert spark.read.parquet(a).count() == 3
    assert main(["query", "s_puente", root, str(tmp_path / "q")]) == 0
