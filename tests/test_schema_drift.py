import json

from pyspark.sql import functions as F

from lonja.operators import schema_drift as sd

KEYS = ("id_archivo", "fuente", "canal", "secuencia", "fecha_recepcion", "contenido")
SCHEMA = "id_archivo string, fuente string, canal string, secuencia int, fecha_recepcion timestamp, contenido string, campos int, key string"


def files(spark, contents, canal="C", fuente="cotizaciones"):
    rows = [(f"{canal}{i}", fuente, canal, i, None, c if isinstance(c, str) or c is None else json.dumps(c), 0, "k") for i, c in enumerate(contents, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, contents):
    s = sd.file_schemas(files(spark, contents), "id_archivo", "fuente", "canal", "secuencia", "fecha_recepcion", "contenido")
    return {(r["id"], r["campo"], r["cambio"]) for r in sd.schema_changes(s, "id_archivo", "canal", "secuencia", "fecha_recepcion").collect()}


def env(*records, name="Resultado"):
    return {"ResponseCode": 200, name: list(records)}


def test_every_kind_of_change(spark):
    got = changes(spark, [
        env({"Valor": "A", "Monto_Negociado": 1.5, "Segmento": "RV1"}),
        env({"valor": "A", "Monto_Negociado": "1.5"}, {"EnSubasta": True}),
        env({"valor": "B", "Monto_Negociado": None, "EnSubasta": False}, name="data"),
        env({"Nemonico": "B", "Monto_Negociado": "2", "EnSubasta": False}, name="data"),
    ])
    assert got == {
        ("C2", "valor", "renombrado"), ("C2", "Monto_Negociado", "tipo"), ("C2", "Segmento", "eliminado"), ("C2", "EnSubasta", "agregado"),
        ("C3", "data", "renombrado"), ("C4", "Nemonico", "renombrado"),
    }


def test_unknown_names_by_evidence(spark):
    got = changes(spark, [env({"PrecioBase": 1.0, "Clave": "AB12"}), env({"PrecioBaseSoles": 1.0, "Ref": "CD34"}), env({"Ref": "x"})])
    assert got == {("C2", "PrecioBaseSoles", "renombrado"), ("C2", "Ref", "renombrado"), ("C3", "PrecioBaseSoles", "eliminado")}


def test_broken_empty_null_bare_and_gaps(spark):
    got = changes(spark, [env({"Valor": "A"}), "{broken", None, "", env({"Valor": "A"}), [{"Valor": "B"}], env()])
    # unreadable files are passed over; a bare array counts as an array without name; an empty one has no fields
    assert got == {("C6", "", "renombrado"), ("C7", "Resultado", "renombrado"), ("C7", "Valor", "eliminado")}
    assert changes(spark, []) == set() and changes(spark, [env({"Valor": "A"})]) == set()


def test_long_channel_is_cut_into_ranges(spark):
    names = ["Valor", "valor"]
    got = changes(spark, [env({names[i // 3 % 2]: "A"}) for i in range(1000)])
    assert got == {(f"C{i + 1}", names[i // 3 % 2], "renombrado") for i in range(3, 1000, 3)}


def test_channel_without_order(spark):
    """Files without a number follow each other by receipt, then id; they are put in order over several tasks too."""
    names = ["Valor", "valor"]
    rows = [(f"C{i:04}", "cotizaciones", "C", None, None, json.dumps(env({names[i % 2]: "A"})), 0, "k") for i in range(300)]
    s = sd.file_schemas(spark.createDataFrame(rows, SCHEMA).repartition(7), *KEYS)
    assert sd.schema_changes(s, *KEYS[:1], "canal", "secuencia", "fecha_recepcion").count() == 299


def consistent(spark, contents):
    return sd.consistent_table(files(spark, contents), "cotizaciones", *KEYS).orderBy("secuencia", "posicion").collect()


def test_consistent_table(spark):
    a, b, c = consistent(spark, [
        env({"Fecha": "14/02/2021", "Valor": " A ", "Monto": "1,234.50", "EnSubasta": "sí", "Raro": 7}, {"FechaCotizacion": "2021-02-15", "valor": None, "Monto_Negociado": 3, "Cierre_Actual": "x"}),
        env({"Valor": "B", "Monto": 1, "Monto_Negociado": 2, "Fecha": "2021-02-15 y algo", "Descripcion": ""}),
    ])
    assert (str(a["fecha_cotizacion"]), a["valor"], a["monto_negociado"], a["en_subasta"], a["otros"], a["version"]) == ("2021-02-14", "A", 1234.5, True, {"Raro": "7"}, 1)
    assert (str(b["fecha_cotizacion"]), b["valor"], b["monto_negociado"], b["no_convertidos"], b["otros"]) == ("2021-02-15", None, 3.0, ["cierre_actual"], {"Cierre_Actual": "x"})
    assert (c["monto_negociado"], c["fecha_cotizacion"], c["no_convertidos"], c["otros"], c["version"]) == (1.0, None, ["fecha_cotizacion"], {"Monto_Negociado": "2", "Fecha": "2021-02-15 y algo"}, 2)
    assert consistent(spark, []) == []


def test_spellings_outside_the_rules_reach_their_column_by_what_they_replaced(spark):
    """A chain of unseen names: known, then X, then Y; the last is linked through the one between."""
    day = lambda n: {"Valor": "A", n: "14/02/2021", "Cierre_Actual": 1.5}
    rows = consistent(spark, [env(day("FechaCotizacion")), env(day("DiaRueda")), env(day("Jornada")), env({**day("Jornada"), "Lote": "x"})])
    assert {str(r["fecha_cotizacion"]) for r in rows} == {"2021-02-14"} and [r["version"] for r in rows] == [1, 2, 3, 4] and rows[3]["otros"] == {"Lote": "x"}


def test_registry(spark):
    s = sd.file_schemas(files(spark, [env({"Valor": "A", "Monto": "1"}), env({"valor": "A", "Monto": 1}), env({"Valor": "B", "Monto": "2"}), env({"DiaRueda": "x9"})]), *KEYS)
    r = {x["version"]: x for x in sd.registry(s, sd.schema_changes(s, "id_archivo", "canal", "secuencia", "fecha_recepcion"), "id_archivo", "fuente", "fecha_recepcion").collect()}
    assert {v: x["archivos"] for v, x in r.items()} == {1: 2, 2: 1, 3: 1}
    steps = lambda v: {(p["accion"], p["campo"], p["destino"]) for p in r[v]["pasos"]}
    assert steps(1) == {("renombrar", "Valor", "valor"), ("renombrar", "Monto", "monto_negociado"), ("convertir", "Monto", "monto_negociado")}
    assert steps(2) == {("renombrar", "valor", "valor"), ("renombrar", "Monto", "monto_negociado")}


def test_numbers_as_text(spark):
    cases = {"1,234.5": 1234.5, "1.234,5": 1234.5, "3,75": 3.75, "12": 12.0, "-0.5": -0.5, "S/ 1,000": 1000.0, "n.d.": None, "": None, "1.204.331": 1204331.0}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, v double")
    assert df.where(~sd.number_of_text(F.col("t")).eqNullSafe(F.col("v"))).collect() == []


def test_changes_of_the_test_files_against_brute_force(spark, root):
    from collections import defaultdict

    from lonja.queries import p2_found
    from lonja.sources import table

    kind = lambda v: None if v is None else "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "t"
    plain = lambda n: "".join(c for c in n.lower() if c.isalnum())
    datum = {(s, plain(n)): f.name for s, fs in sd.RULES.items() for f in fs for n in f.names}
    by = defaultdict(list)
    for r in table(spark, root, "archivos_crudos").collect():
        by[r["canal"]].append(r)
    want = set()
    for rows in by.values():
        before = None
        for r in sorted(rows, key=lambda r: r["secuencia"]):
            body = json.loads(r["contenido"])
            array = next(k for k, v in body.items() if isinstance(v, list))
            types = defaultdict(set)
            for record in body[array]:
                for k, v in record.items():
                    types[k].add(kind(v))
            types = {k: v - {None} for k, v in types.items()}
            if before:
                old_array, old = before
                name = lambda k: datum.get((r["fuente"], plain(k)), k)  # noqa: B023, E731
                new, gone = set(types) - set(old), set(old) - set(types)
                want |= {(r["id_archivo"], array, "renombrado")} if array != old_array else set()
                want |= {(r["id_archivo"], k, "renombrado" if name(k) in {name(g) for g in gone} else "agregado") for k in new}
                want |= {(r["id_archivo"], k, "eliminado") for k in gone if name(k) not in {name(n) for n in new}}
                want |= {(r["id_archivo"], k, "tipo") for k in set(types) & set(old) if types[k] and old[k] and types[k] != old[k]}
            before = array, types
    assert {tuple(r) for r in p2_found(spark, root).collect()} == want
