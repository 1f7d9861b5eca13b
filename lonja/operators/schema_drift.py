"""Files whose records change shape over time: fingerprints, change list, migration steps and one consistent table.

A file's fingerprint is the name of its array and the names and JSON types of its fields. The distinct fingerprints of a
source are its versions, in the order of their first receipt. Each version has explicit steps to the consistent table:
rename, convert, default, or keep aside. A file is routed by its fingerprint and goes through the steps of its version.
Names are known by rule or, if no rule has them, by what they took the place of. The JSON is parsed in the JVM (variant
type); no Python runs per row and no schema is inferred by an extra pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.operators.shared import kept, numbered, previous_rows, small


@dataclass(frozen=True)
class Field:
    """A migration rule: the consistent name and type, the names under which files carry it, and the default."""

    name: str
    kind: str  # text, number, boolean, date
    names: tuple[str, ...]
    default: object = None


#: The migration rules per source: every spelling (case kept) that the raw files are known to use. Fixed values.
RULES: dict[str, tuple[Field, ...]] = {
    "cotizaciones": (
        Field("fecha_cotizacion", "date", ("FechaCotizacion", "Fecha_Cotizacion", "Fecha", "FechaSesion", "fechaCotizacion", "fecha")),
        Field("valor", "text", ("Valor", "valor", "Nemonico", "nemonico", "NemonicoValor", "CodigoValor")),
        Field("descripcion", "text", ("Descripcion", "descripcion", "NombreValor", "DenominacionValor")),
        Field("apertura_actual", "number", ("Apertura_Actual", "AperturaActual", "Apertura", "aperturaActual", "PrecioApertura")),
        Field("cierre_actual", "number", ("Cierre_Actual", "CierreActual", "Cierre", "cierreActual", "PrecioCierre", "Ultimo")),
        Field("cierre_anterior", "number", ("Cierre_Anterior", "CierreAnterior", "cierreAnterior")),
        Field("maxima_actual", "number", ("Maxima_Actual", "MaximaActual", "Maxima")),
        Field("minima_actual", "number", ("Minima_Actual", "MinimaActual", "Minima")),
        Field("promedio_actual", "number", ("Promedio_Actual", "PromedioActual", "Promedio")),
        Field("monto_negociado", "number", ("Monto_Negociado", "MontoNegociado", "Monto", "montoNegociado", "ImporteNegociado")),
        Field("numero_operaciones", "number", ("NumeroOperaciones", "numeroOperaciones", "NroOperaciones", "Operaciones")),
        Field("codigo_isin", "text", ("CodigoISIN", "CodigoIsin", "ISIN", "codigoIsin")),
        Field("segmento", "text", ("Segmento", "segmento")),
        Field("en_subasta", "boolean", ("EnSubasta", "enSubasta")),
    ),
    "principales_cuentas": (
        Field("ruc", "text", ("RUC", "Ruc", "ruc", "NumeroRUC", "NroRuc", "NumeroRuc", "ruc_empresa", "RucEmpresa")),
        Field("nombre_empresa", "text", ("NombreEmpresa", "Nombre_Empresa", "nombreEmpresa", "RazonSocial", "razonSocial")),
        Field("ejercicio", "number", ("Ejercicio", "ejercicio", "AnioEjercicio", "Anio")),
        Field("trimestre", "text", ("Trimestre", "trimestre", "NumeroTrimestre", "Periodo")),
        Field("moneda", "text", ("Moneda", "moneda", "TipoMoneda"), "Soles"),
        Field("ciiu", "text", ("CIIU", "Ciiu", "ciiu", "CodigoCIIU")),
        Field("tipo_sector", "text", ("TipoSector", "tipoSector", "Sector")),
        Field("activo_total", "number", ("ActivoTotal", "Activo_Total", "TotalActivo", "activoTotal")),
        Field("pasivo_total", "number", ("PasivoTotal", "Pasivo_Total", "TotalPasivo", "pasivoTotal")),
        Field("patrimonio_total", "number", ("PatrimonioTotal", "Patrimonio_Total", "TotalPatrimonio")),
        Field("total_ingreso", "number", ("TotalIngreso", "Total_Ingreso", "IngresoTotal", "TotalIngresos")),
        Field("utilidad_neta", "number", ("UtilidadNeta", "Utilidad_Neta", "ResultadoNeto", "utilidadNeta")),
        Field("numero_empleados", "number", ("NumeroEmpleados", "numeroEmpleados", "NroEmpleados")),
        Field("auditor", "text", ("Auditor", "auditor")),
        Field("consolidado", "boolean", ("Consolidado", "consolidado")),
    ),
}


def squeezed(name: Column) -> Column:
    """A field name without case and punctuation."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _canonical(source: Column, name: Column) -> Column:
    """The consistent name by the rules, or NULL."""
    pairs = {f"{s}/{''.join(c for c in n.lower() if c.isalnum())}": f.name for s, fields in RULES.items() for f in fields for n in f.names}
    known = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.try_element_at(known, F.concat_ws("/", F.lower(F.trim(source)), squeezed(name)))


def _arrays(files: DataFrame, idc: str, content: str, carry: list[str]) -> DataFrame:
    """The arrays of records at the root of each file: ``nombre_arreglo`` and ``registros`` (variant)."""
    spark = files.sparkSession
    parsed = files.select(*dict.fromkeys([idc, *carry]), F.try_parse_json(F.col(content)).alias("__v"))
    rooted = parsed.where("__v is not null").withColumn(
        "__v", F.when(F.schema_of_variant("__v").startswith("ARRAY"), F.parse_json(F.concat(F.lit('{"":'), F.col("__v").cast("string"), F.lit("}")))).otherwise(F.col("__v"))
    )
    return rooted.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer())).where(F.schema_of_variant("value").startswith("ARRAY")).select(*dict.fromkeys([idc, *carry]), F.col("key").alias("nombre_arreglo"), F.col("value").alias("registros"))


def file_schemas(files: DataFrame, idc: str, source: str, channel: str, order: str, received: str, content: str) -> DataFrame:
    """One row per readable file: its fingerprint.

    Columns: the five key columns, ``nombre_arreglo``, ``campos`` (array of name, canonical name, JSON type and shape of
    the texts, by name) and ``huella`` (SHA-256 of the array's name and the fields' names and types). A field is in a file if any record has it; a field with nulls only has
    type NULL. Text that is no JSON, and files without an array, give no row; an empty array gives no fields. A bare
    array of records counts as an array without name.
    """
    spark = files.sparkSession
    carry = [source, channel, order, received]
    arrays = _arrays(files, idc, content, carry)
    records = arrays.lateralJoin(spark.tvf.variant_explode_outer(F.col("registros").outer())).select(idc, *carry, "nombre_arreglo", F.col("value").alias("__r"))
    fields = records.lateralJoin(spark.tvf.variant_explode_outer(F.col("__r").outer())).select(idc, *carry, "nombre_arreglo", "key", F.schema_of_variant("value").alias("t"), F.col("value").alias("v"))
    kind = (
        F.when(F.col("t").rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)"), "numero")
        .when(F.col("t") == "STRING", "texto")
        .when(F.col("t") == "BOOLEAN", "booleano")
        .when(F.col("t") != "VOID", "anidado")
    )
    shape = F.regexp_replace(F.regexp_replace(F.try_variant_get("v", "$", "string"), "[0-9]+", "9"), r"\p{L}+", "a")
    per_field = fields.groupBy(idc, *carry, "nombre_arreglo", "key").agg(F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("tipo"), F.min(F.when(F.col("t") == "STRING", shape)).alias("forma"))
    struct = F.when(
        F.col("key").isNotNull(),
        F.struct(F.col("key").alias("nombre"), F.coalesce(_canonical(F.col(source), F.col("key")), F.concat(F.lit("?"), squeezed(F.col("key")))).alias("canonico"), F.nullif("tipo", F.lit("")).alias("tipo"), F.col("forma")),
    )
    per_file = per_field.groupBy(idc, *carry, "nombre_arreglo").agg(F.array_sort(F.collect_list(struct)).alias("campos"))
    shown = F.transform("campos", lambda x: F.concat_ws("\x1e", x["nombre"], F.coalesce(x["tipo"], F.lit(""))))
    return per_file.withColumn("huella", F.sha2(F.concat_ws("\x1f", F.array("nombre_arreglo"), shown), 256))


def _alike(a: Column, r: Column) -> Column:
    """Whether two fields are one datum: the same canonical name; for a name without a rule, evidence of name or values.

    The evidence: both have one JSON type, and one name is within the other or the texts have one shape with digits.
    """
    sa, sr = squeezed(a["nombre"]), squeezed(r["nombre"])
    no_rule = a["canonico"].startswith("?") | r["canonico"].startswith("?")
    shape = a["forma"].eqNullSafe(r["forma"]) & F.contains(F.coalesce(a["forma"], F.lit("")), F.lit("9"))
    name = (F.least(F.length(sa), F.length(sr)) >= 4) & (F.contains(sa, sr) | F.contains(sr, sa))
    return (a["canonico"] == r["canonico"]) | (no_rule & a["tipo"].eqNullSafe(r["tipo"]) & (name | shape))


def schema_changes(schemas: DataFrame, idc: str, channel: str, order: str, received: str, source: str = "fuente") -> DataFrame:
    """One row (``id``, ``fuente``, ``campo``, ``antes``, ``cambio``) per difference between a file and the one before it in its channel.

    ``cambio``: agregado, eliminado, renombrado (same datum under another name; also of the array) or tipo. A type is
    compared with the last one seen in the file before; fields with nulls only have none. Files of one channel with
    the same order number (or none) follow each other by time of receipt, then id. A channel may hold any share of the
    files: it is put in order in ranges. The first file of a channel has no changes.
    """
    payload = F.struct("nombre_arreglo", "campos")
    pairs = previous_rows(schemas, [channel], order, [received, idc], payload, "previo").where("previo is not null")
    cur, old = F.col("campos"), F.col("previo.campos")
    names = lambda a: F.transform(a, lambda x: x["nombre"])
    added = F.filter(cur, lambda x: ~F.array_contains(names(old), x["nombre"]))
    gone = F.filter(old, lambda x: ~F.array_contains(names(cur), x["nombre"]))
    row = lambda name, before, what: F.struct(name.alias("campo"), before.alias("antes"), F.lit(what).alias("cambio"))
    none = F.lit(None).cast("string")
    two = pairs.select(F.col(idc).alias("id"), F.col(source).alias("fuente"), "nombre_arreglo", "previo", "campos", added.alias("a"), gone.alias("g"))
    a, g = F.col("a"), F.col("g")
    old, cur = F.col("previo.campos"), F.col("campos")
    renamed = F.filter(a, lambda x: F.exists(g, lambda y: _alike(x, y)))
    parts = [
        F.transform(F.filter(a, lambda x: ~F.exists(g, lambda y: _alike(x, y))), lambda x: row(x["nombre"], none, "agregado")),
        F.transform(F.filter(g, lambda y: ~F.exists(a, lambda x: _alike(x, y))), lambda y: row(y["nombre"], none, "eliminado")),
        F.transform(renamed, lambda x: row(x["nombre"], F.filter(g, lambda y: _alike(x, y))[0]["nombre"], "renombrado")),
        F.transform(
            F.filter(cur, lambda x: F.exists(old, lambda y: (y["nombre"] == x["nombre"]) & (y["tipo"] != x["tipo"]))),
            lambda x: row(x["nombre"], F.filter(old, lambda y: y["nombre"] == x["nombre"])[0]["tipo"], "tipo"),
        ),
        F.when(F.col("nombre_arreglo") != F.col("previo.nombre_arreglo"), F.array(row(F.col("nombre_arreglo"), F.col("previo.nombre_arreglo"), "renombrado"))).otherwise(F.array().cast("array<struct<campo:string,antes:string,cambio:string>>")),
    ]
    return two.select("id", "fuente", F.explode(F.concat(*parts)).alias("c")).select("id", "fuente", "c.*")


def names_by_evidence(changes: DataFrame, source: str = "fuente") -> DataFrame:
    """(``fuente``, ``plano``, ``dato``): the consistent field of names without a rule, from what replaced what.

    A name that took the place of a known one, or gave its place to one, is that field; a chain of such replacements is
    followed to its end. Where a name has several, the one seen most often is taken, then the least. Names are compared
    without case and punctuation. The table has a row per distinct name at most.
    """
    plain = lambda c: F.concat(F.lit("?"), squeezed(c))
    known = lambda c: F.coalesce(_canonical(F.col(source), c), plain(c))
    renamed = changes.where("cambio = 'renombrado' and antes is not null and antes <> ''").select(F.lower(F.trim(F.col(source))).alias("fuente"), known(F.col("campo")).alias("a"), known(F.col("antes")).alias("b"))
    one = renamed.unionByName(renamed.select("fuente", F.col("b").alias("a"), F.col("a").alias("b"))).where("a like '?%' and a <> b").groupBy("fuente", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    links = kept(one)
    found = links.where("b not like '?%'").groupBy("fuente", "a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("dato"))
    found = kept(found)
    while True:  # each turn follows the chains one link further; names are few, and each is found once
        reached = found.select("fuente", F.col("a").alias("b"), "dato")
        more = links.join(reached, ["fuente", "b"]).join(found.select("fuente", "a"), ["fuente", "a"], "left_anti").groupBy("fuente", "a", "dato").agg(F.sum("n").alias("n"))
        more = kept(more.groupBy("fuente", "a").agg(F.min_by("dato", F.struct(-F.col("n"), F.col("dato"))).alias("dato")))
        if more.isEmpty():
            return found.select("fuente", F.expr("substring(a, 2)").alias("plano"), "dato")
        found = kept(found.unionByName(more))


STEP = "struct<orden:int,accion:string,campo:string,destino:string,tipo:string,origen:string>"


def registry(schemas: DataFrame, changes: DataFrame, idc: str, source: str, received: str) -> DataFrame:
    """One row per version of a source: ``fuente``, ``version``, ``huella``, ``nombre_arreglo``, ``archivos``, ``pasos``.

    Versions are numbered in the order of their first receipt, then id, so a file that comes later never renumbers them.
    ``pasos`` are the steps (``orden``, ``accion``, ``campo``, ``destino``, ``tipo``, ``origen``), in this order:
    ``renombrar`` a field (origen: regla or evidencia), ``convertir`` its JSON type to the consistent one, set the
    ``defecto`` of a field the version lacks, and ``apartar`` a field that no rule and no evidence names.
    """
    first = F.struct(F.col(received).isNotNull(), F.col(received), F.col(idc).cast("string"))
    per = schemas.groupBy(F.lower(F.trim(F.col(source))).alias("fuente"), "huella", "nombre_arreglo").agg(F.min(first).alias("__first"), F.min_by("campos", first).alias("campos"), F.count_distinct(idc).alias("archivos"))
    versions = numbered(per, ["fuente"], ["__first", "huella"], "version")
    learned = names_by_evidence(changes, source).groupBy("fuente").agg(F.map_from_entries(F.collect_list(F.struct("plano", "dato"))).alias("aprendidos"))
    v = versions.join(small(learned), "fuente", "left")
    flat = [(s, f) for s, fields in RULES.items() for f in fields]
    kinds = F.create_map(*(x for s, f in flat for x in (F.lit(f"{s}/{f.name}"), F.lit(f.kind))))
    native = {"number": "numero", "boolean": "booleano", "text": "texto", "date": "texto"}
    takes = F.create_map(*(F.lit(x) for kv in native.items() for x in kv))
    defaults = {s: [f for f in fields if f.default is not None] for s, fields in RULES.items()}
    by_evidence = lambda x: F.try_element_at(F.coalesce("aprendidos", F.create_map().cast("map<string,string>")), squeezed(x["nombre"]))
    target = lambda x: F.when(~x["canonico"].startswith("?"), x["canonico"]).otherwise(by_evidence(x))
    kind = lambda x: F.try_element_at(kinds, F.concat_ws("/", F.col("fuente"), target(x)))
    step = lambda what, field, to, kind_, why, n: F.struct(F.lit(n).alias("orden"), F.lit(what).alias("accion"), field.alias("campo"), to.alias("destino"), kind_.alias("tipo"), why.alias("origen"))
    none = F.lit(None).cast("string")
    rename = F.transform(F.filter("campos", lambda x: target(x).isNotNull()), lambda x: step("renombrar", x["nombre"], target(x), none, F.when(x["canonico"].startswith("?"), "evidencia").otherwise("regla"), 1))
    odd = F.filter("campos", lambda x: target(x).isNotNull() & x["tipo"].isNotNull() & ((x["tipo"] != F.try_element_at(takes, kind(x))) | (kind(x) == "date")))
    convert = F.transform(odd, lambda x: step("convertir", x["nombre"], target(x), kind(x), x["tipo"], 2))
    lacking = F.lit(None)
    has = lambda f: F.exists("campos", lambda x: F.coalesce(target(x) == f.name, F.lit(False)))
    for s, fields in defaults.items():
        rows = F.array(*(F.when(~has(f), step("defecto", none, F.lit(f.name), F.lit(f.kind), F.lit(str(f.default)), 3)) for f in fields)).cast(f"array<{STEP}>")
        lacking = F.when(F.col("fuente") == s, F.array_compact(rows)).otherwise(lacking)
    aside = F.transform(F.filter("campos", lambda x: target(x).isNull()), lambda x: step("apartar", x["nombre"], F.lit("otros"), none, none, 4))
    steps = F.concat(rename.cast(f"array<{STEP}>"), convert.cast(f"array<{STEP}>"), F.coalesce(lacking, F.array().cast(f"array<{STEP}>")), aside.cast(f"array<{STEP}>"))
    return v.select("fuente", "version", "huella", "nombre_arreglo", "archivos", steps.alias("pasos"))


def number_of_text(t: Column) -> Column:
    """A number written as text: thousands separators out, a decimal comma turned into a point; else NULL."""
    t = F.regexp_replace(t, r"[\s S/$]", "")
    grouped = F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(t, ",", "")).when(
        t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$|^[+-]?\d{1,3}(\.\d{3}){2,}$"), F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    ).when(t.rlike(r"^[+-]?\d+,\d+$"), F.regexp_replace(t, ",", "."))
    return F.coalesce(grouped, t).try_cast("double")


def _cast(text: Column, kind: str) -> Column:
    """The value of a text, or NULL if it is not wholly one of the kind."""
    t = F.trim(text)
    if kind == "number":
        return number_of_text(text)
    if kind == "boolean":
        low = F.lower(t)
        return F.when(low.isin("true", "si", "sí", "s", "1", "verdadero"), True).when(low.isin("false", "no", "n", "0", "falso"), False)
    if kind == "date":
        day = F.regexp_extract(t, r"^(\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d-\d\d-\d{4}|\d{4}/\d\d/\d\d|\d{8})(?:[T ]\d\d?:\d\d.*)?$", 1)
        return F.coalesce(*(F.to_date(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit(p))) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd")))
    return F.nullif(t, F.lit(""))


def consistent_table(files: DataFrame, which: str, idc: str, source: str, channel: str, order: str, received: str, content: str) -> DataFrame:
    """All records of the files of source ``which`` in one table with the columns of its rules, and the ``version`` they came in.

    Each file is routed by its fingerprint to its version in the registry, and each record goes through that version's
    steps: rename, convert, default. Nothing read is lost: ``otros`` (map of text) keeps, under their raw names, values
    of fields without a rule, values that can't be converted (their columns are NULL and named in ``no_convertidos``),
    and all but the first, by name, of several values for one column. The files are parsed twice, for the fingerprints
    and for the records; their contents are not shuffled.
    """
    spark = files.sparkSession
    rules = RULES[which]
    own = files.where(F.lower(F.trim(F.col(source))) == which)
    schemas = kept(file_schemas(own, idc, source, channel, order, received, content))
    versions = registry(schemas, schema_changes(schemas, idc, channel, order, received, source), idc, source, received)
    rename = F.map_from_entries(F.transform(F.filter("pasos", lambda p: p["accion"] == "renombrar"), lambda p: F.struct(p["campo"], p["destino"])))
    route = schemas.select(idc, "nombre_arreglo", "huella").dropDuplicates([idc, "nombre_arreglo"]).join(small(kept(versions.select("huella", "nombre_arreglo", "version", rename.alias("__pasos")))), ["huella", "nombre_arreglo"]).drop("huella")
    arrays = _arrays(own, idc, content, [channel, order]).join(small(kept(route)), [idc, "nombre_arreglo"])
    records = arrays.lateralJoin(spark.tvf.variant_explode(F.col("registros").outer())).select(idc, channel, order, "version", "__pasos", F.col("pos").alias("posicion"), F.col("value").alias("__r"))
    raw = records.withColumn("__m", F.coalesce(F.try_variant_get("__r", "$", "map<string,string>"), F.create_map().cast("map<string,string>")))
    m = F.col("__m")
    filled = lambda v: v.isNotNull() & (F.trim(v) != "")
    under = lambda f: F.map_filter(m, lambda k, v: (F.try_element_at(F.col("__pasos"), k) == f.name) & filled(v))
    keys = {f.name: F.get(F.array_sort(F.map_keys(under(f))), F.lit(0)) for f in rules}
    named = raw.select(idc, channel, order, "version", "posicion", "__m", *(k.alias(f"__k_{n}") for n, k in keys.items()))
    named = named.select("*", *(_cast(F.try_element_at(m, F.col(f"__k_{f.name}")), f.kind).alias(f"__v_{f.name}") for f in rules))
    value, key = lambda f: F.col(f"__v_{f.name}"), lambda f: F.col(f"__k_{f.name}")
    used = F.array_compact(F.array(*(F.when(value(f).isNotNull(), key(f)) for f in rules)))
    failed = F.array_compact(F.array(*(F.when(key(f).isNotNull() & value(f).isNull(), F.lit(f.name)) for f in rules)))
    out = [(F.coalesce(value(f), F.lit(f.default)) if f.default is not None else value(f)).alias(f.name) for f in rules]
    return named.withColumn("__used", used).select(idc, channel, order, "version", "posicion", *out, failed.alias("no_convertidos"), F.map_filter(m, lambda k, v: filled(v) & ~F.array_contains(F.col("__used"), k)).alias("otros"))
