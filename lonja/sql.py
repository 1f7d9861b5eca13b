"""SQL for DuckDB that says the same as the training-data queries, by plainer means."""

from __future__ import annotations

#: Minutes east of UTC of zone abbreviations, and months by three letters. Fixed values, stated apart from the operators'.
_ZONES = "Z 0, UTC 0, GMT 0, UT 0, WET 0, WEST 60, CET 60, CEST 120, EST -300, EDT -240, CST -360, CDT -300, MST -420, MDT -360, PST -480, PDT -420, PET -300, COT -300"
_MONTH_NAMES = "ene 1, jan 1, feb 2, mar 3, abr 4, apr 4, may 5, jun 6, jul 7, ago 8, aug 8, set 9, sep 9, oct 10, nov 11, dic 12, dec 12"
#: The fields of each source: name, type, and the spellings without case and punctuation. Fixed values.
_FIELDS = {
    "cotizaciones": """
fecha_cotizacion date fechacotizacion fecha fechasesion
valor text valor nemonico nemonicovalor codigovalor
descripcion text descripcion nombrevalor denominacionvalor
apertura_actual number aperturaactual apertura precioapertura
cierre_actual number cierreactual cierre preciocierre ultimo
cierre_anterior number cierreanterior
maxima_actual number maximaactual maxima
minima_actual number minimaactual minima
promedio_actual number promedioactual promedio
monto_negociado number montonegociado monto importenegociado
numero_operaciones number numerooperaciones nrooperaciones operaciones
codigo_isin text codigoisin isin
segmento text segmento
en_subasta boolean ensubasta""",
    "principales_cuentas": """
ruc text ruc numeroruc nroruc rucempresa
nombre_empresa text nombreempresa razonsocial
ejercicio number ejercicio anioejercicio anio
trimestre text trimestre numerotrimestre periodo
moneda text moneda tipomoneda
ciiu text ciiu codigociiu
tipo_sector text tiposector sector
activo_total number activototal totalactivo
pasivo_total number pasivototal totalpasivo
patrimonio_total number patrimoniototal totalpatrimonio
total_ingreso number totalingreso ingresototal totalingresos
utilidad_neta number utilidadneta resultadoneto
numero_empleados number numeroempleados nroempleados
auditor text auditor
consolidado boolean consolidado""",
}


def _pairs(text: str) -> list[list[str]]:
    return [x.split() for x in text.split(", ")]


_TICKER = "upper(trim({}))"
_RUC = r"regexp_replace(regexp_replace({}, '[.,]0*\s*$', ''), '[^0-9]', '', 'g')"

_REGISTRATIONS = f"""
reg as (
  select {_TICKER.format('valor')} t, fecha_cotizacion d, num_registro, max(monto_negociado) m, max(cierre_actual) c
  from cotizaciones where fecha_cotizacion is not null group by all),
daily as (
  select t, d, sum(cast(m as decimal(28,6))) a, sum(cast(c as decimal(28,6))) p, count(c) np, count(*) filas
  from reg where t is not null group by all)"""

_ROLLED = """
dense as (
  select b.t, b.d, a, p, coalesce(np, 0) np, coalesce(filas, 0) filas
  from (select t, cast(unnest(generate_series(min(d), max(d) + {tail}, interval 1 day)) as date) d from daily group by t) b
  left join daily using (t, d)),
rolled as (
  select t, d, filas,
    cast(coalesce(sum(a) over w7, 0) as double) monto_7d, cast(coalesce(sum(a) over w30, 0) as double) monto_30d,
    cast(sum(p) over w7 as double) / nullif(sum(np) over w7, 0) cierre_prom_7d,
    cast(sum(p) over w30 as double) / nullif(sum(np) over w30, 0) cierre_prom_30d
  from dense
  window w7 as (partition by t order by d rows between 6 preceding and current row),
         w30 as (partition by t order by d rows between 29 preceding and current row))"""

P1_ROLLING = f"""with {_REGISTRATIONS}, {_ROLLED.format(tail=0)}
select t entidad, d dia, filas, monto_7d, monto_7d / 7 monto_prom_7d, cierre_prom_7d, monto_30d, monto_30d / 30 monto_prom_30d, cierre_prom_30d
from rolled"""

P1_FOUND = f"""with {_REGISTRATIONS}, {_ROLLED.format(tail=29)},
j as (
  select s.valor, s.fecha, s.monto_7d s1, s.monto_30d s2, s.monto_prom_30d s3, s.cierre_prom_7d s4,
    coalesce(r.monto_7d, 0) t1, coalesce(r.monto_30d, 0) t2, coalesce(r.monto_30d / 30, 0) t3, r.cierre_prom_7d t4
  from acumulados s left join rolled r on {_TICKER.format('s.valor')} = r.t and s.fecha = r.d)
select distinct valor, strftime(fecha, '%Y-%m-%d') fecha from j
where s1 is null or abs(s1 - t1) > greatest(0.02, 0.005 * abs(t1)) or s2 is null or abs(s2 - t2) > greatest(0.02, 0.005 * abs(t2))
   or s3 is null or abs(s3 - t3) > greatest(0.02, 0.005 * abs(t3)) or (s4 is null) <> (t4 is null) or abs(s4 - t4) > 0.005 * abs(t4)"""

_P4 = f"""
listed as (
  select {_TICKER.format('nemonico_valor')} t, min(fecha_inscripcion) desde, max(fecha_baja) hasta
  from puente_ruc_nemonico p
  left join (select {_TICKER.format('nemonico_valor')} bt, max(fecha_baja) fecha_baja from bajas_valores group by 1) b on bt = {_TICKER.format('p.nemonico_valor')}
  group by 1),
missing as (
  select 'cotizaciones' tabla, cast(id_fila as varchar) clave, {_TICKER.format('valor')} clave_referida, strftime(fecha_cotizacion, '%Y-%m') periodo,
    case when t is null then 'inexistente' when fecha_cotizacion < desde then 'anterior' when fecha_cotizacion > hasta then 'posterior' end motivo
  from cotizaciones left join listed on t = {_TICKER.format('valor')} where valor is not null
  union all
  select 'principales_cuentas', id_registro, r, concat_ws('-', cast(ejercicio as varchar), 'ejercicio'), 'inexistente'
  from (select *, {_RUC.format('ruc')} r from principales_cuentas)
  where length(r) = 11 and r <> '00000000000' and r not in (select {_RUC.format('ruc')} from puente_ruc_nemonico where ruc is not null))"""

P4_FOUND = f"with {_P4} select distinct tabla, clave from missing where motivo is not null"
P4_REPORT = f"""with {_P4} select tabla, periodo, motivo, count(*) referencias, count(distinct clave_referida) claves
from missing where motivo is not null group by all"""

P5_FOUND = f"""with a as (select distinct id_fila, fecha_cotizacion f, {_TICKER.format('valor')} v, cierre_actual c, monto_negociado m from cotizaciones),
b as (select distinct id_fila, fecha_cotizacion f, {_TICKER.format('valor')} v, cierre_actual c, monto_negociado m from cotizaciones_copia),
j as (select id_fila, a.f af, b.f bf, a.v av, b.v bv, a.c ac, b.c bc, a.m am, b.m bm from a join b using (id_fila))
select id_fila, 'solo_cotizaciones' campo from a where id_fila not in (select id_fila from b)
union select id_fila, 'solo_copia' from b where id_fila not in (select id_fila from a)
union select id_fila, 'fecha_cotizacion' from j where af is distinct from bf
union select id_fila, 'valor' from j where av is distinct from bv
union select id_fila, 'cierre_actual' from j where (ac is null) <> (bc is null) or abs(ac - bc) > 0.005
union select id_fila, 'monto_negociado' from j where (am is null) <> (bm is null) or abs(am - bm) > 0.005"""


_LINES = {source: [line.split() for line in text.strip().splitlines()] for source, text in _FIELDS.items()}
_VALUES = ", ".join(f"('{source}', '{plain}', '{line[0]}', '{line[1]}')" for source, lines in _LINES.items() for line in lines for plain in line[2:])

_P2 = f"""rules(fuente, plano, dato, clase) as (values {_VALUES}),
arr as (select id_archivo, fuente, canal, secuencia, e.key arreglo, e.value registros from archivos_crudos, json_each(contenido) e where e.type = 'ARRAY'),
rec as (select id_archivo, fuente, cast(r.key as int) posicion, r.value registro from arr, json_each(registros) r),
fields as (
  select id_archivo, lower(trim(fuente)) fuente, f.key campo, lower(regexp_replace(f.key, '[^A-Za-z0-9]', '', 'g')) plano,
    string_agg(distinct case when f.type = 'BOOLEAN' then 'booleano' when f.type = 'VARCHAR' then 'texto' when f.type in ('OBJECT', 'ARRAY') then 'anidado' when f.type <> 'NULL' then 'numero' end, '|'
      order by case when f.type = 'BOOLEAN' then 'booleano' when f.type = 'VARCHAR' then 'texto' when f.type in ('OBJECT', 'ARRAY') then 'anidado' when f.type <> 'NULL' then 'numero' end) tipo
  from rec, json_each(registro) f group by all),
named as (select f.*, coalesce(r.dato, '?' || plano) dato, clase from fields f left join rules r using (fuente, plano))"""

P2_FOUND = f"""with {_P2},
files as (select id_archivo, canal, secuencia, arreglo, lag(id_archivo) over w previo, lag(arreglo) over w arreglo_previo from arr window w as (partition by canal order by secuencia)),
pairs as (
  select f.id_archivo, f.previo, n.campo, n.dato, n.tipo, o.campo viejo, o.tipo tipo_viejo
  from files f join named n on n.id_archivo = f.id_archivo left join named o on o.id_archivo = f.previo and o.campo = n.campo where f.previo is not null),
gone as (
  select f.id_archivo, o.campo, o.dato from files f join named o on o.id_archivo = f.previo
  left join named n on n.id_archivo = f.id_archivo and n.campo = o.campo where n.campo is null)
select id_archivo, campo, 'tipo' cambio from pairs where tipo <> tipo_viejo
union select id_archivo, campo, case when (id_archivo, dato) in (select (id_archivo, dato) from gone) then 'renombrado' else 'agregado' end from pairs where viejo is null
union select id_archivo, campo, 'eliminado' from gone where (id_archivo, dato) not in (select (id_archivo, dato) from pairs where viejo is null)
union select id_archivo, arreglo, 'renombrado' from files where arreglo <> arreglo_previo"""

_PRINTS = """
prints as (
  select id_archivo, count(campo) n_campos, coalesce(string_agg(case when tipo is null then campo else campo || ':' || tipo end, ',' order by campo), '') campos,
    sha256(any_value(arreglo) || coalesce(string_agg(chr(31) || campo || chr(30) || coalesce(tipo, ''), '' order by campo), '')) huella
  from arr left join fields using (id_archivo) group by 1)"""

P2_SCHEMAS = f"""with {_P2}, {_PRINTS}
select id_archivo, canal, secuencia, arreglo nombre_arreglo, n_campos, campos, huella from prints join arr using (id_archivo)"""

_VERSIONS = f"""{_PRINTS},
firsts as (
  select lower(trim(fuente)) fuente, huella, arreglo nombre_arreglo, count(*) archivos, min(struct_pack(d := fecha_recepcion is not null, r := fecha_recepcion, i := id_archivo)) primero
  from prints join arr using (id_archivo) join (select id_archivo, fecha_recepcion from archivos_crudos) using (id_archivo) group by all),
versions as (select *, row_number() over (partition by fuente order by primero, huella) as "version" from firsts)"""

P2_MIGRACIONES = f"""with {_P2}, {_VERSIONS},
own as (select v.fuente, v."version", archivos, nombre_arreglo, huella, campo, n.dato, clase, tipo from versions v join named n on n.id_archivo = v.primero.i),
steps as (
  select fuente, "version", archivos, nombre_arreglo, huella, 1 orden, 'renombrar' accion, campo, dato destino, null tipo, 'regla' origen from own where dato not like '?%'
  union all select fuente, "version", archivos, nombre_arreglo, huella, 2, 'convertir', campo, dato, clase, tipo from own
    where clase = 'date' and tipo is not null or tipo <> case clase when 'number' then 'numero' when 'boolean' then 'booleano' else 'texto' end
  union all select fuente, "version", archivos, nombre_arreglo, huella, 3, 'defecto', null, 'moneda', 'text', 'Soles' from versions v
    where fuente = 'principales_cuentas' and not exists (from own o where o.fuente = v.fuente and o."version" = v."version" and o.dato = 'moneda')
  union all select fuente, "version", archivos, nombre_arreglo, huella, 4, 'apartar', campo, 'otros', null, null from own where dato like '?%')
select * from steps"""

_SQUEEZED = r"regexp_replace(t, '[\s S/$]', '', 'g')"
_NUMBER = f"""try_cast(case when regexp_full_match({_SQUEEZED}, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]+)?') then replace({_SQUEEZED}, ',', '')
  when regexp_full_match({_SQUEEZED}, '[+-]?[0-9]{{1,3}}([.][0-9]{{3}})+,[0-9]+|[+-]?[0-9]{{1,3}}([.][0-9]{{3}}){{2,}}') then replace(replace({_SQUEEZED}, '.', ''), ',', '.')
  when regexp_full_match({_SQUEEZED}, '[+-]?[0-9]+,[0-9]+') then replace({_SQUEEZED}, ',', '.') else {_SQUEEZED} end as double)"""
_DAY = r"regexp_extract(trim(t), '^(\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d-\d\d-\d{4}|\d{4}/\d\d/\d\d|\d{8})(?:[T ]\d\d?:\d\d.*)?$', 1)"
_DATE = f"cast(try_strptime({_DAY}, ['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%Y/%m/%d', '%Y%m%d']) as date)"
_BOOL = "case when lower(trim(t)) in ('true', 'si', 'sí', 's', '1', 'verdadero') then true when lower(trim(t)) in ('false', 'no', 'n', '0', 'falso') then false end"
_OF = {"number": _NUMBER, "date": _DATE, "boolean": _BOOL, "text": "trim(t)"}


def _consistent(source: str) -> str:
    """One table of the source's records: the first filled spelling by name, cast; what is left over aside."""
    lines = _LINES[source]
    best = lambda line: f"max(case when dato = '{line[0]}' and r = 1 then {_OF[line[1]]} end)"
    columns = [f"coalesce({best(line)}, 'Soles') moneda" if line[0] == "moneda" else f"{best(line)} {line[0]}" for line in lines]
    # the converted value as text tells whether the first spelling was used
    lost = " ".join(f"when '{line[0]}' then ({_OF[line[1]]}) is null" for line in lines)
    rank = " ".join(f"when '{line[0]}' then {i}" for i, line in enumerate(lines))
    return f"""with {_P2}, {_VERSIONS},
cells as (
  select rec.id_archivo, posicion, f.key campo, case when f.type in ('VARCHAR') then json_extract_string(f.value, '$') else cast(f.value as varchar) end t, n.dato
  from rec, json_each(registro) f join named n on n.id_archivo = rec.id_archivo and n.campo = f.key where f.type <> 'NULL'),
placed as (
  select *, case when dato like '?%' then 0 else row_number() over (partition by id_archivo, posicion, dato order by campo) end r from cells where trim(t) <> ''),
judged as (select *, case dato {lost} else true end as aside from placed),
per as (
  select id_archivo, posicion, {", ".join(columns)}, coalesce(string_agg(dato, ',' order by case dato {rank} end) filter (r = 1 and aside), '') no_convertidos,
    coalesce(string_agg(campo || '=' || t, ';' order by campo || '=' || t) filter (aside or r <> 1), '') otros
  from judged group by 1, 2)
select rec.id_archivo, a.canal, a.secuencia, v."version", rec.posicion, {", ".join("coalesce(moneda, 'Soles') moneda" if line[0] == "moneda" else line[0] for line in lines)}, coalesce(no_convertidos, '') no_convertidos, coalesce(otros, '') otros
from rec join arr a using (id_archivo) join prints p using (id_archivo) join versions v on v.huella = p.huella and v.fuente = lower(trim(a.fuente)) left join per using (id_archivo, posicion)
where lower(trim(rec.fuente)) = '{source}'"""


_MONTH = "case lower({0}[:3]) " + " ".join(f"when '{m}' then {n}" for m, n in _pairs(_MONTH_NAMES)) + " end"
_ABBR = "case upper({0}) " + " ".join(f"when '{a}' then {n}" for a, n in _pairs(_ZONES)) + " end"
_T = r"(?:[ T](\d\d?):(\d\d)(?::(\d\d)(?:\.(\d+))?)?( ?[aApP]\.? ?[mM]\.?)?)?(?: ?([A-Z]{1,5}(?:[+-]\d\d?)?|[+-]\d\d:?\d\d))?$"
P3_FOUND = f"""with raw as (
  select 'cotizaciones_bronce' tabla, id_fila, 'fecharegistro' campo, trim(fecharegistro) x, zona_horaria z, orden_fecha = 'MDY' mdy from cotizaciones_bronce left join plazas using (plaza)
  union all select 'cotizaciones_bronce', id_fila, 'fechacotizacion', trim(fechacotizacion), zona_horaria, orden_fecha = 'MDY' from cotizaciones_bronce left join plazas using (plaza)
  union all select 'embig', num_linea, '_c0', trim(_c0), 'UTC', false from embig),
cut as (
  select *, regexp_extract(x, '^(\\d{{4}})-(\\d\\d)-(\\d\\d){_T}', ['y', 'm', 'd', 'h', 'i', 's', 'f', 'ap', 'o']) iso,
    regexp_extract(x, '^(\\d\\d?)[/-](\\d\\d?)[/-](\\d{{4}}|\\d\\d){_T}', ['p', 'q', 'y', 'h', 'i', 's', 'f', 'ap', 'o']) num,
    regexp_extract(x, '^(?:[A-Z][a-z]{{2}}, )?(\\d\\d?)[ -]?([A-Za-z]{{3}})\\.?[ -]?(\\d{{4}}|\\d\\d){_T}', ['d', 'n', 'y', 'h', 'i', 's', 'f', 'ap', 'o']) dmy,
    regexp_extract(x, '^([A-Z][a-z]{{2}}) (\\d\\d?), (\\d{{4}})$', ['n', 'd', 'y']) eng,
    regexp_extract(x, '^(\\d{{4}})(\\d\\d)(\\d\\d)(?:(\\d\\d)(\\d\\d)(\\d\\d))?$', ['y', 'm', 'd', 'h', 'i', 's']) com,
    regexp_extract(x, '^(?:/Date\\()?(\\d{{10}}|\\d{{13}})(?:\\)/)?$', 1) ep
  from raw where x is not null),
parts as (
  select tabla, id_fila, campo, z, ep,
    coalesce(nullif(iso.y, ''), nullif(num.y, ''), nullif(dmy.y, ''), nullif(eng.y, ''), nullif(com.y, '')) y,
    case when iso.y <> '' then try_cast(iso.m as int) when num.y <> '' then try_cast(case when mdy then num.p else num.q end as int) when dmy.y <> '' then {_MONTH.format('dmy.n')} when eng.y <> '' then {_MONTH.format('eng.n')} else try_cast(com.m as int) end m,
    case when iso.y <> '' then try_cast(iso.d as int) when num.y <> '' then try_cast(case when mdy then num.q else num.p end as int) when dmy.y <> '' then try_cast(dmy.d as int) when eng.y <> '' then try_cast(eng.d as int) else try_cast(com.d as int) end d,
    coalesce(try_cast(coalesce(nullif(iso.h, ''), nullif(num.h, ''), nullif(dmy.h, ''), nullif(com.h, '')) as int), 0) h, coalesce(try_cast(coalesce(nullif(iso.i, ''), nullif(num.i, ''), nullif(dmy.i, ''), nullif(com.i, '')) as int), 0) i,
    coalesce(try_cast(coalesce(nullif(iso.s, ''), nullif(num.s, ''), nullif(dmy.s, ''), nullif(com.s, '')) as int), 0) s, rpad(coalesce(nullif(iso.f, ''), nullif(num.f, ''), '0'), 6, '0') f,
    nullif(regexp_replace(lower(coalesce(nullif(iso.ap, ''), nullif(num.ap, ''), dmy.ap, '')), '[^apm]', '', 'g'), '') ap, coalesce(nullif(iso.o, ''), nullif(num.o, ''), nullif(dmy.o, '')) o
  from cut),
timed as (
  select *, case when ep <> '' then make_timestamp(cast(ep as bigint) * case length(ep) when 10 then 1000000 else 1000 end)
    when (ap is null or h between 1 and 12) and h < 24 and i < 60 and s < 60 then
      try_cast(lpad(cast(case when length(y) = 2 then cast(y as int) + case when cast(y as int) >= 90 then 1900 else 2000 end else cast(y as int) end as varchar), 4, '0') || '-' || lpad(cast(m as varchar), 2, '0') || '-' || lpad(cast(d as varchar), 2, '0') as date)
      + to_hours(case ap when 'am' then h % 12 when 'pm' then h % 12 + 12 else h end) + to_minutes(i) + to_seconds(s) + to_microseconds(cast(f as bigint)) end t,
    case when ep <> '' then 0 when o is not null then coalesce({_ABBR.format('o')}, (case when contains(o, '-') then -1 else 1 end) * (60 * try_cast(regexp_extract(o, '[+-](\\d\\d?)', 1) as int) + coalesce(try_cast(regexp_extract(o, '[+-]\\d\\d:?(\\d\\d)', 1) as int), 0))) end away
  from parts),
utc as (
  select *, case when away is not null then t - to_minutes(away) else timezone('UTC', case when timezone(z, timezone(z, t) - interval 1 hour) = t then timezone(z, t) - interval 1 hour else timezone(z, t) end) end u
  from timed where t is not null and year(t) between 1900 and 2099)
select tabla, id_fila, campo, case when campo = 'fecharegistro' then strftime(u, '%Y-%m-%d %H:%M:%S.%f') else strftime(case when away is not null then timezone(z, timezone('UTC', u)) else t end, '%Y-%m-%d') end instante
from utc where u is not null"""

SQL = {
    "p2_schemas": P2_SCHEMAS, "p2_migraciones": P2_MIGRACIONES, "p2_cotizaciones": _consistent("cotizaciones"), "p2_principales_cuentas": _consistent("principales_cuentas"),
    "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p1_found": P1_FOUND, "p1_rolling": P1_ROLLING, "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p5_found": P5_FOUND,
}
