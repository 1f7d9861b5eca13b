"""SQL for DuckDB that says the same as the queries on names and texts, where SQL can say it."""

from __future__ import annotations

_FILINGS = r"""
f as (
  select id_registro, regexp_replace(regexp_replace(c.ruc, '[.,]0*\s*$', ''), '[^0-9]', '', 'g') ruc, ejercicio,
    case when regexp_matches(upper(trim(trimestre)), '^(T?1|1ER|I |PRIMER)') or upper(trim(trimestre)) = 'I' then 1
         when regexp_matches(upper(trim(trimestre)), '^(T?2|2DO|II |SEGUNDO)') then 2
         when regexp_matches(upper(trim(trimestre)), '^(T?3|3ER|III |TERCER)') then 3
         when regexp_matches(upper(trim(trimestre)), '^(T?4|4TO|IV |CUARTO)') then 4 end trimestre,
    case upper(trim(tipo_informacion))[1] when 'I' then 'INDIVIDUAL' when 'C' then 'CONSOLIDADA' end tipo_informacion,
    {numbers}, case when lower(trim(ciiu)) not in ('', '-', 'n.d.') then trim(ciiu) end ciiu, t.prioridad, fecha_registro
  from principales_cuentas c left join fuentes_confianza t on upper(trim(t.fuente_datos)) = upper(trim(c.fuente_datos))),
g as (select * from f where length(ruc) = 11 and ruc <> '00000000000' and ejercicio is not null and trimestre is not null and tipo_informacion is not null)""".replace(
    "{numbers}", ", ".join(f"case when not isnan({c}) then {c} end {c}" for c in ("activo_total", "patrimonio_total", "total_ingreso", "utilidad_neta", "pasivo_total"))
)

_FIELDS = ("activo_total", "patrimonio_total", "total_ingreso", "utilidad_neta", "pasivo_total", "ciiu")
_BEST = " union all ".join(
    f"select ruc, ejercicio, trimestre, tipo_informacion, '{c}' campo, id_registro, row_number() over (partition by ruc, ejercicio, trimestre, tipo_informacion order by prioridad nulls last, fecha_registro desc nulls last, id_registro) r from g where {c} is not null"
    for c in _FIELDS
)

P7_FOUND = f"""with {_FILINGS},
n as (select ruc, ejercicio, trimestre, tipo_informacion, min(id_registro) id_grupo from g group by all having count(*) > 1)
select id_grupo, campo, id_registro from ({_BEST}) join n using (ruc, ejercicio, trimestre, tipo_informacion) where r = 1"""

P7_RECORDS = f"""with {_FILINGS},
c as (select *, {" + ".join(f"cast({x} is not null as int)" for x in _FIELDS)} completitud from g)
select ruc, ejercicio, trimestre, tipo_informacion, id_registro, completitud from c
qualify row_number() over (partition by ruc, ejercicio, trimestre, tipo_informacion order by completitud desc, prioridad nulls last, fecha_registro desc nulls last, id_registro) = 1"""

SQL = {"p7_found": P7_FOUND, "p7_records": P7_RECORDS}
