import pytest

from lonja.llm import names

MARKET = names.Vocabulary(
    ["COMPANIA MINERA", "COMPANIA SEGUROS", "EMPRESA ELECTRICA", "BANCO", "CEMENTOS", "CORPORACION", "INDUSTRIAS", "INMOBILIARIA", "INVERSIONES", "TRANSPORTES", "AGROINDUSTRIAL", "PESQUERA"],
    ["NORTE", "SUR", "ANDINA"],
)


@pytest.mark.parametrize("text,want", [
    ("Cia. Min. Belclaquhen Ostnatia del Sur Sociedad Anonima Cerrada", ("COMPANIA MINERA", "SUR", "SAC", "", ["BELCLAQUHEN", "OSTNATIA"])),
    ("SENNTEDHAL HINJADAL D. NORTE SAC (TRANSPTES.)", ("TRANSPORTES", "NORTE", "SAC", "", ["SENNTEDHAL", "HINJADAL"])),
    ("Bco  Zorncocusa Kanñaster (LNFZD)", ("BANCO", "", "", "LNFZD", ["ZORNCOCUSA", "KANNASTER"])),
    ("E. ELÉCT. TAMSSARTO & JARRIÍTA DEL NORTE S.A.", ("EMPRESA ELECTRICA", "NORTE", "SA", "", ["TAMSSARTO", "JARRIITA"])),
    ("Corporación Yanviapax Felmpereno d/Sur S.A.A.", ("CORPORACION", "SUR", "SAA", "", ["YANVIAPAX", "FELMPERENO"])),
    ("Inmobiliaria Felgural Quicemar S.A. y Subsidiarias", ("INMOBILIARIA", "", "SA", "", ["FELGURAL", "QUICEMAR"])),
    ("NarumbLir-cla", ("", "", "", "", ["NARUMBLIRCLA"])),
    ("DALRCAPAX CORSOYOC DEL SUR, SEGUROS S.A.", ("COMPANIA SEGUROS", "SUR", "SA", "", ["DALRCAPAX", "CORSOYOC"])),
    ("AGRO IND. NELCHAGAN LIRNCORENO AND.", ("AGROINDUSTRIAL", "ANDINA", "", "", ["NELCHAGAN", "LIRNCORENO"])),
    ("", ("", "", "", "", [])), ("S.A.", ("", "", "SA", "", [])), ("¿? 62", ("", "", "", "", [])),
])
def test_parse(text, want):
    assert MARKET.parse(text) == want


def test_lcs_against_brute_force():
    import random

    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("ABC") for _ in range(r.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert names.lcs(a, b) == t[-1][-1]


COMPANIES = [
    ("1", "Banco Zorncocusa Kanñaster S.A.A.", ["LNFZD"]), ("2", "Inversiones Zorncocusa Kanñaster del Sur S.A.", []), ("3", "Industrias Velvaral Velfraquén S.A.A.", []),
    ("4", "Compañía de Seguros Kelgritía Marssareno S.A.A.", []), ("5", "Cementos Hinfledal Dalssadal S.A.A.", []), ("6", "Cementos Hinfledal Dalssadal Andina S.A.A.", []), ("6", None, []),
]


def test_link(spark):
    typed = {
        "BCO ZORNCOCUSA KANNASTER": "1", "Zorncocusa Kannaster, Inversion d/Sur": "2", "Corporacion Zorncocusa Kannaster": None, "Inversiones Zorncocusa Kannaster del Norte": None,
        "Velfraquen Velvaral S.A.A. (INDUSTRIAS)": "3", "IND VELVARALVELFRAQUEN": "3", "VEEVARAL VELFRAQUEN S.A.A (INDUSTRIAS)": "3", "GRUPO KELGRIMARSSA": "4", "Cementos Hinfledal Dalssadal": "5",
        "Cementos Hinfledal Dalssadal And.": "6", "Otra Cosa": None, "": None, "   ": None, None: None, "Z" * 50_000: None,
    }
    df = spark.createDataFrame([(n, None, 1) for n in typed] * 2, "nombre string, sector string, ruc int")
    c = spark.createDataFrame(COMPANIES, "ruc string, nombre string, raices array<string>")
    got = {r["nombre"]: r["ruc"] for r in names.link(df.select("nombre", "sector"), c, MARKET).collect()}
    assert got == {k: v for k, v in typed.items() if v}
    assert names.link(df.select("nombre", "sector").limit(0), c, MARKET).count() == 0
    assert names.link(df.select("nombre", "sector"), c.limit(0)).count() == 0


def test_slips_where_many_companies_share_an_ending(spark):
    """Glued names with a slip in the first letters, and slips in the middle of both words."""
    firsts = ["Senllomes", "Bembone", "Calclagan", "Dorquipax", "Estuvirno", "Fimparde", "Gortalen", "Hinjadal", "Jubrecol", "Kelgritia", "Lirvarto", "Mosdenfu", "Nelchagan", "Ostnatia", "Pulverin"]
    companies = [(str(i), f"Agroindustrial {f} Gannamar del Norte S.A.", []) for i, f in enumerate(firsts)] + [("90", "Industrias Narmural Marjalva Andina", [])]
    typed = {"AGROINDUSTRIAL SENHLLOMESGANNAMAR DEL NORTE": "0", "ZENLLOMESGANNAMAR": "0", "AGROINDUSTRIAL ESUTVIRNOGANNAMAR": "4", "INDUSTRIAS NARMRUAL MARJLAVA ANDINA": "90", "PESQUERA ZENLLOMESGANNAMAR": None, "ZENLLOMESGANNAMAR DEL SUR": None}
    c = spark.createDataFrame(companies, "ruc string, nombre string, raices array<string>")
    got = {r["nombre"]: r["ruc"] for r in names.link(spark.createDataFrame([(n, None) for n in typed], "nombre string, sector string"), c, MARKET).collect()}
    assert got == {k: v for k, v in typed.items() if v}


def test_sector_decides_between_lines(spark):
    c = spark.createDataFrame([("1", "Banco Alfalfa Bembone S.A.", []), ("2", "Pesquera Alfalfa Bembone S.A.", [])], "ruc string, nombre string, raices array<string>")
    rows = [("Alfalfa Bembone", "Bancos"), ("Alfalfa Bembone SA", None), ("Banco Otro Nombre", "Bancos"), ("Pesquera Otro Nombre", "Industrial")]
    got = {r["nombre"]: r["ruc"] for r in names.link(spark.createDataFrame(rows, "nombre string, sector string"), c, MARKET).collect()}
    assert got == {"Alfalfa Bembone": "1"}


@pytest.mark.parametrize("token,word,yes", [
    ("BCO", "BANCO", True), ("TPTES", "TRANSPORTES", True), ("CMTOS", "CEMENTOS", True), ("LABS", "LABORATORIOS", True), ("NTE", "NORTE", True), ("INVERSION", "INVERSIONES", True), ("ANDINO", "ANDINA", True),
    ("CENT", "CENTRO", True), ("CENT", "CEMENTOS", False), ("NOR", "SUR", False), ("BARTUMAR", "BANCO", False), ("S", "SUR", False), ("", "SUR", False),
])
def test_words_cut_short_and_contracted(token, word, yes):
    assert bool(names.stands_for(token, word)) == yes


def test_letters_bound_the_ratio():
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("ABCDE") for _ in range(r.randrange(1, 9)))
    a, b = ([[word() for _ in range(r.randrange(1, 4))] for _ in range(3000)] for _ in range(2))
    ratios, ok = [names.core_ratio(x, y) for x, y in zip(a, b)], names.could_be([" ".join(x) for x in a], [" ".join(x) for x in b])
    assert all(o or x < names.LEAST_RATIO for x, o in zip(ratios, ok)) and not ok.all() and any(x >= names.LEAST_RATIO for x in ratios)


def test_every_order_of_words():
    assert names.core_ratio(["GAMMAS", "ALFA", "BETAN"], ["ALFA", "BETAN", "GAMMAS"]) > 0.99
    assert names.core_ratio(["F", "E", "D", "C", "B", "A"], ["A", "B", "C", "D", "E", "F"]) > 0.99


def test_invented_lines_and_regions_are_learned(spark):
    """Lines of business and regions that no list holds, from the companies' own names."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("bdfglmnrstv") + r.choice("aeiou") for _ in range(4)).capitalize()
    lines, regions = ["Astillero", "Compañía Vinícola", "Compañía Textil", "Relojería", "Molinos"], ["del Altiplano", "Ribereña", ""]
    cores = [f"{word()} {word()}" for _ in range(60)]
    companies = [(f"{i}", f"{lines[i % 5]} {cores[i // 2]} {regions[i % 3]} S.A.", []) for i in range(120)]
    c = spark.createDataFrame(companies, "ruc string, nombre string, raices array<string>")
    v = names.learn(c, "nombre")
    assert set(v.lines) == {"ASTILLERO", "COMPANIA VINICOLA", "COMPANIA TEXTIL", "RELOJERIA", "MOLINOS"} and set(v.regions) == {"ALTIPLANO", "RIBERENA"}
    core = lambda i: cores[i // 2]
    typed = {
        f"ASTILL. {core(0).upper()} ALTIPL.": "0", f"{core(1)}, Cía. Viníc. Ribereña": "1", f"Vinícola {core(1)} Rib.": "1", f"CIA TEXTIL {core(2).upper()}": "2", f"{core(3)} Relojerías d. Altiplano": "3",
        f"Molino {core(4)} (Otra nota) Ribereño": "4", f"Relojería {core(0)} del Altiplano": None, f"Molinos {core(4)} del Altiplano": None, "Molinos Otra Cosa": None,
    }
    got = {x["nombre"]: x["ruc"] for x in names.link(spark.createDataFrame([(n, None) for n in typed], "nombre string, sector string"), c).collect()}
    assert got == {k: v for k, v in typed.items() if v}
    assert names.learn(c.limit(0), "nombre").lines == {}
    sizes = names.blocks(spark.createDataFrame([(n,) for n in typed], "nombre string"), c, v)
    assert sizes.where("nombres > 0 and empresas > 0").count() == sizes.count() > 0
