from pyspark.sql import functions as F

from lonja.llm import language as lg
from lonja.sources import table


def test_labels(spark):
    cases = {"es-PE": "es", "SPA": "es", "Español": "es", " EN ": "en", "en_US": "en", "ita": "it", "Alemán": "de", "und": None, "??": None, "": None, None: None, "xx": None}
    df = spark.createDataFrame(list(cases.items()), "t string, w string")
    assert df.where(~lg.label(F.col("t")).eqNullSafe(F.col("w"))).collect() == []


def test_paragraphs():
    assert lg.paragraphs("a\n\nb\n \n\n c\nd") == ["a", "b", "c\nd"] and lg.paragraphs(" ") == []


def model(spark, root):
    d = table(spark, root.replace("sf0.001", "sf0.01"), "documents")
    return lg.fit(d, "doc_id", "text", d["lang"]), d


def test_held_out_accuracy_and_mixtures(spark, root):
    m, d = model(spark, root)
    known = {
        "es": "La junta general de accionistas aprobó por unanimidad los estados financieros del año anterior.", "pt": "A assembleia geral de acionistas aprovou por unanimidade as demonstrações financeiras do ano anterior.",
        "fr": "L'assemblée générale des actionnaires a approuvé à l'unanimité les comptes de l'exercice précédent.", "it": "L'assemblea generale degli azionisti ha approvato all'unanimità il bilancio dell'esercizio precedente.",
        "de": "Die Hauptversammlung der Aktionäre hat den Jahresabschluss des vergangenen Geschäftsjahres einstimmig gebilligt.", "en": "The general meeting of shareholders unanimously approved the financial statements of the previous year.",
    }
    rows = [(f"d{l}", t, l) for l, t in known.items()] + [("mixed", f"{known['es']} {known['es']}\n\n{known['en']}\n\n12,5 | 3", "pt"), ("none", "12 | 3", "es"), ("blank", " ", "es"), ("null", None, "es"), ("upper", known["fr"].upper(), None), ("long", (known["de"] + " ") * 3000, "de")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc string, text string, lang string, id int, segmento string")
    got = {(r["id"], r["segmento"]): r for r in lg.detect(docs, "doc", "text", docs["lang"], m).collect()}
    assert all(got[f"d{l}", -1]["lang"] == l for l in known) and got["upper", -1]["lang"] == "fr" and got["long", -1]["lang"] == "de"
    assert [got["mixed", k]["lang"] for k in (-1, 0, 1)] == ["es", "es", "en"] and got["mixed", -1]["mezclado"] and ("mixed", 2) not in got
    assert not {"none", "blank", "null"} & {k[0] for k in got} and all(0 < r["confianza"] <= 1 for r in got.values())
    # documents outside the training sample agree with their labels, but for the few that are wrong
    told = lg.detect(d, "doc_id", "text", d["lang"], m).where("segmento = -1 and etiqueta is not null")
    n, same = told.agg(F.count(F.lit(1)), F.count_if(F.col("etiqueta") == F.col("lang"))).first()
    assert same / n > 0.9


def test_empty(spark, root):
    _, d = model(spark, root)
    none = d.limit(0)
    m = lg.fit(none, "doc_id", "text", none["lang"])
    assert lg.detect(none, "doc_id", "text", none["lang"], m).count() == 0


def test_short_paragraphs_lean_on_their_document(spark, root):
    m, _ = model(spark, root)
    es = "La junta general de accionistas aprobó por unanimidad los estados financieros del año anterior."
    docs = spark.createDataFrame([("a", f"{es}\n\nNo\n\n{es}", None), ("b", f"{es}\n\nThe board approved the plan\n\n{es}", None), ("c", "No", None), ("d", es + " " + "x" * 100_000, None)], "doc string, text string, lang string")
    got = {(r["id"], r["segmento"]): r["lang"] for r in lg.detect(docs, "doc", "text", docs["lang"], m).collect()}
    assert got["a", 1] == "es" and got["b", 1] == "en" and ("c", -1) in got and ("d", -1) in got


def test_confidence_means_what_it_says(spark, root):
    """Where labels and model were fitted on other documents, documents of confidence p have about a share p of right labels or more."""
    m, d = model(spark, root)
    told = lg.detect(d, "doc_id", "text", d["lang"], m).where("segmento = -1 and etiqueta is not null and not mezclado")
    for low, least in ((0.5, 0.5), (0.9, 0.85)):
        n, same = told.where(F.col("confianza") >= low).agg(F.count(F.lit(1)), F.count_if(F.col("etiqueta") == F.col("lang"))).first()
        assert n and same / n >= least
    assert (m.slopes > 0.2).all() and len(set(m.slopes.tolist())) > 1
