"""Entries of each kind, with the type and rule they must get, and the fields taken out of them."""

from pyspark.sql import functions as F

from tiewright.functions import fixed_values as V
from tiewright.functions import names as N
from tiewright.functions import records as R
from tiewright.functions import text as T
from tiewright.plans import records as P
from tests.goldens import CASES

def entries(spark, cases=CASES):
    return spark.createDataFrame([(f"E{i}", h, t, n) for i, (h, t, n, *_) in enumerate(cases)], "entry_id string, head string, text string, n_chars int")


def test_types_and_rules(spark):
    got = {r.entry_id: (r.entry_type, r.rule) for r in R.classify(entries(spark)).collect()}
    for i, (head, _, _, kind, rule) in enumerate(CASES):
        assert got[f"E{i}"][0] == kind, (head, got[f"E{i}"])
        assert rule is None or got[f"E{i}"][1] == rule, (head, got[f"E{i}"])
    others = [("2° PHARMACIENS TOLÉRÉS", "2° PHARMACIENS TOLÉRÉS, SANS DIPLÔME, ET INDIGÈNES : Ar. 17. — La tolérance de l'exercice pourra être accordée aux pharmaciens.", 200), ("ALAPETITE", "ALAPETITE (Gabriel), voir au début de l'ouvrage,", 48)]
    got = [r.entry_type for r in R.classify(entries(spark, others)).orderBy("entry_id").collect()]
    assert got[0] != "person" and got[1] != "cross_reference"


def test_honours(spark):
    texts = {
        "chev. de la Légion d'honn-, Médaille coloniale": {"legion_honneur", "medaille_coloniale"}, "comm. do la. Lésion d'honneur": {"legion_honneur"}, "off. du Nichan-Iflikliar": {"nichan_iftikhar"},
        "off. du Nichan-lftikhar": {"nichan_iftikhar"}, "chev. du Mérite agricole": {"merite_agricole"}, "grand cordon du Nichan el-Abed": {"nichan_el_abed"}, "off. d'Académie": {"palmes_academiques"},
    }
    rows = R.honours(spark.createDataFrame([(t, t) for t in [*texts, "olf. du Nichan-Iftikhar", "ol'f. d'Académie"]], "entry_id string, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.entry_id, set()).add(r.order)
    for t, want in texts.items():
        assert want <= got[t], t
    assert not any("saint_olaf" in v for v in got.values()) and "nichan_iftikhar" not in got["grand cordon du Nichan el-Abed"]
    grades = {r.order: r.grade for r in R.honours(spark.createDataFrame([("x", "gr. off. du Nichan-Iftikhar, chev. de la Légion d'honneur")], "entry_id string, text string")).collect()}
    assert grades == {"nichan_iftikhar": "grand_officier", "legion_honneur": "chevalier"}


def test_person_fields(spark):
    text = "ABADIE (Jean), 4 sept. 1S62, Blaye (Gironde). Avocat, 8, rue de Hollande, Tunis. 1899. ETUDES : lycée de Bordeaux; licencié en droit. SUCCESS : commis à Sfax; juge; président du tribunal de Sousse en 1901."
    rows = R.person_fields(R.classify(entries(spark, [("ABADIE", text, 220), ("AUBERT", "AUBERT (Godefroy), Paris, Médaille militaire. Rentier, 8, rue de Hollande, Tunis. 1899. Ancien...", 150)]))).orderBy("entry_id").collect()
    a, b = rows
    assert (a.birth_year, a.settled_year, a.city, a.occupations, a.degrees) == (1862, 1899, "Tunis", ["justice_law"], ["licence_droit"])
    assert a.address.startswith("8, rue de Hollande") and a.schools == ["lycée de Bordeaux"]
    assert b.birth_year is None and b.settled_year == 1899
    posts = N.posts(spark.createDataFrame([("p", a.career)], "id string, career string"), "career").collect()
    assert [(p.position_order, p.position) for p in posts] == [(0, "commis à Sfax"), (2, "président du tribunal de Sousse en 1901")]
    kinds = R.education(spark.createDataFrame([("p", ["d"], ["lycée de Bordeaux", "Facultés de droit de Paris", "X"])], "entry_id string, degrees array<string>, schools array<string>")).collect()
    assert [k.institution_kind for k in kinds] == ["secondary_lycee", "university_faculty", "other"]


def test_place_and_body_fields(spark):
    text = "ZAOUIA. C. c. de Sousse, caïdat de Monastir, à 5 kil. de Sousse, 1.920 hab. Altit. : 45. Gare, école. POPUL. : 1.920 hab. ARCH. : ruines romaines."
    p = R.place_fields(entries(spark, [("ZAOUIA", text, 150)])).first()
    assert (p.controle_civil, p.caidat, p.distance_km, p.distance_from, p.population, p.altitude_m) == ("Sousse", "Monastir", 5, "Sousse", 1920, 45)
    assert p.has_school and p.has_roman_ruins and not p.has_market
    text = "Cercle nautique, 3 mai 1898. Siège social : 12 rue de Rome, Tunis. 1.250 membres. BUT : la natation."
    o = R.organisation_fields(entries(spark, [("Cercle nautique", text, 120)])).first()
    assert (o.founded_year, o.n_members, o.purpose, o.kind) == (1898, 1250, "la natation.", "sport_leisure")
    s = spark.createDataFrame([(text,)], "t string").select(T.sections(F.col("t"), V.RUBRICS).alias("s")).first().s
    assert set(s) == {"head", "but"}


def test_a_found_place_needs_no_entry(spark):
    persons = spark.createDataFrame([("P1", "Sousse", "Lyon"), ("P2", None, "sousse"), ("P3", "", None)], "entry_id string, city string, birth_place string")
    places = spark.createDataFrame([("L1", "SOUSSE"), ("L2", "Sousse")], "entry_id string, head string")
    got = sorted(map(tuple, R.place_ties(persons, places).collect()))
    assert got == [("P1", "L2", "Sousse", "residence"), ("P1", "PLACE:lyon", "Lyon", "birthplace"), ("P2", "L2", "sousse", "birthplace")]


def test_dates_with_day_and_month(spark):
    texts = {"12 mai 1861, Lyon": (12, 5, 1861), "1er juill. 1S76": (1, 7, 1876), "juin 1880": (None, 6, 1880), "3 août 1799": (3, 8, 1799), "en 1.870": (None, None, 1870), "12 rue de Rome": None, "1.8(i6": None, "5 déc. 1901": (5, 12, 1901)}
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.first_date(F.col("t")).alias("d"))
    assert {r.t: (r.d.day, r.d.month, r.d.year) if r.d else None for r in frame.collect()} == texts


def test_officers_read_names_once_on_all_cores(spark):
    assert P.customers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
    texts = [("a", "Anc. prés., M. Faure; v.-prés. d'honn., M. Girod; rien; secr. gén., M. Moreau, prés."), ("b", None)]
    rows = N.officers(spark.createDataFrame(texts, "body string, text string"), "text")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FRERES") == 1  # the key of a name
    assert sorted((r.role, r.name) for r in rows.collect()) == [("honorary_vice_president", "Girod"), ("past_president", "Faure"), ("secretary_general", "Moreau")]


def test_types_are_worked_out_once_in_their_rows(spark):
    """A filter on the type does not repeat the rules, and honours need no joins."""
    persons = R.person_fields(R.classify(entries(spark)).where("entry_type = 'person'"))
    plan = persons._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("see_also_only") == 1 and "Join" not in plan
    marks = spark.range(1).select(R.mentions_of_orders(F.lit("off. du Nichan-Iftikhar; Étoile noire du Bénin; grand cordon du Nichan el-Abed; off. d'Académie, off. de l'Instruction publique")).alias("m")).first().m
    assert [(m.order, m.position) for m in marks] == [("nichan_iftikhar", 8), ("etoile_noire_benin", 25), ("nichan_el_abed", 64), ("palmes_academiques", 87)]
    assert spark.range(1).select(R.mentions_of_orders(F.lit(None).cast("string")).alias("m")).first().m == []


def test_schools_are_looked_for_once_in_persons(spark):
    persons = R.person_fields(R.classify(entries(spark)).where("entry_type = 'person'"))
    plan = R.education(persons)._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().splitlines() if "Filter" in line]
    assert not any(V.SCHOOL[:20] in line for line in filters), len(filters)
