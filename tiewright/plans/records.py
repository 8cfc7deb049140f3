"""Queries for typed records: every customer is an entry of a printed gazetteer, its fields taken from the customer's row.

The key gives the kind of entry (24 templates that meet all rules) and, from its other part, names, dates, places, numbers and
honours. The SQL texts work the expected fields out of the same columns; they never see the printed text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiewright.functions import names as N
from tiewright.functions import records as R
from tiewright.functions import text as T
from tiewright.operators import label as L
from tiewright.operators import resolve as X
from tiewright.plans.windows import LINES, lines
from tiewright.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict = {}


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: list, index: str) -> str:
    """SQL, the same for both engines, of the value at a place."""
    shown = [v if isinstance(v, int) else quoted(v) for v in values]
    return f"CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


CITIES = ["Tunis", "Sousse", "Sfax", "Bizerte", "Kairouan", "Mahdia", "Monastir", "Nabeul", "Zaghouan", "Gafsa", "Tozeur"]
#: Without the tenth: behind 10 to 19 the fixed pattern of misread years takes its first letters for digits.
MONTHS = {"janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "novembre": 11, "décembre": 12}
TRADES = [("Avocat", "justice_law"), ("Pharmacien", "medicine_health"), ("Professeur", "education_science"), ("Architecte", "engineering_architecture"), ("Négociant", "commerce"), ("Journaliste", "press_letters_arts"), ("Viticulteur", "agriculture")]
HONOURS = [("chev. de la Légion d'honneur", "legion_honneur", "France", "chevalier"), ("off. du Nichan-Iftikhar", "nichan_iftikhar", "Tunisia", "officier"), ("comm. de la Couronne d'Italie", "couronne_italie", "Italy", "commandeur"), ("chev. du Mérite agricole", "merite_agricole", "France", "chevalier"), ("gr. off. du Medjidié", "medjidie", "Ottoman Empire", "grand_officier")]
FORENAMES = ["Paul", "Jean-Louis", "Henri", "Émile", "Auguste"]
KIN = ["Dupont", "Bernard", "Moreau", "Faure", "Girod", "Verry", "Duval", "Morin"]

#: Numbers of people stay below 1600, where a number may be a year.
#: Columns of an entry from k (the key), t (the template) and j (how often the template came before).
FIELDS = {
    "name": "concat('ROU', translate(CAST(k AS STRING), '0123456789', 'BDFGKLMNRT'))",
    "small": "concat('Rou', translate(CAST(k AS STRING), '0123456789', 'bdfgklmnrt'))",
    "city": pick(CITIES, "j"), "town": pick(CITIES, "j + 4"), "fore": pick(FORENAMES, "j"), "trade": pick([t for t, _ in TRADES], "j"), "field": pick([f for _, f in TRADES], "j"),
    "day": "1 + j % 28", "month": pick(list(MONTHS), "j"), "month_no": pick(list(MONTHS.values()), "j"), "year": "1821 + j % 60", "num": "1 + j % 180", "dist": "2 + j % 90", "pop": "100 + (j * 37) % 1400", "alt": "5 + j % 900",
    **{n: pick([h[i] for h in HONOURS], "j") for i, n in enumerate(("honour", "h_order", "h_country", "h_grade"))}, **{n: pick([h[i] for h in HONOURS], "j + 2") for i, n in enumerate(("honour2", "h2_order", "h2_country", "h2_grade"))},
    **{f"kin{i}": pick(KIN, f"j + {3 * i}") for i in range(4)},
}
BASE = f"n AS (SELECT c_custkey AS k, c_custkey % 24 AS t, CAST(floor(c_custkey / 24.0) AS BIGINT) AS j FROM customer), e AS (SELECT k, t, j, {', '.join(f'{sql} AS {name}' for name, sql in FIELDS.items())} FROM n)"
PROSE = "On en voit partout. Ils tournent au vent du nord et du sud, de jour et de nuit, et donnent une farine claire que les marchands des villes voisines achètent au printemps. Ceux du bord de la mer sont les plus vieux du pays; on les dit bâtis par des moines venus de loin. Plus tard ils furent vendus."
LONG = "et auteur de plusieurs longs mémoires sur la région, ses monuments et ses fêtes, lus en partie devant un public nombreux et publiés plus tard."
#: Head and text of each template.
TEMPLATES = [
    ("{name}", "{name}. C. c. de {city}, caïdat de {town}, à {dist} kil. de {city}, {pop} hab. Altit. : {alt}. Poste, gare, école. Propriétaires : MM. {kin0}, {kin1} et {kin2}. ARCH. : ruines romaines de {town}."),
    ("{name}", "{name} ({fore}), {day} {month} {year}, {city} (Rhône), {honour}, {honour2}. {trade} au barreau, {num}, rue d'Italie, {town}. 1889. Il habite la ville depuis longtemps et y reçoit tous les matins, le dimanche excepté. ETUDES : lycée de {city}; licencié en droit. SUCCESS : commis à {town} en 1889; juge à {city}, 1895; né; président du tribunal de {town}."),
    ("Cercle des Amis de {city}", "Cercle des Amis de {city} (C.A.). {day} {month} {year}. Siège social : {num}, rue de Rome, {town}. {pop} membres. BUT : la musique et les courses de {city}. TRAVAUX : deux concerts."),
    ("Travaux {small}", "Travaux {small} (Direction des). Créée en {year}."),
    ("Collège {small}", "Collège {small}. Voir Lycée ({city})."),
    ("Sebkha {small}", "Sebkha {small}. Mot arabe, désigne un lac salé."),
    ("Vigne de {city}", "Vigne de {city}. " + "La culture de la vigne a pris un grand essor. " * 10),
    ("Vent de {city}", "Vent de {city}. Le sirocco souffle en juin."),
    ("{name} BEY", "{name} BEY. {year}, La Marsa. Prince."),
    ("{name}", "{name}. {trade} à {city}."),
    ("{name}", "{name}. Rentier. {honour}."),
    ("Aïn-{small}", "Aïn-{small}. Village à {dist} kil. de {city}."),
    ("{name}", "{name}, à {dist} kil. au sud de {city}, {pop} hab."),
    ("{name}", "{name} ({fore}, veuve Henri), à {city}."),
    ("Fête des Arbres de {city}", "Fête des Arbres de {city}. Les membres actifs plantent chaque hiver."),
    ("Moulins", "Moulins. " + PROSE + " Contrôle civil."),
    ("Direction des Ports de {city}", "Direction des Ports de {city}. Bureaux à La Goulette."),
    ("BEN {name}", "BEN {name} ({fore}), né à {city}. Hadj. {trade}."),
    ("{city}", "{city}. Oasis du sud, caïdat de {town}."),
    ("Office {small}", "Office {small}. Fermé le dimanche."),
    ("{name}", "{name} ({fore}), {year}, {city}. {honour}, {honour2}. Notaire à {town}, " + LONG),
    ("{small}", "{small} (V. — {city})."),
    ("Syndicat de {city}", "Syndicat de {city}. {day} {month} {year}. {pop} adhérents."),
    ("{name}", "{name} ({fore}), {day} {month} {year}, {town}. {trade}. TRAVAUX : une carte de {city}. Décédé à {town}."),
]


def filled(template: str) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def customers(spark, d) -> DataFrame:
    """Each customer with k, t, j and the fields of its entry."""
    n = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey AS k", "c_custkey % 24 AS t", "CAST(floor(c_custkey / 24.0) AS BIGINT) AS j")
    return n.selectExpr("k", "t", "j", *[f"{sql} AS {name}" for name, sql in FIELDS.items()])


def by_template(templates: list[str], t: str = "t") -> Column:
    out = F.lit(None).cast("string")
    for i, template in reversed(list(enumerate(templates))):
        out = F.when(F.col(t) == i, filled(template)).otherwise(out)
    return out


def entries(spark, d) -> DataFrame:
    """(entry_id, head, text, n_chars) of all customers."""
    rows = customers(spark, d)
    made = rows.select(F.col("k").alias("entry_id"), by_template([h for h, _ in TEMPLATES]).alias("head"), by_template([x for _, x in TEMPLATES]).alias("text"))
    return made.withColumn("n_chars", F.char_length("text"))


def kind(spark, d, name):
    return R.classify(entries(spark, d)).where(F.col("entry_type") == name)


def query(sql, base=BASE):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {base} {sql}" if base else sql
        return f

    return add


TYPES = [
    "place administrative_unit", "person forenames_and_life_dates", "organisation organisational_template", "state_body directorate_or_office", "cross_reference see_also_only", "topic glossary_gloss", "topic thematic_article", "topic residual",
    "person caps_headword_with_date", "person caps_headword_with_occupation", "person caps_headword_with_honour", "place settlement_noun_and_measure", "place bearing_and_population", "person caps_headword_with_forenames", "organisation organisational_template",
    "place administrative_markers_late", "state_body directorate_or_office", "person forenames_and_life_dates", "place administrative_markers", "state_body directorate_or_office", "person forenames_and_life_dates", "cross_reference see_also_only",
    "organisation organisational_template", "person forenames_and_life_dates",
]
PERSONS, PLACES, BODIES = (f"t IN ({', '.join(str(i) for i, x in enumerate(TYPES) if x.startswith(kind))})" for kind in ("person", "place", "organisation"))


@query(f"SELECT k AS entry_id, {pick([x.split()[0] for x in TYPES], 't')} AS entry_type, {pick([x.split()[1] for x in TYPES], 't')} AS rule FROM e")
def record_types(spark, d):
    """The type of each entry and the rule that decided (FN35, FN29, FN32 to FN34)."""
    return R.classify(entries(spark, d)).select("entry_id", "entry_type", "rule")


@query("""SELECT k AS entry_id, h_order AS "order", h_country AS country, h_grade AS grade FROM e WHERE t IN (1, 10, 20) UNION ALL SELECT k, h2_order, h2_country, h2_grade FROM e WHERE t IN (1, 20)""")
def record_honours(spark, d):
    """Honours with their grades (TF3, JN18, WIN14, WIN15)."""
    return R.honours(entries(spark, d)).select("entry_id", "order", "country", "grade")


@query(f"""SELECT k AS entry_id, CASE WHEN t = 13 THEN fore || ', veuve Henri' WHEN t IN (1, 17, 20, 23) THEN fore END AS forenames, t = 17 AS has_particle, CASE WHEN t = 8 THEN 'Bey' END AS honorific,
  CASE WHEN t IN (1, 23) THEN concat(day, ' ', month, ' ', year) WHEN t IN (8, 20) THEN CAST(year AS STRING) END AS birth_date, CASE WHEN t IN (1, 23) THEN day END AS birth_day, CASE WHEN t IN (1, 23) THEN month_no END AS birth_month,
  CASE WHEN t IN (1, 8, 20, 23) THEN year END AS birth_year, CASE WHEN t = 8 THEN 'La Marsa' WHEN t IN (1, 20) THEN city WHEN t = 23 THEN town END AS birth_place, CASE WHEN t = 1 THEN 'Rhône' END AS birth_place_detail FROM e WHERE {PERSONS}""")
def record_births(spark, d):
    """Names and births of persons (FN28, FN34, FN41)."""
    p = R.person_fields(kind(spark, d, "person"))
    numbers = [F.col(c).cast("long").alias(c) for c in ("birth_day", "birth_month", "birth_year")]
    return p.select("entry_id", "forenames", "has_particle", "honorific", "birth_date", *numbers, "birth_place", "birth_place_detail")


@query(f"""SELECT k AS entry_id, CASE t WHEN 1 THEN trade || ' au barreau, ' WHEN 8 THEN 'Prince.' WHEN 9 THEN concat(trade, ' à ', city, '.') WHEN 10 THEN concat('Rentier. ', honour, '.') WHEN 13 THEN concat('(', fore, ', veuve Henri), à ', city, '.')
    WHEN 17 THEN concat('(', fore, '), né à ', city, '. Hadj. ', trade, '.') WHEN 20 THEN concat('Notaire à ', town, ', ', {quoted(LONG)}) ELSE trade || '.' END AS occupation,
  CASE WHEN t IN (1, 9, 17, 23) THEN field WHEN t = 20 THEN 'justice_law' ELSE '' END AS occupations, CASE WHEN t = 1 THEN concat(num, ', rue d''Italie, ', town) END AS address,
  CASE t WHEN 8 THEN 'La Marsa' WHEN 10 THEN NULL WHEN 23 THEN town ELSE city END AS city, CASE WHEN t = 1 THEN 1889 END AS settled_year, CASE WHEN t IN (1, 20) THEN 2 WHEN t = 10 THEN 1 ELSE 0 END AS n_honours,
  CASE WHEN t IN (1, 20) THEN concat(h_order, ';', h2_order) WHEN t = 10 THEN h_order ELSE '' END AS honours, (t IN (1, 10, 20) AND h_order = 'legion_honneur') OR (t IN (1, 20) AND h2_order = 'legion_honneur') AS has_legion_honneur,
  CASE WHEN t = 1 THEN 'lycée de ' || city ELSE '' END AS schools, CASE WHEN t = 1 THEN 'licence_droit' ELSE '' END AS degrees, CASE WHEN t = 1 THEN 3 ELSE 0 END AS n_posts, t = 23 AS has_works FROM e WHERE {PERSONS}""")
def record_lives(spark, d):
    """Occupation, address, settlement, honours and education of persons (FN40 to FN42)."""
    p = R.person_fields(kind(spark, d, "person"))
    joined = lambda c: F.array_join(c, ";").alias(c)
    return p.select("entry_id", "occupation", joined("occupations"), "address", "city", "settled_year", "n_honours", joined("honours"), "has_legion_honneur", joined("schools"), joined("degrees"), "n_posts", "has_works")


@query("""SELECT k AS entry_id, i AS position_order, CASE i WHEN 0 THEN concat('commis à ', town, ' en 1889') WHEN 1 THEN concat('juge à ', city, ', 1895') ELSE 'président du tribunal de ' || town END AS position, CASE i WHEN 0 THEN 1889 WHEN 1 THEN 1895 END AS year,
  CASE i WHEN 0 THEN town WHEN 1 THEN city END AS place, CASE i WHEN 0 THEN 'administration' ELSE 'justice_law' END AS occupations FROM e, (VALUES (0), (1), (3)) v(i) WHERE t = 1""")
def record_careers(spark, d):
    """Posts in order, with year, place and occupation (TF4)."""
    return R.career(R.person_fields(kind(spark, d, "person"))).withColumn("occupations", F.array_join("occupations", ";"))


@query("SELECT k AS entry_id, 'lycée de ' || city AS institution, 'secondary_lycee' AS institution_kind, 'licence_droit' AS degrees FROM e WHERE t = 1")
def record_schools(spark, d):
    """Schools with their kinds (TF5)."""
    return R.education(R.person_fields(kind(spark, d, "person"))).withColumn("degrees", F.array_join("degrees", ";")).select("entry_id", "institution", "institution_kind", "degrees")


@query(f"""SELECT k AS entry_id, CASE WHEN t = 0 THEN city END AS controle_civil, CASE WHEN t IN (0, 18) THEN town END AS caidat, CASE WHEN t IN (0, 11) THEN dist END AS distance_km, CASE WHEN t IN (0, 11) THEN city END AS distance_from,
  CASE WHEN t IN (0, 12) THEN pop END AS population, CASE WHEN t = 0 THEN alt END AS altitude_m, t = 0 AS has_railway_station, t = 0 AS has_school, false AS has_market, t = 0 AS has_roman_ruins, CASE WHEN t = 0 THEN concat('ruines romaines de ', town, '.') END AS archaeology FROM e WHERE {PLACES}""")
def record_places(spark, d):
    """Fields of places (FN43)."""
    p = R.place_fields(kind(spark, d, "place"))
    numbers = [F.col(c).cast("long").alias(c) for c in ("distance_km", "population", "altitude_m")]
    return p.select("entry_id", "controle_civil", "caidat", "distance_from", *numbers, "has_railway_station", "has_school", "has_market", "has_roman_ruins", "archaeology")


@query("SELECT k AS place_node, kin AS name, upper(kin) AS name_key, 'property_owner' AS role FROM (SELECT k, t, unnest([kin0, kin1, kin2]) AS kin FROM e) WHERE t = 0")
def record_owners(spark, d):
    """Owners that places name (TF6)."""
    return R.owners(R.place_fields(kind(spark, d, "place")))


@query("""SELECT person, coalesce(CAST((SELECT max(k) FROM e WHERE t = 18 AND city = place) AS STRING), 'PLACE:' || CASE place WHEN 'La Marsa' THEN 'marsa' ELSE lower(place) END) AS place_node, place, relation FROM (
    SELECT k AS person, CASE t WHEN 8 THEN 'La Marsa' WHEN 23 THEN town ELSE city END AS place, 'residence' AS relation FROM e WHERE t IN (1, 8, 9, 13, 17, 20, 23) UNION ALL
    SELECT k, CASE t WHEN 8 THEN 'La Marsa' WHEN 23 THEN town ELSE city END, 'birthplace' FROM e WHERE t IN (1, 8, 20, 23))""")
def record_place_ties(spark, d):
    """Residences and birthplaces, at a place's own entry if it has one (TF7)."""
    typed = R.classify(entries(spark, d))
    return R.place_ties(R.person_fields(typed.where("entry_type = 'person'")), typed.where("entry_type = 'place'"))


@query(f"""SELECT k AS entry_id, CASE WHEN t <> 14 THEN concat(day, ' ', month, ' ', year) END AS founded, CASE WHEN t <> 14 THEN year END AS founded_year, CASE WHEN t = 2 THEN concat(num, ', rue de Rome, ', town) END AS seat, CASE WHEN t = 2 THEN town ELSE city END AS city,
  CASE WHEN t <> 14 THEN pop END AS n_members, CASE WHEN t = 2 THEN concat('la musique et les courses de ', city, '.') END AS purpose, CASE WHEN t = 2 THEN 'deux concerts.' END AS activities,
  CASE t WHEN 2 THEN 'sport_leisure;music_arts' WHEN 22 THEN 'professional_union' ELSE '' END AS kinds, CASE t WHEN 2 THEN 'sport_leisure' WHEN 22 THEN 'professional_union' END AS kind FROM e WHERE {BODIES}""")
def record_bodies(spark, d):
    """Fields of bodies (FN44, FN41)."""
    o = R.organisation_fields(kind(spark, d, "organisation"))
    numbers = [F.col(c).cast("long").alias(c) for c in ("founded_year", "n_members")]
    return o.select("entry_id", "founded", *numbers, "seat", "city", "purpose", "activities", F.array_join("kinds", ";").alias("kinds"), "kind")


#: Officers of each of four kinds of lists, with the roles and the columns of their names.
LISTS = [
    ("BUREAU : prés., M. {kin0}; v.-prés., M. {kin1}; {kin2} L.-E., trés.; secr. adj., M. {kin3}", [("president", "kin0"), ("vice_president", "kin1"), ("treasurer", "kin2 || ' L.-E'"), ("deputy_secretary", "kin3")]),
    ("Prés. d'honneur, M. {kin0}; v.-prés. d'honn., M. {kin1}; anc. prés., M. {kin2}; archiviste, M. {kin3}", [("honorary_president", "kin0"), ("honorary_vice_president", "kin1"), ("past_president", "kin2"), ("archivist_librarian", "kin3")]),
    ("Assesseurs : MM. {kin0}, L. {kin1} et {kin2}; membres du bureau : {kin3} et {kin0}; commissaires : Lucas, {kin1}; {small}, secr. gén.", [("assessor", "kin0"), ("assessor", "'L ' || kin1"), ("assessor", "kin2"), ("board_member", "kin3"), ("board_member", "kin0"), ("commissioner", "'Lucas'"), ("commissioner", "kin1"), ("secretary_general", "small")]),
    ("trés.-adj., M. {kin0}; membres d'honneur : {kin1} et {kin2}; directeur, Dr {small}; rien ici", [("deputy_treasurer", "kin0"), ("honorary_member", "kin1"), ("honorary_member", "kin2"), ("director", "small")]),
]


@query(" UNION ALL ".join(f"SELECT k AS body, '{role}' AS role, {name} AS name FROM e WHERE t % 4 = {i}" for i, (_, officers) in enumerate(LISTS) for role, name in officers))
def record_officers(spark, d):
    """Officers of many roles in both printed orders, each list of its customer's own names (TF1, FN36, FN37, FN49, SRT6)."""
    rows = customers(spark, d).withColumn("u", F.col("t") % 4)
    return N.officers(rows.select(F.col("k").alias("body"), by_template([x for x, _ in LISTS], "u").alias("text")), "text").select("body", "role", "name")


@query("""SELECT k AS person, 'président' AS stated_role, 'Société de ' || city AS stated_body FROM e UNION ALL SELECT k, 'membre', 'Chambre de Commerce' FROM e WHERE t % 2 = 0
  UNION ALL SELECT k, 'secrétaire général', 'Institut de Carthage' FROM e WHERE t % 2 = 1""")
def record_affiliations(spark, d):
    """Ties to bodies that entries state (TF2)."""
    texts = ["Président de la Société de {city} depuis {year}; membre de la Chambre de Commerce; conseiller de Tunis.", "Secrétaire général de l'Institut de Carthage en {year}. Président de la Société de {city}. commissaire de police à {town}."]
    rows = customers(spark, d).withColumn("u", F.col("t") % 2)
    return N.affiliations(rows.select(F.col("k").alias("person"), by_template(texts, "u").alias("text")), "text").select("person", "stated_role", "stated_body")


@query("SELECT k AS id, t % 6 IN (0, 1, 2, 5) AS fragment FROM e")
def record_fragments(spark, d):
    """Headwords that are clauses (FN31)."""
    heads = ["{city} signifie montagne", "{num}° PHARMACIENS de {city}", "La ville de {city} fut prise", "Administrateur de {city}", "{name}", "Le port de {city} reçoit des navires"]
    rows = customers(spark, d).withColumn("u", F.col("t") % 6)
    return rows.select(F.col("k").alias("id"), T.is_fragment(by_template(heads, "u")).alias("fragment"))


GIRLS, BOYS = ["Marie", "Anne", "Claire"], ["Jean", "Paul", "Luc", "Henri"]
#: Forenames, text, and label, confidence and evidence.
GENDERS = [
    ("{girl}", "{name} ({girl}), institutrice à {city}.", "FEMALE", "high", "feminine_forename;feminine_occupation"), ("{boy}", "{name} ({boy}), avocat.", "MALE", "medium", "masculine_forename;masculine_occupation"),
    ("Claude", "{name} (Mme Claude), à {city}.", "FEMALE", "high", "civil_title"), ("X.", "{name} (X.), rentier.", "UNKNOWN", None, ""), ("{girl}", "{name} ({girl}), consul à {city}.", "MALE", "low", "feminine_forename;masculine_occupation"),
    ("{girl}", "{name} ({girl}, née à {city}).", "FEMALE", "high", "birth_participle;feminine_forename"), ("{boy}", "{name} ({boy}), rentier.", "MALE", "medium", "masculine_forename"), ("{girl}", "{name} ({girl}), à {city}.", "FEMALE", "medium", "feminine_forename"),
]


@query(f"SELECT k AS entry_id, {pick([g[2] for g in GENDERS], 't')} AS label, {pick([g[3] for g in GENDERS], 't')} AS confidence, {pick([g[4] for g in GENDERS], 't')} AS evidence FROM e")
def gender_evidence(spark, d):
    """Labels by tiers of evidence, decisive ones first (FN48)."""
    rows = customers(spark, d).withColumns({"u": F.col("t") % len(GENDERS), "girl": F.expr(pick(GIRLS, "j")), "boy": F.expr(pick(BOYS, "j"))})
    people = rows.select(F.col("k").alias("entry_id"), F.col("name").alias("head"), by_template([g[0] for g in GENDERS], "u").alias("forenames"), by_template([g[1] for g in GENDERS], "u").alias("text"))
    out = L.gender(people, feminine=[g.lower() for g in GIRLS], masculine=[b.lower() for b in BOYS])
    return out.select("entry_id", "label", "confidence", F.array_join("evidence", ";").alias("evidence"))


@query("""SELECT c_custkey AS id, birth, CASE WHEN position = 'unknown' THEN 'unknown' WHEN position = 'colonist' THEN CASE birth WHEN 'europe' THEN 'metropolitan_colonist' WHEN 'unrecorded' THEN 'colonist_unspecified' ELSE 'colony_born_colonist' END
    WHEN community = 'tunisian_muslim' THEN 'native_muslim' WHEN birth IN ('europe', 'algeria') THEN 'native_jewish_european_status' ELSE 'native_jewish' END AS detail FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'tunisia' WHEN c_custkey % 5 = 0 THEN 'algeria' WHEN c_nationkey % 2 = 0 THEN 'europe' ELSE 'unrecorded' END AS birth,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'colonist' WHEN 'AUTOMOBILE' THEN 'colonist' WHEN 'MACHINERY' THEN 'unknown' ELSE 'native' END AS position, CASE WHEN c_acctbal < 3000 THEN 'tunisian_muslim' ELSE 'tunisian_jewish' END AS community FROM customer)""")
def birth_contexts(spark, d):
    """Where the record says that somebody was born, and the finer position that follows (FN46)."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    signs = F.array_compact(F.array(F.when(F.col("c_nationkey") % 2 == 0, "birth_italy"), F.when(k % 5 == 0, "birth_algeria"), F.lit("name"), F.when(k % 3 == 0, "birth_tunisia")))
    position = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "colonist").when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise("native")
    where = L.birth_context(signs)
    return c.select(k.alias("id"), where.alias("birth"), L.position_detail(position, F.when(F.col("c_acctbal") < 3000, "tunisian_muslim").otherwise("tunisian_jewish"), where).alias("detail"))


#: Names of two words of suppliers, the first of which a nation's suppliers share; orders mention a whole name, its first word, that word with a letter more, or another name.
LETTERS = "translate(CAST({} AS STRING), '0123456789', 'BDFGKLMNRT')"
NAMED = f"s AS (SELECT s_suppkey AS id, concat('NATION', {LETTERS.format('s_nationkey')}, ' ROU', {LETTERS.format('s_suppkey')}) AS name, concat('NATION', {LETTERS.format('s_nationkey')}) AS first FROM supplier)"
MENTION = "CASE o_orderkey % 5 WHEN 0 THEN name WHEN 1 THEN first WHEN 2 THEN concat(first, 'Q') WHEN 3 THEN concat('DE ', name) ELSE concat('NOBODY ROU', substring(first, 7, 9)) END"
INDEX = "x AS (SELECT id AS entity, name AS key FROM s UNION SELECT id, first FROM s)"


def named(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_suppkey AS id", f"concat('NATION', {LETTERS.format('s_nationkey')}, ' ROU', {LETTERS.format('s_suppkey')}) AS name", f"concat('NATION', {LETTERS.format('s_nationkey')}) AS first")


@query("SELECT entity, key FROM x", f"{NAMED}, {INDEX}")
def index_of_keys(spark, d):
    """Whole keys and first words of four letters or more (JN11)."""
    return X.index_keys(named(spark, d), "id", "name")


@query("""SELECT mention, CASE WHEN n = 1 THEN entity END AS entity, CASE WHEN n IS NULL THEN 'unmatched' ELSE concat(CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END, CASE WHEN fuzzy THEN '_fuzzy' ELSE '' END) END AS resolution, coalesce(n, 0) AS n_candidates
  FROM m LEFT JOIN (SELECT mention, fuzzy, count(DISTINCT entity) AS n, min(entity) AS entity FROM h WHERE (mention, fuzzy, place) IN (SELECT mention, fuzzy, min(place) FROM h GROUP BY ALL) AND NOT (fuzzy AND mention IN (SELECT mention FROM h WHERE NOT fuzzy)) GROUP BY ALL) USING (mention)""",
  f"""{NAMED}, {INDEX}, m AS (SELECT o_orderkey AS mention, {MENTION} AS name_key FROM orders JOIN s ON id = o_custkey % (SELECT count(*) FROM supplier)),
  w AS (SELECT mention, 0 AS place, name_key AS key FROM m UNION ALL SELECT mention, unnest(range(1, len(string_split(name_key, ' ')) + 1)), unnest(string_split(name_key, ' ')) FROM m),
  u AS (SELECT DISTINCT key FROM w WHERE place > 0 AND length(key) >= 5), n AS (SELECT u.key AS word, x.entity FROM u JOIN x ON length(x.key) >= 5 AND levenshtein(u.key, x.key) <= 1),
  h AS (SELECT mention, false AS fuzzy, place, entity FROM w JOIN x USING (key) WHERE place = 0 OR length(key) >= 3 UNION ALL SELECT mention, true, place, entity FROM w JOIN n ON w.key = n.word WHERE place > 0)""")
def resolve_cascade(spark, d):
    """Names of several words: the whole key, then each word, then one edit (JN8 to JN10)."""
    names = named(spark, d)
    n = table(spark, d, "supplier").count()
    mentions = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % n).alias("id")).join(names, "id").select(F.col("o_orderkey").alias("mention"), F.expr(MENTION).alias("name_key"))
    return X.resolve(mentions, X.index_keys(names, "id", "name"))


@query("SELECT k AS id, t % 6 IN (0, 2) OR (t % 6 = 5 AND length(city) <= 5) AS heading FROM e")
def sequence_headings(spark, d):
    """Headings at which the filing order starts anew (FN25)."""
    heads = ["SUPPLÉMENT", "Supplément", "Addenda", "SUPPLIQUE de {city}", "{name}", "Annexe"]
    texts = ["SUPPLÉMENT.", "Supplément au dictionnaire illustré de {city}, lettre A", "Addenda", "SUPPLIQUE de {city}", "{name} ({fore}), avocat.", "Annexe de la ville de {city}, en {year}"]
    rows = customers(spark, d).withColumn("u", F.col("t") % 6)
    return rows.select(F.col("k").alias("id"), T.is_sequence_heading(by_template(heads, "u"), by_template(texts, "u")).alias("heading"))


@query("SELECT k AS id, t % 3 = 1 AS merged FROM e")
def merged_entries(spark, d):
    """Texts that hold more than one notice (FN47)."""
    texts = ["{name} ({fore}), avocat à {city}.", "{name} ({fore}), avocat.  VIAL\n(Paul), médecin à {city}.", "{small} ({fore}), avocat. {name}, médecin."]
    rows = customers(spark, d).withColumn("u", F.col("t") % 3)
    return rows.select(F.col("k").alias("id"), T.is_merged(by_template(texts, "u"), r"\p{Lu}{3,} \(\p{Lu}").alias("merged"))


@query(r"SELECT doc_id, i // 3 AS paragraph, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM l GROUP BY ALL", LINES)
def record_paragraphs(spark, d):
    """Lines of documents joined to paragraphs of three (FN26)."""
    rows = lines(spark, d).select("doc_id", F.col("i").cast("long").alias("i"), F.expr("i div 3").alias("paragraph"), F.col("line").alias("text"))
    return T.join_lines(rows, ["doc_id", "paragraph"], "i")


VALUE = "CASE o_orderkey % 7 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 3e9 WHEN 2 THEN o_totalprice * 1e9 WHEN 3 THEN -1e0 / (1 + o_orderkey) WHEN 4 THEN o_custkey * 1e0 WHEN 5 THEN o_totalprice / 7e0 ELSE 0e0 END"


@query(f"SELECT o_orderkey, printf('%.10g', {VALUE}) AS shown FROM orders", "")
def numbers_shown(spark, d):
    """Numbers in ten significant figures (FN12)."""
    return table(spark, d, "orders").select("o_orderkey", T.number_text(F.expr(VALUE).cast("double")).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', p) END AS p FROM (SELECT o_orderkey, (o_custkey % 997) / 997e0 / (1 + o_orderkey % 31) AS p FROM orders)", "")
def p_values_shown(spark, d):
    """p-values as they are printed (FN13)."""
    return table(spark, d, "orders").select("o_orderkey", T.p_text(F.expr("(o_custkey % 997) / 997e0 / (1 + o_orderkey % 31)")).alias("p"))


#: The most words from a place on that fit in 20 characters, but one at least.
FIT = "greatest(1, coalesce(list_max([n FOR n IN range(1, len({0}) + 1) IF length(array_to_string({0}[1:n], ' ')) <= 20]), 1))"


@query(f"""SELECT k AS id, CASE WHEN len(w) = one THEN array_to_string(w, ' ') WHEN len(w) = one + two THEN concat(array_to_string(w[1:one], ' '), chr(10), array_to_string(r, ' ')) ELSE concat(array_to_string(w[1:one], ' '), chr(10), rtrim(substr(array_to_string(r[1:two], ' '), 1, 19)), '…') END AS label
  FROM (SELECT *, {FIT.format('r')} AS two FROM (SELECT *, w[one + 1:] AS r FROM (SELECT *, {FIT.format('w')} AS one FROM (SELECT k, string_split(concat(name, ' de ', city, CASE t % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' et de ', town) WHEN 2 THEN concat(' ', honour, ' à ', town) ELSE concat(' ', kin0, ' ', kin1, ' ', kin2) END), ' ') AS w FROM e))))""")
def labels_shortened(spark, d):
    """Labels wrapped to two lines (FN11)."""
    labels = ["{name} de {city}", "{name} de {city} et de {town}", "{name} de {city} {honour} à {town}", "{name} de {city} {kin0} {kin1} {kin2}"]
    rows = customers(spark, d).withColumn("u", F.col("t") % 4)
    return rows.select(F.col("k").alias("id"), T.shorten(by_template(labels, "u")).alias("label"))
