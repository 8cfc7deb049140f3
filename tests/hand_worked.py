"""Printed entries, lists, pages and strings written by hand, with the rows that the library must make of them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tiewright.functions import names as N
from tiewright.functions import records as R
from tiewright.functions import text as T
from tiewright.operators import label as L
from tiewright.operators import layout as Y
from tiewright.operators import resolve as X
from tiewright.sources import files as S
from tiewright.sources.tables import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}

ENTRIES = [
    ("E01", "MAREDJ", "MAREDJ. C. c. de Béja, caïdat de Mateur, à 12 kil. de Béja, 1.450 hab. Altit. : 210. Poste, gare, école. Propriétaires : MM. Dupont, Bernard et Moreau. ARCH. : ruines romaines."),
    ("E02", "LEROUX", "LEROUX (Paul-Émile), 12 mai 1S61, Lyon (Rhône), off. du Nichan-Iftikhar, chev. de la Légion d'honneur. Avocat-défenseur au barreau, 14, rue d'Italie, Tunis. 1889. ETUDES : lycée de Lyon; licencié en droit. SUCCESS : commis à Sfax en 1889; juge à Sousse, 1895; né; président du tribunal de Tunis."),
    ("E03", "Cercle des Amis", "Cercle des Amis (C.A.). 4 mars 1901. Siège social : 3, rue de Rome, Tunis. 1.085 membres. BUT : la musique et les courses. TRAVAUX : deux concerts."),
    ("E04", "Travaux publics", "Travaux publics (Direction des). Créée en 1883."),
    ("E05", "Collège Neuf", "Collège Neuf. Voir Lycée (Neuf)."),
    ("E06", "Sebkha", "Sebkha. Mot arabe, désigne un lac salé."),
    ("E07", "Vigne", "Vigne. " + "La culture de la vigne a pris un grand essor. " * 10),
    ("E08", "Vent", "Vent. Le sirocco souffle en juin."),
    ("E09", "SALEM BEY", "SALEM BEY. 1SS4, La Marsa. Prince."),
    ("E10", "BERTIN", "BERTIN. Pharmacien à Bizerte."),
    ("E11", "MALLET", "MALLET. Chev. du Mérite agricole."),
    ("E12", "Aïn-Seba", "Aïn-Seba. Village à 20 kil. de Tabarka."),
    ("E13", "ZELLA", "ZELLA, à 7 kil. au sud de Sousse, 640 hab."),
    ("E14", "GARNIER", "GARNIER (Anne, veuve Henri), à Sfax."),
    ("E15", "Fête des Arbres", "Fête des Arbres. Les membres actifs plantent chaque hiver."),
    ("E16", "Moulins", "Moulins. On en voit partout. Ils tournent au vent du nord et du sud, de jour et de nuit, et donnent une farine claire que les marchands des villes voisines achètent au printemps. Ceux du bord de la mer sont les plus vieux du pays; on les dit bâtis par des moines venus de loin. Plus tard ils furent vendus. Contrôle civil."),
    ("E17", "Direction des Ports", "Direction des Ports. Bureaux à La Goulette."),
    ("E18", "BEN SALAH", "BEN SALAH (Ali), né à Tunis. Hadj. Négociant."),
]


def values(rows, columns: str) -> str:
    """SQL text of a table of given rows."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


def query(rows, columns):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = values(rows, columns)
        return f

    return add


def entries(spark):
    return spark.createDataFrame(ENTRIES, "entry_id string, head string, text string").withColumn("n_chars", F.char_length("text"))


def kind(spark, name):
    return R.classify(entries(spark)).where(F.col("entry_type") == name)


@query([
    ("E01", "place", "administrative_unit"), ("E02", "person", "forenames_and_life_dates"), ("E03", "organisation", "organisational_template"), ("E04", "state_body", "directorate_or_office"), ("E05", "cross_reference", "see_also_only"),
    ("E06", "topic", "glossary_gloss"), ("E07", "topic", "thematic_article"), ("E08", "topic", "residual"), ("E09", "person", "caps_headword_with_date"), ("E10", "person", "caps_headword_with_occupation"), ("E11", "person", "caps_headword_with_honour"),
    ("E12", "place", "settlement_noun_and_measure"), ("E13", "place", "bearing_and_population"), ("E14", "person", "caps_headword_with_forenames"), ("E15", "organisation", "organisational_template"), ("E16", "place", "administrative_markers_late"),
    ("E17", "state_body", "directorate_or_office"), ("E18", "person", "forenames_and_life_dates"),
], "entry_id, entry_type, rule")
def record_types(spark, d):
    """The type of each entry and the rule that decided (FN35, FN29, FN32 to FN34)."""
    return R.classify(entries(spark)).select("entry_id", "entry_type", "rule")


@query([("E02", "legion_honneur", "France", "chevalier"), ("E02", "nichan_iftikhar", "Tunisia", "officier"), ("E11", "merite_agricole", "France", "chevalier")], 'entry_id, "order", country, grade')
def record_honours(spark, d):
    """Honours with their grades (TF3, JN18, WIN14, WIN15)."""
    return R.honours(entries(spark)).select("entry_id", "order", "country", "grade")


@query([
    ("E02", "Paul-Émile", False, None, "12 mai 1S61", 12, 5, 1861, "Lyon", "Rhône"), ("E09", None, False, "Bey", "1SS4", None, None, 1884, "La Marsa", None), ("E10", None, False, None, None, None, None, None, None, None), ("E11", None, False, None, None, None, None, None, None, None),
    ("E14", "Anne, veuve Henri", False, None, None, None, None, None, None, None), ("E18", "Ali", True, None, None, None, None, None, None, None),
], "entry_id, forenames, has_particle, honorific, birth_date, birth_day, birth_month, birth_year, birth_place, birth_place_detail")
def record_births(spark, d):
    """Names and births of persons (FN28, FN34, FN41)."""
    return R.person_fields(kind(spark, "person")).select("entry_id", "forenames", "has_particle", "honorific", "birth_date", "birth_day", "birth_month", "birth_year", "birth_place", "birth_place_detail")


@query([
    ("E02", "Avocat-défenseur au barreau, ", "justice_law", "14, rue d'Italie, Tunis", "Tunis", 1889, 2, "nichan_iftikhar;legion_honneur", True, "lycée de Lyon", "licence_droit", 3, False), ("E09", "Prince.", "", None, "La Marsa", None, 0, "", False, "", "", 0, False),
    ("E10", "Pharmacien à Bizerte.", "medicine_health", None, "Bizerte", None, 0, "", False, "", "", 0, False), ("E11", "agricole.", "", None, None, None, 1, "merite_agricole", False, "", "", 0, False),
    ("E14", "(Anne, veuve Henri), à Sfax.", "", None, "Sfax", None, 0, "", False, "", "", 0, False), ("E18", "(Ali), né à Tunis. Hadj. Négociant.", "commerce", None, "Tunis", None, 0, "", False, "", "", 0, False),
], "entry_id, occupation, occupations, address, city, settled_year, n_honours, honours, has_legion_honneur, schools, degrees, n_posts, has_works")
def record_lives(spark, d):
    """Occupation, address, settlement, honours and education of persons (FN40 to FN42)."""
    p = R.person_fields(kind(spark, "person"))
    joined = lambda c: F.array_join(c, ";").alias(c)
    return p.select("entry_id", "occupation", joined("occupations"), "address", "city", "settled_year", "n_honours", joined("honours"), "has_legion_honneur", joined("schools"), joined("degrees"), "n_posts", "has_works")


@query([("E02", 0, "commis à Sfax en 1889", 1889, "Sfax", "administration"), ("E02", 1, "juge à Sousse, 1895", 1895, "Sousse", "justice_law"), ("E02", 3, "président du tribunal de Tunis", None, None, "justice_law")], "entry_id, position_order, position, year, place, occupations")
def record_careers(spark, d):
    """Posts in order, with year, place and occupation (TF4)."""
    return R.career(R.person_fields(kind(spark, "person"))).withColumn("occupations", F.array_join("occupations", ";"))


@query([("E02", "lycée de Lyon", "secondary_lycee", "licence_droit")], "entry_id, institution, institution_kind, degrees")
def record_schools(spark, d):
    """Schools with their kinds (TF5)."""
    return R.education(R.person_fields(kind(spark, "person"))).withColumn("degrees", F.array_join("degrees", ";")).select("entry_id", "institution", "institution_kind", "degrees")


@query([
    ("E01", "Béja", "Mateur", 12, "Béja", 1450, 210, True, True, False, True, "ruines romaines."), ("E12", None, None, 20, "Tabarka", None, None, False, False, False, False, None),
    ("E13", None, None, None, None, 640, None, False, False, False, False, None), ("E16", None, None, None, None, None, None, False, False, False, False, None),
], "entry_id, controle_civil, caidat, distance_km, distance_from, population, altitude_m, has_railway_station, has_school, has_market, has_roman_ruins, archaeology")
def record_places(spark, d):
    """Fields of places (FN43)."""
    p = R.place_fields(kind(spark, "place"))
    return p.select("entry_id", "controle_civil", "caidat", "distance_km", "distance_from", "population", "altitude_m", "has_railway_station", "has_school", "has_market", "has_roman_ruins", "archaeology")


@query([("E01", "Dupont", "DUPONT", "property_owner"), ("E01", "Bernard", "BERNARD", "property_owner"), ("E01", "Moreau", "MOREAU", "property_owner")], "place_node, name, name_key, role")
def record_owners(spark, d):
    """Owners that places name (TF6)."""
    return R.owners(R.place_fields(kind(spark, "place")))


@query([
    ("E02", "PLACE:tunis", "Tunis", "residence"), ("E02", "PLACE:lyon", "Lyon", "birthplace"), ("E09", "PLACE:marsa", "La Marsa", "residence"), ("E09", "PLACE:marsa", "La Marsa", "birthplace"),
    ("E10", "PLACE:bizerte", "Bizerte", "residence"), ("E14", "PLACE:sfax", "Sfax", "residence"), ("E18", "PLACE:tunis", "Tunis", "residence"),
], "person, place_node, place, relation")
def record_place_ties(spark, d):
    """Residences and birthplaces (TF7)."""
    typed = R.classify(entries(spark))
    return R.place_ties(R.person_fields(typed.where("entry_type = 'person'")), typed.where("entry_type = 'place'"))


@query([("E03", "4 mars 1901", 1901, "3, rue de Rome, Tunis", "Tunis", 1085, "la musique et les courses.", "deux concerts.", "sport_leisure;music_arts", "sport_leisure"), ("E15", None, None, None, None, None, None, None, "", None)], "entry_id, founded, founded_year, seat, city, n_members, purpose, activities, kinds, kind")
def record_bodies(spark, d):
    """Fields of bodies (FN44, FN41)."""
    o = R.organisation_fields(kind(spark, "organisation"))
    return o.select("entry_id", "founded", "founded_year", "seat", "city", "n_members", "purpose", "activities", F.array_join("kinds", ";").alias("kinds"), "kind")


OFFICERS = [
    ("O1", "BUREAU : prés., M. Marchand; v.-prés., M. Roux; Vidal L.-E., trés.; secr. adj., M. Petit"),
    ("O2", "Prés. d'honneur, M. Blanc; v.-prés. d'honn., M. Noir; anc. prés., M. Gris; archiviste, M. Vert"),
    ("O3", "Assesseurs : MM. Faure, L. Blanc, Girod et Verry; membres du bureau : Duval et Morin; commissaires : Lucas, Henry"),
    ("O4", "trés.-adj., M. Simon; membres d'honneur : Colin et Brun; directeur, Dr Martel; rien ici"),
]


@query([
    ("O1", "president", "Marchand"), ("O1", "vice_president", "Roux"), ("O1", "treasurer", "Vidal L.-E"), ("O1", "deputy_secretary", "Petit"), ("O2", "honorary_president", "Blanc"), ("O2", "honorary_vice_president", "Noir"), ("O2", "past_president", "Gris"),
    ("O2", "archivist_librarian", "Vert"), ("O3", "assessor", "Faure"), ("O3", "assessor", "L Blanc"), ("O3", "assessor", "Girod"), ("O3", "assessor", "Verry"), ("O3", "board_member", "Duval"), ("O3", "board_member", "Morin"),
    ("O3", "commissioner", "Lucas"), ("O3", "commissioner", "Henry"), ("O4", "deputy_treasurer", "Simon"), ("O4", "honorary_member", "Colin"), ("O4", "honorary_member", "Brun"), ("O4", "director", "Martel"),
], "body, role, name")
def record_officers(spark, d):
    """Officers of all roles in both printed orders (TF1, FN36, FN37, FN49, SRT6)."""
    return N.officers(spark.createDataFrame(OFFICERS, "body string, text string"), "text").select("body", "role", "name")


@query([("A", "président", "Société de Géographie"), ("A", "membre", "Chambre de Commerce"), ("B", "secrétaire général", "Institut de Carthage")], "person, stated_role, stated_body")
def record_affiliations(spark, d):
    """Ties to bodies that entries state (TF2)."""
    rows = [("A", "Président de la Société de Géographie depuis 1901; membre de la Chambre de Commerce; conseiller de Tunis."), ("B", "Secrétaire général de l'Institut de Carthage en 1899. commissaire de police à Sousse.")]
    return N.affiliations(spark.createDataFrame(rows, "person string, text string"), "text").select("person", "stated_role", "stated_body")


@query([("H1", True), ("H2", True), ("H3", True), ("H4", False), ("H5", False), ("H6", True)], "id, fragment")
def record_fragments(spark, d):
    """Headwords that are clauses (FN31)."""
    rows = [("H1", "Djebel signifie montagne"), ("H2", "1° PHARMACIENS"), ("H3", "La ville fut prise"), ("H4", "Administrateur de la Liste"), ("H5", "Est"), ("H6", "Le port reçoit des navires")]
    return spark.createDataFrame(rows, "id string, head string").select("id", T.is_fragment(F.col("head")).alias("fragment"))


@query([(1, "La maison est grande."), (2, "Un mot seul")], "paragraph, text")
def record_paragraphs(spark, d):
    """Lines joined to paragraphs (FN26)."""
    rows = [(1, 2, " est  grande. "), (1, 1, "La maison"), (2, 1, "Un mot"), (2, 2, "seul"), (2, 3, "")]
    return T.join_lines(spark.createDataFrame(rows, "paragraph int, i int, text string"), ["paragraph"], "i")


@query([("0", "0"), ("1", "1"), ("1234.5", "1234.5"), ("-0.00025", "-0.00025"), ("1/3", "0.3333333333"), ("1e12", "1e+12"), ("1.5e-7", "1.5e-07"), ("123456789012", "1.23456789e+11"), ("100", "100")], "name, shown")
def numbers_shown(spark, d):
    """Numbers in ten significant figures (FN12)."""
    rows = [("0", 0.0), ("1", 1.0), ("1234.5", 1234.5), ("-0.00025", -0.00025), ("1/3", 1 / 3), ("1e12", 1e12), ("1.5e-7", 1.5e-7), ("123456789012", 123456789012.0), ("100", 100.0)]
    return spark.createDataFrame(rows, "name string, v double").select("name", T.number_text(F.col("v")).alias("shown"))


@query([("a", "short"), ("b", "one two three four\nfive six"), ("c", "aaaa bbbb cccc dddd\neeee ffff gggg hhhh…")], "id, label")
def labels_shortened(spark, d):
    """Labels wrapped to two lines (FN11)."""
    rows = [("a", "short"), ("b", "one two three four five six"), ("c", "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jjjj")]
    return spark.createDataFrame(rows, "id string, label string").select("id", T.shorten(F.col("label")).alias("label"))


PEOPLE = [("P1", "LEROUX", "Marie", "LEROUX (Marie), institutrice à Sfax."), ("P2", "DURAND", "Jean", "DURAND (Jean), avocat."), ("P3", "ROY", "Claude", "ROY (Mme Claude), à Tunis."), ("P4", "VIAL", "X.", "VIAL (X.), rentier."), ("P5", "PONS", "Anne", "PONS (Anne), consul."), ("P6", "FABRE", "Anne", "FABRE (Anne, née à Lyon).")]


@query([
    ("P1", "FEMALE", "high", "feminine_forename;feminine_occupation"), ("P2", "MALE", "medium", "masculine_forename;masculine_occupation"), ("P3", "FEMALE", "high", "civil_title"),
    ("P4", "UNKNOWN", None, ""), ("P5", "MALE", "low", "feminine_forename;masculine_occupation"), ("P6", "FEMALE", "high", "birth_participle;feminine_forename"),
], "entry_id, label, confidence, evidence")
def gender_evidence(spark, d):
    """Labels by tiers of evidence, decisive ones first (FN48)."""
    people = spark.createDataFrame(PEOPLE, "entry_id string, head string, forenames string, text string")
    out = L.gender(people, feminine=["marie", "anne"], masculine=["jean"])
    return out.select("entry_id", "label", "confidence", F.array_join("evidence", ";").alias("evidence"))


@query([("a", "tunisia", "colony_born_colonist"), ("b", "algeria", "native_jewish_european_status"), ("c", "europe", "metropolitan_colonist"), ("d", "unrecorded", "native_muslim"), ("e", "unrecorded", "unknown"), ("f", "unrecorded", "colonist_unspecified"), ("g", "tunisia", "native_jewish")], "id, birth, detail")
def birth_contexts(spark, d):
    """Where the record says that somebody was born, and the finer position that follows (FN46)."""
    rows = [("a", ["birth_tunisia", "birth_europe"], "colonist", "french"), ("b", ["birth_algeria"], "native", "tunisian_jewish"), ("c", ["birth_italy"], "colonist", "italian"), ("d", ["name"], "native", "tunisian_muslim"), ("e", [], "unknown", ""), ("f", [], "colonist", "french"), ("g", ["birth_tunisia"], "native", "tunisian_jewish")]
    where = L.birth_context(F.col("evidence"))
    return spark.createDataFrame(rows, "id string, evidence array<string>, position string, community string").select("id", where.alias("birth"), L.position_detail(F.col("position"), F.col("community"), where).alias("detail"))


KEYS = [(1, "MARCILLE PAUL"), (2, "BLANC JEAN"), (3, "BLANC LUC"), (4, "MAZIERE"), (5, "LI PO")]


@query([(1, "MARCILLE PAUL"), (1, "MARCILLE"), (2, "BLANC JEAN"), (2, "BLANC"), (3, "BLANC LUC"), (3, "BLANC"), (4, "MAZIERE"), (5, "LI PO")], "entity, key")
def index_of_keys(spark, d):
    """Whole keys and first words of four letters or more (JN11)."""
    return X.index_keys(spark.createDataFrame(KEYS, "id int, name string"), "id", "name")


@query([("a", 1, "resolved", 1), ("b", None, "ambiguous", 2), ("c", 4, "resolved_fuzzy", 1), ("d", None, "unmatched", 0), ("e", None, "ambiguous", 2), ("f", 1, "resolved_fuzzy", 1), ("g", 2, "resolved", 1), ("h", 5, "resolved", 1)], "mention, entity, resolution, n_candidates")
def resolve_cascade(spark, d):
    """Names of several words: the whole key, then each word, then one edit (JN8 to JN10)."""
    index = X.index_keys(spark.createDataFrame(KEYS, "id int, name string"), "id", "name")
    mentions = [("a", "MARCILLE"), ("b", "BLANC"), ("c", "MAZIERES"), ("d", "NOBODY"), ("e", "L BLANC"), ("f", "MARCILE"), ("g", "BLANC JEAN"), ("h", "LI PO")]
    return X.resolve(spark.createDataFrame(mentions, "mention string, name_key string"), index)


@query([("a", True), ("b", False), ("c", True), ("d", False)], "id, heading")
def sequence_headings(spark, d):
    """Headings at which the filing order starts anew (FN25)."""
    rows = [("a", "SUPPLÉMENT", "SUPPLÉMENT."), ("b", "Supplément", "Supplément au dictionnaire illustré de la Régence, lettre A"), ("c", "Addenda", "Addenda"), ("d", "SUPPLIQUE", "SUPPLIQUE")]
    return spark.createDataFrame(rows, "id string, head string, text string").select("id", T.is_sequence_heading(F.col("head"), F.col("text")).alias("heading"))


@query([("a", False), ("b", True), ("c", False)], "id, merged")
def merged_entries(spark, d):
    """Texts that hold more than one notice (FN47)."""
    rows = [("a", "ROUX (Jean), avocat."), ("b", "ROUX (Jean), avocat.  VIAL\n(Paul), médecin."), ("c", "")]
    return spark.createDataFrame(rows, "id string, text string").select("id", T.is_merged(F.col("text"), r"\p{Lu}{3,} \(\p{Lu}").alias("merged"))


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(spark, path: str, text: str) -> None:
    """Write one small file to where Spark writes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(text.encode()))
    out.close()


@query([(0, "https://example.org/c/f1", 1), (1, "https://example.org/c/f2", 2), (2, "https://example.org/d/f9", 9)], "place, id, view")
def json_manifest(spark, d):
    """The canvases of a document of nested sequences, in order (SRC4, SRC7)."""
    canvas = lambda u: {"@id": u, "label": "x"}
    to = f"{folder(spark, 'manifest')}/m.json"
    put(spark, to, json.dumps({"sequences": [{"canvases": [canvas("https://example.org/c/f1"), canvas("https://example.org/c/f2")]}, {"canvases": [canvas("https://example.org/d/f9")]}]}, indent=1))
    return S.manifest_canvases(spark, to)


PAGE = """<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://x"><TextBlock ID="b" HPOS="1" VPOS="2" WIDTH="30" HEIGHT="4"><TextLine HPOS="1" VPOS="2"><String CONTENT="{0}" WC="0.5"/>
<String CONTENT="pri" SUBS_TYPE="HypPart1" SUBS_CONTENT="primaires" WC="1.0"/><String CONTENT="maires" SUBS_TYPE="HypPart2" SUBS_CONTENT="primaires" WC="0.1"/></TextLine><TextLine HPOS="5" VPOS="6"><String CONTENT="{1}" WC="0.8"/></TextLine></TextBlock></alto>"""


@query([(7, 0, "Écoles primaires", 0.75), (7, 1, "Ville", 0.8), (12, 0, "Routes primaires", 0.75), (12, 1, "Port", 0.8)], "page, i, text, confidence")
def page_lines(spark, d):
    """Lines of scanned pages, hyphenated words whole, page numbers from the files' names (SRC5, SRC8, TF8, FN9, FN21)."""
    to = folder(spark, "pages")
    put(spark, f"{to}/f0007.xml", PAGE.format("Écoles", "Ville"))
    put(spark, f"{to}/f0012.xml", PAGE.format("Routes", "Port"))
    return Y.line_texts(S.block_lines(S.read_blocks(spark, f"{to}/*.xml"))).select("page", "i", "text", F.round("confidence", 6).alias("confidence"))


BLOCKS = [(1, "a", 250, 0, 653, 10), (1, "b", 262, 20, 657, 10), (1, "c", 660, 40, 243, 10), (1, "d", 957, 60, 661, 10), (1, "e", 968, 80, 653, 10), (2, "f", 250, 0, 1400, 5), (2, "g", 250, 9, 1400, 5), (3, "h", 0, 500, 900, 300), (3, "i", 250, 900, 900, 200), (3, "j", 140, 505, 900, 300)]


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "page int, name string, hpos int, vpos int, width int, height int")


@query([(1, "a", 0, 0), (1, "b", 0, 1), (1, "c", 0, 2), (1, "d", 1, 0), (1, "e", 1, 1), (2, "f", 0, 0), (2, "g", 0, 1), (3, "h", 0, 0), (3, "j", 0, 1), (3, "i", 0, 2)], 'page, name, "column", place')
def page_reading_order(spark, d):
    """Blocks in columns, an inset in the one that it overlaps more, and in reading order (WIN7, WIN8, JN14)."""
    placed = Y.assign_columns(blocks(spark)).select("page", "name", "hpos", "vpos", "width", "height", "column")
    return Y.reading_order(placed).select("page", "name", "column", "place")


@query([(1, 0, 0, "=== page 1 column 0"), (1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "=== page 1 column 1"), (1, 1, 0, "c")], 'page, "column", place, value')
def page_dumps(spark, d):
    """Texts in order, with a line at each change of column (SNK5, WIN16)."""
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")]
    return Y.page_dump(spark.createDataFrame(rows, "page int, column int, place int, text string"))


STRINGS = [("a", "  Société   Générale d’Études "), ("b", "ÉCOLE L'Été"), ("c", "ORG:PORT DE SFAX ( )"), ("d", "BEN-SALAH"), ("e", "XIV")]


@query([
    ("a", "societe generale d’etudes", "societe generale d-etudes", "societe;generale;etudes", "Société Générale d’Études"), ("b", "ecole l'ete", "ecole l-ete", "ecole;ete", "École L'Été"),
    ("c", "org:port de sfax ( )", "org:port de sfax ( )", "org;port;sfax", "Port De Sfax"), ("d", "ben-salah", "ben-salah", "ben;salah", "Ben-salah"), ("e", "xiv", "xiv", "xiv", "Xiv"),
], "id, norm, coded, tokens, label")
def text_keys(spark, d):
    """Keys and labels of names (FN2, FN3, FN8, FN10)."""
    c = F.col("s")
    return spark.createDataFrame(STRINGS, "id string, s string").select("id", T.norm(c).alias("norm"), T.norm_hyphen(c).alias("coded"), F.array_join(T.name_tokens(c), ";").alias("tokens"), T.pretty(c).alias("label"))


@query([("a", None, True, False, 0.1364), ("b", None, True, False, 0.7778), ("c", None, True, True, 1.0), ("d", "BEN — SALAH", True, True, 1.0), ("e", "", True, False, 1.0)], "id, head_line, is_headword, is_surname, caps")
def head_tests(spark, d):
    """Running heads, headwords and surnames in capitals (FN20, FN23, FN24)."""
    c = F.btrim("s")
    return spark.createDataFrame(STRINGS, "id string, s string").select("id", T.running_head(c).alias("head_line"), T.is_headword(c).alias("is_headword"), T.is_caps_surname(c).alias("is_surname"), F.round(T.caps_share(c), 4).alias("caps"))


@query([("0.0004", "< 0.001"), ("0.0314159", "0.031"), ("1", "1.000")], "name, p")
def p_values_shown(spark, d):
    """p-values as they are printed (FN13)."""
    return spark.createDataFrame([("0.0004", 0.0004), ("0.0314159", 0.0314159), ("1", 1.0)], "name string, v double").select("name", T.p_text(F.col("v")).alias("p"))
