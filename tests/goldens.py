"""Printed entries and the type and rule that each must get."""

CASES = [
    ("MELLITA", "MELLITA. C. c. de Gabès, ann. de Djerba, caïdat de l'Arad.", 200, "place", "administrative_unit"),
    ("SIDI-TABET", "SIDI-TABET (Domaine cle). C. c. de Tunis, caïdat cle la banlieue. Haras.", 200, "place", None),
    ("BREIEAN", "BREIEAN (Paul-Auguste-René). 26 avril 1884, Paris. Secrétaire cle Contrôle civil, 44 (bis), avenue de Paris, Tunis.", 200, "person", None),
    ("Association sténo graphique unitaire", "Association sténo graphique unitaire (méthode Prévost-Delaunay). 20 octobre 1897. Groupe de Tunis. BUT : vulgariser la sténographie. 19 membres.", 200, "organisation", None),
    ("MUSCAT fils", "MUSCAT fils (C), mai 1866, Tunis. Entrepreneur de charpente.", 200, "person", None),
    ("Association des Elèves", "Association des Elèves (A.E.E.A.T.). 13 juillet 1902. Tunis. Siège social : Hôtel des Sociétés françaises. 50 membres.", 200, "organisation", "organisational_template"),
    ("Office Postal", "Office Postal (Direction de V). Les premières lignes télégraphiques datent de 1847.", 200, "state_body", "directorate_or_office"),
    ("FORETS", "FORETS (Direction des). La Direction des Forêts est un service.", 200, "state_body", None),
    ("AZEDINEBEY", "AZEDINEBEY. 1SS2, La Marsa. Grand cordon de l'Ordre du Sang. Prince de la famille beylicale.", 200, "person", "caps_headword_with_date"),
    ("BOULANGER Georges-Ernest-Jean-Alarie", "BOULANGER Georges-Ernest-Jean-Alarie. 1S37. Rennes. Général et homme politique français.", 200, "person", None),
    ("YAOULED", "YAOULED (arabe ya ouled, vocatif de garçon). En français local : jeune arabe, cireur, portefaix.", 109, "topic", "glossary_gloss"),
    ("Collège Sadiki", "Collège Sadiki. Voir Sadiki (Collège).", 38, "cross_reference", "see_also_only"),
    ("BORDJ-EL-ALAOUINE", "BORDJ-EL-ALAOUINE. C. c. de Tunis, caïdat de la Banlieue. Centre de colonisation français. (Voy. Massicault.)", 110, "place", None),
    ("STALIO", ". STALIO (Matteo di Vincenzo), Citlaventria, Dalmasia (Autriche), 20 mai 1854. Eponges en gros.", 200, "person", None),
]
