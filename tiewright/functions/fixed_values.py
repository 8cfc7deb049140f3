"""The tables and patterns by which printed entries are read.

Everything here is data that must have these very values for right results, in its natural order; the module has no logic.
Patterns are applied without regard to case unless their comment says otherwise.
"""

# ---- dates and rubrics
MONTH = r"(?:janv|jan|f[ée]vr?|mars|avril|avr|mai|juin|juill?|ao[uû]t|sept|oct|nov|d[ée]c)[a-zà-ÿ]*\.?"
YEAR = r"1[6-9]\d{2}"
YEAR_LOOSE = r"1[\.\s]?[\dSsOolIiGgCcBZzT][\.\s(]?[\dSsOolIiGgCcBZzT][\.\s(]?[\dSsOolIiGgCcBZzT]"
#: With regard to case.
RUBRICS = {
    "etudes": r"[EÉ]TUDES?\s*:",
    "carriere": r"SUCCESS(?:IVEMENT|IVEM|[’'\"1I])?\s*[.:]",
    "travaux": r"(?:T[RIEB]{1,2}[AI]VAUX|OEUVRES|O[IÎ]UVKES|OUVRAGES\s+PUBLI[EÉ]S|PUBLICATIONS)\s*:",
    "but": r"[BRH]\s?UT\s*:",
    "population": r"POPUL[A-Z]*\.?\s*:",
    "archeologie": r"ARCH[EÉ]?[A-Z]*\.?\s*:",
}

# ---- honours
GRADES = [
    ("grand_maitre", r"gr(?:and)?\.?\s*ma[iî]tre"),
    ("grand_croix", r"gr(?:and)?[\.\s-]*croix"),
    ("grand_cordon", r"gr(?:and)?[\.\s-]*cordon"),
    ("grand_officier", r"gr(?:and)?\.?\s*off(?:icier)?\.?"),
    ("commandeur", r"comm(?:andeur)?\.?"),
    ("officier", r"off(?:icier)?\.?"),
    ("chevalier", r"chev(?:alier)?\.?"),
    ("medaille", r"m[ée]daille"),
    ("titulaire", r"titulaire|d[ée]cor[ée]"),
]
#: Order, its words with the edits allowed, how many words on the others may stand, and the awarding state.
ORDERS = [
    ("legion_honneur", [("legion", 2), ("honneur", 3)], 3, "France"),
    ("palmes_academiques", [("academie", 2)], 1, "France"),
    ("palmes_academiques", [("instruction", 3), ("publique", 3)], 2, "France"),
    ("merite_agricole", [("merite", 2), ("agricole", 2)], 3, "France"),
    ("ouissam_alaouite", [("ouissam", 2)], 1, "Morocco"),
    ("ouissam_alaouite", [("alaouite", 2)], 1, "Morocco"),
    ("couronne_italie", [("couronne", 2), ("italie", 2)], 3, "Italy"),
    ("saints_maurice_lazare", [("maurice", 2), ("lazare", 2)], 3, "Italy"),
    ("etoile_noire_benin", [("etoile", 1), ("noire", 1)], 2, "France (Benin)"),
    ("etoile_anjouan", [("etoile", 2), ("anjouan", 2)], 3, "France (Comoros)"),
    ("ordre_radama", [("radama", 0)], 1, "France (Madagascar)"),
    ("medjidie", [("medjidie", 2)], 1, "Ottoman Empire"),
    ("osmanie", [("osmanie", 2)], 1, "Ottoman Empire"),
    ("isabelle_catholique", [("isabelle", 2), ("catholique", 3)], 3, "Spain"),
    ("charles_iii", [("charles", 1), ("iii", 0)], 2, "Spain"),
    ("christ_portugal", [("christ", 1), ("portugal", 2)], 3, "Portugal"),
    ("saint_olaf", [("olaf", 0)], 1, "Norway"),
    ("saint_stanislas", [("stanislas", 2)], 1, "Russia"),
    ("saint_sauveur_grece", [("sauveur", 2), ("grece", 2)], 3, "Greece"),
    ("francois_joseph", [("francois", 2), ("joseph", 2)], 2, "Austria-Hungary"),
    ("leopold_belgique", [("leopold", 2)], 1, "Belgium"),
    ("dannebrog", [("dannebrog", 2)], 1, "Denmark"),
    ("medaille_militaire", [("medaille", 2), ("militaire", 2)], 3, "France"),
    ("medaille_coloniale", [("medaille", 2), ("coloniale", 2)], 3, "France"),
    ("croix_rouge", [("croix", 0), ("rouge", 0)], 2, "international"),
    ("nichan_el_abed", [("nichan", 2), ("abed", 1)], 1, "Tunisia"),
    ("nichan_ed_dem", [("nichan", 2), ("dem", 1)], 1, "Tunisia"),
    ("nichan_iftikhar", [("nichan", 2)], 1, "Tunisia"),
]
#: The last order only counts where none of these follows its word.
UNLESS = {"nichan_iftikhar": [("abed", 1), ("dem", 1)]}

# ---- occupations, degrees, schools
OCCUPATIONS = [
    ("justice_law", r"avocat|avou[ée]|notaire|huissier|greffier|magistrat|\bjuge\b|procureur|substitut|oukil|cadi|ca[iï]d[ıi]?\s+de\s+justice|conseiller\s+[àa]\s+la\s+cour|pr[ée]sident\s+du\s+tribunal|d[ée]fenseur"),
    ("medicine_health", r"m[ée]decin|docteur\s+en\s+m[ée]decine|chirurgien|pharmacien|dentiste|v[ée]t[ée]rinaire|sage[\s\-]femme|interne\s+des\s+h[oô]pitaux"),
    ("military", r"g[ée]n[ée]ral|colonel|lieutenant[\s\-]colonel|commandant|capitaine|lieutenant|sous[\s\-]officier|adjudant|gendarme|officier\s+d[’'\s]*artillerie|chef\s+de\s+bataillon|mar[ée]chal"),
    ("education_science", r"professeur|instituteur|institutrice|direct(?:eur|rice)\s+d[’'\s]*[ée]cole|proviseur|censeur|inspecteur\s+de\s+l[’'\s]*enseignement|ma[iî]tre\s+d[’'\s]*[ée]tudes|savant|arch[ée]ologue|naturaliste"),
    ("religion", r"cur[ée]|pr[êe]tre|abb[ée]|pasteur|rabbin|imam|aum[oô]nier|[ée]v[êe]que|mufti|mokaddem|p[èe]re\s+blanc|chanoine"),
    ("engineering_architecture", r"ing[ée]nieur|architecte|g[ée]om[èe]tre|conducteur\s+des\s+ponts|dessinateur[\s\-]projeteur"),
    ("administration", r"fonctionnaire|contr[oô]leur|v[ée]rificateur|conservateur|tr[ée]sorier[\s-]payeur|chef\s+de\s+section|chef\s+de\s+bureau|chef\s+de\s+service|sous[\s\-]directeur|directeur\s+g[ée]n[ée]ral|secr[ée]taire\s+g[ée]n[ée]ral|r[ée]dacteur\s+[àa]\s+la\s+direction|\bcommis\b|receveur|percepteur|inspecteur|administrateur|attach[ée]\s+au\s+cabinet|interpr[èe]te|drogman"),
    ("politics_native_admin", r"d[ée]put[ée]|conseiller\s+municipal|\bmaire\b|adjoint\s+au\s+maire|conf[ée]rence\s+consultative|ca[iï]d\b|khalifa|gouverneur|cheikh\s+de|premier\s+ministre|ministre\s+de\s+la\s+plume"),
    ("diplomacy", r"consul|vice[\s\-]consul|charg[ée]\s+d[’'\s]*affaires|agent\s+consulaire"),
    ("commerce", r"n[ée]gociant|commer[çc]ant|marchand|[ée]picier|importateur|exportateur|courtier|repr[ée]sentant\s+de\s+commerce|magasin|quincaillier|libraire"),
    ("industry_crafts", r"industriel|entrepreneur|fabricant|minotier|imprimeur|constructeur|manufactur|usine|tanneur|boulanger|serrurier|menuisier|coiffeur|tailleur"),
    ("agriculture", r"\bcolon\b|agriculteur|viticulteur|[ée]leveur|exploitant\s+agricole|propri[ée]taire\s+agricole|fermier|ol[ée]iculteur|horticulteur"),
    ("finance_banking", r"banquier|banque|agent\s+de\s+change|assureur|assurances|comptable|changeur|courtier\s+d[’'\s]*assurance"),
    ("press_letters_arts", r"journaliste|publiciste|r[ée]dacteur\s+en\s+chef|directeur\s+du\s+journal|homme\s+de\s+lettres|[ée]crivain|po[èe]te|peintre|sculpteur|musicien|artiste|photographe"),
    ("mining", r"\bmine[sr]?\b|minier|phosphate"),
    ("transport_maritime", r"armateur|capitaine\s+au\s+long\s+cours|chef\s+de\s+gare|agent\s+maritime|transitaire|compagnie\s+de\s+navigation|chemins?\s+de\s+fer"),
    ("hospitality_services", r"h[oô]telier|restaurateur|caf[ée]tier|propri[ée]taire\s+d[’'\s]*h[oô]tel"),
]
DEGREES = [
    ("licence_droit", r"licenci[ée]\s+en\s+droit"),
    ("doctorat_droit", r"docteur\s+en\s+droit"),
    ("doctorat_medecine", r"docteur\s+en\s+m[ée]decine"),
    ("baccalaureat", r"bachelier|baccalaur[ée]at"),
    ("brevet_superieur", r"brevet\s+sup[ée]rieur"),
    ("agregation", r"agr[ée]g[ée]"),
    ("diplome_superieur", r"dipl[oô]m[ée]"),
    ("certificat", r"certificat"),
]
SCHOOL = (
    r"(?:Facult[ée]s?\s+(?:de\s+)?(?:droit|m[ée]decine|des\s+sciences|des\s+lettres|de\s+th[ée]ologie)[^.;:]{0,40}"
    r"|[EÉ]cole\s+(?:normale|polytechnique|centrale|coloniale|des\s+[A-Za-zà-ÿ\-]+|sup[ée]rieure[^.;:]{0,30}|de\s+[A-Za-zà-ÿ\-]+)"
    r"|lyc[ée]e\s+(?:de\s+|d[’']\s*|cle\s+)?[A-Za-zà-ÿ'\-]+"
    r"|coll[èe]ge\s+(?:de\s+|d[’']\s*|cle\s+)?(?:Sadiki|Alaoui|[A-Za-zà-ÿ'\-]+)"
    r"|Khaldounia|Grande\s+Mosqu[ée]e|Zitouna"
    r"|Institut\s+(?:national\s+)?[A-Za-zà-ÿ'\-]+)"
)
INSTITUTIONS = [
    ("university_faculty", r"facult[ée]|universit[ée]"),
    ("grande_ecole", r"[ée]cole\s+(?:normale\s+sup|polytechnique|centrale|coloniale|des\s+mines|des\s+ponts|sup[ée]rieure|nationale)"),
    ("teacher_training", r"[ée]cole\s+normale"),
    ("secondary_lycee", r"lyc[ée]e"),
    ("secondary_college", r"coll[èe]ge"),
    ("islamic_institution", r"khaldounia|grande\s+mosqu[ée]e|zitouna|sadiki"),
    ("technical_school", r"[ée]cole\s+(?:d[’']agriculture|professionnelle|pratique|d[’']arts)"),
    ("institute", r"institut"),
]

# ---- bodies
KINDS = [
    ("mutual_aid", r"secours\s+mutuels?|mutuelle|bienfaisance|philanthropi|orph[ée]linat"),
    ("professional_union", r"syndicat|amicale\s+des\s+fonctionnaires|association\s+amicale\s+des|corporation|chambre\s+syndicale"),
    ("chamber_public_body", r"chambre\s+de\s+commerce|chambre\s+d[’'\s]*agriculture|conf[ée]rence\s+consultative|conseil\s+"),
    ("learned_society", r"soci[ée]t[ée]\s+de\s+g[ée]ographie|institut|arch[ée]ologi|savante|scientifique|litt[ée]raire|[ée]tudes"),
    ("sport_leisure", r"sportive?|sports|nautique|gymnastique|cycliste|courses|chasse|v[ée]lo|foot"),
    ("alumni", r"anciens\s+[ée]l[èe]ves|anciens\s+combattants"),
    ("masonic", r"loge|ma[çc]onni|grand\s+orient"),
    ("religious", r"catholique|isra[ée]lite|protestant|paroisse|confr[ée]rie|charit[ée]\s+chr[ée]tienne"),
    ("music_arts", r"chorale|harmonie|musique|orph[ée]on|th[ée][âa]tre|beaux[\s\-]arts"),
    ("national_community", r"italiana|italienne|maltais|grecque|anglaise|espagnole|su[ié]sse|allemande|tunisina"),
    ("agricultural_economic", r"agricole|coop[ée]rative|colons|viticole|[ée]conomique"),
]
BODY_HEAD = (
    r"^(Association|Soci[ée]t[ée]|Societ[àa]|Associazione|Cercle|Club|Comit[ée]|Syndicat|"
    r"Chambre|Union|Ligue|Loge|Conf[ée]rence|Conseil|Compagnie|Banque|Caisse|F[ée]d[ée]ration|"
    r"Orph[ée]linat|Amicale|Mutuelle|Chorale|Harmonie|Croix|H[oô]pital|Institut|Dispensaire|"
    r"Mus[ée]e|Th[ée][âa]tre|Cr[ée]dit|Patronage|Fanfare|Alliance|Oeuvre|Fondation)\b"
)
BODY = r"BUT\s*:|Si[èe]ge\s+social|membres?\s+actifs?|adh[ée]rents|Pr[ée]s\.|pr[ée]sident"
STATE_HEAD = r"^(?:Office|Direction|Secr[ée]tariat|R[ée]gie|Recette\s+g[ée]n[ée]rale|Section\s+d[’']?\s*Etat|Services?)\b"
STATE_BRACKET = r"^[ ,.;]*\(\s*(?:Direction|Recette\s+g[ée]n[ée]rale|Administration|R[ée]gie|Service)\b"

# ---- places
#: With regard to case.
CITIES = (
    r"\b(Tunis|Sousse|Sfax|Bizerte|Kairouan|B[ée]ja|Gab[èe]s|Le\s+Kef|Mahdia|Monastir|"
    r"Nabeul|Zaghouan|Ferryville|La\s+Goulette|La\s+Marsa|Menzel[\s\-]Bourguiba|Djerba|"
    r"Gafsa|Tozeur|Medenine|Souk[\s\-]el[\s\-]Arba|Teboursouk|Grombalia|Tebourba|Carthage)\b"
)
ADDRESS = r"(\d{1,3}\s*(?:bis|ter)?\s*,\s*(?:rue|avenue|av\.|boulevard|bd|place|quai|impasse|passage|route)[^.;]{2,60})"
ADMIN_FIRST = (
    r"^[\s.,;:'’\-]*(?:\([^)]{0,30}\))?[\s.,;:'’\-]*"
    r"(?:C[.,]\s*c[.,:;]|Contr[oô]le\s+civil|Ca[iï]dat|Terr\.\s*mil\.|Territoire\s+militaire|"
    r"Annexe\s+et\s+ca[iï]dat|Ann\.\s*(?:et|de)\s)"
)
ADMIN = r"\bC[.,]\s*c[.,:;]|contr[oô]le\s+civil|ca[iï]dat|Territoire\s+militaire|POPUL|\bannexe\s+et\s+ca[iï]dat"
SETTLEMENT = (
    r"(?:village|douar|henchir|oasis|djebel|gorges|ha[oe]uch|bourgade|hameau|centre\s+de\s+colonisation"
    r"|localit[ée]|ferme|ruines\s+de|[iî]le\b)"
)
MEASURE = r"[àa]\s*\d{1,3}\s*(?:k|kil|kilom|km)[a-z.]*\s*(?:de|du|d[’'])|\bhab\.|habitants"
BEARING = r"[àa]\s*\d{1,3}\s*(?:k|kil|kilom|km)[a-z.]*\s*(?:au\s+[a-zà-ÿ\-]+\s+)?(?:de|du|des|d[’'])\s*[A-ZÉÈ]"
POPULATION = r"\b\d[\d.,\s]{0,8}\s*hab\.|\bhabitants\b"

# ---- headwords
#: With regard to case.
POINTER = r"\(\s*[Vv]\s*[-–—.,:]+\s*\S|\(\s*[Vv]o(?:ir|y)\b|\b[Vv]o(?:ir|y)\.?\s+[A-ZÉÈ«“]"
GLOSS = (
    r"\b(?:signifie|signifiant|litt[ée]ralement|veut\s+dire|nom\s+donn[ée]|nom\s+de\s+la|"
    r"terme\s+employ[ée]|d[ée]signe|d[ée]signant|mot\s+(?:arabe|italien|h[ée]breu|turc|"
    r"jud[ée]o[\s\-]arabe|berb[èe]re)|en\s+fran[çc]ais\s+local|pluriel\s+d|"
    r"sens\s+[ée]tymologique|on\s+appelle)\b"
)
#: Verbs that no headword has behind its first word; with regard to case.
VERBS = (
    r"est|était|sont|étaient|fut|furent|avait|avaient|ont|a\s+été|"
    r"tomba|fait|signifie|désigne|occupe|possède|comprend|contient|renferme|"
    r"exploité|exploitée|située|situé|reçoit|remonte|existe|appelle|servait|sert"
)
CONNECTIVES = "et ou dit dite nee veuve vve fils aine jeune ben bent bin ould bel".split()
#: What stands in the bracket behind a headword and is no forename; with regard to case.
NO_FORENAMES = (
    r"^(?:(?:LA|LE|LES|EL|El|Le|La|Les|les|la|le|ou|OU|dit|voir|Domaine|"
    r"Henchir|Oued|Djebel|Bordj|Dar|A[iï]n|Ville|Cap|[ÎIl]le)\b|(?:L[’']|V\.)(?=\w)|[’'\-])"
)
PATRONYMIC_PARTICLES = "BEN BENT BIN OULD ABD ABOU ABU BOU BEL EL SIDI SI OU".split()
HONORIFICS = r"\b(Si|Sidi|Hadj|Hadji|Cheikh|Bey|Pacha)\b"

# ---- names and roles
TITLES = (
    r"MM\.?|M\.|MAI\.?|A[I1]A[I1]\.?|Mme\.?|Mlle\.?|D[Rr]\.?|D['’]|docteur|"
    r"prof(?:esseur)?\.?|av(?:ocat)?\.?|cav\.|comm(?:andant)?\.?|cap(?:itaine)?\.?|"
    r"col(?:onel)?\.?|g[ée]n(?:[ée]ral)?\.?|ing(?:[ée]nieur)?\.?|abb[ée]|R\.\s*P\.|"
    r"S\.\s*A\.|Mgr|baron|comte|marquis|R[ée]sident\s+G[ée]n[ée]ral|Si|Sidi|Hadj|"
    r"cheikh|ca[iï]d|le|la|les|de"
)
#: Headings of lists, which are no names.
HEADINGS = (
    "BUREAU COMMISSION COMITE CONSEIL MEMBRES MEMBRE ADMINISTRATION PERMANENTE DIRECTEUR DIRECTION PRESIDENT SECRETAIRE TRESORIER ANCIENS ANCIEN ACTUEL SIEGE "
    "TRAVAUX BUT ETUDES SUCCESS MM M MAI ET LE LA LES DE DU DES"
).split()
#: Institutions where a person is expected.
NO_PERSONS = (
    "MUNICIPALITE GOUVERNEMENT CONFERENCE CONSULTATIVE COUR TRIBUNAL CHAMBRE SOCIETE ASSOCIATION COMITE DIRECTION ADMINISTRATION MINISTERE RESIDENCE PREFECTURE "
    "ETAT PROTECTORAT REPUBLIQUE PRES SECR TRES VICE HONNEUR BANQUE COMPAGNIE SYNDICAT CONSEIL REGENCE FRANCE TUNISIE"
).split()
#: The longer label stands before its own beginning.
ROLES = [
    ("honorary_president", r"pr[ée]s(?:ident)?s?\.?,?\s*d[’'\s]*honn?(?:eur)?"),
    ("honorary_vice_president", r"v(?:ice)?[\.\s-]*pr[ée]s(?:ident)?s?\.?,?\s*d[’'\s]*honn?"),
    ("past_president", r"anc(?:ien|\.)\s*s?\.?\s*pr[ée]s(?:ident)?s?"),
    ("vice_president", r"v(?:ice)?[\.\s-]*pr[ée]s(?:ident)?s?\.?"),
    ("president", r"pr[ée]s(?:ident)?s?\.?"),
    ("secretary_general", r"secr[ée]?t?a?i?r?e?\.?[\s-]*g[ée]n(?:[ée]ral)?\.?"),
    ("deputy_secretary", r"secr[ée]?t?a?i?r?e?\.?[\s-]*adj(?:oint)?\.?"),
    ("secretary", r"secr[ée]?t?a?i?r?e?\.?"),
    ("deputy_treasurer", r"tr[ée][ss]?\.?[\s-]*adj(?:oint)?\.?|tr[ée]sorier[\s-]*adj"),
    ("treasurer", r"tr[ée][ss]?(?:orier)?\.?"),
    ("archivist_librarian", r"archiviste|biblioth[ée]caire"),
    ("assessor", r"assess(?:eur)?s?\.?"),
    ("board_member", r"membres?\s+du\s+bureau|conseil\s+d[’'\s]*administration|comit[ée]\s+directeur"),
    ("councillor", r"conseillers?"),
    ("commissioner", r"commiss(?:aire)?s?\.?"),
    ("delegate", r"d[ée]l[ée]gu[ée]s?"),
    ("director", r"directeur|g[ée]rant"),
    ("founder", r"fondateur|fondatrice|membres?\s+fondateurs?"),
    ("honorary_member", r"membres?\s+d[’'\s]*honn(?:eur)?|membres?\s+honor(?:aires?)?"),
    ("member", r"membres?\s+actifs?|membres?|soci[ée]taires?|adh[ée]rents?"),
]
#: Roles that several people hold.
PLURAL_ROLES = ("board_member", "councillor", "member", "honorary_member", "assessor", "commissioner", "delegate", "founder", "past_president")
AFFILIATION_ROLES = [
    r"membre\s+correspondant", r"membre\s+fondateur", r"membre\s+d[’'\s]*honneur", "membre", r"pr[ée]sident\s+d[’'\s]*honneur", r"pr[ée]sident", r"vice[\s-]pr[ée]sident", r"v\.-pr[ée]s\.",
    r"secr[ée]taire\s+g[ée]n[ée]ral", r"secr[ée]taire", r"tr[ée]sorier", "administrateur", "fondateur", "conseiller", "assesseur", r"d[ée]l[ée]gu[ée]", "censeur", "commissaire", "rapporteur", "directeur",
]
#: An affiliation's body has one of these nouns.
BODY_NOUNS = (
    r"\b(soci[ée]t[ée]|societ[àa]|associazione|association|cercle|club|chambre|comit[ée]|"
    r"ligue|syndicat|loge|conseil|conf[ée]rence|institut|acad[ée]mie|banque|compagnie|"
    r"caisse|f[ée]d[ée]ration|union|amicale|mutuelle|orph[ée]linat|[ée]cole|coll[èe]ge|"
    r"h[oô]pital|croix|alliance|oeuvre|fondation|patronage|harmonie|chorale|commission|"
    r"tribunal|municipalit[ée]|conservatoire|mus[ée]e|barreau)\b"
)
NO_BODIES = ["tunisie", "tunis", "france", "regence", "la regence", "protectorat", "ville", "region", "pays", "commission", "meme", "cette", "celle", "cette societe", "cette compagnie", "cette association", "meme societe", "police"]
