"""Interpretive labels from tiered evidence (AGG17 to AGG19, LBL1 to LBL5, FN46).

Evidence is (entity, token, label, weight); what has none stays unknown. Each step only ever reads the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiewright.operators.profile import vote

UNKNOWN = "unknown"


def tally(entities: DataFrame, evidence: DataFrame, key: str = "entity") -> DataFrame:
    """One row for each entity: label, confidence, evidence, competing (AGG17, AGG18).

    The label with the largest sum wins. Its confidence is that of its strongest piece (3 high, 2 medium, 1 low), or low if
    another label ties with it; then both are named.
    """
    top = vote(evidence, key, "label", "weight")
    strongest = evidence.groupBy(key, F.col("label").alias("winner")).agg(F.max("weight").alias("strongest"))
    tokens = evidence.groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("evidence"))
    level = F.when(F.col("tied"), "low").when(F.col("strongest") >= 3, "high").when(F.col("strongest") == 2, "medium").otherwise("low")
    out = entities.join(top.join(strongest, [key, "winner"]).join(tokens, key), key, "left")
    return out.select(
        *entities.columns, F.coalesce("winner", F.lit(UNKNOWN)).alias("label"), F.when(F.col("winner").isNotNull(), level).alias("confidence"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.when(F.col("tied"), F.array("winner", "runner_up")).otherwise(F.array().cast("array<string>")).alias("competing"),
    )


def fallback(df: DataFrame, token: str, label: str) -> DataFrame:
    """Entities without a vote take ``label`` at low confidence if they have the weak token (LBL1)."""
    weak = (F.col("label") == UNKNOWN) & F.array_contains("evidence", token)
    return df.withColumn("confidence", F.when(weak, "low").otherwise(F.col("confidence"))).withColumn("label", F.when(weak, label).otherwise(F.col("label")))


def override(df: DataFrame, tokens: list[str], label: str) -> DataFrame:
    """Decisive tokens fix the label at high confidence, whatever the vote (LBL2)."""
    hit = F.arrays_overlap("evidence", F.array(*map(F.lit, tokens)))
    return df.withColumn("label", F.when(hit, label).otherwise(F.col("label"))).withColumn("confidence", F.when(hit, "high").otherwise(F.col("confidence")))


def place_unknown(df: DataFrame, condition: Column, label: str, basis: str) -> DataFrame:
    """Unknown entities for which the condition holds get the label at medium confidence, with a token for the basis (LBL3)."""
    hit = (F.col("label") == UNKNOWN) & condition
    df = df.withColumn("__hit", hit)
    return (
        df.withColumn("label", F.when(F.col("__hit"), label).otherwise(F.col("label"))).withColumn("confidence", F.when(F.col("__hit"), "medium").otherwise(F.col("confidence")))
        .withColumn("evidence", F.when(F.col("__hit"), F.array_append("evidence", F.lit(basis))).otherwise(F.col("evidence"))).drop("__hit")
    )


def retract(df: DataFrame, condition: Column, note: str) -> DataFrame:
    """Entities for which the condition holds go back to unknown, with a token that says so (LBL4)."""
    df = df.withColumn("__hit", F.coalesce(condition, F.lit(False)))
    return (
        df.withColumn("label", F.when(F.col("__hit"), UNKNOWN).otherwise(F.col("label"))).withColumn("confidence", F.when(~F.col("__hit"), F.col("confidence")))
        .withColumn("evidence", F.when(F.col("__hit"), F.array_append("evidence", F.lit(note))).otherwise(F.col("evidence"))).drop("__hit")
    )


def annotate(df: DataFrame, label: str, token: str, note: str) -> DataFrame:
    """A note where a label and a token meet (LBL5)."""
    hit = (F.col("label") == label) & F.array_contains("evidence", token)
    return df.withColumn("evidence", F.when(hit, F.array_append("evidence", F.lit(note))).otherwise(F.col("evidence")))


def agreement(df: DataFrame, rule: str, prior: str, unless: Column | None = None) -> DataFrame:
    """(n_agree, n_disagree, precision) of a rule's label against an earlier one, rows that the rule placed left out (AGG19)."""
    both = df.where(F.col(rule).isNotNull() & F.col(prior).isNotNull() & (F.col(prior) != UNKNOWN))
    if unless is not None:
        both = both.where(~unless)
    sums = both.agg(F.count_if(F.col(rule) == F.col(prior)).alias("n_agree"), F.count_if(F.col(rule) != F.col(prior)).alias("n_disagree"))
    return sums.withColumn("precision", F.col("n_agree") / F.nullif(F.col("n_agree") + F.col("n_disagree"), F.lit(0)))


def basis(evidence: Column, order: list[tuple[str, list[str]]]) -> Column:
    """The first basis with a token among the evidence (FN46); null if none has."""
    found = [F.when(F.arrays_overlap(evidence, F.array(*map(F.lit, tokens))), F.lit(name)) for name, tokens in order]
    return F.coalesce(*found, F.lit(None).cast("string"))


def birth_context(evidence: Column, homes: tuple[str, ...] = ("tunisia", "algeria"), elsewhere: str = "europe") -> Column:
    """Where the evidence says that somebody was born: the first of ``homes``, elsewhere for any other birthplace, or unrecorded (FN46)."""
    out = F.when(F.exists(evidence, lambda e: e.startswith("birth_")), elsewhere).otherwise("unrecorded")
    for home in reversed(homes):
        out = F.when(F.array_contains(evidence, f"birth_{home}"), home).otherwise(out)
    return out


#: The finer position, by position, community ("" for any other) and birth ("" for any other).
DETAILS = [
    ("colonist", "", "europe", "metropolitan_colonist"), ("colonist", "", "tunisia", "colony_born_colonist"), ("colonist", "", "algeria", "colony_born_colonist"), ("colonist", "", "", "colonist_unspecified"),
    ("native", "tunisian_muslim", "", "native_muslim"), ("native", "", "europe", "native_jewish_european_status"), ("native", "", "algeria", "native_jewish_european_status"), ("native", "", "", "native_jewish"),
]


def position_detail(position: Column, community: Column, birth: Column, table: list[tuple[str, str, str, str]] = DETAILS) -> Column:
    """The finer position of the first line of the table that fits, unknown if none does (FN46)."""
    out = F.lit(UNKNOWN)
    for p, c, b, detail in reversed(table):
        out = F.when((position == p) & ((community == c) if c else F.lit(True)) & ((birth == b) if b else F.lit(True)), detail).otherwise(out)
    return out


#: Signs of gender, the name of each being its piece of evidence.
TITLE = r"(?U)^\s*\(\s*(?:M|Al|AI|A1|Mm|Mme|Mlle|Mile|Mll)[\"'’\.]{1,3}\s*(?=[A-ZÉÈ]|\))|^\s*\(\s*(?:Mme|Madame|Mlle|Mademoiselle|V(?:eu)?ve)\b"
PARTICIPLE = r"(?iuU)\bn[ée]e\b[\s.,]*(?=(?:[àa]\b|[A-ZÉÈ][a-zà-ÿ]{2}))"
FEMININE = (
    r"(?iuU)\bdirectrice\b|\binstitutrice\b|\bsage[\s-]femme\b|\breligieuse\b|\binfirmi[èe]re\b|\bsurveillante\b|\bfondatrice\b|\bcollaboratrice\b|"
    r"\bs[oœ]ur\b|\bveuve\b|\bla\s+m[èe]re\b"
)
MASCULINE = (
    r"(?iuU)\binstituteur\b|\bdirecteur\b|\bpasteur\b|\bcur[ée]\b|\bpr[êe]tre\b|\brabbin\b|\bimam\b|\bcolonel\b|\bcapitaine\b|\bg[ée]n[ée]ral\b|"
    r"\bcommandant\b|\bpr[ée]sident\b|\bconsul\b|\bavocat\b|\bing[ée]nieur\b|\boukil\b|\bca[iï]d\b|\bcheikh\b|\bn[ée]\s+[àa]\b"
)


def gender(people: DataFrame, feminine: list[str], masculine: list[str]) -> DataFrame:
    """``people`` (entry_id, head, forenames, text) with label, confidence and evidence (FN48).

    Forenames are parameters: unaccented, lower case, of three letters or more; a masculine one counts before a feminine one.
    A title in the headword's bracket, a feminine participle or a feminine occupation decides whatever else is said.
    """
    from tiewright.functions.text import norm

    opening = F.substring(F.col("text"), F.lit(1), F.char_length("head") + 200)
    behind = F.substring(F.col("text"), F.char_length("head") + 1, F.lit(80))
    tokens = F.filter(F.split(norm(F.coalesce("forenames", F.lit(""))), r"[-\s.(),]+"), lambda t: F.char_length(t) > 2)
    has = lambda names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)).cast("array<string>"))
    piece = lambda condition, token, value, weight: F.when(condition, F.struct(F.lit(token).alias("token"), F.lit(value).alias("label"), F.lit(weight).alias("weight")))
    votes = F.array_compact(F.array(
        piece(behind.rlike(TITLE), "civil_title", "FEMALE", 3), piece(opening.rlike(PARTICIPLE), "birth_participle", "FEMALE", 3), piece(opening.rlike(FEMININE), "feminine_occupation", "FEMALE", 3),
        piece(opening.rlike(MASCULINE), "masculine_occupation", "MALE", 2), piece(has(masculine), "masculine_forename", "MALE", 2), piece(~has(masculine) & has(feminine), "feminine_forename", "FEMALE", 2),
    ))
    evidence = people.select(F.col("entry_id").alias("entity"), F.explode(votes).alias("v")).select("entity", "v.*")
    out = override(tally(people.withColumn("entity", F.col("entry_id")), evidence), ["civil_title", "birth_participle", "feminine_occupation"], "FEMALE")
    return out.withColumn("label", F.when(F.col("label") == UNKNOWN, "UNKNOWN").when(F.size("competing") > 0, F.when(F.arrays_overlap("evidence", F.array(F.lit("civil_title"), F.lit("birth_participle"), F.lit("feminine_occupation"))), "FEMALE").otherwise("MALE")).otherwise(F.col("label"))).drop("entity")
