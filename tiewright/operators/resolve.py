"""Joins that resolve, canonicalise and merge (JN2 to JN13, JN17, JN18, SET1 to SET7, S3, S4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order (S4, SET2)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def last_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the last in order (S3). ``order``: columns, ascending."""
    return first_wins(df, key, [F.desc(c) for c in order])


def join_required(df: DataFrame, index: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` looked up by ``key``, of which ``index`` has each once; a key that it lacks stops the query (JN1)."""
    found = index.select(key, F.struct(F.col(column).alias("v")).alias("__found"))
    missing = F.raise_error(F.concat(F.lit(f"no {column} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(index.schema[column].dataType)
    return df.join(found, key, "left").withColumn(column, F.when(F.col("__found").isNotNull(), F.col("__found.v")).otherwise(missing)).drop("__found")


def keyed_or_synthetic(df: DataFrame, index: DataFrame, key: str, id_column: str, prefix: str) -> DataFrame:
    """``df`` with ``id_column`` looked up by ``key``, or else the key behind a prefix (JN7)."""
    return df.join(index.select(key, id_column), key, "left").withColumn(id_column, F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit(prefix), F.col(key))))


def deletion_signatures(word: Column) -> Column:
    """The word and every form of it with one letter deleted: words within one edit share a signature."""
    n = F.char_length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def index_keys(entities: DataFrame, entity: str, key: str, least: int = 4) -> DataFrame:
    """(entity, key): the whole key and, if different and of ``least`` letters, its first word (JN11)."""
    head = F.element_at(F.split(key, " "), 1)
    both = F.array_distinct(F.array_compact(F.array(F.col(key), F.when((head != F.col(key)) & (F.char_length(head) >= least), head))))
    return entities.select(F.col(entity).alias("entity"), F.explode(both).alias("key")).distinct()


def resolve(mentions: DataFrame, index: DataFrame, exact_least: int = 3, fuzzy_least: int = 5) -> DataFrame:
    """(mention, entity, resolution, n_candidates) for mentions (mention, name_key) against an index (entity, key).

    The whole name is tried first, then its words of ``exact_least`` letters in order; the first with any candidate decides
    (JN8). Names without an exact candidate are tried word by word within one edit, among words and keys of ``fuzzy_least``
    letters (JN9). One candidate resolves, several are ambiguous and give no entity, none is unmatched (JN10).

    Mentions meet keys, never the entities behind a key: those are counted once for a key, or a set of keys.
    """
    index = index.select("entity", "key").distinct()
    held = index.groupBy("key").agg(F.count("*").alias("n_candidates"), F.min("entity").alias("entity"))
    words = F.filter(F.split("name_key", " "), lambda w: F.char_length(w) >= exact_least)
    tries = mentions.select("mention", F.posexplode(F.concat(F.array("name_key"), words)).alias("place", "key"))

    def decide(hits: DataFrame, suffix: str) -> DataFrame:
        """The keys (an array) of each mention's first place: hits are (mention, place, keys)."""
        places = hits.groupBy("mention", "place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("keys"))
        chosen = places.groupBy("mention").agg(F.min_by("keys", "place").alias("keys"))
        single = chosen.where(F.size("keys") == 1).select("mention", F.get("keys", F.lit(0)).alias("key")).join(held, "key").select("mention", "n_candidates", "entity")
        several = chosen.where(F.size("keys") > 1)
        found = single.unionByName(several.join(entities_of(several.select("keys").distinct(), index), "keys").select("mention", "n_candidates", "entity"))
        one = F.col("n_candidates") == 1
        return found.select("mention", F.when(one, F.col("entity")).alias("entity"), F.when(one, f"resolved{suffix}").otherwise(f"ambiguous{suffix}").alias("resolution"), "n_candidates")

    exact = decide(tries.join(held.select("key"), "key").select("mention", "place", F.array("key").alias("keys")), "")
    left = mentions.join(exact, "mention", "left_anti")
    words = F.filter(F.split("name_key", " "), lambda w: F.char_length(w) >= fuzzy_least)
    loose = left.select("mention", F.posexplode(words).alias("place", "word"))
    tried = loose.select("word").distinct().select("word", F.explode(deletion_signatures(F.col("word"))).alias("sign"))
    signs = held.where(F.char_length("key") >= fuzzy_least).select("key", F.explode(deletion_signatures(F.col("key"))).alias("sign"))
    near = tried.join(signs, "sign").where(F.levenshtein("word", "key", 1) >= 0).groupBy("word").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    fuzzy = decide(loose.join(near, "word").select("mention", "place", "keys"), "_fuzzy")
    found = exact.unionByName(fuzzy)
    return mentions.select("mention").join(found, "mention", "left").select("mention", "entity", F.coalesce("resolution", F.lit("unmatched")).alias("resolution"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def entities_of(sets: DataFrame, index: DataFrame) -> DataFrame:
    """(keys, n_candidates, entity) for distinct sets of keys (arrays): how many entities have any of the keys, and the least.

    Entities that have the same keys among those of all sets are counted together first, so that a set meets classes of
    entities and not each entity.
    """
    asked = sets.select("keys", F.explode("keys").alias("key"))
    classes = index.join(asked.select("key").distinct(), "key").groupBy("entity").agg(F.array_sort(F.collect_set("key")).alias("had"))
    classes = classes.groupBy("had").agg(F.count("*").alias("n"), F.min("entity").alias("entity"))
    met = asked.join(classes.select("had", "n", "entity", F.explode("had").alias("key")), "key").select("keys", "had", "n", "entity").distinct()
    return met.groupBy("keys").agg(F.sum("n").alias("n_candidates"), F.min("entity").alias("entity"))


def canonical_names(names: DataFrame, generic: list[str], least: int = 2) -> DataFrame:
    """(name, canonical) for distinct names: a name whose distinctive words all occur in an earlier one becomes that one (JN12).

    Names are in order of falling number of words, then length, then the name. Words in ``generic`` are not distinctive;
    names with fewer than ``least`` distinctive words stay themselves. A name meets others only through its rarest word.
    """
    words = F.array_distinct(F.filter(F.split("name", " "), lambda w: (w != "") & ~w.isin(generic)))
    rows = names.select("name").distinct().withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("rank", F.struct(-F.col("n"), -F.char_length("name"), F.col("name")))
    kept = rows.where(F.col("n") >= least)
    own = kept.select("name", F.explode("words").alias("word"))
    seen = own.groupBy("word").agg(F.count("*").alias("seen"))
    rarest = own.join(seen, "word").groupBy("name").agg(F.min_by("word", F.struct("seen", "word")).alias("word"))
    small = kept.join(rarest, "name").select("name", "words", "rank", "word")
    large = kept.select(F.col("name").alias("into"), F.col("rank").alias("into_rank"), F.col("words").alias("into_words"), F.explode("words").alias("word"))
    pairs = small.join(large, "word").where((F.col("into_rank") < F.col("rank")) & (F.size(F.array_except("words", "into_words")) == 0))
    first = pairs.groupBy("name").agg(F.min_by("into", "into_rank").alias("into"))
    return rows.select("name").join(first, "name", "left").select("name", F.coalesce("into", "name").alias("canonical"))


def best_overlap(items: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """(item, span, overlap): each item's interval (low, high) with the span of the same group that it overlaps most.

    Overlaps may be negative, where nothing overlaps; ties go to the nearer beginning and then to the smaller span (JN13).
    """
    joined = items.select(*on, "item", F.col("low").alias("a1"), F.col("high").alias("a2")).join(spans.select(*on, "span", F.col("low").alias("b1"), F.col("high").alias("b2")), on)
    overlap = F.least("a2", "b2") - F.greatest("a1", "b1")
    joined = joined.withColumn("overlap", overlap).withColumn("away", F.abs(F.col("a1") - F.col("b1")))
    best = joined.groupBy("item").agg(F.min_by(F.struct("span", "overlap"), F.struct(-F.col("overlap"), F.col("away"), F.col("span"))).alias("x"))
    return best.select("item", "x.span", "x.overlap")


def deletions(word: Column, most: Column | int, bound: int) -> Column:
    """The word and every form of it with up to ``most`` letters deleted, ``most`` being at most ``bound``."""
    most = F.lit(most) if isinstance(most, int) else most
    out = F.array(word)
    for k in range(1, bound + 1):
        longer = F.array_distinct(F.flatten(F.transform(out, deletion_signatures)))
        out = F.when(most >= k, longer).otherwise(out)
    return out


def vocabulary_hits(tokens: DataFrame, rules: list[tuple[str, str, int]], word: str = "word") -> DataFrame:
    """``tokens`` with each rule (label, anchor, most) that a word is within the edit distance ``most`` of, 0 to 3 (JN18, FN38).

    Words within k edits share a form with up to k letters deleted on either side: anchors and different words meet on such
    forms by an equal join, and only those that meet are compared. Words too short or too long for every rule are not
    looked at. Null words match nothing; rules that say the same count once.
    """
    bound = max((k for _, _, k in rules), default=0)
    if not 0 <= bound <= 3 or not rules:
        raise ValueError("rules are needed, with distances of 0 to 3")
    spark = tokens.sparkSession
    shortest, longest = min(len(a) - k for _, a, k in rules), max(len(a) + k for _, a, k in rules)
    forms = spark.createDataFrame(sorted(set(rules)), "label string, anchor string, most int").withColumn("form", F.explode(deletions(F.col("anchor"), F.col("most"), bound)))
    words = tokens.select(F.col(word).alias("__word")).where(F.char_length("__word").between(shortest, longest)).distinct()
    met = words.withColumn("form", F.explode(deletions(F.col("__word"), bound, bound))).join(F.broadcast(forms), "form")  # a rule's forms: 300 at 12 letters
    hits = met.where(F.levenshtein("__word", "anchor") <= F.col("most")).select("__word", "label", "anchor", "most").distinct()
    return tokens.join(hits, F.col(word) == F.col("__word")).drop("__word")


def merge_measures(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two measured node sets; what one of them lacks is null, never 0 (JN6)."""
    return left.join(right, key, "full")


def partition_sets(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """(combination, n): keys by the sets they are in, none of them counted twice (SET3, SET4)."""
    held = df.groupBy(key).agg(*[F.max(c.cast("int")).alias(n) for n, c in flags.items()])
    label = F.concat_ws("+", *[F.when(F.col(n) == 1, F.lit(n)) for n in flags])
    return held.groupBy(F.when(label == "", "none").otherwise(label).alias("combination")).agg(F.count("*").alias("n"))
