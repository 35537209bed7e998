"""Text search in an entity table: the best entities of a mention by BM25.

Entities with the same words are one class, of which only the first entities are ever
needed. A class has one whole number per word, its impact; a mention scores the sum of
the impacts of the words it shares with the class.

No mention meets all classes of a frequent word. `heads` has, for each word and each
pair of words, the best classes by the impacts of just these words. If a class shares
exactly one or two words with a mention and is among its best k, then it is among the
first k of that list, as all before it score at least as much. So the heads alone answer
mentions of one or two words, and give every other one a score that its k-th result has
at least. With it, only classes that share more words are looked for, in the lists of
pairs (for classes of many words: of single words), and only in those parts that the
largest impacts of the mention's remaining words can lift to that score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelink.functions.formats import LIST_LIMIT
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import first_k

# Parameters of BM25, and what one unit of score counts.
SATURATION, LENGTH_SHARE, UNIT = 1.2, 0.75, 1_000_000.0
# Texts of up to this many different words are listed under their pairs of words.
PAIRED_WORDS = 24


def search_words(text: Column) -> Column:
    """Words of a text: runs of letters and digits, lower-cased; empty for null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.coalesce(words, F.array().cast("array<string>"))


def _pairs(words: Column) -> Column:
    """Pairs of a sorted array, as arrays."""
    return F.flatten(
        F.transform(
            words,
            lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.array(a, b)),
        )
    )


@dataclass(frozen=True)
class EntityIndex:
    """What a search reads; computed anew by each use unless saved.

    classes   class, n_words, impacts (map), first (struct rank, id), entities (array)
    heads     words (one or two), class, impact, first, at (1 to k)
    singles   word, class, impact, long
    pairs     words, class, impact, of classes that are not long
    """

    classes: DataFrame
    heads: DataFrame
    singles: DataFrame
    pairs: DataFrame

    def save(self, path: str) -> EntityIndex:
        """Write the tables below `path`; later searches read them from there."""
        for field in fields(self):
            getattr(self, field.name).write.mode("error").parquet(f"{path}/{field.name}")
        return read_index(self.classes.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> EntityIndex:
    return EntityIndex(*(spark.read.parquet(f"{path}/{field.name}") for field in fields(EntityIndex)))


def build_index(
    entities: DataFrame,
    k: int = LIST_LIMIT,
    paired_words: int = PAIRED_WORDS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> EntityIndex:
    """Index of an entity table (id, label, description, rank) for the best `k`.

    The words are those of label and description. Entities without a word, or without
    an id, are not found. Classes are named by 64 bits of their words. `keep` is as in
    `search_entities`.
    """
    text = F.concat_ws(" ", "label", "description")
    named = (
        entities.where(F.col("id").isNotNull())
        .select("id", "label", "description", "rank", F.sort_array(search_words(text)).alias("bag"))
        .where(F.size("bag") > 0)
    )
    counts = named.groupBy("bag").agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.struct(
            F.sum("n").cast("double").alias("n"),
            (F.sum(F.size("bag") * F.col("n")).cast("double") / F.sum("n").cast("double")).alias("length"),
        )
    )
    n, mean_length = totals.scalar()["n"], totals.scalar()["length"]
    frequency = (
        counts.select(F.explode(F.array_distinct("bag")).alias("word"), "n")
        .groupBy("word")
        .agg(F.sum("n").cast("double").alias("df"))
        .select("word", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("weight"))
    )
    best = (
        first_k(named, k, keys=["bag"], order=["rank", "id"], out="at")
        .groupBy("bag")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "id", "label", "description"))).alias("entities"))
    )
    bags = best.select(
        F.xxhash64("bag").alias("class"), "bag", "entities",
        F.struct(F.col("entities")[0]["rank"].alias("rank"), F.col("entities")[0]["id"].alias("id")).alias("first"),
    )
    share = F.size("bag").cast("double") / mean_length
    words = F.array_distinct("bag")
    said = bags.select(
        "class",
        (share * LENGTH_SHARE + (1.0 - LENGTH_SHARE)).alias("norm"),
        (F.size(words) > paired_words).alias("long"),
        F.explode(
            F.transform(
                words,
                lambda w: F.struct(
                    w.alias("word"), F.size(F.filter("bag", lambda x: x == w)).cast("double").alias("tf")
                ),
            )
        ).alias("_said"),
    ).select("class", "norm", "long", "_said.*")
    tf = F.col("tf")
    score = F.col("weight") * (tf * (SATURATION + 1.0)) / (tf + F.col("norm") * SATURATION)
    singles = keep(
        many_to_one(said, frequency, ["word"], "inner").select(
            "word", "class", F.floor(score * UNIT).cast("bigint").alias("impact"), "long"
        )
    )
    impacts = singles.groupBy("class").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "impact")))).alias("impacts")
    )
    classes = keep(
        bags.join(impacts, "class").select(
            "class", F.size(F.map_keys("impacts")).alias("n_words"), "impacts", "first", "entities"
        )
    )
    paired = F.when(F.col("n_words") <= paired_words, _pairs(F.map_keys("impacts")))
    pairs = classes.select("class", "impacts", "first", F.explode(paired).alias("words")).select(
        "words", "class", (F.col("impacts")[F.col("words")[0]] + F.col("impacts")[F.col("words")[1]]).alias("impact"),
        "first",
    )
    alone = classes.select("class", "first", F.explode("impacts").alias("word", "impact")).select(
        F.array("word").alias("words"), "class", "impact", "first"
    )
    down = alone.unionByName(pairs).withColumn("down", -F.col("impact"))
    heads = keep(first_k(down, k, keys=["words"], order=["down", "first"], out="at").drop("down"))
    return EntityIndex(classes, heads, singles, pairs.drop("first"))


def _scored(found: DataFrame, index: EntityIndex) -> DataFrame:
    """Score of each words and class, whatever listed it."""
    total = F.aggregate(
        "words",
        F.lit(0).cast("bigint"),
        lambda sum_, word: sum_ + F.coalesce(F.try_element_at("impacts", word), F.lit(0).cast("bigint")),
    )
    known = index.classes.select("class", "impacts", "first")
    return many_to_one(found.distinct(), known, ["class"], "inner").select(
        "words", "class", total.alias("score"), "first"
    )


def _best(scored: DataFrame, k: int) -> DataFrame:
    down = scored.withColumn("down", -F.col("score"))
    return first_k(down, k, keys=["words"], order=["down", "first"], out="at").drop("down")


def _listed(asked: DataFrame, index: EntityIndex, paired_words: int) -> DataFrame:
    """words and class: what the heads of the words, and of their pairs, have."""
    alone = F.transform("words", lambda w: F.array(w))
    pairs = F.when(F.size("words") <= paired_words, F.concat(alone, _pairs(F.col("words")))).otherwise(alone)
    keys = asked.select("words", F.explode(pairs).alias("key"))
    return keys.join(index.heads.select(F.col("words").alias("key"), "class"), "key").select("words", "class")


def _deeper(asked: DataFrame, near: DataFrame, index: EntityIndex, k: int, paired_words: int) -> DataFrame:
    """words and class: classes that share more words than the heads vouch for and may
    reach the k-th score.

    The mention's words are ordered by their largest impact. A class is looked for under
    the two last words that it shares (one, for long classes and mentions), and gains at
    most the largest impacts of all words before them.
    """
    reached = near.where(F.col("at") == k).select("words", F.col("score").alias("least"))
    tops = index.heads.where((F.size("words") == 1) & (F.col("at") == 1)).select(
        F.col("words")[0].alias("word"), F.col("impact").alias("top")
    )
    known = many_to_one(asked.select("words", F.explode("words").alias("word")), tops, ["word"], "inner")
    ordered = (
        known.groupBy("words")
        .agg(F.sort_array(F.collect_list(F.struct("top", "word"))).alias("order"))
        .where(F.size("order") >= 2)
        .join(reached, "words", "left")
        .withColumn("least", F.coalesce("least", F.lit(0).cast("bigint")))
    )
    # At each place of the order: what all words before it add at most.
    steps = F.aggregate(
        "order",
        F.array(F.lit(0).cast("bigint")),
        lambda sums, word: F.concat(sums, F.array(F.element_at(sums, -1) + word["top"])),
    )
    placed = ordered.withColumn("before", steps).withColumn("few", F.size("words") <= paired_words)
    one = placed.select(
        "words", "few", "least", "before", F.posexplode("order").alias("at", "last")
    ).where(F.col("at") >= 1)
    need = (F.col("least") - F.col("before")[F.col("at")]).alias("need")
    by_one = one.select("words", "few", F.col("last.word").alias("word"), F.col("last.top").alias("top"), need)
    by_one = by_one.where(F.col("top") >= F.col("need")).drop("top")
    singles = by_one.join(index.singles, "word").where(
        (F.col("long") | ~F.col("few")) & (F.col("impact") >= F.col("need"))
    )
    two = one.where(F.col("few") & (F.col("at") >= 2)).select(
        "words", "least", "last", F.posexplode(F.slice("before", F.lit(1), F.col("at"))).alias("place", "less"),
        F.col("at"),
    )
    order_of = placed.select("words", "order")
    two = two.where(F.col("place") >= 1).join(order_of, "words").withColumn("other", F.col("order")[F.col("place")])
    two = two.where(F.col("last.top") + F.col("other.top") >= F.col("least") - F.col("less"))
    by_two = two.select(
        F.col("words").alias("asked"),
        F.sort_array(F.array("last.word", "other.word")).alias("words"),
        (F.col("least") - F.col("less")).alias("need"),
    )
    pairs = by_two.join(index.pairs, "words").where(F.col("impact") >= F.col("need"))
    return singles.select("words", "class").unionByName(
        pairs.select(F.col("asked").alias("words"), "class")
    )


def search_entities(
    mentions: DataFrame,
    index: EntityIndex,
    k: int = LIST_LIMIT,
    paired_words: int = PAIRED_WORDS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """One row per mention and found entity: the mention columns, place (1 to k),
    entity_id, label, description, score.

    The best are those with the highest score, then by rank and id. `k` and
    `paired_words` are those the index was built with. Mentions are searched for once
    per set of words, however often they occur; null, wordless and unknown ones are left
    out. `keep` stores a table that is read twice; without it, it is made twice.
    """
    words = F.sort_array(F.array_distinct(search_words(F.col("mention"))))
    keyed = mentions.withColumn("_words", words)
    asked = keep(keyed.select(F.col("_words").alias("words")).where(F.size("words") > 0).distinct())
    near = keep(_best(_scored(_listed(asked, index, paired_words), index), k))
    far = _scored(_deeper(asked, near, index, k, paired_words), index)
    both = near.select("words", "class", "score", "first").unionByName(far).distinct()
    of_class = index.classes.select("class", F.col("entities"))
    found = (
        many_to_one(_best(both, k).select("words", "class", "score"), of_class, ["class"], "inner")
        .select("words", "score", F.inline("entities"))
        .withColumn("down", -F.col("score"))
    )
    hits = first_k(found, k, keys=["words"], order=["down", "rank", "id"], out="place")
    per_words = hits.groupBy("words").agg(
        F.sort_array(
            F.collect_list(F.struct("place", F.col("id").alias("entity_id"), "label", "description", "score"))
        ).alias("_hits")
    )
    return many_to_one(
        keyed, per_words.withColumnRenamed("words", "_words"), ["_words"], "inner"
    ).select(*mentions.columns, F.inline("_hits"))
