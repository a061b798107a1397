"""A stored index of words and trigrams: searches read the buckets of the query's terms, updates write those of changed concepts.

Folders under the index's path, all with a generation: ``words`` and ``grams``
(by bucket of the term) and ``changed`` (the concepts that a generation
replaces). A generation counts once its ``changed`` is written, which comes
last; one that failed before is written over. An entry holds until a later
generation has its concept among the changed ones, and compaction leaves one
generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.functions.scalars import text_rank, text_words, trigrams
from noema.operators.common import checkpointed, lookup

#: Fixed values of the rank: places of a word that are kept, and the largest place.
PLACES, LAST = 255, 16383
WORD = "store string, id string, term string, places array<int>, bucket int, gen long"
GRAM = "store string, id string, term string, size int, bucket int, gen long"
CHANGED = "store string, id string, gen long"
#: Characters that a task indexes, where one of a title, which makes about as many entries as ten of other texts, counts as ten.
TEXT = 32_000_000
#: Numbers that concepts are hashed to, to tell which entries a later generation may have replaced: no more lines than that are broadcast.
MARKS = 1 << 20
#: Titles whose trigrams a task makes.
TITLES = 100_000


def _texts(concepts: DataFrame) -> list[str]:
    return [c for c in ("title", "description", "body") if c in concepts.columns]


def task_count(concepts: DataFrame) -> int:
    """Tasks to index ``concepts`` in: they follow the texts, so that a task's memory doesn't."""
    weighed = (F.coalesce(F.length(c), F.lit(0)) * (10 if c == "title" else 1) for c in _texts(concepts))
    held = concepts.agg(F.sum(sum(weighed, F.lit(0)))).first()[0] or 0
    spark = concepts.sparkSession
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), held // TEXT + 1)


def word_entries(concepts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Words of living concepts with their places: store, id, term, places. Title, description and body (those that there are) count as one text; a word keeps its first places."""
    # texts are dealt out, not their words: what is grouped by concept and word already lies together by concept
    living = concepts.where("status <> 'tombstone'")
    dealt = living.repartition("id") if tasks is None else living.repartition(tasks, "id")
    rows = dealt.select("store", "id", F.posexplode(text_words(F.concat_ws(" ", *_texts(concepts)))).alias("at", "term"))
    numbered = rows.select("store", "id", "term", F.least(F.col("at") + 1, F.lit(LAST)).alias("at"))
    return numbered.groupBy("store", "id", "term").agg(F.slice(F.array_sort(F.collect_set("at")), 1, PLACES).alias("places"))


def gram_entries(concepts: DataFrame) -> DataFrame:
    """Trigrams of living concepts' titles: store, id, term, size (of the set that it is from)."""
    sets = concepts.where("status <> 'tombstone'").select("store", "id", trigrams(F.col("title")).alias("set"))
    return sets.select("store", "id", F.size("set").alias("size"), F.explode("set").alias("term"))


@dataclass(frozen=True)
class TextIndex:
    """An index at a path that all executors see, with ``buckets`` folders of terms a generation.

    Entries are written where they are made, so a task of an update or a compaction has a file in each
    folder that it has terms of; they would take more room in a shuffle than on disk.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        """The latest complete generation; -1 where nothing has been written."""
        last = self._table("changed", CHANGED).agg(F.max("gen")).first()[0]
        return -1 if last is None else last

    def _write(self, gen: int, changed: DataFrame, words: DataFrame, grams: DataFrame) -> None:
        for name, rows in (("words", words), ("grams", grams)):
            placed = rows.withColumn("bucket", self._bucket(F.col("term"))).sortWithinPartitions("bucket", "term")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/gen={gen}")
        # the empty row marks the generation as complete even where nothing was changed
        mark = self.spark.range(1).select(F.lit(None).cast("string").alias("store"), F.lit(None).cast("string").alias("id"))
        changed.select("store", "id").distinct().unionAll(mark).write.mode("overwrite").parquet(f"{self.path}/changed/gen={gen}")

    def update(self, concepts: DataFrame, removed: DataFrame | None = None) -> int:
        """Takes new and changed ``concepts`` in, and those in ``removed`` (store, id) out; tombstones go out as well. Work follows the concepts given, not the index."""
        gen = self.generation() + 1
        touched = concepts.select("store", "id")
        touched = touched if removed is None else touched.unionAll(removed.select("store", "id"))
        tasks = task_count(concepts)
        self._write(gen, touched, word_entries(concepts, tasks), gram_entries(concepts.repartition(tasks, "id")))
        return gen

    def live(self, name: str, schema: str, terms: list[str] | None = None) -> DataFrame:
        """Entries that hold, of ``terms`` or of all. Only the buckets of the terms are read; of all, only entries that may have been replaced are shuffled."""
        done = self.generation()
        rows = self._table(name, schema).where(F.col("gen") <= done)
        if terms is not None:
            rows = rows.where(F.col("term").isin(*terms) & F.col("bucket").isin(*(self._bucket(F.lit(t)) for t in terms))) if terms else rows.limit(0)
        changed = self._table("changed", CHANGED).where("id is not null").groupBy("store", "id").agg(F.max("gen").alias("last"), F.min("gen").alias("first"))
        # what has changed in one generation only has no other entries
        last = changed.where("last > first").select("store", "id", "last").hint("shuffle_hash")
        settled = lambda found: found.join(last, ["store", "id"], "left").where("last is null or gen >= last").drop("last")
        if terms is not None:
            return settled(rows).drop("bucket", "gen")
        mark = F.pmod(F.xxhash64("store", "id"), F.lit(MARKS)).alias("mark")
        marked = rows.withColumn("mark", mark).join(F.broadcast(last.groupBy(mark).agg(F.max("last").alias("latest"))), "mark", "left").drop("mark")
        sure, doubtful = marked.where("latest is null or gen >= latest"), marked.where("gen < latest")
        return sure.drop("latest").unionByName(settled(doubtful.drop("latest"))).drop("bucket", "gen")

    def compact(self) -> int:
        """One generation with all that holds; earlier ones count no more, since every concept is among its changed ones."""
        gen = self.generation() + 1
        words, grams = (self.live(n, s) for n, s in (("words", WORD), ("grams", GRAM)))
        self._write(gen, self._table("changed", CHANGED).where("id is not null"), words, grams)
        return gen

    def search(self, words: list[str], limit: int = 20) -> DataFrame:
        """Concepts with all words by their rank, then by id and store: store, id, score, rank."""
        terms = sorted(set(words))
        hits = self.live("words", WORD, terms).groupBy("store", "id").agg(F.count("*").alias("n"), F.collect_list("places").alias("places")).where(F.col("n") == len(terms))
        scored = hits.select("store", "id", text_rank(F.col("places")).alias("score"))
        return _placed(scored, "score", limit)

    def similar(self, grams: list[str], least: float = 0.3, limit: int = 20) -> DataFrame:
        """Concepts whose titles have at least ``least`` of all trigrams in common with ``grams``: store, id, similarity, rank.

        Shared trigrams are counted from the entries of the query's alone; titles that are too
        short or too long to reach ``least`` are left out in the scan.
        """
        wanted = len(set(grams))
        rows = self.live("grams", GRAM, sorted(set(grams))).where(F.col("size").between(F.lit(least * wanted - 1e-9), F.lit(wanted / max(least, 1e-9) + 1e-9)))
        found = rows.groupBy("store", "id", "size").agg(F.count("*").alias("shared")).select("store", "id", (F.col("shared") / (F.col("size") + wanted - F.col("shared"))).alias("similarity"))
        return _placed(found.where(F.col("similarity") >= least), "similarity", limit)


def _placed(rows: DataFrame, by: str, limit: int) -> DataFrame:
    order = (F.desc(by), "id", "store")
    best = rows.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def title_classes(concepts: DataFrame) -> DataFrame:
    """Living concepts by the set of trigrams of their title: store, id, class (the smallest id of those alike), set. Titles without words are in no class."""
    # a title goes to its task before its trigrams are made, and what meets is one text of three characters a trigram
    titles = concepts.where("status <> 'tombstone'").select("store", "id", "title").repartition(max(1, concepts.count() // TITLES), "id")
    sets = titles.select("store", "id", F.array_join(F.array_sort(trigrams(F.col("title"))), "").alias("grams")).where("grams <> ''")
    names = sets.groupBy("grams").agg(F.min("id").alias("class"))
    set_ = F.transform(F.sequence(F.lit(1), F.length("grams"), F.lit(3)), lambda k: F.col("grams").substr(k, F.lit(3)))
    return sets.join(names.hint("merge"), "grams").select("store", "id", "class", set_.alias("set"))


def title_candidates(classes: DataFrame, least: float) -> DataFrame:
    """Pairs of classes (class, set) that may have ``least`` of all trigrams in common: a, b.

    Two such sets share a trigram among the first of each in any one order, so few are looked
    at: those that the fewest classes have come first. Sets too different in size don't meet. A
    trigram that very many classes begin with is one key of a join that Spark can split.
    """
    sets = classes.select("class", F.size("set").alias("n"), F.explode("set").alias("gram"))
    counts = sets.groupBy("gram").agg(F.count("*").alias("held"))
    ranked = lookup(sets, counts, ["gram"])
    place = F.row_number().over(W.partitionBy("class").orderBy("held", "gram"))
    first = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least - 1e-9) * F.col("n")) + 1).select("class", "n", "gram", "place")
    a, b = (first.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"), "gram", F.col("place").alias(f"at_{k}")) for k in "ab")
    # what is shared at this place or later can't be more than what either set has left
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    needed = F.lit(least / (1 + least) - 1e-9) * (F.col("n_a") + F.col("n_b"))
    fits = (F.col("a") < F.col("b")) & (F.col("n_b") >= F.col("n_a") * (least - 1e-9)) & (F.col("n_a") >= F.col("n_b") * (least - 1e-9)) & (left >= needed)
    return a.join(b.hint("merge"), "gram").where(fits).select("a", "b").distinct()


def similar_titles(concepts: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Titles with at least ``least`` of all trigrams in common: pairs of different classes (a, b, similarity), and the classes of all concepts (store, id, class). Concepts of one class are alike and no pairs."""
    classes = checkpointed(title_classes(concepts))
    sets = checkpointed(classes.where(F.col("id") == F.col("class")).dropDuplicates(["class"]).select("class", "set"))
    # sets go to their pairs in shuffles, as on disk they are far smaller than in the driver's memory
    sides = [sets.select(F.col("class").alias(k), F.col("set").alias(f"set_{k}")).hint("merge") for k in "ab"]
    pairs = title_candidates(sets, least).join(sides[0], "a").join(sides[1], "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    scored = pairs.select("a", "b", (shared / (F.size("set_a") + F.size("set_b") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= least), classes.select("store", "id", "class")
