"""Words that are one edit apart, by pairs of trie nodes.

The nodes of a trie over all words and of one over all reversed words are numbered. A word then is a row of integer
pairs: skipping its position ``i`` leaves the prefix node at ``i`` and the suffix node behind ``i``; the gap before ``i``
leaves the prefix node at ``i`` and the suffix node from ``i`` on. Two words with a skip in common differ by a replaced
code point there; a word whose gap is another's skip lacks its code point. A pair names its word but for one code point, so at
most as many words as the alphabet has letters share one, and nothing has to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# A word's characters, lower-cased A-Z only.
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELT = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
# A node's number is that of its part and, in the low bits, its own in the part.
NODE_BITS = 40


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the words with at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences.

    Where ``MISSPELT`` divides the checksum of ``<id>:<run>`` the run loses one code point; a null id is empty there.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = marked.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


def _shared(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def _numbered(words: DataFrame, key: Column, nodes: str) -> DataFrame:
    """``words`` with ``nodes``: the numbers of the trie nodes on the way of each distinct ``key``, the root's 0 first.

    Sorted parts are numbered each on their own: a word makes a new node for each code point beyond what it
    shares with the word before. What a part's first word shares with the part before is numbered there.
    """
    sent = words.select("*", key.alias("__key"), F.lit(0).alias("__part"), F.array().cast("array<bigint>").alias(nodes))
    columns = sent.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, way, used = "", [0], part << NODE_BITS
        for batch in batches:
            ways = []
            for word in batch.column("__key").to_pylist():
                shared = _shared(last, word)
                way = way[: shared + 1] + list(range(used + 1, used + 1 + len(word) - shared))
                used += len(word) - shared
                last = word
                ways.append(way)
            own = {"__part": pa.array([part] * batch.num_rows, pa.int32()), nodes: pa.array(ways, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(c)) for c in columns], columns)

    ordered = sent.repartitionByRange("__key").sortWithinPartitions("__key").mapInArrow(run, sent.schema)
    ordered = written(ordered, "nodes")
    # Two words per part, as many as shuffle partitions at most.
    ends = ordered.groupBy("__part").agg(F.min("__key").alias("first"), F.max(F.struct("__key", nodes)).alias("last"))
    moved, before = [], None
    for row in sorted(ends.collect(), key=lambda r: r["__part"]):
        last, way = row["last"]
        if before is not None:
            shared = _shared(before[0], row["first"])
            if shared:
                right = before[1][1 : shared + 1]
                moved.append((row["__part"], right))
                # The part's first nodes are those of its first word.
                base = row["__part"] << NODE_BITS
                way = [right[x - base - 1] if base < x <= base + shared else x for x in way]
        before = (last, way)
    ordered = ordered.withColumnRenamed("__part", "__own")
    if not moved:
        return ordered.drop("__key", "__own")
    # A row per part, as long as what two neighbouring words share: bounded like the parts.
    table = words.sparkSession.createDataFrame(moved, "__part int, __right array<bigint>")
    joined = ordered.join(F.broadcast(table), F.col("__own") == F.col("__part"), "left")
    place = F.lit((1 << NODE_BITS) - 1)

    def right(x: Column) -> Column:
        own = (F.shiftright(x, NODE_BITS) == F.col("__own")) & (x.bitwiseAND(place) > 0)
        return F.coalesce(F.when(own, F.get("__right", (x.bitwiseAND(place) - 1).cast("int"))), x)

    fixed = F.when(F.col("__right").isNull(), F.col(nodes)).otherwise(F.transform(nodes, right))
    return joined.withColumn(nodes, fixed).drop("__key", "__own", "__part", "__right")


def _dictionary(words: DataFrame) -> DataFrame:
    """``prefix, suffix, w, n, gap, start``: a row per skipped position and per gap of every word.

    ``w`` is the word's last trie node, a number that grows with the word in code-point order. Of equal
    neighbouring code points only the first one's skip is a ``start``: leaving out any of them gives the same word.
    """
    size = F.char_length("word")
    places = words.select("word", "n", "down", "up", F.element_at("down", -1).alias("w"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    after = F.col("up")[size - F.col("i")]
    behind = F.col("up")[size - F.col("i") - 1]
    here = F.substring("word", F.col("i") + 1, F.lit(1))
    rows = places.select(
        "w", "n", F.col("down")[F.col("i")].alias("prefix"),
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("gap"), after.alias("suffix"), F.lit(False).alias("start")),
                F.struct(
                    F.lit(False).alias("gap"),
                    F.when(F.col("i") < size, behind).alias("suffix"),
                    ((F.col("i") == 0) | (here != F.substring("word", F.col("i"), F.lit(1)))).alias("start"),
                ),
            )
        ).alias("row"),
    )
    return rows.select("w", "n", "prefix", "row.*").filter("suffix is not null")


def near_words(words: DataFrame) -> DataFrame:
    """``w, n_near, best`` of the words that have near ones; ``best`` is a struct of minus the count and ``w``.

    A near pair by replacement shares one pair of nodes, one by a missing code point one gap and one start of a skip.
    """
    rows = _dictionary(words)
    member = F.struct((-F.col("n")).alias("o"), "w", "start")
    keys = rows.groupBy("prefix", "suffix").agg(
        F.array_sort(F.collect_list(F.when(~F.col("gap"), member))).alias("skips"),
        F.max(F.when(F.col("gap"), member)).alias("gap"),
    )
    keys = keys.filter(F.size("skips") + F.col("gap").isNotNull().cast("int") > 1)

    def bare(m: Column) -> Column:
        return F.struct(m["o"].alias("o"), m["w"].alias("w"))

    starts = F.filter("skips", lambda m: m["start"])
    lone = F.col("gap").isNotNull()

    def of_skip(m: Column) -> Column:
        other = F.when(F.col("skips")[0]["w"] == m["w"], F.get("skips", F.lit(1))).otherwise(F.col("skips")[0])
        shorter = F.when(m["start"], F.col("gap"))
        count = F.size("skips") - 1 + (lone & m["start"]).cast("int")
        best = F.least(F.when(other.isNotNull(), bare(other)), F.when(shorter.isNotNull(), bare(shorter)))
        return F.struct(m["w"].alias("w"), count.alias("n_near"), best.alias("best"))

    first = F.get(starts, F.lit(0))
    of_gap = F.struct(F.col("gap")["w"].alias("w"), F.size(starts).alias("n_near"), F.when(first.isNotNull(), bare(first)).alias("best"))
    found = F.concat(F.transform("skips", of_skip), F.when(lone, F.array(of_gap)).otherwise(F.slice(F.array(of_gap), F.lit(1), F.lit(0))))
    each = keys.select(F.explode(found).alias("m")).select("m.*").filter("n_near > 0")
    return each.groupBy("w").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``w, root`` of words with a form, from ``w, form``: forms are followed to the last.

    A form is at least twice as frequent as its word, so a chain has a few dozen links at most and doubling the steps ends
    after a few rounds.
    """
    steps = written(forms.select("w", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("w").alias("root"), F.col("root").alias("ahead"))
        further = written(steps.join(ahead, "root", "left").select("w", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("open")), "roots")
        if not further.filter("open").take(1):
            return further.select("w", "root")
        steps = further.select("w", "root")


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``word_counts``.

    Near words differ by one inserted, deleted or replaced code point. A word's ``form`` is the most frequent near
    word (of several the first in code-point order) if that is at least ``RATIO`` times as frequent, else null. ``root`` is
    reached by following forms. Null, empty and repeated texts count as they are; an empty table gives an empty one. Other
    columns are not read.
    """
    counts = written(word_counts(docs, key, text), "words")
    words = _numbered(_numbered(counts, F.col("word"), "down"), F.reverse("word"), "up")
    words = written(words, "tries")
    best = written(near_words(words), "near")
    known = words.select("word", "n", F.element_at("down", -1).alias("w"))
    strong = -F.col("best")["o"] >= RATIO * F.col("n")
    rows = known.join(best, "w", "left").select("w", "word", "n", "n_near", F.when(strong, F.col("best")).alias("best"))
    rows = written(rows, "forms")
    roots = _roots(rows.filter("best is not null").select("w", F.col("best.w").alias("form")))
    named = known.select(F.col("w").alias("to"), F.col("word").alias("name"))
    done = rows.join(roots, "w", "left").select("word", "n", "n_near", "best", F.col("root").alias("last"))
    done = done.join(named.toDF("t1", "form"), F.col("best.w") == F.col("t1"), "left")
    done = done.join(named.toDF("t2", "root"), F.col("last") == F.col("t2"), "left")
    return done.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        (-F.col("best")["o"]).alias("form_n"),
    )
