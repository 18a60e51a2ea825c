"""Language-model data: token streams cut into lanes and chunks.

Tokens are never rows. A document knows its place in the stream from a prefix sum of lengths, cuts its
own token list at the chunk borders, and a chunk is put together from the few cuts that reach it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import exploded
from ..session import written
from .joins import tokens_to_ids
from .position import prefix_sum
from .skew import FREQUENT, frequent_values, is_small
from .split import random_key
from .vocab import vocab_by_frequency


# So many chunks are sent and put together at a time.
CARRIED = 16


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _span(low: Column, high: Column, build) -> Column:
    """``build(i)`` for all i from low to high; nothing when high < low."""
    items = F.transform(F.sequence(low, F.greatest(low, high)), build)
    return F.slice(items, 1, F.greatest(high - low + 1, F.lit(0)).cast("int"))


def _stream(df: DataFrame, tokens: str, row_id: str, bsz: int) -> DataFrame:
    """Rows with their first place ``off``, length ``len``, steps per lane ``n_step``.

    Only row numbers and lengths are ranked and summed; token lists are written once, before, and meet their offsets
    without a sort: in place if the offsets are small, else by a hash join that builds on the offsets.
    """
    named = df.select(F.col(row_id).alias("__row"), F.col(tokens).alias("__tok"), F.size(tokens).cast("long").alias("len"))
    stored = written(named, "tokens")
    keys = stored.select("__row", "len")
    offsets = prefix_sum(keys, ["__row"], F.col("__row"), F.col("len"), name="off", total="__n").drop("len")
    offsets = written(offsets, "offsets")
    near = F.broadcast(offsets) if is_small(offsets) else offsets.hint("shuffle_hash")
    placed = stored.join(near, "__row")
    n_step = _div(F.col("__n"), F.lit(bsz))
    return placed.withColumn("n_step", n_step).filter(F.col("n_step") > 0)


def _lane_parts(bsz: int, cut) -> Column:
    """``cut(lane, s0, s1, base)`` for each lane a row reaches: its steps s0..s1 (exclusive) start at
    place ``base`` of the row's tokens. Tokens after the last full lane are left out."""
    off, length, n_step = F.col("off"), F.col("len"), F.col("n_step")

    def one(lane: Column) -> Column:
        start = lane * n_step
        s0 = F.greatest(off, start) - start
        s1 = F.least(off + length, start + n_step) - start
        return cut(lane, s0, s1, start + s0 - off)

    first = _div(off, n_step)
    last = F.least(_div(off + length - 1, n_step), F.lit(bsz - 1).cast("long"))
    return F.flatten(_span(first, last, one))


def _reassemble(parts: DataFrame, key: list[str], column: str = "part") -> DataFrame:
    """Put the cuts of each chunk together in order of their first step."""
    ordered = F.sort_array(F.collect_list(F.struct("step", column)))
    return parts.groupBy(*key).agg(
        F.flatten(F.transform(ordered, lambda p: p[column])).alias("__all"), F.max("n_step").alias("n_step")
    )


def pack_contiguous(
    df: DataFrame, tokens: str, bsz: int, bptt: int, ext_len: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """The stream of all rows' tokens as ``lane, chunk, seq_len, data, target``.

    The stream is cut into ``bsz`` equal lanes (the remainder is dropped) and lanes into chunks of
    ``bptt`` steps. ``target`` is the token after each step; ``data`` also carries up to ``ext_len``
    steps before the chunk.
    """
    placed = _stream(df, tokens, row_id, bsz)
    n_step = F.col("n_step")
    size, ext = F.lit(bptt).cast("long"), F.lit(ext_len).cast("long")
    n_chunks = _div(n_step - 1 + size - 1, size)

    # Cuts travel in runs of chunks, so that the context of a chunk is sent once for the run and not for each chunk.
    wide = size * CARRIED
    n_runs = _div(n_chunks + CARRIED - 1, F.lit(CARRIED).cast("long"))

    def window(start, width):
        """The steps from the first of the context to the last target."""
        return start - F.least(ext, start), F.least(start + width, n_step - 1) + 1

    def cut(lane, s0, s1, base):
        def run(r):
            low, high = window(r * wide, wide)
            a, b = F.greatest(low, s0), F.least(high, s1)
            part = F.slice(F.col("__tok"), (base + a - s0 + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
            return F.struct(lane.alias("lane"), r.alias("run"), a.alias("step"), part.alias("part"))

        return _span(_div(F.greatest(s0 - 1, F.lit(0)), wide), F.least(_div(s1 - 1 + ext, wide), n_runs - 1), run)

    def chunk(c):
        low, high = window(c * size, size)

        def reached(p):
            return F.least(high, p["step"] + F.size(p["part"])) > F.greatest(low, p["step"])

        def own(p):
            a, b = F.greatest(low, p["step"]), F.least(high, p["step"] + F.size(p["part"]))
            return F.struct(a.alias("step"), F.slice(p["part"], (a - p["step"] + 1).cast("int"), (b - a).cast("int")).alias("part"))

        return F.struct(c.alias("chunk"), F.sort_array(F.transform(F.filter("__parts", reached), own)).alias("parts"))

    cuts = exploded(placed, ["n_step"], _lane_parts(bsz, cut), "c")
    cuts = cuts.select("n_step", "c.*").filter(F.size("part") > 0)
    runs = cuts.groupBy("lane", "run").agg(F.collect_list(F.struct("step", "part")).alias("__parts"), F.max("n_step").alias("n_step"))
    first = F.col("run") * CARRIED
    chunks = exploded(runs, ["lane", "n_step"], _span(first, F.least(first + CARRIED, n_chunks) - 1, chunk), "c")
    chunks = chunks.select("lane", "n_step", "c.*").filter(F.size("parts") > 0)
    start = F.col("chunk") * size
    context = F.least(ext, start)
    seq_len = F.least(size, n_step - 1 - start)
    return chunks.withColumn("__all", F.flatten(F.transform("parts", lambda p: p["part"]))).select(
        "lane",
        "chunk",
        seq_len.alias("seq_len"),
        F.slice("__all", F.lit(1), (context + seq_len).cast("int")).alias("data"),
        F.slice("__all", (context + 2).cast("int"), seq_len.cast("int")).alias("target"),
    )


def uniform(col: Column, seed: int) -> Column:
    """A fixed pseudo-random number in (0, 1) per value."""
    return (random_key(col, seed).cast("double") + 0.5) / F.lit(float(2**60))


def chunk_borders(
    df: DataFrame, n_step: int, bptt: int, std: float = 5.0, min_len: int = 5, max_deviation: int = 3, seed: int = 0
) -> DataFrame:
    """``chunk, start, seq_len`` of variable chunks that cover ``n_step`` steps.

    A length is normal around ``bptt`` (around half of it for one chunk in twenty) and kept between
    ``min_len`` and ``bptt + max_deviation * std``. Lengths depend on seed and chunk number only, so
    the borders are their prefix sums.
    """
    spark = df.sparkSession
    chunks = spark.range(0, n_step // min_len + 1).withColumnRenamed("id", "chunk")
    c = F.col("chunk")
    mean = F.when(uniform(c, seed) < 0.95, F.lit(float(bptt))).otherwise(F.lit(bptt / 2))
    normal = F.sqrt(-2 * F.log(uniform(c, seed + 1))) * F.cos(F.lit(2 * math.pi) * uniform(c, seed + 2))
    longest = int(bptt + max_deviation * std)
    length = F.least(F.lit(longest), F.greatest(F.lit(min_len), (mean + F.lit(float(std)) * normal).cast("int")))
    sized = chunks.withColumn("len", length.cast("long"))
    placed = prefix_sum(sized, ["chunk"], c, F.col("len"), name="start")
    placed = placed.filter((c == 0) | (F.col("start") < n_step - 2))
    return placed.select(
        "chunk", "start", F.least(F.col("len"), F.lit(n_step - 1) - F.col("start")).alias("seq_len")
    )


def pack_variable(
    df: DataFrame,
    tokens: str,
    bsz: int,
    bptt: int,
    ext_len: int = 0,
    std: float = 5.0,
    min_len: int = 5,
    max_deviation: int = 3,
    seed: int = 0,
    row_id: str = "row_id",
) -> DataFrame:
    """Like ``pack_contiguous`` with chunks of random length (see ``chunk_borders``).

    Steps and borders meet by blocks of steps about one chunk long: an equality join in which a row's
    cut meets only the two or three chunks near it.
    """
    total = df.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first()[0]
    n_step = total // bsz
    block = F.lit(int(bptt + max_deviation * std)).cast("long")
    placed = _stream(df, tokens, row_id, bsz)

    def cut(lane, s0, s1, base):
        def piece(k):
            a = F.greatest(k * block, s0)
            b = F.least((k + 1) * block, s1)
            part = F.slice(F.col("__tok"), (base + a - s0 + 1).cast("int"), (b - a).cast("int"))
            return F.struct(lane.alias("lane"), k.alias("block"), a.alias("step"), part.alias("part"))

        return _span(_div(s0, block), _div(s1 - 1, block), piece)

    pieces = exploded(placed, ["n_step"], _lane_parts(bsz, cut), "c").select("n_step", "c.*")
    borders = chunk_borders(df, n_step, bptt, std, min_len, max_deviation, seed)
    context = F.least(F.lit(ext_len).cast("long"), F.col("start"))
    reach = borders.withColumn("begin", F.col("start") - context).withColumn(
        "end", F.col("start") + F.col("seq_len") + 1
    )
    near = reach.withColumn("block", F.explode(F.sequence(_div(F.col("begin"), block), _div(F.col("end") - 1, block))))
    met = pieces.join(near, "block")
    a = F.greatest("step", "begin")
    b = F.least(F.col("step") + F.size("part"), F.col("end"))
    cuts = met.filter(b > a).select(
        "lane",
        "chunk",
        "start",
        "seq_len",
        "n_step",
        a.alias("step"),
        F.slice("part", (a - F.col("step") + 1).cast("int"), (b - a).cast("int")).alias("part"),
    )
    seq_len = F.col("seq_len")
    return _reassemble(cuts, ["lane", "chunk", "start", "seq_len"]).select(
        "lane",
        "chunk",
        "start",
        "seq_len",
        F.slice("__all", F.lit(1), (context + seq_len).cast("int")).alias("data"),
        F.slice("__all", (context + 2).cast("int"), seq_len.cast("int")).alias("target"),
    )


def pack_sentences(
    df: DataFrame,
    tokens: str,
    bsz: int,
    bptt: int,
    ext_len: int = 0,
    seed: int = 0,
    shuffle: bool = True,
    row_id: str = "row_id",
    shard: str | None = None,
) -> DataFrame:
    """Sentences in no fixed order as ``lane, chunk, data, target`` (and the shard).

    A sentence gives one (token, next token) pair less than it has tokens. The shard's pairs are one stream
    that is cut into ``bsz`` lanes of equal length, so a sentence at a border goes on in the next lane. Every
    shard leaves out less than ``bsz`` pairs and one unfinished batch, ``bsz * bptt``.
    """
    key = random_key(F.col(row_id), seed)
    rows = df.select(
        (F.col(shard) if shard else F.lit("")).alias("shard"),
        F.col(row_id).alias("__row"),
        F.col(tokens).alias("__tok"),
        F.greatest(F.size(tokens) - 1, F.lit(0)).cast("long").alias("len"),
        key.alias("__key"),
    )
    order = ["__key", "__row"] if shuffle else ["__row"]
    placed = prefix_sum(
        rows, order, F.col(order[0]).cast("double"), F.col("len"), by=["shard"], name="off", total="__n"
    )
    size, ext = F.lit(bptt).cast("long"), F.lit(ext_len).cast("long")
    lane_len = _div(F.col("__n"), F.lit(bsz).cast("long"))
    placed = placed.withColumn("lane_len", lane_len).withColumn("n_batch", _div(F.col("lane_len"), size))
    placed = placed.filter((F.col("n_batch") > 0) & (F.col("len") > 0))

    def lane(number):
        base = number * F.col("lane_len")
        off, end = F.greatest(F.col("off") - base, F.lit(0)), F.col("off") + F.col("len") - base

        def chunk(c):
            start = c * size
            a = F.greatest(start - F.least(ext, start), off)
            b = F.least(start + size, end)
            n = F.greatest(b - a, F.lit(0)).cast("int")
            first = (a + base - F.col("off")).cast("int")
            return F.struct(
                number.cast("int").alias("lane"),
                c.alias("chunk"),
                a.alias("step"),
                F.slice(F.col("__tok"), first + 1, n).alias("d"),
                F.slice(F.col("__tok"), first + 2, n).alias("t"),
            )

        last = F.least(end, F.col("n_batch") * size)
        return _span(_div(off, size), F.least(_div(last - 1 + ext, size), F.col("n_batch") - 1), chunk)

    final = F.least(_div(F.col("off") + F.col("len") - 1, F.col("lane_len")), F.lit(bsz - 1).cast("long"))
    chunks = F.flatten(_span(_div(F.col("off"), F.col("lane_len")), final, lane))
    cuts = exploded(placed, ["shard"], chunks, "c").select("shard", "c.*")
    ordered = F.sort_array(F.collect_list(F.struct("step", "d", "t")))
    context = F.least(ext, F.col("chunk") * size)
    packed = (
        cuts.filter(F.size("d") > 0)
        .groupBy("shard", "lane", "chunk")
        .agg(ordered.alias("__p"))
        .select(
            "shard",
            "lane",
            "chunk",
            F.flatten(F.transform("__p", lambda p: p["d"])).alias("data"),
            F.slice(F.flatten(F.transform("__p", lambda p: p["t"])), (context + 1).cast("int"), F.lit(bptt)).alias("target"),
        )
    )
    return packed.withColumnRenamed("shard", shard) if shard else packed.drop("shard")


def pack_shards(
    df: DataFrame, tokens: str, bsz: int, bptt: int, shard: str, ext_len: int = 0, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """``pack_sentences`` shard by shard, with each shard's key in the shuffled shard order."""
    packed = pack_sentences(df, tokens, bsz, bptt, ext_len, seed, True, row_id, shard)
    return packed.withColumn("shard_order", random_key(F.col(shard), seed))


# End markers of the encodings.
EOS, EDGE = "<eos>", "<S>"


def add_eos(tokens: Column, mode: str) -> Column:
    """``none``, ``eos`` (one mark at the end) or ``double`` (one mark on each side)."""
    if mode == "eos":
        return F.concat(tokens, F.array(F.lit(EOS)))
    if mode == "double":
        return F.concat(F.array(F.lit(EDGE)), tokens, F.array(F.lit(EDGE)))
    return tokens


def corpus_vocab_encode(
    df: DataFrame,
    tokens: str,
    count_splits: list[str],
    eos: str = "eos",
    lower: bool = False,
    row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame]:
    """A vocabulary over some splits and all splits encoded with it: ``(vocab, split, row_id, ids)``."""
    words = F.transform(tokens, F.lower) if lower else F.col(tokens)
    # Read for the counts, for frequent words and for the codes: cut into tokens once.
    marked = written(df.select("split", row_id, add_eos(words, eos).alias("__tok")), "marked")
    specials = (EOS, "<unk>") if eos != "double" else (EDGE, "<unk>")
    counted = marked.filter(F.col("split").isin(count_splits))
    vocab = vocab_by_frequency(counted, "__tok", 1, specials, lower=False)
    # Words of the counted splits are known by their counts, and the marks are in every row; only other splits are sketched.
    most = F.when(F.col("index") < len(specials), F.lit(2**62)).otherwise(F.col("count"))
    known = vocab.filter(F.col("index") < FREQUENT).select(F.col("token").alias("item"), most.alias("count"))
    others = frequent_values(marked.filter(~F.col("split").isin(count_splits) | F.col("split").isNull()), F.col("__tok"))
    both = known.unionByName(others.filter(~F.col("item").isin(*specials))).groupBy("item").agg(F.sum("count").alias("count"))
    top = both.orderBy(F.desc("count"), "item").limit(FREQUENT)
    coded = tokens_to_ids(marked, vocab, "__tok", "ids", ["split", row_id], unk_id=1, top=top, keep_tokens=False)
    return vocab, coded.select("split", row_id, "ids")


def sampling_weights(
    vocab: DataFrame, n_sample: int, range_max: Column, index: str = "index", exact: bool = False
) -> DataFrame:
    """Add ``p`` and ``log_q`` of every class rank under log-uniform sampling.

    ``exact`` takes the chance to be drawn from ``(1-p)^tries``; the default from ``(1+p)^-tries``.
    """
    c = F.col(index).cast("double")
    p = (F.log(c + 2) - F.log(c + 1)) / F.log(range_max.cast("double") + 1)
    tries = F.lit(2.0 * n_sample)
    missed = tries * F.log1p(-p) if exact else -tries * F.log1p(p)
    return vocab.withColumn("p", p).withColumn("log_q", F.log(-F.expm1(missed)))


def negative_samples(tries: DataFrame, range_max: Column, key: str = "id", seed: int = 0) -> DataFrame:
    """Distinct classes drawn by log-uniform weight, one draw per row of ``tries``."""
    top = range_max.cast("double") + 1
    drawn = F.floor(F.exp(uniform(F.col(key), seed) * F.log(top))).cast("long") - 1
    return tries.select(F.least(drawn, range_max.cast("long") - 1).alias("class")).distinct()


def next_token_target(df: DataFrame, tokens: str, bsz: int, row_id: str = "row_id", block: int = 512) -> DataFrame:
    """``lane, step, token, target``: each step of a lane with the token after it.

    Read off the packed chunks, so a lane is never sorted as a whole.
    """
    packed = pack_contiguous(df, tokens, bsz, block, row_id=row_id)
    pairs = F.arrays_zip(F.col("data").alias("token"), F.col("target").alias("target"))
    flat = exploded(packed, ["lane", "chunk"], pairs, "e", "i")
    return flat.select("lane", (F.col("chunk") * block + F.col("i")).alias("step"), "e.token", "e.target")
