"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, materialise, table

#: Documents that meet in a leaf of the reduction tree, about, and the bits by which a level merges groups.
LEAF, FAN_BITS = 128, 7
#: Size bands for each doubling of the size: documents are paired with others of about their size.
BANDS = 8


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target, _docs for rows of (source, size).

    The sources, in order of code points with null last, take the weights in
    turn. Targets share `share` times all sizes by weight, but stop at `cap`
    times their source's size; what is above is shared again. The common factor
    of those below the cap is found from running sums over sources in the order
    in which they reach it. Only one row for each source meets in one task.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("_most", F.col("source_size") * F.lit(float(cap))).withColumn("_at", F.col("_most") / F.col("_w"))
    order = Window.orderBy("_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    filled = F.coalesce(F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_factor", (total - filled) / rest)
    # the first source that stays below its cap gives the factor of all after it
    factor = F.min_by(F.when(F.col("_factor") <= F.col("_at"), F.col("_factor")), F.when(F.col("_factor") <= F.col("_at"), F.col("_at"))).over(everything)
    return w.select("source", "source_size", F.coalesce(F.least(F.col("_most"), factor * F.col("_w")), F.col("_most")).alias("target"), "_docs")


# A pair (a, b) of documents with copy probabilities a.p and b.p: moving words
# from b to a goes as far as `up`, from a to b as far as `down`; the direction is
# drawn so that both probabilities keep their expectation. The number of words
# that the two are expected to give stays the same whatever is drawn.
_PAIR = """
transform(array(named_struct('up', least((1 - a.p) * a.size, b.p * b.size), 'down', least(a.p * a.size, (1 - b.p) * b.size))),
  t -> if(shiftrightunsigned(xxhash64(a.h, b.h, {seed}), 11) / 9007199254740992D * (t.up + t.down) < t.down,
    named_struct('a', if(t.up >= (1 - a.p) * a.size, 1D, a.p + t.up / a.size), 'b', if(t.up >= b.p * b.size, 0D, b.p - t.up / b.size)),
    named_struct('a', if(t.down >= a.p * a.size, 0D, a.p - t.down / a.size), 'b', if(t.down >= (1 - b.p) * b.size, 1D, b.p + t.down / b.size))))[0]
"""

_ITEM = "struct<h:bigint,doc_id:bigint,size:bigint,p:double>"
_START = f"named_struct('left', cast(null as {_ITEM}), 'done', cast(array() as array<{_ITEM}>))"
_WITH = "named_struct('h', {0}.h, 'doc_id', {0}.doc_id, 'size', {0}.size, 'p', {1})"

#: Folds a sorted array of items into {left: the one item that isn't integral yet, or null; done: the others}.
_FOLD = """
aggregate(_items, {start}, (s, b) -> if(s.left is null, named_struct('left', b, 'done', s.done),
  transform(array(s.left), a -> transform(array({pair}), q -> named_struct(
    'left', case when q.a > 0 and q.a < 1 then {a} when q.b > 0 and q.b < 1 then {b} end,
    'done', concat(s.done, filter(array({a}, {b}), x -> x.p <= 0 or x.p >= 1))))[0])[0]))
"""

#: Rounds what is left of each band, from the largest size down. What a rounding adds or takes is carried to the next, which is
#: drawn with its own probability and the carried words over its size: so each keeps its expectation, but for those where that
#: is below 0 or above 1, and for the smallest, which goes to the nearer side.
_LAST = """
aggregate(_items, named_struct('carry', 0D, 'i', 1, 'done', cast(array() as array<{item}>)), (s, b) ->
  if(b.p * b.size + s.carry >= b.size * if(s.i = size(_items), 0.5D, shiftrightunsigned(xxhash64(b.h, {seed}), 11) / 9007199254740992D),
    named_struct('carry', s.carry + (b.p - 1) * b.size, 'i', s.i + 1, 'done', concat(s.done, array({one}))),
    named_struct('carry', s.carry + b.p * b.size, 'i', s.i + 1, 'done', concat(s.done, array({zero})))))
"""


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and h, a hash of id and text.

    A document is taken whole, copies x size words. Its copies are target /
    source_size, rounded: the whole part is sure, the fraction is a probability.
    Pairs of documents of a source, of about the same size, shift probability
    (as words) at random until one is integral. That is folded in leaves of some
    LEAF documents, whose remainders meet again in a tree, FAN_BITS hash bits a
    level, until each source has one remainder a size band; those are drawn
    from the largest down with the error carried on, so that a source's words
    end within about a small document of its target. Rows that agree in id and
    text would meet in every leaf; they are one item, since pairing them with
    each other leaves one with a fraction at most. So no key gathers its rows:
    leaves and nodes are bounded, whatever a source's or a row's share.

    Draws come from hashes of the documents and the seed: reruns agree. A null
    text has size 0, and sizes of 0 take 0. A null source comes last in order;
    null ids are allowed; of rows that repeat, some are taken once more than the
    others. No rows give no rows; other columns are not read.
    """
    rows = docs.select(docs[source_col].cast("string").alias("source"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    sized = materialise(rows.select("source", "doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"), named.alias("_s")), "sizes")
    targets = source_targets(sized, weights, share, cap).select(named.alias("_s"), "source_size", "target", "_docs")
    told = attach(sized, targets, "_s", "_docs", sized.count(), ["h"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    told = told.withColumn("_x", F.round(copies, 12)).withColumn("_base", F.floor("_x")).withColumn("p", F.col("_x") - F.col("_base"))
    told = materialise(told.select("doc_id", "size", "source_size", "target", "h", "_s", "_base", "p", F.floor(F.log2(F.greatest("size", F.lit(1))) * BANDS).cast("int").alias("_band")), "copies")
    out = ["doc_id", "size", "source_size", "target", "taken", "h"]
    sure = (F.col("size") == 0) | (F.col("p") == 0)
    done = told.where(sure).select("doc_id", "size", "source_size", "target", (F.col("_base") * F.col("size")).alias("taken"), "h")

    fixed = ["_s", "source_size", "target", "_base"]
    # rows that repeat: of n with the probability p, whole ones are taken or left, and one has what remains of n x p
    same = told.where(~sure).groupBy(*fixed, "_band", "h", "doc_id", "size", "p").agg(F.count(F.lit(1)).alias("_n"))
    same = same.withColumn("_up", F.when(F.col("_n") > 1, F.floor(F.round(F.col("_n") * F.col("p"), 9))).otherwise(0))
    same = materialise(same.withColumn("_p", F.when(F.col("_n") > 1, F.round(F.col("_n") * F.col("p"), 9) - F.col("_up")).otherwise(F.col("p"))), "open-copies")
    whole = same.where("_n > 1").withColumn("_i", F.explode(F.sequence(F.lit(1), (F.col("_n") - (F.col("_p") > 0).cast("long")).cast("int"))))
    done = done.unionByName(whole.select("doc_id", "size", "source_size", "target", ((F.col("_base") + (F.col("_i") <= F.col("_up")).cast("long")) * F.col("size")).alias("taken"), "h"))
    open_ = same.where("_p > 0").select(*fixed, "_band", "h", "doc_id", "size", F.col("_p").alias("p"))
    most = open_.groupBy("_s", "_band").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (max(1, most // LEAF)).bit_length())
    fold = _FOLD.format(start=_START, pair=_PAIR.format(seed=seed), a=_WITH.format("a", "q.a"), b=_WITH.format("b", "q.b"))

    def emit(folded: DataFrame) -> DataFrame:
        d = folded.select(*fixed, F.explode("_f.done").alias("d"))
        return d.select("d.doc_id", "d.size", "source_size", "target", ((F.col("_base") + F.col("d.p").cast("long")) * F.col("d.size")).alias("taken"), "d.h").select(*out)

    items = open_.select(*fixed, "_band", F.struct("h", "doc_id", "size", "p").alias("_item"))
    while True:
        branch = F.shiftrightunsigned("_item.h", 64 - bits) if bits else F.lit(0)
        grouped = items.groupBy(*fixed, "_band", branch.alias("_branch")).agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        folded = materialise(grouped.select(*fixed, "_band", F.expr(fold).alias("_f")), "rounded")
        done = done.unionByName(emit(folded))
        items = folded.where("_f.left is not null").select(*fixed, "_band", F.col("_f.left").alias("_item"))
        if not bits:
            break
        bits = max(0, bits - FAN_BITS)
    by_size = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("_item.size").alias("s"), "_item"))))
    last = items.groupBy(*fixed).agg(by_size.alias("_items")).withColumn("_items", F.transform("_items", lambda x: x["_item"]))
    end = _LAST.format(item=_ITEM, seed=seed, one=_WITH.format("b", "1D"), zero=_WITH.format("b", "0D"))
    return done.unionByName(emit(last.select(*fixed, F.expr(end).alias("_f"))))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it (0, 1, ...); rows without words are not in it.

    Rows that agree in id and text share their copies, which repeat one of them.
    """
    taken = mix(docs, id_col, text_col, source_col, **how).where("taken > 0").groupBy("doc_id", "h").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_times")).select(F.col("doc_id").alias("_mix_id"), F.col("h").alias("_mix_hash"), F.col("_times").alias("_mix_times"))
    h = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    keyed = docs.withColumn("_mix_h", h)
    met = keyed.join(taken, (keyed["_mix_h"] == taken["_mix_hash"]) & keyed[id_col].cast("long").eqNullSafe(taken["_mix_id"])).dropDuplicates(["_mix_h", id_col])
    return met.withColumn("_mix_i", F.explode(F.sequence(F.lit(1), "_mix_times"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
