"""Mixing sources to target weights by pivotal dependent rounding.

Native: DataFrame functions only. Every document of a source gets the same expected number of
copies, target / size of its source. Its integral part is taken outright; the fractional parts are
rounded by the pivotal method with sizes as weights: two fractional documents of one source meet,
probability mass times size moves from one to the other until one is 0 or 1, the direction drawn so
that every expectation stays as it was. What is left fractional of a block of documents goes to the
next level of a reduction tree, where blocks of such residuals meet, until one is left per source.
So the words a source yields differ from its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, word_count

#: Documents that one fold of the reduction tree rounds.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value that a lambda's body uses more than once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ranked(per: DataFrame) -> DataFrame:
    """``per`` with ``rank`` from 0 by the code points of ``source``, null last.

    Range partitions are sorted by themselves; each is offset by the rows of those before it, so the only
    window without a key runs over one row per partition.
    """
    parts = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("source").isNull(), F.col("source"))
    at = F.monotonically_increasing_id()  # partition, then position in it
    own = per.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", at)
    own = staged(own.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("i")).drop("at"), "ranked")
    rows = own.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return own.join(rows, "part").withColumn("rank", F.col("before") + F.col("i")).drop("part", "i", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, n, target): water-filling of ``share`` of all words by weight.

    Targets stop at ``cap`` times a source's size and the excess is shared again by weight until none
    is above: each round is one aggregation over the sources, however many they are, and sources that
    stop never start again. The level of a round is the target of weight 1.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = staged(_ranked(per).select("source", "source_size", "n", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("limit")), "sources")
    level, stopped = 0.0, -1
    while True:
        open_ = F.col("limit") > F.lit(level) * F.col("weight")
        row = per.agg(F.sum("source_size").alias("all"), F.count_if(~open_).alias("stopped"), F.coalesce(F.sum(F.when(~open_, F.col("limit"))), F.lit(0.0)).alias("given"), F.sum(F.when(open_, F.col("weight"))).alias("open")).first()
        if row["all"] is None or row["open"] is None or row["stopped"] == stopped:  # no source, or none open, or as before
            break
        stopped, level = row["stopped"], (share * row["all"] - row["given"]) / row["open"]
    return per.select("source", "source_size", "n", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"))


def _meet(acc: Column, item: Column) -> Column:
    """One pivotal step: the carried fractional document meets the next."""
    cur = acc["cur"]
    def step(m: Column) -> Column:
        up = item["u"] * (m["give"] + m["take"]) < m["take"]  # the carried one gains, with probability take / (give + take)
        full, void = m["give"] >= cur["w"] * (1 - cur["p"]), m["take"] >= cur["w"] * cur["p"]
        cp = F.when(up, F.when(full, F.lit(1.0)).otherwise(cur["p"] + m["give"] / cur["w"])).otherwise(F.when(void, F.lit(0.0)).otherwise(cur["p"] - m["take"] / cur["w"]))
        ip = F.when(up, F.when(full, item["p"] - m["give"] / item["w"]).otherwise(F.lit(0.0))).otherwise(F.when(void, item["p"] + m["take"] / item["w"]).otherwise(F.lit(1.0)))
        snap = lambda x: F.when(x < 1e-9, F.lit(0.0)).when(x > 1 - 1e-9, F.lit(1.0)).otherwise(x)
        return F.struct(snap(cp).alias("cp"), snap(ip).alias("ip"))
    def after(s: Column) -> Column:
        whole = lambda x: (x == 0) | (x == 1)
        said = lambda d, p: F.struct(d["doc_id"].alias("doc_id"), p.cast("int").alias("up"))
        none = F.lit(None).cast("struct<doc_id:bigint,w:double,p:double>")
        out = F.filter(F.array(F.when(whole(s["cp"]), said(cur, s["cp"])), F.when(whole(s["ip"]), said(item, s["ip"]))), lambda x: x.isNotNull())
        held = lambda d, p: F.struct(d["doc_id"].alias("doc_id"), d["w"].alias("w"), p.alias("p"))
        return F.struct(F.when(~whole(s["cp"]), held(cur, s["cp"])).when(~whole(s["ip"]), held(item, s["ip"])).otherwise(none).alias("cur"), F.concat(acc["out"], out).alias("out"))
    moves = F.struct(F.least(cur["w"] * (1 - cur["p"]), item["w"] * item["p"]).alias("give"), F.least(cur["w"] * cur["p"], item["w"] * (1 - item["p"])).alias("take"))
    first = F.struct(F.struct(item["doc_id"].alias("doc_id"), item["w"].alias("w"), item["p"].alias("p")).alias("cur"), acc["out"].alias("out"))
    return F.when(cur.isNull(), first).otherwise(_let(moves, lambda m: _let(step(m), after)))


def _uniform(seed: int, level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.lit("u"), "source", "doc_id"), 11) / F.lit(float(1 << 53))


def round_fractions(units: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, up) of units (source, doc_id, w, p) with 0 < p < 1 and w > 0; up is 0 or 1."""
    start = F.lit(None).cast("struct<doc_id:bigint,w:double,p:double>")
    zero = F.struct(start.alias("cur"), F.array().cast("array<struct<doc_id:bigint,up:int>>").alias("out"))
    said, level, rest = [], 0, units
    while True:
        per = rest.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        most = per.agg(F.max("blocks")).first()[0]
        if not most:
            break
        dealt = rest.join(per, rest["source"].eqNullSafe(per["source"])).drop(per["source"])
        dealt = dealt.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id"), "blocks"))
        items = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), F.lit(level), "doc_id").alias("h"), "doc_id", "w", "p", _uniform(seed, level).alias("u"))))
        done = staged(dealt.groupBy("source", "b").agg(items.alias("items")).select("source", F.aggregate("items", zero, _meet).alias("r")).select("source", "r.*"), f"level{level}")
        said.append(done.select("source", F.explode("out").alias("o")).select("source", "o.*"))
        rest, level = done.where("cur is not null").select("source", "cur.*"), level + 1
        if most == 1:
            last = (_uniform(seed, level) < F.col("p")).cast("int")
            said.append(rest.select("source", "doc_id", last.alias("up")))
            break
    out = said[0] if said else units.select("source", "doc_id", F.lit(0).alias("up"))
    for x in said[1:]:
        out = out.unionByName(x)
    return out


def _plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sizes of all rows, and the plan."""
    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = staged(source_targets(rows, weights, share, cap), "targets")
    units = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    joined = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate + 1e-12).cast("int")
    frac = F.greatest(F.lit(0.0), rate - base)
    joined = staged(joined.withColumn("base", base).withColumn("p", F.when(frac < 1e-12, F.lit(0.0)).otherwise(frac)), "units")
    ups = round_fractions(joined.where("p > 0 and size > 0").select("source", "doc_id", F.col("size").cast("double").alias("w"), "p"), seed)
    ups = ups.select(F.col("source").alias("_us"), F.col("doc_id").alias("_ud"), "up")
    same = F.col("source").eqNullSafe(F.col("_us")) & F.col("doc_id").eqNullSafe(F.col("_ud"))
    out = joined.join(ups, same, "left").select("source", "doc_id", "size", "source_size", "target", (F.col("base") + F.coalesce("up", F.lit(0))).alias("copies"))
    return rows, out


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per (source, doc_id): doc_id, source, size, source_size, target, copies.

    Options: weights, share, cap, seed, id_col, text_col, source_col. ``cap`` bounds targets and, as
    copies never exceed its ceiling, documents. Null text has size 0, null source is a source of its
    own, rows with one id and source (repeated rows, null ids) are one unit that is taken or left
    together; documents of size 0 get the integral part of their copies; an empty table gives an
    empty plan. Draws are hashes of seed and id, so reruns agree.
    """
    return _plan(docs, **options)[1]


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies * size)."""
    rows, plan = _plan(docs, **options)
    plan = plan.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "source_size", "target", "copies")
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, copy_col: str = "copy", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the plan takes it, with ``copy_col`` from 1.

    All columns come back as they were; a ``copy_col`` that ``docs`` has already is an error.
    """
    if copy_col in docs.columns:
        raise ValueError(f"the documents have a column {copy_col!r} already: name another copy_col")
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    plan = mix_plan(docs, **options).where("copies > 0").select("source", "doc_id", "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").alias("own_source"), F.col(f"`{id_col}`").cast("long").alias("own_id"))
    found = rows.join(plan, F.col("own_source").eqNullSafe(F.col("source")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    found = found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("copy").alias(copy_col))
