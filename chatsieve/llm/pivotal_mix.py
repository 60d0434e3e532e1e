"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of words; a document is then copied ``target /
source size`` times: the whole part always, the fraction by dependent
rounding.  Two documents with fractions meet; words move from one to the
other, with the probabilities that leave both expectations alone, until one
fraction is 0 or 1.  The words a source takes never change in a meeting, so
at the end they differ from the target by less than the last document.

The meetings form a reduction tree: blocks of about 64 documents (by hash,
within a source) are folded in one expression each and leave at most one
fraction, the residuals are blocked again, and so on: log64 of the largest
source levels, each a narrow aggregation written to the shared folder.  A
source that holds a third of all rows only has more blocks.

Defined results: null text has size 0, such documents take 0 words; a null
source is a source of its own, ranked last; rows equal in source, id and size
share their copies as evenly as whole numbers allow; an empty table gives an
empty result; other columns are ignored.  Chance comes from hashes of the
ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import words, write_and_read
from chatsieve.operators.ranking import exact_row_number

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 64
SMALL_SOURCES = 20_000  # rows of the source table that may be broadcast


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size, m).

    Sources in code point order, null last, take the weights in turn.  Targets
    share ``share`` times all words by weight, stop at ``limit`` times the
    source, and the excess is shared again until none is above.
    """
    src = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                      F.count(F.lit(1)).alias("n"))
    src = exact_row_number(src.withColumn("last", F.col("source").isNull()), [], ["last", "source"], out="rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])[((F.col("rank") - 1) % len(weights)).cast("int")]
    src = write_and_read(src.select("source", "source_size", "n", turn.alias("weight")), "mix-sources")
    cap = limit * F.col("source_size")
    whole = float(src.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, None
    while True:  # each round at least one more source is full, or it is the last
        above = F.lit(level) * F.col("weight") > cap
        row = src.agg(F.sum(F.when(above, cap)).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("free"),
                      F.count(F.when(above, 1)).alias("full")).first()
        if row["full"] == full or not row["free"]:
            break
        full = row["full"]
        level = (whole - float(row["used"] or 0.0)) / float(row["free"])
    return src.select("source", "source_size", "n", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 12).cast("double") / float(1 << 52)


def _meet(level: int, seed: int):
    """Folds one more unit into (cur, out): cur holds the only open fraction."""
    def merge(acc: Column, x: Column) -> Column:
        c = acc["cur"]
        cw, xw = c["w"], x["w"]
        to_c = F.least(cw * (1 - c["f"]), xw * x["f"])  # words that may move from x to c
        to_x = F.least(xw * (1 - x["f"]), cw * c["f"])
        chance = _unit(F.xxhash64(c["u"], x["u"], F.lit(level), F.lit(seed)))
        move_c = chance * (to_c + to_x) < to_x
        c_full = cw * (1 - c["f"]) <= xw * x["f"]
        x_full = xw * (1 - x["f"]) <= cw * c["f"]

        def unit(k: Column, f: Column) -> Column:
            return F.struct(k["u"].alias("u"), k["gid"].alias("gid"), k["w"].alias("w"),
                            F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)).alias("f"))

        def done(k: Column, up: int) -> Column:
            return F.array(F.struct(k["gid"].alias("gid"), F.lit(up).alias("up")))

        rest = (F.when(c.isNull(), unit(x, x["f"]))
                .when(move_c, F.when(c_full, unit(x, x["f"] - to_c / xw)).otherwise(unit(c, c["f"] + to_c / cw)))
                .otherwise(F.when(x_full, unit(c, c["f"] - to_x / cw)).otherwise(unit(x, x["f"] + to_x / xw))))
        settled = (F.when(c.isNull(), F.array().cast("array<struct<gid:bigint,up:int>>"))
                   .when(move_c, F.when(c_full, done(c, 1)).otherwise(done(x, 0)))
                   .otherwise(F.when(x_full, done(x, 1)).otherwise(done(c, 0))))
        return F.struct(rest.alias("cur"), F.concat(acc["out"], settled).alias("out"))

    return merge


def round_fractions(units: DataFrame, seed: int = 0) -> DataFrame:
    """(gid, up) for units (source, blocks, u, gid, w, f): every fraction to 0 or 1.

    ``blocks``: how many blocks the source has on the first level.
    """
    cur = "struct<u:bigint,gid:bigint,w:double,f:double>"
    start = F.struct(F.lit(None).cast(cur).alias("cur"),
                     F.array().cast("array<struct<gid:bigint,up:int>>").alias("out"))
    most = units.agg(F.max("blocks")).first()[0]
    settled, level = [], 0
    while most is not None:
        block = F.pmod(F.xxhash64("u", F.lit(level), F.lit(seed)), F.col("blocks"))
        folded = (units.withColumn("block", block).groupBy("source", "blocks", "block")
                  .agg(F.array_sort(F.collect_list(F.struct("u", "gid", "w", "f"))).alias("xs"))
                  .withColumn("r", F.aggregate("xs", start, _meet(level, seed)))
                  .select("source", "blocks", "r.cur", "r.out"))
        folded = write_and_read(folded, f"mix-level{level}")
        settled.append(folded.select(F.explode("out").alias("d")).select("d.gid", "d.up"))
        if most <= 1:
            chance = _unit(F.xxhash64("cur.u", F.lit(seed), F.lit("last")))
            settled.append(folded.select("cur.gid", (chance < F.col("cur.f")).cast("int").alias("up")))
            break
        units = folded.select("source", F.ceil(F.col("blocks") / BLOCK).cast("long").alias("blocks"), "cur.*")
        most, level = -(-most // BLOCK), level + 1
    if not settled:
        return units.select("gid", F.lit(0).alias("up")).limit(0)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.size(words(text)).cast("long").alias("size"))
    sized = (rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
             .withColumn("gid", F.monotonically_increasing_id()))
    sized = write_and_read(sized, "mix-sizes")
    src = write_and_read(source_targets(sized, weights, share, limit), "mix-targets")
    few = src.count() <= SMALL_SOURCES
    by_source = src.withColumnRenamed("source", "s")
    if few:
        by_source = F.broadcast(by_source)
    mass = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (sized.join(by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
               .withColumn("mass", F.when(F.abs(mass - F.round(mass)) < 1e-9, F.round(mass)).otherwise(mass))
               .withColumn("whole", F.floor("mass")))
    units = planned.where((F.col("mass") > F.col("whole")) & (F.col("size") > 0)).select(
        "source", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"),
        F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("u"), "gid",
        F.col("size").cast("double").alias("w"), (F.col("mass") - F.col("whole")).alias("f"))
    ups = round_fractions(units, seed)
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    out = planned.join(ups, "gid", "left").withColumn("all", copies)
    out = out.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    out = out.withColumn("copies", F.floor(F.col("all") / F.col("m"))
                         + F.when(F.col("j") < F.col("all") % F.col("m"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns.

    Rows that share an id, source and size get the copies of their group.
    """
    m = mix(docs, id_col, text_col, source_col, **kw)
    m = m.groupBy("doc_id", "source", "size").agg(
        F.min("copies").alias("__low"), F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__m"))
    m = m.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
                 "__low", "__sum", "__m")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumn("__words", F.size(words(text)).cast("long"))
    on = (F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col(f"`{source_col}`").eqNullSafe(F.col("__source"))
          & (F.col("__words") == F.col("__size")))
    joined = keyed.join(m, on)
    from pyspark.sql import Window
    # The few rows of one group are told apart only where the group is larger than one.
    single = joined.where("__m = 1").withColumn("__copies", F.col("__sum"))
    nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.lit(1)))
    shared = joined.where("__m > 1").withColumn(
        "__copies", F.col("__low") + F.when(nth <= F.col("__sum") - F.col("__low") * F.col("__m"), 1).otherwise(0))
    out = single.unionByName(shared)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
