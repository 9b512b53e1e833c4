"""Product listings that describe the same item, by probabilistic record linkage.

Attributes are parsed into canonical units; listings with equal attributes are
one signature. Signatures are compared field by field within blocks; the
weights of each field's outcomes are fitted by expectation-maximisation over
the counts of all comparison patterns; links above a threshold are clustered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.edits import osa
from millrace.llm.listing import Attributes, Parsed, Parser, letters_apart
from millrace.operators.components import components
from millrace.session import spread, written

FIELDS = Attributes._fields
#: Outcomes of a comparison by field; 'n' (a side is unknown) says nothing.
OUTCOMES = {"code": "=xn", "model": "=~xn", "kind": "=xn", "colour": "=xn", "measure": "=xn", "maker": "=~xn"}


@lru_cache(maxsize=1)
def _parser(kinds: tuple[tuple[int, str], ...]) -> Parser:
    """The parser of a list of kinds, made once in a worker."""
    return Parser(list(kinds))


def parsed(records: DataFrame, key: str, title: str, vendor: str, body: str, skus: str, kinds: list[tuple[int, str]]) -> DataFrame:
    """(key, the columns of ``Parsed``), one row per key; unknown attributes are null.

    ``kinds`` is the reference list of kinds of goods, of fixed size. Of rows
    with one key the one that tells most counts. Rows without a key are left out.
    """
    type_ = dict(records.dtypes)[key]
    given = spread(records.where(F.col(key).isNotNull()).select(key, title, vendor, body, skus), key)
    types = {"kind": (pa.int64(), "long"), **dict.fromkeys(("names", "words", "joined"), (pa.list_(pa.string()), "array<string>"))}
    arrow = [types.get(f, (pa.string(), "string")) for f in Parsed._fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(tuple(kinds))
        for batch in batches:
            found = [parser.parse(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            columns = list(zip(*found)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (t, _) in zip(columns, arrow))], names=[key, *Parsed._fields])

    rows = given.mapInArrow(run, ", ".join((f"`{key}` {type_}", *(f"{f} {t}" for f, (_, t) in zip(Parsed._fields, arrow)))))
    known = sum((F.col(f).isNotNull().cast("int") for f in ("code", "kind", "colour", "measure", "maker")), F.lit(0))
    return rows.groupBy(key).agg(F.max_by(F.struct(*Parsed._fields), F.struct(known.alias("known"), *Parsed._fields)).alias("_a")).select(key, "_a.*")


def numbered(listings: DataFrame) -> DataFrame:
    """``listings`` without the article numbers that are a shop's own.

    Letters before a number that stand with three makers or more, and begin
    under half of their names, name the shop and not the maker.
    """
    led = listings.where((F.col("prefix") != "") & F.col("code").isNotNull() & (F.col("begins") != ""))
    begun = F.startswith("begins", "prefix") | F.startswith("begins", F.right("prefix", F.lit(2)))
    shops = led.groupBy("prefix", "begins").agg(F.max(begun.cast("int")).alias("_own")).groupBy("prefix").agg(F.count("*").alias("_n"), F.avg("_own").alias("_share"))
    shops = shops.where((F.col("_n") >= 3) & (F.col("_share") < 0.5)).select("prefix", F.lit(True).alias("_shop"))
    return listings.join(shops, "prefix", "left").withColumn("code", F.when(F.col("_shop").isNull(), F.col("code"))).drop("_shop", "prefix", "begins")


def _osa(values: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([osa(a, b) for a, b in zip(values, others)], dtype="int32")


def modelled(listings: DataFrame, key: str, top: float = 0.25, broad: float = 0.2, enough: int = 10) -> DataFrame:
    """``listings`` with ``model`` in place of ``words`` and ``joined``: the word that tells a maker's articles apart, learned from all listings.

    A word may be a model if one maker has more of its listings than that
    maker's share of all, by ``top`` of the rest, as trade words and materials
    are spread over many, and if it is no word of a maker's name anywhere. Of a listing's such words that other listings have as
    well, two neighbours in the title written as one among them, the one most
    its maker's own counts, then the most frequent, then the first; but a word that over ``broad`` of a maker's
    listings have, of ``enough`` or more, is a series and comes last. A model
    within one edit of another that twice as many listings have, and of no
    second such, is that one misspelt. A listing with none takes the model that a word of its own is uniquely nearest to
    within one edit, a swap being one, else its first word that only it has.
    """
    listed = F.concat("words", F.array_except("joined", "words"))
    words = listings.select(key, F.col("house").alias("maker"), F.size("words").alias("_plain"), F.posexplode(listed).alias("at", "word"))
    plain_ = words.where(F.col("at") < F.col("_plain"))
    by_maker = plain_.groupBy("word", "maker").agg(F.count("*").alias("_c"))
    sizes = listings.where(F.col("house").isNotNull()).groupBy(F.col("house").alias("maker")).agg(F.count("*").alias("_of"))
    counted = by_maker.join(sizes, "maker", "left").groupBy("word").agg(
        F.sum("_c").alias("_n"), F.sum(F.when(F.col("maker").isNotNull(), F.col("_c"))).alias("_known"),
        F.max(F.when(F.col("maker").isNotNull(), F.struct(F.col("_c"), F.col("_of")))).alias("_top"),
    )
    makers = listings.select(F.explode("names").alias("word")).distinct()
    total = sizes.agg(F.sum("_of").alias("_all"))
    base = F.col("_top._of") / F.col("_all")
    one = F.col("_top").isNull() | (F.col("_top._c") / F.col("_known") >= base + top * (1.0 - base))
    series = F.coalesce((F.col("_top._of") >= enough) & (F.col("_top._c") > broad * F.col("_top._of")), F.lit(False))
    names = counted.join(F.broadcast(total)).where(one).join(makers, "word", "left_anti").select("word", "_n", series.alias("_series"), F.round(F.coalesce(F.col("_top._c") / F.col("_known"), F.lit(1.0)), 1).alias("_share"))
    mine = words.join(names, "word").groupBy(key).agg(
        F.min(F.when(F.col("_n") > 1, F.struct("_series", -F.col("_share"), -F.col("_n"), "at", "word"))).alias("_shared"), F.min(F.when((F.col("_n") == 1) & (F.col("at") < F.col("_plain")), F.struct("at", "word"))).alias("_lone"), F.collect_set(F.when((F.col("_n") == 1) & (F.col("at") < F.col("_plain")), F.col("word"))).alias("_own")
    )
    named = written(listings.join(mine, key, "left").select(key, *(f for f in FIELDS if f != "model"), "_own", "joined", F.col("_shared.word").alias("_m"), F.col("_lone.word").alias("_lone")), "named")

    def forms(word: str) -> Column:
        c = F.col(word)
        shorter = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.explode(F.array_union(F.array(c), shorter)).alias("_form")

    models = written(named.where(F.length("_m") >= SHORTEST).groupBy("_m").agg(F.count("*").alias("_of")), "models")
    longest = models.agg((F.max(F.length("_m")) + 1).alias("_longest"))
    own = named.where(F.col("_m").isNull()).select(key, F.explode(F.array_union(F.coalesce("_own", "joined"), "joined")).alias("_s"), F.lit(0).alias("_held"))
    rare = models.select(F.col("_m").alias("_s"), F.col("_of").alias("_held"))
    asked = own.select("_s").union(rare.select("_s")).distinct().join(F.broadcast(longest)).where((F.length("_s") >= SHORTEST - 1) & (F.length("_s") <= F.col("_longest")))  # one row
    met = asked.select("_s", forms("_s")).join(models.select("_m", "_of", forms("_m")), "_form").select("_s", "_m", "_of").distinct()
    near = written(met.withColumn("_d", F.pandas_udf(_osa, "int")("_s", "_m")).where(F.col("_d") <= 1), "near")

    def nearest(spelled: DataFrame, by: str) -> DataFrame:
        at = spelled.join(near, "_s").where(F.col("_of") >= 2 * F.col("_held")).where((F.col("_held") == 0) | (F.col("_d") > 0)).groupBy(by, "_d").agg(F.min("_m").alias("_m"), (F.min("_m") == F.max("_m")).alias("_one"))
        return at.groupBy(by).agg(F.min_by(F.struct("_m", "_one"), "_d").alias("_b")).where("_b._one").select(by, F.col("_b._m").alias("_r"))

    mended = nearest(rare, "_s").withColumnsRenamed({"_s": "_m", "_r": "_mended"})
    out = named.join(nearest(own, key), key, "left").join(mended, "_m", "left")
    return out.withColumn("model", F.coalesce("_mended", "_m", "_r", "_lone")).select(key, *FIELDS)


SHORTEST = 5  # letters of a model that may be misspelt
CHUNK = 200  # signatures of a block that one task compares with as many


def _blocks(signatures: DataFrame) -> DataFrame:
    """(block, part, side, signature id and fields): equal article number; equal model with equal colour or measure; all but a letter of the model; equal maker, kind, colour and measure.

    A block of more than CHUNK signatures is cut by their hash, and each two
    pieces of it are a part of their own, with ``side`` 0, 1 or, where both are
    one piece, 2. So all pairs of a block are compared whatever its size, and
    no task holds more than two pieces.
    """
    def key(name: str, *parts: Column) -> Column:
        whole = F.concat_ws("\x1f", F.lit(name), *(p.cast("string") for p in parts))
        known = F.lit(True)
        for p in parts:
            known = known & p.isNotNull()
        return F.when(known, F.xxhash64(whole))

    c = {f: F.col(f) for f in FIELDS}
    spelled = F.transform(F.sequence(F.lit(1), F.length("model")), lambda i: F.concat(F.substring("model", 1, i - 1), F.substring("model", i + 1, F.length("model"))))
    near = F.when(
        c["model"].isNotNull() & c["colour"].isNotNull() & c["measure"].isNotNull() & c["kind"].isNotNull(),
        F.transform(F.array_distinct(spelled), lambda s: F.xxhash64(F.concat_ws("\x1f", F.lit("near"), s, "colour", "measure", F.col("kind").cast("string")))),
    )
    exact = F.array(key("code", c["code"]), key("colour", c["model"], c["colour"]), key("measure", c["model"], c["measure"]), key("bare", c["maker"], c["kind"], c["colour"], c["measure"]))
    keyed = signatures.withColumn("block", F.explode(F.array_distinct(F.array_compact(F.concat(exact, F.coalesce(near, F.array().cast("array<bigint>")))))))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    keyed = keyed.join(sizes, "block").withColumn("_pieces", F.ceil(F.col("_n") / CHUNK).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("_pieces")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_pieces") - 1), lambda o: F.struct(
        F.least("_mine", o).alias("i"), F.greatest("_mine", o).alias("j"), F.when(o == F.col("_mine"), 2).when(F.col("_mine") < o, 0).otherwise(1).alias("side"),
    ))
    return keyed.withColumn("_o", F.explode(others)).select("block", F.struct("_o.i", "_o.j").alias("_part"), F.col("_o.side").alias("_side"), "sig", *FIELDS)


def _compare(values: pd.DataFrame, others: pd.DataFrame) -> pd.Series:
    out = []
    for a, b in zip(values.itertuples(index=False), others.itertuples(index=False)):
        said = []
        for f, x, y in zip(FIELDS, a, b):
            if x is None or y is None or x != x or y != y:
                said.append("n")
            elif x == y:
                said.append("=")
            elif f == "model" and osa(x, y) == 1 or f == "maker" and letters_apart(x, y) <= 4:
                said.append("~")
            else:
                said.append("x")
        out.append("".join(said))
    return pd.Series(out, dtype=object)


def fit(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Probability that a pair of each pattern is a match, by expectation-maximisation.

    ``counts`` has the number of pairs of every pattern: at most the product of
    the outcomes, however many pairs there are. Fields are independent given
    whether a pair matches; unknown outcomes have no weight.
    """
    total = sum(counts.values())
    if not total:
        return {}
    share = 0.3
    m = {f: {o: w for o, w in zip("=~x", (0.9, 0.07, 0.03))} for f in FIELDS}
    u = {f: {o: w for o, w in zip("=~x", (0.3, 0.05, 0.65))} for f in FIELDS}
    match: dict[str, float] = {}
    for _ in range(rounds):
        for pattern in counts:
            weight = log(share / (1 - share))
            for f, o in zip(FIELDS, pattern):
                if o != "n":
                    weight += log(m[f][o] / u[f][o])
            match[pattern] = 1 / (1 + 2.718281828459045 ** -max(-60.0, min(60.0, weight)))
        share = min(0.99, max(0.01, sum(match[p] * n for p, n in counts.items()) / total))
        for i, f in enumerate(FIELDS):
            for table, side in ((m, lambda p: match[p]), (u, lambda p: 1 - match[p])):
                seen = {o: 0.5 for o in "=~x"}
                for p, n in counts.items():
                    if p[i] != "n":
                        seen[p[i]] += side(p) * n
                whole = sum(seen.values())
                table[f] = {o: max(1e-4, v / whole) for o, v in seen.items()}
    return match


def links(signatures: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, named) of linked signature ids: ``signatures`` has ``sig`` and the fields, ``named`` says whether a number or model was compared. A pair is linked if its pattern's fitted probability is ``threshold`` or more, and by nothing else."""
    blocks = written(_blocks(signatures), "blocks")
    left = blocks.where(F.col("_side") != 1).select("block", "_part", "_side", F.col("sig").alias("a"), F.struct(*FIELDS).alias("_l"))
    right = blocks.where(F.col("_side") != 0).select("block", "_part", F.col("sig").alias("b"), F.struct(*FIELDS).alias("_r"))
    met = left.join(right, ["block", "_part"]).where((F.col("_side") != 2) | (F.col("a") < F.col("b")))
    in_order = F.col("a") < F.col("b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(in_order, F.col("_l")).otherwise(F.col("_r")).alias("_l"), F.when(in_order, F.col("_r")).otherwise(F.col("_l")).alias("_r"))
    pairs = met.groupBy("a", "b").agg(F.first("_l").alias("_l"), F.first("_r").alias("_r"))
    compare = F.pandas_udf(_compare, "string")
    patterns = written(pairs.select("a", "b", compare("_l", "_r").alias("pattern")), "patterns")
    counts = {r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()}
    good = [p for p, chance in fit(counts).items() if chance >= threshold]
    named = F.substring("pattern", 1, 2) != "nn"
    return patterns.where(F.col("pattern").isin(good)).select("a", "b", named.alias("named"))


def same_items(attributes: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, item): listings that describe one item share ``item``; one without a partner is an item of its own.

    Equal signatures are one before anything is compared, but for those that
    know neither an article number nor a model: these are told apart by key.
    Ties can't arise: items are named by their smallest signature.
    """
    bare = F.when(F.col("code").isNull() & F.col("model").isNull(), F.col(key).cast("string"))
    signed = written(attributes.withColumn("sig", F.xxhash64(*(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in FIELDS), F.coalesce(bare, F.lit("")))), "signed")
    signatures = written(signed.groupBy("sig").agg(*(F.first(f).alias(f) for f in FIELDS)), "signatures")
    found = written(links(signatures, threshold), "links")
    items = signatures.select("sig").join(components(found.where("named"), "a", "b").withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("component", "sig").alias("item"))
    # what names nothing joins the one item it is linked to, and none if there are several
    ends = F.explode(F.array(F.struct(F.col("a").alias("sig"), F.col("b").alias("of")), F.struct(F.col("b").alias("sig"), F.col("a").alias("of"))))
    bare = signatures.where(F.col("code").isNull() & F.col("model").isNull()).select("sig")
    loose = found.where(~F.col("named")).select(ends.alias("e")).select("e.sig", "e.of").join(bare, "sig").join(bare.withColumnRenamed("sig", "of"), "of", "left_anti")
    joined = loose.join(items.withColumnRenamed("sig", "of"), "of").groupBy("sig").agg(F.min("item").alias("_i"), F.max("item").alias("_j")).where(F.col("_i") == F.col("_j")).select("sig", "_i")
    out = signed.join(items, "sig").join(joined, "sig", "left").select(key, "sig", *FIELDS, F.coalesce("_i", "item").alias("item"))
    return written(out, "items")  # what reads it several times would have the driver plan all of this as often


def item_pairs(members: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b: pairs of one item's listings, after an exact check of what an article is.

    Listings of one article number agree in colour and measure; others in kind
    and, but for a misspelling, in model too. Where colour or measure is unknown
    the pair stands if all listings of the item that share the other and the
    model, or all where these are unknown as well, have one such value; with several it could be
    any of them.
    """
    fields = {"colour": "measure", "measure": "colour"}
    sizes = members.groupBy("item").agg(F.count("*").alias("_n"), *(F.countDistinct(f).alias(f"_all_{f}") for f in fields)).where(F.col("_n") > 1).drop("_n")
    held = members.join(sizes, "item")
    for f, other in fields.items():
        its = members.where(F.col(other).isNotNull() & F.col("model").isNotNull()).groupBy("item", "model", other).agg(F.countDistinct(f).alias(f"_its_{f}"))
        held = held.join(its, ["item", "model", other], "left")
    counts = [F.coalesce(f"_its_{f}", f"_all_{f}").alias(f"_ways_{f}") for f in fields]
    held = written(held.select("item", key, *FIELDS, *counts), "held")
    side = lambda name: held.select("item", F.col(key).alias(name), F.struct(*FIELDS, *(f"_ways_{f}" for f in fields)).alias(f"_{name}"))
    both = side("a").join(side("b"), "item").where(F.col("a") < F.col("b"))
    same = {f: F.col(f"_a.{f}") == F.col(f"_b.{f}") for f in ("code", "kind", *fields)}
    numbered = F.coalesce(same["code"], F.lit(False))
    only = {f: F.greatest(f"_a._ways_{f}", f"_b._ways_{f}") < 2 for f in fields}
    agree = F.coalesce(same["code"], F.lit(True))
    for f in fields:
        agree = agree & F.coalesce(same[f], numbered | only[f])
    models = F.coalesce(F.levenshtein(F.col("_a.model"), F.col("_b.model"), 2) >= 0, F.lit(True))  # a swap is two
    return both.where(agree & (numbered | models & F.coalesce(same["kind"], F.lit(True)))).select("a", "b").distinct()


def listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings of product_record with their item."""
    kinds = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/canon_value.parquet").where(F.col("field_name") == "product_type").select("canon_id", F.explode(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>"))))).collect()]
    records = spark.read.parquet(f"{sf_dir}/product_record.parquet")
    attributes = written(parsed(records, "product_id", "title", "vendor", "body_html", "skus", kinds), "attributes")
    return same_items(modelled(numbered(attributes), "product_id"), "product_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of one article."""
    return item_pairs(listing_items(spark, sf_dir), "product_id").select(F.col("a").alias("product_id_a"), F.col("b").alias("product_id_b"))
