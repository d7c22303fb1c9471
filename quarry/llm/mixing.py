"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

The token budget goes down the tree in proportion to the weights of siblings. A node gets at most its capacity, its tokens times ``max_epochs``; what it
can't take is shared by its siblings in proportion to their weights, and only what all of them can't take goes to other branches of their
parent (and so on upwards). A leaf takes whole epochs and then the beginning of one more: its documents in the order of
md5(seed:epoch:id), as long as the tokens before a document are fewer than what is left to take.

Texts are read once: ids, leaves and token counts are written, some tens of bytes a document, and all else reads those. Everything is aggregation: tokens per
leaf, then per leaf and 16 bits of the hash; the beginning's last hash value is found in the one bucket where the budget ends. Documents are then chosen by comparing their own
hash with their leaf's last one, so a source that holds a third of all rows isn't sorted or moved. Leaves, of which there are as many as sources, are shared out
among siblings per parent; beyond LEAVES_BROADCAST of them their documents are joined to them in SALTS parts.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Defined results: null or empty text has no tokens, a text of any length counts whole; either is chosen with its place in the order; a null language or source is the
leaf ''; rows of one id are chosen together; a null id is ordered as the empty string; leaves without tokens give nothing; an empty table gives an
empty result; other columns are not read (``mix_documents`` hands them through).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

LEAVES_BROADCAST = 100_000  # about 100 bytes each
SALTS = 64
LEAF = ["domain", "language", "origin"]


@dataclass(frozen=True)
class Mix:
    """Weights of siblings (others have the weight default), the share of all tokens to take, epochs at most, and the seed."""

    domains: dict[str, float] = field(default_factory=lambda: {"d0": 0.3, "d1": 0.3, "d2": 0.2, "d3": 0.2})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    default: float = 0.1
    share: float = 0.8
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source: the remainder by 4 of the number that ends its name; without one, 'other'."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (digits.cast("long") % 4).cast("string")))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(names: dict[str, float], default: float, of: str) -> Column:
    w = F.lit(float(default))
    for k, v in names.items():
        w = F.when(F.col(of) == k, F.lit(float(v))).otherwise(w)
    return w


def _fill(children: DataFrame, parents: list[str], child: str, weight: Column) -> DataFrame:
    """Adds ``take`` to rows with ``budget`` (of the parent) and ``room`` (of the child): the weighted share, or the room where that is less."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), child)
    first = children.withColumn("weight", weight).select(
        "*",
        F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = (F.col("budget") - F.col("full")) / F.col("open")
    over = F.col("room") <= F.col("weight") * level
    rate = F.first(F.when(~over, level), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return first.withColumn("take", F.when(over, F.col("room").cast("double")).otherwise(F.col("weight") * rate)).drop("weight", "full", "open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, origin, tokens, take) from (domain, language, origin, tokens): one row a leaf."""
    leaves = leaves.where("tokens > 0").withColumn("room", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    leaves = leaves.withColumn("total", F.lit(total) * F.lit(float(mix.share)))
    domains = leaves.groupBy("domain").agg(F.sum("room").alias("room"), F.max("total").alias("budget"))
    domains = _fill(domains, [], "domain", _weight(mix.domains, mix.default, "domain")).select("domain", F.col("take").alias("budget"))
    languages = leaves.groupBy("domain", "language").agg(F.sum("room").alias("room")).join(domains, "domain")
    languages = _fill(languages, ["domain"], "language", _weight(mix.languages, mix.default, "language")).select("domain", "language", F.col("take").alias("budget"))
    origins = _fill(leaves.join(languages, ["domain", "language"]), ["domain", "language"], "origin", _weight(mix.sources, 1.0, "origin"))
    return origins.select(*LEAF, "tokens", F.floor(F.col("take") + 0.001).cast("long").alias("take"))


def _described(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), domain_of(source).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("language"), source.alias("origin"), words(F.col(text_col)).alias("tokens"))


def _plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, origin, epochs, cut) of rows as _sized() gives them: whole epochs that each leaf takes, and the last hash it takes of the next one (null: none)."""
    leaves = storage.written(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), "leaves")
    plan = budgets(leaves, mix)
    plan = storage.written(plan.select(*LEAF, F.floor(F.col("take") / F.col("tokens")).cast("long").alias("epochs"), (F.col("take") % F.col("tokens")).alias("rest")), "budgets")
    hashed = _looked_up(rows, plan.where("rest > 0")).withColumn("h", order_hash(mix.seed, F.col("epochs"), F.col("id"))).withColumn("bucket", F.substring("h", 1, 4))
    buckets = hashed.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last bucket that begins below the budget
    last = buckets.withColumn("before", before).where("before < rest").groupBy(*LEAF).agg(F.max(F.struct("bucket", "before")).alias("b"))
    last = storage.written(last.select(*LEAF, F.col("b.bucket").alias("bucket"), F.col("b.before").alias("before")), "last_buckets")
    inside = _looked_up(hashed, last.withColumnRenamed("bucket", "ends")).where("bucket = ends").groupBy(*LEAF, "bucket", "h").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    earlier = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("earlier", F.col("before") + earlier).where("earlier < rest").groupBy(*LEAF).agg(F.max("h").alias("cut"))
    return storage.written(plan.join(cut, LEAF, "left").select(*LEAF, "epochs", "cut"), "cuts")


def _looked_up(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with what a table with a row a leaf says. The table is broadcast while it has few rows, else every row of it goes to SALTS tasks, over which a leaf's documents are spread."""
    if leaves.count() <= LEAVES_BROADCAST:
        return rows.join(F.broadcast(leaves), LEAF)
    salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*LEAF, "salt"]).drop("salt")


def _chosen(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """rows with id and leaf columns, once for each epoch that takes them."""
    rows = _looked_up(rows, plan).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    part = order_hash(mix.seed, F.col("epoch"), F.col("id")) <= F.col("cut")
    return rows.where((F.col("epoch") < F.col("epochs")) | part).drop("epochs", "cut")


def _sized(docs: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """The ids, leaves and token counts, written once: texts are read and counted in one pass only."""
    return storage.written(_described(docs, *columns), "sized")


def mixture(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, domain, lang, source, epoch, n_tokens): the documents that the mixture takes, one row for each time."""
    mix = mix or Mix()
    rows = _sized(docs, (id_col, text_col, lang_col, source_col))
    got = _chosen(rows, _plan(rows, mix), mix)
    return got.select(F.col("id").alias(id_col), "domain", F.col("language").alias("lang"), F.col("origin").alias("source"), "epoch", F.col("tokens").alias("n_tokens"))


def mix_documents(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the mixture takes, with all their columns, once for each time."""
    mix = mix or Mix()
    plan = _plan(_sized(docs, (id_col, text_col, lang_col, source_col)), mix)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id_col, lang_col, source_col)}
    plain = docs.toDF(*names)
    source = F.coalesce(F.col(at[source_col]).cast("string"), F.lit(""))
    rows = plain.select(*names, F.col(at[id_col]).alias("id"), domain_of(source).alias("domain"), F.coalesce(F.col(at[lang_col]).cast("string"), F.lit("")).alias("language"), source.alias("origin"))
    return _chosen(rows, plan, mix).select(*names).toDF(*docs.columns)
