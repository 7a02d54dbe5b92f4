"""Style rules: declarations to rules, and rules onto elements. All relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config as C
from quire.functions import text as X

FLAGS = ("bold", "italic", "underline", "center", "page_break_before")


def rules(declarations: DataFrame, strict: bool = False) -> DataFrame:
    """css_rules of css_decls(book_id, pos, selectors array<string>, prop, value): flags of one key are united, the last size declared wins."""
    set_ = declarations.withColumns({"prop": X.css_property(F.col("prop")), "value": X.css_value(F.col("value"), strict)})
    set_ = set_.withColumn("d", F.explode(F.array(X.css_declaration(F.col("prop"), F.col("value"))))).where("d IS NOT NULL")
    keyed = set_.select("book_id", "pos", "d.*", F.explode("selectors").alias("selector")).withColumn("k", X.css_selector("selector")).where("k IS NOT NULL")
    flags = [F.bool_or(f).alias(f) for f in FLAGS]
    return keyed.groupBy("book_id", "k.kind", "k.key").agg(*flags, F.max_by("font_ratio", F.when(F.col("font_ratio").isNotNull(), F.col("pos"))).alias("font_ratio"))


def resolve(elements: DataFrame, css_rules: DataFrame, strict: bool = False) -> DataFrame:
    """elements(book_id, element_id, tag, id, class, style) with the style that applies to each.

    Tag, then id, then the classes in their order, then the element's own style: flags are united, the last size wins.
    """
    classes = F.array_remove(F.split(F.coalesce("class", F.lit("")), "[ \\t\\r\\n\\f]+"), "")
    by_class = F.transform(classes, lambda c, i: F.struct(F.lit("CLASS").alias("kind"), X.ascii_lower(c).alias("key"), (i + 2).alias("rank")))
    keys = F.concat(
        F.array(F.struct(F.lit("TAG").alias("kind"), X.ascii_lower("tag").alias("key"), F.lit(0).alias("rank"))),
        F.when(F.coalesce("id", F.lit("")) != "", F.array(F.struct(F.lit("ID").alias("kind"), X.ascii_lower("id").alias("key"), F.lit(1).alias("rank")))).otherwise(F.array().cast("array<struct<kind:string,key:string,rank:int>>")),
        by_class,
    )
    wanted = elements.select("book_id", "element_id", F.explode(keys).alias("k")).select("book_id", "element_id", "k.*")
    met = wanted.join(css_rules, ["book_id", "kind", "key"]).select("book_id", "element_id", "rank", *FLAGS, "font_ratio")
    own = elements.where(F.coalesce("style", F.lit("")) != "").select("book_id", "element_id", F.posexplode(F.split("style", ";")).alias("i", "decl"))
    own = own.where("instr(decl, ':') > 0").withColumns({"prop": X.css_property(F.substring_index("decl", ":", 1)), "value": X.css_value(F.expr("substr(decl, instr(decl, ':') + 1)"), strict)})
    own = own.withColumn("d", F.explode(F.array(X.css_declaration(F.col("prop"), F.col("value"))))).where("d IS NOT NULL")
    own = own.select("book_id", "element_id", (F.col("i") + 1_000_000).alias("rank"), *(F.col(f"d.{f}").alias(f) for f in FLAGS), "d.font_ratio")
    applied = met.unionByName(own).groupBy("book_id", "element_id").agg(*(F.bool_or(f).alias(f) for f in FLAGS), F.max_by("font_ratio", F.when(F.col("font_ratio").isNotNull(), F.col("rank"))).alias("font_ratio"))
    out = elements.join(applied, ["book_id", "element_id"], "left")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS})


def inherited_ratio(ratios: Column) -> Column:
    """The product of an element's and its ancestors' ratios, outermost first, held to its bounds at every step."""
    held = lambda r: F.least(F.lit(C.RATIO_MOST).cast("float"), F.greatest(F.lit(C.RATIO_LEAST).cast("float"), r))
    return F.aggregate(ratios, F.lit(1.0).cast("float"), lambda a, r: held((a * F.coalesce(r, F.lit(1.0).cast("float"))).cast("float")))
