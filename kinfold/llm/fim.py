"""Fill-in-middle transformation (12) by relational units.

A text is cut into units by a pattern; `posexplode` gives each unit a row (its ordinal and its length, not its text), a window sums the lengths, so
that each unit has the offset at which it ends; the two cut requests of a document meet the units by ordinal, an aggregate makes one row of offsets
of them, and `substring` takes prefix, middle and suffix. All is built-in functions. Units, sums, requests
and offsets are rows of numbers; texts are shuffled once, to meet their offsets.

Which rows are transformed, how, and where they are cut comes from four 32-bit numbers of a hash of the seed and doc_id, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plainly_named

#: Lines with their ends; the last may lack one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of `seed:doc_id`; a null id is an empty string there."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def offsets(cut: DataFrame, key: list[str]) -> DataFrame:
    """For each row of cut (key, chars: lengths of the units in order, lo and hi: units before each cut; keys are unique) n, and the offsets in code points of its
    cuts, lo_at and hi_at. A cut after no unit is at 0. A window holds the units of one row of cut, no more than that row does."""
    units = cut.select(*key, F.posexplode_outer("chars").alias("pos", "chars"))
    upto = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select(*key, (F.col("pos") + 1).cast("long").alias("ordinal"), F.sum("chars").over(upto).alias("at"))
    request = [F.struct(F.lit(k).alias("cut"), F.col(c).alias("ordinal"), F.size("chars").cast("long").alias("n")) for k, c in enumerate(("lo", "hi"))]
    asked = cut.select(*key, F.explode(F.array(*request)).alias("r")).select(*key, "r.*")
    met = asked.join(ends, [*key, "ordinal"], "left")
    return met.groupBy(*key).agg(F.max("n").alias("n"), *(F.coalesce(F.max(F.when(F.col("cut") == k, F.col("at"))), F.lit(0)).alias(f"{c}_at") for k, c in enumerate(("lo", "hi"))))


def restored(output: Column, form: Column) -> Column:
    """The text that a form's output was made from. A text with a sentinel is never transformed and no sentinel overlaps itself, so each stands once, where it was put."""
    p = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, units: str = LINES, with_text: bool = True) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output_sha256, restored_sha256 and, unless with_text is false, output.

    `rate` of 100 documents are transformed, `spm_rate` of 100 of them suffix first. Null and empty texts have no units and are plain, as is any text that
    contains a sentinel. Rows without an id are drawn as if their id were the empty string; rows that share an id share its draws and are cut each by its own units; rows
    repeated whole give equal rows. Texts of any length that a row can hold are taken whole. Columns beside doc_id and text are left behind; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = plainly_named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # two hashes name a row: rows that share them are equal in id and text, so one of them is cut for all
    base = base.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text")).alias("k2"))
    key = ["k1", "k2"]
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = reduce(lambda a, b: a | b, [F.contains("text", F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)])
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    chars = F.transform(F.regexp_extract_all("text", F.lit(units), F.lit(0)), F.char_length)
    cut = base.select(*key, chars.alias("chars"), h1.alias("h1"), h2.alias("h2")).groupBy(*key).agg(*(F.max(c).alias(c) for c in ("chars", "h1", "h2")))
    n1 = F.size("chars") + F.lit(1)
    cut = cut.select(*key, "chars", F.least(F.col("h1") % n1, F.col("h2") % n1).alias("lo"), F.greatest(F.col("h1") % n1, F.col("h2") % n1).alias("hi"))
    at = offsets(cut, key).hint("shuffle_hash")  # a row a text, without the text: the texts needn't be sorted
    docs = base.withColumn("form", form).join(at, key)
    lo, hi = F.col("lo_at").cast("int"), F.col("hi_at").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), lo), F.substring("text", lo + 1, hi - lo), F.substring("text", hi + 1, F.lit(2**31 - 1))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    out = docs.select("doc_id", "n", "form", "lo_at", "hi_at", output.alias("output"))
    told = F.col("form") != "plain"
    return out.select(
        "doc_id",
        "n",
        "form",
        F.when(told, F.col("lo_at")).alias("prefix_chars"),
        F.when(told, F.col("hi_at") - F.col("lo_at")).alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
        *(["output"] if with_text else []),
    )
