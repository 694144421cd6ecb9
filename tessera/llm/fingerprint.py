"""Document fingerprints by consistent weighted sampling, in SQL functions only.

A document is a weighted set: its five-word shingles with their counts.  For
each of ``SAMPLES`` samples, a term of weight w draws r and c from Gamma(2, 1)
and b from Uniform(0, 1), all decided by the term's hash; then
t = floor(ln w / r + b) and ln a = ln c - r (t + 1 - b).  The term of least a
is the sample.  Two documents take the same sample with a chance equal to
their generalised Jaccard similarity.  As a depends on (term, t) alone, the
least a itself names the sample.

The variates are exact, and drawn from three independent Exp(1) variates
a0, h and g: c = a0 + h is Gamma(2, 1), and a0 / c is uniform and independent
of it, so e = ln(c / a0) is Exp(1); r = e + g is Gamma(2, 1), and b = g / r is
uniform and independent of it.  With these, a = a0 exp(-r t) and
t = floor((ln w + g) / r).  Compared is 1 - exp(-a), which grows with a: where
t = 0, as with every term of weight 1, that is the uniform variate from which
a0 is drawn, so that most terms take one hash and no logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._order import boundaries, with_range

SAMPLES = 32
WORDS = 5
_SPACES = "[\\x20\\x09-\\x0D]+"


def _sample(j: int) -> Column:
    """1 - exp(-a) of sample ``j``, from columns ``_x{j}`` (the term's bits) and ``_lnw`` (null: no term)."""
    x = f"_x{j}"
    u = f"((shiftrightunsigned({x}, 12) + 0.5D) * 2.220446049250313E-16D)"
    a = f"(-log1p(-{u}))"
    # h and g take the halves of a second hash
    y = f"xxhash64({x})"
    h = f"(-ln((shiftrightunsigned({y}, 32) + 0.5D) * 2.3283064365386963E-10D))"
    g = f"(-ln((({y} & 4294967295L) + 0.5D) * 2.3283064365386963E-10D))"
    r = f"(log1p({h} / {a}) + {g})"
    t = f"floor((_lnw + {g}) / {r})"
    return F.expr(f"if(_lnw = 0.0D, {u}, if({t} = 0, {u}, -expm1(-{a} * exp(-{r} * {t}))))")


def signatures(df: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """One row per ``keys`` (which must tell rows apart) with ``_sig``, an array of ``samples`` doubles.

    Null, empty and blank texts have no terms: every sample is null.  A text
    of one to four words has one term, its whole sequence.
    """
    df = df.select(*keys, F.btrim(F.coalesce(text_col, F.lit("")), F.lit(" \t\n\x0b\x0c\r")).alias("_text"))
    df = df.select(*keys, F.when(F.col("_text") != "", F.transform(F.split("_text", _SPACES, -1), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("_w"))
    n = F.size("_w")
    at = lambda i, k: F.get("_w", i + k)
    shingles = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(at(i, k) for k in range(WORDS))))
    df = df.select(*keys, F.when(n >= WORDS, shingles).when(n > 0, F.array(F.xxhash64(F.lit("short"), "_w"))).alias("_s"))
    df = df.select(*keys, "_s", F.array_distinct("_s").alias("_d"))
    # Most texts repeat no shingle; only where one does are counts taken, from the runs of the sorted array.
    sorted_ = F.sort_array("_s")
    df = df.select(*keys, "_d", F.when(F.size("_s") > F.size("_d"), sorted_).alias("_s"))
    runs = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    df = df.select(*keys, "_d", "_s", F.when(F.col("_s").isNotNull(), runs).alias("_r"))
    terms = F.when(F.col("_s").isNull(), F.col("_d")).otherwise(F.transform("_r", lambda i: F.get("_s", i)))
    ends = F.concat(F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1))), F.array(F.size("_s")))
    counts = F.when(F.col("_s").isNotNull(), F.zip_with(ends, "_r", lambda e, b: e - b))
    df = df.select(*keys, terms.alias("_t"), counts.alias("_c"))
    df = df.select(*keys, "_c", F.posexplode_outer("_t").alias("_pos", "_term"))
    weight = F.when(F.col("_c").isNull(), F.when(F.col("_term").isNotNull(), F.lit(0.0))).otherwise(F.log(F.get("_c", F.col("_pos")).cast("double")))
    df = df.select(*keys, weight.alias("_lnw"), *(F.xxhash64("_term", F.lit(j)).alias(f"_x{j}") for j in range(samples)))
    sampled = [F.min(_sample(j)).alias(f"_m{j}") for j in range(samples)]
    out = df.groupBy(*keys).agg(*sampled)
    return out.select(*keys, F.array(*(F.col(f"_m{j}") for j in range(samples))).alias("_sig"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: 1 for two texts without terms, 0 where one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    none_a, none_b = F.get(a, F.lit(0)).isNull(), F.get(b, F.lit(0)).isNull()
    return F.when(none_a & none_b, F.lit(1.0)).when(none_a | none_b, F.lit(0.0)).otherwise(same / F.lit(float(samples)))


def as_text(sig: Column) -> Column:
    """A fingerprint's text: eight hex digits a sample; empty where there are no terms."""
    return F.when(F.get(sig, F.lit(0)).isNull(), F.lit("")).otherwise(F.array_join(F.transform(sig, lambda v: F.substring(F.lpad(F.hex(F.xxhash64(v)), 16, "0"), 9, 8)), ""))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with ``_next``, the text of the next row by id; after the last comes the first.

    Rows are cut into ranges of (id, hash of the text) at sampled bounds, as
    many as the bytes of text ask for; the range is the only shuffle key, and
    a range's first row also goes, as a ghost, to the range before.  So no
    task sees more than its ranges, also where many texts share an id.  Null
    ids come first; rows of equal ids are ordered by that hash, then by text,
    and rows that are equal in both stay in one range.  Ghosts stay in the
    result (``_ghost``).
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_tie", F.xxhash64("_text"))
    bounds = boundaries(df, "_key", "_tie", "_text", 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) or [(0, 0)]
    df = with_range(df, "_key", "_tie", bounds, "_b", "_bound")
    first = F.col("_b") == 1
    before = F.when(first, F.lit(len(bounds))).otherwise(F.col("_b") - 1)
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    ghost = F.struct(before.alias("b"), first.cast("int").alias("wrap"), F.lit(True).alias("ghost"))
    df = df.withColumn("_to", F.explode(F.when(F.col("_bound"), F.array(own, ghost)).otherwise(F.array(own))))
    df = df.select("_id", "_key", "_tie", "_text", F.col("_to.b").alias("_b"), F.col("_to.wrap").alias("_wrap"), F.col("_to.ghost").alias("_ghost"))
    by = Window.partitionBy("_b").orderBy("_wrap", "_key", "_tie", "_text")
    return df.select("_id", "_b", "_ghost", "_text", F.row_number().over(by).alias("_rn"), F.lead("_text").over(by).alias("_next"))


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The contract's rows: each document's fingerprint, its edited text's, and the likenesses.

    Null texts count as empty; two texts without terms are alike (1), one with
    and one without are not (0); a single document is its own next one;
    repeated rows give one row each, and extra columns are left out.
    """
    df = with_next(docs, "doc_id", "text")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    df = df.select("_id", "_b", "_rn", "_ghost", "_text", n.cast("long").alias("_n"), F.when(~F.col("_ghost"), F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))).alias("_edited"))
    # Three rows a document: its text, its edited text, and one without terms for the digest,
    # so that the grouping key of the many term rows stays a few numbers.
    none = F.lit(None).cast("string")
    own = F.struct(F.lit(0).alias("k"), F.col("_text").alias("t"), none.alias("sha"))
    edited = F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t"), none.alias("sha"))
    digest = F.struct(F.lit(2).alias("k"), F.lit("").alias("t"), F.sha2(F.encode("_edited", "UTF-8"), 256).alias("sha"))
    df = df.withColumn("_v", F.explode(F.when(F.col("_ghost"), F.array(own)).otherwise(F.array(own, edited, digest))))
    df = df.select("_b", "_rn", "_ghost", "_id", "_n", F.col("_v.sha").alias("_sha"), F.col("_v.k").alias("_k"), F.col("_v.t").alias("_t0"))
    sigs = signatures(df, ["_b", "_rn", "_ghost", "_id", "_n", "_k", "_sha"], "_t0", samples)
    by = Window.partitionBy("_b").orderBy("_rn", "_k")
    out = sigs.select("*", F.lead("_sig", 1).over(by).alias("_e"), F.lead("_sha", 2).over(by).alias("_esha"), F.lead("_sig", 3).over(by).alias("_f"))
    out = out.where((F.col("_k") == 0) & ~F.col("_ghost"))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_chars"),
        F.col("_esha").alias("edited_sha256"),
        as_text(F.col("_sig")).alias("fingerprint"),
        as_text(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_e"), samples).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_f"), samples).alias("near_next"),
    )
