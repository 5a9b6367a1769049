"""Document fingerprints: SpotSigs, all inside the JVM.

Words follow runs of letters and digits in lower case. Each occurrence of a common word is an anchor; its
spot signature is the anchor and the chain of the next CHAIN words that are not common, wherever other
anchors stand between. The set of a text's signatures, each hashed to 32 bits, is its fingerprint,
written as sorted hexadecimal numbers. Boilerplate of links and lists has no anchors and leaves no trace.

Defined results: a null text counts as empty. A text without any signature has one that stands for all
its words, and a text without words has an empty fingerprint. Two empty fingerprints are alike to 1,
an empty and another to 0. Null ids come before all others, as one id; rows that share an id follow each
other by text. A single row is its own successor. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recon.llm.common import bound, texts, written

# Common words of four languages.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she "
    "that the their there they this to was we were which with you "
    "au aux ce ces dans de des du elle en est et il ils la le les leur ne nous ou par pas pour qui que sa "
    "se ses son sur un une vous "
    "aber als am auch auf aus bei bin das dass dem den der die ein eine einem einen einer er es für hat "
    "ich ihr im ist mit nach nicht noch nur oder sein sich sie sind so und von war wir wird zu zum zur "
    "al como con del desde el ella ellos era eran las lo los más mi muy no nos para pero por sin sobre "
    "son su sus también una y ya"
)
CHAIN = 2
BUCKET_ROWS = 1_000
MOST_BUCKETS = 4_096
_SIDE = 64
_LEAST_ID = -(2**63)


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit signatures of a text without nulls."""
    common = sorted(set(ANCHORS.split()))

    def chains(words: Column, content: Column) -> Column:
        anchors = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull())
        # Before the j-th anchor, at word p, stand p - j words that are not anchors.
        return F.transform(anchors, lambda p, j: F.when(
            p - j < F.size(content),
            F.hash(F.concat_ws(":", F.get(words, p), *[F.get(content, p - j + k) for k in range(CHAIN)]))))

    def marks(words: Column) -> Column:
        spots = bound(F.filter(words, lambda w: ~w.isin(common)), lambda content: chains(words, content))
        spots = F.array_sort(F.array_distinct(F.array_compact(spots)))
        whole = F.array(F.hash(F.concat_ws(" ", F.lit("whole"), words)))
        return bound(spots, lambda x: F.when(F.size(x) > 0, x).when(F.size(words) > 0, whole).otherwise(
            F.array().cast("array<int>")))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return bound(words, marks)


def rendered(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.lower(F.hex(m.cast("bigint").bitwiseAND(0xFFFFFFFF)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def _buckets(ids: DataFrame, name: str) -> tuple[Column, Column, int]:
    """Number (from 1) of the range of ids a row falls in, that range's least id, and how many there are.

    The least ids are order statistics of the ids themselves, so ranges hold about equally many rows
    however the ids are spread; there are at most MOST_BUCKETS.
    """
    total = ids.count()
    wanted = min(MOST_BUCKETS, max(1, math.ceil(total / BUCKET_ROWS)))
    shares = [i / wanted for i in range(1, wanted)]
    aggregates = [F.min(name).alias("least")]
    if shares:
        aggregates.append(F.percentile_approx(name, shares, 10 * MOST_BUCKETS).alias("cuts"))
    row = ids.agg(*aggregates).first()
    if row.least is None:
        return F.lit(1), F.lit(_LEAST_ID), 1
    starts = sorted({row.least, *(row.cuts if shares else [])})

    def constant(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    # Two short searches in place of one long one.
    coarse = constant(starts[::_SIDE])
    fine = F.split(F.lit(";".join(",".join(map(str, starts[i: i + _SIDE])) for i in range(0, len(starts), _SIDE))), ";")
    row_no = F.size(F.filter(coarse, lambda x: x <= F.col(name)))
    line = F.split(F.get(fine, row_no - 1), ",").cast("array<bigint>")
    within = F.size(F.filter(line, lambda x: x <= F.col(name)))
    return (row_no - 1) * _SIDE + within, F.get(line, within - 1), len(starts)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, marks, next_text, next_marks): each row with the row of the next larger id.

    Rows are shuffled once, by ranges of ids. The first row of a range also goes to the range before
    it, where it only serves as a successor; that of the first range goes to the last.
    """
    rows = texts(docs).withColumn("place", F.coalesce("doc_id", F.lit(_LEAST_ID)))
    bucket, least, total = _buckets(rows.select("place"), "place")
    before = F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(total))
    both = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")),
                   F.struct(before.alias("bucket"), F.lit(1).alias("tail")))
    one = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")))
    dealt = (rows.withColumn("bucket", bucket)
             .withColumn("copies", F.when(F.col("place") == least, both).otherwise(one))
             .select("doc_id", "place", "text", F.explode("copies").alias("copy"))
             .select("doc_id", "place", "text", "copy.bucket", "copy.tail")
             .repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("tail", "place", "text")
    return (dealt.withColumn("marks", signatures(F.col("text")))
            .withColumn("next", F.lead(F.struct("text", "marks")).over(order))
            .where(F.col("tail") == 0)
            .select("doc_id", "text", "marks", F.col("next.text").alias("next_text"), F.col("next.marks").alias("next_marks")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form, and how alike they are; see the module's head."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_marks", signatures(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("marks")).alias("fingerprint"), rendered(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Texts whose fingerprints are alike: (membership, pairs).

    Membership is (doc_id, class_id), a class being all rows of one fingerprint and its id the smallest
    of theirs; pairs is (left_id, right_id, likeness) between classes, left_id < right_id. Sets are
    partitioned by length so that a set needs its own and the next partition only, and a set is indexed
    under its rarest signatures, as many as a set this much alike cannot all lack. Empty fingerprints
    are in no pair.
    """
    rows = written(texts(docs).select("doc_id", signatures(F.col("text")).alias("marks")).where("doc_id IS NOT NULL"))
    classes = written(rows.groupBy("marks").agg(F.min("doc_id").alias("class_id")))
    members = rows.join(classes, "marks").select("doc_id", "class_id")
    size = F.size("marks")
    sets = classes.where(size > 0).select("class_id", "marks", size.alias("size"),
                                          F.floor(F.log(size) / -math.log(threshold) + 1e-9).cast("int").alias("part"))
    spread = sets.select("class_id", "size", "part", F.explode("marks").alias("mark"))
    ranked = spread.join(spread.groupBy("mark").agg(F.count("*").alias("n")), "mark")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("n", "mark"))
    index = ranked.withColumn("place", place).where(
        F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    a = index.select("mark", "part", F.col("class_id").alias("a"), F.col("size").alias("a_size"))
    b = index.select("mark", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"),
                     F.col("class_id").alias("b"), F.col("size").alias("b_size"))
    fits = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    near = (a.join(b, ["mark", "part"]).where(fits & (F.col("a_size") >= F.col("b_size") * threshold - 1e-9))
            .select("a", "b").distinct())
    checked = (near.join(classes.select(F.col("class_id").alias("a"), F.col("marks").alias("x")), "a")
               .join(classes.select(F.col("class_id").alias("b"), F.col("marks").alias("y")), "b")
               .withColumn("likeness", likeness(F.col("x"), F.col("y"))).where(F.col("likeness") >= threshold))
    return members, checked.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "likeness")
