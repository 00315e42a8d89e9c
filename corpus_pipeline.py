"""A corpus pipeline of five stages, each written as Parquet and read again.

    from corpus_pipeline import run
    sequences = run(spark, "folder of the tables")

Stages take and give the columns of ``documents``; the last gives the packed
pieces.  Documents without a language go, one document of each near-duplicate
class stays, passages that an earlier document has are cut, small sources are
repeated and all dealt to blocks, and what is left is packed into sequences.  An
empty table gives no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import op3_mixing, op5_suffix, op7_language, op8_order_minhash, op9_packing
from inkgauge.session import fresh_path, written

#: A document stays if its language has at least this chance; with no letter it has none.
LEAST_LANGUAGE_SCORE = 0.3

#: Language models, alignment and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the model learns from the rows that name theirs.

    With no row that names one there is no language to find, and no document stays.
    """
    model = op7_language.fit_languages(docs.where(~op7_language.base.held_out("doc_id", op7_language.FOLDS, op7_language.FOLD)))
    out = max(docs.columns, key=len) + "_found"  # longer than any name there is
    known = (F.col(f"`{out}`.lang_pred") != op7_language.UNKNOWN) & (F.col(f"`{out}`.score") >= LEAST_LANGUAGE_SCORE)
    return op7_language.identify(docs, model, out=out).where(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class, once; rows of a null id stay."""
    classes = op8_order_minhash.near_duplicates(docs)
    by_id = classes.where("id is not null").groupBy(F.col("id").alias("of")).agg(F.count("*").alias("rows"), F.min("class_id").alias("class_id"))
    odd = by_id.where("of <> class_id or rows > 1").select("of", (F.col("of") != F.col("class_id")).alias("goes"))
    odd = written(odd, "corpus-odd")
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    single = rows.join(odd, rows.id == odd.of, "left_anti").select("row.*")
    repeated = odd.where("not goes")
    if repeated.isEmpty():
        return single
    # rows of one id that stays: the first of them by all their columns
    first = rows.join(repeated, rows.id == repeated.of).groupBy("of").agg(F.min("row").alias("row")).select("row.*")
    return single.unionAll(first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has.

    What is left of a text stays as it stands; one of which nothing is left goes.
    """
    out = op5_suffix.suffix_dedup(docs, join_words=False)
    keep = out.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    new = {"doc_id": F.col("id"), "text": F.col("kept_text"), "n_chars": n_chars}
    return keep.select(*[(new[c] if c in new else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, block by block of the mix: all at least once, those of small sources up to twice.

    A block's rows lie together in its order.  Equal rows are one row with the uses
    of all of them; null ids, sources and texts are values.  An empty table gives no
    rows.
    """
    own = max(docs.columns, key=len)  # names made from it are longer than any there is
    key, of, block, place, epoch = (f"{own}_{c}" for c in ("key", "of", "block", "place", "epoch"))
    values = [v for c in docs.columns for v in (F.col(f"`{c}`"), F.isnull(F.col(f"`{c}`")))]
    same = F.concat_ws(":", F.xxhash64(F.lit(1), *values).cast("string"), F.xxhash64(F.lit(2), *values).cast("string"))
    rows = docs.withColumn(key, same)
    uses = op3_mixing.mix_sources(rows, id_col=key)
    uses = uses.select(F.col("id").alias(of), F.col("block").alias(block), F.col("place").alias(place), F.col("epoch").alias(epoch))
    repeated = written(rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key), "corpus-repeated")
    if not repeated.isEmpty():
        first = rows.join(repeated, key, "left_semi").groupBy(key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("row"))
        rows = rows.join(repeated, key, "left_anti").select(*rows.columns).unionAll(first.select("row.*"))
    placed = rows.join(uses, rows[key] == uses[of])
    return placed.repartition(block).sortWithinPartitions(block, place, epoch).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Rows count each, also those of one id or a null one; a null text is an empty
    one, and an empty table gives no rows.
    """
    import public_tokenizers

    pieces = op9_packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return op9_packing.pack_pieces(pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each result but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
