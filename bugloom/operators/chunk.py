"""Records to chunks: clean, split, explode."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.chunks import split_text
from bugloom.functions.text import clean_text
from bugloom.schema import CHUNK_COLUMNS, combined_text, metadata_columns
from bugloom.session import unnest


def chunk_texts(
    df: DataFrame, text_col: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP
) -> DataFrame:
    """Replace a text column by ``(chunk_index, n_chunks, text)``, one row per piece."""
    pieces = df.withColumn("_pieces", split_text(F.col(text_col), size, overlap))
    rest = [c for c in df.columns if c != text_col]
    n_chunks = F.size("_pieces").alias("n_chunks")
    return unnest(pieces, "_pieces", "chunk_index", "text", *rest, n_chunks)


def chunk_defects(
    records: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of defect records with the records' metadata. Narrow: no shuffle.

    The combined text is cleaned a second time, after its parts were. A record without any
    text yields one chunk with its title, or its id.
    """
    pieces = split_text(F.col("_text"), size, overlap)
    fallback = F.array(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("defect_id")))
    # Chunks carry no more of the record than the metadata: descriptions stop here.
    prepared = (
        records.withColumn("_text", clean_text(combined_text()))
        .select(
            *metadata_columns(),
            F.nullif("resolution_note", F.lit("")).alias("resolution_note"),
            F.nullif("created_at", F.lit("")).alias("created_at"),
            pieces.alias("_split"),
        )
        .withColumn(
            "_pieces", F.when(F.size("_split") > 0, F.col("_split")).otherwise(fallback)
        )
        .drop("_split")
    )
    n_chunks = F.size("_pieces").alias("n_chunks")
    exploded = unnest(prepared, "_pieces", "chunk_index", "text", "*", n_chunks)
    return exploded.withColumn(
        "chunk_id",
        F.concat(
            F.coalesce("defect_id", F.lit("")), F.lit("::chunk"), F.col("chunk_index").cast("string")
        ),
    ).select(*CHUNK_COLUMNS)
