"""Raw keystrokes to the enriched table with folds, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.edits import annotate
from . import features as feat
from . import folds, layout
from .inference import linguistic_features, with_layout
from .sequences import TYPO_TYPES, normalise, split_at_typos
from .windows import ENRICHED

#: Every type of typing error ends a sequence, unless told otherwise.
DROP_ALL = dict.fromkeys(TYPO_TYPES, False)


def filtered(annotated: DataFrame, keep: dict[str, bool] = DROP_ALL) -> DataFrame:
    """Sequences cut at unwanted errors; the first name stays in original_sequence_id."""
    rows = split_at_typos(annotated, "sequence_id", ["time", "key"], F.col("typo_type"), keep)
    return rows.withColumn("sequence_id", F.concat_ws("_", "sequence_id", "part")).drop("part")


def enriched(normalised: DataFrame, dims: tuple[DataFrame, DataFrame, DataFrame], **tables: DataFrame) -> DataFrame:
    """All features of normalised sequences, in the columns of ENRICHED; what was not asked for is null."""
    rows = normalised.withColumn("pos", F.row_number().over(Window.partitionBy("sequence_id").orderBy("time", "key")) - 1)
    pairs = feat.pair_table(rows.sparkSession, layout.key_dim(*dims), layout.movement_dim(dims[1]))
    full = with_layout(linguistic_features(rows, "sequence_id", **tables), "sequence_id", pairs)
    reach = layout.key_dim(*dims).where("slot IS NOT NULL").join(layout.reach_dim(dims[1]), "slot")
    ways = reach.select("key_id", *(F.col(f"move_{c}").alias(f"reach_{c}") for c in ("dist", "sin", "cos")))
    full = full.join(F.broadcast(ways), "key_id", "left")
    return full.select(*(F.col(c) if c in full.columns else F.lit(None).cast("double").alias(c) for c in ENRICHED), "pos")


def run(raw: DataFrame, dims: tuple[DataFrame, DataFrame, DataFrame], word_folds: DataFrame, pair_folds: DataFrame, *, keep: dict[str, bool] = DROP_ALL, sds: float = 4.0, **tables: DataFrame) -> DataFrame:
    """Keystrokes (schema.KEYSTROKES) through errors, sequences, normalisation, features and folds (item, fold)."""
    full = enriched(normalise(filtered(annotate(raw), keep), sds), dims, **tables)
    return folds.assign(full, word_folds, pair_folds).select(*ENRICHED, "fold_word", "fold_bigram")
