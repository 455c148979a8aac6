"""Contract rows for scoring requests, and the frozen drift baseline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.contract import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, VELOCITY_COLUMNS, VELOCITY_FILLS, feature_columns
from riskloom.functions import scalars as S
from riskloom.operators import encode, prepare, velocity

#: Features computed at request time: name -> function of a frame that adds the column of that name.
ON_DEMAND: dict[str, Callable[[DataFrame], DataFrame]] = {
    "amt_log": lambda df: df.withColumn("amt_log", S.amount_log(F.col("TransactionAmt"))),
    "amt_to_card_mean_24h": lambda df: df.withColumn("amt_to_card_mean_24h", S.amount_to_mean_ratio(F.col("TransactionAmt"), F.col("card_amt_mean_24h"))),
}


def register_feature(name: str, add: Callable[[DataFrame], DataFrame]) -> None:
    """Add an on-demand feature; a name that is taken is an error."""
    if name in ON_DEMAND:
        raise ValueError(f"{name} is registered")
    ON_DEMAND[name] = add


def assemble_features(requests: DataFrame, snapshot: DataFrame, encoder: DataFrame, prior: float, v_columns: Sequence[str] = ()) -> DataFrame:
    """``transaction_id`` and the contract row of each decoded request ``(transaction_id, card_id, amount, raw)``.

    Maps are reindexed to the contract's names, the card's latest velocity comes from the snapshot (fills for
    unknown cards), categoricals are encoded with unseen keys at their defaults, numbers are coerced to float.
    """
    flat = requests.select(
        "transaction_id", F.col("card_id"), F.col("amount").alias("TransactionAmt"), *[F.col(f"raw.{c}").alias(c) for c in NUMERIC_COLUMNS],
        *S.reindex_map(F.col("raw.v"), v_columns), *S.reindex_map(F.col("raw.categorical"), CATEGORICAL_COLUMNS),
    )
    rows = velocity.lookup_latest(flat, snapshot, card="card_id", fills=VELOCITY_FILLS)
    for add in ON_DEMAND.values():
        rows = add(rows)
    rows = S.fill_missing_velocity(rows)
    rows = rows.withColumns({c: S.coerce_numeric(F.col(c)) for c in (*NUMERIC_COLUMNS, *v_columns)})
    encoded = encode.transform_encoder(rows, encoder, prior, CATEGORICAL_COLUMNS, "transaction_id")
    return encoded.select("transaction_id", *[F.col(c).cast("float").alias(c) for c in feature_columns(v_columns)])


def drift_baseline(train: DataFrame, encoder: DataFrame, prior: float, categoricals: Sequence[str], id: str, rows: int = 50_000, seed: int = 42) -> DataFrame:
    """A bounded sample of train under the full-train encoding, as it will be served (not out-of-fold)."""
    return encode.transform_encoder(prepare.uniform_sample(train, rows, id, seed), encoder, prior, categoricals, id)


def velocity_view(clean: DataFrame) -> DataFrame:
    """The card feature view of clean transactions ``(card_id, event_timestamp, TransactionID, TransactionAmt)``."""
    df = clean.withColumn("__us", F.unix_micros("event_timestamp"))
    out = velocity.seconds_since_previous(velocity.velocity(df, card="card_id", us="__us", amount="TransactionAmt"), card="card_id", us="__us", tie="TransactionID")
    names = dict(zip(("v_count", "v_sum", "v_mean", "v_max", "gap_s"), VELOCITY_COLUMNS, strict=True))
    return out.select("card_id", "event_timestamp", "TransactionID", *[F.col(a).cast("float").alias(b) for a, b in names.items()])
