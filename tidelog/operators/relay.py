"""The confirmed forwarder: strict decode, projection to deliveries, acknowledgements of what was confirmed.

Acknowledgements follow from confirmed deliveries only, so every failure leaves the source
message unacknowledged and it is forwarded again under the same id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.codec import decode_rows, encode_ack, encode_delivery
from tidelog.session import drop, save


@dataclass(frozen=True)
class Forwarded:
    """Deliveries (topic, message_id, encoded), and what was rejected (raw, error); both read ``decoded``."""

    deliveries: DataFrame
    rejects: DataFrame
    decoded: DataFrame


def forward(wire: DataFrame, relay_topic: str | None = None, raw: str = "value") -> Forwarded:
    """Decode wire rows and project the good ones; rows of other topics are ignored, as the subscription would.

    Decoded rows are written once: both outputs filter them, and a filter would otherwise be
    pushed below the decoder with the decoder in it.
    """
    rows = wire if relay_topic is None else wire.where(F.col("topic") == relay_topic)
    decoded = save(decode_rows(rows.select(F.col(raw).alias("raw")), F.col("raw")), "decoded")
    good = decoded.where("d.ok").select("d.topic", "d.message_id", encode_delivery(F.col("d.message_id"), F.col("d.payload_json")).alias("encoded"))
    return Forwarded(good, decoded.where("NOT d.ok").select("raw", "d.error"), decoded)


def acks_of(confirmed: DataFrame) -> DataFrame:
    """An acknowledgement for each confirmed delivery, duplicates included."""
    return confirmed.select("message_id", encode_ack(F.col("message_id")).alias("encoded"))


def relay_batch(publish: Callable[[DataFrame], DataFrame], acknowledge: Callable[[DataFrame], None], reject: Callable[[DataFrame], None] | None = None, relay_topic: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: destination first, acknowledgements of the confirmed rows after.

    ``publish`` writes deliveries and returns them with a ``confirmed`` column. A crash between
    the two writes replays the batch, which is the at-least-once window.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        kept = save(batch, "relay-batch")  # read twice; a recomputed source must not differ
        try:
            out = forward(kept, relay_topic)
            status = save(publish(out.deliveries), "relay-status")
            acknowledge(acks_of(status.where("confirmed")))
            if reject is not None:
                reject(out.rejects)
            drop(status)
            drop(out.decoded)
        finally:
            drop(kept)

    return one
