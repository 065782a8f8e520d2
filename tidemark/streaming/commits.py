"""Ordered, exactly-once commits of daily snapshots per account, as a keyed stateful stream.

A snapshot is applied if its session follows the last applied one; the same content again is a duplicate without effect;
changed content for an applied session, sessions out of order and gaps are rejected. The state holds the last session
and the digests of the last KEPT applied ones, so replays after a failure give the same account; anything older is out of
order, whatever it holds. Accounts share BUCKETS states by hash, as a call of Python for each account costs more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sessions back from the last one of which an account keeps the digest.
KEPT = 500
#: Groups of accounts; fixed, since a stream's stored state goes by them.
BUCKETS = 4_096
#: Bytes of a digest.
WIDTH = 32
OUT = "account string, session_idx int, digest binary, status string, reason string, balance double"
#: An account's applied sessions follow each other, so their digests are one string of bytes that ends with the last one's.
STATE = "accounts array<string>, lasts array<int>, digests array<binary>, balances array<double>"


def decide(last: int | None, digests: bytes, session: int, digest: bytes) -> tuple[str, str]:
    if last is None or session == last + 1:
        return "applied", ""
    at = len(digests) - WIDTH * (last - session + 1)
    if session <= last and at >= 0:
        return ("duplicate", "") if digests[at : at + WIDTH] == digest else ("rejected", "changed content")
    return "rejected", "gap" if session > last else "out of order"


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {account: rest for account, *rest in zip(*state.get)} if state.exists else {}
    pieces = (zip(*[frame[c].tolist() for c in ("account", "session_idx", "digest", "amount")]) for frame in frames)  # cut where an Arrow batch is full, in no order
    snapshots = sorted(chain.from_iterable(pieces))
    made = []
    for account, session, digest, amount in snapshots:
        last, digests, balance = held.get(account, (None, b"", 0.0))
        status, reason = decide(last, digests, session, digest)
        if status == "applied":
            balance += amount
            held[account] = session, (bytes(digests) + digest)[-KEPT * WIDTH :], balance
        made.append((status, reason, balance))
    accounts, sessions, contents, _ = zip(*snapshots)
    statuses, reasons, balances = zip(*made)
    yield pd.DataFrame({"account": accounts, "session_idx": sessions, "digest": contents, "status": statuses, "reason": reasons, "balance": balances})
    state.update((list(held), *([account[i] for account in held.values()] for i in range(3))))


def commits(snapshots: DataFrame) -> DataFrame:
    """A stream of (account, session_idx, amount, payload) to commit decisions."""
    rows = snapshots.where("account IS NOT NULL AND session_idx IS NOT NULL")
    rows = rows.select("account", F.col("session_idx").cast("int").alias("session_idx"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.unhex(F.sha2(F.to_json(F.struct("session_idx", "amount", "payload")), 256)).alias("digest"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("account"), F.lit(BUCKETS)).cast("int"))
    made = rows.groupBy("bucket").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return made.withColumn("digest", F.lower(F.hex("digest")))


def contiguous(snapshots: DataFrame) -> DataFrame:
    """The batch check: per account the sessions, the gaps between them and contents that differ for one session."""
    per = snapshots.groupBy("account", "session_idx").agg(F.countDistinct("payload").alias("_versions"))
    return per.groupBy("account").agg(F.count(F.lit(1)).alias("sessions"), (F.max("session_idx") - F.min("session_idx") + 1 - F.count(F.lit(1))).alias("gaps"), F.count_if(F.col("_versions") > 1).alias("changed"))
