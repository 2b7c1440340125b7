"""Taking in a stream with keyed state: who owns which bytes, and what each session has, whatever the order in which candidates come.

The state of a hash is its owner, the least (seq, candidate) that may be stored, and the candidates seen with their last status. A candidate that comes
with a smaller seq than the owner takes its place, and the former owner is said to be a duplicate from then on. What comes out are changes: each
candidate's status with a step that grows, and its former status, so that sums over changes are counters at any time and the last step of a candidate
is its status. A candidate that comes again changes nothing. State that nobody has touched for `keep` is forgotten: what comes after is new.

State is Spark's, in its RocksDB store under the query's checkpoint: a restart goes on where the last micro-batch ended. Rows of one hash in one
micro-batch meet in one task; file_stream's most_files bounds a micro-batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verbena.session import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fields(texts: str, numbers: str = "") -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType() if n in numbers.split() else T.StringType()) for n in texts.split()])


CHANGE = _fields("sha256 candidate_id session_id step status was", "step")
_OWNER, _SEEN, _KEY = _fields("seq candidate_id step", "seq step"), _fields("session_id status own"), _fields("candidate_id")


def own_status(score, review_at: int = 30, confirmed_at: int = 70):  # noqa: ANN001, ANN201
    """What a candidate is if its bytes are its own."""
    return F.when(score < review_at, "rejected").when(score < confirmed_at, "uncertain_review").otherwise("stored")


class Owners(StatefulProcessor):
    """Rows (sha256, candidate_id, session_id, seq, own: own_status()) to CHANGE rows."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", _OWNER, self.keep_ms)
        self.seen = handle.getMapState("seen", _KEY, _SEEN, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.owner.get() if self.owner.exists() else None
        seq, owner, step = held if held is not None else (None, None, 0)
        out = []

        def change(candidate: str, session: str, status: str, own: str, was: str | None) -> None:
            nonlocal step
            step += 1
            self.seen.updateValue((candidate,), (session, status, own))
            out.append(Row(sha256=key[0], candidate_id=candidate, session_id=session, step=step, status=status, was=was))

        # in order within a micro-batch, so that the owner changes as seldom as may be
        for r in sorted(rows, key=lambda r: (r.seq, r.candidate_id)):
            if self.seen.containsKey((r.candidate_id,)):
                continue
            if r.own == "rejected":
                change(r.candidate_id, r.session_id, "rejected", r.own, None)
            elif owner is None or (r.seq, r.candidate_id) < (seq, owner):
                if owner is not None:
                    session, status, own = self.seen.getValue((owner,))
                    change(owner, session, "duplicate_linked", own, status)
                seq, owner = r.seq, r.candidate_id
                change(r.candidate_id, r.session_id, r.own, r.own, None)
            else:
                change(r.candidate_id, r.session_id, "duplicate_linked", r.own, None)
        if step != (held[2] if held is not None else 0):
            self.owner.update((seq, owner, step))
        yield from out

    def close(self) -> None:
        pass


def changes(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """CHANGE rows of a stream with sha256, candidate_id, session_id, seq and own (see own_status). Rows without a hash have no bytes and are left out."""
    spark = stream.sparkSession
    ship(spark)
    # Spark starts a worker on the driver, too, which has no files sent to executors: the processor goes to it whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.where("sha256 IS NOT NULL").select("sha256", "candidate_id", "session_id", F.col("seq").cast("long").alias("seq"), "own")
    return rows.groupBy("sha256").transformWithState(Owners(keep_ms), CHANGE, "append", "processingTime" if keep_ms else "none")


def statuses(rows: DataFrame) -> DataFrame:
    """candidate_id, session_id, sha256, status: where each candidate stands after all changes so far."""
    return rows.groupBy("candidate_id").agg(F.max_by(F.struct("session_id", "sha256", "status"), "step").alias("last")).select("candidate_id", "last.*")


def counters(rows: DataFrame) -> DataFrame:
    """session_id, status, n: sums over changes, which need not be read again for what is counted already."""
    gain = rows.select("session_id", F.explode(F.array(F.struct("status", F.lit(1).alias("d")), F.struct(F.col("was").alias("status"), F.lit(-1).alias("d")))).alias("x"))
    return gain.where("x.status IS NOT NULL").groupBy("session_id", "x.status").agg(F.sum("x.d").alias("n")).where("n <> 0")


def run(spark: SparkSession, stream: DataFrame, place: str, keep_ms: int | None = None) -> DataFrame:
    """What is there now of a stream through keyed state; all changes so far, under place. Running it again goes on from its checkpoint."""
    from verbena.streaming.flows import drain

    return drain(changes(stream, keep_ms), place)
