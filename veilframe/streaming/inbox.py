"""Inbox as a stream: files are rewritten as they arrive, each subject's vault kept as state.

Within a micro-batch a subject's documents are taken in order of seq; across batches, in order of arrival. So a replay
equals the batch result if files arrive in seq order for each subject.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import egress
from ..operators.deid import Detector, Rewriter

SCHEMA = "subject string, seq long, doc_id long, text string"
OUT = "subject string, seq long, doc_id long, text string, n_tokens int, new_tokens string"


def inbox(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines of (subject, seq, doc_id, text) dropped into a folder; the checkpoint remembers which files are done."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def rewritten(stream: DataFrame, *, today: datetime.date, detector: Detector | None = None, strict: bool = False) -> DataFrame:
    """The stream de-identified; the state of a subject is its vault, as JSON."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter(json.loads(state.get[0]) if state.exists else (), today=today, detector=detector, strict=strict)
        frame = pd.concat(list(frames)).sort_values(["seq", "doc_id"])
        rows = []
        for seq, doc, text in zip(frame.seq, frame.doc_id, frame.text):
            before = len(rewriter.vault.entries)
            made = rewriter.rewrite(text)["text"]
            rows.append((key[0], seq, doc, made, len(rewriter.vault.entries), json.dumps(list(rewriter.vault.entries.items())[before:], ensure_ascii=False)))
        state.update((json.dumps(list(rewriter.vault.entries.items()), ensure_ascii=False),))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])

    return stream.groupBy("subject").applyInPandasWithState(step, OUT, "vault string", "append", "NoTimeout")


def guarded(queries: DataFrame, column: str = "query") -> DataFrame:
    """A stream of outgoing queries with its verdict; stateless."""
    return queries.withColumn("verdict", egress.verdict(F.col(column)))
