"""Score documents as they arrive (M5 on Structured Streaming).

Each micro-batch is cleaned, tokenised and scored with a model fitted in batch
(its parameters are static), then appended to a sink.  ``foreachBatch`` keeps
the batch operators unchanged and makes the sink write idempotent per batch id.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from petrel.operators import models as M
from petrel.operators import tokens as T


def score_stream(docs: DataFrame, model: M.NBModel, stop: Iterable[str], out_path: str,
                 checkpoint: str, text: str = "text", key: str = "doc_id",
                 trigger_once: bool = True) -> StreamingQuery:
    stop = list(stop)

    def run(batch: DataFrame, batch_id: int) -> None:
        toks = T.corpus_tokens(batch.select(key, text), text=text, stop=stop, key=key)
        pred = M.nb_score(model, toks, key=key)
        pred.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    w = docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
