"""Structured Streaming: questions that arrive are answered against a corpus that stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspan.config import Settings
from quillspan.plans.ask import ask


def sentences_of_stream(docs: DataFrame) -> DataFrame:
    """Stripped sentences of a stream of documents(doc_id, text): a map over rows, so it needs no state."""
    from pyspark.sql import functions as F

    from quillspan.functions.text import SENTENCE_END, strip

    return docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", SENTENCE_END), strip), lambda s: F.length(s) > Settings.min_sentence)).alias("sent_idx", "sent"))


def answer_stream(questions: DataFrame, docs: DataFrame, out: str, checkpoint: str, cfg: Settings = Settings()) -> StreamingQuery:
    """Answer a stream of questions(q_id, question) in micro-batches, each written to its own folder, so a batch that is run again replaces itself."""

    def batch(rows: DataFrame, nth: int) -> None:
        ask(docs, rows, cfg).write.mode("overwrite").parquet(f"{out}/batch={nth}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


