"""Sources: tables, files as bytes, evaluation sets; and the derived fixtures of word boxes and logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.config import TOO_LARGE, Settings
from quillspan.functions.text import SPACE, let
from quillspan.operators.pages import Boxes, Words
from quillspan.operators.reading import Logits, Reader

WORD_BOXES = "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, word string"
EVAL_SET = "paper_path string, question string, gold_answer string, gold_page int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, cfg: Settings = Settings()) -> DataFrame:
    """doc_id (hash of the content), path, length, content, error of files; equal contents come once, under their first path.

    Files that are too large have an error and no content: their bytes are never read, and the hash of
    path and length stands for that of the content.  Only hashes are shuffled to find copies.
    """
    found = spark.read.format("binaryFile").load(path)
    small = found.filter(F.col("length") <= cfg.max_bytes).withColumn("doc_id", F.sha2("content", 256))
    first = small.groupBy("doc_id").agg(F.min("path").alias("path"))
    kept = small.join(first, ["doc_id", "path"], "left_semi").select("doc_id", "path", "length", "content", F.lit(None).cast("string").alias("error"))
    large = found.filter(F.col("length") > cfg.max_bytes).select(
        F.sha2(F.concat_ws(" ", "path", F.col("length").cast("string")).cast("binary"), 256).alias("doc_id"), "path", "length", F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("error")
    )
    return kept.unionByName(large)


def plain_texts(contents: DataFrame, parser: Callable[[bytes, int], Iterator[str]], cfg: Settings = Settings()) -> DataFrame:
    """doc_id, text of files(doc_id, content) without layout: parser(content, max_pages) yields the text of each page.

    The first pages that have any text are joined by spaces; a file that the parser cannot read has an empty text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(" ".join(t for t in islice(parser(content, cfg.max_pages), cfg.max_pages) if t))
                except Exception:  # an unreadable document is an empty one
                    texts.append("")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return contents.filter(F.col("content").isNotNull()).select("doc_id", "content").mapInPandas(run, "doc_id string, text string")


def word_boxes(contents: DataFrame, parser: Callable[[bytes, int], Iterator[tuple]], cfg: Settings = Settings()) -> DataFrame:
    """Word boxes of files(doc_id, content) by a plug-in: parser(content, max_pages) yields (page, x0, y0, x1, y1, word).

    A file that the parser cannot read has no words; it never fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows = [(doc_id, page, i, x0, y0, x1, y1, word) for i, (page, x0, y0, x1, y1, word) in enumerate(parser(content, cfg.max_pages)) if page < cfg.max_pages]
                except Exception:  # an unreadable document is an empty one
                    rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "page", "seq", "x0", "y0", "x1", "y1", "word"])

    return contents.filter(F.col("content").isNotNull()).select("doc_id", "content").mapInPandas(run, WORD_BOXES)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list; anything else fails."""
    return spark.read.schema(EVAL_SET).option("mode", "FAILFAST").json(path, multiLine=True)


def resolve_paths(items: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """items(paper_path) with resolved: the first root under which listing(path) has the file, else the path as it is."""
    tried = items.select("paper_path").distinct().select("paper_path", F.posexplode(F.array(*(F.concat(F.lit(r.rstrip("/") + "/"), "paper_path") for r in roots))).alias("nth", "path"))
    found = tried.join(listing.select("path").distinct(), "path").groupBy("paper_path").agg(F.min_by("path", "nth").alias("hit"))
    return items.join(found, "paper_path", "left").withColumn("resolved", F.coalesce("hit", "paper_path")).drop("hit")


def write_json(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """Keys and the other columns as one JSON string, nulls kept."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}).alias("response"))


def derived_words(docs: DataFrame, per_page: int = 300, per_row: int = 10) -> DataFrame:
    """Word boxes laid out from texts: rows of ten words; odd documents have two columns, and rows are slightly uneven."""
    words = docs.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), lambda w: w != "")).alias("seq", "word"))
    page, i = F.floor(F.col("seq") / per_page).cast("int"), F.col("seq") % per_page
    two = F.col("doc_id") % 2 == 1
    half = per_row // 2
    side, k = F.floor(i / (per_page // 2)), i % (per_page // 2)
    col = F.when(two, k % half + side * half).otherwise(i % per_row)
    row = F.when(two, F.floor(k / half)).otherwise(F.floor(i / per_row))
    x0 = col * 30.0 + F.when(two, side * 60.0).otherwise(0.0)
    y0 = row * 14.0 + (F.col("seq") % 3) * 0.5
    return words.select("doc_id", page.alias("page"), "seq", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 25.0).cast("double").alias("x1"), (y0 + 10.0).cast("double").alias("y1"), "word")


def derived_word_rows(docs: pa.RecordBatch, per_page: int = 300, per_row: int = 10) -> Words:
    """``derived_words`` of a batch of documents (doc_id, text)."""
    # white space is that of SPACE
    held = [(t or "").split() for t in docs.column("text").to_pylist()]
    count = np.fromiter(map(len, held), np.int64, len(held))
    doc = np.repeat(np.arange(len(held)), count)
    seq = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    two, half = (np.fmod(docs.column("doc_id").to_numpy(), 2) == 1)[doc], per_row // 2
    i = seq % per_page
    side, k = i // (per_page // 2), i % (per_page // 2)
    col, row = np.where(two, k % half + side * half, i % per_row), np.where(two, k // half, i // per_row)
    x0, y0 = col * 30.0 + np.where(two, side * 60.0, 0.0), row * 14.0 + seq % 3 * 0.5
    return Words(doc, seq // per_page, seq, x0, y0, x0 + 25.0, y0 + 10.0, list(chain.from_iterable(held)))


def derived_boxes(docs: DataFrame) -> Boxes:
    """The derived word boxes of documents (doc_id long, text), read where a document lies."""
    return Boxes(docs.select("doc_id", "text"), derived_words, derived_word_rows)


def paged_words(docs: DataFrame, per_page: int = 300) -> DataFrame:
    """doc_id, ord, page, word of texts cut into pages of as many words."""
    words = docs.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), lambda w: w != "")).alias("ord", "word"))
    return words.select("doc_id", "ord", F.floor(F.col("ord") / per_page).cast("int").alias("page"), "word")


def joined_text(words: DataFrame) -> DataFrame:
    held = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("ws"))
    return held.select("doc_id", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("text"))


def derived_logits(contexts: DataFrame, width: int = 7, before: int = 6) -> DataFrame:
    """Logits from ids alone, as multiples of 1/8, for the whole of each context(doc_id, q_id, context).

    Tokens are ``width`` characters long, after ``before`` tokens of the question and before a closing one.
    A start and an end stand out, up to 39 tokens apart; the end may lie beyond the context.
    """
    seed = F.col("doc_id") * 31 + F.col("q_id") * 17
    noise = lambda i, a, b: (F.pmod(seed * a + i.cast("long") * (i + b) * 7, F.lit(64)) - 40) / 8.0

    def model(m: Column) -> Column:
        at = F.sequence(F.lit(0), m["n"] - 1)
        logit = lambda a, b, top: F.transform(at, lambda i: (noise(i, a, b) + F.when(i == top, 16.0).otherwise(0.0)).cast("float"))
        place = lambda i: F.least(F.greatest((i - before) * width, F.lit(0)), m["size"])
        return F.struct(
            logit(3, 5, m["peak"]).alias("start_logits"), logit(5, 11, m["peak"] + F.pmod(seed, F.lit(40))).alias("end_logits"),
            F.transform(at, lambda i: F.when((i >= before) & (i < m["n"] - 1), 1).otherwise(0)).alias("seq_ids"),
            F.transform(at, lambda i: F.struct(place(i).alias("s"), place(i + 1).alias("e"))).alias("offsets"),
        )

    # lengths are counted once a context, not once a token
    n = lambda size: before + F.ceil(size / width).cast("int") + 1
    peak = lambda size: before + F.pmod(seed * 7, (n(size) - before - 1).cast("long"))
    sized = lambda size: F.struct(size.alias("size"), n(size).alias("n"), peak(size).alias("peak"))
    made = let(let(F.length("context"), sized), model)
    return contexts.filter(F.length("context") > 0).withColumn("m", made).select("doc_id", "q_id", "context", "m.*")


def derived_logit_rows(doc_ids: np.ndarray, q_ids: np.ndarray, contexts: list[str], width: int = 7, before: int = 6) -> Logits:
    """``derived_logits`` of a batch of contexts."""
    seed = doc_ids.astype(np.int64) * 31 + q_ids.astype(np.int64) * 17
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n = before - -size // width + 1
    peak = before + np.mod(seed * 7, np.maximum(n - before - 1, 1))
    at = np.arange(n.max())

    def logit(a: int, b: int, top: np.ndarray) -> np.ndarray:
        # modulo 64, so eight bits are enough
        noise = (seed * a & 63).astype(np.uint8)[:, None] + (at * (at + b) * 7 & 63).astype(np.uint8)
        noise &= 63
        made = np.multiply(noise.view(np.int8) - np.int8(40), np.float32(1 / 8), dtype=np.float32)
        real = np.flatnonzero(top < n)
        made[real, top[real]] += 16
        for k in np.unique(n[n < len(at)]):
            made[n == k, k:] = -np.inf
        return made

    def places(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip((token + more - before) * width, 0, size[row]) for more in (0, 1))

    return Logits(logit(3, 5, peak), logit(5, 11, peak + np.mod(seed, 40)), np.full(len(n), before), n - 2, places)


#: The derived logits as a reader.
DERIVED = Reader(derived_logits, derived_logit_rows)


def derived_rerank_scores(windows: DataFrame, questions: DataFrame) -> DataFrame:
    """Reranker scores of every window(doc_id, win_id) for every question, as multiples of 1/4, with ties, exact margins and low tops."""
    rows = windows.select("doc_id", "win_id").crossJoin(questions.select("q_id")).select("doc_id", "q_id", "win_id")
    return rows.withColumn("score", (F.pmod(F.col("doc_id") * 13 + F.col("q_id") * 7 + F.col("win_id") * F.col("win_id") * 5, F.lit(23)) / 4.0 - F.pmod(F.col("doc_id"), F.lit(4)) * 3).cast("float"))


def neighbours(sentences: DataFrame) -> DataFrame:
    """Pairs of adjoining sentences as gold and predicted answers, with some cases that are equal, empty, repeated or missing."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    rows = sentences.select("doc_id", "sent_idx", F.col("sent").alias("gold_answer"), F.lead("sent").over(order).alias("following"))
    kind = F.pmod(F.col("doc_id") + F.col("sent_idx"), F.lit(6))
    pred = (
        F.when(kind == 0, F.col("gold_answer")).when(kind == 1, F.lit("")).when(kind == 2, F.concat_ws(" ", "following", "following"))
        .when(kind == 3, F.concat(F.lit("  "), F.replace("gold_answer", F.lit("e"), F.lit("E")), F.lit(" ..."))).when(kind == 4, F.lit("?!")).otherwise(F.concat_ws(" ", F.substring("gold_answer", 1, 40), F.col("following")))
    )
    error = F.when(F.pmod(F.col("doc_id") * 7 + F.col("sent_idx"), F.lit(11)) == 0, F.lit("File not found"))
    return rows.select("doc_id", "sent_idx", "gold_answer", pred.alias("predicted_answer"), F.concat_ws(" ", "gold_answer", "following").alias("context"), error.alias("error"))
