"""Problem 7: the corpus encoded with a public byte-level BPE.

Method: a global distinct-word shuffle. Texts are split once into pre-tokens with positions, which are written; each
distinct pre-token is encoded once, its ids are joined back by the word, and a text's pieces meet under its row number
and are put together by position. Pre-tokens that hold HEAVY of a bounded hashed sample of the documents are encoded on
the driver (at most 1 / HEAVY of them) and filled in where the text is split, so that the join has no hot key; the
sample decides where a word is encoded, never how. Runs of such words are one piece. Decoding joins ids with the table
of token bytes.

Null and empty texts both have the empty list. Strings of special tokens are ordinary text. Rows that repeat an id
come out as often as they came in, each with the ids of its text. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.plans.scratch import stage_partitions, table

VOCABULARY = os.environ.get("AMPLIQ_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HEAVY = 0.0005
SAMPLE = 4_000
_PIECES = "row bigint, doc bigint, pos int, word string, word_ids array<int>"


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file, one for each worker process."""
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def piece_encoder(path: str):
    """Merges one pre-token; a pre-token given alone is never split again by the pattern."""
    return encoding(path).encode_ordinary


@functools.lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def _split(heavy: dict[str, list[int]]):
    """The pieces of every text: a word that is still to be encoded, or the ids of heavy words that follow one another.

    A text has a piece without ids at position -1, which brings its id and lets an empty text come out.
    """

    def run(batches):
        find, known = splitter().findall, heavy.get
        for batch in batches:
            row, doc, pos, word, flat, ends = [], [], [], [], [], []
            for r, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row.append(r)
                doc.append(d)
                pos.append(-1)
                word.append(None)
                ends.append(len(flat))
                if not text:
                    continue
                at = len(row)
                opened = False
                for k, w in enumerate(find(text)):
                    got = known(w)
                    if got is None:
                        pos.append(k)
                        word.append(w)
                        ends.append(len(flat))
                        opened = False
                    else:
                        flat += got
                        if opened:
                            ends[-1] = len(flat)
                        else:
                            pos.append(k)
                            word.append(None)
                            ends.append(len(flat))
                            opened = True
                n = len(pos) - at
                row += [r] * n
                doc += [None] * n
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(word, pa.string()), lists], names=["row", "doc", "pos", "word", "word_ids"])

    return run


def _assemble(batches):
    """Pieces sorted by row and position to (doc, ids); a row's ids are its pieces' ids, which already lie in order."""
    held: list[pa.RecordBatch] = []  # the last row's pieces, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        row = batch.column(0).to_numpy()
        if held and row[-1] == held[0].column(0)[0].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(row, row[-1], "left"))
        yield _texts(pa.Table.from_batches([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield _texts(pa.Table.from_batches(held))


def _texts(part: pa.Table) -> pa.RecordBatch:
    row = part.column(0).to_numpy()
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    lists = part.column(2).combine_chunks()
    ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    ids = pa.ListArray.from_arrays(pa.array(ends[np.append(start, len(row))], pa.int32()), lists.flatten())
    return pa.RecordBatch.from_arrays([part.column(1).combine_chunks().take(pa.array(start)), ids], names=["doc", "ids"])


def _encode(path: str):
    def run(batches):
        one = piece_encoder(path)
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([one(w) for w in words.to_pylist()], pa.list_(pa.int32()))], names=["word", "word_ids"])

    return run


def heavy_words(texts: DataFrame, path: str) -> dict[str, list[int]]:
    """Pre-tokens in at least HEAVY of about SAMPLE documents' pre-tokens, with their ids."""
    n = texts.count()
    step = max(1, n // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(step)) == 0) if step > 1 else texts

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                total.update(splitter().findall(text or ""))
        every = sum(total.values())
        kept = [(w, c) for w, c in total.items() if c >= HEAVY / 4 * every] + [(None, every)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["word", "n"])

    got = {r["word"]: r["n"] for r in some.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    every = got.pop(None, 0)
    one = piece_encoder(path)
    return {w: one(w) for w, c in got.items() if c >= max(2, HEAVY * every) and len(w) <= 64}


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    heavy = heavy_words(texts, vocabulary)
    split = table(texts.select(F.monotonically_increasing_id().alias("row"), "doc", "text").mapInArrow(_split(heavy), _PIECES), "pieces")
    light = split.filter("word is not null").select("row", "pos", "word")
    words = light.select("word").distinct().mapInArrow(_encode(vocabulary), "word string, word_ids array<int>")
    none = F.lit(None).cast("bigint").alias("doc")
    found = light.join(words.hint("shuffle_merge"), "word").select("row", "pos", none, "word_ids")
    pieces = split.filter("word is null").select("row", "pos", "doc", "word_ids").unionByName(found)
    whole = pieces.repartition(stage_partitions(spark), "row").sortWithinPartitions("row", "pos").select("row", "doc", "word_ids")
    return whole.mapInArrow(_assemble, "doc bigint, ids array<int>").select(F.col("doc").alias(key), "ids")


def token_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, bytes) of every token: as many rows as the vocabulary, whatever the corpus."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(vocabulary).items()], "id int, bytes binary")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of rows of ids with distinct keys; the empty list is the empty text."""
    table = F.broadcast(token_table(df.sparkSession, vocabulary))  # 50,256 rows, fixed by the vocabulary
    apart = df.select(F.col(key), F.posexplode_outer(ids).alias("pos", "id")).join(table, "id", "left")
    one = apart.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("hex"))))).alias("parts"))
    return one.select(key, F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8").alias("text"))


def _sizes(path: str):
    def run(batches):
        one, find = piece_encoder(path), splitter().findall
        size: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n = 0
                for word in find(text or ""):
                    k = size.get(word)
                    if k is None:
                        k = len(one(word))
                        if len(size) < 200_000:
                            size[word] = k
                    n += k
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def token_sizes(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of keep, and tokens: the number of ids of the text. No shuffle."""
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    return source.mapInArrow(_sizes(vocabulary), f"{fields}, tokens bigint")
