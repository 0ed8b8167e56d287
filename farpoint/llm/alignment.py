"""Alignment of two tokenizers over a corpus, each distinct text tokenised and aligned once.

Documents are shuffled by their full text, so equal texts meet and count once with a multiplicity. Texts are then cut
into blocks of some MB. A block keeps its distinct words, the id pairs that these link and how often each text holds
each word; so the corpus-wide counts of pairs are sums over blocks, a block gets back only the counts of the
pairs that it holds, and the measures of a text are sums over its words. No table of pairs or words is sent to all tasks.

Both tokenizers cut before a space that follows a visible character and never join over it, so a text's tokens and
groups are those of its words, one after the other. The tests compare this with encoding whole texts.

NULL and empty texts have no tokens, nor do texts that a tokenizer does not give back byte by byte: their measures are
zero and their digest is ''. Texts may be of any length; repeated rows and ids each get a row of their own; a NULL id
is kept. An empty table gives an empty result. Columns other than the id and the text are left out, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.tokens import tokenizer_path
from farpoint.session import materialize

# Bytes of text that share a table of words and pairs.
BLOCK_BYTES = 8 << 20
# Words that a task remembers beside those of its block, some hundred bytes each.
REMEMBERED = 250_000
# Longer words are aligned where they occur and not remembered.
LONG_WORD = 64
# Rows of one text are dealt over this many keys when its measures go back to the documents (bits of a long).
SALTS = 64

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_SPACED = re.compile(r"\s ")


def _byte_symbols() -> dict[str, int]:
    """Bytes behind the symbols of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def words_of(text: str) -> list[str]:
    """``text`` cut at spaces where both tokenizers cut; a word stands for itself after one space."""
    parts = text.split(" ")
    if not parts[-1] and len(parts) > 1:  # a space at the end is no word of its own
        parts[-2:] = [parts[-2] + " "]
    if not _SPACED.search(" " + text[:-1]):
        return parts
    words: list[str] = []
    for part in parts:
        if words and (not words[-1] or words[-1][-1].isspace()):
            words[-1] += " " + part
        else:
            words.append(part)
    return words


class WordAligner:
    """Token counts, groups and linked id pairs of words, remembered up to a bound."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = _byte_symbols()
        self.bytes_a = {
            i: bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
            for entry, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if any("▁" in p[1:] and p.strip("▁") for _, p in pieces):
            raise ValueError("pieces of the second tokenizer join over spaces")
        self.bytes_b = {
            i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces
        }
        self.known: dict[str, tuple] = {}

    def align(self, words: list[str]) -> list[tuple]:
        """Per word: tokens of both sides, groups, the groups as text (None if bytes differ), pairs of its links."""
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        found: dict[str, tuple] = {}
        for start in range(0, len(missing), 2000):
            some = missing[start : start + 2000]
            ids_a = self.a.encode_batch([" " + w for w in some], add_special_tokens=False)
            ids_b = self.b.encode(some, num_threads=1)
            found.update((w, self._word(w, x.ids, y)) for w, x, y in zip(some, ids_a, ids_b))
        self.known.update((w, v) for w, v in found.items() if len(w) <= LONG_WORD)
        return [self.known[w] if w in self.known else found[w] for w in words]

    def _word(self, word: str, ids_a: list[int], ids_b: list[int]) -> tuple:
        raw = (" " + word).encode()
        left, right = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(left) != raw or b"".join(right) != raw:
            return 0, 0, 0, None, b""
        ends_a, ends_b = list(itertools.accumulate(map(len, left))), list(itertools.accumulate(map(len, right)))
        groups, links = [], array("q")
        i = j = first_a = first_b = 0
        while i < len(ids_a):
            links.append(ids_a[i] << 32 | ids_b[j])
            until_a, until_b = ends_a[i], ends_b[j]
            if until_a < until_b:
                i += 1
            elif until_b < until_a:
                j += 1
            else:
                i, j = i + 1, j + 1
                if i - first_a == 1 == j - first_b:
                    groups.append(f"{ids_a[first_a]}|{ids_b[first_b]}")
                else:
                    groups.append(f"{','.join(map(str, ids_a[first_a:i]))}|{','.join(map(str, ids_b[first_b:j]))}")
                first_a, first_b = i, j
        return len(ids_a), len(ids_b), len(groups), ";".join(groups), links.tobytes()


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> WordAligner:
    """The aligner of this process."""
    return WordAligner(path_a, path_b)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK = pa.schema(
    [("block", pa.int64()), ("keys", pa.list_(pa.binary())), ("salts", _LONGS), ("counts", pa.list_(_LONGS)), ("digests", pa.list_(pa.string()))]
    # Words of each text with their number, pairs of each word; *_end say where a text's or a word's part ends.
    + [(c, _INTS) for c in ("words", "times", "words_end", "links", "links_end")]
    + [("pairs", _LONGS), ("weights", _LONGS)]
)
_BLOCK_DDL = (
    "block long, keys array<binary>, salts array<long>, counts array<array<long>>, digests array<string>, words array<int>, "
    "times array<int>, words_end array<int>, links array<int>, links_end array<int>, pairs array<long>, weights array<long>"
)


def _align_block(number: int, rows: list[tuple], words: WordAligner) -> pa.RecordBatch:
    """One row for a block of distinct texts: (key, salts, multiplicity, text)."""
    numbers: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    held = [np.fromiter(map(numbers.__getitem__, words_of(text)), dtype="int64") for *_, text in rows]
    entries = words.align(list(numbers))
    sizes = np.array([(e[0], e[1], e[2], len(e[4]) // 8) for e in entries], dtype="int64").reshape(-1, 4)
    shown = [e[3] for e in entries]
    broken = np.array([g is None for g in shown])
    pairs, links = np.unique(np.frombuffer(b"".join(e[4] for e in entries), dtype="<i8"), return_inverse=True)
    weights = np.zeros(len(entries), dtype="int64")
    counts, digests, parts, times, ends = [], [], [], [], []
    for (_, _, copies, text), ids in zip(rows, held):
        if not text or broken[ids].any():
            counts.append([0, 0, 0, 0])
            digests.append("")
            ids = ids[:0]
        else:
            counts.append(sizes[ids].sum(axis=0).tolist())
            digests.append(hashlib.sha256(";".join(map(shown.__getitem__, ids.tolist())).encode()).hexdigest())
        distinct, number_of = np.unique(ids, return_counts=True)
        weights[distinct] += copies * number_of
        parts.append(distinct)
        times.append(number_of)
        ends.append(len(distinct))
    join = lambda arrays: np.concatenate(arrays).astype("int32")
    per_pair = np.zeros(len(pairs), dtype="int64")
    np.add.at(per_pair, links, np.repeat(weights, sizes[:, 3]))
    columns = [
        [number], [[r[0] for r in rows]], [[r[1] for r in rows]], [counts], [digests], [join(parts)], [join(times)],
        [np.cumsum(ends, dtype="int32")], [links.astype("int32")], [np.cumsum(sizes[:, 3]).astype("int32")], [pairs], [per_pair],
    ]
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)


def _blocks(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        words, rows, size = aligner(path_a, path_b), [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                key, salts, copies, text = (column[row].as_py() for column in batch.columns)
                rows.append((key, salts, copies, text))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield _align_block(next(numbers), rows, words)
                    rows, size = [], 0
        if rows:
            yield _align_block(next(numbers), rows, words)

    return texts.mapInArrow(run, _BLOCK_DDL)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts, which may be empty."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            values = {n: batch.column(n)[row] for n in batch.schema.names}
            column = lambda n: values[n].values.to_numpy(zero_copy_only=False) if values[n].is_valid else np.zeros(0, dtype="int64")
            links, links_end, words_end = (column(n) for n in ("links", "links_end", "words_end"))
            sums = []
            for name in ("best", "n"):
                per_word = _sums(column(name)[links], links_end)
                sums.append(_sums(per_word[column("words")] * column("times"), words_end))
            counts = np.array(values["counts"].as_py(), dtype="int64").reshape(-1, 4)
            yield pa.record_batch(
                [values["keys"].values, values["salts"].values, *[pa.array(c) for c in (*counts.T, *sums)], values["digests"].values],
                names=["_key", "_salts", *MEASURES, "groups_sha256"],
            )


def align_documents(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokens of both tokenizers, groups, links and link counts per document, and a digest of its groups.

    ``path_a`` is a byte-level vocabulary of ``tokenizers`` (default byte_bpe_50k.json), ``path_b`` a model of ``sentencepiece``
    (default piece_bpe_32k.model). The count of an id pair is the number of links that hold it in all documents;
    ``n_best`` counts the links whose pair has the largest count of its second id, ties included.
    """
    path_a = path_a or tokenizer_path("byte_bpe_50k.json")
    path_b = path_b or tokenizer_path("piece_bpe_32k.model")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias(id_column), whole.alias("_text"), F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(SALTS)).cast("int").alias("_salt")
    )
    key = F.unhex(F.sha2("_text", 256))
    texts = rows.groupBy("_text").agg(
        F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("salts"), F.count("*").alias("copies")
    )
    blocks = materialize(_blocks(texts.select(key.alias("key"), "salts", "copies", "_text"), path_a, path_b), "aligned")

    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "weights")).alias("i", "p"))
    held = held.select("block", "i", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("w"))
    counts = materialize(held.groupBy("pair").agg(F.sum("w").alias("n")), "pair_counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # One row per id of the second tokenizer.
    tops = counts.groupBy(second.alias("b")).agg(F.max("n").alias("top"))
    judged = counts.withColumn("b", second).join(F.broadcast(tops), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    per_block = held.join(judged, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "n", "best"))).alias("v"))
    values = per_block.select("block", F.col("v.n").alias("n"), F.col("v.best").alias("best"))
    ddl = "_key binary, _salts long, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string"
    measured = blocks.drop("pairs", "weights").join(values, "block", "left").mapInArrow(_measures, ddl)

    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("_salts", s) == 1)
    spread = measured.withColumn("_salt", F.explode(salts)).drop("_salts")
    narrow = rows.select(id_column, key.alias("_key"), "_salt")
    return narrow.join(spread, ["_key", "_salt"]).select(id_column, *MEASURES, "groups_sha256")
