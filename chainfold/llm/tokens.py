"""Token-ID output: documents as ids in binary shards under a Re-Pair grammar.

Documents are range-partitioned and sorted by id; each partition writes shards of about SHARD_TOKENS
ids, one row of a Parquet file each, through Spark's own committer, so a lost executor or a second
attempt leaves neither gaps nor copies, and any file system that Spark writes to will do. A row has:

    part, shard      the range partition and the shard's number in it; (part, shard) sorts by doc_id
    doc_ids          the ids of the shard's documents, ascending
    n_tokens         ids in the shard, end ids included
    symbols          little-endian unsigned 32-bit symbols of the compressed sequence
    ends             where each document ends in it (little-endian unsigned 32-bit)
    rules            pairs (left, right) of the nonterminals, numbered from first_rule on
    lengths          the length of each nonterminal's expansion
    first_rule       65536, or the size of a larger vocabulary

A word is encoded once a worker and then looked up: the tokenizer's pre-tokenizer never joins what
white space parts, so the ids of a text are those of its space-separated pieces. The store of pieces
is bounded and emptied when full. Memory is bounded by a shard and by the longest document.

A null or empty text is the end id alone. Repeated ids are separate documents, ordered by a hash of
their text; null ids come first. An empty table gives no shards. Other columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bound_batches, table
from .repair import FIRST_RULE, Grammar, compress

END_ID = 1
SHARD_TOKENS = 1 << 20
PIECES = 800_000
#: Texts that reach a worker at once: more of them repeat more words, and are numbered in less time.
TEXT_BYTES = 8 << 20
_SCHEMA = ("part int, shard int, doc_ids array<long>, n_tokens long, symbols binary, ends binary, rules binary, lengths binary, first_rule int")


#: Letters whose lower case is one such letter, and which are composed as they are.
_SIMPLE = re.compile("[a-zA-Z\u00c0-\u012f\u0131-\u024f]+")
#: A full stop or comma between such a letter, or a digit, and a blank: it is a pre-token of its own.
_MARK = "([0-9a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])([.,]) "
_BARE = 64
_DOCS = 8192


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on; blanks stay."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)} | {32: " "}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, by the tokenizers library and a store of pieces.

    Words of simple letters, nearly all new pieces, go to the library without its normaliser and
    pre-tokenizer, which would leave them as they are; all else goes the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            bare = json.load(file)
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.letters = _byte_letters()
        self.closes = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
        for token, k in self.whole.get_vocab(with_added_tokens=False).items():
            self.closes[k] = token.endswith("</w>")
        self.store: dict[str, bytes] = {}  # the ids of each piece seen
        self.marks = {m: self._whole(m).tobytes() for m in ".,"}

    def _learn_words(self, words: list[str]) -> bool:
        lots = [" ".join(words[k : k + _BARE]).lower().encode().decode("latin-1").translate(self.letters) for k in range(0, len(words), _BARE)]
        ids = np.array([i for e in self.bare.encode_batch_fast(lots, add_special_tokens=False) for i in e.ids], "<u4")
        # each of these words is one pre-token, which ends with the only id that closes a word
        cuts = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            return False
        self.store.update(zip(words, map(ids.tobytes().__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        return True

    def _learn_others(self, pieces: list[str]) -> None:
        made = [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]
        raw = np.array([i for ids in made for i in ids], "<u4").tobytes()
        at = 0
        for piece, ids in zip(pieces, made, strict=True):
            self.store[piece] = raw[at : at + 4 * len(ids)]
            at += 4 * len(ids)

    def _values(self, names: list[str]) -> list[bytes]:
        """The ids of each piece, from the store or learnt."""
        store, marks = self.store, self.marks
        values = list(map(store.get, names))
        missing = [i for i, v in enumerate(values) if v is None]
        new_words, new_others, later = [], [], []
        for i in missing:
            name = names[i]
            if name.isalpha() and (name.isascii() or _SIMPLE.fullmatch(name)):
                new_words.append(name)  # the names of a batch are distinct
            # a full stop or comma after simple letters is a pre-token of its own
            elif (mark := marks.get(name[-1:])) is not None and (word := name[:-1]).isalpha() and (word.isascii() or _SIMPLE.fullmatch(word)):
                later.append((i, word, mark))
            else:
                new_others.append(name)
        if later:
            new_words += {word for _, word, _ in later}.difference(new_words, store)
        if new_words and not self._learn_words(new_words):
            self._learn_others(new_words)
        if new_others:
            self._learn_others(new_others)
        for i, word, mark in later:
            store[names[i]] = store[word] + mark
        for i in missing:
            values[i] = store[names[i]]
        return values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has.

        Splitting and numbering the pieces is Arrow's work; only a batch's distinct pieces become
        Python strings.
        """
        texts = texts.fill_null("")
        # a text that may hold a special token's name goes the whole way, unaltered
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            found = [self._whole(t) if odd else self.encode(pa.array([t], pa.string()))[0] for t, odd in zip(texts.to_pylist(), special, strict=True)]
            return np.concatenate(found), np.array([len(f) for f in found])
        if len(self.store) > PIECES:
            self.store.clear()
        blanks = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        lines = pc.split_pattern(pc.replace_substring_regex(blanks, _MARK, r"\1 \2 "), " ")
        pieces = lines.flatten().dictionary_encode()
        values = self._values(pieces.dictionary.to_pylist())
        # a batch has far fewer than 2**31 ids, and these are its largest arrays
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        flat = np.frombuffer(b"".join(values), "<u4")
        which = pieces.indices.to_numpy()
        width = size[which]
        upto = np.cumsum(width, dtype=np.int32)
        total = int(upto[-1]) if len(upto) else 0
        ids = flat[np.repeat(first[which] - upto + width, width) + np.arange(total, dtype=np.int32)]
        ends = np.concatenate([np.zeros(1, np.int32), upto])[lines.offsets.to_numpy() - lines.offsets[0].as_py()]
        return ids, np.diff(ends).astype(np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def _write(held, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = held.value
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(state["path"]))
        part, shard = TaskContext.get().partitionId(), 0
        held_ids, held_sizes, held_keys, total = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64())]
                           + [(n, pa.binary()) for n in ("symbols", "ends", "rules", "lengths")] + [("first_rule", pa.int32())])
        first_rule = max(FIRST_RULE, len(encoder.closes))

        def flush():
            nonlocal held_ids, held_sizes, held_keys, total, shard
            ends = np.cumsum(np.concatenate(held_sizes))
            g = compress(np.concatenate(held_ids), ends, first_rule=first_rule)
            row = {"part": part, "shard": shard, "doc_ids": held_keys, "n_tokens": int(ends[-1]),
                   "symbols": g.symbols.astype("<u4").tobytes(), "ends": g.ends.astype("<u4").tobytes(),
                   "rules": np.stack([g.left, g.right], 1).astype("<u4").tobytes(), "lengths": g.lengths.astype("<u4").tobytes(), "first_rule": first_rule}
            held_ids, held_sizes, held_keys, total, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for k in range(0, batch.num_rows, _DOCS):
                some = batch.slice(k, _DOCS)
                ids, sizes = encoder.encode(some.column("text"))
                ends = np.cumsum(sizes)
                ids, sizes, ends = np.insert(ids, ends, END_ID), sizes + 1, ends + np.arange(1, len(sizes) + 1)
                keys, done = some.column("doc_id").to_pylist(), 0
                while done < len(keys):
                    # documents up to the one that fills the shard
                    before = int(ends[done - 1]) if done else 0
                    stop = min(len(keys), int(np.searchsorted(ends, before + shard_tokens - total)) + 1)
                    held_ids.append(ids[before : ends[stop - 1]])
                    held_sizes.append(sizes[done:stop])
                    held_keys += keys[done:stop]
                    total += int(ends[stop - 1]) - before
                    done = stop
                    if total >= shard_tokens:
                        yield flush()
        if held_keys:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every document and write the shards under path."""
    bound_batches(docs.sparkSession, TEXT_BYTES)
    held = docs.sparkSession.sparkContext.broadcast({"path": tokenizer})
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    rows.mapInArrow(_write(held, shard_tokens), _SCHEMA).write.option("compression", "zstd").parquet(path)


def load(symbols: bytes, ends: bytes, rules: bytes, lengths: bytes, first_rule: int = FIRST_RULE) -> Grammar:
    pairs = np.frombuffer(rules, "<u4").reshape(-1, 2)
    return Grammar(np.frombuffer(symbols, "<u4"), np.frombuffer(ends, "<u4").astype(np.int64), pairs[:, 0], pairs[:, 1],
                   np.frombuffer(lengths, "<u4").astype(np.int64), first_rule)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):  # one shard at a time in memory
                get = lambda n: columns[n][k].as_py()  # noqa: B023, E731
                g = load(get("symbols"), get("ends"), get("rules"), get("lengths"), get("first_rule"))
                raw = g.expand(g.symbols).astype("<u4").tobytes()
                if len(raw) != 4 * get("n_tokens"):
                    raise ValueError(f"shard {get('part')}.{get('shard')}: {len(raw) // 4} ids, {get('n_tokens')} expected")
                upto = np.cumsum(g.widths(g.symbols))
                ends = np.where(g.ends > 0, upto[g.ends - 1], 0).tolist()
                starts = [0, *ends[:-1]]
                view, first = memoryview(raw), get("first")
                made = [pa.array(get("doc_ids"), pa.int64()), pa.array([first + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    made.append(pa.array([np.frombuffer(view[4 * s : 4 * e], "<u4").astype(np.int32) for s, e in zip(starts, ends, strict=True)],
                                         pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of each document."""
    bound_batches(spark)
    shards = spark.read.schema(_SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    # shards of a part in a window of their own; one row per part in the window over all
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    firsts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside")).join(F.broadcast(parts), "part").select(
        "part", "shard", (F.col("before") + F.col("inside")).alias("first"))
    few = firsts.count() <= 500_000
    placed = shards.join(F.broadcast(firsts) if few else firsts, ["part", "shard"])
    return placed.mapInArrow(_read(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to the shared folder and read the digest of every document back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = Scratch(docs.sparkSession, "tokens").path("shards")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))
