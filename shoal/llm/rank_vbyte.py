"""Token ids by frequency rank, in byte-aligned variable-length coding.

Texts become token ids, ids are renumbered by falling frequency over all
documents, so that common tokens need one byte. Numbers are stored as two
streams: control bytes, which hold four 2-bit lengths each, and the data bytes.
A reader finds lengths in a table with one row per control byte.

File format: Parquet, one row per block of whole documents, in ascending id
order: part, block, first_token (tokens of the part before the block), idents,
lengths (tokens per document), control, data. `ranks.parquet` beside it holds
(rank, token).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.llm.common import with_workers
from shoal.session import remove_path, scratch_path, stage

END = 2
BLOCK_TOKENS = 1 << 16
# Pieces of words whose ids a worker remembers; others are encoded again.
REMEMBERED = 800_000
# Bytes of text whose different words are cut together.
TOGETHER = 1 << 24

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    return _tokenizers[path]


# Where this vocabulary never joins the parts of a word made of ASCII and the letters
# U+00C0 to U+00FF; words with other characters stay whole, as `<|` may begin a special
# token. A-Z have the ids of a-z.
PIECES = re.compile(
    rb"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[^\sA-Za-z0-9\xc3]+"
)
OTHER = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]|<\|")
PIECES_AND_ENDS = re.compile(PIECES.pattern + rb"|\n")
# Stands between pieces that are encoded together; pieces that may not stand there.
BETWEEN = b" 0 "
ALONE = re.compile(rb"[0-9]|" + OTHER.pattern)


def _remember(known: dict, new: dict) -> dict:
    """`new` joins what is remembered while there is room; returns where to look `new` up."""
    if len(known) + len(new) > REMEMBERED:
        return new
    known.update(new)
    return known


def id_type(path: str) -> str:
    """Narrowest type that holds every id of the vocabulary."""
    return "<u2" if _tokenizer(path)[0].get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def encode_pieces(pieces: list[bytes], path: str) -> dict[bytes, bytes]:
    """Ids of each piece as numbers of `id_type`.

    Pieces without digits and foreign letters go together with a number between
    them, whose id none of them has; letters count alike in either case.
    """
    tokenizer, kind = _tokenizer(path)[0], id_type(path)
    ids_of = lambda texts: [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    between = ids_of([BETWEEN.strip().decode()])[0]
    alone = list(filter(ALONE.search, pieces))
    plain, coded = list(set(pieces).difference(alone)), {}
    for at in range(0, len(plain), 512):
        some = plain[at : at + 512]
        ids = ids_of([BETWEEN.join(some).decode()])[0]
        ends = np.flatnonzero(ids == between[0])
        if len(between) != 1 or len(ends) != len(some) - 1:
            alone += some
            continue
        begins, ends = np.append(0, ends + 1).tolist(), np.append(ends, len(ids)).tolist()
        raw, width = ids.tobytes(), ids.itemsize
        coded.update((piece, raw[a * width : b * width]) for piece, a, b in zip(some, begins, ends))
    for at in range(0, len(alone), 4096):
        some = alone[at : at + 4096]
        coded.update((piece, ids.tobytes()) for piece, ids in zip(some, ids_of([p.decode() for p in some])))
    return coded


def runs(values: pa.Array, places: pa.Array | np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The large_binary `values` at `places`, joined up to each of `ends`."""
    flat = values.take(pa.array(places))
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[np.append(0, ends)]
    offsets = offsets if pa.types.is_large_binary(kind) else offsets.astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), flat.buffers()[2]])


def word_ids(words: pa.Array, path: str) -> pa.Array:
    """Ids of each of some different words (string) as large_binary. Pieces seen before are looked up."""
    _, known = _tokenizer(path)
    text = b"\n".join(words.view(pa.binary()).to_pylist())
    whole = np.zeros(len(words), bool)
    if OTHER.search(text):
        whole = np.array([OTHER.search(w) is not None for w in text.split(b"\n")])
        text = b"\n".join(words.filter(pa.array(~whole)).view(pa.binary()).to_pylist())
    # pieces of all words, each word with a line feed behind it; then words that stay whole
    pieces = PIECES_AND_ENDS.findall(text.lower() + b"\n") if not whole.all() else []
    for word in words.filter(pa.array(whole)).view(pa.binary()).to_pylist():
        pieces += word, b"\n"
    pieces = pa.array(pieces, pa.binary()).dictionary_encode()
    different = pieces.dictionary.to_pylist()
    coded = encode_pieces([p for p in different if p not in known and p != b"\n"], path)
    coded[b"\n"] = b""
    if _remember(known, coded) is known:
        coded = known
    found = [coded[p] if p in coded else known[p] for p in different]
    end = different.index(b"\n") if different else 0
    ends = np.flatnonzero(pieces.indices.to_numpy() == end) + 1
    order = np.argsort(np.append(np.flatnonzero(~whole), np.flatnonzero(whole)))
    return runs(pa.array(found, pa.large_binary()), pieces.indices, ends, pa.large_binary()).take(pa.array(order))


def token_ids(texts: pa.Array, path: str) -> pa.Array:
    """Ids of each text (binary or null) as numbers of `id_type`, the end id last.

    No token spans white space, so a text's ids are those of its words. Each
    different word of `texts` is cut once and its ids are put where it stands.
    """
    if not len(texts):
        return pa.array([], pa.binary())
    words = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
    found = words.flatten().dictionary_encode()
    # behind the words of each text stands its end, numbered after all words
    ends = np.cumsum(pc.list_value_length(words).to_numpy() + 1)
    inner = np.ones(len(found) + len(texts), bool)
    inner[ends - 1] = False
    places = np.full(len(inner), len(found.dictionary), np.int32)
    places[inner] = found.indices.to_numpy()
    end = pa.array([np.array([END], id_type(path)).tobytes()], pa.large_binary())
    return runs(pa.concat_arrays([word_ids(found.dictionary, path), end]), places, ends, pa.binary())


def token_bytes(texts: list[bytes | None], path: str) -> list[bytes]:
    """`token_ids` of a list."""
    return token_ids(pa.array(texts, pa.binary()), path).to_pylist()


def encode_texts(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident and the ids of its text as binary; a null text is empty."""
    with_workers(docs)
    rows = docs.select(F.col(ident).cast("long").alias("ident"), F.col(text).cast("binary").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + TOGETHER, side="right"))
                part = batch.slice(begin, max(1, end - begin))
                yield pa.RecordBatch.from_arrays([part.column("ident"), token_ids(part.column("text"), path)], ["ident", "ids"])
                begin += part.num_rows

    return rows.mapInArrow(encode, "ident long, ids binary")


def frequency_ranks(coded: DataFrame, kind: str) -> np.ndarray:
    """Tokens by falling frequency, ties by id. The result is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            if len(n) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(n) - len(seen), np.int64)])
            seen[: len(n)] += n
        tokens = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(seen[tokens])], ["token", "n"])

    counts = coded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").select("token").toLocalIterator()], np.int64)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    size = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(size)] = size
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


# Four byte lengths for every control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` numbers of two streams."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    word = padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24
    return word & KEEP[size - 1]


def write_tokens(coded: DataFrame, path: str, kind: str = "<u4") -> None:
    """Write ids, binary of type `kind`, to `path` in the file format. `coded` is read twice."""
    spark = with_workers(coded)
    tokens = frequency_ranks(coded, kind)
    rank_of = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.uint32)
    rank_of[tokens] = np.arange(len(tokens), dtype=np.uint32)
    ranks = spark.createDataFrame(pa.table({"rank": np.arange(len(tokens)), "token": tokens}))
    ranks.coalesce(1).write.parquet(f"{path}/ranks.parquet")
    ranked = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, done = TaskContext.get().partitionId(), 0, 0
        idents: list = []
        held: list = []
        lengths: list = []

        def flush() -> pa.RecordBatch:
            control, data = pack(ranked.value[np.concatenate(held)])
            values = [[part], [block], [done], [idents], [lengths], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCKS)], schema=BLOCKS)

        for batch in batches:
            for ident, ids in zip(batch.column("ident").to_pylist(), batch.column("ids").to_pylist()):
                idents.append(ident)
                held.append(np.frombuffer(ids, kind))
                lengths.append(len(held[-1]))
                if sum(lengths) >= BLOCK_TOKENS or len(lengths) >= BLOCK_TOKENS // 16:
                    yield flush()
                    block, done = block + 1, done + sum(lengths)
                    idents, held, lengths = [], [], []
        if held:
            yield flush()

    ordered = coded.withColumn("crc", F.crc32("ids"))
    ordered = ordered.repartitionByRange("ident", "crc").sortWithinPartitions("ident", "crc", "ids").drop("crc")
    fields = "part int, block int, first_token long, idents array<long>, lengths array<int>, control binary, data binary"
    # already packed: a second compression costs time and saves little
    ordered.mapInArrow(blocks, fields).write.parquet(f"{path}/blocks.parquet", compression="none")


BLOCKS = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("idents", pa.list_(pa.int64())),
     ("lengths", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())]
)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the tokens before it. One row per written part."""
    blocks = spark.read.parquet(f"{path}/blocks.parquet")
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.groupBy("part").agg(F.sum(n).alias("n"))
    rows = sorted((r["part"], r["n"]) for r in sums.toLocalIterator())
    starts = np.concatenate([[0], np.cumsum([n for _, n in rows])]).astype(int).tolist()
    return spark.createDataFrame([(p, s) for (p, _), s in zip(rows, starts)], "part int, base long")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files of `path`: ident, start, n_tokens, ids_crc32 (and ids as binary)."""
    tokens = spark.read.parquet(f"{path}/ranks.parquet").orderBy("rank").toArrow().column("token").to_numpy()
    token_of = spark.sparkContext.broadcast(tokens.astype("<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = token_of.value[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                texts = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                columns = [
                    pa.array(np.full(len(ends), row["part"]), pa.int32()), pa.array(row["idents"], pa.int64()),
                    pa.array(row["first_token"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                ]
                names = ["part", "ident", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = "part int, ident long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = spark.read.parquet(f"{path}/blocks.parquet").mapInArrow(decode, kind)
    # one row per written part: bounded by the number of tasks of a write
    placed = rows.join(F.broadcast(part_starts(spark, path)), "part")
    return placed.select(
        "ident", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def tokenize(docs: DataFrame, vocabulary: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, write and read back: ident, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Null ids come first, rows of equal
    id follow each other in a fixed order of their ids, an empty table gives no
    rows, other columns are not read. A text is encoded in one piece by one
    task; nothing but the vocabulary's counts reaches the driver.
    """
    spark = with_workers(docs)
    raw = scratch_path(spark, "ids")
    encode_texts(docs, vocabulary, ident, text).write.parquet(raw, compression="zstd")
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.schema("ident long, ids binary").parquet(raw), path, id_type(vocabulary))
    remove_path(spark, raw)  # written again above, and read by nothing else
    return read_tokens(spark, path).withColumnRenamed("ident", ident)
