"""Phrases whose words go together, counted by an FM-index over word ids in each shard of the corpus.

1. Texts become shards of word numbers; words are counted over all shards, and those frequent enough for a
   phrase to hold them get ids over the corpus.
2. Each shard's index lists its pairs by extending intervals; sums over shards leave the frequent pairs.
3. What is left of each shard is its runs of frequent pairs; its index lists triples and quadruples there.
4. A phrase is scored by its weakest cut, dropped where a longer one explains it, and ranked in its language.

A phrase of f occurrences has no part with fewer, so nothing that counts is left out before its sum is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import release, written
from .textops import LOWER, mix

#: Occurrences a candidate needs, words it has at most, candidates a language returns.
LEAST, LONGEST, FIRST = 30, 4, 2000
#: Share of a phrase's occurrences, in hundredths, that a longer one may hold before the phrase is dropped.
EXPLAINED = 80
#: Scale of a score.
SCALE = 2_000_000
#: Words a shard takes; a longer text is cut between pieces, which no phrase crosses.
SHARD_WORDS = 1_500_000
#: Words of the corpus for each bucket in which pairs meet; there are fewer pairs than words.
BUCKET_WORDS = 1_000_000
#: Bytes of text turned into words at once.
PART_BYTES = 1 << 20
#: Scores of a bucket of the histogram that finds where a language's first rows end.
BUCKET = 500

#: The bytes that end a piece become one byte that no text holds, a tab becomes a space.
END = b"\xff"
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else LOWER[b] for b in range(256))


# ---------------------------------------------------------------- shards of word numbers


class _Numbers(dict):
    """Numbers words of one language as they are met; the numbers are shared by all languages of a shard."""

    def __init__(self, words: list[tuple[str, bytes]], lang: str):
        super().__init__({END: 0})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        number = self[word] = len(self.words)
        return number


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of some ``PART_BYTES`` that end where a piece ends."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = text.find(END, at + PART_BYTES)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def packed(ids: np.ndarray) -> bytes:
    """32-bit numbers, their bytes laid out plane by plane and compressed."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


SHARDS = "shard long, lang string, word binary, local int, n long, seq binary"


def _shard(name: int, words: list[tuple[str, bytes]], runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row a word and its count in the shard, then the shard's sequence in one row."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("local", pa.int32()), ("n", pa.int64()), ("seq", pa.binary())])
    seq = np.concatenate([np.zeros(1, np.int32), *runs, np.zeros(1, np.int32)])
    seq = seq[np.append(True, (seq[1:] != 0) | (seq[:-1] != 0))]
    counts = np.bincount(seq, minlength=len(words) + 1)
    for a in range(0, len(words), 100_000):
        part = words[a : a + 100_000]
        m = len(part)
        cells = [np.full(m, name), [x for x, _ in part], [x for _, x in part], np.arange(a + 1, a + m + 1, dtype=np.int32), counts[a + 1 : a + m + 1], [None] * m]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
    yield pa.record_batch([pa.array([c], f.type) for c, f in zip((name, None, None, None, len(seq), packed(seq)), schema, strict=True)], schema=schema)


def _sharded(size: int):
    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        words: list[tuple[str, bytes]] = []
        own: dict[str, _Numbers] = {}
        runs: list[np.ndarray] = []
        filled = 0
        for batch in batches:
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in own:
                    own[lang] = _Numbers(words, lang)
                for part in _parts(cell.as_buffer().to_pybytes()):
                    found = part.replace(END, b" \xff ").split()
                    runs += [np.fromiter(map(own[lang].__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
                    filled += len(found)
                    if filled >= size:
                        yield from _shard(name, words, runs)
                        name, words, own, runs, filled = name + 1, [], {}, [], 0
                        own[lang] = _Numbers(words, lang)
        if filled:
            yield from _shard(name, words, runs)
        del words, own, runs
        release()

    return sharded


def shards(docs: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """Shards of ``docs`` (lang, text): a row for each word of a shard, and one for its sequence of the words' numbers, 0 between pieces."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return written(own.where("text is not null").mapInArrow(_sharded(size), SHARDS), "shards")


# ---------------------------------------------------------------- the index


def _order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic sequence by their first ``depth`` symbols, equal ones by place."""
    n = len(symbols)
    shift = max(1, int(n).bit_length())
    order = np.arange(n)
    for d in reversed(range(depth)):
        key = (symbols[(order + d) % n].astype(np.int64) << shift) | np.arange(n)
        key.sort()
        key &= (1 << shift) - 1
        order = order[key]
    return order.astype(np.int32)


class WordIndex:
    """An FM-index of a sequence of ids (0: end of a piece), its rows ordered by ``depth`` words, and that of the sequence read backwards.

    An n-gram is an interval of rows here and one of the same size there. ``left`` and ``right`` extend all
    intervals of a level at once: rows in the order of the symbol before them are where those symbols' rows
    stand, so a run of one symbol and one interval is the interval of the extended n-gram.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        self.names, symbols = np.unique(np.append(sequence, 0), return_inverse=True)
        self.symbols, self.depth = symbols[:-1].astype(np.int32), depth
        self.sides: list[tuple[np.ndarray, np.ndarray] | None] = [None, None]

    def _side(self, backwards: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols before the rows, rows by that symbol) of the sequence, or of it read backwards."""
        if self.sides[backwards] is None:
            text = self.symbols[::-1] if backwards else self.symbols
            before = text[_order(text, self.depth) - 1]
            self.sides[backwards] = (before, _order(before, 1))
        return self.sides[backwards]

    def words(self) -> list[np.ndarray]:
        """[starts here, starts in the backward index, sizes, words] of all single words."""
        count = np.bincount(self.symbols, minlength=len(self.names))
        start = np.cumsum(count) - count
        return [start[1:], start[1:], count[1:], np.arange(1, len(self.names), dtype=np.int32)[:, None]]

    def _extended(self, level: list[np.ndarray], backwards: int) -> list[np.ndarray]:
        start, other, size, words = level
        if backwards:
            start, other = other, start
        before, by = self._side(backwards)
        member = np.full(len(before), -1, np.int32)
        rank = np.argsort(start)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size[rank]) - size[rank], size[rank])
        member[np.repeat(start[rank], size[rank]) + at] = np.repeat(rank, size[rank])
        own, symbol = member[by], before[by]
        place = np.flatnonzero(own >= 0)
        own, symbol = own[place], symbol[place]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(fresh)
        sizes = np.diff(first, append=len(place))
        parent, symbol, starts = own[first], symbol[first], place[first]
        # in the other index an interval is parted by these symbols in their order
        ranked = np.lexsort((symbol, parent))
        before_it = np.cumsum(sizes[ranked]) - sizes[ranked]
        lead = np.append(True, parent[ranked][1:] != parent[ranked][:-1])[: len(ranked)]
        shift = np.empty(len(ranked), np.int64)
        shift[ranked] = before_it - before_it[lead][np.cumsum(lead) - 1] if len(ranked) else before_it
        keep = symbol > 0
        starts, sizes, parent, symbol = starts[keep], sizes[keep], parent[keep], symbol[keep]
        others = other[parent] + shift[keep]
        added = [words[parent], symbol[:, None]]
        return [*((others, starts) if backwards else (starts, others)), sizes, np.hstack(added if backwards else added[::-1])]

    def left(self, level: list[np.ndarray]) -> list[np.ndarray]:
        """All one-word extensions to the left of the n-grams of ``level``, with the counts of each."""
        return self._extended(level, 0)

    def right(self, level: list[np.ndarray]) -> list[np.ndarray]:
        """All one-word extensions to the right."""
        return self._extended(level, 1)

    def counted(self, level: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words of each n-gram, occurrences)."""
        return self.names[level[3]], level[2]


# ---------------------------------------------------------------- counting over shards


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _blob(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the steps between them, plane by plane and compressed."""
    return _wide(np.diff(numbers, prepend=0))


def _unblob(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unwide(raw, n))


def _wide(numbers: np.ndarray) -> bytes:
    planes = numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unwide(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


#: The sequence of a shard in ids of the corpus (bucket null), and its pairs by bucket with their counts.
INDEXED = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
#: Frequent pairs of a shard (keys), and each frequent pair with its count over all shards (k1, f).
MERGED = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("k1", pa.int64()), ("f", pa.int64())])
#: Triples and quadruples of a shard by bucket, and each frequent one with its count over all shards.
GRAMS = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("k1", pa.binary()), ("k2", pa.binary()), ("counts", pa.binary())])
LONGER = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("f", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in schema)


def _cells(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _paired(buckets: int, width: int):
    def paired(seqs: pa.Table, words: pa.Table) -> pa.Table:
        if not seqs.num_rows or not words.num_rows:
            return INDEXED.empty_table()
        shard, n = seqs.column("shard")[0].as_py(), seqs.column("n")[0].as_py()
        local = unpacked(seqs.column("seq")[0].as_py(), n)
        ids = np.zeros(int(local.max(initial=0)) + 1, np.int64)
        ids[_array(words, "local")] = _array(words, "id")
        sequence = ids[local]  # words that are not frequent end a piece
        sequence = sequence[np.append(True, (sequence[1:] != 0) | (sequence[:-1] != 0))]
        del local
        rows = [(shard, None, len(sequence), packed(sequence), None)]
        index = WordIndex(sequence, 1)
        pairs, count = index.counted(index.left(index.words()))
        key = pairs[:, 0] * width + pairs[:, 1]
        bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        key, bucket, count = key[order], bucket[order], count[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False):
            rows.append((shard, int(bucket[a]), b - a, _blob(key[a:b]), packed(count[a:b])))
        del index, pairs, key, count, order, sequence
        release()
        return _cells(INDEXED, rows)

    return paired


def _merged(width: int):
    def merged(table: pa.Table) -> pa.Table:
        shards, sizes = table.column("shard").to_pylist(), table.column("n").to_pylist()
        keys = np.concatenate([_unblob(k.as_py(), n) for k, n in zip(table.column("keys"), sizes, strict=True)])
        counts = np.concatenate([unpacked(c.as_py(), n) for c, n in zip(table.column("counts"), sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        fresh = np.append(True, keys[order][1:] != keys[order][:-1])
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(fresh))
        often = np.empty(len(keys), bool)
        often[order] = (total >= LEAST)[np.cumsum(fresh) - 1]
        rows, at = [], 0
        for shard, n in zip(shards, sizes, strict=True):
            own = keys[at : at + n][often[at : at + n]]
            if len(own):
                rows.append((shard, len(own), _blob(own), None, None))
            at += n
        own = keys[order][fresh][total >= LEAST]
        none = pa.nulls(len(own), pa.int64())
        found = [none, none, pa.nulls(len(own), pa.binary()), pa.array((own // width << 32) | own % width), pa.array(total[total >= LEAST])]
        return pa.concat_tables([_cells(MERGED, rows), pa.table(found, schema=MERGED)])

    return merged


def _grams(buckets: int, width: int):
    def grams(seqs: pa.Table, side: pa.Table) -> pa.Table:
        if not seqs.num_rows or not side.num_rows:
            return GRAMS.empty_table()
        sequence = unpacked(seqs.column("keys")[0].as_py(), seqs.column("n")[0].as_py()).astype(np.int64)
        pairs = np.sort(np.concatenate([_unblob(k.as_py(), n) for k, n in zip(side.column("keys"), side.column("n").to_pylist(), strict=True)]))
        key = sequence[:-1] * width + sequence[1:]
        linked = (pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key) & (sequence[:-1] != 0) & (sequence[1:] != 0)
        # a word stays where a frequent pair holds it; an end follows where the next pair is none
        before, after = np.append(False, linked), np.append(linked, False)
        stays = before | after
        out = np.zeros(2 * len(sequence) + 1, np.int64)
        out[1::2] = np.where(stays, sequence, 0)
        keep = np.zeros(len(out), bool)
        keep[0] = True
        keep[1::2] = stays
        keep[2::2] = stays & ~after
        index = WordIndex(out[keep], LONGEST - 1)
        level = index.left(index.words())
        found = []
        for size in range(3, LONGEST + 1):
            level = index.right(level) if size % 2 else index.left(level)
            words, n = index.counted(level)
            k2 = words[:, 2] if size == 3 else (words[:, 2] << 32) | words[:, 3]
            found.append((words[:, 0] << 32 | words[:, 1], k2, n))
        k1, k2, n = (np.concatenate(x) for x in zip(*found, strict=True))
        del index, level, words, out, sequence, pairs, key, found
        bucket = (mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((k1, bucket))
        k1, k2, n, bucket = k1[order], k2[order], n[order], bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k1) else np.zeros(0, np.int64)
        ends = [*first[1:].tolist(), len(k1)]
        rows = [(int(bucket[a]), b - a, _blob(k1[a:b]), _wide(k2[a:b]), packed(n[a:b])) for a, b in zip(first.tolist(), ends, strict=False)]
        release()
        return _cells(GRAMS, rows)

    return grams


def _longer(table: pa.Table) -> pa.Table:
    """The frequent ones of a bucket over all shards."""
    sizes = table.column("n").to_pylist()
    k1, k2, n = (
        np.concatenate([read(c.as_py(), m) for c, m in zip(table.column(name), sizes, strict=True)])
        for name, read in (("k1", _unblob), ("k2", _unwide), ("counts", unpacked))
    )
    order = np.lexsort((k2, k1))
    k1, k2, n = k1[order], k2[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    total = np.add.reduceat(n, first)
    first, total = first[total >= LEAST], total[total >= LEAST]
    return pa.table([pa.array(k1[first]), pa.array(k2[first]), pa.array(total)], schema=LONGER)


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with ids from 2 on, dense: a place in its partition and the rows of the partitions before."""
    own = written(words.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return own.join(F.broadcast(base), "part").withColumn("id", F.col("base") + F.col("row") + 2).drop("part", "row", "base")


def _counts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((k1, k2, f) of frequent phrases, (id, lang, word) of frequent words, (lang, n) of all words).

    k1 holds the first two ids of a phrase and k2 the next two, 32 bits each, the upper half empty where one is left over.
    """
    corpus = shards(docs)
    words = corpus.where("seq is null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = written(words, "vocabulary")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = written(_numbered(words.where(F.col("f") >= LEAST)), "frequent")
    if known.count() >= (1 << 31) - 2:
        raise ValueError("more frequent words than 31 bits number")
    words_in_all = int(totals.agg(F.sum("n")).first()[0] or 0)
    buckets, width = -(-words_in_all // BUCKET_WORDS) or 1, known.count() + 2
    maps = corpus.where("seq is null").join(known.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "local", "id")
    sequences = corpus.where("seq is not null").select("shard", "n", "seq")
    indexed = written(sequences.groupBy("shard").cogroup(maps.groupBy("of")).applyInArrow(_paired(buckets, width), _ddl(INDEXED)), "indexed")
    # sums over shards by buckets of pairs; what is frequent goes back to each shard that has it
    pairs = written(indexed.where("bucket is not null").groupBy("bucket").applyInArrow(_merged(width), _ddl(MERGED)), "pairs")
    sequences = indexed.where("bucket is null").select("shard", "n", "keys")
    side = pairs.where("keys is not null").select("shard", "n", "keys")
    grams = sequences.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(_grams(buckets, width), _ddl(GRAMS))
    longer = grams.groupBy("bucket").applyInArrow(_longer, _ddl(LONGER))
    none = F.lit(0).cast("long").alias("k2")
    single = known.select(F.col("id").alias("k1"), none, "f")
    double = pairs.where("keys is null").select("k1", none, "f")
    return written(single.unionByName(double).unionByName(longer), "counts"), known.select("id", "lang", "word"), totals


# ---------------------------------------------------------------- scores


def _high(key: str) -> Column:
    return F.shiftrightunsigned(key, 32)


def _low(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << 32) - 1))


def _key(*ids: Column) -> list[Column]:
    pair = [ids[0] if len(ids) == 1 else F.shiftleft(ids[0], 32).bitwiseOR(ids[1])]
    rest = ids[2:]
    return [*pair, F.lit(0).cast("long") if not rest else rest[0] if len(rest) == 1 else F.shiftleft(rest[0], 32).bitwiseOR(rest[1])]


def _ids(size: int) -> list[Column]:
    return [F.col(f"g{k}") for k in range(1, size + 1)]


def _by_size(of) -> Column:
    """An array that depends on the phrase's size."""
    out = F.when(F.col("size") == 2, of(2))
    for size in range(3, LONGEST + 1):
        out = out.when(F.col("size") == size, of(size))
    return out


def _cuts(size: int) -> Column:
    def cut(k: int) -> Column:
        left, right = _key(*_ids(size)[:k]), _key(*_ids(size)[k:])
        return F.struct(F.lit(k).alias("k"), *(c.alias(n) for c, n in zip([*left, *right], ("lk1", "lk2", "rk1", "rk2"), strict=True)))

    return F.array(*(cut(k) for k in range(1, size)))


def _inner(size: int) -> Column:
    """The keys of all shorter phrases inside one of ``size`` words."""
    runs = [(a, m) for m in range(2, size) for a in range(size - m + 1)]
    keys = [_key(*_ids(size)[a : a + m]) for a, m in runs]
    kind = "array<struct<k1: bigint, k2: bigint>>"
    return F.array(*(F.struct(a.alias("k1"), b.alias("k2")) for a, b in keys)).cast(kind) if keys else F.array().cast(kind)


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of ``docs`` (lang, text) in each language.

    Null texts count as empty, a null language as ``und``. Equal rows count each. A text of any length is
    cut between pieces only. An empty table, or one without frequent phrases, gives no rows. Only lang and
    text are read, so other columns may have any names.
    """
    counts, words, totals = _counts(docs)
    size = F.when(F.col("k2") == 0, 2).when(_high("k2") == 0, 3).otherwise(4)
    found = counts.where(_high("k1") != 0).select("k1", "k2", F.col("f").alias("a"), size.alias("size"))
    found = found.select("*", _high("k1").alias("g1"), _low("k1").alias("g2"), F.when(F.col("size") == 3, F.col("k2")).otherwise(_high("k2")).alias("g3"), F.when(F.col("size") == 4, _low("k2")).alias("g4"))
    part = lambda side: counts.select(F.col("k1").alias(f"{side}k1"), F.col("k2").alias(f"{side}k2"), F.col("f").alias(side))
    cuts = found.select("k1", "k2", "a", F.explode(_by_size(_cuts)).alias("c")).select("k1", "k2", "a", "c.*")
    cuts = cuts.join(part("l"), ["lk1", "lk2"]).join(part("r"), ["rk1", "rk2"])
    wide = f"cast(floor(cast(a as decimal(38,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)) as bigint)"
    weakest = cuts.withColumn("score", F.expr(wide)).groupBy("k1", "k2").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inside = found.select(F.col("a").alias("longer"), F.explode(_by_size(_inner)).alias("c")).select("longer", "c.*")
    held = inside.groupBy("k1", "k2").agg(F.max("longer").alias("longer"))
    kept = found.join(held, ["k1", "k2"], "left").where(F.expr(f"longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * {EXPLAINED}"))
    scored = kept.join(weakest, ["k1", "k2"]).select("g1", "g2", "g3", "g4", "size", "a", "c.score", "c.l", "c.r")
    name = lambda k: words.select(F.col("id").alias(f"g{k}"), F.col("word").cast("string").alias(f"w{k}"))
    scored = written(scored.join(words.select(F.col("id").alias("g1"), "lang", F.col("word").cast("string").alias("w1")), "g1"), "scored")
    # the first rows of a language lie in its upper buckets; the last of those is taken whole
    bucket = F.floor(F.col("score") / BUCKET)
    above = Window.partitionBy("lang").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = scored.groupBy("lang", bucket.alias("bucket")).count().withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0)))
    upper = buckets.where(F.col("above") < FIRST).groupBy("lang").agg(F.min("bucket").alias("bottom"))
    first = scored.join(F.broadcast(upper), "lang").where(bucket >= F.col("bottom"))
    for k in (2, 3, 4):
        first = first.join(name(k), f"g{k}", "left" if k > 2 else "inner")
    first = first.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3", "w4"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= FIRST)
    return first.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Fixed SQL of the contract.
SQL = r"""
with d as (
    select row_number() over () as row, coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
p as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from d),
g as (select lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: w[i:i + m - 1])) as w from p, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m),
f as (select lang, m, w, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where m = 1 group by lang),
c as (select lang, m, w, f as a from f where m >= 2 and f >= 30),
k as (
    select c.lang, c.w, a, l.f as l, r.f as r, k, (cast(2000000 as hugeint) * a) // (l.f + r.f) as score
    from (select *, unnest(generate_series(1, m - 1)) as k from c) as c
    join f as l on l.lang = c.lang and l.w = c.w[1:k] join f as r on r.lang = c.lang and r.w = c.w[k + 1:c.m]),
b as (select * from k qualify row_number() over (partition by lang, w order by score, k) = 1),
s as (select lang, a, s, w[i:i + s - 1] as w from (select *, unnest(generate_series(1, m - s + 1)) as i from (select *, unnest([2, 3]) as s from c) where s < m)),
x as (select lang, w, max(a) as longer from s group by all),
o as (
    select b.lang, array_to_string(b.w, ' ') as phrase, a, l, r, score from b left join x on x.lang = b.lang and x.w = b.w
    where longer is null or 100 * longer < 80 * a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select z.lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from z join n on n.lang = z.lang where rank <= 2000
"""
