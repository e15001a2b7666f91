"""Token ids in binary shard files, reached by key through a minimal perfect hash index.

A shard file is the ids of its documents one after another, little-endian, each document closed by the end
id, then a directory of the shard (doc ids and counts) and its length. Files ascend by doc_id. The text
writer of Spark puts the bytes there, with the end id as its line separator, so any Hadoop file system, task
retry and commit protocol will do.

The index maps (doc_id, occurrence) to (shard, offset, count, ids before). Keys are dealt to parts by hash; a
part holds a minimal perfect hash function (bit arrays a level, ranks) and, by slot, a 32-bit fingerprint and
the place. What the fingerprint lets through is checked against the shard's directory.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, release, written
from .textops import mix

#: Bytes of text a shard file takes on average.
SHARD_BYTES = 16 << 20
#: Keys a part of the index takes on average.
PART_KEYS = 1 << 16
#: Bytes of text tokenised at once; a longer document is cut at white space, where no token crosses.
PIECE_BYTES = 1 << 20
#: Words and their bytes that a worker remembers before it forgets most of them.
MEMO_WORDS, MEMO_BYTES = 400_000, 24 << 20
#: Words it keeps then.
KEPT_WORDS = 100_000
#: Runs of signs behind words that it remembers.
TAILS = 4096
#: Bits a key of a level of the hash function, and levels before the rest is listed by name.
SPREAD, LEVELS = 1.7, 48
#: The letters that byte-level models write for those bytes of small Latin-1 letters that do not print.
BYTE_LETTERS = {159: 321, 160: 322, 173: 323}
#: Closes the directory.
MAGIC = b"IDSHARD1"

_MARKS = re.compile(rb"[\xcc-\xf7]")
#: Small letters of ASCII and Latin-1, and signs of ASCII behind them: two pre-tokens at most, each of them as it stands.
_SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: Words that the model itself must split as the whole tokenizer does, or it is not asked alone.
PROBE = ["the", "unquestionable", "d\u00e9j\u00e0", "ma\u00f1ana,", "\u00edndice...", "stra\u00dfenb\u00e4hnchen!", "xqzvt;", "it'", "word###", "n<|&"]
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")


# ---------------------------------------------------------------- words to ids


class _Memo(dict):
    """Numbers words as they are met and keeps those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        self.bytes += len(word)
        return number


def _plain(text: bytes) -> bytes:
    """Lower-cases A-Z, which the model does itself, where no mark could combine with them (no character from U+0300 on)."""
    return text if _MARKS.search(text) else text.lower()


class Encoder:
    """Ids of texts by a ``tokenizers`` model that lower-cases and whose tokens never cross ASCII white space: each word is encoded once."""

    def __init__(self, model: str, special: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = not special
        self.tokenize = self.tokenizer.model.tokenize
        # no k or i: other characters than A-Z become those in lower case
        whole = sorted(t for t in self.tokenizer.get_vocab(with_added_tokens=False) if re.fullmatch(r"[a-hjl-z]{8,}</w>", t))
        self.mark = whole[0].removesuffix("</w>")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.tails: dict[bytes, list[int]] = {}
        general = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBE]
        self.direct = all(self._direct(_SIMPLE.fullmatch(w.encode())) == ids for w, ids in zip(PROBE, general, strict=True))
        self.memo, self.bounds = _Memo(), np.zeros(1 << 14, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _forget(self) -> None:
        """Keeps the first words, which tend to be the common ones."""
        memo = _Memo()
        for word in itertools.islice(self.memo, KEPT_WORDS):
            memo[word] = len(memo)
            memo.bytes += len(word)
        if memo.bytes > MEMO_BYTES // 2:
            memo = _Memo()
        self.memo, self.used = memo, int(self.bounds[len(memo)])

    def _direct(self, found: re.Match) -> list[int]:
        """Letters, a word to the model as it stands, and signs behind them."""
        word = found[1]
        ids = [t.id for t in self.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_LETTERS))]
        if tail := found[2]:
            if tail not in self.tails:
                if len(self.tails) >= TAILS:
                    self.tails.clear()
                self.tails[tail] = self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids
            ids += self.tails[tail]
        return ids

    def _together(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, from one text of all words with ``mark``, a token that none of them holds, between."""
        ids = self.tokenizer.encode(f" {self.mark} ".join(words), add_special_tokens=False).ids
        cut = [k for k, i in enumerate(ids) if i == self.mark_id]
        if len(cut) != len(words) - 1:  # a word spells the mark
            return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return [ids[a + 1 : b] for a, b in zip([-1, *cut], [*cut, len(ids)], strict=True)]

    def _learn(self) -> None:
        fresh, self.memo.fresh = self.memo.fresh, []
        at, tokenize = len(self.memo) - len(fresh), self.tokenize
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            lists: list[list[int]] = []
            others: list[int] = []
            for j, w in enumerate(part):
                if self.direct and w.isalpha() and w.islower():  # of bytes: a-z alone
                    lists.append([t.id for t in tokenize(w.decode())])
                elif self.direct and (found := _SIMPLE.fullmatch(w)):
                    lists.append(self._direct(found))
                else:
                    lists.append([])
                    others.append(j)
            if others:
                for j, ids in zip(others, self._together([part[j].decode("utf-8", "replace") for j in others]), strict=True):
                    lists[j] = ids
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            total, end = int(sizes.sum()), at + len(lists)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while end >= len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, total)
            self.bounds[at + 1 : end + 1] = self.used + np.cumsum(sizes)
            self.used, at = self.used + total, end

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each word) of ``words``."""
        if len(self.memo) > MEMO_WORDS or self.memo.bytes > MEMO_BYTES:
            self._forget()
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if self.memo.fresh:
            self._learn()
        start = self.bounds[number]
        size = self.bounds[number + 1] - start
        before = np.cumsum(size) - size
        return self.flat[np.repeat(start - before, size) + np.arange(int(size.sum()))], size

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        words: list[bytes] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            own = _plain(text).split()
            words += own
            counts[k + 1] = len(own)
        ids, size = self.words(words)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def text(self, text: bytes) -> np.ndarray:
        """The ids of one text of any length."""
        out, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, at + PIECE_BYTES)
            end = gap.start() if gap else len(text)
            out.append(self.words(_plain(text[at:end]).split())[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@functools.lru_cache(maxsize=1)
def _encoder(model: str, special: bool) -> Encoder:
    return Encoder(model, special)


def _let_go() -> None:
    """Drops the words that this worker remembers from writing, which later stages do not ask for, and gives the memory back."""
    if _encoder.cache_info().currsize:
        _encoder.cache_clear()
        release()


def _groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about a piece together; a text beyond that stands alone."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


# ---------------------------------------------------------------- shard files


def _kind(width: int) -> str:
    return f"<u{width}"


def _directory_bytes(ids: list[int | None], counts: list[int]) -> bytes:
    known = np.array([i is not None for i in ids], np.uint8)
    body = b"".join(x.tobytes() for x in (np.array([i or 0 for i in ids], "<i8"), np.array(counts, "<i8"), known))
    return body + np.array([len(ids)], "<u8").tobytes() + MAGIC


def directory(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, which are known, ids of each document) of a shard file; its documents follow one another from byte 0."""
    end = len(raw) - width
    if raw[end - 8 : end] != MAGIC:
        raise ValueError("a shard file does not end in its directory")
    n = int(np.frombuffer(raw, "<u8", 1, end - 16)[0])
    at = end - 16 - 17 * n
    ids, counts = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<i8", n, at + 8 * n)
    if int(counts.sum()) * width != at:
        raise ValueError(f"a shard file holds {at} bytes of ids and lists {int(counts.sum())} ids")
    return ids, np.frombuffer(raw, np.uint8, n, at + 16 * n).astype(bool), counts


def write_shards(docs: DataFrame, model_file: str, folder: str, end_id: int = 1, special: bool = False, shard_bytes: int = SHARD_BYTES) -> int:
    """Ids of every text of ``docs`` (doc_id, text) into shard files in ``folder``; returns the bytes an id takes.

    Documents ascend by doc_id, nulls first, and equal ids by their texts' hash. Null texts are empty: the
    end id alone. Ids take two bytes where the vocabulary allows, else four. ``special``: whether texts that
    spell a special token mean it.
    """
    from tokenizers import Tokenizer

    model = Path(model_file).read_text(encoding="utf-8")
    width = 2 if Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    end = int(end_id).to_bytes(width, "little")
    if max(end) > 127:
        raise ValueError(f"the bytes of end id {end_id} cannot separate the writer's lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = docs.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = order.repartitionByRange(-(-size // shard_bytes) or 1, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, special)
        ids: list[int | None] = []
        counts: list[int] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for group in _groups(t.as_buffer().to_pybytes() for t in batch.column(1)):
                found = encoder.texts(group) if len(group) > 1 else [encoder.text(group[0])]
                counts += [len(x) + 1 for x in found]
                yield pa.record_batch([pa.array([x.astype(_kind(width)).tobytes() for x in found], pa.binary())], ["value"])
        if ids:
            yield pa.record_batch([pa.array([_directory_bytes(ids, counts)], pa.binary())], ["value"])
        release()

    rows = order.select("doc_id", "text").mapInArrow(encode, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end.decode("ascii")).option("compression", "none").text(folder)
    return width


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, content) of the files in ``folder``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def _listed(width: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, known, counts = directory(memoryview(raw.as_buffer()), width)
                n = len(ids)
                fresh = np.ones(n, bool)
                fresh[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
                begin = np.flatnonzero(fresh)
                run = np.cumsum(fresh) - 1
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, shard)), pa.array(ids, mask=~known), pa.array(np.arange(n) - begin[run]),
                        pa.array((run == 0) | (run == run[-1])), pa.array(np.cumsum(counts) - counts), pa.array(counts),
                    ],
                    ["shard", "doc_id", "occurrence", "edge", "at", "n"],
                )

    return listed


def listing(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(doc_id, occurrence, shard, at, n, start) of every document, from the files' directories.

    ``at`` counts ids in the shard, ``start`` ids in all files; occurrences number the documents of one id
    in file order, over shards as well.
    """
    from pyspark.sql import Window

    schema = "shard long, doc_id long, occurrence long, edge boolean, at long, n long"
    rows = written(shard_files(spark, folder).mapInArrow(_listed(width), schema), "listing")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard, and one for the first and last id of each: few, whatever the documents
    base = rows.groupBy("shard").agg(F.sum("n").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    runs = rows.where("edge").groupBy("shard", "doc_id").agg(F.count("*").alias("own"))
    runs = runs.select(F.col("shard").alias("s"), F.col("doc_id").alias("d"), F.sum("own").over(earlier.partitionBy("doc_id")).alias("carry"))
    rows = rows.join(base, "shard").join(runs.where("carry > 0"), (F.col("shard") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    number = F.col("occurrence") + F.coalesce("carry", F.lit(0))
    return rows.select("doc_id", number.alias("occurrence"), "shard", "at", "n", (F.col("base") + F.col("at")).alias("start"))


# ---------------------------------------------------------------- the index


class PerfectHash:
    """A minimal perfect hash function of distinct 64-bit keys: a level's keys that meet no other take its bit, the rest go on.

    ``slots`` gives each key a number below the count of keys; a foreign key gets one as well, or -1.
    Keys that share all 64 bits find no level and are left to the caller.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.unpackbits(bits, bitorder="little") if len(bits) else np.zeros(0, np.uint8)
        self.rank = np.concatenate([[0], np.cumsum(ones.reshape(-1, 64).sum(axis=1, dtype=np.int64))]) if len(ones) else np.zeros(1, np.int64)
        self.ones = ones

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flags, rest = [], [], keys
        for level in range(LEVELS):
            if not len(rest):
                break
            size = -(-int(SPREAD * len(rest) + 1) // 64) * 64
            place = cls.place(rest, level, size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            rest = rest[~alone[place]]
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(flags), bitorder="little") if flags else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = base + self.place(keys[open_], level, size)
            hit = self.ones[at].astype(bool)
            at, found = at[hit], open_[hit]
            inside = np.arange(64) < (at % 64)[:, None]
            out[found] = self.rank[at // 64] + (self.ones.reshape(-1, 64)[at // 64] * inside).sum(axis=1, dtype=np.int64)
            open_ = open_[~hit]
            base += size
        return out


def _key(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "occurrence")


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(kind, copy=False)


#: Columns of a slot, and their types.
SLOT = {"print": "<u4", "shard": "<i8", "at": "<i8", "n": "<i8", "start": "<i8"}
#: A part of the index: the function, the slots and the keys that share all bits of another (as good as never any).
INDEX = "part long, sizes binary, bits binary, " + ", ".join(f"{c} binary" for c in SLOT) + ", others binary"


def _indexed(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    _let_go()
    keys = _column(table, "key", np.int64).view(np.uint64)
    function = PerfectHash.of(keys)
    slot = function.slots(keys)
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    alone = np.zeros(len(keys), bool)
    alone[first[count == 1]] = True
    alone &= slot >= 0
    row = np.zeros(int(alone.sum()), np.int64)
    row[slot[alone]] = np.flatnonzero(alone)
    cells = {"print": (_column(table, "name", np.int64).view(np.uint64) >> np.uint64(32))}
    cells |= {c: _column(table, c, np.int64) for c in SLOT if c != "print"}
    out = {"part": table.column("part").slice(0, 1).cast(pa.int64()), "sizes": [function.sizes.astype("<i8").tobytes()], "bits": [function.bits.tobytes()]}
    out |= {c: [cells[c].astype(kind)[row].tobytes()] for c, kind in SLOT.items()}
    others = table.filter(pa.array(~alone)).select(["doc_id", "occurrence", "shard", "at", "n", "start"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, others.schema) as stream:
        stream.write_table(others)
    return pa.table(out | {"others": pa.array([sink.getvalue().to_pybytes() if others.num_rows else None], pa.binary())})


def index(entries: DataFrame, part_keys: int = PART_KEYS) -> tuple[DataFrame, int]:
    """The index over ``entries`` (doc_id, occurrence, shard, at, n, start) and the number of its parts."""
    parts = -(-entries.count() // part_keys) or 1
    keyed = entries.withColumns({"name": _key(1), "key": _key(2)}).withColumn("part", F.pmod("name", F.lit(parts)).cast("long"))
    return written(keyed.groupBy("part").applyInArrow(_indexed, INDEX), "index"), parts


LOCATED = "doc_id long, occurrence long, shard long, at long, n long, start long"


def _found(keys: pa.Table, part: pa.Table) -> pa.Table:
    _let_go()
    keys = keys.combine_chunks()
    names = ["shard", "at", "n", "start"]
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "occurrence", *names)])
    if not part.num_rows or not keys.num_rows:
        return schema.empty_table()
    cell = {c: part.column(c)[0].as_py() for c in part.column_names}
    slots = {c: np.frombuffer(cell[c], kind) for c, kind in SLOT.items()}
    function = PerfectHash(np.frombuffer(cell["sizes"], "<i8"), np.frombuffer(cell["bits"], np.uint8))
    slot = function.slots(_column(keys, "key", np.int64).view(np.uint64))
    inside = np.flatnonzero((slot >= 0) & (slot < len(slots["print"])))
    prints = (_column(keys, "name", np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    hit = inside[slots["print"][slot[inside]] == prints[inside]]
    own = keys.select(["doc_id", "occurrence"])
    out = [pa.table([*own.take(pa.array(hit)).columns, *(pa.array(slots[c][slot[hit]]) for c in names)], schema=schema)]
    if cell["others"]:
        asked = {tuple(r.values()) for r in own.to_pylist()}
        rest = pa.ipc.open_stream(cell["others"]).read_all()
        out.append(rest.filter(pa.array([tuple(r.values()) in asked for r in rest.select(["doc_id", "occurrence"]).to_pylist()], pa.bool_())).cast(schema))
    return pa.concat_tables(out)


def locate(found: DataFrame, parts: int, keys: DataFrame) -> DataFrame:
    """(doc_id, occurrence, shard, at, n, start) of those ``keys`` (doc_id, occurrence) that the index knows: one probe a key."""
    keys = keys.select("doc_id", "occurrence").withColumns({"name": _key(1), "key": _key(2)})
    keys = keys.withColumn("part", F.pmod("name", F.lit(parts)).cast("long"))
    return keys.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_found, LOCATED)


def _fetched(width: int, digests: bool):
    def fetched(places: pa.Table, files: pa.Table) -> pa.Table:
        _let_go()
        last = pa.field("ids_crc32", pa.int64()) if digests else pa.field("ids", pa.binary())
        schema = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "occurrence", "start", "n_tokens")], last])
        if not places.num_rows or not files.num_rows:
            return schema.empty_table()
        places = places.combine_chunks()
        raw = memoryview(files.column("content")[0].as_buffer())
        ids, known, counts = directory(raw, width)
        begin = np.cumsum(counts) - counts
        at, n = _column(places, "at", np.int64), _column(places, "n", np.int64)
        doc = np.searchsorted(begin, at)
        absent = places.column("doc_id").is_null().to_numpy()
        own = places.column("doc_id").fill_null(0).to_numpy()
        right = doc < len(ids)
        doc = np.minimum(doc, len(ids) - 1)
        right &= (begin[doc] == at) & (counts[doc] == n) & (known[doc] == ~absent) & (absent | (ids[doc] == own))
        places, at, n = places.filter(pa.array(right)), at[right], n[right]
        cut = (raw[a * width : (a + m) * width] for a, m in zip(at.tolist(), n.tolist(), strict=True))
        if digests:
            found = pa.array([zlib.crc32(np.frombuffer(x, _kind(width)).astype("<u4")) for x in cut], pa.int64())
        else:
            found = pa.array([bytes(x) for x in cut], pa.binary())
        return pa.table([places.column("doc_id"), places.column("occurrence"), places.column("start"), pa.array(n), found], schema=schema)

    return fetched


def fetch(spark: SparkSession, folder: str, width: int, places: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, occurrence, start, n_tokens, ids: bytes in the files' width) read from the shard files at ``places``;
    with ``digests`` ids_crc32 (of the ids as little-endian 32-bit integers) in place of the ids, taken where they are read."""
    files = shard_files(spark, folder)
    schema = "doc_id long, occurrence long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary")
    return places.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(_fetched(width, digests), schema)


def token_shards(docs: DataFrame, model_file: str, end_id: int = 1, special: bool = False) -> DataFrame:
    """Writes ``docs`` as shard files, indexes them and reads every document back by its key.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. A null
    text is empty; documents with a null id come first; equal ids keep a row each, numbered by occurrence,
    in the order of their texts' hashes. A text of any length is one document, tokenised in pieces cut at
    white space. An empty table makes no files and no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "shards")
    width = write_shards(docs, model_file, folder, end_id, special)
    found, parts = index(written(listing(spark, folder, width), "entries"))
    keys = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("occurrence"))
    rows = fetch(spark, folder, width, locate(found, parts, keys), digests=True)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
