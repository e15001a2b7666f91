"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

A text is split into matches of the vocabulary's pattern; each distinct match becomes token-position
rows, one a byte. A recursive query joins neighbouring rows with the merge table and contracts, in every
step and word, the leftmost pair of least rank, until no pair is left. Decoding joins the token positions of
texts with the vocabulary and concatenates by an ordered aggregation, cut at the texts' lengths.

A worker remembers the ids of the words it met lately, so the recursion sees the new words of a partition
rather than its running text. The merge table follows from the rank file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release

#: Words of each of two generations that a worker remembers; rows that one recursion may produce; characters
#: of texts coded at once (a longer text makes a slice of its own); DuckDB's memory in a worker.
REMEMBER, STEP_ROWS, SLICE_CHARS, MEMORY = 160_000, 600_000, 1 << 19, "64MB"
#: Tokens that one query decodes; a longer text is decoded in parts, joined in their order.
DECODE_ROWS = 100_000
#: Words of up to so many bytes contract one pair a step; in longer ones a step contracts every
#: occurrence of the least pair where that provably comes to the same.
SHORT = 32

#: A row's place g is 64 * word + position in the word. Rows come in the order of their places, which one thread
#: keeps from step to step, so neighbours are met without a sort; were they ever not, some row would precede a smaller one.
_STEP = """
WITH RECURSIVE s AS (
    SELECT 0 AS step, word * 64 + pos AS g, tok, false AS done FROM base
    UNION ALL (
        WITH p AS MATERIALIZED (
            SELECT a.step, a.g, a.tok, m.rank, m.rank * 64 + (a.g & 63) AS key,
                   CASE WHEN a.after <= a.g THEN error('rows out of order') ELSE a.after END AS after
            FROM (SELECT *, lead(tok) OVER () AS next, lead(g) OVER () AS after FROM s WHERE NOT done) a
            LEFT JOIN merges m ON a.tok = m.l AND a.next = m.r AND (a.g >> 6) = (a.after >> 6)
        ),
        b AS (SELECT g >> 6 AS word, min(key) AS best, arg_min(after, key) AS gone FROM p GROUP BY g >> 6)
        SELECT step + 1, g, CASE WHEN key = best THEN rank ELSE tok END, best IS NULL
        FROM p JOIN b ON (g >> 6) = word WHERE gone IS NULL OR g <> gone
    )
)
SELECT g >> 6 AS word, g & 63 AS pos, tok, 0 AS step FROM s WHERE done ORDER BY g
"""

#: As above; of the rows whose pair has the word's least rank, those at odd places of a run of
#: neighbours are contracted together if the merged token is safe, else the leftmost alone.
_STEP_LONG = """
WITH RECURSIVE s AS (
    SELECT 0 AS step, word, pos, tok FROM base
    UNION ALL
    SELECT step + 1, word, pos, CASE WHEN chosen THEN rank ELSE tok END
    FROM (
        SELECT *, lag(chosen) OVER (PARTITION BY word ORDER BY pos) AS prev
        FROM (
            SELECT *, coalesce(rank = best AND CASE WHEN safe THEN (row_number() OVER (PARTITION BY word, isle, rank = best ORDER BY pos)) % 2 = 1
                               ELSE pos = first END, false) AS chosen
            FROM (
                SELECT *, i - row_number() OVER (PARTITION BY word, rank = best ORDER BY pos) AS isle,
                       min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY word) AS first
                FROM (
                    SELECT a.*, m.rank, m.safe, min(m.rank) OVER (PARTITION BY a.word) AS best
                    FROM (SELECT *, lead(tok) OVER w AS nxt, row_number() OVER w AS i FROM s WHERE step < {steps}
                          WINDOW w AS (PARTITION BY word ORDER BY pos)) a
                    LEFT JOIN merges m ON a.tok = m.l AND a.nxt = m.r
                )
                WHERE best IS NOT NULL
            )
        )
    )
    WHERE prev IS NULL OR NOT prev
)
SELECT word, pos, tok, step FROM s QUALIFY step = max(step) OVER (PARTITION BY word) ORDER BY word, pos
"""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair that the contraction of a token's own bytes ends with; none if it ends in more tokens."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        found = [ranks.get(a + b, len(ranks) << 32) for a, b in zip(parts, parts[1:], strict=False)]
        k = min(range(len(found)), key=found.__getitem__)
        if found[k] == len(ranks) << 32:
            return None
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder of one vocabulary, with a DuckDB database of its own in memory."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.pattern = regex.compile(pattern)
        left, right, merged, met = [], [], [], []
        for token, rank in self.ranks.items():
            cuts = [cut for cut in range(1, len(token)) if token[:cut] in self.ranks and token[cut:] in self.ranks]
            # within a word the bytes of a pair were contracted as they are alone, so of several pairs of a token one is ever met
            last = last_pair(token, self.ranks) if len(cuts) > 1 else None
            for cut in cuts:
                left.append(self.ranks[token[:cut]]), right.append(self.ranks[token[cut:]]), merged.append(rank)
                met.append(len(cuts) == 1 or (last is not None and len(last[0]) == cut))
        merges = {"l": np.array(left), "r": np.array(right), "rank": np.array(merged)}
        size = max(self.ranks.values(), default=0) + 1
        least = np.full(size, np.iinfo(np.int64).max)
        for side in ("l", "r"):
            np.minimum.at(least, merges[side], merges["rank"])
        # safe: no pair with the merged token ranks below the merge that made it
        merges["safe"] = least[merges["rank"]] > merges["rank"]
        self.merges = pa.table(merges).filter(pa.array(met, pa.bool_()))
        self.vocabulary = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "raw": [t.decode("latin-1") for t in self.ranks]})
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.sizes = np.zeros(size, np.int64)
        self.sizes[list(self.ranks.values())] = list(map(len, self.ranks))
        self.heads = np.zeros(size, np.uint8)
        self.heads[list(self.ranks.values())] = [token[0] for token in self.ranks]
        self.decimal = np.array([str(k) for k in range(size)], object)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.open()

    def open(self) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._table("merges", self.merges)
        self._table("vocabulary", self.vocabulary)

    def rest(self) -> None:
        """Lets go of what the database gathered, at a partition's end: other work follows in this worker."""
        self.db.close()
        self.open()
        release()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as packed 32-bit integers, by contraction to the fixpoint."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end, rows, long = at, 0, len(words[order[at]]) > SHORT
            while end < len(order) and (end == at or rows + len(words[order[end]]) ** 2 <= STEP_ROWS) and (len(words[order[end]]) > SHORT) == long:
                rows += len(words[order[end]]) ** 2 // (1 if long else 2)
                end += 1
            own = order[at:end]
            joined = np.frombuffer(b"".join([words[k] for k in own]), np.uint8)
            sizes = np.array([len(words[k]) for k in own])
            word = np.repeat(np.arange(len(own)), sizes)
            pos = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            state = {"word": word, "pos": pos, "tok": self.byte_ids[joined]}
            steps = max(2, STEP_ROWS // max(1, len(joined)))
            sql = _STEP_LONG.format(steps=steps) if long else _STEP
            while True:
                self._table("base", pa.table({k: state[k] for k in ("word", "pos", "tok")}))
                state = {k: np.asarray(v) for k, v in self.db.execute(sql).fetchnumpy().items()}
                if not long or state["step"].max() < steps:
                    break
            bounds = (4 * np.searchsorted(state["word"], np.arange(len(own) + 1))).tolist()
            packed = state["tok"].astype(np.uint32).tobytes()
            for k, a, b in zip(own, bounds, bounds[1:], strict=False):
                out[k] = packed[a:b]
            at = end
        return out

    def _turn(self) -> None:
        if len(self.recent) > REMEMBER:
            self.older, self.recent = self.recent, {}

    def learn(self, words: set[str]) -> None:
        """Sees to it that all of ``words`` are in the table of recent ones."""
        new = words - self.recent.keys()
        known = new & self.older.keys()
        self.recent.update([(w, self.older[w]) for w in known])
        names = list(new - known)
        raws = [w.encode() for w in names]
        rest = [k for k, raw in enumerate(raws) if raw not in self.ranks]
        self.recent.update((names[k], self.ranks[raw].to_bytes(4, "little")) for k, raw in enumerate(raws) if raw in self.ranks)
        self.recent.update(zip([names[k] for k in rest], self._contract([raws[k] for k in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.pattern.findall(t) for t in texts]
        self._turn()
        self.learn(set().union(*split) if split else set())
        get = self.recent.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in split]

    def decimals(self, ids: np.ndarray) -> str:
        """The decimal ids joined by one space."""
        return " ".join(self.decimal[ids])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids; an id that the vocabulary lacks raises ValueError."""
        sizes = np.array([len(x) for x in ids], np.int64)
        out: list[list[bytes]] = [[] for _ in ids]
        if not sizes.sum():
            return [b""] * len(ids)
        tokens, text = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(len(ids)), sizes)
        if tokens.min() < 0 or tokens.max() >= len(self.sizes):
            raise ValueError("ids that are not in the vocabulary")
        for k in range(0, len(tokens), DECODE_ROWS):
            own, whose = tokens[k : k + DECODE_ROWS], text[k : k + DECODE_ROWS]
            self._table("coded", pa.table({"pos": np.arange(len(own), dtype=np.int32), "tok": own.astype(np.int32)}))
            raw, n = self.db.execute(
                "SELECT string_agg(raw, ''), count(*) FROM (SELECT raw FROM coded JOIN vocabulary USING (tok) ORDER BY pos)"
            ).fetchall()[0]
            self.db.execute("DROP TABLE coded")
            if n < len(own):
                raise ValueError("ids that are not in the vocabulary")
            whole, end = raw.encode("latin-1"), np.cumsum(self.sizes[own])
            # one thread hands the sorted rows on in their order; were it ever not so, tokens would not begin where they have to
            if (np.frombuffer(whole, np.uint8)[end - self.sizes[own]] != self.heads[own]).any():
                raise RuntimeError("rows out of order")
            last = np.append(np.flatnonzero(np.diff(whose)), len(own) - 1)
            for row, a, z in zip(whose[last].tolist(), [0, *end[last[:-1]].tolist()], end[last].tolist(), strict=True):
                out[row].append(whole[a:z])
        return [b"".join(parts) for parts in out]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """This worker's codec of a vocabulary."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    column = batch.column(batch.schema.get_field_index("text"))
    at, size, rows = 0, 0, []
    for k, text in enumerate(column):
        value = text.as_py() or ""
        rows.append(value)
        size += len(value)
        if size >= SLICE_CHARS:
            yield at, rows
            at, size, rows = k + 1, 0, []
    yield at, rows


def encoded(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids.

    A null text counts as empty: no tokens; a null id is kept. Repeated rows are encoded each; an empty table gives an
    empty table; other columns are ignored. Nothing is shuffled. The rank file is read by the driver and broadcast: a
    vocabulary has a fixed size. A text is coded whole, so the longest one bounds a worker's memory.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = codec(shared.value, pattern)
        for batch in batches:
            for at, texts in _slices(batch):
                coded = own.encode(texts)
                plain = own.decode(coded)
                cols = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(ids) for ids in coded], pa.int64()),
                    pa.array([hashlib.sha256(own.decimals(ids).encode()).hexdigest() for ids in coded], pa.string()),
                    pa.array([hashlib.sha256(raw).hexdigest() for raw in plain], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    edges = np.concatenate([[0], np.cumsum([len(ids) for ids in coded])]).astype(np.int32)
                    flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)))
                    names.append("ids")
                yield pa.record_batch(cols, names)
        own.rest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decoded(coded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, raw binary): the bytes of each row's ids; null ids decode to nothing."""
    with open(rank_file, "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids = [np.array(x.as_py() or [], np.int64) for x in batch.column(1).slice(at, 500)]
                yield pa.record_batch([batch.column(0).slice(at, 500), pa.array(own.decode(ids), pa.binary())], ["doc_id", "raw"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")
