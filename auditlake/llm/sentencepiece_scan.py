"""SentencePiece encoding and decoding as a max-plus parallel scan.

Encoding picks the segmentation of a text into pieces of the model's table whose scores add up to most
(the unigram criterion; a character without a piece costs the lowest score less ten and becomes byte
pieces). A text of `chunk` characters or more is cut every `chunk` characters, wherever that falls. A
chunk's boundary state is how many of its first characters a piece from before has already taken, and
the chunk becomes a transfer matrix: best score from each entry state to each exit state. Matrices
combine associatively under (max, +): first within groups of `fan` chunks, then over a document's
groups, and back down, which gives each chunk the best scores of all texts before it, by entry state.

Of segmentations with equal scores the one with the longest last piece counts, then the longest before
it, and so on. So that this doesn't depend on the cuts, each chunk then maps every exit state to the
entry state of that path; the maps combine associatively too, from the end of the text, and give each
chunk its own entry and exit state. Then every chunk is traced back by itself, on whatever executor.
Scores are taken to the nearest 2**-20, so sums are exact and equal scores are equal in any order.

Pieces never hold a word mark after another character, so within a chunk the words between two marks
are independent. A word's pieces are found in one pass over it, and the segmentations of words that
came first are kept in a bounded cache.

The model's file is read on the driver; its pieces, tens of thousands of short strings, go along with
the tasks. Only models without a normalisation table are taken.

Defined results: null text gives null ids, empty text none; decoding gives the text back, but for word
marks (U+2581) in it, which come back as spaces. Rows repeated get the same result each; an empty table gives none; extra columns
stay, ones named like an output column are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm._shared import stored, text_key

MARK, CHUNK, FAN, WORDS = "▁", 1 << 15, 64, 100_000
NEVER, EXACT = -np.inf, 1 << 20


class Known(dict):
    """What `make` gives for a text; that of the first `most` short texts, likelier to come again, is kept."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) < 64 and len(self) < self.most:
            self[text] = found
        return found


class Pieces:
    """The piece table of a model."""

    def __init__(self, table: list[tuple[str, float, str]]):
        """table: piece, score and kind (normal, byte, unknown or other) by id."""
        self.ids = {p: i for i, (p, _, kind) in enumerate(table) if kind == "normal"}
        self.scores = [round(s * EXACT) / EXACT for _, s, _ in table]
        bytes_ = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(table) if kind == "byte"}
        self.bytes = bytes_ if len(bytes_) == 256 else {}
        self.unknown = next((i for i, x in enumerate(table) if x[2] == "unknown"), 0)
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10.0
        # every piece's score, and None for what only begins pieces
        self.begun: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        self.begun.update({p: self.scores[i] for p, i in self.ids.items()})
        self.longest = max(map(len, self.ids))
        self.cuts = not any(MARK in p[i:] and p[i - 1] != MARK for p in self.ids for i in range(1, len(p)) if p[i] == MARK)
        self.known = {c for p in self.ids for c in p}
        other = "".join(map(re.escape, sorted(self.known - {MARK})))
        # words, or stretches of known characters; a character that no piece holds is a part of its own
        self.parts = re.compile(f"{MARK}+[{other}]*|[{other}]+|[^{other}{MARK}]" if self.cuts else f"[{other}{MARK}]+|[^{other}{MARK}]", re.S)
        decoded = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in bytes_.items()}
        out = [decoded.get(i, " ⁇ ".encode() if i == self.unknown else b"") for i in range(len(table))]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        # what an id adds to a score; of an unknown character's bytes the first adds it
        self.weights = np.array(self.scores)
        self.weights[[self.unknown, *self.bytes.values()]] = self.unknown_score
        self.weights[[i for b, i in self.bytes.items() if b & 0xC0 == 0x80]] = 0.0
        # every piece's length, score and id, and those of known characters without a piece, found in a text in one pass
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matches.add_word(p, (len(p), self.scores[i], np.int32(i).tobytes()))
        for c in self.known - self.ids.keys():
            self.matches.add_word(c, (1, self.unknown_score, self._unknown_ids(c)))
        self.matches.make_automaton()
        self.words = Known(self._segment, WORDS)

    @staticmethod
    def load(path: str) -> list[tuple[str, float, str]]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ﬁ") not in (f"{MARK}{MARK}a{MARK}{MARK}ﬁ",):
            raise ValueError(f"{path}: models that normalise text aren't supported")
        kind = lambda i: "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unused(i) else "normal"
        return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]

    def edges(self, text: str, at: int) -> list[tuple[int, float, str]]:
        """Ends of the pieces that start at a place, with scores."""
        out, begun = [], self.begun
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            piece = text[at:end]
            if piece not in begun:
                break
            if (score := begun[piece]) is not None:
                out.append((end, score, piece))
        return out if out and out[0][0] == at + 1 else [(at + 1, self.unknown_score, text[at]), *out]

    def _segment(self, text: str) -> bytes:
        """Ids of text, best score first by its end; matches come with the longest first, and one of a character always."""
        if text[0] not in self.known:
            return self._unknown_ids(text)
        best, last = [0.0] + [NEVER] * len(text), [None] * (len(text) + 1)
        for end, match in self.matches.iter(text):
            end += 1
            score = best[end - match[0]] + match[1]
            if score > best[end]:
                best[end], last[end] = score, match
        ids, at = [], len(text)
        while at:
            ids.append(last[at][2])
            at -= last[at][0]
        return b"".join(ids[::-1])

    def _unknown_ids(self, char: str) -> bytes:
        return np.array([self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown], np.int32).tobytes()

    def encode(self, marked: str) -> tuple[float, bytes]:
        """Score and ids (int32) of marked text."""
        ids = b"".join(map(self.words.__getitem__, self.parts.findall(marked)))
        return float(self.weights[np.frombuffer(ids, np.int32)].sum()), ids

    def _spread(self, text: str, a: int, b: int, start: np.ndarray) -> np.ndarray:
        """Best scores (place - a, column of start) after all pieces that start in a..b; start: those at the first places."""
        best = np.full((len(text) + 1 - a, start.shape[1]), NEVER)
        best[: len(start)] = start[: len(best)]
        for at in range(a, b):
            if np.isneginf(best[at - a]).all():
                continue
            for end, score, _ in self.edges(text, at):
                np.maximum(best[end - a], best[at - a] + score, out=best[end - a])
        return best

    def _marks(self, text: str, n: int) -> list[int]:
        """Places of a chunk of n characters that every path goes through, whatever its entry."""
        found = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text[: n + 1])] if self.cuts else []
        return [m for m in found if self.longest - 1 <= m <= n]

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Matrix of best scores from state s to state t of a chunk of n characters; text goes on after them."""
        size = self.longest
        enter = np.full((size, size), NEVER)
        np.fill_diagonal(enter, 0.0)
        inner = self._marks(text, n)
        if not inner:
            best = self._spread(text, 0, n, enter)
        else:
            head = self._spread(text[: inner[0]], 0, inner[0], enter)[inner[0]]
            middle = self.encode(text[inner[0] : inner[-1]])[0]
            tail = self._spread(text, inner[-1], n, np.zeros((1, 1)))[:, 0]
            best = np.full((len(text) + 1, size), NEVER)
            best[inner[-1] :] = head[None, :] + middle + tail[:, None]
        out = np.full((size, size), NEVER)
        ends = best[n : n + size]
        out[:, : len(ends)] = ends.T
        return out

    def entries(self, text: str, n: int, before: np.ndarray) -> np.ndarray:
        """For each exit state the entry state of the path that counts, with the best scores before the chunk by entry state."""
        size, inner = self.longest, self._marks(text, n)
        stop = inner[0] if inner else n
        if inner:
            text = text[:stop]
        best = self._spread(text, 0, stop, np.asarray(before, float)[:, None])[:, 0]
        back = {}
        for at in range(stop):
            if best[at] > NEVER:
                for end, score, _ in self.edges(text, at):
                    if end not in back and best[at] + score == best[end]:  # the first is the longest piece
                        back[end] = at
        # a place among the first that is best reached by entering there is an entry; a longer piece from before goes first
        def entry(place: int) -> int:
            while place in back and not (place < size and before[place] == best[place]):
                place = back[place]
            return place if place < size else 0

        if inner:
            return np.full(size, entry(stop), np.int32)
        return np.array([entry(n + z) if n + z < len(best) and best[n + z] > NEVER else 0 for z in range(size)], np.int32)


_LOADED: dict[int, Pieces] = {}


def _pieces(table: list[tuple[str, float, str]]) -> Pieces:
    """The table's pieces; a worker process keeps those of its last model, and their cache, from task to task."""
    key = hash(tuple(table))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(table)
    return _LOADED[key]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def reached(before: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Best scores by state before each of the matrices in a row."""
    out = [before]
    for m in matrices[:-1]:
        out.append((out[-1][:, None] + m).max(axis=0))
    return out


def composed(maps: list[np.ndarray]) -> np.ndarray:
    """Maps from exit to entry states in a row, as one: the last is applied first."""
    out = maps[-1]
    for m in maps[-2::-1]:
        out = m[out]
    return out


def walked(maps: list[np.ndarray], exit_: int) -> list[tuple[int, int]]:
    """Entry and exit state of each, from the exit state of the last."""
    out = []
    for m in maps[::-1]:
        out.append((int(m[exit_]), exit_))
        exit_ = int(m[exit_])
    return out[::-1]


def _marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _matrix(x: bytes, size: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(size, size)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """docs plus ids (array of int) and token_score (double, the pieces' scores added up)."""
    table = Pieces.load(model)
    size = Pieces(table).longest
    docs = docs.drop("ids", "token_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("token_score", T.DoubleType())])

    def listed(found: list) -> list[pa.Array]:
        ids = [None if x is None else np.frombuffer(x[1], np.int32) for x in found]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else x[0] for x in found], pa.float64())]

    def whole(batches):
        pieces = _pieces(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [None if t is None else pieces.encode(_marked(t)) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *listed(found)], [f.name for f in schema])

    text = F.col(text_col)
    known_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))  # equal texts have equal results anyway
    giant = F.coalesce(F.length(text) >= chunk, F.lit(False))
    small = docs.where(~giant).mapInArrow(whole, schema)

    large = docs.where(giant).select(known_id.alias("id"), text_key(text).alias("key"), F.concat(F.lit(MARK), F.translate(text, " ", MARK)).alias("text")).dropDuplicates(["id", "key"])

    def cut(batches):
        for batch in batches:
            for id_, key, t in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text"))):
                for k, at in enumerate(range(0, len(t), chunk)):
                    yield pa.RecordBatch.from_pydict({"id": [id_], "key": [key], "k": pa.array([k], pa.int32()), "g": pa.array([k // fan], pa.int32()), "text": [t[at : at + chunk + size - 1]], "n": pa.array([min(chunk, len(t) - at)], pa.int32())})

    chunks = stored(large.mapInArrow(cut, "id long, key long, k int, g int, text string, n int").repartition("id", "key", "k"))

    def transfer(batches):
        pieces = _pieces(table)
        for batch in batches:
            made = [pieces.transfer(t, n).tobytes() for t, n in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "k", "g")), pa.array(made, pa.binary())], ["id", "key", "k", "g", "m"])

    def combine(rows: pa.Table) -> pa.Table:
        got = sorted(zip(rows.column("k").to_pylist(), rows.column("m").to_pylist()))
        total = _matrix(got[0][1], size)
        for _, m in got[1:]:
            total = product(total, _matrix(m, size))
        return pa.table([rows.column(c).slice(0, 1) for c in ("id", "key", "g")] + [pa.array([total.tobytes()], pa.binary())], ["id", "key", "g", "m"])

    def each(rows: pa.Table, by: str, columns: dict[str, pa.Array]) -> pa.Table:
        """Rows of one document: its key, the sorted numbers of its groups or chunks, and columns."""
        numbers = pa.array(sorted(rows.column(by).to_pylist()), pa.int32())
        same = lambda c: pa.array([rows.column(c)[0].as_py()] * len(numbers), pa.int64())
        return pa.table([same("id"), same("key"), numbers, *columns.values()], ["id", "key", by, *columns])

    def in_order(rows: pa.Table, by: str, column: str, read) -> list[np.ndarray]:
        return [read(x) for _, x in sorted(zip(rows.column(by).to_pylist(), rows.column(column).to_pylist()))]

    matrix, vector, map_ = lambda x: _matrix(x, size), lambda x: np.frombuffer(x, np.float64), lambda x: np.frombuffer(x, np.int32)
    blobs = lambda found: pa.array([x.tobytes() for x in found], pa.binary())
    start = np.full(size, NEVER)
    start[0] = 0.0

    def before_groups(rows: pa.Table) -> pa.Table:
        return each(rows, "g", {"before": blobs(reached(start, in_order(rows, "g", "m", matrix)))})

    def before_chunks(rows: pa.Table, group: pa.Table) -> pa.Table:
        return each(rows, "k", {"before": blobs(reached(vector(group.column("before")[0].as_py()), in_order(rows, "k", "m", matrix)))})

    def entries(batches):
        pieces = _pieces(table)
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("text", "n", "before")))
            found = [pieces.entries(t, n, vector(b)) for t, n, b in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "k", "g")), blobs(found)], ["id", "key", "k", "g", "map"])

    def compose(rows: pa.Table) -> pa.Table:
        return pa.table([rows.column(c).slice(0, 1) for c in ("id", "key", "g")] + [blobs([composed(in_order(rows, "k", "map", map_))])], ["id", "key", "g", "map"])

    def out_of_groups(rows: pa.Table) -> pa.Table:
        return each(rows, "g", {"leave": pa.array([z for _, z in walked(in_order(rows, "g", "map", map_), 0)], pa.int32())})

    def out_of_chunks(rows: pa.Table, group: pa.Table) -> pa.Table:
        path = walked(in_order(rows, "k", "map", map_), group.column("leave")[0].as_py())
        return each(rows, "k", {"enter": pa.array([a for a, _ in path], pa.int32()), "leave": pa.array([z for _, z in path], pa.int32())})

    def trace(batches):
        pieces = _pieces(table)
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("text", "n", "enter", "leave")))
            found = [pieces.encode(t[a : n + z]) for t, n, a, z in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "k")), *listed(found)], ["id", "key", "k", "ids", "score"])

    matrices = stored(chunks.mapInArrow(transfer, "id long, key long, k int, g int, m binary"))
    by_group = lambda df: df.groupBy("id", "key", "g")
    groups = by_group(matrices).applyInArrow(combine, "id long, key long, g int, m binary").groupBy("id", "key").applyInArrow(before_groups, "id long, key long, g int, before binary")
    before = by_group(matrices).cogroup(by_group(groups)).applyInArrow(before_chunks, "id long, key long, k int, before binary")
    maps = stored(chunks.join(before, ["id", "key", "k"]).mapInArrow(entries, "id long, key long, k int, g int, map binary"))
    exits = by_group(maps).applyInArrow(compose, "id long, key long, g int, map binary").groupBy("id", "key").applyInArrow(out_of_groups, "id long, key long, g int, leave int")
    placed = by_group(maps).cogroup(by_group(exits)).applyInArrow(out_of_chunks, "id long, key long, k int, enter int, leave int")
    traced = chunks.join(placed, ["id", "key", "k"]).mapInArrow(trace, "id long, key long, k int, ids array<int>, score double")
    parts = traced.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"), F.sum("score").alias("token_score"))
    back = parts.select(F.col("id").alias("_i"), F.col("key").alias("_k"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), "token_score")
    keyed = docs.where(giant).withColumns({"_id": known_id, "_key": text_key(text)})
    joined = keyed.join(back, (F.col("_id") == F.col("_i")) & (F.col("_key") == F.col("_k"))).drop("_id", "_key", "_i", "_k")
    return small.unionByName(joined)


def decode_documents(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """encoded with its ids replaced by decoded (string)."""
    table = Pieces.load(model)
    encoded = encoded.drop("decoded")
    rest = [f for f in encoded.schema.fields if f.name != ids_col]
    schema = T.StructType([*rest, T.StructField("decoded", T.StringType())])

    def run(batches):
        pieces = _pieces(table)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                ids = batch.column(ids_col)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                size = pieces.out_size[flat]
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = pieces.out[np.repeat(pieces.out_at[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
                valid = ids.is_valid().to_pylist()
                texts = [raw[a:z].removeprefix(b" ").decode("utf-8", "replace") if ok else None for a, z, ok in zip(cuts, cuts[1:], valid)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string())], [f.name for f in schema])

    return encoded.mapInArrow(run, schema)
