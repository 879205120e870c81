"""Language-model scores from a hierarchical Pitman-Yor model whose restaurants are seated by Gibbs sampling.

A word's restaurant is a class of the word before it: 256 classes by hash within each last byte, 65,536 in
all. Its parent is the last byte, whose parent is the one restaurant of all words, whose base gives each of
the V known words and the one unknown word the same share. The cells, a word in a restaurant, grow with the
corpus; the restaurants' totals don't. Customers of a restaurant are the training tokens (or the tables of
its children) that order a word.

A sweep reseats the customers of every cell, one after another, by the restaurant process given everyone
else's seats as the sweep before left them: its own tables leave the restaurant and the parent first, and
the next customer opens a table with probability weight / (weight + seated - discount * tables), where
weight is (strength + discount * the restaurant's tables) times the parent's probability, both counting
the tables opened so far. After every sweep the totals are summed over all cells
again, so that each state's predictive probabilities add up to one; those of `sweeps` states after `burn`
ones are averaged.

The work goes by pages (up to about 4 MB of documents in one compressed row) and by buckets of words. Each
page sends its distinct (word, context) pairs with their training counts to the words' buckets (see
`_exchange`), so a word in every text is at most one entry for each context and page. A bucket holds all
contexts of its words; its cells and seats are one row of a stored table that the sweeps rewrite. At the
end the buckets answer the pages' pairs with log10 probabilities, as 32-bit floats; counts are 64-bit. Words go as 64-bit
hashes. Random draws depend on the bucket and the sweep only, so a task that runs again gives the same.

Defined results: null and empty texts hold their end token only; null ids are learned from and not held
out; rows repeated are each counted and scored; texts of any length are scored whole; nothing is ranked, so
there are no ties; an empty table gives none; columns other than id and text don't reach the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditlake.llm._exchange import ROWS, Exchange, Segments, unzip, zip_
from auditlake.llm._hashing import SPACE, word_hashes
from auditlake.llm._shared import stored
from auditlake.llm.substring_dedup import PAGES, _page_rows
from auditlake.llm.toxicity import fold

PAGE_BYTES, BUCKET_BYTES, FAN = 4 << 20, 6 << 20, 4096
CONTEXTS, PARENTS = 1 << 16, 1 << 8
END = np.uint64(0x5EED5EED5EED5EED)
SENT, BACK = ("<u8", "<u4", "<u2", "<u4"), ("<f4", "<u8")
CELLS = "bucket long, words binary, lens binary, contexts binary, counts binary, seats array<binary>, totals binary"
_CELLS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("words", "lens", "contexts", "counts")), ("seats", pa.list_(pa.binary())), ("totals", pa.binary())])
# places of the shared totals: customers and tables of all restaurants by level, cells with one and two customers by level, tokens, words
SIZES = (CONTEXTS, PARENTS, 1)
AT = np.cumsum([0, *SIZES, *SIZES, 3, 3, 1, 1])


class _Tokens:
    """A page's tokens and its distinct (word, context) pairs, in order of bucket, word and context."""

    def __init__(self, rows: bytes, buckets: int):
        self.table = pa.ipc.open_stream(rows).read_all()
        held = np.array(self.table.column("held").to_pylist(), bool)
        words, contexts, self.n = [], [], []
        for text in self.table.column("text").to_pylist():
            raw = (text or "").encode().lower()
            data = np.frombuffer(raw, np.uint8)
            inside = ~SPACE[data]
            last = data[inside & ~np.append(inside[1:], False)] if len(data) else data
            found = word_hashes(raw)
            words += [found, [END]]
            contexts += [[0], (last.astype(np.int64) << 8) | (found & np.uint64(0xFF)).astype(np.int64)]
            self.n.append(len(found) + 1)
        tokens = np.concatenate([np.zeros(0, np.uint64), *words])
        self.doc = np.repeat(np.arange(len(held)), self.n)
        distinct, of = np.unique(tokens, return_inverse=True)
        bucket = ((distinct >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.bucket, self.token_word = distinct[order], bucket[order], rank[of]
        pairs, self.of = np.unique(self.token_word * CONTEXTS + np.concatenate([np.zeros(0, np.int64), *contexts]).astype(np.int64), return_inverse=True)
        self.word, self.context = pairs // CONTEXTS, pairs % CONTEXTS
        self.count = np.bincount(self.of, ~held[self.doc], len(pairs))

    def sent(self, page: int) -> Segments:
        to, words = np.unique(self.bucket, return_counts=True)
        pairs = np.diff(np.searchsorted(self.word, np.concatenate([[0], np.cumsum(words)])))
        lens = np.bincount(self.word, minlength=len(self.words))
        columns = [self.words, lens.astype(SENT[1]), self.context.astype(SENT[2]), self.count.astype(SENT[3])]
        return Segments(np.full(len(to), page), to, np.stack([words, words, pairs, pairs], axis=1), columns)


def seat(customers: np.ndarray, own: np.ndarray, above: np.ndarray, size: np.ndarray, discount: float, rng: np.random.Generator, fine: int = 32) -> np.ndarray:
    """Tables after seating each cell's customers, all of one dish, one after another.

    A customer after i others at t tables opens a table with probability w / (w + i - discount * t), where
    w = (own + discount * t) * (above + t) / (size + t): the restaurant's strength with its other cells'
    tables and the new ones, times the parent's probability, in which every table opened here is one
    customer more. Up to twice `fine` customers are drawn one by one; of more, a `fine`-th of those seated
    are drawn at once, with the weights that hold before them, so hot cells cost the logarithm of their size.
    """
    tables, live = (customers > 0).astype(np.int64), np.flatnonzero(customers > 1)
    n, a, b, z, t, seated = customers[live], own[live], above[live], size[live], np.ones(len(live), np.int64), 1
    while len(live):
        w, lost = (a + discount * t) * (b + t) / (z + t), discount * t
        share = w / (w + seated - lost)
        t = t + (rng.random(len(live)) < share if seated < 2 * fine else rng.binomial(np.minimum(seated // fine, n - seated), share))
        seated += max(1, seated // fine)
        more = n > seated
        if not more.all():
            tables[live[~more]] = t[~more]
            live, n, a, b, z, t = (x[more] for x in (live, n, a, b, z, t))
    return tables


class _Restaurants:
    """All cells of a bucket's words, with the ways from a cell to its parents."""

    def __init__(self, row: dict):
        lens = unzip(row["lens"], "<u4")
        self.words, self.u2, self.c2 = unzip(row["words"], "<u8"), unzip(row["contexts"], "<u2").astype(np.int64), unzip(row["counts"], "<u8").astype(np.int64)
        self.word = np.repeat(np.arange(len(lens)), lens)
        parent = self.u2 // (CONTEXTS // PARENTS)
        new = np.ones(len(parent), bool)  # cells are in order of word and context, so a parent's cells stand together
        new[1:] = (self.word[1:] != self.word[:-1]) | (parent[1:] != parent[:-1])
        self.up1, self.up0, self.u1 = np.cumsum(new) - 1, self.word[new], parent[new]
        self.seen = np.bincount(self.word, self.c2, len(lens)).astype(np.int64)  # training count of each word

    def first(self) -> tuple:
        """One table a cell."""
        t2 = (self.c2 > 0).astype(np.int64)
        t1 = (self.customers1(t2) > 0).astype(np.int64)
        return t2, t1, (self.customers0(t1) > 0).astype(np.int64)

    def customers1(self, t2: np.ndarray) -> np.ndarray:
        return np.bincount(self.up1, t2, len(self.u1)).astype(np.int64)

    def customers0(self, t1: np.ndarray) -> np.ndarray:
        return np.bincount(self.up0, t1, len(self.seen)).astype(np.int64)

    def totals(self, seats: tuple) -> np.ndarray:
        t2, t1, t0 = seats
        c1, c0 = self.customers1(t2), self.customers0(t1)
        levels = ((self.c2, self.u2), (c1, self.u1), (c0, np.zeros(len(c0), np.int64)))
        by = lambda x, u, size: np.bincount(u, x, size)
        parts = [by(c, u, size) for (c, u), size in zip(levels, SIZES)] + [by(t, u, size) for t, (_, u), size in zip(seats, levels, SIZES)]
        parts += [[(c == k).sum() for c, _ in levels] for k in (1, 2)] + [[self.c2.sum()], [(self.seen > 0).sum()]]
        return np.concatenate(parts).astype(np.int64)

    def predictive(self, seats: tuple, shared: "_Shared") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the cells, of their parents' cells and of the words, by seats and totals of one state."""
        t2, t1, t0 = seats
        d2, d1, d0 = shared.discount
        (c_2, c_1, c_0), (t_2, t_1, t_0), s = shared.customers, shared.tables, shared.strength
        p0 = (self.customers0(t1) - d0 * t0 + (s + d0 * t_0) * shared.base) / (s + c_0)
        p1 = (self.customers1(t2) - d1 * t1 + (s + d1 * t_1[self.u1]) * p0[self.up0]) / (s + c_1[self.u1])
        return (self.c2 - d2 * t2 + (s + d2 * t_2[self.u2]) * p1[self.up1]) / (s + c_2[self.u2]), p1, p0

    def reseat(self, seats: tuple, shared: "_Shared", rng: np.random.Generator) -> tuple:
        """All cells anew, from the lowest level up. Each leaves its parent first and is seated given everyone else's seats of before."""
        (t2, t1, t0), (d2, d1, d0), (_, c_1, c_0), (t_2, t_1, t_0), s = seats, shared.discount, shared.customers, shared.tables, shared.strength

        def put(at, customers, others, tables, d, upper, d_up, upper_tables, spread, size):
            """Tables of cells, anew at the places where they aren't sure."""
            # the parent's probability is (customers - discount * tables + spread) / size, here without this cell's tables
            rest = np.maximum(upper - tables[at], 0)
            above = np.maximum(rest - d_up * np.minimum(upper_tables, rest), 0) + spread
            out = (customers > 0).astype(np.int64)
            out[at] = seat(customers[at], s + d * (others - tables[at]), above, np.maximum(size - tables[at], s), d, rng)
            return out

        c1, c0 = self.customers1(t2), self.customers0(t1)
        p0 = (c0 - d0 * t0 + (s + d0 * t_0) * shared.base) / (s + c_0)
        at = np.flatnonzero(self.c2 > 1)
        up, u = self.up1[at], self.u1[self.up1[at]]
        n2 = put(at, self.c2, t_2[self.u2[at]], t2, d2, c1[up], d1, t1[up], (s + d1 * t_1[u]) * p0[self.up0[up]], s + c_1[u])
        c1 = self.customers1(n2)
        at = np.flatnonzero(c1 > 1)
        up, same = self.up0[at], np.ones(len(at))
        n1 = put(at, c1, t_1[self.u1[at]], t1, d1, c0[up], d0, t0[up], (s + d0 * t_0) * shared.base * same, (s + c_0) * same)
        # the base is a fixed distribution: its probability doesn't change with the tables
        big = 1e18
        n0 = seat(self.customers0(n1), s + d0 * (t_0 - t0), np.full(len(t0), shared.base * big), np.full(len(t0), big), d0, rng)
        return n2, n1, n0


class _Shared:
    """What all buckets share: totals of one state, discounts, strength and the base probability."""

    def __init__(self, totals: np.ndarray, strength: float, discount: tuple[float, ...] | None = None):
        parts = [totals[a:b].astype(float) for a, b in zip(AT, AT[1:])]
        scalar = lambda x: x[0] if len(x) == 1 else x
        self.customers, self.tables, self.strength = [scalar(x) for x in parts[:3]], [scalar(x) for x in parts[3:6]], strength
        self.n_train, self.n_words = int(parts[8][0]), int(parts[9][0])
        self.base = 1 / (self.n_words + 1)
        one, two = parts[6], parts[7]
        self.discount = discount or tuple(min(0.95, max(0.05, a / max(1.0, a + 2 * b))) if a else 0.5 for a, b in zip(one, two))


def _zipped(seats: tuple) -> bytes:
    return zip_(np.concatenate(seats).astype("<u8"))


def _seats(x: bytes, rest: _Restaurants) -> tuple:
    return tuple(np.split(unzip(x, "<u8").astype(np.int64), np.cumsum([len(rest.c2), len(rest.u1)])))


def _summed(cells: DataFrame) -> np.ndarray:
    """Totals over all buckets; the driver gets one number a place, whatever the input."""

    def part(batches):
        total = np.zeros(AT[-1], np.int64)
        for batch in batches:
            for x in batch.column("totals").to_pylist():
                total += unzip(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    out = np.zeros(AT[-1], np.int64)
    for r in cells.select("totals").mapInArrow(part, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def sample(cells: DataFrame, strength: float, burn: int, sweeps: int) -> tuple[DataFrame, list[_Shared]]:
    """cells with the seats of `sweeps` states, and each state's totals."""
    shared, kept = _Shared(_summed(cells), strength), []
    for s in range(burn + sweeps):

        def sweep(batches, shared=shared, s=s):
            for batch in batches:
                for row in batch.to_pylist():
                    rest, rng = _Restaurants(row), np.random.default_rng([row["bucket"], s])
                    before = row["seats"][-1]
                    now = rest.reseat(_seats(before, rest), shared, rng)
                    row["seats"] = [*(row["seats"] if s > burn else []), _zipped(now)]
                    row["totals"] = zip_(rest.totals(now))
                    yield pa.RecordBatch.from_pylist([row], schema=_CELLS)

        cells = stored(cells.mapInArrow(sweep, CELLS), instead_of=cells)
        shared = _Shared(_summed(cells), strength, shared.discount)
        if s >= burn:
            kept.append(shared)
    return cells, kept


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held: int = 2,
    strength: float = 1.0,
    burn: int = 2,
    sweeps: int = 3,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity."""
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), F.col(text_col).alias("text"), F.coalesce(fold(id_, folds) == held, F.lit(False)).alias("held"))
    pages = stored(rows.mapInArrow(lambda it: _page_rows(it, "text", PAGE_BYTES), PAGES))
    size, n_pages = pages.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ways = Exchange(n_pages, max(1, math.ceil(size / BUCKET_BYTES)), FAN)

    def send(batches):
        for batch in batches:
            for page, rows in zip(batch.column("page").to_pylist(), batch.column("rows").to_pylist()):
                yield ways.sent(_Tokens(rows, ways.buckets).sent(page))

    def gather(table: pa.Table) -> pa.Table:
        """A bucket's cells from what the pages sent, with one table each."""
        s = Segments.read(table, SENT)
        words, of = np.unique(s.columns[0], return_inverse=True)
        cells, at = np.unique(np.repeat(of, s.columns[1]) * CONTEXTS + s.columns[2], return_inverse=True)
        row = {"bucket": table.column("to")[0].as_py(), "words": zip_(words), "lens": zip_(np.bincount(cells // CONTEXTS, minlength=len(words)).astype("<u4")),
               "contexts": zip_((cells % CONTEXTS).astype("<u2")), "counts": zip_(np.bincount(at, s.columns[3], len(cells)).astype("<u8"))}
        rest = _Restaurants(row)
        row |= {"seats": [_zipped(rest.first())], "totals": zip_(rest.totals(rest.first()))}
        return pa.Table.from_pylist([row], schema=_CELLS)

    grouped = ways.forward(pages.select("page", "rows").mapInArrow(send, ROWS), SENT).groupBy("to")
    cells, states = sample(stored(grouped.applyInArrow(gather, CELLS)), strength, burn, sweeps)
    n_train, n_words = states[0].n_train, states[0].n_words

    def answer(sent: pa.Table, known: pa.Table) -> pa.Table:
        s, row = Segments.read(sent, SENT), known.to_pylist()[0]
        rest = _Restaurants(row)
        mean = sum(rest.predictive(_seats(x, rest), state)[0] for x, state in zip(row["seats"], states)) / len(states)
        logs = np.log10(mean).astype(BACK[0])
        of = np.searchsorted(rest.words, s.columns[0])
        cell = np.searchsorted(rest.word * CONTEXTS + rest.u2, np.repeat(of, s.columns[1]) * CONTEXTS + s.columns[2])
        back = Segments(s.pages, s.buckets, s.lens[:, [2, 0]], [logs[cell], rest.seen[of].astype(BACK[1])])
        return pa.Table.from_batches([ways.answered(back)])

    schema = T._parse_datatype_string(f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    arrow = to_arrow_schema(schema)

    def finish(left: pa.Table, back: pa.Table) -> pa.Table:
        out, s = [], Segments.read(back, BACK)
        s = s.taken(np.argsort(s.buckets, kind="stable"))
        for rows in left.column("rows").to_pylist():
            p = _Tokens(rows, ways.buckets)
            logs, seen = s.columns[0].astype(np.float64), s.columns[1].astype(np.float64)[p.token_word]
            n = len(p.n)
            score = np.bincount(p.doc, logs[p.of], n)
            plain = np.bincount(p.doc, np.log10((seen + 1) / (n_train + n_words + 1)), n)
            counts = np.array(p.n, np.int64)
            out.append(pa.table(
                [p.table.column("id"), p.table.column("held"), pa.array(counts), pa.array(np.bincount(p.doc, seen > 0, n).astype(np.int64)), pa.array([n_train] * n, pa.int64()),
                 pa.array(plain), pa.array(score), pa.array(10 ** np.minimum(-score / counts, 300))], names=[f.name for f in schema],
            ).cast(arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    answers = ways.back(grouped.cogroup(cells.groupBy("bucket")).applyInArrow(answer, ROWS), BACK)
    return pages.select("page", "rows").groupBy("page").cogroup(answers.groupBy("to")).applyInArrow(finish, schema)
