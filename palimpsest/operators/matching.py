"""Which terms and fragments of a table of queries rows have, and each query's best rows, inside the tasks that read the rows.

`numbered` puts the numbers of the terms that a row has in place of its texts, so that what follows is narrow; `best` scores
the rows for all queries and keeps a task's k best of each, so that no pair of query and row is shuffled or sorted but those.
The table of queries, not that of rows, goes through the driver to every task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Letters by which terms are looked up in words; shorter terms by all of theirs.
LETTERS = 3
#: Cells of rows and queries that are scored at once, rows kept before they are cut to the best, words whose terms are remembered.
CELLS, KEPT, REMEMBERED = 4_000_000, 200_000, 500_000
#: Hundredths for a term and for a fragment that a row's kind, file, module and path have; 40 at most.
WEIGHTS = {"kind": (8, 10), "file": (8, 10), "module": (6, 8), "path": (4, 6)}


class Asked:
    """Queries with their distinct words and fragments, both numbered over all queries."""

    def __init__(self, queries: list[tuple], key: DataType, terms: list[str] | None = None, fragments: list[str] | None = None):
        self.queries, self.key = queries, key
        self.terms = terms if terms is not None else sorted({w for _, words, _ in queries for w in words})
        self.fragments = fragments if fragments is not None else sorted({f for *_, found in queries for f in found})
        self.n_terms = np.array([len(words) for _, words, _ in queries], dtype=np.int64)

    @classmethod
    def of(cls, queries: DataFrame) -> Asked:
        """queries: query_id, words, fragments."""
        return cls([tuple(r) for r in queries.select("query_id", "words", "fragments").orderBy("query_id").collect()], queries.schema["query_id"].dataType)

    def without(self, left_out: list[str]) -> Asked:
        """The same without some words and fragments; the others keep their numbers."""
        keep = lambda items: [x for x in items if x not in left_out]
        return Asked([(i, keep(words), keep(found)) for i, words, found in self.queries], self.key, self.terms, self.fragments)

    def links(self, of: int) -> tuple[np.ndarray, np.ndarray]:
        """For terms (1) or fragments (2): where each one's queries start, and the queries by their place."""
        names = self.terms if of == 1 else self.fragments
        number = {x: i for i, x in enumerate(names)}
        pairs = sorted((number[x], q) for q, row in enumerate(self.queries) for x in row[of])
        item, query = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)
        return np.searchsorted(item, np.arange(len(names) + 1)), query


class Lookup:
    """The terms that a word has as parts; one of digits alone has no digit next to it."""

    def __init__(self, terms: list[str]):
        self.terms, self.known, self.by = terms, {}, defaultdict(list)
        self.number = {t: i for i, t in enumerate(terms)}
        for i, t in enumerate(terms):
            self.by[t[:LETTERS]].append(i)

    def has(self, text: str, term: str) -> bool:
        return term in text and (not re.fullmatch("[0-9]+", term) or re.search(f"(?<![0-9]){term}(?![0-9])", text) is not None)

    def held(self, word: str) -> list[int]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            keys = {word[i : i + n] for n in range(1, LETTERS + 1) for i in range(len(word) - n + 1)} & self.by.keys()
            found = self.known[word] = [t for k in keys for t in self.by[k] if self.has(word, self.terms[t])]
        return found


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """Values as one list for each of n rows; row ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(value.astype(np.int32)))


def _distinct(row: np.ndarray, value: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(row * max(1, base) + value, return_counts=True)
    return key // max(1, base), key % max(1, base), n


def _words(words: pa.Array, lookup: Lookup) -> tuple[tuple, tuple]:
    """(row, term, 1) of the terms that are part of a row's words, and (row, term, times) of those that are one of its words."""
    parent = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    names = coded.dictionary.to_pylist()
    row, word, times = _distinct(parent, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names))
    held = [lookup.held(w) for w in names]
    size, own = np.array([len(h) for h in held] or [0]), np.array([lookup.number.get(w, -1) for w in names] or [-1])
    start, flat = np.concatenate([[0], np.cumsum(size)]), np.array([t for h in held for t in h], dtype=np.int64)
    some, itself = size[word] > 0 if len(word) else np.zeros(0, bool), own[word] >= 0 if len(word) else np.zeros(0, bool)
    parts = _distinct(np.repeat(row[some], size[word[some]]), flat[_spans(start[word[some]], size[word[some]])], len(lookup.terms))
    order = np.lexsort((own[word[itself]], row[itself]))
    return parts, (row[itself][order], own[word[itself]][order], times[itself][order])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans of some sizes, one span after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def numbered(rows: DataFrame, asked: Asked, words: dict[str, str], text: str | None = None) -> DataFrame:
    """rows with numbers in place of words: words names for each column of tokens the column of the terms that are part of them.

    `own` and `times` are the terms that are tokens of the first of these columns and how often, `size` the number of its
    tokens; `fragments` are those that the lower-case column text has.
    """
    keep = [c for c in rows.columns if c not in (*words, text)]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{x} array<int>" for x in (*words.values(), "own", "times", "fragments")] + ["size int"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(asked.terms)
        for batch in batches:
            n, out = batch.num_rows, {c: batch.column(c) for c in keep}
            for i, (column, name) in enumerate(words.items()):
                parts, own = _words(batch.column(column), lookup)
                out[name] = _lists(parts[0], parts[1], n)
                if i == 0:
                    out["own"], out["times"] = _lists(own[0], own[1], n), _lists(own[0], own[2], n)
                    out["size"] = pc.list_value_length(batch.column(column))
            hits = [np.flatnonzero(pc.fill_null(pc.match_substring(batch.column(text), f), False).to_numpy(zero_copy_only=False)) for f in asked.fragments] if text else []
            row, piece = np.concatenate([*hits, np.zeros(0, np.int64)]), np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            order = np.argsort(row, kind="stable")
            out["fragments"] = _lists(row[order], piece[order], n)
            yield pa.RecordBatch.from_pydict({c: out[c] for c in (*keep, *words.values(), "own", "times", "fragments", "size")})

    return rows.mapInArrow(number, schema)


class Sheet:
    """Rows of one batch against all queries: matrices of rows by queries."""

    def __init__(self, batch: pa.RecordBatch, asked: Asked, links: dict, lookup: Lookup):
        self.batch, self.asked, self._links, self.lookup = batch, asked, links, lookup

    def column(self, name: str) -> np.ndarray:
        """A column of numbers, upright."""
        return self.batch.column(name).to_numpy(zero_copy_only=False)[:, None]

    def items(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Row and value of a column of lists."""
        column = self.batch.column(name)
        return pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def spread(self, row: np.ndarray, item: np.ndarray, weight: np.ndarray | None = None, of: int = 1) -> np.ndarray:
        """For each row and query the number (the sum of weights) of the items that are the query's."""
        start, query = self._links[of]
        size, n = start[item + 1] - start[item], len(self.asked.queries)
        cell = np.repeat(row, size) * n + query[_spans(start[item], size)]
        return np.bincount(cell, None if weight is None else np.repeat(weight, size), self.batch.num_rows * n).reshape(-1, n)

    def per_text(self, column: str, make: Callable[[str], np.ndarray]) -> np.ndarray:
        """make of each distinct text of a column, for each row."""
        coded = self.batch.column(column).dictionary_encode()
        return np.array([make(x) for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]

    def hits(self, place: str | None = None) -> np.ndarray:
        """How many terms of a query the row's text has, or its text and a short lower-case column."""
        row, term = self.items("terms")
        if place:
            has = self.per_text(place, lambda x: np.array([self.lookup.has(x, t) for t in self.asked.terms], dtype=bool))
            more = np.nonzero(has)
            row, term, _ = _distinct(np.concatenate([row, more[0]]), np.concatenate([term, more[1]]), len(self.asked.terms))
        return self.spread(row, term)

    def exact(self, place: str) -> np.ndarray:
        """12 hundredths for each fragment of a query that the row's text or the column has, 36 at most."""
        row, piece = self.items("fragments")
        if self.asked.fragments:
            more = np.nonzero(self.per_text(place, lambda x: np.array([f in x for f in self.asked.fragments], dtype=bool)))
            row, piece, _ = _distinct(np.concatenate([row, more[0]]), np.concatenate([piece, more[1]]), len(self.asked.fragments))
        return np.minimum(36, 12 * self.spread(row, piece, of=2)) / 100.0

    def structured(self, place: str) -> np.ndarray:
        """Hundredths for terms and fragments in kind, file, module and path; the column has path and kind, a line each."""

        def of(text: str) -> np.ndarray:
            path, kind = text.rsplit("\n", 1)
            parts, total = path.split("/"), np.zeros(len(self.asked.queries))
            where = {"kind": kind, "file": parts[-1], "module": parts[-2] if len(parts) > 1 else "", "path": path}
            for k, names in ((1, self.asked.terms), (2, self.asked.fragments)):
                weight = np.array([sum(WEIGHTS[p][k - 1] for p, x in where.items() if name in x) for name in names], dtype=float)
                item = np.flatnonzero(weight)
                start, query = self._links[k]
                size = start[item + 1] - start[item]
                np.add.at(total, query[_spans(start[item], size)], np.repeat(weight[item], size))
            return total

        return np.minimum(40, self.per_text(place, of)) / 100.0


def rounded(x: np.ndarray) -> np.ndarray:
    """As scores.rounded: half goes up."""
    return np.floor(x * 10**4 + 0.5) / 10.0**4


def share(hits: np.ndarray, asked: Asked) -> np.ndarray:
    return hits / np.maximum(1, asked.n_terms)[None, :]


#: Of a sheet: the scores, -inf for rows that are none of a query's, and further matrices by name.
Score = Callable[[Sheet], tuple[np.ndarray, dict[str, np.ndarray]]]


def best(rows: DataFrame, asked: Asked, score: Score, k: int | None, carry: list[str], more: list[str], then: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, carry, score, more: each task's k best rows of each query (all, without k), of equal scores those with the larger `then`, then the smaller id."""
    taken = ["id", *[c for c in carry if c != "id"]]
    schema = ", ".join([f"query_id {asked.key.simpleString()}", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in taken], *[f"`{c}` double" for c in ("score", *more)]])

    def cut(tables: list[pa.Table], least: np.ndarray) -> pa.Table:
        table = pa.concat_tables(tables)
        table = table.take(pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "descending"), *[(c, "descending") for c in then], ("id", "ascending")]))
        q = table.column("q").to_numpy()
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = np.flatnonzero(place == k - 1)
        least[q[last]] = np.maximum(least[q[last]], table.column("score").to_numpy()[last])
        return table.filter(pa.array(place < k))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, lookup, n = {of: asked.links(of) for of in (1, 2)}, Lookup(asked.terms), len(asked.queries)
        ids, least, kept, waiting = pa.array([q[0] for q in asked.queries], to_arrow_type(asked.key)), np.full(n, -np.inf), [], 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            shaped = pa.table({"query_id": ids.take(table.column("q").combine_chunks()), **{c: table.column(c) for c in (*taken, "score", *more)}})
            yield from shaped.to_batches(max_chunksize=10_000)

        for batch in batches:
            for at in range(0, batch.num_rows if n else 0, step := max(1, CELLS // max(1, n))):
                sheet = Sheet(batch.slice(at, step), asked, links, lookup)
                scores, others = score(sheet)
                if k and len(scores) >= k:
                    least = np.maximum(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                row, q = np.nonzero((scores >= least[None, :]) & (scores > -np.inf))
                part = pa.Table.from_batches([sheet.batch.select(taken)]).take(pa.array(row))
                for name, x in {"score": scores, **{m: others[m] for m in more}}.items():
                    part = part.append_column(name, pa.array(np.broadcast_to(x, scores.shape)[row, q].astype(float)))
                part = part.append_column("q", pa.array(q))
                if not k:
                    yield from out(part)
                    continue
                kept, waiting = [*kept, part], waiting + part.num_rows
                if waiting > KEPT:
                    kept = [cut(kept, least)]
                    waiting = 0
        if kept:
            yield from out(cut(kept, least))

    return rows.mapInArrow(keep, schema)
