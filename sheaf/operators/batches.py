"""The blocks of many documents at a time as Arrow columns.

``per_document`` collects a document's rows in one row and hands batches of
documents to a function of Arrow arrays as a column expression: the rows stay in
the partition of their document and keep its ``doc_id``.  Ids are looked up with
sorted numeric keys, texts are joined by list offsets; nothing here loops over
blocks or documents in Python.

Numbers that are missing are ``NONE``, below all others, as nulls are in Spark.
Rows with equal places are told apart by their other fields (``rank``), which
are looked at only where there are such rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).min


def listed(whole: DataFrame, fn: Callable[..., pa.Array], returns: str, *columns: str, name: str = "out") -> DataFrame:
    """``whole`` (a row a document) with ``name``: ``fn`` of its ``columns``."""
    def call(*arrays: pa.Array) -> pa.Array:
        return fn(*arrays)

    call.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    # evaluated once, wherever its result is filtered
    return whole.withColumn(name, F.arrow_udf(call, returns).asNondeterministic()(*columns))


def per_document(rows: DataFrame, columns: list[str | Column], fn: Callable[[pa.Array, pa.Array], pa.Array], returns: str,
                 documents: DataFrame | None = None, name: str = "out") -> DataFrame:
    """``(doc_id, out)``: ``fn`` of the lists of each document's rows and of
    whether its ``doc_id`` is known; for the ``doc_id`` of ``documents`` where
    given, also for those without rows."""
    rows = rows.select("doc_id", F.struct(*columns).alias("b"))
    if documents is None:
        whole = rows.groupBy("doc_id").agg(F.collect_list("b").alias("b"))
    else:
        rows = rows.unionByName(documents.select("doc_id", F.lit(True).alias("wanted")), allowMissingColumns=True)
        whole = rows.groupBy("doc_id").agg(F.collect_list("b").alias("b"), F.max("wanted").alias("wanted")).where("wanted")
    return listed(whole.withColumn("known", F.col("doc_id").isNotNull()), fn, returns, "b", "known", name=name).select("doc_id", name)


def structs(b: pa.Array) -> dict[str, pa.Array]:
    """The fields of flattened lists of structs."""
    rows = b.flatten()
    return dict(zip([f.name for f in rows.type], rows.flatten()))


# ---------------------------------------------------------------------------
# columns
# ---------------------------------------------------------------------------

def numbers(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a.cast(pa.int64()), int(NONE)).to_numpy(zero_copy_only=False)


def equals(a: pa.Array, value: str) -> np.ndarray:
    return pc.fill_null(pc.equal(a, value), False).to_numpy(zero_copy_only=False)


def parents(lists: pa.Array) -> np.ndarray:
    """The list that each flattened element is of."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def place(groups: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of equal numbers."""
    i = np.arange(len(groups))
    new = np.ones(len(groups), bool)
    new[1:] = groups[1:] != groups[:-1]
    return i - np.maximum.accumulate(np.where(new, i, 0)) if len(groups) else i


def offsets(groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` groups begins and ends in sorted ``groups``."""
    return np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)


def lists(groups: np.ndarray, n: int, values: pa.Array, missing: np.ndarray | None = None) -> pa.Array:
    """``values`` as ``n`` lists, by sorted ``groups``."""
    mask = None if missing is None else pa.array(missing)
    return pa.ListArray.from_arrays(pa.array(offsets(groups, n)), values, mask=mask)


def joined(groups: np.ndarray, n: int, texts: pa.Array, sep: str) -> pa.Array:
    return pc.binary_join(lists(groups, n, texts), sep)


def taken(a: pa.Array, rows: np.ndarray) -> pa.Array:
    """``a`` at ``rows``, null where a row is -1."""
    return a.take(pa.array(rows, mask=rows < 0))


def text_of(a: pa.Array, rows: np.ndarray) -> pa.Array:
    return pc.fill_null(taken(a, rows), "")


def rank(a: pa.Array) -> np.ndarray:
    """Numbers in the order of the values: texts by their bytes, lists by
    their elements, nulls first."""
    if pa.types.is_list(a.type):
        key = [None if v is None else tuple((x is not None, (x or "").encode()) for x in v) for v in a.to_pylist()]
        order = {v: i for i, v in enumerate(sorted({v for v in key if v is not None}))}
        return np.array([-1 if v is None else order[v] for v in key], np.int64)
    if not pa.types.is_string(a.type):
        return numbers(a)
    coded = a.dictionary_encode()
    at = np.empty(len(coded.dictionary), np.int64)
    at[pc.array_sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(at))
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return np.where(codes < 0, -1, at[codes] if len(at) else -1)


def number(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows have one number, in the order of the columns; and a row of each number."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return at, order[new]


def in_order(key: np.ndarray, order: np.ndarray, ties: Callable[[], list[np.ndarray]]) -> np.ndarray:
    """Rows by key and order; where both are equal, by ``ties``."""
    o = np.lexsort((order, key))
    k, v = key[o], order[o]
    if ((k[1:] == k[:-1]) & (v[1:] == v[:-1])).any():
        o = np.lexsort((*ties()[::-1], order, key))
    return o


def one_each(key: np.ndarray, order: np.ndarray, ties: Callable[[], list[np.ndarray]], first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the last (``first``) row of each."""
    o = in_order(key, order, ties)
    k = key[o]
    edge = np.ones(len(k), bool)
    if first:
        edge[1:] = k[1:] != k[:-1]
    else:
        edge[:-1] = k[1:] != k[:-1]
    return k[edge], o[edge]


def among(keys: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The row of each asked key in sorted ``keys``, -1 where it is not there."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, rows[at], -1)


# ---------------------------------------------------------------------------
# blocks
# ---------------------------------------------------------------------------

class Blocks:
    """A batch of documents: ``doc`` numbers a block's document."""

    def __init__(self, b: pa.Array, known: pa.Array):
        self.n_docs, self.doc, self.known = len(b), parents(b), known.to_numpy(zero_copy_only=False)
        self.columns = structs(b)
        self.kind, self.text = self.columns["block_type"], self.columns["text"]
        self.ord, self.page = numbers(self.columns["block_ord"]), numbers(self.columns["page"])
        self.is_known = self.known[self.doc]
        if "id" in self.columns:
            coded = self.columns["id"].dictionary_encode()
            self.ids, self.code = coded.dictionary, pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)

    def codes(self, ids: pa.Array) -> np.ndarray:
        """Numbers of ids as in ``code``: -1 for nulls, other ones for ids that no block has."""
        at = pc.fill_null(pc.index_in(ids, value_set=self.ids).cast(pa.int64()), -1).to_numpy(zero_copy_only=False).copy()
        other = (at < 0) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
        if other.any():
            at[other] = len(self.ids) + ids.filter(pa.array(other)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return at

    def entity(self, kind: str) -> np.ndarray:
        e = self.columns["entity_types"]
        has = np.zeros(len(self.doc), bool)
        has[parents(e)[equals(e.flatten(), kind)]] = True
        return has

    def rels(self, rows: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Relationships of ``rows``: which of the rows, type and ids."""
        r = self.columns["relationships"].take(pa.array(rows))
        kind, ids = r.flatten().flatten()
        return parents(r), kind, ids

    def first_ids(self, rows: np.ndarray, kind: str) -> pa.Array:
        """Ids of the first relationship of a type, null without one."""
        of, kinds, ids = self.rels(rows)
        fits = np.flatnonzero(equals(kinds, kind))
        has, at = np.unique(of[fits], return_index=True)
        found = np.full(len(rows), -1, np.int64)
        found[has] = fits[at]
        return taken(ids, found)

    def child_ids(self) -> pa.Array:
        """The first CHILD relationship's ids of every block."""
        if "child_ids" not in self.columns:
            self.columns["child_ids"] = self.first_ids(np.arange(len(self.doc)), "CHILD")
        return self.columns["child_ids"]

    def value_ids(self, rows: np.ndarray) -> pa.Array:
        """The first id of the first VALUE relationship (JN-5)."""
        ids = self.first_ids(rows, "VALUE")
        each, at = np.unique(parents(ids), return_index=True)
        found = np.full(len(rows), -1, np.int64)
        found[each] = at
        return taken(ids.flatten(), found)

    def scope(self, scope: str) -> Scope:
        return Scope(self, scope)


class Scope:
    """Inside what ids resolve: ``group`` numbers it for each block (-1: the
    block is in none); group ``g`` is document ``doc[g]``, page ``page[g]``."""

    def __init__(self, b: Blocks, scope: str):
        self.b = b
        if scope == "document":
            self.group, self.doc, self.page = b.doc, np.arange(b.n_docs), np.full(b.n_docs, NONE)
            self.inside = np.ones(len(b.doc), bool)
        else:
            self.inside = b.page != NONE
            self.keys, at = np.unique(page_key(b.doc[self.inside], b.page[self.inside]), return_inverse=True)
            self.group = np.full(len(b.doc), -1, np.int64)
            self.group[self.inside] = at
            self.doc, self.page = self.keys >> 32, (self.keys & 0xFFFFFFFF) - (1 << 31)
        self.n, self.usable = len(self.doc), self.inside & b.is_known

    def lookup(self, group: np.ndarray, ids: pa.Array, *fields: str, first: bool = False, placed: bool = False) -> np.ndarray:
        """JN-1/JN-2/WIN-3: the last (``first``) block with each id in its
        group, -1 where there is none; of blocks at one place the one with the
        greatest (least) ``fields``.  ``placed``: only blocks with a place."""
        b = self.b
        codes = b.codes(ids)
        asked = np.zeros(len(b.ids) + 1, bool)
        asked[codes[(codes >= 0) & (codes < len(b.ids))]] = True
        rows = self.usable & (b.code >= 0) & asked[b.code]
        rows = np.flatnonzero(rows & (b.ord != NONE) if placed else rows)
        span = len(b.ids)
        keys, at = one_each(self.group[rows] * span + b.code[rows], b.ord[rows],
                            lambda: [rank(b.columns[f].take(pa.array(rows))) for f in fields], first)
        found = among(keys, rows[at], group * span + codes)
        return np.where((codes >= 0) & (codes < span), found, -1)

    def child_texts(self, rows: np.ndarray, owner: np.ndarray, n: int, placed: bool = False) -> pa.Array:
        """JN-3/JN-4: texts of the CHILD blocks of ``rows``, a text for each of
        ``n`` owners; rows of one owner have each slot once."""
        of, kinds, ids = self.b.rels(rows)
        fits = np.flatnonzero(equals(kinds, "CHILD") & pc.is_valid(ids).to_numpy(zero_copy_only=False))
        ids = ids.take(pa.array(fits))
        slot = parents(ids)
        of, rel = of[fits], place(of[fits])
        row, rel, at = of[slot], rel[slot], place(slot)
        found = self.lookup(self.group[rows[row]], ids.flatten(), "text", placed=placed)
        texts, own = text_of(self.b.text, found), owner[row]
        if len(rows) != n:
            r = rank(texts)
            _, keep = number(own, rel, at, r)
            texts, own = texts.take(pa.array(keep)), own[keep]
        elif (own[1:] < own[:-1]).any():
            o = np.argsort(own, kind="stable")
            texts, own = texts.take(pa.array(o)), own[o]
        return joined(own, n, texts, " ")


def page_key(doc: np.ndarray, page: np.ndarray) -> np.ndarray:
    return (doc << 32) | (page + (1 << 31))


# ---------------------------------------------------------------------------
# forms (AGG-5, PRJ-2, JN-5, JN-9)
# ---------------------------------------------------------------------------

def forms(s: Scope, placed: bool = False) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Groups (sorted), keys and values of the pairs in order.  ``placed``: as
    nested documents have them, where a text comes from blocks with a place
    and a key needs none."""
    b = s.b
    is_key = b.entity("KEY")
    kv = np.flatnonzero(equals(b.kind, "KEY_VALUE_SET") & s.usable & (is_key | b.entity("VALUE")))
    key_of = is_key[kv]
    ids = b.value_ids(kv)
    wanted = np.where(key_of, b.codes(ids), -1)
    owner, row = number(s.group[kv], b.ord[kv], b.code[kv], key_of, wanted)
    text = s.child_texts(kv, owner, len(row), placed)
    group, order, code, key_of, wanted = s.group[kv][row], b.ord[kv][row], b.code[kv][row], key_of[row], wanted[row]
    once, _ = number(group, code, key_of)
    n, last = one_each(once, order, lambda: [rank(ids.take(pa.array(row))), rank(text)])
    at = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(at, once, order)
    # a key and the VALUE block it names: one text at most
    group, code, key_of, wanted, has = group[last], code[last], key_of[last], wanted[last], order[last] != NONE
    text = text.take(pa.array(last))
    span = len(b.ids) + 1
    values = np.flatnonzero(~key_of & (code >= 0) & has)
    values = values[np.argsort(group[values] * span + code[values])]
    keys = np.flatnonzero(key_of & (has | placed) & ~equals(text, ""))
    keys = keys[np.lexsort((at[keys], group[keys]))]
    known = (wanted[keys] >= 0) & (wanted[keys] < len(b.ids))
    found = np.where(known, among(group[values] * span + code[values], values, group[keys] * span + wanted[keys]), -1)
    return group[keys], text.take(pa.array(keys)), text_of(text, found)


def _greatest(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Of each owner's values the greatest, which a null never is."""
    if len(owner) == n:
        return values.take(pa.array(np.argsort(owner)))
    _, last = one_each(owner, rank(values), lambda: [])
    return values.take(pa.array(last))


def legacy_texts(s: Scope, group: np.ndarray, texts: pa.Array, ids: pa.Array, times: np.ndarray) -> pa.Array:
    """Own text when set, else the texts of the children that exist and have
    one, joined by '', each as often as its block was delivered."""
    own = pc.fill_null(texts, "")
    empty = equals(own, "")
    asking = np.flatnonzero(empty)
    ids = ids.take(pa.array(asking))
    of = asking[parents(ids)]
    kids = text_of(s.b.text, s.lookup(group[of], ids.flatten(), "text", first=True))
    again = np.repeat(np.arange(len(of)), times[of])
    return pc.if_else(pa.array(empty), joined(of[again], len(texts), kids.take(pa.array(again)), ""), own)


def legacy_forms(s: Scope) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Every KEY block in order whose first VALUE id some block has."""
    b = s.b
    rows = np.flatnonzero(equals(b.kind, "KEY_VALUE_SET") & s.usable & b.entity("KEY"))
    ids = b.value_ids(rows)
    has = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    rows, ids = rows[has], ids.filter(pa.array(has))
    owner, row = number(s.group[rows], b.ord[rows], b.codes(ids))
    n, text, kids = np.bincount(owner, minlength=len(row)), b.text.take(pa.array(rows)), b.first_ids(rows, "CHILD")
    text, kids = _greatest(text, owner, len(row)), _greatest(kids, owner, len(row))
    group, order, ids = s.group[rows][row], b.ord[rows][row], ids.take(pa.array(row))
    children = b.child_ids()
    found = s.lookup(group, ids, "text", "child_ids", first=True)
    keep = np.flatnonzero(found >= 0)
    group, order, n, found = group[keep], order[keep], n[keep], found[keep]
    text, kids = text.take(pa.array(keep)), kids.take(pa.array(keep))
    every = np.flatnonzero(s.usable & (b.code >= 0))
    copy = np.full(len(b.doc), -1, np.int64)
    copy[every], _ = number(s.group[every], b.code[every], b.ord[every])
    copies = np.bincount(copy[every], minlength=1)[copy[found]] if len(found) else found
    m = np.where(b.ord[found] != NONE, copies, 1)
    # a side without a place in the document has no text
    sides = []
    for has, t, i, times in ((order != NONE, text, kids, n), (b.ord[found] != NONE, taken(b.text, found), taken(children, found), m)):
        at = np.where(has, np.arange(len(keep)), -1)
        sides.append(legacy_texts(s, group, taken(t, at), taken(i, at), times))
    o = np.lexsort((order, group))
    o = np.repeat(o, (n * n * m)[o])  # blocks delivered again pair each with each
    return group[o], *[x.take(pa.array(o)) for x in sides]


# ---------------------------------------------------------------------------
# tables (AGG-6, AGG-7, JN-6)
# ---------------------------------------------------------------------------

class Cells:
    """Tables in order of group and place, and their cells in order: ``group``
    a table, ``table`` (sorted), ``at``, ``text``, ``row``, ``col`` a cell."""

    def __init__(self, s: Scope, legacy: bool = False, placed: bool = False):
        b = s.b
        rows = np.flatnonzero(equals(b.kind, "TABLE") & s.usable)
        if placed:  # a table that was delivered twice is one
            _, one = number(s.group[rows], b.ord[rows], b.page[rows], b.code[rows])
            rows = rows[one]
        ids = b.first_ids(rows, "CHILD")
        o = np.lexsort((b.ord[rows], s.group[rows]))
        if legacy:
            o = o[pc.is_valid(ids).to_numpy(zero_copy_only=False)[o]]
        rows, ids = rows[o], ids.take(pa.array(o))
        self.s, self.group, self.number = s, s.group[rows], place(s.group[rows])
        table = parents(ids)
        group, at = self.group[table], place(table)
        if legacy:
            children = b.child_ids()
            found = s.lookup(group, ids.flatten(), "text", "row_index", "column_index", "child_ids", first=True)
            keep = found >= 0
        else:
            found = s.lookup(group, ids.flatten(), "text", "block_type", "row_index", "column_index", placed=placed)
            is_cell = equals(b.kind, "CELL")
            keep = (found >= 0) & is_cell[found] if len(is_cell) else found >= 0
        self.table, self.at, found = table[keep], at[keep], found[keep]
        has = b.ord[found] != NONE if len(found) else found >= 0
        if legacy:  # a cell without a place in the document has no text
            own = np.where(has, found, -1)
            self.text = legacy_texts(s, group[keep], taken(b.text, own), taken(children, own), np.ones(len(own), np.int64))
        else:
            cells = np.flatnonzero(is_cell & s.usable & (b.ord != NONE))
            owner, row = number(s.group[cells], b.ord[cells])
            texts = s.child_texts(cells, owner, len(row), placed)
            of = np.full(len(b.doc), -1, np.int64)
            of[cells] = owner
            self.text = text_of(texts, of[found] if len(of) else found)
        self.row, self.col = (pc.fill_null(b.columns[c], 0).take(pa.array(found)) for c in ("row_index", "column_index"))

    def grid(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        return grid(self.table, len(self.group), self.row.to_numpy(), self.col.to_numpy(), self.text)


def grid(table: np.ndarray, n: int, row: np.ndarray, col: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """AGG-7: rows and columns of each of ``n`` tables (0: no grid) and the
    texts of all slots; of cells at one slot the last counts."""
    row, col = row.astype(np.int64), col.astype(np.int64)
    rows, cols = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(rows, table, row)
    np.maximum.at(cols, table, col)
    dense = (rows > 0) & (cols > 0)
    rows, cols = np.where(dense, rows, 0), np.where(dense, cols, 0)
    begin = np.concatenate([[0], np.cumsum(rows * cols)])
    own = np.flatnonzero((row >= 1) & (col >= 1))
    slot = np.full(begin[-1], -1, np.int64)
    np.maximum.at(slot, begin[table[own]] + (row[own] - 1) * cols[table[own]] + col[own] - 1, own)
    return rows, cols, text_of(text, slot)


def preview(slots: pa.Array, cells: pa.Array, tables: int, most: int) -> dict:
    """LIM-1 of the documents' grids and cells: the columns of the rows shown,
    by document (``doc``)."""
    doc, g, bare_doc, c = parents(slots), structs(slots), parents(cells), structs(cells)
    known = lambda t: (t != NONE) & (t <= tables)
    keep = np.flatnonzero(known(numbers(g["table_no"])))
    doc, table, line, col = doc[keep], *(numbers(g[k])[keep] for k in ("table_no", "row_no", "col_no"))
    text = g["text"].take(pa.array(keep))
    row, one = number(doc, table, line)
    o = in_order(row, col, lambda: [rank(text)])
    texts = joined(row[o], len(one), text.take(pa.array(o)), " | ")
    doc, table, line = doc[one], table[one], line[one]
    of, tops = number(doc, table)
    n_rows = np.bincount(of, minlength=len(tops))[of]
    shown = np.flatnonzero(line <= most)
    # tables that have cells but no grid
    bare_table = numbers(c["table_no"])
    each, first = number(bare_doc, bare_table)
    count = np.bincount(each, minlength=len(first))
    both = page_key(doc[tops], table[tops])
    bare = np.flatnonzero(known(bare_table[first]) & ~np.isin(page_key(bare_doc[first], bare_table[first]), both))
    at = first[bare]
    note = pa.array([f"{n} cells (no rows structure)" for n in count[bare].tolist()], pa.string())
    join = lambda x, y: np.concatenate([x, y])
    docs = join(doc[shown], bare_doc[at])
    o = np.argsort(docs, kind="stable")
    return {"doc": docs[o], "table_no": join(table[shown], bare_table[at])[o], "row_no": join(line[shown], np.zeros(len(at), np.int64))[o],
            "row_text": pa.concat_arrays([texts.take(pa.array(shown)), note]).take(pa.array(o)),
            "more_rows": join(np.maximum(n_rows[shown] - most, 0), np.zeros(len(at), np.int64))[o]}


# ---------------------------------------------------------------------------
# pages (AGG-1..3, WIN-1, PRJ-3, JN-7)
# ---------------------------------------------------------------------------

class Pages:
    """The page list by document and number: ``doc``, ``number`` and ``page``,
    and ``group``, the page's group in scope ``s`` (-1: no block has the page)."""

    def __init__(self, s: Scope, profile: str):
        b = s.b
        if profile == "current":
            rows = np.flatnonzero(equals(b.kind, "PAGE"))
            rows = rows[np.lexsort((b.ord[rows], b.doc[rows]))]
            self.doc, page = b.doc[rows], b.page[rows]
            self.number = place(self.doc) + 1
            self.page = np.where((page != NONE) & (page != 0), page, self.number)
        else:  # one page per distinct page value
            self.doc, self.page = s.doc, s.page
            self.number = place(self.doc) + 1
        self.s, self.group = s, among(s.keys, np.arange(s.n), page_key(self.doc, self.page))
        # pages of a null document have nothing
        self.group = np.where(b.known[self.doc] if len(self.doc) else self.group >= 0, self.group, -1)

    def lines(self, profile: str) -> list[pa.Array]:
        """Text, confidence and block count of each page."""
        s, b = self.s, self.s.b
        rows = np.flatnonzero(equals(b.kind, "LINE") & s.usable)
        text, group = pc.fill_null(b.text.take(pa.array(rows)), ""), s.group[rows]
        o = in_order(group, b.ord[rows], lambda: [rank(text)])
        texts = joined(group[o], s.n, text.take(pa.array(o)), "\n")
        score = b.columns["confidence"].take(pa.array(rows))
        given = pc.is_valid(score).to_numpy(zero_copy_only=False)
        scored = np.bincount(group[given], minlength=s.n)
        total = np.bincount(group[given], weights=score.drop_null().to_numpy(), minlength=s.n)
        mean = np.where(scored > 0, total / np.maximum(scored, 1), 0.0)
        counted = group if profile == "current" else s.group[s.usable]
        return [text_of(texts, self.group), self.of(mean, 0.0), self.of(np.bincount(counted, minlength=s.n), 0)]

    def of(self, values: np.ndarray, none: float) -> pa.Array:
        if not len(values):
            return pa.array(np.full(len(self.group), none))
        return pa.array(np.where(self.group >= 0, values[self.group], none))


def gathered(values: pa.Array, groups: np.ndarray, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``values`` by sorted ``groups``: the rows of each wanted group (-1:
    none) one after another, and which wanted one a row is for."""
    begin = offsets(groups, n).astype(np.int64)
    sizes = np.where(wanted >= 0, np.diff(begin)[wanted], 0) if n else np.zeros(len(wanted), np.int64)
    of = np.repeat(np.arange(len(wanted)), sizes)
    return (begin[wanted[of]] if n else of) + place(of), of
