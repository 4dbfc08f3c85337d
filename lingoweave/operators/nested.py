"""Deeply nested semi-structured records into flat parent and child tables.

A batch of JSON texts is indexed as one byte buffer with numpy: bitmaps of escaped bytes and of string bodies, structural
characters outside strings, nesting depth by prefix sums. Sorting the tokens by (text, depth, position) puts the
members of each container side by side with every nested value collapsed to one item, so that grammar, array
positions, member names and parents all follow from neighbouring items.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_PLAIN_NAME = re.compile(r"[A-Za-z0-9_]+")
_BOM = b"\xef\xbb\xbf"

#: item kinds within a container
_OPEN, _CLOSE, _COMMA, _COLON, _STRING, _SCALAR_K, _OBJECT, _ARRAY = range(8)

_CLASS = np.zeros(256, np.uint8)  # 1 structural, 2 blank
for _c in b"{}[]:,":
    _CLASS[_c] = 1
for _c in b" \t\r\n":
    _CLASS[_c] = 2
_ESCAPABLE = np.zeros(256, bool)
for _c in b'"\\/bfnrtu':
    _ESCAPABLE[_c] = True
_HEX = np.zeros(256, bool)
for _c in b"0123456789abcdefABCDEF":
    _HEX[_c] = True

#: allowed successions (container is an object?, kind before, kind)
_NEXT = np.zeros((2, 8, 8), bool)
for _v in (_STRING, _SCALAR_K, _OBJECT, _ARRAY):
    _NEXT[0, _OPEN, _v] = _NEXT[0, _v, _COMMA] = _NEXT[0, _COMMA, _v] = _NEXT[0, _v, _CLOSE] = True
    _NEXT[1, _COLON, _v] = _NEXT[1, _v, _COMMA] = _NEXT[1, _v, _CLOSE] = True
_NEXT[:, _OPEN, _CLOSE] = True
_NEXT[1, _OPEN, _STRING] = _NEXT[1, _COMMA, _STRING] = _NEXT[1, _STRING, _COLON] = True


class Index:
    """Structural index of a list of JSON texts.

    ``valid[i]``: text i is one JSON value (as Python's parser judges: NaN and Infinity pass, control characters in strings
    do not). The arrays ``doc, kind, start, stop, parent, name, place`` describe the values of all valid texts in
    document order; ``parent`` is the index of the enclosing container or -1, ``name`` the item number of the member name
    or -1, ``place`` the position in an array or -1.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = [t.strip(b" \t\r\n").removeprefix(_BOM).strip(b" \t\r\n") for t in texts]
        self._index()

    def _index(self) -> None:
        n = len(self.texts)
        buffer = b"\n".join(self.texts) + b"\n"
        size = np.fromiter((len(t) + 1 for t in self.texts), np.int64, n)
        self.buffer, end = buffer, np.cumsum(size)
        begin = end - size
        self._bytes = b = np.frombuffer(buffer, np.uint8)
        at = np.repeat(np.arange(n, dtype=np.int32), size)  # text of each byte
        bad = np.zeros(n, bool)

        # bytes escaped by an odd run of backslashes
        slash = np.flatnonzero(b == 92)
        escaped = np.zeros(len(b) + 1, bool)
        if len(slash):
            first = np.ones(len(slash), bool)
            first[1:] = np.diff(slash) != 1
            start = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
            odd = (np.arange(len(slash)) - start) % 2 == 0
            escaped[slash[odd] + 1] = True
        escaped = escaped[:-1]

        quote = (b == 34) & ~escaped
        total = np.cumsum(quote, dtype=np.int64)
        before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0)
        inside = ((total - np.repeat(before, size)) & 1).astype(bool)  # from an opening quote up to before the closing one
        bad |= ((total[end - 1] - before) & 1).astype(bool)
        body = inside & ~quote
        bad[at[body & (b < 32)]] = True
        bad[at[escaped & body & ~_ESCAPABLE[b]]] = True
        u = np.flatnonzero(escaped & body & (b == 117))
        for k in range(1, 5):
            p = np.minimum(u + k, len(b) - 1)
            bad[at[u[~(_HEX[b[p]] & body[p])]]] = True

        outside = ~inside & ~quote
        structural = outside & (_CLASS[b] == 1)
        other = outside & (_CLASS[b] == 0)
        scalar_start = other.copy()
        scalar_start[1:] &= ~other[:-1]
        scalar_end = other.copy()
        scalar_end[:-1] &= ~other[1:]
        opening_quote = quote & inside
        pos = np.flatnonzero(structural | opening_quote | scalar_start)
        c = b[pos]
        token_doc = at[pos]
        is_open, is_close = structural[pos] & ((c == 123) | (c == 91)), structural[pos] & ((c == 125) | (c == 93))
        depth = np.cumsum(is_open.astype(np.int64) - is_close)
        ends = np.searchsorted(token_doc, np.arange(n), "right")
        starts = np.searchsorted(token_doc, np.arange(n), "left")
        base = np.where(starts > 0, depth[np.maximum(starts - 1, 0)], 0) if len(depth) else np.zeros(n, np.int64)
        depth = depth - base[token_doc]
        bad |= ends == starts
        some = ends > starts
        bad[some] |= depth[ends[some] - 1] != 0
        bad[token_doc[depth < 0]] = True

        stop = np.zeros(len(pos), np.int64)  # end of strings (closing quote) and scalars
        string = opening_quote[pos]
        closing = np.flatnonzero(quote & ~inside)
        at_string = np.flatnonzero(string)
        if len(closing):
            k = np.searchsorted(closing, pos[at_string])
            stop[at_string] = np.where(k < len(closing), closing[np.minimum(k, len(closing) - 1)], pos[at_string])
        scalar = scalar_start[pos]
        stop[scalar] = np.flatnonzero(scalar_end) + 1
        # each different scalar is looked at once
        some = np.flatnonzero(scalar)
        spelled = self._raw(pos[some], stop[some]).dictionary_encode()
        right = np.array([bool(_SCALAR.fullmatch(x)) for x in spelled.dictionary.to_pylist()], bool)
        if not right.all():
            bad[token_doc[some[~right[spelled.indices.to_numpy()]]]] = True

        # items: each token on the level of its container; an opening bracket is an item on both levels
        kind = np.select([is_open & (c == 123), is_open, is_close, string, scalar, c == 44], [_OBJECT, _ARRAY, _CLOSE, _STRING, _SCALAR_K, _COMMA], _COLON)
        outer = np.where(is_open, depth - 1, np.where(is_close, depth + 1, depth))
        token = np.concatenate([np.arange(len(pos)), np.flatnonzero(is_open)])
        level = np.concatenate([outer, depth[is_open]])
        item = np.concatenate([kind, np.full(int(is_open.sum()), _OPEN)])
        good = ~bad[token_doc[token]]
        token, level, item = token[good], level[good], item[good]
        o = np.lexsort((token, level, token_doc[token]))
        token, level, item = token[o], level[o], item[o]
        doc = token_doc[token]
        m = len(token)
        idx = np.arange(m)
        # the root level has no opening item; it is checked by its count
        root = level == 0
        bad |= (np.bincount(doc[root], minlength=n) != 1) & ~bad
        bad[doc[root & (item < _STRING)]] = True
        opener = np.maximum.accumulate(np.where(item == _OPEN, idx, -1)) if m else idx
        nested = ~root
        holder = np.where(nested, token[np.maximum(opener, 0)], -1)  # token of the container
        in_object = np.zeros(m, np.int64)
        in_object[nested] = kind[holder[nested]] == _OBJECT
        prev = np.roll(item, 1)
        check = nested & (item != _OPEN)
        bad[doc[check & ~_NEXT[in_object, prev, item]]] = True
        # brackets must match in kind
        closer = nested & (item == _CLOSE)
        bad[doc[closer & (c[token] != np.where(in_object == 1, 125, 93))]] = True
        is_name = (item == _STRING) & (in_object == 1) & ((prev == _OPEN) | (prev == _COMMA))
        bad[doc[is_name & (np.roll(item, -1) != _COLON)]] = True
        bad[doc[(item == _COLON) & ~np.roll(is_name, 1)]] = True
        commas = np.cumsum(item == _COMMA)
        place = np.where(nested & (in_object == 0), commas - commas[np.maximum(opener, 0)], -1)
        value = (item >= _STRING) & ~is_name & ~bad[doc]
        named = value & (in_object == 1)
        name = np.where(named, token[np.maximum(idx - 2, 0)], -1)
        self.valid = ~bad
        v = np.flatnonzero(value)
        v = v[np.argsort(token[v], kind="stable")]
        back = np.full(len(pos) + 1, -1, np.int64)
        back[token[v]] = np.arange(len(v))
        self.doc, self.kind = doc[v], item[v]
        self.start, self.stop = pos[token[v]], stop[token[v]]
        self.parent = np.where(holder[v] >= 0, back[holder[v]], -1)
        self.place, self.name = place[v], name[v]
        self._pos, self._stop, self.level = pos, stop, level[v]

    def _raw(self, start: np.ndarray, stop: np.ndarray) -> pa.BinaryArray:
        """The bytes of stretches."""
        size = stop - start
        last = np.cumsum(size)
        at = np.repeat(start - last + size, size) + np.arange(int(size.sum()))
        offsets = np.concatenate([[0], last]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self._bytes[at].tobytes())])

    @staticmethod
    def _decoded(raw: pa.BinaryArray) -> pa.StringArray:
        """Strings from what stands between their quotes; a lone surrogate or a broken byte becomes U+FFFD."""
        if not len(raw):
            return pa.array([], pa.string())
        try:
            plain = raw.cast(pa.string())
        except pa.ArrowInvalid:
            plain = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        escaped = np.flatnonzero(pc.match_substring(plain, "\\").to_numpy(zero_copy_only=False))
        if not len(escaped):
            return plain
        texts = json.loads('["' + '","'.join(plain.take(pa.array(escaped)).to_pylist()) + '"]')
        try:
            found = pa.array(texts, pa.string())
        except (UnicodeEncodeError, pa.ArrowInvalid):
            found = pa.array([x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in texts], pa.string())
        at = np.arange(len(plain))
        at[escaped] = len(plain) + np.arange(len(escaped))
        return pa.concat_arrays([plain, found]).take(pa.array(at))

    def strings(self, which: np.ndarray) -> pa.StringArray:
        """The string values with these numbers."""
        return self._decoded(self._raw(self.start[which] + 1, self.stop[which]))

    @functools.cached_property
    def _names(self) -> tuple[np.ndarray, pa.StringArray]:
        """For each value the number of its member name, -1 in an array; and the different names."""
        some = np.flatnonzero(self.name >= 0)
        code = np.full(len(self.doc), -1, np.int64)
        item = self.name[some]
        spelled = self._raw(self._pos[item] + 1, self._stop[item]).dictionary_encode()
        names = self._decoded(spelled.dictionary).dictionary_encode()  # a name may be spelled with escapes
        if len(some):
            code[some] = names.indices.to_numpy()[spelled.indices.to_numpy()]
        return code, names.dictionary

    @functools.cached_property
    def alive(self) -> np.ndarray:
        """Which values count: of several members of one name in an object the last does, as in usual parsers, with all below it."""
        code, names = self._names
        alive = np.ones(len(code), bool)
        some = np.flatnonzero(code >= 0)[::-1]
        _, first = np.unique(self.parent[some] * max(1, len(names)) + code[some], return_index=True)
        alive[some] = False
        alive[some[first]] = True
        for at in self._by_level[1:]:
            alive[at] &= alive[self.parent[at]]
        return alive

    @functools.cached_property
    def _by_level(self) -> list[np.ndarray]:
        order = np.argsort(self.level, kind="stable")
        edges = np.searchsorted(self.level[order], np.arange(int(self.level.max()) + 2 if len(order) else 1))
        return [order[a:b] for a, b in zip(edges, edges[1:])]

    def chained(self, root: str, member: Callable[[str], str], place: Callable[[int], str]) -> pa.StringArray:
        """For each value the steps from the root down to it, joined: ``root``, then ``member`` of each name and ``place`` of each position."""
        code, names = self._names
        positions, where = np.unique(self.place, return_inverse=True)
        steps = pa.array([*map(member, names.to_pylist()), *[place(int(p)) for p in positions]], pa.string())
        step = np.where(code >= 0, code, len(names) + where)
        inside = np.zeros(len(code), np.int64)  # place of each value within its level
        out: list[pa.StringArray] = []
        for depth, at in enumerate(self._by_level):
            inside[at] = np.arange(len(at))
            if depth == 0:
                out.append(pa.array([root] * len(at), pa.string()))
            else:
                up = out[-1].take(pa.array(inside[self.parent[at]]))
                out.append(pc.binary_join_element_wise(up, steps.take(pa.array(step[at])), ""))
        if not out:
            return pa.array([], pa.string())
        back = np.empty(len(code), np.int64)
        back[np.concatenate(self._by_level)] = np.arange(len(code))
        return pa.concat_arrays(out).take(pa.array(back))

    def member_names(self, which: np.ndarray) -> pa.StringArray:
        """The member names of the values with these numbers; '' in an array, at the root and for -1."""
        code, names = self._names
        code = np.where(which >= 0, code[np.maximum(which, 0)], -1) if len(code) else np.full(len(which), -1)
        return pa.concat_arrays([names, pa.array([""], pa.string())]).take(pa.array(np.where(code >= 0, code, len(names))))

    def having(self, name: str, kinds: set[int], pattern: str | None = None) -> np.ndarray:
        """For each value whether it is an object with a member of that name and kind (for scalars: spelled like the pattern)."""
        out = np.zeros(len(self.doc), bool)
        code, names = self._names
        at = np.flatnonzero(self.alive & np.isin(code, [i for i, x in enumerate(names.to_pylist()) if x == name]) & np.isin(self.kind, list(kinds)))
        if pattern is not None and len(at):
            spelled = self._raw(self.start[at], self.stop[at]).dictionary_encode()
            right = np.array([bool(re.fullmatch(pattern.encode(), x)) for x in spelled.dictionary.to_pylist()], bool)
            at = at[right[spelled.indices.to_numpy()]]
        out[self.parent[at]] = True
        return out

    @functools.cached_property
    def enclosing(self) -> np.ndarray:
        """Number of the nearest enclosing object of each value, -1 for none."""
        out = np.full(len(self.doc), -1, np.int64)
        for at in self._by_level[1:]:
            up = self.parent[at]
            out[at] = np.where(self.kind[up] == _OBJECT, up, out[up])
        return out

    def written(self) -> tuple[np.ndarray, pa.StringArray]:
        """Numbers and values of the strings that are not blank."""
        at = np.flatnonzero(self.alive & (self.kind == _STRING))
        values = self.strings(at)
        # blank ones begin with a blank: only those are looked at one by one
        doubtful = np.flatnonzero(pc.match_substring_regex(values, r"^(?:$|[\s\x1c-\x1f\x85\p{Z}])").to_numpy(zero_copy_only=False))
        keep = np.ones(len(at), bool)
        keep[doubtful] = [bool(x) and not x.isspace() for x in values.take(pa.array(doubtful)).to_pylist()]
        return at[keep], values.filter(pa.array(keep))

    def nodes(self) -> dict[str, list]:
        """``node_columns`` as lists."""
        return {k: v.to_pylist() for k, v in self.node_columns().items()}

    def node_columns(self) -> dict[str, pa.Array]:
        """Objects below the root and non-blank texts, with path, nearest enclosing object and the value of texts."""
        path = self.chained("$", lambda x: "." + x if _PLAIN_NAME.fullmatch(x) else f"['{x}']", "[{}]".format)
        text, values = self.written()
        objects = np.flatnonzero(self.alive & (self.kind == _OBJECT) & (self.level > 0))
        at = np.concatenate([objects, text])
        holder = self.enclosing[at]
        parent = path.take(pa.array(np.maximum(holder, 0))) if len(path) else path
        parent = pc.if_else(pa.array(holder >= 0), parent, "$")
        kind = pa.array(["object"] * len(objects) + ["text"] * len(text), pa.string())
        return {"doc": pa.array(self.doc[at], pa.int64()), "parent_path": parent, "path": path.take(pa.array(at)), "kind": kind,
                "value": pa.concat_arrays([pa.nulls(len(objects), pa.string()), values]), "depth": pa.array(self.level[at], pa.int32())}


def _pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        yield batch.slice(start), texts[start:]


def mark_readable(df: DataFrame, body: str, flag: str = "readable") -> DataFrame:
    """``df`` with a flag: the body is one JSON value. Null and empty bodies are not; a byte-order mark or outer blanks do no harm."""
    schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, body):
            valid = Index(texts).valid
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(valid)], names=[*rows.schema.names, flag])

    return df.mapInArrow(run, schema)


def flatten_json(df: DataFrame, body: str, ids: list[str]) -> DataFrame:
    """Linked rows (*ids, parent_path, path, kind, value, depth) of every object below the root and every non-blank text.

    Bodies that are no JSON give no rows. ``ids`` are columns of ``df`` carried along; they must not be named as the results.
    """
    chosen = df.select(*ids, body)
    fields = [chosen.schema[i] for i in ids]
    out = [T.StructField("parent_path", T.StringType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()),
           T.StructField("value", T.StringType()), T.StructField("depth", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, body):
            found = Index(texts).node_columns()
            take = found.pop("doc")
            yield pa.RecordBatch.from_arrays([*[rows.column(i).take(take) for i in ids], *[found[f.name] for f in out]], names=[*ids, *[f.name for f in out]])

    return chosen.mapInArrow(run, T.StructType([*fields, *out]))


def latest_readable(df: DataFrame, file: str = "file", body: str = "body", loaded_at: str = "loaded_at", number: str = "delivery_no") -> DataFrame:
    """(file, body) of the readable delivery of each file that was loaded last; equal times: the larger number, then text.

    The aggregation combines on the map side, so a file with very many deliveries sends one row per task.
    """
    marked = mark_readable(df.select(file, loaded_at, number, body), body).where("readable")
    best = marked.groupBy(file).agg(F.max(F.struct(loaded_at, number, body)).alias("_m"))
    return best.select(file, F.col(f"_m.{body}").alias(body))
