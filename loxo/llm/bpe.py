"""Byte-level BPE by a tokenization automaton.

Compilation.  The automaton starts with one state per byte, in which every
byte may follow, and takes the merges in order of rank.  The gadget of merge
(u, v) -> w removes the arc v from the state that u leads to, adds an arc w
beside every arc u that still has v behind it, and lets w lead to a copy of
the state behind v as it is at that time.  All arcs with one label lead to one
state, so the state after a token is that token's own, and whether state q has
an arc w unrolls into the arcs that were there when the gadgets were added:

* (q, byte) is there unless a gadget removed it,
* (q, w), w = uv added at rank r, is there if (q, u) was there at r, and no
  gadget removed (q, w) since,
* the state of w = uv is a copy of that of v at rank r: what was removed
  before r stays removed, what is removed from v later does not count.

So the arcs are a table over pairs of tokens, filled in as text asks for them
(``_Automaton.arc``, bounded); the whole table would have vocabulary squared entries.

Encoding runs the automaton over a pre-split word: at each place the longest
spelling in a trie that has an arc from the state before it is taken, else its
next shorter prefix; if none has, the step before is undone and its place
marked, for the path that leads to a place is the only one.  So each place is
left at most once.  Decoding emits the labels (byte strings) of the arcs.

Words are encoded once per worker and kept in a bounded memo.

Defined cases: null text counts as empty: no ids, empty text; ids that are not
in the vocabulary raise on decoding; special tokens in a text become their
own ids, as the library does by default; repeated rows are encoded one by
one; columns pass through, except that result columns replace those of their
name.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT

#: The pre-split of byte-level vocabularies (a fixed public pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where letters and digits are those that Python's own engine knows by \\w and \\d; ODD finds texts for which that isn't so.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
MEMO = 400_000
LONG = 64
#: Tokens of an output batch.
FLUSH = 1 << 19


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Automaton:
    def __init__(self, spec: dict) -> None:
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        spell = lambda s: bytes(letters[c] for c in s)
        self.labels = {i: spell(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        by_bytes = {spell(s): i for s, i in vocab.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}  # w: u, v and the rank of its gadget
        self.removed: dict[tuple[int, int], int] = {}  # (u, v): the rank of the gadget that removed the arc
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            u, v = vocab[left], vocab[right]
            self.removed[u, v] = rank
            self.parts.setdefault(vocab[left + right], (u, v, rank))
        self.never = len(self.removed)
        self.table: dict[int, bool] = {}
        self.trie: dict = {}  # over the spellings of what merges can make; key -1 holds the token
        self.shorter: dict[int, int | None] = {}
        made = [(b, i) for b, i in by_bytes.items() if len(b) == 1 or i in self.parts and self._there(*self.parts[i])]
        for b, i in sorted(made):
            node, prefix = self.trie, None
            for x in b:
                prefix = node.get(-1, prefix)
                node = node.setdefault(x, {})
            node[-1] = i
            self.shorter[i] = prefix
        self.size = {i: len(b) for i, b in self.labels.items()}
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(names) + ")") if names else None
        self.any_words, self.plain_words = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall
        self.memo: dict[str, tuple] = {}

    def _gone(self, q: int, t: int, until: int) -> bool:
        """Whether a gadget before ``until`` removed arc t from q's state, by itself or from the state that q's was copied from."""
        while True:
            if self.removed.get((q, t), self.never) < until:
                return True
            if q not in self.parts:
                return False
            _, q, born = self.parts[q]
            until = min(until, born)

    def _there(self, q: int, t: int, until: int) -> bool:
        """Whether the state behind q had arc t before the gadget of rank ``until``."""
        while not self._gone(q, t, until):
            if t not in self.parts:
                return True
            # Arc u must have been there when uv was added, after that gadget's own removal (which counts for u = v).
            t, _, born = self.parts[t]
            until = min(until, born + 1)
        return False

    def arc(self, q: int, t: int) -> bool:
        """Whether the finished automaton has arc t in the state behind q."""
        key = q << 32 | t
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = self._there(q, t, self.never)
        return found

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-split word."""
        n, trie, shorter, size, table = len(data), self.trie, self.shorter, self.size, self.table
        path: list[int] = []
        dead: set[int] = set()
        at = 0
        while at < n:
            node, t, i = trie, None, at
            while i < n and (node := node.get(data[i])) is not None:
                t = node.get(-1, t)
                i += 1
            while True:
                if t is None:
                    dead.add(at)
                    t = path.pop()
                    at -= size[t]
                    t = shorter[t]
                    continue
                if at + size[t] in dead:
                    t = shorter[t]
                    continue
                if not path:
                    break
                ok = table.get(path[-1] << 32 | t)
                if self.arc(path[-1], t) if ok is None else ok:
                    break
                t = shorter[t]
            path.append(t)
            at += size[t]
        return path

    def encode(self, text: str) -> tuple[list[str], int, list[bytes]]:
        """Ids as decimal strings per word, how many, and the labels emitted on the way back from these ids."""
        memo, said, count, labels = self.memo, [], 0, []
        words = self.any_words if ODD.search(text) else self.plain_words
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
            if part in self.special:
                i = self.special[part]
                said.append(str(i))
                labels.append(self.labels[i])
                count += 1
                continue
            for w in words(part):
                known = memo.get(w)
                if known is None:
                    ids = self.word(w.encode("utf-8", "surrogatepass"))
                    known = (",".join(map(str, ids)), len(ids), b"".join([self.labels[i] for i in ids]))
                    if len(w) <= LONG:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[w] = known
                        if len(self.table) >= MEMO:
                            self.table.clear()
                said.append(known[0])
                count += known[1]
                labels.append(known[2])
        return said, count, labels


@lru_cache(maxsize=2)
def automaton(text: str) -> _Automaton:
    """The automaton of a tokenizer file's text, once per worker."""
    return _Automaton(json.loads(text))


KEPT["bpe"] = automaton.cache_clear


def _vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _source(docs: DataFrame, path: str):
    """The vocabulary as a broadcast: its size is the file's, a few MB, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(_vocabulary(path))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>)."""
    spec = _source(docs, path)

    @F.pandas_udf("array<int>")
    def ids(column: pd.Series) -> pd.Series:
        a = automaton(spec.value)
        return column.map(lambda t: [int(i) for w in a.encode(t or "")[0] for i in w.split(",")])

    return docs.drop(*[c for c in docs.columns if c.lower() == "ids"]).withColumn("ids", ids(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded (string): labels of the ids' arcs, bytes that are no UTF-8 replaced."""
    spec = _source(df, path)

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        labels = automaton(spec.value).labels
        return column.map(lambda x: b"".join([labels[i] for i in (() if x is None else x)]).decode("utf-8", "replace"))

    return df.drop(*[c for c in df.columns if c.lower() == "decoded"]).withColumn("decoded", decoded(F.col(f"`{ids}`")))


def tokenized(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens (long), ids (array<int>) and round_trip (boolean: decoding the ids gives the text), in one pass.

    Ids leave in batches of about ``FLUSH`` tokens, in one buffer each; a longer text's come alone.
    """
    made = {"n_tokens", "ids", "round_trip"}
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made or c.lower() == text.lower()])
    spec, at = _source(docs, path), [c.lower() for c in df.columns].index(text.lower())
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in made]

    def run(batches):
        a = automaton(spec.value)
        for batch in batches:
            first, held, rows, counts, right = 0, 0, [], [], []

            def flush(upto):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))
                return pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, upto - first) for i in kept), pa.array(counts, pa.int64()), ids, pa.array(right, pa.bool_())], names=names)  # noqa: B023

            for i, t in enumerate(batch.column(at)):
                body = t.as_py() or ""
                ids = np.fromiter((int(x) for w in a.encode(body)[0] for x in w.split(",")), np.int32)
                if rows and held + len(ids) > FLUSH:
                    yield flush(i)
                    first, held, rows, counts, right = i, 0, [], [], []
                right.append(b"".join([a.labels[x] for x in ids.tolist()]).decode("utf-8", "replace") == body)
                rows.append(ids)
                counts.append(len(ids))
                held += len(ids)
            if counts:
                yield flush(batch.num_rows)

    schema = T.StructType([*(df.schema.fields[i] for i in kept), *T._parse_datatype_string("n_tokens long, ids array<int>, round_trip boolean").fields])
    names = schema.names
    return df.mapInArrow(run, schema)


def encode_digest(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, without building arrays of ids."""
    spec = _source(docs, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(column: pd.Series) -> pd.DataFrame:
        a, rows = automaton(spec.value), []
        for t in column:
            said, n, labels = a.encode(t or "")
            back = b"".join(labels).decode("utf-8", "replace")
            rows.append((n, hashlib.sha256(",".join(said).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_d")).select(*keep, "_d.*")
