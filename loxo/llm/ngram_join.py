"""N-gram Jaccard join by PartEnum signatures: every pair of sets with similarity 0.8 or more.

Sets r and s with Jaccard similarity of at least 80 / 100 differ in at most
K = floor((|r| + |s|) / 9) features, and the larger has at most 5/4 of the
smaller's size.  So each set knows the largest K it can share with a partner.

Signatures (equal-size bands, partitions of the feature domain, subsets):

* Bands of sizes [l, 1.5 l) have a scheme each: the hash domain is cut into G
  groups of 3 parts.  A set signs in the scheme of its band and, if a partner
  can lie there, in the next one; partners so share a scheme.
* If K features differ, then fewer than K/2 + 1 groups hold two or more of the
  differences; a group that holds at most one has two equal parts.  Signatures
  are the three 2-subsets of a group's parts, with what the set has in them.
* A group is thin for a set if its features lie in one part or none.  In order
  of groups, a set signs all of them up to its (floor(K/2) + 1)-th that isn't
  thin.  Let j be the first group that isn't thin in r and holds at most one
  difference: it has two equal parts that aren't empty; before it every group
  that isn't thin, in r or in s, holds two differences or more, of which there
  are at most K/2; so both sets sign j, and meet.
* Passages that many documents share would meet in thin signatures.  Leaving
  the same features out of all sets makes no difference larger, so sets sign
  first without frequent features, those that a count-min sketch of fixed size
  over all texts marks, and K stays that of the whole sets.
* If there is no such group, each has at most K/2 groups that aren't thin, and
  both know this of themselves.  Such sets sign again, whole and under another hash, and
  after ``SEEDS`` hashes in one signature of the scheme.
* Sets under ``SMALL`` features sign instead with the 2-subsets of their K + 2
  smallest hashes, of which partners share two at least (without the frequent
  ones first, and whole too if fewer than K + 2 are left); sets that can have
  a partner under SMALL do both.

Copies have one class, the hash of their set; each task signs a class once, so a
group of copies sends as many rows to a signature as there are tasks, not as it
has members.  Rows that share a signature are grouped in one exchange; the
smallest class of a bucket is its pivot.  Each class is compared with the one
of its pivots with which it shares most signatures, and links are contracted to
components; so a bucket of n costs n comparisons.

Then only buckets with more than one component are looked into.  Their rows
bring the parities of their set in ``PARITIES`` cells of the hash domain: each
feature that differs turns one parity, so parities differ in at most K places
between partners, and pairs beyond that are no partners.  In rounds, each class
is compared with the nearest by parities of the classes of another component
that stand beside it in a bucket, and links are contracted, until hardly a
comparison finds a link.  Last, the buckets that are torn still are compared
in a stream, in memory, and all pairs of different components that pass go on
to the comparison of whole texts.  A bucket of more than ``BIG`` members is first cut by signatures
under a further hash of all its members, of which partners share one too.  So
no link between components is lost, no join makes the pairs of a bucket, and
no pairs are made within a group that holds together.  Texts are picked out of
the table for the candidates alone, by a Bloom filter of a bounded size.

Defined cases: null and empty texts, or white space only, have the empty set,
size 0, and are linked with nothing; equal sets are linked; rows with equal
doc_id are separate documents; a null doc_id is never a component's name if
the component has another; ids may have any type that has an order; an empty
table gives an empty result; other columns are not returned, so names can't
clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.components import connected_components
from .common import checkpointed, let_go, partitions, release, small_batches, written
from .shingles import U, batched, mixed, shingle_sets

SMALL, SEEDS, WIDTH = 40, 4, 5
#: Bits of the Bloom filter a candidate, and the most it may have in all (16 MB); when it is fuller more rows pass, which the join behind it drops.
BLOOM_EACH, BLOOM_MOST = 8, 1 << 27
#: Bytes of the pieces in which it is put together.
BLOOM_PIECE = 1 << 14
CELLS, STRETCHES = 1 << 22, 128
#: A feature is frequent if so many classes have it, and so many times the mean of the sketch's cells.
FREQUENT, ABOVE_MEAN = 64, 4
PARITIES, BIG = 512, 4096
#: Rows that are dealt together, and pairs that a task remembers.
SHARE, SEEN = 50_000, 2_000_000
#: Links to a task when components are found.
LINKS = 100_000
_SALT = U(0xA0761D6478BD642F)
_WAY = (U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3))


def _bands(upto: int) -> list[int]:
    edges = [SMALL]
    while edges[-1] <= upto:
        edges.append(edges[-1] * 3 // 2)
    return edges


_EDGES = _bands(1 << 40)


def _groups(band: int) -> int:
    """How many groups band's scheme has: somewhat more than the largest K/2 + 1."""
    t = (2 * (_EDGES[band + 1] - 1) // 9) // 2 + 1
    return int(np.ceil(1.2 * t + 2 * np.sqrt(t)))


def class_id(s: np.ndarray) -> int:
    """The hash of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(s ^ _SALT)) if len(s) else U(0)
        return int(mixed(np.array([total + U(len(s))], np.uint64)).view(np.int64)[0])


def _pairs(s: np.ndarray, k: int, tag: int) -> np.ndarray:
    head = s[: k + 2]
    a, b = np.triu_indices(len(head), 1)
    return mixed(head[a] * _WAY[0] + head[b] * _WAY[1] + U(tag))


def _small(s: np.ndarray, rare: np.ndarray, k: int) -> np.ndarray:
    if len(rare) >= k + 2:
        return _pairs(rare, k, 7)
    return np.concatenate([_pairs(rare, k, 7), _pairs(s, k, 8)])


def _scheme(s: np.ndarray, rare: np.ndarray, band: int, k: int) -> np.ndarray:
    groups, need, out = _groups(band), k // 2 + 1, []
    for seed in range(SEEDS):
        x = rare if seed == 0 else np.sort(mixed(s ^ (_SALT + U(seed))))
        cell = ((x >> U(32)) * U(3 * groups)) >> U(32)
        cut = np.searchsorted(cell, np.arange(3 * groups + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x + _SALT))])
        has = (cut[1:] > cut[:-1]).reshape(groups, 3)
        held = (sums[cut[1:]] - sums[cut[:-1]]).reshape(groups, 3)
        full = np.cumsum(has.sum(1) > 1)
        last = int(np.searchsorted(full, need)) + 1 if full[-1] >= need else groups
        name = mixed(np.arange(last, dtype=np.uint64) + U((band * SEEDS + seed) << 40))
        for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            pick = has[:last, a] | has[:last, b]
            out.append(mixed(held[:last, a][pick] * _WAY[a] + held[:last, b][pick] * _WAY[b] + name[pick] * _WAY[i] + U(i)))
        if full[-1] >= need:
            return np.concatenate(out)
    return np.concatenate([*out, mixed(np.array([band], np.uint64) + _SALT)])


def signatures(s: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
    """All signatures of a set; none where only an equal set can be a partner.  frequent marks features to be left out where the rest will do."""
    n = len(s)
    largest = n * 5 // 4
    if (n + largest) // 9 == 0:
        return np.empty(0, np.uint64)
    out = []
    rare = s if frequent is None else s[~frequent]
    with np.errstate(over="ignore"):
        if n * 4 < SMALL * 5 - 4 or n < SMALL:
            out.append(_small(s, rare, (n + largest) // 9))
        if largest >= SMALL:
            band = max(int(np.searchsorted(_EDGES, n, side="right")) - 1, 0)
            if n >= SMALL:
                out.append(_scheme(s, rare, band, (n + min(largest, _EDGES[band + 1] - 1)) // 9))
                if largest >= _EDGES[band + 1]:
                    out.append(_scheme(s, rare, band + 1, (n + largest) // 9))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _cells(x: np.ndarray) -> np.ndarray:
    return np.stack([mixed(x + _WAY[i]) % U(CELLS) for i in range(2)]).astype(np.int64)


def _unseen(own: list[int], seen: set) -> list[int]:
    """Places of the classes that the task hasn't met yet."""
    out = []
    for i, c in enumerate(own):
        if c not in seen:
            seen.add(c)
            out.append(i)
    return out


def _frequent(docs: DataFrame):
    """Which cells of two hashes hold frequent features, as a broadcast of two bitmaps of CELLS bits whatever the corpus.

    A count-min sketch over all texts: each task counts its classes into
    2 * CELLS cells, which are added up by stretches of cells, beyond 64 tasks
    in two steps, so that no task holds a row of every other.
    """
    width = CELLS // STRETCHES

    def count(batches):
        let_go()
        counts, seen = np.zeros((2, CELLS), np.uint32), set()
        for batch in batches:
            for _, part in batched(batch.column(0).to_pylist()):
                sets = shingle_sets(part, WIDTH)
                new = _unseen([class_id(s) for s in sets], seen)
                if new:
                    for row, cell in enumerate(_cells(np.concatenate([sets[i] for i in new]))):
                        np.add.at(counts[row], cell, np.uint32(1))
        if counts.any():
            yield stretches(dict(enumerate(counts.reshape(2 * STRETCHES, width))))

    def stretches(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(r, 65535).astype(np.uint16).tobytes() for r in sums.values()], pa.binary())], names=["stretch", "counts"])

    def add_some(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(r.as_buffer(), np.uint16).astype(np.uint32)
        if sums:
            yield stretches(sums)

    def add(key, rows):  # a stretch of 64 KB from each of 64 tasks at most
        total = np.zeros(width, np.int64)
        for r in rows.column("counts"):
            total += np.frombuffer(r.as_buffer(), np.uint16)
        marked = np.packbits(total > np.maximum(FREQUENT, ABOVE_MEAN * total.mean()))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([marked.tobytes()], pa.binary())], names=["stretch", "bits"])

    parts = docs.select("text").mapInArrow(count, "stretch int, counts binary")
    if docs.rdd.getNumPartitions() > 64:
        parts = parts.withColumn("task", F.spark_partition_id() % 64).repartition(64, "task").drop("task").mapInArrow(add_some, "stretch int, counts binary")
    rows = parts.groupBy("stretch").applyInArrow(add, "stretch int, bits binary").collect()
    bits = np.zeros((2 * STRETCHES, width // 8), np.uint8)
    for r in rows:
        bits[r.stretch] = np.frombuffer(bytes(r.bits), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits.reshape(2, CELLS // 8))


def _marked(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = _cells(x)
    return (((bits[0][a >> 3] >> (7 - (a & 7))) & (bits[1][b >> 3] >> (7 - (b & 7)))) & 1).astype(bool)


def _signing(frequent, kind: pa.DataType):
    """Makes rows (sig, class, n, doc_id, row): a row per signature of a class with n > 0, and per document one with n = -1 - size."""

    def signed(batches):
        let_go()
        names, seen = ["sig", "class", "n", "doc_id", "row"], set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, part in batched(texts):
                sets = shingle_sets(part, WIDTH)
                size = np.array([len(s) for s in sets], np.int32)
                own = np.array([class_id(s) for s in sets], np.int64)
                spread = mixed(np.arange(len(part), dtype=np.uint64) + own.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(own), pa.array(-1 - size), batch.column(0).slice(first, len(part)), batch.column(2).slice(first, len(part))], names=names)
                new = _unseen(own.tolist(), seen)
                if not new:
                    continue
                marks = np.split(_marked(frequent.value, np.concatenate([sets[i] for i in new])), np.cumsum(size[new])[:-1])
                sigs = [signatures(sets[i], f) for i, f in zip(new, marks, strict=True)]
                lengths = np.array([len(g) for g in sigs])
                if total := int(lengths.sum()):
                    flat = np.concatenate(sigs).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(own[new], lengths)), pa.array(np.repeat(size[new], lengths)), pa.nulls(total, kind), pa.nulls(total, pa.int64())], names=names)

    return signed


def _shared(batches):
    """From rows in order of sig: documents as they are, and for each bucket of two classes or more its members but the first met, with that as pivot.  One row is held over.

    The order has one key, so Spark sorts it by radix; the few rows that share a sig are put in order of class here.
    """
    let_go()
    last = None
    names = ["sig", "class", "n", "doc_id", "row", "pivot", "pivot_n"]
    for batch in batches:
        n = batch.column(2).to_numpy()
        doc = np.flatnonzero(n < 0)
        if len(doc):
            d = batch.take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([*d.columns, pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int32())], names=names)
        at = np.flatnonzero(n > 0)
        if not len(at):
            continue
        sig, cls, n = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], n[at]
        if last is not None:
            sig, cls, n = np.append(last[0], sig), np.append(last[1], cls), np.append(last[2], n)
        same = sig[1:] == sig[:-1]
        several = np.flatnonzero(np.append(same, False) | np.append(False, same))
        end = sig[-1], cls[-1], n[-1]
        if len(several):
            s, c, m = sig[several], cls[several], n[several]
            held = last is not None and several[0] == 0
            rank = np.argsort(c, kind="stable")
            if held:  # the pivot that was held over stays the first of its bucket
                rank = np.append(0, rank[rank != 0])
            rank = rank[np.argsort(s[rank], kind="stable")]
            s, c, m = s[rank], c[rank], m[rank]
            head = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), np.arange(len(s)), 0))
            k = np.flatnonzero((c != c[head]) & np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
            if s[-1] == end[0]:
                end = s[-1], c[head[-1]], m[head[-1]]
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(s[k]), pa.array(c[k]), pa.array(m[k]), pa.nulls(len(k), batch.column(3).type), pa.nulls(len(k), pa.int64()), pa.array(c[head[k]]), pa.array(m[head[k]])], names=names)
        last = end


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    x = ids.view(np.uint64)
    return np.stack([mixed(x + _WAY[i]) % U(size) for i in range(3)])


def _bloom(ids: DataFrame, size: int):
    """A Bloom filter of a column of longs, of ``size`` bits."""

    def build(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_bits(b.column(0).to_numpy(), size).ravel()] = True
        rows = np.packbits(bits).reshape(-1, BLOOM_PIECE)
        some = np.flatnonzero(rows.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["piece", "bits"])

    def either(key, rows):  # 16 KB from each of 64 tasks at most
        out = np.zeros(BLOOM_PIECE, np.uint8)
        for x in rows.column("bits"):
            out |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["piece", "bits"])

    # One Python operator a stage, so one worker a task.
    whole = np.zeros((size // 8 // BLOOM_PIECE, BLOOM_PIECE), np.uint8)
    for r in ids.coalesce(64).mapInArrow(build, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect():
        whole[r.piece] = np.frombuffer(bytes(r.bits), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole.tobytes())


def parities(s: np.ndarray) -> bytes:
    """Whether the set has an odd number of features in each of PARITIES cells."""
    return np.packbits((np.bincount((s % U(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).tobytes()


def _texts_of(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(class, text, sketch) of candidates(class, row), from docs(doc_id, text, row): equal rows are one."""
    size = max(1 << 20, min(BLOOM_MOST, 1 << (BLOOM_EACH * candidates.count()).bit_length()))
    bloom = _bloom(candidates.select("row"), size)

    def pick(batches):
        bits, seen = np.frombuffer(bloom.value, np.uint8), set()
        for batch in batches:
            b = _bits(batch.column(1).to_numpy(), size)
            hit = np.flatnonzero(((bits[b // U(8)] >> (U(7) - b % U(8)).astype(np.uint8)) & 1).all(0))
            found = batch.column(1).to_numpy()[hit].tolist()
            yield batch.take(pa.array(hit[_unseen(found, seen)]))

    def sketched(batches):
        for batch in batches:
            made = [parities(s) for _, part in batched(batch.column(1).to_pylist()) for s in shingle_sets(part, WIDTH)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["class", "text", "sketch"])

    found = docs.select("text", "row").mapInArrow(pick, "text string, row long").dropDuplicates(["row"])
    return found.join(candidates, "row").select("class", "text").mapInArrow(sketched, "class long, text string, sketch binary")


def _strangers(window: int | None):
    """From rows (sig, class, n, component, sketch) with the rows of a sig together: pairs (a, b, far) of a bucket in different components that sizes and parities don't rule out.

    Without a window these are all such pairs; with one, for each row the pair
    that is least far of those with the ``window`` rows before and after it.
    The rows of one bucket are held.  Buckets of a neighbourhood come one after
    the other, so most repeats of a pair are met, and left out, here.
    """
    seen: set = set()

    def pairs(sig, cls, n, part, sketch):
        ends = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig))
        upto = np.repeat(ends, np.diff(ends, prepend=0))
        at, found = np.arange(len(sig)), []
        best, mate = np.full(len(sig), np.inf), np.zeros(len(sig), np.int64)
        for step in range(1, min(len(sig), (window or len(sig)) + 1)):
            at = at[at + step < upto[at]]
            if not len(at):
                break
            i, j = at, at + step
            ok = (part[i] != part[j]) & (n[i] * 5 >= n[j] * 4) & (n[j] * 5 >= n[i] * 4)
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1)
            ok = apart <= (n[i] + n[j]) // 9
            if not ok.any():
                continue
            i, j, far = i[ok], j[ok], apart[ok] / (n[i[ok]] + n[j[ok]])
            if window is None:
                found.append((i, j, far))
                continue
            for x, y in ((i, j), (j, i)):
                less = far < best[x]
                best[x[less]], mate[x[less]] = far[less], y[less]
        if window is not None and len(i := np.flatnonzero(best < np.inf)):
            found.append((i, mate[i], best[i]))
        if found:
            i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
            names, once = np.unique(mixed(a.view(np.uint64)) ^ b.view(np.uint64), return_index=True)
            if len(seen) > SEEN:
                seen.clear()
            once = once[_unseen(names.tolist(), seen)]
            yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once]), pa.array(far[once])], names=["a", "b", "far"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            rows = [*(batch.column(k).to_numpy().astype(np.int64) for k in range(4)), sketch]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            last = int(np.flatnonzero(rows[0] != rows[0][-1]).max(initial=-1)) + 1
            if last:
                yield from pairs(*(x[:last] for x in rows))
            rest = [x[last:] for x in rows]
        if rest is not None:
            yield from pairs(*rest)

    return run


def _cut_finer(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows(sig, class, n, component, sketch, deal) of large buckets, cut by signatures under a further hash, of which partners share one too."""

    def finer(batches):
        for batch in batches:
            for first, part in batched(batch.column(6).to_pylist()):
                sigs = [signatures(np.sort(mixed(s ^ _WAY[0]))) for s in shingle_sets(part, WIDTH)]
                at = np.repeat(np.arange(first, first + len(part)), [len(g) for g in sigs])
                if len(at):
                    under = mixed(np.concatenate(sigs) ^ mixed(batch.column(0).to_numpy()[at].view(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(under), *(batch.column(k).take(pa.array(at)) for k in range(1, 6))], names=batch.schema.names[:6])

    return rows.join(texts.select("class", "text"), "class").select("sig", "class", "n", "component", "sketch", "deal", "text").mapInArrow(finer, rows.schema)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar enough; sets are made from the whole texts."""

    def compare(batches):
        memo: dict = {}

        def set_of(c: int, text: str | None):
            s = memo.get(c)
            if s is None:
                s = shingle_sets([(text or "").encode("utf-8", "surrogatepass")], WIDTH)[0]
                if class_id(s) != c:
                    return None
                if len(memo) >= 64:
                    memo.clear()
                memo[c] = s
            return s

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(len(a)):
                y = set_of(b[i], batch.column(3)[i].as_py())
                x = set_of(a[i], batch.column(2)[i].as_py())
                if x is None or y is None:
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if common * 100 >= (len(x) + len(y) - common) * 80:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    first = texts.select(F.col("class").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("class").alias("b"), F.col("text").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _can_match(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = 2, window: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (long), component_id (of doc_id's type).

    rounds, window: how often, at most, each class is compared with its nearest stranger, and among how many; they only spare comparisons.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    id_type = slim.schema["doc_id"].dataType
    with small_batches(spark):
        frequent = _frequent(slim)
    signed = slim.mapInArrow(_signing(frequent, to_arrow_type(id_type)), f"sig long, class long, n int, doc_id {id_type.simpleString()}, row long")
    with small_batches(spark, 4000):
        met = written(signed.repartition(partitions(spark), "sig").sortWithinPartitions("sig").mapInArrow(_shared, f"sig long, class long, n int, doc_id {id_type.simpleString()}, row long, pivot long, pivot_n int"))
    release(spark)
    every = met.where("n < 0").select("doc_id", "class", (-1 - F.col("n")).cast("long").alias("n_shingles"), "row")
    shared = met.where("n > 0").select("sig", "class", "n", "pivot", "pivot_n")
    # Of a class the smallest id, nulls last, and the row that has it.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = every.where("n_shingles > 0").groupBy("class").agg(least.alias("least")).select("class", F.col("least.doc_id").alias("first"), F.col("least.row").alias("row"))

    pivots = written(shared.where(_can_match("n", "pivot_n")).select(F.col("class").alias("a"), F.col("pivot").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared")))
    members = shared.select("class").unionByName(shared.select(F.col("pivot").alias("class"))).distinct()
    candidates = written(classes.join(members, "class", "left_semi").select("class", "row"))
    with small_batches(spark):
        texts = written(_texts_of(slim, candidates))
    release(spark)

    known_links = 0
    links = done = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, component long")
    named = lambda c, as_: labels.select(F.col("node").alias(c), F.col("component").alias(as_))
    def compared(pairs: DataFrame) -> int:
        """Compares pairs(a, b), takes the links in and returns how many there were."""
        nonlocal links, done, labels, known_links
        done = done.unionByName(pairs)
        with small_batches(spark, 500):
            more = written(_linked(pairs, texts))
        found = more.count()
        if found:
            known_links += found
            # Links are few beside rows: as many tasks as they need, not as many as rows do.
            few = 1 + known_links // LINKS
            links = written(links.unionByName(more).coalesce(few))
            labels = connected_components(links, lambda df: checkpointed(df.coalesce(few)), few)
        return found

    compared(written(pivots.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))

    # What is left: buckets of several components.
    known = shared.join(named("class", "c"), "class", "left").join(named("pivot", "pc"), "pivot", "left").withColumns({"c": F.coalesce("c", "class"), "pc": F.coalesce("pc", "pivot")})
    known = written(known.select("sig", "class", "n", "c", "pivot", "pivot_n", "pc"))
    # Buckets go to a task by their smallest component, those of a component with very many rows in shares.
    torn = written(known.groupBy("sig").agg(F.min(F.least("c", "pc")).alias("low"), F.max(F.greatest("c", "pc")).alias("high"), F.count("*").alias("size")).where("low < high").select("sig", "low", "size"))
    shares = torn.groupBy("low").agg(F.ceil(F.sum("size") / SHARE).alias("shares"))
    torn = torn.join(shares, "low").select("sig", F.xxhash64("low", F.pmod(F.xxhash64("sig"), F.col("shares"))).alias("deal"))
    inside = known.select("sig", "class", "n").unionByName(known.groupBy("sig").agg(F.min(F.struct("pivot", "pivot_n")).alias("p")).select("sig", F.col("p.pivot").alias("class"), F.col("p.pivot_n").alias("n")))
    rows = written(inside.join(torn, "sig").join(texts.select("class", "sketch"), "class").select("sig", "class", "n", "sketch", "deal"))
    release(spark)

    def met_again(rows: DataFrame, window: int | None, *order) -> DataFrame:
        dealt = rows.select("sig", "class", "n", "component", "sketch", "deal").repartition(partitions(spark), "deal").sortWithinPartitions("deal", "sig", *order)
        return dealt.mapInArrow(_strangers(window), "a long, b long, far double").join(done, ["a", "b"], "left_anti")

    placed = lambda: rows.join(named("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    for k in range(rounds):
        near = met_again(placed(), window, F.xxhash64("class", F.lit(k)))
        either = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
        nearest = either.groupBy("a").agg(F.min(F.struct("far", "b"))["b"].alias("b"))
        pairs = written(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        n = pairs.count()
        found = compared(pairs)
        release(spark)
        if found * 10 <= n:
            break

    # All pairs of what is torn still.
    still = written(placed())
    torn = still.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("sig", "size")
    rest = still.join(torn, "sig")
    if torn.where(F.col("size") > BIG).limit(1).count():
        with small_batches(spark):
            finer = written(_cut_finer(rest.where(F.col("size") > BIG).select("sig", "class", "n", "component", "sketch", "deal"), texts))
        rest = rest.where(F.col("size") <= BIG).drop("size").unionByName(finer)
    compared(written(met_again(rest, None, "class").select("a", "b").distinct()))
    release(spark)

    named_classes = classes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = named_classes.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named_classes.join(names, "component").select("class", "component_id")
    out = every.join(by_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
