"""Near-duplicates: MinHash, banding, signature verification, exact confirmation,
and connected components by alternating large-star and small-star.

1. Each text gets a digest of its words and a signature of `bands * rows` minima, under
   universal hash functions, of its shingles (five consecutive words, A-Z lower-cased).
   Texts of equal words are one class from here on, however many there are.
2. Classes that agree in a whole band share a bucket. The least class of a bucket is its
   hub. First every member is paired with its hubs only; these pairs are verified by
   signature, then on the full sets, and what is linked is one component so far.
3. Buckets that still hold several components are compared pair by pair across them, in
   blocks of a bounded number of signatures. What comes out isn't pairs (a group of m near
   copies has m * m) but classes: those with a pair that passes, for each pair of blocks of texts
   it stands in. These block pairs are verified on the full sets.
4. The components of all confirmed links are the groups.

Texts are fetched for classes of pairs that passed the signature check only, and are verified in
blocks of a bounded number of bytes: a text goes once to each pair of blocks in which it has
such pairs. A block keeps track of what it has linked and skips pairs that are linked already.
Links rest on words, not on hashes: shingles that agree by hash are compared byte by byte.

A pair at the threshold is missed with probability (1 - 0.85 ** rows) ** bands, about
2e-6, and by the signature check with about 3e-6. No bucket or candidate is capped. The work
is in proportion to the pairs within buckets that hubs don't link.

Defined cases: null, empty and wordless texts have no shingles and are linked with
nothing; fewer words than a shingle's are one shingle; repeated rows and equal texts
are linked; a null id never names a group unless its group has no other; an empty
table gives no rows; other columns pass through `dedup` and are left out by `groups`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, fresh, map_batches, spans_of_rows, texts
from tidemark.llm.components import components
from tidemark.llm.words import BY_SPACE, join, mix, split

SHINGLE, BANDS, ROWS = 5, 28, 6
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Signatures that are compared with each other at once; larger buckets are dealt over pairs of such blocks.
BLOCK = 1024
#: Bytes of text of one block that is verified; a task holds two blocks, or two texts that are longer.
BLOCK_BYTES = 4 << 20
#: Candidate classes up to which their ids are broadcast (about 90 bytes each).
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240610)
_A = _rng.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, 1024, dtype=np.uint32)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles (as 64-bit hashes) of each text."""
    data, offsets = texts(column)
    for a, b in spans_of_rows(offsets):
        w = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SPACE)
        runs = join(w.hash, k)
        for r in range(b - a):
            lo, hi = int(w.first[r]), int(w.first[r + 1])
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            else:
                yield mix(join(w.hash[lo:hi], hi - lo) + np.uint64(hi - lo)) if hi > lo else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """Minima of k multiply-add hash functions over the shingles."""
    low = np.full(k, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        h = short[i : i + 2048, None] * _A[:k] + _B[:k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(0), out=low)
    return low


def sketch(docs: DataFrame, k: int, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, th (hash of the text), n (shingles), size (bytes), node (digest of the words) and sig of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, size, node, sig = [], [], [], []
                for s, body in zip(shingle_sets(part.column(2), shingle), part.column(2)):
                    raw = body.as_py().encode() if body.is_valid else b""
                    n.append(len(s))
                    size.append(len(raw))
                    node.append(hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest())
                    sig.append(signature(s, k).tobytes())
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "th", "n", "size", "node", "sig"])

        return step

    return map_batches(docs.select(key, F.xxhash64(text).alias("th"), text), make, f"key {kind}, th long, n long, size long, node binary, sig binary")


def band_keys(bands: int, rows: int):
    """Arrow function: signatures to the keys of their bands."""

    @F.arrow_udf("array<bigint>")
    def of(sig: pa.Array) -> pa.Array:
        if not len(sig):
            return pa.array([], pa.list_(pa.int64()))
        s = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), bands, rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
        for i in range(rows):
            key = mix(key + s[:, :, i])
        return pa.ListArray.from_arrays(np.arange(0, bands * len(sig) + 1, bands, dtype=np.int32), key.astype(np.int64).reshape(-1))

    return of


# Signatures ------------------------------------------------------------------------------------


def least_agreement(k: int, percent: int) -> float:
    """Equal minima that a pair at the threshold falls short of with a probability of about 3e-6."""
    share = percent / 100
    return k * (share - 4.5 * (share * (1 - share) / k) ** 0.5)


def _agree(k: int, percent: int):
    """Arrow function: whether two signatures and sizes of sets may belong to a linked pair."""

    @F.arrow_udf("boolean")
    def of(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), k) for c in (a, b))
        n, m = np.asarray(n), np.asarray(m)
        return pa.array(((x == y).sum(1) >= least_agreement(k, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))

    return of


#: Columns of a row of a bucket, sorted by the first three. spot: the block its text is verified in.
_BUCKET = ("band", "lo", "hi", "node", "own", "block", "spot", "n", "sig")


def _across(rows: list[tuple], percent: int) -> set[tuple[int, bytes, bytes]]:
    """(pair of text blocks, node, own) of the classes that have a pair with another component that passes. rows: whole buckets."""
    m, out = len(rows), set()
    group = np.cumsum([0, *(rows[i][:3] != rows[i - 1][:3] for i in range(1, m))])
    names: dict[bytes, int] = {}
    own = np.array([names.setdefault(r[4], len(names)) for r in rows])
    split_, block, spot, n = np.array([r[1] != r[2] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows]), np.array([r[7] for r in rows])
    sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(m, -1)
    least = least_agreement(sig.shape[1], percent)
    for d in range(1, m):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same & (own[d:] != own[:-d]) & (~split_[d:] | (block[d:] != block[:-d])) & (100 * np.minimum(n[d:], n[:-d]) >= percent * np.maximum(n[d:], n[:-d])))
        for at in range(0, len(i), 16_384):
            a = i[at : at + 16_384]
            a = a[(sig[a] == sig[a + d]).sum(1) >= least]
            pair = mix(mix(np.minimum(spot[a], spot[a + d]).view(np.uint64)) ^ np.maximum(spot[a], spot[a + d]).view(np.uint64)).view(np.int64)
            for x, j in zip(pair.tolist(), a.tolist()):
                out.add((x, rows[j][3], rows[j][4]))
                out.add((x, rows[j + d][3], rows[j + d][4]))
    return out


def _buckets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in chain(batches, [None]):
        for at in range(0, batch.num_rows, 1024) if batch else [None]:
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)) if batch else [None]:
                if row is None or (len(held) >= 2048 and row[:3] != held[-1][:3]):  # whole buckets only: one has at most two blocks
                    found = _across(held, percent) if held else ()
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary()))], ["pair", "node", "own"])
                    held = []
                held.append(row)


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["u", "v"])


# Full sets ------------------------------------------------------------------------------------------


class Text:
    """A text's shingles by hash, and its words as bytes."""

    def __init__(self, body: str, k: int) -> None:
        data, offsets = texts(pa.array([body], pa.string()))
        w = split(data, offsets, BY_SPACE)
        self.k = min(k, len(w.hash))
        self.keys, self.at = np.unique(join(w.hash, self.k), return_index=True)
        self.spelled = b" ".join(body.encode().lower().split())
        size = w.end - w.start + 1
        self.start = np.cumsum(size) - size
        self.end = self.start + size - 1

    def runs(self, at: np.ndarray) -> Iterator[bytes]:
        for a, b in zip(self.start[at].tolist(), self.end[at + self.k - 1].tolist()):
            yield self.spelled[a:b]


def linked(a: Text, b: Text, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; shingles that agree by hash are compared as bytes."""
    if a.k != b.k:
        return False
    if len(a.keys) > len(b.keys):
        a, b = b, a
    near = np.minimum(np.searchsorted(b.keys, a.keys), len(b.keys) - 1)
    same = b.keys[near] == a.keys
    both, total = int(same.sum()), len(a.keys) + len(b.keys)
    if 100 * both < percent * (total - both):
        return False
    both = sum(x == y for x, y in zip(a.runs(a.at[same]), b.runs(b.at[near[same]])))
    return 100 * both >= percent * (total - both)


class Joined:
    """Which of some nodes are linked so far, the texts of a pair of blocks, and the links found."""

    def __init__(self, shingle: int, percent: int) -> None:
        self.shingle, self.percent, self.bodies, self.sets, self.up = shingle, percent, {}, {}, {}

    def root(self, x: bytes) -> bytes:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def text(self, x: bytes) -> Text:
        if x not in self.sets:
            self.sets[x] = Text(self.bodies[x], self.shingle)
        return self.sets[x]

    def link(self, u: bytes, v: bytes) -> bool:
        """Whether u and v are newly linked."""
        if self.root(u) == self.root(v) or not linked(self.text(u), self.text(v), self.percent):
            return False
        self.up[self.root(u)] = self.root(v)
        return True


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links that span what is linked: rows (block pair, 0, node, -, body) and then (block pair, 1, u, v, -), sorted by the block pair."""
    now, state, out = None, Joined(shingle, percent), []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for pair, kind, u, v, body in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                if pair != now:
                    now, state = pair, Joined(shingle, percent)
                if kind == 0:
                    state.bodies[u] = body
                elif state.link(u, v):
                    out.append((u, v))
        if len(out) > 5000:
            yield _pairs_batch(out)
            out = []
    if out:
        yield _pairs_batch(out)


def _compare(rows: list[tuple], shingle: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that span what is linked among rows (node, own, n, sig, body) of different components."""
    if len(rows) < 2:
        return []
    state = Joined(shingle, percent)
    state.bodies = {r[0]: r[4] for r in rows}
    rows = list({r[0]: r for r in rows}.values())
    names: dict[bytes, int] = {}
    own = np.array([names.setdefault(r[1], len(names)) for r in rows])
    n = np.array([r[2] for r in rows])
    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), -1)
    least, out = least_agreement(sig.shape[1], percent), []
    for i in range(len(rows) - 1):
        fits = np.flatnonzero((own[i + 1 :] != own[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))) + i + 1
        agree = np.concatenate([np.zeros(0, int), *((sig[fits[at : at + 4096]] == sig[i]).sum(1) for at in range(0, len(fits), 4096))])
        order = np.argsort(-agree, kind="stable")
        for j in fits[order[: int((agree >= least).sum())]].tolist():
            if own[j] != own[i] and state.link(rows[i][0], rows[j][0]):
                out.append((rows[i][0], rows[j][0]))
                own[own == own[j]] = own[i]
    return out


def _compared(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links among rows (block pair, node, own, n, sig, body), sorted by the block pair."""
    now, rows = None, []
    for batch in chain(batches, [None]):
        for at in range(0, batch.num_rows, 256) if batch else [0]:
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)) if batch else [(None,)]:
                if row[0] != now:
                    out = _compare(rows, shingle, percent)
                    if out:
                        yield _pairs_batch(out)
                    now, rows = row[0], []
                rows.append(row[1:])


def verify(pairs: DataFrame, classes: DataFrame, placed: DataFrame, docs: DataFrame, repeated: bool, shingle: int, percent: int) -> tuple[DataFrame, str]:
    """Links (u, v) among pairs, as a table in the shared folder. placed: node, block."""
    spot = F.xxhash64(F.least("bu", "bv"), F.greatest("bu", "bv"))
    blocks = {x: placed.select(F.col("node").alias(x), F.col("block").alias(f"b{x}")) for x in "uv"}
    dealt, where = cut(pairs.join(blocks["u"], "u").join(blocks["v"], "v").select(spot.alias("pair"), "u", "v"), "dealt")
    ends = dealt.select("pair", "u").union(dealt.select("pair", "v")).distinct()
    bodies = texts_of(ends.select(F.col("u").alias("node")), classes, docs, repeated).withColumnRenamed("node", "u")
    none = F.lit(None)
    rows = ends.join(bodies, "u").select("pair", F.lit(0).alias("kind"), "u", none.cast("binary").alias("v"), "body")
    rows = rows.union(dealt.select("pair", F.lit(1), "u", "v", none.cast("string")))
    found = rows.repartition("pair").sortWithinPartitions("pair", "kind").mapInArrow(partial(_verified, shingle=shingle, percent=percent), "u binary, v binary")
    links, path = cut(found, "links")
    discard(docs.sparkSession, where)
    return links, path


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """node and body of some classes."""
    wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", "key", "th")
    bodies = _with_text(wanted, docs).select("node", "body")
    return bodies.dropDuplicates(["node"]) if repeated else bodies  # equal ids with equal texts would repeat a class


def _with_text(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates (node, key, th) with the text of the row they stand for."""
    body = docs.select(F.col("key").alias("_k"), F.xxhash64("text").alias("_t"), F.col("text").alias("body"))
    if candidates.count() <= BROADCAST_ROWS:  # else a shuffled join
        candidates = F.broadcast(candidates)
    return body.join(candidates, F.col("_k").eqNullSafe(F.col("key")) & (F.col("_t") == F.col("th")))


def groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, th, n_shingles, component_id (least key of the group) and kept of every row, as a table in the shared folder."""
    spark, gone = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = cut(df, name)
        gone.append(path)
        return out

    k = bands * rows
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    repeated = _repeated(docs)
    sketches = kept(sketch(docs, k, shingle, "text", "key"), "sketches")
    # one row for each distinct text; the least id (nulls last) stands for it
    first = F.struct(F.col("key").isNull().alias("none"), "key", "th", "n", "size", "sig")
    classes = kept(sketches.filter("n > 0").groupBy("node").agg(F.min(first).alias("r")).select("node", "r.key", "r.th", "r.n", "r.size", "r.sig"), "classes")
    members = classes.select("node", F.explode(band_keys(bands, rows)(F.col("sig"))).alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("hub")).filter("m > 1")
    buckets = kept(members.join(shared, "band"), "buckets")
    # only classes that share a bucket go on: what is joined below is this table, not that of all classes
    near = kept(classes.join(buckets.select("node").distinct(), "node", "left_semi"), "near")
    # where texts are verified: with the least hub's other members, in blocks of bounded size
    home = buckets.groupBy("node").agg(F.min("hub").alias("home")).join(near.select("node", "size"), "node")
    parts = home.groupBy("home").agg(F.ceil(F.sum("size") / block_bytes).cast("int").alias("parts"))
    placed = kept(home.join(parts, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1)))).alias("block")), "placed")
    # pairs with hubs
    sides = {x: near.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")) for x in "uv"}
    hubs = buckets.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    passing = hubs.join(sides["u"], "u").join(sides["v"], "v").filter(_agree(k, percent)("sig_u", "sig_v", "n_u", "n_v")).select("u", "v")
    links, path = verify(passing, near, placed, docs, repeated, shingle, percent)
    gone.append(path)
    own, path = components(links)
    gone.append(path)
    # pairs across what hubs linked, in buckets that hold more than one component
    of = buckets.join(own, "node", "left").withColumn("own", F.coalesce("component", "node"))
    mixed = of.groupBy("band").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a <> b").select("band")
    dealt = of.join(mixed, "band", "left_semi").withColumn("parts", F.ceil(F.col("m") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows_ = dealt.join(near.select("node", "n", "sig"), "node").join(placed.withColumnRenamed("block", "spot"), "node").select(*_BUCKET)
    rows_ = rows_.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")
    rest = kept(rows_.mapInArrow(partial(_buckets, percent=percent), "pair long, node binary, own binary").distinct(), "passing")
    if not rest.isEmpty():
        full = rest.join(near.select("node", "n", "sig"), "node").join(texts_of(rest.select("node"), near, docs, repeated), "node")
        full = full.select("pair", "node", "own", "n", "sig", "body").repartition("pair").sortWithinPartitions("pair", "node")
        links = kept(full.mapInArrow(partial(_compared, shingle=shingle, percent=percent), "u binary, v binary"), "links")
        for x in "uv":
            links = links.join(own.select(F.col("node").alias(x), F.col("component").alias(f"own_{x}")), x, "left").withColumn(x, F.coalesce(f"own_{x}", x)).select("u", "v")
        over, path = components(links)
        gone.append(path)
        over = over.select(F.col("component").alias("over"), F.col("node").alias("component"))
        alone = over.join(own, over.component == own.node, "left_anti").select(F.col("component").alias("node"), F.col("over").alias("component"))
        own = own.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component")).union(alone)
    # the row that is kept: the least id (nulls last), and of its texts that of the least hash
    row = F.struct(F.col("key").isNull().alias("none"), "key", "th").alias("row")
    named = classes.select("node", row).join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("row").alias("r"))
    names = named.join(least, "component").select("node", F.col("r.key").alias("component_id"), F.col("r.th").alias("kept_th"))
    whole = sketches.select("key", "th", "n", "node").filter("n > 0").join(names, "node")
    whole = whole.select("key", "th", F.col("n").alias("n_shingles"), "component_id", (F.col("key").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("kept_th"))).alias("kept"))
    lone = sketches.filter("n = 0").select("key", "th", F.col("n").alias("n_shingles"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    result, _ = cut(whole.union(lone).withColumnRenamed("key", key), "groups")
    for path in gone:
        discard(spark, path)
    return result


def _repeated(docs: DataFrame) -> bool:
    """Whether any id occurs twice (two narrow aggregates)."""
    return not docs.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """docs with one row of each group."""
    found = groups(docs, text=text, key=key, **settings)
    mark = F.xxhash64(text)
    k, th, n = fresh(docs, "k", "t", "n")
    gone = found.filter("NOT kept").select(F.col(key).alias(k), F.col("th").alias(th)).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rest = docs.join(gone, F.col(key).eqNullSafe(F.col(k)) & (mark == F.col(th)), "left_anti")
    twice = found.filter("kept AND n_shingles > 0").groupBy(key, "th").agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(F.col(key).alias(k), F.col("th").alias(th))
    if twice.isEmpty():
        return rest
    # rows repeated with their id: all but one of each go
    again = F.col(key).eqNullSafe(F.col(k)) & (mark == F.col(th))
    single = rest.join(twice, again, "left_anti")
    return single.unionByName(rest.join(twice, again, "left_semi").dropDuplicates([key, text]))
