"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word
shingles. Fingerprints at most ``radius`` bits apart are linked, and a component of links is a
group of near copies.

Candidate pairs come from a covering family (Pagh, "Locality-sensitive hashing without false
negatives", 2016): each bit position i gets a vector m(i) of radius + 1 bits, and each nonzero
vector v keeps the positions with <m(i), v> = 1. Any ``radius`` positions leave some v orthogonal
to all of theirs, so a pair within the radius agrees on all kept bits of some table: no pair is
lost, with 2^(radius+1) - 1 tables of about half the bits each.

Equal fingerprints are merged before any table is built. A bucket is scanned in key order and
linked by a search that leaves a spanning forest, never all pairs. Buckets above ``bucket`` rows
are not compared: their members meet through every value within radius / 2 bits (a shared value
proves a link, and every link has one), a number of rows linear in the members.

Copies by Jaccard similarity of shingles (``near_copy_components``) are first sought in the same
way, and their links verified on the whole sets. A pair can be similar and yet leave every such
radius, so those not linked by then have further candidates: pairs that agree on minimum hashes, or
share one of their rarest shingles where these are too many; see there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, FILE_ROWS, connected_components, dropped, like, maybe_broadcast, released, staged

BITS = 64
#: A-Z to a-z on UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles hashed at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 16


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """Bit masks, one for each nonzero v of radius + 1 bits; position i is kept where <m(i), v> is odd."""
    import random

    # Every nonzero vector is dealt about equally often, which keeps the tables' widths even.
    size = (1 << (radius + 1)) - 1
    dealt = [1 + i % size for i in range(bits)]
    random.Random(seed).shuffle(dealt)
    return [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_bytes(text: bytes | None, width: int) -> Iterator[list[bytes]]:
    """Blocks of the shingles of a text, in order, repeats included."""
    words = (text or b"").translate(LOWER).split()  # splits at \x20 and \x09-\x0D only
    if not words:
        return
    if len(words) < width:
        yield [b" ".join(words)]
        return
    for at in range(0, len(words) - width + 1, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        joined, ends, pos = b" ".join(part), [], -1
        for w in part:
            pos += len(w) + 1
            ends.append(pos)
        starts = [0, *(x + 1 for x in ends)]
        yield [joined[i:j] for i, j in zip(starts, ends[width - 1 :])]


def mixed(h, seed: int):
    """Hashes made from hashes (the finaliser of splitmix64), so that a shingle is read once."""
    import numpy as np

    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: bytes | None, width: int, seeds: tuple[int, ...], most: float | None = None) -> list[int]:
    """One 64-bit value for each seed, as signed integers; the first takes XXH64 itself, the others mix it.

    most: the largest share of all shingles that one of them counts for, so that a sign between all
    words does not make every text alike.
    """
    import numpy as np
    from xxhash import xxh64_intdigest as hashed

    counts, n = np.zeros((len(seeds), BITS), dtype=np.int64), 0
    blocks = shingle_bytes(text, width)
    if most is not None:
        held = Counter(s for b in blocks for s in b)
        cap = max(1, int(most * held.total()))
        weight = np.minimum(np.fromiter(held.values(), np.int64, len(held)), cap)
        first = np.array([hashed(s, seeds[0]) for s in held], dtype="<u8")
        for k, seed in enumerate(seeds):
            bits = np.unpackbits((mixed(first, seed) if k else first).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] = weight.astype(np.float64) @ bits  # exact: whole numbers
        return np.packbits(counts * 2 > weight.sum(), axis=1, bitorder="little").view("<i8").ravel().tolist()
    for block in blocks:
        n += len(block)
        first = np.array([hashed(s, seeds[0]) for s in block], dtype="<u8")
        for k, seed in enumerate(seeds):
            h = (mixed(first, seed) if k else first).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(h), 255):  # a byte holds the sums of 255 bits
                counts[k] += np.unpackbits(h[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, plan: tuple[tuple[int, tuple[int, ...], float | None], ...]) -> DataFrame:
    """id and ``fps``: for each (shingle width, seeds, most) of plan, one value a seed. Null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [[x for how in plan for x in fingerprint(t.as_py(), *how)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "fps"])
        released()

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    return picked.mapInArrow(run, "id long, fps array<long>")


def _forest(batches, radius: int, slack: int, first_check: int, bucket: int):
    """Rows (key, node, bits, check) in key and node order to links (a, b); rows of large buckets pass as hot."""
    import numpy as np
    import pyarrow as pa

    def linked(left, x, bits, check):
        """Those of ``left`` that link to x; check values are compared only where the first test holds."""
        hit = np.bitwise_count(bits[left] ^ bits[x]) <= radius
        if check.shape[1] and hit.any():
            at = np.flatnonzero(hit)
            hit[at] = np.bitwise_count(check[left[at]] ^ check[x]).sum(axis=1) <= slack
        return hit

    def group(node, bits, check, out):
        left = np.arange(len(node))
        while len(left) > 1:
            root, todo, left = left[0], [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = linked(left, x, bits, check)
                if hit.any():
                    found = left[hit]
                    out.append((node[found], np.full(len(found), node[root])))
                    todo.extend(found.tolist())
                    left = left[~hit]

    def table(out, hot):
        a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.int64)
        b = np.concatenate([x for _, x in out]) if out else np.empty(0, np.int64)
        n, m = len(a), sum(len(h[0]) for h in hot)
        none = pa.nulls(n, pa.list_(pa.int64()))
        checks = [c.view(np.int64).tolist() for h in hot for c in h[2]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, *(h[0] for h in hot)])), pa.array(np.concatenate([b, *(h[1].view(np.int64) for h in hot)])), pa.array(np.arange(n + m) >= n), pa.concat_arrays([none, pa.array(checks, pa.list_(pa.int64()))])],
            names=["a", "b", "hot", "check"],
        )

    key = node = bits = check = None
    hot_key = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
        new = [new[0], new[1], new[2].view(np.uint64), flat.view(np.uint64).reshape(b.num_rows, -1) if len(flat) else np.zeros((b.num_rows, 0), np.uint64)]
        out, hot = [], []
        if hot_key is not None:
            cont = int(np.searchsorted(new[0] != hot_key, True)) if (new[0] != hot_key).any() else len(new[0])
            if cont:
                hot.append((new[1][:cont], new[2][:cont], new[3][:cont]))
                new = [x[cont:] for x in new]
            if len(new[0]):
                hot_key = None
        if key is not None:
            new = [np.concatenate([x, y]) for x, y in zip((key, node, bits, check), new)]
        key, node, bits, check = new
        if len(key):
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            edges = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([edges, [len(key)]]))
            for i in np.flatnonzero(sizes[:-1] > 1):
                s, t = edges[i], edges[i] + sizes[i]
                if t - s > bucket:
                    hot.append((node[s:t], bits[s:t], check[s:t]))
                else:
                    group(node[s:t], bits[s:t], check[s:t], out)
            s = edges[-1]  # the last bucket may go on in the next batch
            key, node, bits, check = key[s:], node[s:], bits[s:], check[s:]
            if len(key) > bucket:
                hot_key = key[0]
                hot.append((node, bits, check))
                key = None
        if out or hot:
            yield table(out, hot)
    if key is not None and len(key) > 1:
        out = []
        group(node, bits, check, out)
        if out:
            yield table(out, [])


def _ball(bits: Column, radius: int) -> Column:
    """All values within radius bits, as an array."""
    from itertools import combinations

    masks = [signed(sum(1 << i for i in c)) for k in range(radius + 1) for c in combinations(range(BITS), k)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: bits.bitwiseXOR(m))


def links(nodes: DataFrame, radius: int, bucket: int = 16384) -> DataFrame:
    """Spanning links (a, b) of ``nodes(node, tables array<long>, check array<long>)``.

    Two nodes are linked if for some i their tables[i] differ in at most radius bits; components
    are exactly those of all links. ``check`` is empty.
    """
    masks = covering_masks(radius)
    width = len(masks)
    # One generator of width values a fingerprint; the key is a hash, and exact comparison follows.
    each = nodes.select("node", "check", F.posexplode("tables").alias("f", "bits"))
    keys = F.transform(F.array(*(F.lit(signed(m)) for m in masks)), lambda m, i: F.xxhash64(F.col("f"), i, F.col("bits").bitwiseAND(m)))
    rows = each.select("node", "bits", "check", F.explode(keys).alias("key")).select("key", "node", "bits", "check")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "node")
    found = staged(sorted_rows.mapInArrow(lambda b: _forest(b, radius, 0, width, bucket), "a long, b long, hot boolean, check array<long>"))
    out = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("node"), F.col("b").alias("bits"), "check").distinct()
    if hot.limit(1).count():
        near = hot.select("node", "check", F.explode(_ball(F.col("bits"), (radius + 1) // 2)).alias("key"))
        low = near.groupBy("key").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m <> x").select("key", "m")
        more = near.join(low, "key").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
        out = out.union(more)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, radius: int = 4, seed: int = 42, bucket: int = 16384) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (signed long), component_id.

    Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer
    words than ``width`` form one shingle; equal fingerprints are always one component; rows with
    a null id keep a row, and their component is the smallest id of the others, or null; repeated
    rows repeat in the result; other columns of docs are not read; an empty table gives no rows.
    """
    if radius % 2:
        raise ValueError("radius must be even: large buckets meet at radius / 2")
    n = docs.count()
    fps = staged(fingerprints(docs, id_col, text_col, ((width, (seed,), None),)).select(F.col("id").alias("doc_id"), F.element_at("fps", 1).alias("fingerprint")), like(docs))
    nodes = staged(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), n)
    known = nodes.where("node is not null").select("node", F.array("fingerprint").alias("tables"), F.array().cast("array<long>").alias("check"))
    comp = connected_components(links(known, radius, bucket=bucket), "a", "b", most=n)
    ids = staged(nodes.join(comp, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id")), n)
    return fps.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_set(text: bytes | None, width: int):
    """Sorted distinct XXH64 hashes of the shingles of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest as hashed

    parts = [np.unique(np.array([hashed(s) for s in block], dtype="<u8")) for block in shingle_bytes(text, width)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, "<u8")


def minima(held, count: int):
    """``count`` minimum hashes of a set; all ones for the empty set."""
    import numpy as np

    salt = np.arange(1, count + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    low = np.full(count, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(held), 1024):
        h = (held[at : at + 1024][None, :] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(low, h.min(axis=1), out=low)
    return low


def band_keys(low, bands: int, rows: int) -> list[int]:
    """One key for each band of ``rows`` minimum hashes, as signed integers."""
    import numpy as np

    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key ^ low[r::rows], r + 1)
    return key.view(np.int64).tolist()


def set_fingerprint(held) -> int:
    """The fingerprint of a set of hashes, each counted once, as a signed integer; zero for the empty set."""
    import numpy as np

    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(held), 255):  # a byte holds the sums of 255 bits
        counts += np.unpackbits(held[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(held), bitorder="little").view("<i8")[0])


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """row, id, copy (a hash of the text), same (a hash of the whole set), n, fp (its fingerprint), bands, lanes (a byte of each minimum hash) and held (the set itself, 8 bytes a shingle)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                sets = [shingle_set(t.as_py(), width) for t in part.column(3)]
                held = [x.tobytes() for x in sets]
                low = [minima(x, bands * rows) for x in sets]
                keys = pa.array([band_keys(x, bands, rows) if len(y) else [] for x, y in zip(low, sets)], pa.list_(pa.int64()))
                lanes = pa.array([(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in low], pa.binary())
                cols = [*part.columns[:3], pa.array([xxh3_128_digest(x) for x in held], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_fingerprint(x) for x in sets], pa.int64()), keys, lanes, pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "copy", "same", "n", "fp", "bands", "lanes", "held"])
        released()

    text = docs[text_col].cast("binary")
    picked = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), text_key(text).alias("copy"), text.alias("text"))
    return picked.mapInArrow(run, "row long, id long, copy long, same binary, n long, fp long, bands array<long>, lanes binary, held binary")


def text_key(text: Column) -> Column:
    """A hash that tells rows of one id apart by their texts; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def _compared(pairs: DataFrame, values: DataFrame, column: str, keep, weight: int, most: int) -> DataFrame:
    """The pairs (a, b, u, v) that keep(x, y) holds for, given arrays of values(node, column) of a and b."""

    def run(batches):
        import pyarrow as pa

        for p in batches:
            if p.num_rows:
                hit = keep(p.column(4), p.column(5))
                yield pa.RecordBatch.from_arrays(p.columns[:4], names=["a", "b", "u", "v"]).filter(pa.array(hit, pa.bool_()))
        released()

    asked = _hinted(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), 2 * most)
    held = values.join(asked, "node", "left_semi")
    wide = pairs.join(held.select(F.col("node").alias("a"), F.col(column).alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")
    return staged(wide.select("a", "b", "u", "v", "x", "y").mapInArrow(run, "a long, b long, u long, v long"), weight * most)


def _hinted(df: DataFrame, most: int) -> DataFrame:
    """maybe_broadcast without a count where a bound on the rows is known and small."""
    return F.broadcast(df) if most <= BROADCAST_ROWS else maybe_broadcast(df)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """Those of the pairs (a, b, u, v) whose a and b have, in ``sets(node, lanes, held)``, at least that Jaccard similarity.

    Of m minimum hashes a pair of similarity s shares m * s, give or take. Pairs of 4.4 standard
    deviations fewer (5 in a million at the least similarity asked for) are left out before their
    whole sets are fetched.
    """

    def agree(x, y):
        import numpy as np

        a, b = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (x, y))
        m = a.shape[1]
        return (a == b).sum(axis=1) >= m * similarity - 4.4 * (m * similarity * (1 - similarity)) ** 0.5

    def exact(x, y):
        import numpy as np

        hit = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            hit.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
        return hit

    near = _compared(pairs, sets, "lanes", agree, 2, most)
    found = _compared(near, sets, "held", exact, 16, near.count())
    dropped(near)
    return found


def reached(a, b):
    """The nodes of the edges (a, b), and the smallest node that each one reaches."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low, before = np.arange(len(nodes)), None
    while before is None or (low != before).any():
        before = low
        least, low = np.minimum(low[x], low[y]), low.copy()
        for end in (x, y, before[x], before[y]):
            np.minimum.at(low, end, least)
        while (low[low] != low).any():
            low = low[low]
    return nodes, nodes[low]


def _merged(edges: DataFrame, most: int) -> DataFrame:
    """node, component of the staged edges (a, b), at most so many.

    As many edges as may be broadcast are one task of a fixed size, which spares the driver some
    dozen small jobs; more of them take rounds over the cluster.
    """
    if most > BROADCAST_ROWS:
        return staged(connected_components(edges, "a", "b", most=most), 2 * most)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches if b.num_rows]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reached(a, b)], names=["node", "component"])
        released()

    return staged(edges.select("a", "b").where("a <> b").coalesce(1).mapInArrow(run, "node long, component long"), 2 * most)


def _placed(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """rows with the component of their node, itself where comp(node, component) has none."""
    if comp is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _turns(members: DataFrame, comp: DataFrame | None, sets: DataFrame, similarity: float, bucket: int, every: bool, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Link members(key, node, n, p, component) within their buckets: components so far, and the nodes of buckets that are still open.

    comp has the components of all nodes, at most so many, and those of members are taken from it.
    n is the size of a node's set, p the place of the key in it, 1 where keys have no order. Each
    turn links the members of a bucket to a representative, one for every ``bucket`` members: first
    the one that has least before the key, then others drawn at random; only pairs of a bucket in
    different components are open. A bucket of one component is settled for good, so a turn reads
    only what the one before left open, and components are joined by what it has merged alone.
    Turns end when one links little. every: then, or once open pairs are no more than members, all
    are compared whose sizes and places allow the similarity: behind the first shingle that two
    sets share, in the order of keys, they can share no more than either has left.
    """
    state, n_members, turn, fruitful = members, members.count(), 0, True
    left_over = F.least(F.col("n") - F.col("p"), F.col("o") - F.col("q")) + 1
    near = left_over >= similarity / (1 + similarity) * (F.col("n") + F.col("o")) - 1e-9  # so much do alike sets share
    while True:
        parts = state.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        held = parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        held = staged(held, n_members)
        open_pairs, rows = held.agg(F.sum((F.col("m").cast("double") * F.col("m") - F.col("sq")) / 2), F.sum("m")).first()
        if not open_pairs:
            dropped(held)
            if turn:
                dropped(state)
            return comp, None
        opened = state.join(held.select("key", "m"), "key")
        last = every and (open_pairs <= rows or not fruitful)
        if last:
            left, right = opened.select("key", "node", "n", "p", "component"), opened.select("key", F.col("node").alias("b"), F.col("n").alias("o"), F.col("p").alias("q"), F.col("component").alias("other"))
            pairs = left.join(right, "key").where(F.col("component") < F.col("other"))
        elif not fruitful:
            return comp, opened.select("node").distinct()
        else:
            dealt = opened.withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("m") / bucket)))
            own = F.lit(0.0) if turn else F.col("p") / F.col("n")
            drawn = dealt.groupBy("key", "part").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("o"), F.col("p").alias("q"), F.col("component").alias("other")), F.struct(own, F.xxhash64("node", F.lit(turn), F.lit("drawn")))).alias("x"))
            pairs = dealt.join(drawn.select("key", "part", "x.*"), ["key", "part"]).where(F.col("component") != F.col("other"))
        ends = [f("node", "b").alias(x) for x, f in (("a", F.least), ("b", F.greatest))] + [f("component", "other").alias(x) for x, f in (("u", F.least), ("v", F.greatest))]
        pairs = staged(pairs.where(near).select(*ends).distinct(), int(open_pairs if last else rows))
        n_pairs = pairs.count()
        new = _alike(pairs, sets, similarity, n_pairs) if n_pairs else pairs
        n_new = new.count() if n_pairs else 0
        fruitful = n_new * 16 >= n_pairs and n_new > 0
        before = (state if turn else None, comp if turn else None)
        if n_new:
            # Components that met before are one node by now, so only what is new has to be worked out.
            merged = _merged(new.select(F.col("u").alias("a"), F.col("v").alias("b")), n_new)
            moved = _hinted(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), 2 * n_new)
            now = lambda d: d.join(moved, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
            comp = merged if comp is None else staged(now(comp).select("node", "component").unionByName(merged.join(comp.select("node"), "node", "left_anti")), most)
            if not last:
                state = staged(now(opened.drop("m")).select("key", "node", "n", "p", "component"), int(rows))
            for used in (*before, merged if comp is not merged else None):
                dropped(used)
        for used in (held, pairs, new):
            dropped(used)
        if last:
            return comp, None
        turn += 1


def prefixes(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """key, node, n, p, component: the shingles by which a node of ``nodes(node, component)`` can be alike to another one of them.

    Shingles are put in one order, those in fewest sets first. Two sets of the similarity share one
    of each one's first n - ceil(similarity * n) + 1 (Chaudhuri, Ganti and Kaushik, 2006); shingles
    of one set alone take places there but join nothing, so a set of much that is its own has no
    keys at all. p is a key's place in its set.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for node, component, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(held.as_buffer(), "<u8").view(np.int64)
                for at in range(0, len(x), 50_000):
                    part = x[at : at + 50_000]
                    cols = [pa.array(part), *(pa.array(np.full(len(part), v)) for v in (node, len(x), component))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "n", "component"])
        released()

    wanted = sets.select("node", "held").join(maybe_broadcast(nodes), "node").select("node", "component", "held")
    tokens = staged(wanted.mapInArrow(run, "key long, node long, n long, component long"))
    often = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by = Window.partitionBy("node")
    placed = tokens.join(often, "key").withColumn("place", F.row_number().over(by.orderBy("df", "key"))).withColumn("shared", F.count(F.lit(1)).over(by))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    place = F.col("n") - F.col("shared") + F.col("place")  # those of one set alone come first
    out = staged(placed.select("key", "node", "n", place.alias("p"), "component", first.alias("first")).where("p <= first").drop("first"))
    dropped(tokens)
    return out


def fingerprint_groups(nodes: DataFrame, radius: int, bucket: int, most: int) -> DataFrame:
    """key, node, n, p: the nodes(node, n, fp) whose fingerprints are in one component of links within the radius, under its key."""
    each = staged(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("many")), most)
    edges = staged(links(each.select("node", F.array("fp").alias("tables"), F.array().cast("array<long>").alias("check")), radius, bucket=bucket), most)
    comp = _merged(edges, edges.count())
    keys = staged(each.join(comp, "node", "left").where("component is not null or many > 1").select("fp", F.coalesce("component", "node").alias("key")), most)
    out = staged(nodes.join(maybe_broadcast(keys), "fp").select("key", "node", "n", F.lit(1).cast("long").alias("p")), most)
    for used in (each, edges, comp, keys):
        dropped(used)
    return out


def jaccard_components(near: DataFrame, members, sets: DataFrame, similarity: float, bucket: int, most: int = FILE_ROWS) -> DataFrame | None:
    """node, component of all links among ``near`` and ``members(key, node, n, p)``: pairs of one key and a Jaccard similarity reached.

    near: groups by fingerprints, which go first; members: buckets of minimum hashes, in which only
    what these leave apart is compared, as a table or as a function that makes it (with component)
    from the components so far; most: a bound on the nodes. Buckets are settled by representatives as far as these link much: groups of copies, whatever
    their size. What is left open are sets that meet by something common, such as a passage. These
    meet again by their rarest shingles, which loses no pair either, and only the few that share
    such a one are compared.
    """
    first, apart = _turns(_placed(near, None), None, sets, similarity, bucket, False, most)
    held = members(first) if callable(members) else _placed(members, first)
    comp, left = _turns(held, first, sets, similarity, bucket, False, most)
    if first is not None and comp is not first:
        dropped(first)
    both = [x for x in (apart, left) if x is not None]
    if not both:
        dropped(held)
        return comp
    open_nodes = _placed(both[0] if len(both) == 1 else both[0].union(both[1]).distinct(), comp)
    keys = prefixes(staged(open_nodes.select("node", "component"), most), sets, similarity)
    out = _turns(keys, comp, sets, similarity, bucket, True, most)[0]
    dropped(keys)
    dropped(held)
    return out


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, similarity: float = 0.8, radius: int = 4, bands: int = 24, rows: int = 4, bucket: int = 16384) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.

    One row for each row of docs: doc_id, copy (a hash of its text), component_id (the smallest id
    of its group) and component_copy (the hash that goes with it), so that rows which repeat an id
    can be told apart.

    SimHash comes first: sets whose fingerprints are linked within ``radius`` bits by the covering
    tables are candidates, as in simhash_components. A few edited words change ``width`` shingles
    each, so other pairs of the similarity leave any radius that a covering family can afford.
    Among what is not linked by then, candidates agree on all ``rows`` minimum hashes of one of ``bands`` bands, which a pair of
    similarity s misses with probability (1 - s ** rows) ** bands whatever the shape of the edit
    (3 in a million at 0.8). Every link is verified on the whole sets before it counts; see
    jaccard_components for buckets that grow large.
    Nulls, repeats and empty tables as in simhash_components.
    """
    n = docs.count()
    cut = staged(sketches(docs, id_col, text_col, width, bands, rows), like(docs))
    known = F.when(F.col("id").isNotNull(), F.struct("id", "copy"))
    nodes = staged(cut.groupBy("same").agg(F.min(known).alias("low"), F.min(F.struct("row", "n", "fp", "bands")).alias("x")).select("same", "low", F.col("x.row").alias("node"), "x.n", "x.fp", "x.bands"), 8 * n)
    key = Window.partitionBy("key")

    def members(comp: DataFrame | None) -> DataFrame:
        """Buckets of bands that hold nodes of more than one component; buckets of the same members are one."""
        each = _placed(nodes.where("low is not null").select("node", "n", "bands"), comp).select("node", "n", "component", F.explode("bands").alias("key"))
        marks = [F.min("node").over(key).alias("first"), F.count(F.lit(1)).over(key).alias("many"), F.bit_xor(F.xxhash64("node")).over(key).alias("mark")]
        each = each.select("node", "n", "component", *marks, (F.min("component").over(key) != F.max("component").over(key)).alias("open")).where("open")
        return staged(each.select(F.xxhash64("first", "many", "mark").alias("key"), "node", "n", F.lit(1).cast("long").alias("p"), "component").distinct(), bands * n)

    near = fingerprint_groups(nodes.where("low is not null").select("node", "n", "fp"), radius, bucket, n)
    comp = jaccard_components(near, members, cut.select(F.col("row").alias("node"), "lanes", "held"), similarity, bucket, n)
    ids = nodes.select("same", "low", F.col("node").alias("component")) if comp is None else nodes.join(comp, "node", "left").select("same", "low", F.coalesce("component", "node").alias("component"))
    lows = ids.groupBy("component").agg(F.min("low").alias("lowest"))
    ids = staged(ids.join(lows, "component").select("same", "lowest"), 2 * n)
    out = cut.select(F.col("id").alias("doc_id"), "copy", "same").join(ids, "same")
    out = staged(out.select("doc_id", "copy", F.col("lowest.id").alias("component_id"), F.col("lowest.copy").alias("component_copy")), 2 * n)
    for used in (cut, nodes, near, comp, ids):
        dropped(used)
    return out
