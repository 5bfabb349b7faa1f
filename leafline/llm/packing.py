"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most
``capacity`` counts, whatever the number of documents. The plan is made on counts alone.
Martello and Toth's dominance reduction first fixes sets that some optimal packing has: the
largest length with nothing, with one partner or with two, where no other feasible set for that
sequence could do better. Best-fit decreasing places the rest. Both work on whole classes of
equal sequences, so the plan has few groups, and every document finds its place by its rank
within its length, which needs one small join.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import like, released, staged

#: One text in so many, by a hash of it, is encoded in both ways and has to agree.
PROVED = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def merge_loop(path: str):
    """A function from text to bytes of ids built from a byte-level BPE file, or None if its merges are not in id order."""
    import json
    import sys

    if sys.byteorder != "little":
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, pre = held["model"], held.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or held.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    special = {t["content"] for t in held.get("added_tokens", [])}
    ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [model["vocab"].get(t, -1) for t in joined]
    if ids != sorted(set(ids)) or min(ids) < 256 or len(ids) + 256 != len(ranks):
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value: the byte-level pre-tokeniser's
    encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    return lambda text: encode(text, disallowed_special=()).tobytes()


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes: those of the tokenizers library for a file.

    A byte-level BPE file whose merges are in the order of their ids is the vocabulary that
    tiktoken's faster merge loop takes, so texts of Latin script, where the two splitters agree by
    construction, go through that loop, built from the same file. Any other text, one that spells
    an added token, and any file of another kind goes through tokenizers itself. One text in
    PROVED goes through both, and a difference fails the task.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = "|".join(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values())
        self.foreign = re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]" + (f"|{added}" if added else "")).search
        self.fast = merge_loop(path)

    def direct(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        import zlib

        if self.fast is None or self.foreign(text):
            return self.direct(text)
        out = self.fast(text)
        if zlib.crc32(out) % PROVED == 0 and out != self.direct(text):
            raise ValueError("the merge loop and tokenizers differ on a text")
        return out


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan for counts[length] pieces: (number of sequences, [(length, pieces in each)]) groups."""
    left = {s: n for s, n in counts.items() if n > 0}
    groups: list[tuple[int, list[tuple[int, int]]]] = []

    def fix(times: int, lengths: list[int]) -> None:
        each: dict[int, int] = defaultdict(int)
        for s in lengths:
            each[s] += 1
        for s, k in each.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        groups.append((times, sorted(each.items(), reverse=True)))

    def times(lengths: list[int]) -> int:
        return min(left[s] // lengths.count(s) for s in set(lengths))

    def alike(lengths: list[int]) -> int:
        """Sequences in a row that meet the same conditions: these ask for four pieces of a length at most."""
        return max(1, min((left[s] - 4) // lengths.count(s) + 1 for s in set(lengths)))

    kept: list[int] = []  # lengths that the reduction cannot settle
    for s in sorted(left, reverse=True):
        while s in left:
            room = capacity - s
            others = sorted(k for k, n in left.items() if n - (k == s) > 0)  # what may join one piece of s
            low = others[0] if others else capacity + 1
            if low > room:
                fix(left[s], [s])
                continue
            k = others[bisect_right(others, room) - 1]
            if k == room:  # a full sequence: nothing does better
                fix(times([s, k]), [s, k])
                continue
            smallest: list[int] = []
            for x in others[:3]:
                smallest += [x] * min(3, left[x] - (x == s))
            smallest = smallest[:3]
            if len(smallest) < 2 or sum(smallest[:2]) > room:  # one partner at most, the largest dominates
                fix(times([s, k]), [s, k])
                continue
            if len(smallest) < 3 or sum(smallest) > room:  # two partners at most
                best, seconds = 0, 0  # the fullest pair, and the largest that a lesser half of a pair can be
                for a in reversed(others[: bisect_right(others, room)]):
                    spare = left[a] - (a == s)
                    at = bisect_right(others, min(room - a, a if spare > 1 else a - 1)) - 1
                    if at >= 0:
                        best, seconds = max(best, a + others[at]), max(seconds, others[at])
                if k >= best:  # no pair fills more than k alone
                    fix(times([s, k]), [s, k])
                    continue
                b_at = bisect_right(others, min(room - k, k if left[k] - (k == s) > 1 else k - 1)) - 1
                if b_at >= 0 and others[b_at] >= seconds and times([s, k, others[b_at]]):  # k and b bound every feasible pair piece by piece
                    fix(alike([s, k, others[b_at]]), [s, k, others[b_at]])
                    continue
            kept.append(s)
            break
    return groups + best_fit(left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on counts: equal sequences are one class."""
    open_by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        n = counts[s]
        for room in sorted(r for r in open_by_room if r >= s):
            while n and open_by_room[room]:
                many, held = open_by_room[room].pop()
                each = room // s  # best fit stays with a sequence while it is the fullest that has room
                full = min(many, n // each)
                if full:
                    open_by_room[room - each * s].append((full, (*held, (s, each))))
                    n -= full * each
                if full < many:
                    rest = many - full
                    if 0 < n < each:
                        open_by_room[room - n * s].append((1, (*held, (s, n))))
                        n, rest = 0, rest - 1
                    if rest:
                        open_by_room[room].append((rest, held))
                    if not n:
                        break
            if not n:
                break
        each = capacity // s
        if n // each:
            open_by_room[capacity - each * s].append((n // each, ((s, each),)))
        if n % each:
            open_by_room[capacity - n % each * s].append((1, ((s, n % each),)))
    return [(many, list(held)) for classes in open_by_room.values() for many, held in classes]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, and the rank of the piece in its task and length."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import zlib

        import pyarrow as pa

        encode, end, task, seen = Encoder(path), end_id.to_bytes(4, "little"), None, defaultdict(int)
        for b in batches:
            rows = []
            if task is None and b.num_rows:
                task = b.column(2)[0].as_py() >> 33  # the partition, whatever task reads it
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(t.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity  # only the first piece can be shorter
                    part = memoryview(ids)[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, size, zlib.crc32(part), task, seen[size]))
                    seen[size] += 1
                    at, k = at + size, k + 1
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
        del encode
        released()

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees one count for each length. Ranks within a length come from counts by task
    and length, so no length's pieces meet in one task.

    Defined cases: a null or empty text is its end id alone; null ids and repeated rows keep their
    pieces; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, id_col, text_col, capacity=capacity, end_id=end_id, tokenizer=tokenizer), like(docs))
    held = staged(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), cut.count())
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots, base = defaultdict(list), 0
    ranks: dict[int, int] = defaultdict(int)
    for many, held_in in reduce_and_fit(counts, capacity):
        offset = 0
        for length, each in held_in:
            slots[length].append((ranks[length], each, base, offset))
            ranks[length] += many * each
            offset += length * each
        base += many
    table = spark.sparkContext.broadcast(dict(slots))  # groups are bounded by capacity, not by the documents

    # Where a task's pieces of a length begin. One row a task and length: a fraction of a percent of the pieces.
    from pyspark.sql import Window

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("begin").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                size = int(length[rows[0]])
                first, each, start, offset = (np.array(x, dtype=np.int64) for x in zip(*table.value[size]))
                g = np.searchsorted(first, rank[rows], side="right") - 1
                within = rank[rows] - first[g]
                seq[rows] = start[g] + within // each[g]
                off[rows] = offset[g] + within % each[g] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(begins, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "begin")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
