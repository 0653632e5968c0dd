"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared as bit planes: plane i holds bit i of every fingerprint of a block, packed. A query's distance
to all of them grows plane by plane in carry-save counters of three bit planes, which stop at `radius + 1`; a block is
left once each of its counters has passed the radius. Which blocks meet: fingerprints are cut into five parts, and two
that differ in three bits or fewer agree in two parts at least, so each goes to ten keys of two parts. Equal
fingerprints are one node; a key gives the edges of a spanning forest of its links, not all pairs.

`near_duplicates` has the fingerprints of the query, and `near_copies` those of texts that are alike by 0.8 or more.

Defined cases: a null or empty text, or one without words, has fingerprint 0; null doc_ids take part in links, and a
component of these alone has a null id; repeated rows are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, key_text, slices
from leafmill.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Edges of the five parts of a fingerprint, in bits.
PARTS = (0, 13, 26, 39, 52, 64)
#: Fingerprints of a key that are compared in one place; a larger key is cut into blocks and each pair of blocks compared.
BLOCK = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # ASCII only, as bytes
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(flat, SEED)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps[: 1 - shingle] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(flat)]
    hashes = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)], ">u8")
    return int.from_bytes(np.packbits(2 * bit_counts(hashes[:, None]) > len(hashes)).tobytes(), "big")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of big-endian words have each bit."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        part = hashes[at : at + 255]
        counts += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return counts


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint's 64 bits as a long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    texts = key_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long, text_hash long")


class Planes:
    """A block of fingerprints, an array of 64-bit words by row, as bit planes."""

    def __init__(self, fps: np.ndarray):
        self.n, self.bits = len(fps), 64 * fps.shape[1]
        bits = np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1)
        padded = np.zeros((self.bits, -(-self.n // 64) * 64), np.uint8)
        padded[:, : self.n] = bits.T
        self.planes = np.packbits(padded, axis=1).view(np.uint64)
        self.rest = packed(np.ones((1, self.n), bool))

    def within(self, queries: np.ndarray, radius: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all fingerprints within the radius of each query; asked: the places that a query asks for.

        A counter starts so that it overflows with the first difference past the radius. Two planes go into it at a
        time, by a full adder and then its carry along the counter's planes. A query is left once all of its counters
        have overflowed, or a word of places once all in it have for each query.
        """
        flags = np.broadcast_to(self.rest, (len(queries), self.rest.shape[1])) if asked is None else packed(asked)
        width = radius.bit_length()
        start = (1 << width) - 1 - radius
        full = ~np.uint64(0)
        near, planes = flags.copy(), self.planes
        rows, words = np.arange(len(queries)), np.arange(near.shape[1])
        counter = [np.full_like(near, full if start >> b & 1 else 0) for b in range(width)]
        for i in range(0, self.bits, 2):
            pair = []
            for k in (i, i + 1):
                flip = np.where(queries[rows, k // 64] >> np.uint64(63 - k % 64) & np.uint64(1), full, np.uint64(0))
                pair.append(planes[k] ^ flip[:, None])
            either = pair[0] ^ pair[1]
            carry = (counter[0] & either) | (pair[0] & pair[1])
            counter[0] ^= either
            for c in counter[1:]:
                carry, before = carry & c, carry
                c ^= before
            near &= ~carry
            if i % 8 == 6:
                left, there = near.any(axis=1), near.any(axis=0)
                if not left.all():
                    rows, near, counter = rows[left], near[left], [c[left] for c in counter]
                if not there.all():
                    words, planes, near, counter = words[there], planes[:, there], near[:, there], [c[:, there] for c in counter]
                if not near.size:
                    break
        q, place = np.nonzero(np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1)) if near.size else (np.zeros(0, int),) * 2
        return rows[q], words[place // 64] * 64 + place % 64 if near.size else place


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words, padded with 0."""
    wide = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1).view(np.uint64)


#: Queries that are compared together with a block.
ROWS = 256


def forest(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the edges of a spanning forest of the links within each group.

    Groups stand together. side 0 and 1: links between the two sides count; 2: a group's rows all meet each other.
    """
    planes, label = Planes(fps), np.arange(len(fps))
    out: list[tuple[int, int]] = []
    for at in range(0, len(fps), ROWS):
        mine = slice(at, at + ROWS)
        asked = (group[mine, None] == group) & np.where(side[mine, None] == 2, np.arange(len(fps)) > np.arange(at, min(at + ROWS, len(fps)))[:, None], (side[mine, None] == 0) & (side == 1))
        wanted = np.flatnonzero(asked.any(axis=1))
        if not len(wanted):
            continue
        q, p = planes.within(fps[mine][wanted], radius, asked[wanted])
        q = wanted[q] + at
        for k in np.unique(q).tolist():
            there = p[q == k] if len(q) < 4096 else p[np.searchsorted(q, k) : np.searchsorted(q, k, "right")]
            for other in np.unique(label[there], return_index=True)[1].tolist():
                a, b = label[k], label[there[other]]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    out.append((k, int(there[other])))
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def keys_of_parts(fp: str = "fp") -> list:
    """Ten keys: two of the five parts of a fingerprint each."""
    parts = [F.shiftrightunsigned(fp, 64 - e).bitwiseAND((1 << (e - s)) - 1) for s, e in zip(PARTS, PARTS[1:], strict=False)]
    return [F.lit(k * 1 << 52) + parts[i] * (1 << 13) + parts[j] for k, (i, j) in enumerate(combinations(range(5), 2))]


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct fps of nodes, enough to connect all that are linked."""
    keyed = nodes.select(F.col("fp").alias("node"), F.explode(F.array(*keys_of_parts())).alias("key"))
    return compared(keyed, RADIUS, block)


def compared(keyed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of nodes that share a key and differ in `radius` bits or fewer: a spanning forest of each key's.

    keyed has (node, key), and fp, 64-bit words as bytes, or none where the node is the fingerprint. A key with more
    than `block` nodes is cut into blocks by hash, and each pair of blocks is compared in one place.
    """
    wide = "fp" in keyed.columns
    columns = ["node", "key", *(["fp"] if wide else [])]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    keyed = keyed.join(sizes, "key")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a block meets every block of its key once: (i, j) with i <= j
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = keyed.withColumn("own", own).select(*columns, "own", F.explode(meets).alias("pair")).select("key", "pair.*", "own", "node", *columns[2:])

    def solve(rows):
        node, side = rows["node"], np.where(rows["i"] == rows["j"], 2, (rows["own"] == rows["j"]).astype(int))
        a, b = forest(rows["fp"], rows["group"], side, radius)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(k).to_numpy() for k, c in enumerate(("key", "i", "j", "own", "node"))}
            if wide:
                flat = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64)
                new["fp"] = flat.reshape(batch.num_rows, -1)
            else:
                new["fp"] = new["node"].view(np.uint64)[:, None]
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            starts = np.flatnonzero(np.append(True, np.any([held[c][1:] != held[c][:-1] for c in ("key", "i", "j")], axis=0)))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(held["key"]))))
            # whole groups, about `block` rows together; the last may go on in the next batch
            done = 0
            while done < starts[-1]:
                end = int(starts[max(np.searchsorted(starts, done + block, "right") - 1, np.searchsorted(starts, done) + 1)])
                yield solve({c: x[done:end] for c, x in held.items()} | {"group": group[done:end]})
                done = end
            held = {c: x[done:] for c, x in held.items()}
        if held is not None:
            yield solve(held | {"group": np.zeros(len(held["key"]), int)})

    parts = max(2, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, root) of each row; root is the same for a component's rows."""
    marked = cut(fingerprints(docs), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    # written, so that its join with the rows is one of plain shuffles and a fingerprint's many rows can be split
    return marked.join(cut(named, "named"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


#: Near copies by likeness: words of a shingle, 64-bit words of a fingerprint, and how far two may differ: texts that share
#: 0.8 of their shingles differ in 39 bits of 256 on average, with a deviation of 6.
WORDS, LANES, LIKE = 5, 4, 46
#: Keys of a document, and shingles in a key: 0.8 alike texts share a key with probability 0.997.
KEYS, PICKS = 8, 3
_ODD = np.random.default_rng(21).integers(0, 1 << 63, LANES + KEYS * PICKS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Hashes of a text's different shingles; fewer words than `size` are one, and none are one too."""
    from xxhash import xxh3_64_intdigest

    words = np.fromiter(map(xxh3_64_intdigest, text.lower().split()), np.uint64)
    if not len(words):
        return np.zeros(1, np.uint64)
    n = max(1, len(words) - size + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        found = found * _ODD[0] + words[k : k + n]
    return np.unique(_mixed(found))


def wide_fingerprint(found: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A fingerprint of LANES words over different shingles, and the document's keys."""
    counts = bit_counts(_mixed(found[:, None] * _ODD[:LANES]).astype(">u8"))
    fp = np.packbits(2 * counts > len(found)).view(">u8").astype(np.uint64)
    least = np.array([(found * odd).min() for odd in _ODD[LANES:]], np.uint64).reshape(KEYS, PICKS)
    keys = np.arange(KEYS, dtype=np.uint64)
    for k in range(PICKS):
        keys = _mixed(keys * _ODD[1] + least[:, k])
    return fp.tobytes(), keys


def near_copies(docs: DataFrame, radius: int = LIKE, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, root) of each row; root is the same for rows whose texts are linked by likeness.

    Texts are alike if their fingerprints, over five-word shingles, differ in `radius` bits or fewer. At 0.8 of the
    shingles shared that is far more than keys of a fingerprint's own parts can find, so the documents that are compared
    are those that share a few of their shingles with the least hashes; the comparison is by bit planes as above. Equal
    shingles are one node.
    """

    def run(batches):
        for batch in slices(batches):
            got = [wide_fingerprint(shingles(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * KEYS), pa.array(np.concatenate([k for _, k in got]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f for f, _ in got], pa.binary()), keys], names=["doc_id", "text_hash", "fp", "keys"])

    texts = key_text(docs).withColumn("text_hash", F.xxhash64("text"))
    marked = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp binary, keys array<long>").withColumn("node", F.xxhash64("fp"))
    marked = cut(marked, "fingerprints")
    nodes = marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = cut(nodes.select("node", F.explode("keys").alias("key"), "fp"), "keys")
    roots = cut(components(compared(keyed, radius, block)), "roots")  # as above
    return marked.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def representatives(marked: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of one document for each component: the least doc_id (a null one last), then the least hash."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    return marked.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
